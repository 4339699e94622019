"""Language identification by prediction by partial matching (PPM).

Each language is a byte context tree of variable order, learned once and then frozen. A byte's probability in the longest
known context is its share of the counts there; a byte not seen there is reached by an escape (method C: as likely as the
number of different bytes seen) to the next shorter context, from which the bytes already ruled out are excluded; below
order 0 all 256 bytes are alike. A text's code length in a language is the exact sum of -log2 of these over its UTF-8 bytes,
and the language with the shortest code is predicted.

With frozen statistics a tree is a finite automaton: a state for each context and, for every byte, its cost and the next
state. Texts are cut into segments that are stepped through side by side; since a state depends on the last ``order`` bytes
only, a segment that starts that many bytes early is in the right state, and the sum is the same as for the uncut text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.scratch import bounded_batches

LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ContextTree:
    """The automaton of one language. cost[state, symbol] in bits, step[state, symbol]; symbol_of maps bytes to symbols."""

    cost: np.ndarray
    step: np.ndarray


def learn(counted: dict[bytes, tuple[np.ndarray, np.ndarray]], symbols: np.ndarray) -> ContextTree:
    """A tree from contexts: the bytes that follow each, and how often.

    A context is kept if its own shorter contexts are there, so the tree is deeper where there is more to know. ``symbols``
    maps a byte to its column; bytes that no language has seen share column 0 and are 1/256 each at the root.
    """
    width = int(symbols.max()) + 1
    seen: dict[bytes, np.ndarray] = {b"": np.zeros(width)}
    for context, (follow, n) in counted.items():
        np.add.at(seen.setdefault(context, np.zeros(width)), symbols[follow], n)
    contexts = sorted((c for c in seen if all(c[i:] in seen for i in range(1, len(c) + 1))), key=lambda c: (len(c), c))
    number = {c: k for k, c in enumerate(contexts)}
    chance = np.zeros((len(contexts), width))
    for c in contexts:
        counts = seen[c]
        # Bytes without a column of their own are alike: one of them costs as much as the next.
        below = chance[number[c[1:]]] if c else np.full(width, 1 / 256)
        known = counts > 0
        total, kinds = counts.sum(), known.sum()
        if not kinds:
            chance[number[c]] = below
            continue
        ruled_out = below[known].sum()
        left = max(1 - ruled_out, 1e-12)
        chance[number[c]] = np.where(known, counts / (total + kinds), below / left * (kinds / (total + kinds)))
    step = np.zeros((len(contexts), width), dtype=np.int32)
    of_symbol = {int(symbols[b]): b for b in range(256) if symbols[b]}
    for c in contexts:
        for s, b in of_symbol.items():
            after = c + bytes([b])
            while after not in number:
                after = after[1:]
            step[number[c], s] = number[after]
    return ContextTree(-np.log2(np.maximum(chance, 1e-300)).astype(np.float32), step)


class PpmModel:
    """Context trees of several languages over one alphabet, laid one after the other in flat tables."""

    def __init__(self, trees: dict[str, ContextTree], symbols: np.ndarray, order: int):
        self.languages, self.order, self.symbols = sorted(trees), order, symbols.astype(np.uint8)
        if not trees:
            return
        self.width = int(symbols.max()) + 1
        bases = np.cumsum([0, *(len(trees[x].cost) for x in self.languages)])
        self.roots = (bases[:-1] * self.width).astype(np.int32)
        self.cost = np.concatenate([trees[x].cost.ravel() for x in self.languages])
        # A step leads to the row's first place in the flat table, so that adding a symbol gives the next place.
        self.step = np.concatenate([((trees[x].step + base) * self.width).ravel().astype(np.int32) for x, base in zip(self.languages, bases, strict=False)])

    def code_lengths(self, texts: list[bytes], segment: int = 1024) -> np.ndarray:
        """Bits of each text in each language: float64[len(texts), len(languages)]."""
        starts, owners, heads = [], [], []
        data = b"".join(texts)
        at = 0
        for k, t in enumerate(texts):
            for s in range(0, len(t), segment):
                head = min(self.order, s)
                starts.append(at + s - head)
                heads.append(head)
                owners.append((k, min(segment, len(t) - s) + head))
            at += len(t)
        bits = np.zeros((len(texts), len(self.languages)))
        if not starts:
            return bits
        owner, length = np.array(owners).T
        by = np.argsort(-length, kind="stable")
        start, head, owner, length = np.array(starts)[by], np.array(heads)[by], owner[by], length[by]
        codes = self.symbols[np.frombuffer(data + b"\0", dtype=np.uint8)]
        live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # segments longer than i
        n = len(self.languages)
        state = np.repeat(self.roots[:, None], len(start), axis=1)
        total = np.zeros((n, len(start)), dtype=np.float64)
        for i in range(int(length[0])):
            m = int(live[i])
            place = state[:, :m] + codes[start[:m] + i]
            paid = self.cost[place]
            if i < self.order:
                paid *= head[:m] <= i
            total[:, :m] += paid
            state[:, :m] = self.step[place]
        np.add.at(bits, owner, total.T)
        return bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its posterior probability for equal priors, and bits a byte in that language.

        The codes of a text are compared over all its bytes. ``und``, 0 and 8 for null and for texts without a letter.
        """
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        names, scores, rate = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
        if known:
            coded = [texts[k].encode("utf-8", "replace") for k in known]
            bits = self.code_lengths(coded)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(known)), best]
            for k, b in zip(known, best, strict=True):
                names[k] = self.languages[b]
            scores[known] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            rate[known] = least / np.fromiter(map(len, coded), dtype=np.float64)
        return names, scores, rate


def codes_of(data: bytes, order: int) -> np.ndarray:
    """A 64-bit code for every byte string of length 1 to ``order`` + 1 in ``data``: its length in the top byte, its bytes below."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    made, code = [], np.zeros(len(b), dtype=np.uint64)
    for n in range(1, order + 2):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        made.append(code | np.uint64(n << 56))
    return np.concatenate(made) if made else code


def context_counts(rows: DataFrame, order: int, least: int) -> DataFrame:
    """(lang, context, symbols, counts): for each context of up to ``order`` bytes that is empty or seen ``least`` times, the
    bytes that follow it in the texts of each language, and how often. Counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, codes in waiting.items():
                known, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), pa.array(known.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "code", "n"])
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "replace")
                for at in range(0, max(len(data), 1), 1 << 20):
                    codes = codes_of(data[at : at + (1 << 20)], order) if not at else _fresh(data[at - order : at + (1 << 20)], order)
                    waiting.setdefault(lang, []).append(codes)
                    size += len(codes)
                    if size > 4_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    bounded_batches(rows.sparkSession)
    counted = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    length = F.shiftrightunsigned("code", 56)
    below = F.shiftrightunsigned(F.shiftleft("code", 8), 16)  # without the length and the last byte
    context = below.bitwiseOR(F.shiftleft(length - 1, 56))
    split = counted.select("lang", context.alias("context"), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
    met = split.groupBy("lang", "context").agg(F.sort_array(F.collect_list(F.struct("symbol", "n"))).alias("seen"), F.sum("n").alias("total"))
    return met.filter((F.col("context") == 0) | (F.col("total") >= least)).select("lang", "context", F.col("seen.symbol").alias("symbols"), F.col("seen.n").alias("counts"))


def _fresh(part: bytes, order: int) -> np.ndarray:
    """The codes of the byte strings of length 1 to ``order`` + 1 that end after the first ``order`` bytes of ``part``."""
    return np.concatenate([_ending(part, order, n) for n in range(1, order + 2)])


def _ending(part: bytes, order: int, n: int) -> np.ndarray:
    codes = codes_of(part[order - n + 1 :], n - 1)
    return codes[(codes >> np.uint64(56)) == n]


def train(labelled: DataFrame, order: int = 3, least: int = 24, sample_bytes: int = 4_000_000, max_bytes: int = 640_000_000) -> PpmModel:
    """Learns from rows with a ``lang`` and a ``text``; others are ignored.

    ``sample_bytes`` bounds the sample: of each language, rows with so many bytes together are expected, chosen by a hash of
    their id and text, and whole texts of them are read; a language with less is read whole. So at most ``order`` + 1 times
    ``sample_bytes`` / ``least`` contexts of a language come to the driver, where the trees are made; trees above ``max_bytes``
    together are an error.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).collect()}
    if not sizes:
        return PpmModel({}, np.zeros(256, dtype=np.int64), order)
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit("ppm")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample_bytes / max(n, 1)))) for k, n in sorted(sizes.items())])
    by: dict[str, dict[bytes, tuple[np.ndarray, np.ndarray]]] = {k: {} for k in sizes}
    for lang, context, symbols, counts in context_counts(rows.filter(part < share), order, least).toLocalIterator():
        by[lang][(context & ((1 << 56) - 1)).to_bytes(7, "big")[7 - (context >> 56) :]] = (np.array(symbols), np.array(counts, dtype=np.float64))
    seen = sorted({int(b) for c in by.values() if b"" in c for b in c[b""][0]})
    symbols = np.zeros(256, dtype=np.int64)
    symbols[seen] = np.arange(1, len(seen) + 1)
    if len(seen) > 255:
        symbols = np.arange(256)
    trees = {k: learn(c, symbols) for k, c in by.items() if c}
    if sum(t.cost.nbytes + t.step.nbytes for t in trees.values()) > max_bytes:
        raise ValueError("the trees are too large to broadcast: lower order or raise least")
    return PpmModel(trees, symbols, order)


def predictions(docs: DataFrame, model: PpmModel, keep: list[str] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language, its score and the bits a byte, under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(f"`{c}`" for c in keep)) if "text" in keep else docs.select(*(f"`{c}`" for c in keep), "text")
    place, n = kept.columns.index("text"), len(keep)
    # Columns go by their places: their names may be any.
    kinds = [*(f.dataType.simpleString() for f in kept.schema.fields[:n]), "string", "double", "double"]
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, scores, rate = model.predict(batch.column(place).to_pylist())
            made = [pa.array(lang, pa.string()), pa.array(scores), pa.array(rate)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[f"c{i}" for i in range(n + 3)])

    bounded_batches(docs.sparkSession)
    return kept.toDF(*(f"c{i}" for i in range(len(kept.columns)))).mapInArrow(predict, schema).toDF(*keep, *names)


def held_out(divisor: int = 4, remainder: int = 2):
    """Whether the CRC-32 of the doc_id as text has that remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))


def identify(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every document.

    Learns from the documents that are not held out and have a lang. Null texts and texts without a letter are ``und`` with
    score 0, as is everything if nothing can be learned. Repeated rows are predicted each; a null doc_id is not held out. Ties
    go to the first language in order of name. Only the text counts in a prediction; extra columns are ignored.
    """
    model = train(docs.filter(~held_out()), **limits)
    if not model.languages:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(8.0).alias("bits_per_byte"))
    return predictions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
