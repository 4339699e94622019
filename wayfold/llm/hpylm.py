"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word has a restaurant for what follows it: the customers are the training tokens with that word before them. All these
context restaurants share one parent, the word restaurant, whose customers are their tables. Its base is a spelling model: a
word's bytes, one after the other, each from the restaurant of the two bytes before it; that restaurant's parent has the
context of one byte and is shared by all contexts that end in it, the parent of those is the empty context, and the base of
that is uniform. A new table in a restaurant is a customer of its parent. A text's first word follows the end of a text.

Seating is sampled by Gibbs sweeps. A sweep draws the tables of every pair in the context restaurants, given how many tables
each restaurant had and how likely the word restaurant thought each word after the sweep before; then the words' tables, given
how many context tables serve them; then the spelling restaurants. Given its parent's probabilities, the number of tables that
serve a dish to c customers has an exact distribution (generalised Stirling numbers), which is used up to ``EXACT`` customers;
further customers are seated in blocks of a tenth. Restaurants of one level are drawn side by side from the state before. The
first sweep starts from expected numbers of tables and the words' shares. After ``burn_in`` sweeps, the predictive
probability of every token is worked out in each sweep's state, a pair's own tables by their expectation in that state, and
these probabilities are averaged over ``samples`` sweeps.

Two scores come of it. ``spelled_score`` is over all byte strings: an unknown word has the probability of its spelling.
``score`` is over the known words and one class of all others, as the base is: an unknown word has the probability of that
class, which is what the model leaves to all strings outside the vocabulary.

Scale: texts are read once and cut into blocks of whole documents, one row each, with the block's different words and its
documents as places among them. A block's words, and its pairs of neighbours as 64-bit hashes, travel as sorted, compressed
slices to the part of their hash, where those of all blocks are counted; counts go back in the slices' order. The number of
parts follows the bytes of text. A word or pair is in each block once, however frequent. The driver holds the spelling
counts only (at most 257 ** 3, whatever the corpus). A sweep moves numbers for words alone, in the order of the block's and
the part's words, which do not move again; pairs stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.language_id import held_out
from wayfold.plans.scratch import bounded_batches, discard, materialise

EXACT = 64
PART_BYTES = 32 << 20  # of text for each part
CHUNK = 50_000  # words that are spelled at a time
EDGE = 256  # stands before and after a word
BASE = 257


def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to n; -inf where there is no such seating."""
    made = np.full((n + 1, n + 1), -np.inf)
    made[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(n + 1)
            stay = np.log(np.maximum(c - discount * t, 0)) + made[c]
            made[c + 1] = np.logaddexp(np.concatenate([[-np.inf], made[c, :-1]]), stay)
    return made


def _blocks(c: np.ndarray, x: np.ndarray, t: np.ndarray, discount: float, draw) -> np.ndarray:
    """Seats the customers beyond ``EXACT``, a tenth of those seated at a time; ``draw(m, p)`` says how many open a table."""
    at, t = np.minimum(c, EXACT).astype(np.float64), t.astype(np.float64).copy()
    left = np.flatnonzero(c > EXACT)
    while len(left):
        m = np.minimum(np.maximum(np.floor(at[left] / 10), 1), c[left] - at[left])
        t[left] += draw(m, x[left] / (x[left] + np.maximum(at[left] - discount * t[left], 1e-9)))
        at[left] += m
        left = left[at[left] < c[left]]
    return t


def tables(c: np.ndarray, x: np.ndarray, discount: float, log_s: np.ndarray, rng: np.random.Generator | None, uniform: np.ndarray | None = None) -> np.ndarray:
    """How many tables serve dishes with c customers, x being (strength + discount * tables) * parent's probability.

    Drawn with ``rng``; or once for each row of uniform numbers, added up; the expected number without either.
    """
    draws = 1 if uniform is None else len(uniform)
    t = np.minimum(c, 1).astype(np.float64) * draws
    for least, most in ((1, 4), (4, 12), (12, np.inf)):  # no more columns than customers
        several, width = np.flatnonzero((c > least) & (c <= most)), int(min(most, EXACT)) + 1
        for lo in range(0, len(several), 250_000 // width):
            k = several[lo : lo + 250_000 // width]
            seated = np.minimum(c[k], EXACT).astype(np.int64)
            if most <= 12:  # small enough for plain numbers, the most probable being near 1
                w, power = np.zeros((len(k), width)), np.ones(len(k))
                for n_tables in range(1, width):
                    power = power * np.maximum(x[k], 1e-20)
                    w[:, n_tables] = np.exp(log_s[:, n_tables])[seated] * power
            else:
                w = log_s[seated, :width] + np.arange(width) * np.log(np.maximum(x[k], 1e-300))[:, None]
                w = np.exp(w - w.max(axis=1, keepdims=True))
            if rng is None and uniform is None:
                t[k] = (w @ np.arange(width)) / w.sum(axis=1)
            else:
                up = np.cumsum(w, axis=1)
                t[k] = sum((up < (u * up[:, -1])[:, None]).sum(axis=1) for u in ([rng.random(len(k))] if uniform is None else uniform[:, k]))
    if not (c > EXACT).any():
        return t
    if uniform is not None:  # the expected further tables, rounded at random
        far = np.flatnonzero(c > EXACT)
        t[far] = np.floor(_blocks(c[far], x[far], t[far] / draws, discount, lambda m, p: m * p) + uniform[:, far]).sum(axis=0)
        return t
    return _blocks(c, x, t, discount, (lambda m, p: m * p) if rng is None else (lambda m, p: rng.binomial(m.astype(np.int64), np.minimum(p, 1.0))))


def discount_of(counts_1: float, counts_2: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return float(min(0.95, max(0.05, counts_1 / (counts_1 + 2 * counts_2)))) if counts_1 else 0.5


@dataclass
class Spelling:
    """log10 of the averaged predictive probabilities, log10_p[before, last, symbol], and the symbols' places in it."""

    log10_p: np.ndarray
    place: np.ndarray

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        if not words:
            return np.zeros(0)
        before, last, now, starts = _trigrams(words)
        p = self.log10_p[self.place[before], self.place[last], self.place[now]]
        return np.add.reduceat(p.astype(np.float64), starts)


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every word and its end: the two symbols before it and itself; and where each word starts."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    now = np.full(int(ends[-1]), EDGE, dtype=np.int64)
    inside = np.ones(len(now), dtype=bool)
    inside[ends - 1] = False
    now[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = ends - lengths
    last = np.concatenate([[EDGE], now[:-1]])
    before = np.concatenate([[EDGE, EDGE], now[:-2]])[: len(now)]
    before[starts] = EDGE
    return before, last, now, starts


def sample_spelling(keys: np.ndarray, counts: np.ndarray, seed: int = 7, burn_in: int = 8, samples: int = 8, strength: float = 1.0) -> Spelling:
    """Gibbs sampling of the context restaurants from trigram counts (keys as made by ``spelling_counts``)."""
    rng = np.random.default_rng(seed)
    before, last, now = keys // (BASE * BASE), keys // BASE % BASE, keys % BASE
    seen = np.unique(np.concatenate([before, last, now]))
    place = np.full(BASE, len(seen), dtype=np.int64)  # what was never seen shares the last place
    place[seen] = np.arange(len(seen))
    n = len(seen) + 1
    a, b, s = place[before], place[last], place[now]
    c3 = counts.astype(np.float64)
    c2_at = np.unique(b * n + s)
    up3 = np.searchsorted(c2_at, b * n + s)
    s2 = c2_at % n
    d3, d2, d1 = discount_of((c3 == 1).sum(), (c3 == 2).sum()), 0.5, 0.5
    tables_of = {d: stirling(d) for d in (d3, d2, d1)}
    t3, t2, t1 = np.minimum(c3, 1), np.ones(len(c2_at)), np.ones(n)
    total = np.zeros((n, n, n))
    for sweep in range(burn_in + samples):
        c2 = np.bincount(up3, weights=t3, minlength=len(c2_at))
        t2 = np.minimum(np.maximum(t2, 1), c2)
        c1 = np.bincount(s2, weights=t2, minlength=n)
        t1 = np.minimum(np.maximum(t1, 1), c1)
        p1 = (c1 - d1 * t1 + (strength + d1 * t1.sum()) / BASE) / (strength + c1.sum())
        room2, open2 = np.bincount(c2_at // n, weights=c2, minlength=n), np.bincount(c2_at // n, weights=t2, minlength=n)
        p2 = np.outer((strength + d2 * open2) / (strength + room2), p1)
        p2[c2_at // n, s2] += (c2 - d2 * t2) / (strength + room2[c2_at // n])
        flat = a * n + b
        room3, open3 = np.bincount(flat, weights=c3, minlength=n * n), np.bincount(flat, weights=t3, minlength=n * n)
        if sweep >= burn_in:
            p3 = ((strength + d3 * open3) / (strength + room3)).reshape(n, n, 1) * p2[None]
            p3[a, b, s] += (c3 - d3 * t3) / (strength + room3[flat])
            total += p3
        t3 = tables(c3, (strength + d3 * open3[flat]) * p2[b, s], d3, tables_of[d3], rng)
        c2 = np.bincount(up3, weights=t3, minlength=len(c2_at))
        t2 = tables(c2, (strength + d2 * open2[c2_at // n]) * p1[s2], d2, tables_of[d2], rng)
        c1 = np.bincount(s2, weights=t2, minlength=n)
        t1 = tables(c1, np.full(n, (strength + d1 * t1.sum()) / BASE), d1, tables_of[d1], rng)
    return Spelling(np.log10(total / samples).astype(np.float32), place)


@dataclass
class WordModel:
    """The word restaurant: training tokens, different words, tables, and the spelling model below."""

    tokens: int
    words: int
    tables: float
    discount: float
    strength: float
    spelling: Spelling
    spelled: float = 0.0  # the spelling model's probability of all known words together

    def __post_init__(self) -> None:
        self.log_s = stirling(self.discount)

    def pull(self, log10_h: np.ndarray) -> np.ndarray:
        return (self.strength + self.discount * self.tables) * np.power(10.0, np.maximum(log10_h, -290))

    def drawn(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        """One Gibbs draw of the words' tables; the same words draw the same."""
        rng = np.random.default_rng(xxhash.xxh64_intdigest(words[0]) if words else 0)
        return tables(c, self.pull(self.spelling.score(words)), self.discount, self.log_s, rng)

    def log10(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        """log10 of the averaged predictive probability of each word, whose count in training is c."""
        x = self.pull(self.spelling.score(words))
        own = np.maximum(c - self.discount * tables(c, x, self.discount, self.log_s, None), 0)
        return np.log10((own + x) / (self.strength + self.tokens))

    def log10_unknown(self) -> float:
        """log10 of the probability of any word that is not known."""
        return float(np.log10((self.strength + self.discount * self.tables) * max(1 - self.spelled, 1e-12) / (self.strength + self.tokens)))


def _pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers, bytes of equal weight together, compressed."""
    import zstandard

    flat = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.T).tobytes())


def _unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    values = np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return values if kind == "<u8" else values.astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    """Words hold no white space."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    """One word at least: the empty one is the end of a text."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _cuts(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) for sorted keys: parts are ranges of equal width."""
    step = (1 << 64) // parts + 1
    edges = np.searchsorted(keys, np.array([p * step for p in range(1, parts)], dtype=np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    return [(p, lo, hi) for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]


BLOCK = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, places binary, words binary, n binary"


def blocks(docs: DataFrame, divisor: int, remainder: int, tokens: int = 2_000_000) -> DataFrame:
    """Blocks of whole documents, about ``tokens`` tokens each, as one row.

    ``words`` are the block's different words in order of their hashes, ``n`` how often each is in training documents,
    ``places`` the documents' tokens as places among the words. The end of a text is the empty word.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId(), 0, 0
        vocabulary: dict[bytes, int] = {}
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            words = list(vocabulary)
            order = np.argsort(_hashes(words), kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            ids, held, lengths, at = zip(*made, strict=True)
            places = rank[np.concatenate(at)]
            n = np.bincount(places[np.repeat(~np.array(held), lengths)], minlength=len(words))
            columns = [[(task << 24) + number], [ids], [held], [lengths], [_pack(places)], [_pack_words([words[i] for i in order])], [_pack(n)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                words.append(b"")
                made.append((doc_id, held, len(words), np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int32)))
                size += len(words)
                if size >= tokens:
                    yield flush()
                    vocabulary.clear()
                    made.clear()
                    number, size = number + 1, 0
        if made:
            yield flush()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(divisor, remainder), F.col("text").cast("string"))
    return rows.mapInArrow(cut, BLOCK)


def _table(names: str, kinds: list, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names.split())


@dataclass
class Pairs:
    """A block's different pairs of neighbours, in order of their hashes, and each token's pair."""

    before: np.ndarray  # places of the words before
    now: np.ndarray
    keys: np.ndarray
    each: np.ndarray


def block_pairs(places: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> Pairs:
    end = words.index(b"")
    last = np.empty_like(places)
    last[1:] = places[:-1]
    last[np.cumsum(lengths) - lengths] = end
    code, each = np.unique(last * len(words) + places, return_inverse=True)
    h = _hashes(words)
    before, now = code // len(words), code % len(words)
    keys = _mix(_mix(h[before]) + h[now])
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return Pairs(before[order].astype(np.int32), now[order].astype(np.int32), keys[order], rank[each].astype(np.int32))


SLICE = "part int, block long, words binary, keys binary, n binary"
MET = "block long, part int, kind int, words binary, values binary, ones long, twos long"
MET_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def meet(cut: DataFrame, parts: int) -> DataFrame:
    """Counts over all blocks: rows for a block's slice of words (kind 0) or pairs (kind 1), and a part's words (kind 2).

    ``values`` are 2 * count in training + 1 in the block that owns the word or pair, which is one; ``words`` of a slice of
    words are their places among the part's. ``ones`` and ``twos`` count a part's pairs seen once and twice.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, held, lengths, places, words, n = (batch.column(i)[row].as_py() for i in range(6))
                words, n, lengths = _unpack_words(words), _unpack(n), np.array(lengths)
                rows = [(p, block, _pack_words(words[lo:hi]), None, _pack(n[lo:hi])) for p, lo, hi in _cuts(_hashes(words), parts)]
                pairs = block_pairs(_unpack(places), lengths, words)
                n = np.bincount(pairs.each[np.repeat(~np.array(held), lengths)], minlength=len(pairs.keys))
                rows += [(parts + p, block, None, _pack(np.diff(pairs.keys[lo:hi], prepend=np.uint64(0)), "<u8"), _pack(n[lo:hi])) for p, lo, hi in _cuts(pairs.keys, parts)]
                yield from _table("part block words keys n", [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows).to_batches()

    def count(slices: pa.Table) -> pa.Table:
        part, owners = slices.column("part")[0].as_py(), slices.column("block").to_pylist()
        n = [_unpack(x.as_py()) for x in slices.column("n")]
        if part < parts:
            index: dict[bytes, int] = {}
            at = np.fromiter((index.setdefault(w, len(index)) for x in slices.column("words") for w in _unpack_words(x.as_py())), dtype=np.int64, count=sum(map(len, n)))
            first = np.unique(at, return_index=True)[1]
        else:
            _, first, at = np.unique(np.concatenate([np.cumsum(_unpack(x.as_py(), "<u8"), dtype=np.uint64) for x in slices.column("keys")]), return_index=True, return_inverse=True)
        c = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
        values = 2 * c[at]
        values[first] += 1
        ends = np.cumsum([len(x) for x in n])
        rows = [(block, part % parts, int(part >= parts), _pack(at[hi - len(x) : hi]) if part < parts else None, _pack(values[hi - len(x) : hi], "<u8"), 0, 0) for block, x, hi in zip(owners, n, ends.tolist(), strict=True)]
        if part < parts:
            rows.append((None, part, 2, _pack_words(list(index)), _pack(c, "<u8"), 0, 0))
        else:
            rows[0] = (*rows[0][:5], int((c == 1).sum()), int((c == 2).sum()))
        return _table("block part kind words values ones twos", MET_KINDS, rows)

    return cut.select("block", "held_out", "n_tokens", "places", "words", "n").mapInArrow(deal, SLICE).repartition(4 * parts, "part").groupBy("part").applyInArrow(count, MET)


@dataclass
class Contexts:
    """The context restaurants: training tokens, different words, discount and strength."""

    tokens: int
    words: int
    discount: float
    strength: float

    def __post_init__(self) -> None:
        self.log_s = stirling(self.discount)

    def first_open(self, c_before: np.ndarray) -> np.ndarray:
        """The number of tables expected in restaurants before anything is known of their dishes."""
        n = np.maximum(c_before, 1).astype(np.float64)
        return np.minimum(np.power(n, self.discount) * math.gamma(self.strength + 1) / (self.discount * math.gamma(self.strength + self.discount)), n)

    def pull(self, open_: np.ndarray, p: np.ndarray) -> np.ndarray:
        """What a new table weighs: ``p`` is the word restaurant's probability of the dish."""
        return (self.strength + self.discount * open_) * p

    def seat(self, c: np.ndarray, pull: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
        """A draw of the tables that serve dishes to c customers, or their expected numbers without ``rng``."""
        return tables(c.astype(np.float64), pull, self.discount, self.log_s, rng)

    def predictive(self, c: np.ndarray, c_before: np.ndarray, open_: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The probability of dishes in restaurants with ``c_before`` customers at ``open_`` tables, c of them at that dish."""
        pull = self.pull(open_, p)
        return (np.maximum(c - self.discount * self.seat(c, pull, None), 0) + pull) / (self.strength + c_before)


def _values(found: pa.Table, kind: int) -> list[bytes]:
    """A block's slices of one kind, in order of their parts."""
    mine = sorted((p, i) for i, (p, k) in enumerate(zip(found.column("part").to_pylist(), found.column("kind").to_pylist(), strict=True)) if k == kind)
    return [found.column("values")[i].as_py() for _, i in mine]


def _counted(found: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, owned)."""
    v = np.concatenate([_unpack(x, "<u8") for x in _values(found, kind)]).astype(np.int64)
    return v // 2, v % 2 == 1


STATE = "block long, cuts array<int>, before binary, now binary, c binary, once binary, c_word binary, c_pair binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, places binary, words binary"
DRAWN = ["block", "cuts", "before", "now", "c", "once", "c_word"]
SUMS = "part int, block long, n binary"
VALUES = "block long, part int, kind int, values binary"
VALUE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def states(cut: DataFrame, met: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Blocks with what their draws need: the pairs that they own and that are seen more than once, sums of those seen once,
    and where the parts' slices of their words are; and with the counts of all words and pairs, for the end."""

    def made(block: pa.Table, found: pa.Table) -> pa.Table:
        words, lengths = _unpack_words(block.column("words")[0].as_py()), np.array(block.column("n_tokens")[0].as_py())
        pairs = block_pairs(_unpack(block.column("places")[0].as_py()), lengths, words)
        c, owned = _counted(found, 1)
        once = np.stack([np.bincount(at[owned & (c == 1)], minlength=len(words)) for at in (pairs.before, pairs.now)])
        k = np.flatnonzero(owned & (c > 1))
        k = k[np.lexsort((pairs.now[k], pairs.before[k]))]
        cuts = [x for one in _cuts(_hashes(words), parts) for x in one]
        row = (block.column("block")[0].as_py(), cuts, _pack(np.diff(pairs.before[k], prepend=np.int32(0))), _pack(pairs.now[k]), _pack(c[k], "<u8"), _pack(once.ravel()), _pack(_counted(found, 0)[0], "<u8"), _pack(c, "<u8"))
        made = _table("block cuts before now c once c_word c_pair", [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 6], [row])
        for name in ("doc_id", "held_out", "n_tokens", "places", "words"):
            made = made.append_column(name, block.column(name))
        return made

    mine = met.filter("kind < 2").select("block", "part", "kind", "values").repartition(tasks, "block")
    return cut.select("block", "doc_id", "held_out", "n_tokens", "places", "words").repartition(tasks, "block").groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(made, STATE)


def _floats(found: pa.Table, kind: int) -> np.ndarray:
    """A block's slices of numbers of one kind, in order of their parts."""
    return np.concatenate([np.frombuffer(x, dtype="<f4") for x in _values(found, kind)]).astype(np.float64)


def draw_contexts(state: DataFrame, values: DataFrame, contexts: Contexts, sweep: int, tasks: int) -> DataFrame:
    """One draw of all pairs' tables, each where it is owned: for a block's slice of words, the tables in their restaurants and
    the context tables that serve them. ``values``: the state of the sweep before, kinds ``OPEN`` and ``LOG_P``; may be empty.
    """

    def draw(block: pa.Table, found: pa.Table) -> pa.Table:
        at = block.column("block")[0].as_py()
        before, now, c, once, c_word = (_unpack(block.column(i)[0].as_py(), k) for i, k in ((2, "<u4"), (3, "<u4"), (4, "<u8"), (5, "<u4"), (6, "<u8")))
        before, c, c_word = np.cumsum(before), c.astype(np.int64), c_word.astype(np.int64)
        open_ = _floats(found, OPEN) if found.num_rows else contexts.first_open(c_word)
        p = np.power(10.0, _floats(found, LOG_P)) if found.num_rows else np.maximum(c_word, 1) / max(contexts.tokens, 1)
        t = contexts.seat(c, contexts.pull(open_[before], p[now]), np.random.default_rng((at, sweep)))
        open_, served = (np.bincount(k, weights=t, minlength=len(c_word)) + one for k, one in zip((before, now), once.reshape(2, -1), strict=True))
        cuts = np.array(block.column("cuts")[0].as_py()).reshape(-1, 3).tolist()
        return _table("part block n", [pa.int32(), pa.int64(), pa.binary()], [(part, at, _pack(np.concatenate([open_[lo:hi], served[lo:hi]]), "<u8")) for part, lo, hi in cuts])

    told = values.select("block", "part", "kind", "values").repartition(tasks, "block")
    return state.select(*DRAWN).repartition(tasks, "block").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(draw, SUMS)


#: Kinds of numbers for a block's slice of words: tables in each word's restaurant, log10 of the word restaurant's
#: probability; and, for a part, its words with the customers that they have in the word restaurant.
OPEN, LOG_P, CUSTOMERS = 3, 5, 4


def add_up(sums: DataFrame, met: DataFrame, parts: int) -> DataFrame:
    """Sums over blocks: rows of ``OPEN`` for each block's slice, and of ``CUSTOMERS`` for each part."""

    def add(slices: pa.Table, places: pa.Table) -> pa.Table:
        part, at = places.column("part")[0].as_py(), _places(places)
        n = {b: _unpack(x.as_py(), "<u8").astype(np.float64).reshape(2, -1) for b, x in zip(slices.column("block").to_pylist(), slices.column("n"), strict=True)}
        size = 1 + max(int(k.max()) for k in at.values())
        both = np.zeros((2, size))
        for block, k in at.items():
            for row, own in zip(both, n[block], strict=True):
                row += np.bincount(k, weights=own, minlength=size)
        rows = [(block, part, OPEN, both[0][k].astype("<f4").tobytes()) for block, k in at.items()]
        return _table("block part kind values", VALUE_KINDS, [*rows, (None, part, CUSTOMERS, _pack(both[1], "<u8"))])

    return sums.repartition(2 * parts, "part").groupBy("part").cogroup(_word_rows(met, parts).groupBy("part")).applyInArrow(add, VALUES)


def _word_rows(met: DataFrame, parts: int) -> DataFrame:
    """The slices' places among the parts' words, and the words."""
    return word_rows(met).repartition(2 * parts, "part")


def word_rows(met: DataFrame) -> DataFrame:
    return met.filter("kind IN (0, 2)").select("part", "block", "kind", "words")


def _places(rows: pa.Table) -> dict[int, np.ndarray]:
    return {b: _unpack(w.as_py()) for b, kind, w in zip(rows.column("block").to_pylist(), rows.column("kind").to_pylist(), rows.column("words"), strict=True) if kind == 0}


def known_words(met: DataFrame, customers: DataFrame) -> DataFrame:
    """(words, values) of each part: its words and their customers."""
    words = met.filter("kind = 2").select("part", "words")
    return words.join(customers.filter(F.col("kind") == CUSTOMERS).select("part", "values"), "part").select("words", "values")


def spread_words(customers: DataFrame, met: DataFrame, model: WordModel, parts: int) -> DataFrame:
    """Rows of ``LOG_P`` for each block's slice of words: log10 of the word restaurant's predictive probability."""
    shared = met.sparkSession.sparkContext.broadcast(model)

    def spread(counted: pa.Table, places: pa.Table) -> pa.Table:
        model, part = shared.value, places.column("part")[0].as_py()
        words = next(_unpack_words(w.as_py()) for kind, w in zip(places.column("kind").to_pylist(), places.column("words"), strict=True) if kind == 2)
        c = _unpack(counted.column("values")[0].as_py(), "<u8").astype(np.float64)
        p = np.concatenate([model.log10(words[lo : lo + CHUNK], c[lo : lo + CHUNK]) for lo in range(0, len(words), CHUNK)]).astype("<f4")
        return _table("block part kind values", VALUE_KINDS, [(block, part, LOG_P, p[k].tobytes()) for block, k in _places(places).items()])

    mine = customers.filter(F.col("kind") == CUSTOMERS).select("part", "values").repartition(2 * parts, "part")
    return mine.groupBy("part").cogroup(_word_rows(met, parts).groupBy("part")).applyInArrow(spread, VALUES)


def _known(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, customers) of a part's words that training has, some at a time."""
    for row in range(batch.num_rows):
        words, c = _unpack_words(batch.column(0)[row].as_py()), _unpack(batch.column(1)[row].as_py(), "<u8").astype(np.float64)
        for lo in range(0, len(words), CHUNK):
            some = np.flatnonzero(c[lo : lo + CHUNK]) + lo
            if len(some):
                yield [words[i] for i in some], c[some]


def spelled_mass(words: DataFrame, spelling: Spelling) -> float:
    """The probability that the spelling model gives to all the words together."""
    shared = words.sparkSession.sparkContext.broadcast(spelling)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float(np.power(10.0, shared.value.score(w)).sum()) for b in batches for w, _ in _known(b))
        yield pa.RecordBatch.from_arrays([pa.array([float(total)], pa.float64())], names=["p"])

    return float(words.mapInArrow(add, "p double").agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0])


#: Keys of what is counted beside the trigrams: tables, words, customers, words with one customer and with two.
BESIDE = (-1, -2, -3, -4, -5)


def spelling_counts(words: DataFrame, model: WordModel | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Trigram counts over the words' tables, and ``BESIDE``. Without a model each word has one table."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, beside = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(len(BESIDE))
        held = 0
        model = shared.value
        for spelled, c in (chunk for batch in batches for chunk in _known(batch)):
            t = np.ones(len(c)) if model is None else model.drawn(spelled, c)
            beside += [t.sum(), len(c), c.sum(), (c == 1).sum(), (c == 2).sum()]
            before, last, now, starts = _trigrams(spelled)
            each = np.repeat(t, np.diff(np.append(starts, len(now))))
            k, at = np.unique((before * BASE + last) * BASE + now, return_inverse=True)
            keys.append(k)
            weights.append(np.bincount(at, weights=each))
            held += len(k)
            if held > 2_000_000:
                k, at = np.unique(np.concatenate(keys), return_inverse=True)
                keys, weights, held = [k], [np.bincount(at, weights=np.concatenate(weights))], len(k)
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        w = np.bincount(at, weights=np.concatenate(weights), minlength=len(k))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, BESIDE)), pa.array(np.append(w, beside))], names=["key", "n"])

    found = words.mapInArrow(count, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    own = np.argsort(keys)
    keys, n = keys[own], n[own]
    return keys[keys >= 0], np.maximum(np.rint(n[keys >= 0]), 1), [float(n[keys == k].sum()) for k in BESIDE]


def _totals(met: DataFrame) -> tuple[int, int, int, int]:
    """Training tokens, different words, pairs seen once and twice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, dtype=np.int64)
        for batch in batches:
            for kind, values, ones, twos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = _unpack(values, "<u8").astype(np.int64) if kind == 2 else np.zeros(0, np.int64)
                total += [c.sum(), (c > 0).sum(), ones, twos]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=list("abcd"))

    rows = met.filter("kind = 2 OR ones + twos > 0").select("kind", F.when(F.col("kind") == 2, F.col("values")).alias("values"), "ones", "twos")
    summed = rows.mapInArrow(add, "a long, b long, c long, d long").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "abcd"]).first()
    return tuple(map(int, summed))


def score(docs: DataFrame, divisor: int = 7, remainder: int = 2, burn_in: int = 1, samples: int = 3, strength: float = 1.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, spelled_score for every document.

    Learns from the documents whose doc_id's CRC-32 does not have that remainder, and scores all, whole. A token is a word in
    lower case (A-Z) or the end of a text; null text counts as empty. With nothing to learn from, every word is spelled by the
    uniform base. Repeated rows are counted and scored each; a null doc_id is learned from; an empty table gives no rows;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    parts = max(8, -(-int(size) // PART_BYTES))
    cut = materialise(blocks(docs, divisor, remainder), "blocks")
    tasks = max(1, 2 * cut.count())  # twice as many as there are blocks, so that few meet in a task
    met = materialise(meet(cut, parts), "met")
    tokens, words, ones, twos = _totals(met)
    contexts = Contexts(tokens, words, discount_of(ones, twos), strength)
    state = materialise(states(cut, met, parts, tasks), "states", cut)
    # Of what the blocks were told, sweeps need the words only.
    met = materialise(word_rows(met), "places", met)
    model, values, kept, models = None, spark.createDataFrame([], VALUES), None, []
    for sweep in range(burn_in + samples):
        sums = draw_contexts(state, values, contexts, sweep, tasks)
        added = materialise(add_up(sums, met, parts), "added")
        known = known_words(met, added)
        keys, counts, (open_, _, customers, alone, two) = spelling_counts(known, model)
        discount = discount_of(alone, two)
        spelling = sample_spelling(keys, counts, seed=7 + sweep)
        model = WordModel(int(customers), words, open_, discount, strength, spelling)
        if sweep >= burn_in:
            model.spelled = spelled_mass(known, spelling)
            models.append(model.log10_unknown())
        before = values
        values = materialise(added.filter(F.col("kind") == OPEN).unionByName(spread_words(added, met, model, parts)), "values", added)
        if sweep <= burn_in:  # those of later sweeps are averaged at the end
            discard(before)
        if sweep >= burn_in:
            own = values.withColumn("kind", F.col("kind") + 10 * len(models))
            kept = own if kept is None else kept.unionByName(own)
    discard(met)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double, spelled_score double"

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        spelled, lengths = _unpack_words(block.column("words")[0].as_py()), np.array(block.column("n_tokens")[0].as_py())
        places = _unpack(block.column("places")[0].as_py())
        c_word, c = (_unpack(block.column(name)[0].as_py(), "<u8").astype(np.int64) for name in ("c_word", "c_pair"))
        base = np.log10((c_word + 1) / (contexts.tokens + contexts.words + 1))
        pairs = block_pairs(places, lengths, spelled)
        c_before = c_word[pairs.before].astype(np.float64)
        # Averages of probabilities as multiples of the first sweep's word probabilities: spellings may be below all numbers.
        total, spelled_out, scale = np.zeros(len(c)), np.zeros(len(c)), None
        for k, log10_unknown in enumerate(models, 1):
            own, open_ = _floats(found, LOG_P + 10 * k), _floats(found, OPEN + 10 * k)[pairs.before]
            closed = np.where(c_word > 0, own, log10_unknown)
            new = (c_word == 0)[pairs.now]
            p = contexts.predictive(c, c_before, open_, np.power(10.0, np.maximum(closed, -300))[pairs.now])
            total += p / len(models)
            # An unknown word has no pair: what it is spelled by is weighed alone.
            log = np.where(new, np.log10(contexts.pull(open_, 1.0) / (contexts.strength + c_before)) + own[pairs.now], np.log10(p))
            scale = log if scale is None else scale
            spelled_out += np.power(10.0, log - scale) / len(models)
        full, spelled_p = np.log10(total), np.log10(spelled_out) + scale
        starts = np.cumsum(lengths) - lengths

        def add(of_tokens: np.ndarray) -> np.ndarray:
            return np.add.reduceat(of_tokens, starts)

        scored = add(full[pairs.each])
        perplexity = np.power(10.0, np.minimum(-scored / lengths, 300))
        columns = [pa.array(block.column(name)[0].as_py(), kind) for name, kind in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()))]
        columns += [pa.array(add((c_word > 0)[places].astype(np.int64))), pa.array([contexts.tokens] * len(lengths), pa.int64()), pa.array(add(base[places])), pa.array(scored), pa.array(perplexity), pa.array(add(spelled_p[pairs.each]))]
        return pa.table(columns, names=[f.split()[0] for f in schema.split(", ")])

    whole = state.select("block", "doc_id", "held_out", "n_tokens", "places", "words", "c_word", "c_pair")
    return whole.repartition(tasks, "block").groupBy("block").cogroup(kept.repartition(tasks, "block").groupBy("block")).applyInArrow(finish, schema)
