"""Exact encoding and decoding for merge-type (BPE) SentencePiece models.

A text is cut into units between which no merge is possible, because no piece of the vocabulary holds the two characters at
the cut. A unit is encoded by backtracking: the longest piece at each place comes from one Aho-Corasick pass; a piece may
follow another only if merging the two anew would not have joined across their border; where none fits, the last piece is
shortened, and a bitfield remembers the positions from which no encoding goes on. The result is that of the library's
priority queue of merges, in time linear in the unit. Units are remembered, up to a bound.

Decoding joins the pieces, turns byte pieces into UTF-8 (an undecodable byte becomes U+FFFD) and drops the space that
encoding put first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.scratch import bounded_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class MergeCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes, remembered: int = 300_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.precompiled_charsmap:
            raise ValueError("only merge-type models without a character map are supported")
        if spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep white space and put a space first are supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.bytes_at = {int(p.piece[3:5], 16): k for k, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown = next(k for k, kind in enumerate(self.kinds) if kind == UNKNOWN)
        self.byte_of = {k: b for b, k in self.bytes_at.items()}
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for kind in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        # Pieces by rank: characters first, then merges, the best score first.
        normal = [k for k, kind in enumerate(self.kinds) if kind == NORMAL]
        order = sorted(normal, key=lambda k: (len(self.pieces[k]) > 1, -spec.pieces[k].score, k))
        self.id_of_rank = order
        self.text_of = [self.pieces[k] for k in order]
        self.rank_of = {t: r for r, t in enumerate(self.text_of)}
        self.split: list[tuple[int, int]] = [(r, r) for r in range(len(order))]
        reachable = set()
        for r, text in enumerate(self.text_of):
            if len(text) == 1:
                reachable.add(r)
                continue
            parts = self._merged(text)
            if len(parts) == 1:
                self.split[r] = self._last
                reachable.add(r)
        self.automaton = ahocorasick.Automaton()
        for r in reachable:
            self.automaton.add_word(self.text_of[r], (len(self.text_of[r]) - 1, r))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t, reachable) for t in self.text_of]
        self.joined = {}
        for r, text in enumerate(self.text_of):
            for cut in range(1, len(text)):
                a, b = self.rank_of.get(text[:cut]), self.rank_of.get(text[cut:])
                if a in reachable and b in reachable:
                    self.joined[a, b] = r
        self._units = self._unit_pattern()
        self._known: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}
        self._remembered = remembered

    def _merged(self, text: str) -> list[int]:
        """Plain merging, best rank and then leftmost first; keeps the two parts of the last merge."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank_of.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            self._last = (self.rank_of.get(parts[i], -1), self.rank_of.get(parts[i + 1], -1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _shorter(self, text: str, reachable: set[int]) -> int:
        """The longest piece that is a proper prefix, or -1."""
        return next((r for n in range(len(text) - 1, 0, -1) if (r := self.rank_of.get(text[:n])) in reachable), -1)

    def _unit_pattern(self) -> re.Pattern:
        """Cuts a text where no piece goes across: before a space that follows another character, and between letters and
        other characters where no piece has both."""
        pairs = {t[i : i + 2] for t in self.text_of for i in range(len(t) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            return re.compile(r"(?s).+")
        # Letters that some piece joins to another character count as other characters.
        letter, odd = re.compile(r"[^\W\d_]"), ""
        for _ in range(2):
            mixed = {p for p in pairs if SPACE not in p and bool(letter.match(p[0])) != bool(letter.match(p[1]))}
            if not mixed:
                letters = letter.pattern
                return re.compile(f"{SPACE}*{letters}+|{SPACE}*(?:(?!{letters})[^{SPACE}])+|{SPACE}+")
            odd = "".join(sorted({ch for p in mixed for ch in p if letter.match(ch)}))
            letter = re.compile(rf"[^\W\d_{re.escape(odd)}]")
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _fits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow ``a``: undoing their merges, the last first, shows no merge across the border that
        would have come earlier."""
        joined, split, limit = self.joined, self.split, 1 << 60
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def _encode_known(self, text: str, longest: list[int]) -> list[int]:
        """Ranks for a run of characters that are all pieces; ``longest`` has the longest piece at each place."""
        texts = self.text_of
        open_at = bytearray(b"\xff" * (len(text) // 8 + 1))
        made: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while True:
                end = at + len(texts[token])
                if open_at[end >> 3] >> (end & 7) & 1 and (not made or self._fits(made[-1], token)):
                    made.append(token)
                    at = end
                    token = longest[at] if at < len(text) else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                else:
                    open_at[at >> 3] &= ~(1 << (at & 7))
                    token = made.pop()
                    at -= len(texts[token])
        return made

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit, spaces already written as U+2581."""
        longest = [-1] * len(unit)
        for end, (before, rank) in self.automaton.iter(unit):
            longest[end - before] = rank  # ends only grow: the last match from a place is its longest
        if -1 not in longest:
            return [self.id_of_rank[r] for r in self._encode_known(unit, longest)]
        ids: list[int] = []
        at = 0
        while at < len(unit):
            if longest[at] < 0:
                ids += self._bytes(unit[at])
                at += 1
                continue
            end = at
            while end < len(unit) and longest[end] >= 0:
                end += 1
            # No piece goes beyond `end`, since the character there is none.
            ids += [self.id_of_rank[r] for r in self._encode_known(unit[at:end], longest[at:end])]
            at = end
        return ids

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes_at.get(b, self.unknown) for b in char.encode("utf-8", "replace")]

    def _unit(self, unit: str) -> tuple[str, int, str]:
        if (found := self._older.get(unit)) is not None:
            return self._keep(unit, found)
        ids = self.encode_unit(unit)
        found = (",".join(map(str, ids)), len(ids), self._text(ids))
        return self._keep(unit, found)

    def _keep(self, unit: str, found: tuple[str, int, str]) -> tuple[str, int, str]:
        """Two generations: what was used since the last change of generations outlives the next one."""
        if len(unit) <= 64:
            if len(self._known) >= self._remembered:
                self._older, self._known = self._known, {}
            self._known[unit] = found
        return found

    def coded(self, text: str) -> tuple[str, int, str]:
        """The decimal ids joined by commas, how many, and the text they decode to.

        A character's bytes never leave its unit, so the units' ids can be decoded one unit at a time.
        """
        if not text:
            return "", 0, ""
        unit = self._unit
        found = [self._known.get(u) or unit(u) for u in self._units.findall(SPACE + text.replace(" ", SPACE))]
        ids, counts, texts = zip(*found, strict=True)
        joined = "".join(texts)
        return ",".join(ids), sum(counts), (joined[1:] if joined.startswith(SPACE) else joined).replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        joined = self.coded(text)[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def _text(self, ids: list[int]) -> str:
        """The pieces put together, spaces still as U+2581."""
        out, held = [], bytearray()
        for k in ids:
            if self.kinds[k] == BYTE:
                held.append(self.byte_of[k])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if self.kinds[k] != CONTROL:
                out.append(" ⁇ " if self.kinds[k] == UNKNOWN else self.pieces[k])
        return "".join(out) + (_utf8(bytes(held)) if held else "")

    def decode(self, ids: list[int]) -> str:
        """The library's text for the ids."""
        text = self._text(ids)
        spaced = next((self.kinds[k] == NORMAL and self.pieces[k].startswith(SPACE) for k in ids if self.kinds[k] != CONTROL), False)
        return (text[1:] if spaced else text).replace(SPACE, " ")


def _utf8(data: bytes) -> str:
    """UTF-8, each byte that does not decode as U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[str, MergeCodec] = {}


def codec(model: str) -> MergeCodec:
    """The codec of a model file of the public tokenizers, read once in each process."""
    if model not in _loaded:
        import public_tokenizers

        with open(public_tokenizers.path(model), "rb") as f:
            _loaded[model] = MergeCodec(f.read())
    return _loaded[model]


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document (and, on demand, ids and the decoded text).

    Whole texts, without begin and end ids. Null counts as empty, which has no ids and decodes to the empty text. Each row is
    encoded on its own, whatever its doc_id; an empty table gives no rows; extra columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                joined, n, decoded = c.coded(text.as_py() or "")
                ids = [int(x) for x in joined.split(",")] if with_ids and joined else []
                for column, value in zip(out, (n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), ids, decoded), strict=True):
                    column.append(value)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
