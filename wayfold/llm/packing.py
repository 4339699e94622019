"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

Documents are cut only where they must be: every ``capacity`` ids a full piece, then one remainder. The histogram of
remainder lengths (at most ``capacity`` - 1 bins, whatever the number of documents) is a cutting-stock instance:

* the linear program chooses how often each *pattern* (a multiset of lengths that fits in a sequence) is used;
* a knapsack dynamic program prices new patterns from the duals, until Farley's bound proves the gap below ``gap``;
* the uses are rounded down, and what is left (fewer than one sequence for each pattern) is packed best-fit decreasing.

The plan is a small table of (length, first rank, last rank, first sequence, offset). Documents of one length are ranked
without gathering them: counts for each (length, salt), a running sum over the salts, and row numbers in a salt. The only
thing sent to the driver is the histogram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.plans.scratch import bounded_batches, materialise

#: Pieces of one length that are ranked together in one task, about.
SALTED = 200_000
PIECES = "doc_id long, doc_tokens long, starts array<long>, lengths array<int>, crcs array<long>"


class CuttingStock:
    """The linear program over patterns for one histogram of lengths, and its rounding.

    ``counts[l]`` is the number of items of length ``l``; index 0 is unused.
    """

    def __init__(self, counts: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 4000):
        self.capacity, self.gap, self.rounds = capacity, gap, rounds
        self.lengths = np.flatnonzero(counts)
        self.demand = counts[self.lengths].astype(np.float64)
        self.bound = float(self.demand @ self.lengths) / capacity  # no plan has fewer sequences

    def _price(self, duals: np.ndarray) -> np.ndarray:
        """The most valuable pattern: unbounded knapsack by dynamic programming over the room left."""
        best, take = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        useful = np.flatnonzero(duals > 1e-12)
        sizes, values = self.lengths[useful], duals[useful]
        for room in range(1, self.capacity + 1):
            fits = np.searchsorted(sizes, room, side="right")
            best[room] = best[room - 1]
            if fits:
                got = best[room - sizes[:fits]] + values[:fits]
                k = int(got.argmax())
                if got[k] > best[room] + 1e-12:
                    best[room], take[room] = got[k], k
        pattern, room = np.zeros(len(self.lengths), dtype=np.int64), self.capacity
        while room > 0:
            if take[room] < 0:
                room -= 1
            else:
                pattern[useful[take[room]]] += 1
                room -= sizes[take[room]]
        return pattern

    def _start(self) -> tuple[np.ndarray, np.ndarray]:
        """A feasible basis and its inverse. Each length stands alone, as often as it fits, or is paired with the length that
        fills the sequence: the scarcer of the two is used up in pairs, the other has what is left to itself."""
        at = {int(x): k for k, x in enumerate(self.lengths)}
        alone = (self.capacity // self.lengths).astype(np.float64)
        basis, inverse = np.diag(alone), np.diag(1.0 / alone)
        for k, x in enumerate(self.lengths):
            other = at.get(self.capacity - int(x))
            if other is not None and other != k and (self.demand[k], k) < (self.demand[other], other):
                basis[k, k] = inverse[k, k] = 1.0
                basis[other, k] = 1.0
                inverse[other, k] = -1.0 / alone[other]
        return basis, inverse

    def solve(self) -> list[tuple[np.ndarray, int]]:
        """(pattern, uses) for every pattern of the optimal basis that is used at least once after rounding down."""
        n = len(self.lengths)
        if not n:
            return []
        basis, inverse = self._start()
        uses = inverse @ self.demand
        for _ in range(self.rounds):
            duals = inverse.sum(axis=0)
            pattern = self._price(np.maximum(duals, 0))
            value = float(duals @ pattern)
            self.bound = max(self.bound, uses.sum() / max(value, 1.0))
            if uses.sum() <= (1 + self.gap) * self.bound or value <= 1 + 1e-9:
                break
            column = inverse @ pattern
            rows = np.flatnonzero(column > 1e-9)
            if not len(rows):
                break
            ratios = uses[rows] / column[rows]
            leave = rows[int(ratios.argmin())]
            basis[:, leave] = pattern
            pivot = inverse[leave] / column[leave]
            column[leave] = 0
            hit = np.flatnonzero(np.abs(column) > 1e-12)
            inverse[hit] -= np.outer(column[hit], pivot)
            inverse[leave] = pivot
            uses = np.maximum(inverse @ self.demand, 0)
        whole, left = [], self.demand.copy()
        for k in np.argsort(-uses):
            pattern = basis[:, k].astype(np.int64)
            held = pattern > 0
            n_uses = int(min(np.floor(uses[k] + 1e-9), (left[held] // pattern[held]).min())) if held.any() else 0
            if n_uses > 0:
                left -= pattern * n_uses
                whole.append((pattern, n_uses))
        return whole + self._rest(left.astype(np.int64))

    def _rest(self, left: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Best-fit decreasing of what rounding down leaves, most of it in runs of equal patterns."""
        made: dict[bytes, int] = {}
        while left.any():
            pattern, room = np.zeros(len(left), dtype=np.int64), self.capacity
            for k in range(int(np.searchsorted(self.lengths, room, side="right")) - 1, -1, -1):
                if left[k] and self.lengths[k] <= room:
                    take = min(int(left[k]), room // int(self.lengths[k]))
                    pattern[k], room = take, room - take * int(self.lengths[k])
                    if not room:
                        break
            times = int((left[pattern > 0] // pattern[pattern > 0]).min())
            left = left - pattern * times
            made[pattern.tobytes()] = made.get(pattern.tobytes(), 0) + times
        return [(np.frombuffer(p, dtype=np.int64), n) for p, n in made.items()]


def plan_rows(counts: np.ndarray, capacity: int, gap: float = 0.002) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, slot): the items of that length with those ranks (from 0) go, one to
    each sequence from the first on, into that slot of it."""
    stock = CuttingStock(counts, capacity, gap)
    rows, sequence, used = [], 0, {int(x): 0 for x in stock.lengths}
    for pattern, times in stock.solve():
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            length = int(stock.lengths[k])
            for _ in range(int(pattern[k])):
                rows.append((length, used[length], used[length] + times - 1, sequence, slot))
                used[length] += times
                slot += 1
        sequence += times
    return rows


def _encoder(ranks_path: str, pattern: str, added: dict[str, int]):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks={a: b for a, b in ranks.items() if b not in added.values()}, special_tokens=added)


_loaded: dict = {}


def _ids_of(vocabulary: str):
    """text -> ids, equal to those of the tokenizer file ``vocabulary``.

    ``name.tiktoken`` beside ``name.json`` holds the same merges; where it lies there, its faster reader does the work. The
    strings of the file's added tokens are matched first and become their ids, as in the file's tokenizer.
    """
    if vocabulary not in _loaded:
        import os

        import public_tokenizers

        path, ranks = public_tokenizers.path(vocabulary), None
        if os.path.exists(path.replace(".json", ".tiktoken")):
            ranks = path.replace(".json", ".tiktoken")
        if ranks:
            import json

            with open(path, encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            coder = _encoder(ranks, public_tokenizers.PATTERN, added)
            # Most texts hold no added token: they need no search for them.
            _loaded[vocabulary] = lambda text: coder.encode(text, allowed_special="all") if any(t in text for t in added) else coder.encode_ordinary(text)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _loaded[vocabulary] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _loaded[vocabulary]


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1) -> DataFrame:
    """One row a document: the pieces of its ids, cut every ``capacity`` ids, each with its start, length and CRC-32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids_of(vocabulary)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                starts = range(0, len(ids), capacity)
                out[0].append(doc_id)
                out[1].append(len(ids))
                out[2].append(list(starts))
                out[3].append([min(capacity, len(ids) - s) for s in starts])
                out[4].append([zlib.crc32(ids[s : s + capacity].tobytes()) for s in starts])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "doc_tokens", "starts", "lengths", "crcs"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 2048, granule: int = 8, gap: float = 0.002) -> DataFrame:
    """Packs all documents (``doc_id``, ``text``; null text counts as empty) into sequences of at most ``capacity`` ids.

    A document is its ids and an end id. Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id lies in one piece; a sequence is gapless from offset 0. The linear program counts lengths in
    whole granules, rounded up, which bounds its size by ``capacity / granule``. Repeated rows, equal texts and repeated or
    null doc_ids are each packed on their own. An empty text is one end id; an empty table gives no rows. Extra columns of
    ``docs`` are ignored.
    """
    pieces = materialise(tokenised_pieces(docs, vocabulary, capacity), "pieces")
    n = pieces.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
    salts = max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // SALTED))
    each = pieces.select("doc_id", "doc_tokens", F.explode(F.arrays_zip("starts", "lengths", "crcs")).alias("p")).select(
        "doc_id", "doc_tokens", F.col("p.starts").alias("start"), F.col("p.lengths").cast("long").alias("length"), F.col("p.crcs").alias("ids_crc32"),
        F.ceil(F.col("p.lengths") / granule).cast("int").alias("units"),
        F.pmod(F.xxhash64("doc_id", F.col("p.starts"), F.col("p.crcs")), F.lit(salts)).cast("int").alias("salt"),
    )
    return _placed(each, capacity // granule, gap)


def _placed(each: DataFrame, capacity: int, gap: float) -> DataFrame:
    """Ranks the pieces of each length in units and looks their places up in the plan."""
    counts = each.groupBy("units", "salt").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for units, n in counts.groupBy("units").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[units] = n
    # A row for each length of each pattern of the basis: bounded by the square of `capacity`, not by the documents.
    plan = each.sparkSession.createDataFrame(plan_rows(histogram, capacity, gap), "planned int, first long, last long, sequence long, slot int")
    slots = plan.groupBy("planned").agg(F.sort_array(F.collect_list(F.struct("first", "last", "sequence", "slot"))).alias("slots"))
    running = Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("units").alias("u"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    in_salt = F.row_number().over(Window.partitionBy("units", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = each.withColumn("in_salt", in_salt).join(before, (F.col("units") == F.col("u")) & (F.col("salt") == F.col("s")))
    found = ranked.withColumn("rank", F.col("before") + F.col("in_salt")).join(F.broadcast(slots), F.col("units") == F.col("planned"))
    placed = found.withColumn("at", F.expr("filter(slots, s -> s.first <= rank AND rank <= s.last)[0]"))
    placed = placed.withColumn("sequence_id", F.col("at.sequence") + F.col("rank") - F.col("at.first"))
    in_sequence = Window.partitionBy("sequence_id").orderBy("at.slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
