"""Document fingerprints: SimHash of weighted terms, and a search for all fingerprints within a Hamming radius.

A term is a run of words; its hash votes, with the term's weight, for or against each of 64 bits, and the signs of the sums
are the fingerprint. The search keeps a table for each choice of blocks: the fingerprint's bits permuted so that those blocks
come first, keyed by them. Fingerprints within the radius agree in all the leading blocks of at least one table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.hot import join_counted
from wayfold.plans.scratch import bounded_batches, materialise

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def term_votes(text: str, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the terms of a text: runs of ``size`` words in lower case, or all of them if there are fewer.

    A longer term says more, so its weight is the number of binary digits of its length in bytes. Weights are whole numbers, so
    that sums are exact in any order.
    """
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * FACTORS[2] + hashes[i : i + n] * FACTORS[i & 1]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * FACTORS[1]
        mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([[0], np.cumsum(lengths)])
    return mixed, np.frexp(total[size:] - total[:-size])[1].astype(np.float32)


def simhash(text: str, size: int = 2) -> int:
    """The fingerprint of a whole text; 0 if it has no words."""
    hashes, weights = term_votes(text, size)
    votes = np.zeros(64)
    for at in range(0, len(hashes), 1 << 15):
        part, weight = hashes[at : at + (1 << 15)].astype("<u8"), weights[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        votes += 2.0 * (weight @ bits) - weight.sum(dtype=np.float64)  # below 2 ** 24, and so exact
    return int(np.packbits(votes > 0, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, near_edited double, near_next double"
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 64 << 20


def _row(doc_id: int | None, text: str, fp: int, following: str, fp_next: int, size: int) -> tuple:
    changed = edited(text, following)
    other = simhash(changed, size)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), _signed(fp), _signed(other), likeness(fp, other), likeness(fp, fp_next))


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def fingerprint_documents(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The next document is the next in order of (doc_id, hash of the text, text), a null doc_id being first and the first one
    following the last. Null text counts as empty; a text without words has fingerprint 0; repeated rows follow each other. An
    empty table gives no rows; extra columns are ignored.

    Texts move once, into ranges in that order, whose number follows their bytes. Within a range each row meets the next; the
    ends of the ranges, two rows each, meet in a join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // RANGE_BYTES))
    dealt = rows.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    fields = f"{ROW}, place int, side int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId(), None  # doc_id, text, fingerprint: waits for the row after it
        end = lambda side, row: (row[0], None, None, _signed(row[2]), None, None, None, place, side, row[1])
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                now = (doc_id, text, held[2] if held is not None and held[1] == text else simhash(text, size))
                out.append(end(0, now) if held is None else (*_row(*held, text, now[2], size), place, None, None))
                held = now
            yield _batch(out, fields)
        if held is not None:
            yield _batch([end(1, held)], fields)

    bounded_batches(spark)
    met = materialise(dealt.mapInArrow(run, fields), "ranges")
    # A row for each range, without its texts: the range after each, and the first after the last.
    places = met.filter("side = 0").select("place")
    order = Window.orderBy("place")
    after = places.select("place", F.coalesce(F.lead("place").over(order), F.first("place").over(order)).alias("after"))
    last = met.filter("side = 1").select("doc_id", "text", "fingerprint", "place")
    first = met.filter("side = 0").select(F.col("place").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("fp_next"))
    ends = last.join(after, "place").join(first, "after").select("doc_id", "text", "fingerprint", "following", "fp_next")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_row(d, t, fp % (1 << 64), following, fp_next % (1 << 64), size) for d, t, fp, following, fp_next in zip(*(c.to_pylist() for c in batch.columns), strict=True)], ROW)

    names = [f.split()[0] for f in ROW.split(", ")]
    return met.filter("side IS NULL").select(*names).unionByName(ends.mapInArrow(join_ends, ROW))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def as_hex(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def permutations(blocks: int, radius: int) -> list[list[tuple[int, int, int]]]:
    """For each table, how its bits move: (from, width, to), the chosen blocks to the high end."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = list(itertools.pairwise(edges))
    tables = []
    for chosen in itertools.combinations(range(blocks), blocks - radius):
        order = [*chosen, *(b for b in range(blocks) if b not in chosen)]
        moves, top = [], 64
        for b in order:
            lo, hi = parts[b]
            top -= hi - lo
            moves.append((lo, hi - lo, top))
        tables.append(moves[: blocks - radius])
    return tables


def _lead(column, moves: list[tuple[int, int, int]]):
    """The leading blocks of the permuted fingerprint; the rest of its bits are zero."""
    made = F.lit(0).cast("long")
    for lo, width, to in moves:
        part = F.shiftrightunsigned(column, lo).bitwiseAND(F.lit((1 << width) - 1) if width < 64 else F.lit(-1))
        made = made.bitwiseOR(F.shiftleft(part, to))
    return made


def within(fingerprints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(query_fp, fp, distance): for every different query fingerprint all different fingerprints within ``radius`` bits.

    Both frames have a column ``fp`` (long). Copies are not expanded: join the result with the rows that have a fingerprint.
    """
    table, asked = fingerprints.select("fp").distinct(), queries.select(F.col("fp").alias("query_fp")).distinct()
    if blocks is None:
        n = table.count()
        blocks = next(b for b in range(radius + 1, 17) if n <= 2 ** (64 * (b - radius) / b - 1) or b == 16)
    moves = permutations(blocks, radius)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), _lead(F.col(name), m).alias("key")) for i, m in enumerate(moves)])
        return df.select(name, F.explode(keys).alias("k")).select(name, "k.t", "k.key")

    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("query_fp")))
    # Either side grows with the data, so neither is to be broadcast.
    met = keyed(table, "fp").join(keyed(asked, "query_fp").hint("merge"), ["t", "key"]).filter(distance <= radius)
    return met.select("query_fp", "fp", distance.cast("int").alias("distance")).distinct()


def with_neighbours(rows: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """Adds n_near: for rows whose doc_id is divisible by ``every``, how many other rows lie within ``radius`` bits."""
    rows = materialise(rows, "fingerprints")
    asked_for = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = materialise(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"), F.bool_or(asked_for).alias("asked")), "counts")
    found = within(counts, counts.filter("asked"), radius).join(counts.select("fp", "n").hint("merge"), "fp").groupBy(F.col("query_fp")).agg((F.sum("n") - 1).alias("n_near"))
    near_of = materialise(counts.select("fp", F.col("n").alias("k")).join(found.hint("merge"), F.col("fp") == F.col("query_fp"), "left").select("fp", "k", "n_near"), "near")
    joined = join_counted(rows, near_of, [("fingerprint", "fp")], "k", merge=True)
    near = F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near")
    return joined.select("doc_id", "n_chars", "edited_sha256", as_hex("fingerprint").alias("fingerprint"), as_hex("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", near)
