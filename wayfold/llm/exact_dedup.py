"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a set of documents reduced to one row for each different digest, dealt into shards by digest; each shard has a
binary-fuse filter of eight-bit fingerprints, built once. A batch is reduced in the same way before anything is shuffled
by digest, so copies within the batch are grouped on their own and no digest is hot. Its digests are screened by the filter
of their shard; only positives are joined with the snapshot's exact rows, and there the normalised texts of both sides are
compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.hot import join_counted
from wayfold.plans.scratch import bounded_batches, materialise

WHITE = b" \t\n\x0b\x0c\r"
DIGESTS = "doc_id long, old boolean, n_chars long, digest binary"


def digests(docs: DataFrame, old) -> DataFrame:
    """(doc_id, old, n_chars, digest): code points of the whole text, and SHA-256 of it without white space. Null counts as
    empty. ``old`` is a column that is true for the rows of the snapshot."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            made = [hashlib.sha256(t.encode("utf-8", "replace").translate(None, WHITE)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(len, texts)), pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "old", "n_chars", "digest"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(old, F.lit(False))).mapInArrow(of, DIGESTS)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static three-wise binary-fuse filter: about nine and a half bits a key for 100,000, more for few; false positives 1 in 256, no false negatives."""

    def __init__(self, seed: int, segment: int, table: np.ndarray):
        self.seed, self.segment, self.table = seed, segment, table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three slots of each key, in three segments that follow each other, and its fingerprint."""
        h = _mixed(keys, self.seed)
        starts = len(self.table) // self.segment - 2
        first = ((h >> np.uint64(40)) % np.uint64(starts)).astype(np.int64) * self.segment
        low = np.uint64(self.segment - 1)
        inside = [(h & low).astype(np.int64), ((h >> np.uint64(13)) & low).astype(np.int64), ((_mixed(h, 1) >> np.uint64(7)) & low).astype(np.int64)]
        return np.stack([first + i * self.segment + inside[i] for i in range(3)]), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray, tries: int = 100) -> BinaryFuse:
        """Peels slots that only one key has, all that there are in a round at once, and fills them in the opposite order."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        slots = max(3, int(np.ceil(n * factor / segment)) + 2) * segment
        for seed in range(tries):
            made = cls(seed, segment, np.zeros(slots, dtype=np.uint8))
            places, prints = made._places(keys)
            count = np.bincount(places.ravel(), minlength=slots)
            which = np.zeros(slots, dtype=np.int64)  # exclusive or of the keys' numbers at a slot
            for row in places:
                np.bitwise_xor.at(which, row, np.arange(n))
            order, found = [], 0
            single = np.flatnonzero(count == 1)
            while len(single):
                owners, at = np.unique(which[single], return_index=True)
                own = single[at]
                order.append((owners, own))
                found += len(owners)
                touched = places[:, owners]
                for row in touched:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(which, row, owners)
                touched = np.unique(touched)
                single = touched[count[touched] == 1]
            if found == n:
                for owners, own in reversed(order):
                    p = places[:, owners]
                    made.table[own] = 0
                    made.table[own] = prints[owners] ^ made.table[p[0]] ^ made.table[p[1]] ^ made.table[p[2]]
                return made
        raise ValueError("no seed gives a filter")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys.astype(np.uint64))
        return (self.table[places[0]] ^ self.table[places[1]] ^ self.table[places[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment], dtype="<u4").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment = np.frombuffer(data[:8], dtype="<u4")
        return cls(int(seed), int(segment), np.frombuffer(data[8:], dtype=np.uint8))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join([d[:8] for d in column.to_pylist()]), dtype="<u8")


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many rows, and the row that stays (most code points, then smallest doc_id)."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id")))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


class Snapshot:
    """An immutable set of documents: its groups by digest, and a filter for each shard of them."""

    def __init__(self, groups: DataFrame, filters: DataFrame, shards: int):
        self.groups, self.filters, self.shards = groups, filters, shards

    @classmethod
    def of(cls, rows: DataFrame, per_shard: int = 100_000) -> Snapshot:
        """From the rows of ``digests``. The number of shards follows the number of digests, so a shard's size is bounded."""
        spark = rows.sparkSession
        groups = materialise(_groups(rows), "snapshot")
        shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // per_shard))

        def build(table: pa.Table) -> pa.Table:
            made = BinaryFuse.build(_keys(table.column("digest"))).to_bytes()
            return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})

        filters = groups.select(_shard(shards).alias("shard"), "digest").groupBy("shard").applyInArrow(build, "shard int, filter binary")
        return cls(groups, materialise(filters, "filters"), shards)

    def screen(self, groups: DataFrame) -> DataFrame:
        """The batch's groups that the filters let through: every digest of the snapshot, and about 1 in 256 others."""

        def probe(batch: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not batch.num_rows:
                return batch.slice(0, 0).select(["digest"])
            keep = BinaryFuse.from_bytes(filters.column("filter")[0].as_py()).holds(_keys(batch.column("digest")))
            return batch.select(["digest"]).filter(pa.array(keep))

        dealt = groups.select(_shard(self.shards).alias("shard"), "digest").groupBy("shard")
        return dealt.cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "digest binary")


def _maybe(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The documents whose hashed id is marked in a bitmap of fixed size (2 ** bits bits): a superset of those in ``ids``.

    It spares the shuffle of other documents' texts; the join that follows is exact.
    """
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << bits))
    maps = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap"))
    marked = docs.withColumn("spot", spot).withColumn("bucket_of", F.bitmap_bucket_number("spot")).join(F.broadcast(maps), F.col("bucket_of") == F.col("bucket"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bitmap_bit_position(spot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, cast(bitmap_bit_position(spot) % 8 as int))")
    return marked.filter(byte.bitwiseAND(bit) != 0).drop("spot", "bucket_of", "bucket", "bitmap")


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of (digest, left_id, right_id), the digests for which both documents' normalised texts are the same bytes."""
    wanted = pairs.select("digest", F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    texts = _maybe(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), wanted.select(F.col("id").alias("doc_id")))
    plain = F.translate(F.coalesce("text", F.lit("")), WHITE.decode(), "")
    # Ids may be null, on many rows: the digest is part of the join.
    own = texts.select("doc_id", plain.alias("plain")).withColumn("own", F.unhex(F.sha2("plain", 256)))
    joined = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    return joined.groupBy("digest").agg(F.min("plain").alias("least"), F.max("plain").alias("most")).filter("least = most").select("digest")


def deduplicate(docs: DataFrame, in_snapshot=None) -> DataFrame:
    """A row for every document: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` is a column that says which documents are the snapshot; the others are the new batch. Without it, half of
    them by hashed doc_id are. Texts are equal when identical without white space ([\\x20\\x09-\\x0D]); null counts as empty. The
    row with the most code points stays, then the smallest doc_id. Rows that repeat a doc_id count one by one in group_size
    and share its fate. A null doc_id stays only if no other row of its length is equal. An empty table gives no rows; extra
    columns are ignored.
    """
    first = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    rows = materialise(digests(docs, first), "digests")
    snapshot = Snapshot.of(rows.filter("old"))
    fresh = materialise(_groups(rows.filter("NOT old")), "batch")
    old = snapshot.groups.select(F.col("digest").alias("d"), F.col("n").alias("old_n"), F.col("best").alias("old_best"))
    hits = snapshot.screen(fresh).join(fresh, "digest").join(old, F.col("digest") == F.col("d"))
    pairs = materialise(hits.select("digest", "n", "best", "old_n", "old_best", (-F.col("best.minus_id")).alias("left_id"), (-F.col("old_best.minus_id")).alias("right_id")), "hits")
    proven = pairs.join(same_bytes(docs, pairs), "digest")
    merged = materialise(proven.select(F.col("digest").alias("m"), (F.col("n") + F.col("old_n")).alias("all_n"), F.greatest("best", "old_best").alias("all_best")), "merged")
    sides = snapshot.groups.withColumn("side", F.lit(True)).union(fresh.withColumn("side", F.lit(False)))
    final = materialise(sides.join(merged, F.col("digest") == F.col("m"), "left").select(F.col("digest").alias("g"), "side", "n", F.coalesce("all_n", "n").alias("group_size"), F.coalesce("all_best", "best").alias("best")), "final")
    joined = join_counted(rows, final, [("digest", "g"), ("old", "side")], "n")
    keep = -F.col("best.minus_id")
    return joined.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
