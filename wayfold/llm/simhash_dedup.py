"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified Hamming distance, connected components.

Fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` blocks, so they meet in one of the
tables keyed by ``blocks - radius`` blocks. More blocks make longer keys and more tables; the number is taken from the count
of different fingerprints, so that a key is expected to be shared by few of them.

A bucket gives the edges of a spanning forest of its links and not all its pairs. In buckets above ``chunk`` fingerprints, those
near the bucket's first are linked to it at once. The others are split into chunks, and every pair of chunks with one of the
others at least is a task's run of its own: a bucket never has to fit in one, and what one fingerprint already joins is not
paired among itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.components import components
from wayfold.llm.hot import join_counted
from wayfold.plans.scratch import bounded_batches, materialise

SEED = 42


def shingle_hashes(text: str, size: int = 4) -> np.ndarray:
    """XXH64 of each shingle of the words of ``text`` with A-Z in lower case, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null text counts as empty, whose fingerprint is 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(t.as_py() or "", shingle)) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The masks of the tables: every choice of ``blocks - radius`` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int, shared: float = 0.5) -> int:
    """The least number of blocks at which a key is expected to be shared by under ``shared`` other fingerprints."""
    return next(b for b in range(radius + 1, 17) if n <= shared * 2 ** (64 * (b - radius) / b) or b == 16)


def _spanning(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among ``fps``, breadth first: no pair is listed but the tree's."""
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                for k in left[near].tolist():
                    queue.append(k)
                    yield at, k
                left = left[~near]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(nodes: DataFrame, radius: int = 4, blocks: int | None = None, chunk: int = 4096) -> DataFrame:
    """Edges (a, b) between nodes (node long, fp long; each fp once) that connect whatever is within ``radius`` bits.

    The edges are a spanning forest in each bucket, so every pair within the radius ends up in one component.
    """
    masks = [_signed(m) for m in block_masks(blocks or blocks_for(nodes.count(), radius), radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")
    keyed = nodes.select("node", "fp", tables).select("node", "fp", F.col("k.t").alias("t"), F.col("k.key").alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(F.struct("fp", "node")).alias("lead")).filter("n > 1").select(F.col("t").alias("bt"), F.col("key").alias("bk"), "n", "lead")
    large = materialise(sizes.filter(F.col("n") > chunk), "large")
    small = keyed.join(sizes.filter(F.col("n") <= chunk), (F.col("t") == F.col("bt")) & (F.col("key") == F.col("bk"))).select("t", "key", F.lit(0).alias("p"), F.lit(0).alias("q"), "node", "fp")
    if large.isEmpty():
        return _forests(small, radius)
    # Large buckets are fewer than keys / chunk, and their rows are of fixed width.
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= radius
    crowded = materialise(join_counted(keyed, large, [("t", "bt"), ("key", "bk")], "n").select("t", "key", "node", "fp", F.col("lead.node").alias("lead"), near.alias("near")), "crowded")
    counts = crowded.groupBy("t", "key").agg(F.count_if("near").alias("a"), F.count_if(~F.col("near")).alias("b"), F.count("*").alias("n"))
    parts = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    sized = materialise(counts.filter("b > 0").select(F.col("t").alias("bt"), F.col("key").alias("bk"), "n", parts("a").alias("pa"), parts("b").alias("pb")), "sized")
    own = F.when(F.col("near"), F.pmod(F.xxhash64("fp"), F.col("pa"))).otherwise(F.col("pa") + F.pmod(F.xxhash64("fp"), F.col("pb"))).cast("int")
    # Chunks below pa hold what is near the first fingerprint: they meet all chunks from pa on, those meet every chunk.
    first = F.when(F.col("near"), F.col("pa")).otherwise(F.lit(0))
    pairs = F.explode(F.transform(F.sequence(first, F.col("pa") + F.col("pb") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("p"), F.greatest(x, F.col("own")).alias("q"))))
    runs = join_counted(crowded, sized, [("t", "bt"), ("key", "bk")], "n").withColumn("own", own).select("t", "key", pairs.alias("c"), "node", "fp").select("t", "key", F.col("c.p").alias("p"), F.col("c.q").alias("q"), "node", "fp")
    to_lead = crowded.filter("near AND node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return _forests(small.unionByName(runs), radius).unionByName(to_lead)


def _forests(runs: DataFrame, radius: int) -> DataFrame:
    """The edges of a spanning forest of the links within each run (t, key, p, q) of rows (node, fp)."""
    dealt = runs.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges_of(run: list[np.ndarray]) -> list[tuple[int, int]]:
            t, key, p, q, node, fp = run
            fp = fp.view(np.uint64)
            changes = (np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(t)]])
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            made = list(zip(node[two].tolist(), node[two + 1].tolist(), strict=True))
            for lo, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                made += [(int(node[lo + i]), int(node[lo + j])) for i, j in _spanning(fp[lo : lo + n], radius)]
            return made

        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = np.ones(len(columns[0]), dtype=bool)
            for c in columns[:4]:
                last &= c == c[-1] if len(c) else True
            end = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            made = edges_of([c[:end] for c in columns]) if end else []
            held = [c[end:] for c in columns]
            if made:
                yield _edge_batch(made)
        if held is not None and len(held[0]):
            yield _edge_batch(edges_of(held))

    return dealt.mapInArrow(forest, "a long, b long")


def _edge_batch(made: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*made, strict=True) if made else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document: components of fingerprints within ``radius`` bits.

    component_id is the smallest doc_id of the component. Texts without a word have fingerprint 0 and are linked like any
    other; null text counts as empty. Each row goes by its own text: rows that repeat a doc_id with different texts have the
    components of their texts, which the doc_id alone does not join, though it names them. A null doc_id keeps its row and
    takes the component of its fingerprint, null if no doc_id has it. An empty table gives no rows; extra columns are ignored.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    # Fingerprints are the nodes: their smallest doc_ids may be one.
    labels = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, blocks))
    named = materialise(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    names = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    of_fp = materialise(join_counted(named, names, [("component", "c")], "size").select(F.col("fp").alias("f"), "n", "component_id"), "of-fp")
    joined = join_counted(fps, of_fp, [("fp", "f")], "n")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
