import hashlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids
from wayfold.llm.exact_dedup import BinaryFuse, Snapshot, deduplicate, digests, same_bytes


def plain(text):
    return "".join(c for c in (text or "") if c not in " \t\n\v\f\r")


def test_against_brute_force(spark):
    groups = {}
    for r in edge_rows():
        groups.setdefault(plain(r[1]), []).append((-len(r[1] or ""), r[0]))
    rows = deduplicate(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    texts = {r[0]: r[1] for r in edge_rows()}
    for r in rows:
        key = plain(texts[r.doc_id])
        assert r.keep_id == min(groups[key])[1] and r.group_size == len(groups[key]) and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert deduplicate(no_docs(spark)).count() == 0


def test_any_split_into_snapshot_and_batch_gives_the_same(spark):
    docs = edge_docs(spark)
    want = sorted(map(tuple, deduplicate(docs).collect()))
    for split in (F.lit(True), F.lit(False), F.col("doc_id") < 4):
        assert sorted(map(tuple, deduplicate(docs, split).collect())) == want


def test_null_and_repeated_ids(spark):
    for split in (None, F.lit(False), F.coalesce(F.col("doc_id") < 4, F.lit(False)), F.length("text") % 2 == 0):
        rows = deduplicate(odd_docs(spark), split).collect()
        assert len(rows) == len(odd_ids())
        groups = {}
        for i, t in odd_ids():
            groups.setdefault(hashlib.sha256(plain(t).encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0))
        for r in rows:
            _, null, keep = min(groups[r.text_sha256])
            assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == (None if null else keep)


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        made = BinaryFuse.from_bytes(BinaryFuse.build(keys).to_bytes())
        if n:
            assert made.holds(keys).all()
            assert len(made.table) < (1.25 * n + 2000 if n > 50_000 else 2 * n + 200)
        other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
        assert made.holds(other).mean() < 0.01


def test_the_screen_lets_all_of_the_snapshot_through(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    rows = digests(docs, F.col("doc_id") < 2000)
    snapshot = Snapshot.of(rows.filter("old"))
    asked = rows.select("digest")
    passed = {bytes(r[0]) for r in snapshot.screen(asked).collect()}
    old = {bytes(r[0]) for r in rows.filter("old").select("digest").collect()}
    assert old <= passed and len(passed) < 2000 + 60


def test_bytes_are_compared(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "abc")], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    pairs = spark.createDataFrame([(bytearray(sha("ab")), 1, 2)], "digest binary, left_id long, right_id long")
    assert [bytes(r[0]) for r in same_bytes(docs, pairs).collect()] == [sha("ab")]
