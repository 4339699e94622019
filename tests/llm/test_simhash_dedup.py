import re

import numpy as np
import xxhash

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids
from wayfold.llm.components import components
from wayfold.llm.simhash_dedup import block_masks, blocks_for, links, near_duplicates


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(nodes, near):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(spark):
    rows = near_duplicates(edge_docs(spark)).collect()
    fps = {r[0]: fingerprint(r[1]) for r in edge_rows()}
    want = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == want[r.doc_id]
    assert near_duplicates(no_docs(spark)).count() == 0


def test_links_connect_all_close_pairs_even_in_large_buckets(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 62, 6)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for c in centres for _ in range(60)})
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    want = brute_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for blocks, chunk in ((5, 4096), (6, 8), (7, 3)):
        found = {r.node: r.component for r in components(links(nodes, 4, blocks, chunk)).collect()}
        assert {n: found.get(n, n) for n in range(len(fps))} == want


def test_null_and_repeated_ids(spark):
    rows = near_duplicates(odd_docs(spark)).collect()
    least = {}
    for i, t in odd_ids():
        least[fingerprint(t)] = min((x for x in (i, least.get(fingerprint(t))) if x is not None), default=None)
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows), key=str) == sorted(((i, fingerprint(t), least[fingerprint(t)]) for i, t in odd_ids()), key=str)


def test_hot_keys_join_like_any_other(spark, monkeypatch):
    from wayfold.llm import hot

    monkeypatch.setattr(hot, "FEW", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (None, 4)) for i in range(n)], "k long, i int")
    table = spark.createDataFrame([(1, 50, "x"), (2, 3, "y"), (4, 9, "z")], "t long, n long, v string")
    want = sorted([(1, "x")] * 50 + [(2, "y")] * 3)
    assert sorted((r.k, r.v) for r in hot.join_counted(rows, table, [("k", "t")], "n").collect()) == want
    left = hot.join_counted(rows, table, [("k", "t")], "n", "left").collect()
    assert len(left) == 58 and sum(r.v is None for r in left) == 5


def test_masks_cover_the_bits():
    for blocks in (5, 6, 8):
        for mask in block_masks(blocks, 4):
            assert 0 < mask < 1 << 64
        assert all(sum(m >> b & 1 for m in block_masks(blocks, 4)) for b in range(64))
    assert blocks_for(10, 4) == 5 and blocks_for(10**6, 4) == 6 and blocks_for(10**10, 4) > 7


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)] + [(3, 2), (3, 2)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
