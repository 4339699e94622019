import hashlib

import numpy as np

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids, prose
from wayfold.llm.fingerprints import edited, fingerprint_documents, likeness, permutations, simhash, term_votes, with_neighbours, within


def test_rows_meet_the_next_document(spark):
    docs = spark.createDataFrame([r[:2] for r in edge_rows()[:17]], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    texts = [r[1] or "" for r in edge_rows()[:17]]
    assert len(rows) == 17
    for i, text in enumerate(texts):
        after = texts[(i + 1) % 17]
        k = len(text) // 4
        changed = text[: len(text) - k] + after[:k]
        assert edited(text, after) == changed
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint & (1 << 64) - 1 == simhash(text)
        assert r.near_edited == likeness(simhash(text), simhash(changed)) and r.near_next == likeness(simhash(text), simhash(after))


def test_many_buckets_one_row_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(i * i, prose(i, 20)) for i in range(300)], "doc_id long, text string")
    rows = fingerprint_documents(docs).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [i * i for i in range(300)]
    assert all(r.near_next == likeness(simhash(prose(i, 20)), simhash(prose((i + 1) % 300, 20))) for i, r in enumerate(rows))
    assert fingerprint_documents(edge_docs(spark)).count() == len(edge_rows())
    assert fingerprint_documents(no_docs(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprint_documents(one).first().near_next == 1.0
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    assert fingerprint_documents(odd).count() == 3
    made = fingerprint_documents(odd_docs(spark)).collect()
    assert sorted((r.doc_id, r.n_chars, r.fingerprint & (1 << 64) - 1) for r in made if r.doc_id) == sorted((i, len(t or ""), simhash(t or "")) for i, t in odd_ids() if i)
    assert len(made) == len(odd_ids())


def test_votes_are_whole_numbers():
    hashes, weights = term_votes(prose(7, 50) + " " + "x" * 70_000)
    assert (weights == np.floor(weights)).all() and weights.max() * (1 << 15) < 1 << 24 and len(hashes) == len(weights)


def test_equal_texts_and_changes():
    text = prose(4, 400)
    assert simhash(text) == simhash(text)
    assert likeness(simhash(text), simhash(edited(text, prose(5, 400)))) > likeness(simhash(text), simhash(prose(6, 400)))


def test_search_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = sorted({int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)))) for b in base for _ in range(6)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    mask = (1 << 64) - 1
    want = {(a, b, ((a ^ b) & mask).bit_count()) for a in fps[::3] for b in fps if ((a ^ b) & mask).bit_count() <= 3}
    for blocks in (None, 4, 5, 6):
        got = {tuple(r) for r in within(df, spark.createDataFrame([(f,) for f in fps[::3]], "fp long"), 3, blocks).collect()}
        assert got == want
    assert len(permutations(6, 3)) == 20


def test_neighbours_are_counted_for_the_asked_rows(spark):
    text = prose(1, 200)
    docs = spark.createDataFrame([(0, text), (1, text), (20, prose(9, 200)), (21, text)], "doc_id long, text string")
    rows = {r.doc_id: r.n_near for r in with_neighbours(fingerprint_documents(docs)).collect()}
    assert rows == {0: 2, 1: None, 20: 0, 21: None}
