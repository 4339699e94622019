import random

import pytest

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids, prose
from tests.llm.test_near_copies import brute_components, edited, jaccard, shingles
from tests.llm.test_packing import check_packed

corpus_pipeline = __import__("corpus_pipeline")


def plain(text):
    return "".join(c for c in (text or "") if c not in " \t\n\v\f\r")


def one_by_one(rows, of_group):
    """Rows kept by brute force: one of each group, by what ``of_group`` says of a group's rows."""
    return sorted((min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0, r[1] or "")) for g in of_group(rows)), key=str)


def exact_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(plain(r[1]), []).append(r)
    return list(groups.values())


def near_groups(rows):
    """Components of rows alike, as lists."""
    sets = [frozenset(shingles(r[1])) for r in rows]
    up = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] == sets[j] or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8)])
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(up[i], []).append(r)
    return list(groups.values())


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def corpus(seed, n=30):
    r = random.Random(seed)
    rows = [(i, prose(100 * seed + i, 90)) for i in range(n)]
    rows += [(n + i, r.choice([rows[i][1], f" {rows[i][1]}\n", edited(rows[i][1], 1, i), edited(rows[i][1], 12, i)])) for i in range(n)]
    rows += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, "12 34 !"), (3, rows[4][1]), (None, rows[5][1]), (None, prose(seed + 5000, 90)), rows[0]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = kept(corpus_pipeline.drop_exact_copies(spark, docs, ""))
    assert exact == one_by_one(rows, exact_groups)
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(exact, "doc_id long, text string"), "")
    ids = kept(near)
    groups = near_groups(exact)
    assert len(ids) == len(groups)
    for group in groups:
        stays = [r for r in group if r in ids]
        assert len(stays) == 1 and stays[0][0] == min((r[0] for r in group if r[0] is not None), default=None)


def test_null_and_repeated_ids(spark):
    exact = kept(corpus_pipeline.drop_exact_copies(spark, odd_docs(spark), ""))
    assert exact == one_by_one(odd_ids(), exact_groups)
    leak = [(5, "alpha text one"), (5, "beta text two"), (3, "beta  text  two")]
    assert kept(corpus_pipeline.drop_exact_copies(spark, spark.createDataFrame(leak, "doc_id long, text string"), "")) == [(3, "beta  text  two"), (5, "alpha text one")]
    near = kept(corpus_pipeline.drop_near_copies(spark, odd_docs(spark), ""))
    groups = near_groups(odd_ids())
    assert len(near) == len(groups) and all(sum(r in near for r in set(g)) == 1 for g in groups)


def test_stages_keep_what_they_should(spark, tmp_path):
    rows = [(i, prose(i, 100), "en", "s", 0) for i in range(30)]
    copy = rows[3][1]
    rows += [(50, copy, "en", "s", 0), (51, f" {copy} ", None, "s", 0), (60, None, None, "s", 0), (61, "12 34", None, "s", 0), (70, copy + " end", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    stays = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(30)) - {3} <= set(stays) and 60 not in stays and 61 not in stays and 50 not in stays
    assert len(set(stays) & {3, 50, 51, 70}) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(stays)
    check_packed(packed, [(i, t) for i, t in stays.items()])


def test_languages(spark):
    rows = [(i, prose(i, 60), "en" if i % 3 else None) for i in range(40)] + [(50, None, "en"), (51, "", "en"), (52, "1 2", None), (None, prose(77, 50), None), (7, prose(78, 50), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lost = {(i, t) for i, t, _ in rows} - {(r.doc_id, r.text) for r in corpus_pipeline.identify_languages(spark, docs, "").collect()}
    assert lost == {(50, None), (51, ""), (52, "1 2")}
    unlabelled = corpus_pipeline.identify_languages(spark, docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), "")
    assert unlabelled.count() == len(rows) - 3


def test_repeated_rows_and_extra_columns(spark):
    clash = edge_docs(spark).selectExpr("*", "1 AS __key", "2 AS __rank", "'x' AS __lang", "3 AS __digest", "4 AS `a.b`")
    once = corpus_pipeline.drop_exact_copies(spark, clash, "")
    assert once.columns == clash.columns
    ids = sorted(r.doc_id for r in once.collect())
    assert len(ids) == len(set(ids)) < len(edge_rows())
    assert corpus_pipeline.drop_near_copies(spark, clash, "").columns == clash.columns
    assert corpus_pipeline.identify_languages(spark, clash, "").columns == clash.columns


def test_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), "").count() == 0, name
