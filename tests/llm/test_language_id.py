import functools
import math
import random
from collections import Counter

import numpy as np

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids
from wayfold.llm.language_id import PpmModel, codes_of, context_counts, identify, learn

LANGUAGES = {"aa": "abcab", "bb": "bdebd", "cc": "xyzéx"}


def text(lang, seed, n=200):
    r = random.Random(seed)
    return "".join(r.choice(LANGUAGES[lang]) + (" " if r.random() < 0.2 else "") for _ in range(n))


def model(order=2, least=2):
    grams = {}
    for lang in LANGUAGES:
        c = Counter()
        for seed in range(5):
            data = text(lang, seed).encode()
            for n in range(1, order + 2):
                c.update(data[i : i + n] for i in range(len(data) - n + 1))
        grams[lang] = c
    seen = sorted({g[0] for c in grams.values() for g in c if len(g) == 1})
    symbols = np.zeros(256, dtype=np.int64)
    symbols[seen] = np.arange(1, len(seen) + 1)
    return grams, PpmModel({k: learn(contexts(c, least), symbols) for k, c in grams.items()}, symbols, order)


def contexts(grams, least):
    """{context: (bytes that follow, counts)} of those seen ``least`` times."""
    follow = {}
    for g, n in grams.items():
        follow.setdefault(g[:-1], {})[g[-1]] = n
    return {c: (np.array(sorted(f)), np.array([f[b] for b in sorted(f)], dtype=float)) for c, f in follow.items() if not c or sum(f.values()) >= least}


def slow_bits(grams, data, order, least):
    """PPM by its definition, a byte at a time."""
    totals = Counter()
    for g, n in grams.items():
        totals[g[:-1]] += n
    contexts = {c for c in totals if totals[c] >= least} | {b""}
    bits = 0.0

    @functools.cache
    def chances(context):
        counts = {g[-1]: n for g, n in grams.items() if g[:-1] == context}
        below = chances(context[1:]) if context else [1 / 256] * 256
        total, kinds, left = sum(counts.values()), len(counts), max(1 - sum(below[b] for b in counts), 1e-12)
        return [counts[b] / (total + kinds) if b in counts else below[b] / left * kinds / (total + kinds) for b in range(256)]

    for i, byte in enumerate(data):
        context = data[max(0, i - order) : i]
        while context not in contexts or not all(context[k:] in contexts for k in range(len(context))):
            context = context[1:]
        bits -= math.log2(chances(context)[byte])
    return bits


def test_contexts_are_counted_like_strings(spark):
    texts = [("aa", text("aa", 1)), ("cc", text("cc", 2)), ("cc", "é"), ("cc", ""), ("bb", None), ("aa", "x" * 1_100_000 + "yz" * 520_000)]
    got = {(r.lang, (r.context & ((1 << 56) - 1)).to_bytes(7, "big")[7 - (r.context >> 56) :]): dict(zip(r.symbols, r.counts, strict=True)) for r in context_counts(spark.createDataFrame(texts, "lang string, text string"), 3, 5).collect()}
    want = {}
    for lang, t in texts:
        data = (t or "").encode()
        c = Counter(data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1))
        for g, n in c.items():
            follow = want.setdefault((lang, g[:-1]), Counter())
            follow[g[-1]] += n
    assert got == {k: dict(f) for k, f in want.items() if not k[1] or sum(f.values()) >= 5}
    assert len(codes_of(b"", 3)) == 0 and len(codes_of(b"ab", 3)) == 3


def test_code_lengths_are_exact_whatever_the_segments():
    grams, m = model()
    texts = [text("aa", 9, 40).encode(), text("cc", 8, 25).encode(), b"", b"q?", "bdé".encode()]
    for segment in (7, 1024):
        got = m.code_lengths(texts, segment)
        for row, data in zip(got, texts, strict=True):
            for k, lang in enumerate(m.languages):
                assert abs(row[k] - slow_bits(grams[lang], data, 2, 2)) < 1e-3 * max(1, len(data))


def test_probabilities_sum_to_one():
    _, m = model()
    # Bytes without a column of their own share one: each of them costs as much as it says.
    alone = 256 - (m.width - 1)
    p = np.exp2(-m.cost.reshape(-1, m.width).astype(np.float64))
    assert np.allclose(p[:, 1:].sum(axis=1) + alone * p[:, 0], 1, atol=1e-3)


def test_held_out_accuracy_and_defined_results(spark):
    rows = [(i, text(lang, 1000 + i), lang) for i, lang in enumerate(list(LANGUAGES) * 40)]
    found = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=2, least=4).collect()
    right = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == right[r.doc_id] for r in found if r.held_out) / sum(r.held_out for r in found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    edge = {r.doc_id: r for r in identify(edge_docs(spark)).collect()}
    assert len(edge) == len({r[0] for r in edge_rows()})
    for i in (5, 6, 7, 16):  # empty, null, white space, no letter
        assert edge[i].lang_pred == "und" and edge[i].score == 0
    assert edge[0].lang_pred == "en"
    assert identify(no_docs(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "text", None)], "doc_id long, text string, lang string")
    assert identify(docs).first().lang_pred == "und"


def test_null_and_repeated_ids(spark):
    rows = identify(odd_docs(spark).selectExpr("*", "'en' AS lang")).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in rows), key=str) == sorted(((i, "en" if t else "und") for i, t in odd_ids()), key=str)
