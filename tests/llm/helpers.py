"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

WORDS = "the of and to in is that for on with as by at from this be are was it an river stone light cloud paper green winter morning quiet table window garden street music yellow letter bridge market engine silver".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([".", ","]) if r.random() < 0.1 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, score, fp, node, units)"""
    base = prose(1, 120)
    texts = [base, base, base.replace("river", "stone", 1), base.upper(), f"  {base}\n\n", "", None, "   \n\t", "one", "one two", "x" * 5000, prose(2, 6000), "日本語 テキスト 😀", "\u0000odd space", prose(3, 80), prose(3, 80) + " more", "1 2 3 !!!"]
    rows = [(i, t, "en" if i % 3 else None, "s", None, 0.5, 7, 3, 1) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[5]]  # repeated rows


def odd_ids() -> list[tuple]:
    """(doc_id, text): null doc_ids, and doc_ids that repeat with different texts."""
    a, b, c = prose(11, 60), prose(12, 60), prose(13, 60)
    return [(3, a), (5, a), (5, b), (None, b), (None, c), (None, c), (None, None), (3, b + "  "), (7, c.replace(" ", "  "))]


def odd_docs(spark):
    return spark.createDataFrame(odd_ids(), "doc_id long, text string")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, node long, units int"


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
