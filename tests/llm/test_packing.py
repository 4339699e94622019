import zlib

import numpy as np
import pytest

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids
from wayfold.llm.packing import CuttingStock, pack, plan_rows


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check_packed(rows, texts):
    """The pieces are those of the texts (doc_id, text), each as often as its row, and sequences are gapless."""
    want = []
    for doc_id, text in texts:
        ids, start = ids_of(text), 0
        mine = sorted({r.start: r.length for r in rows if r.doc_id == doc_id and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())}.items())
        assert [s for s, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]] and sum(n for _, n in mine) == len(ids)
        want += [(doc_id, s, n, len(ids), zlib.crc32(ids[s : s + n].tobytes())) for s, n in mine]
    assert sorted(want, key=str) == sorted(((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in rows), key=str)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048


def test_every_id_is_in_one_piece_and_sequences_have_no_gaps(spark):
    check_packed(pack(edge_docs(spark)).collect(), [(r[0], r[1]) for r in edge_rows()])
    check_packed(pack(odd_docs(spark)).collect(), odd_ids())


def test_an_empty_table_has_no_pieces(spark):
    assert pack(no_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_the_histogram_and_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, dtype=np.int64)
    counts[1:] = rng.integers(0, 200, 256)
    counts[rng.integers(1, 257, 100)] = 0
    rows = plan_rows(counts, 256)
    seen, filled = {}, {}
    for length, first, last, sequence, _slot in rows:
        for k in range(last - first + 1):
            key = (length, first + k)
            assert key not in seen
            seen[key] = sequence + k
            filled[sequence + k] = filled.get(sequence + k, 0) + length
    assert len(seen) == counts.sum() and max(filled.values()) <= 256
    stock = CuttingStock(counts, 256)
    stock.solve()
    assert stock.bound > 0 and len(filled) <= 1.01 * stock.bound + 40


def test_a_pattern_is_priced_like_brute_force():
    stock = CuttingStock(np.array([0, 0, 0, 5, 0, 4, 0, 3]), 16)
    duals = np.array([0.2, 0.33, 0.47])
    best = max(duals @ np.array([a, b, c]) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert abs(duals @ stock._price(duals) - best) < 1e-9


def test_a_hot_length_is_spread(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'the same text' as text")
    rows = pack(docs)
    assert rows.count() == 2000
    per = rows.groupBy("sequence_id").count().agg({"count": "max"}).first()[0]
    assert per * rows.first().length <= 2048


def test_ids_of_the_end_token_s_string_equal_the_untouched_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from wayfold.llm.packing import _ids_of

    untouched = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|>b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", "plain words, 12"):
        assert list(_ids_of("byte_bpe_50k.json")(text)) == untouched.encode(text, add_special_tokens=False).ids
    assert _ids_of("byte_bpe_50k.json")("a <|endoftext|> b") == [64, 220, 50256, 275]
