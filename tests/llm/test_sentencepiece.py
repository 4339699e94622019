import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_docs, edge_rows, no_docs
from wayfold.llm.sentencepiece_codec import codec, encode_decode

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "ing", "0", "12", ".", ",", "é", "ß", "😀", "中", "▁", "<s>", "\x00", "<0x41>", "²", "Ünder", "===", "'s"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=40).filter(lambda t: not any(0xD800 <= ord(c) <= 0xDFFF for c in t))))
def test_ids_and_text_are_the_library_s(text):
    c = codec("piece_bpe_32k.model")
    ids = LIBRARY.encode(text)
    assert c.encode(text) == ids
    assert c.decode(ids) == LIBRARY.decode(ids) == c.coded(text)[2]


def test_long_units_need_no_recursion():
    c = codec("piece_bpe_32k.model")
    for text in ("ab" * 20_000, "x" * 30_000, " " * 1000 + "y"):
        assert c.encode(text) == LIBRARY.encode(text)


def test_rows(spark):
    rows = encode_decode(edge_docs(spark), with_ids=True).collect()
    assert len(rows) == len(edge_rows())
    texts = {r[0]: r[1] or "" for r in edge_rows()}
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == LIBRARY.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert encode_decode(no_docs(spark)).count() == 0
