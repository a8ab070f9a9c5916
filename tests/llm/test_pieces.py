import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tests.llm import cases
from tidelog.llm.pieces import CharMap, PieceMemo, encode_digests, encode_spans, op6

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.one_of(st.text(max_size=40), st.text(alphabet="aeb \t\n▁é😀'", max_size=40))


@pytest.fixture(scope="module")
def memo():
    return PieceMemo(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_memo_is_the_library(memo, library, texts):
    assert memo.by_word
    assert [i.tolist() for i in memo.ids(texts)] == library.encode(texts)


def test_memo_that_forgets(library):
    memo = PieceMemo(PATH)
    memo.memo.most = 3
    for text in ("a b c d  e f", " f e", "x ▁y z", "") * 3:
        assert memo.ids([text])[0].tolist() == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_spans_tile_the_text(memo, text):
    ids = memo.ids([text])[0]
    begin, end = memo.spans(text, ids)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(begin, end, strict=True)) == raw
    assert (begin[1:] >= begin[:-1]).all()
    for i, a, b in zip(ids.tolist(), begin, end, strict=True):
        piece = memo.sp.id_to_piece(i)
        if not memo.sp.is_byte(i):
            assert piece.replace("▁", " ").lstrip(" ") == raw[a:b].decode().replace("▁", " ").lstrip(" ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalising_by_the_compiled_map(rule):
    """Longest prefixes of the library's own maps."""
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(normaliser.serialized_model_proto())
    spec = model.normalizer_spec
    own = CharMap(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for text in ("ｱｲ ｳﾞ ＡＢＣ ½ ﬁ", "Ünïcode ĳ ǆ", "e\u0301 a\u0308", "plain", "", "①②  ㌔", "\u200b x\u00ad"):
        got, begin, end = own.normalise(text.encode())
        assert got.decode() == normaliser.normalize(text)
        assert len(begin) == len(end) == len(got) and all(0 <= a <= b <= len(text.encode()) for a, b in zip(begin, end, strict=True))


def test_extra_white_space_goes():
    own = CharMap(b"", True, True, True)
    got, begin, end = own.normalise("  a  b ".encode())
    assert got.decode() == "▁a▁b" and begin.tolist()[3] == 2 and end.tolist()[-1] == 6


def expected(rows, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for i, t in rows:
        ids = library.encode(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    return sorted(out, key=repr)


def test_query(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op6(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert cases.rows(got) == expected(rows, library)


def test_cases(spark, library):
    rows = [r[:2] for r in cases.ROWS]
    got = encode_digests(cases.clashing(spark), PATH, with_ids=True)
    assert cases.rows(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == expected(rows, library)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got.collect())
    spans = {r["doc_id"]: r for r in encode_spans(cases.docs(spark), PATH).collect()}
    assert spans[10]["decoded"] == cases.ROWS[10][1] and spans[4]["ids"] == [] and len(spans[7]["ends"]) == len(spans[7]["ids"])
    assert np.array(spans[9]["ids"]).tolist() == library.encode("word")
    assert encode_digests(cases.empty(spark), PATH).count() == 0 and encode_spans(cases.empty(spark), PATH).count() == 0
