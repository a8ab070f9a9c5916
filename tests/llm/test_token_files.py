import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tidelog.llm.token_files import STABLE, WordMemo, decode_block, encode_block, op4, read_blocks, read_files, tokenise_to_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def memo():
    return WordMemo(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1))))
def test_code(ids):
    a = np.array(ids, np.uint32)
    control, data = encode_block(a)
    assert len(control) == -(-len(ids) // 4) and decode_block(control, data, len(ids)).tolist() == ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=STABLE + "'’", max_size=60), st.text(max_size=30), st.text(alphabet="aA's 'tT're 1.,\n<|>", max_size=40)))
def test_memo_is_the_library(memo, library, text):
    got = np.frombuffer(memo.ids([text])[0], "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_memo_that_forgets(library):
    memo = WordMemo(PATH, "<u2")
    memo.memo.most = 5
    for text in ("a b c d e f g h", "h g f x y z a", "a b c d e f g h i j k l m") * 3:
        assert np.frombuffer(memo.ids([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def wanted(rows, library, end):
    out, start = [], 0
    for doc, ids in sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u4").tobytes())):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op4(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == wanted(rows, library, 1)


def test_cases_and_files(spark, tmp_path, library):
    manifest = tokenise_to_files(cases.clashing(spark), PATH, str(tmp_path / "t"), 1)
    got = sorted(map(tuple, read_files(manifest).collect()), key=lambda r: r[1])
    plain = [(r[0], r[2], r[3]) for r in got]
    assert sorted(plain, key=repr) == sorted([(d, n, c) for d, _, n, c in wanted([r[:2] for r in cases.ROWS], library, 1)], key=repr)
    ends = 0
    for _, start, n, _ in got:
        assert start == ends
        ends += n
    docs = [d for r in manifest.orderBy("part").collect() for block, _, _ in read_blocks(r["path"]) for d in block]
    assert docs == sorted(docs, key=lambda d: (d is not None, d or 0)) and len(docs) == len(cases.ROWS)
    with_ids = read_files(manifest, with_ids=True).where("doc = 9").first()["ids"]
    assert np.frombuffer(with_ids, "<u4").tolist() == [*library.encode("word", add_special_tokens=False).ids, 1]
    ranks = np.frombuffer((tmp_path / "t" / "ranks.bin").read_bytes(), "<u4")
    assert sorted(ranks.tolist()) == list(range(len(ranks)))


def test_files_grow_with_the_ids(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = tokenise_to_files(docs, PATH, str(tmp_path / "few"), 1)
    n = few.agg({"n_ids": "sum"}).first()[0]
    monkeypatch.setattr("tidelog.llm.token_files.FILE_IDS", n // 20)
    many = tokenise_to_files(docs, PATH, str(tmp_path / "many"), 1)
    assert few.count() < 20 <= many.count() <= 21
    assert read_files(many).exceptAll(read_files(few)).count() == 0 and many.agg({"n_ids": "sum"}).first()[0] == n


def test_empty(spark, tmp_path):
    manifest = tokenise_to_files(cases.empty(spark), PATH, str(tmp_path / "t"), 1)
    assert read_files(manifest).count() == 0 and (tmp_path / "t" / "ranks.bin").exists()


def test_not_a_file(tmp_path):
    (tmp_path / "ranks.bin").write_bytes(b"")
    (tmp_path / "part-0.tok").write_bytes(b"something else")
    with pytest.raises(ValueError):
        list(read_blocks(str(tmp_path / "part-0.tok")))
