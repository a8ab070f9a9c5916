"""The pipeline next to brute-force versions of its stages, and its place in the entry."""

import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm import cases
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as near
from tidelog.llm import language, queries

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(rows, items, model):
    """(id, tokens, digest of ids) of what should be left of (id, text) rows with different ids."""
    judged = {i: model.judge(t) for i, t in rows}
    left = [(i, t) for i, t in rows if judged[i][0] != language.UND and judged[i][2] >= 0.5]
    comp = {i: c for i, _, c in near(left, 5)}
    left = [(i, t) for i, t in left if comp[i] == i]
    hit = {i for i, _, n, _ in leaks(left, items, 10) if n}
    out = []
    for i, t in left:
        if i not in hit:
            ids = LIBRARY.encode(t)
            out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = cp.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256")
    wanted = expected(rows, items, language.fit(docs))
    assert sorted(map(tuple, got.collect())) == wanted and 0 < len(wanted) < len(rows)


def test_stages_keep_the_columns(spark, sf):
    docs = cases.docs(spark)
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
    assert docs.count() > 0


def test_edge_cases_go_through(spark, sf, tmp_path):
    for frame in (cases.docs(spark), cases.clashing(spark), cases.empty(spark)):
        now = frame
        for k, (_, stage) in enumerate(cp.STAGES):
            at = str(tmp_path / f"{id(frame)}-{k}")
            stage(spark, now, sf).write.parquet(at)
            now = spark.read.parquet(at)
        assert "ids" in now.columns
        assert now.where(F.col("doc_id").isin(4, 5, 6, 12)).count() == 0


def test_without_any_language(spark, sf):
    """Nothing is learned, so stage 1 drops what has no letter and nothing else."""
    docs = cases.docs(spark).withColumn("lang", F.lit(None).cast("string"))
    left = dict(cp.STAGES)["language"](spark, docs, sf)
    assert left.columns == docs.columns
    wanted = sorted(r[0] or 0 for r in cases.ROWS if any(map(str.isalpha, r[1] or "")))
    assert sorted(r["doc_id"] or 0 for r in left.select("doc_id").collect()) == wanted
    # Nor is anything learned from texts without a letter.
    only = docs.withColumn("lang", F.when(F.col("doc_id") == 12, "en"))
    assert dict(cp.STAGES)["language"](spark, only, sf).count() == len(wanted)


def test_registered():
    found = entry.queries()
    assert found["pipeline"] is cp.run and set(queries.QUERIES) <= set(found)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" not in entry.oracle_sql()
