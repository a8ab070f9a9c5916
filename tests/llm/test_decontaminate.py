import re

import pytest
from pyspark.sql import functions as F

from tests.compare import duck, same
from tests.llm import cases
from tidelog.llm.decontaminate import OP2_SQL, keep_clean, op2, scan


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items, size):
    out = []
    for i, t in docs:
        w, hit, who = words(t), set(), set()
        for item, text in items:
            q = words(text)
            k = min(size, len(q))
            wins = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)} if q else set()
            at = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in wins] if wins else []
            hit |= {x for j in at for x in range(j, j + k)}
            if at and item is not None:
                who.add(str(item))
        out.append((i, len(w), len(hit), sorted(who)))
    return sorted(out, key=repr)


ITEMS = [(1, cases.BASE), (2, "Quick, BROWN fox"), (3, "word"), (4, None), (5, ""), (None, "one two"), (6, "été à la PLAGE"), (6, "été à la PLAGE"), (7, cases.BASE.replace(" twenty", " other"))]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_equals_brute_force(spark, block):
    """Also with a benchmark of several automata."""
    got = scan(cases.clashing(spark), items(spark), size=4, block_bytes=block)
    found = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr)
    assert found == brute([r[:2] for r in cases.ROWS], ITEMS, 4)


def test_query(spark, sf):
    same(op2(spark, sf), duck(sf), OP2_SQL)


def test_spans_are_those_of_the_original(spark):
    text = "Ünder — (the QUICK,\tbrown... FOX) jumps"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = scan(docs, spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")).first()
    assert [text.encode()[a:b].decode() for a, b in r["spans"]] == ["QUICK,\tbrown... FOX"]


def test_empty(spark):
    assert scan(cases.empty(spark), items(spark)).count() == 0
    none = scan(cases.docs(spark), items(spark).where(F.lit(False)))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_clean_rows_keep_their_columns(spark, block):
    docs = cases.clashing(spark)
    clean = keep_clean(docs, items(spark), size=4, block_bytes=block)
    assert clean.columns == docs.columns
    wanted = [i for i, _, n, _ in brute([r[:2] for r in cases.ROWS], ITEMS, 4) if not n]
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted(wanted, key=repr)


def test_repeated_items_are_one_block(spark):
    """An item that fills most of the benchmark is taken once."""
    from tidelog.llm.decontaminate import item_blocks

    many = spark.range(5000).select(F.lit(1).cast("long").alias("item_id"), F.lit(cases.BASE).alias("text"))
    blocks = list(item_blocks(many, "item_id", "text", 1000))
    assert blocks == [[(1, cases.BASE)]]
    got = scan(cases.docs(spark), many, block_bytes=1000).where("doc_id = 1").first()
    assert got["n_hit"] == 20 and got["items"] == ["1"]


def test_string_ids_are_an_error(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        scan(cases.docs(spark).withColumn("doc_id", F.lit("x")), items(spark))
