import os
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import duck, same
from tests.llm import cases
from tidelog.llm import near_dedup as nd
from tidelog.scratch import scratch_root
from tidelog.session import union


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent=80):
    """Component of each (id, text): the least id reachable over links."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [k for k, (i, s) in enumerate(sets) if s and i is not None]
    for n, a in enumerate(live):
        for b in live[n + 1 :]:
            both = len(sets[a][1] & sets[b][1])
            if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k in live:
        least[root(k)] = min(least.get(root(k), sets[k][0]), sets[k][0])
    return sorted(((i, len(s), least[root(k)] if s and i is not None else i) for k, (i, s) in enumerate(sets)), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def family(rng, n, base=80, edits=3, start=0):
    """Texts that differ from their predecessor by a few words: chains of links."""
    w, out = [f"w{rng.randrange(400)}" for _ in range(base)], []
    for k in range(n):
        out.append((start + k, " ".join(w)))
        w = list(w)
        for _ in range(rng.randrange(1, edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    rng = random.Random(size)
    rows = [r for f in range(12) for r in family(rng, rng.randrange(1, 14), rng.choice([6, 30, 120]), start=1000 * f)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(df, size)) == brute(rows, size)


@pytest.mark.parametrize("turns", [0, 1, 8])
def test_large_group_between_components(spark, monkeypatch, turns):
    """However much the stars have joined, the pairs between components complete it."""
    monkeypatch.setattr(nd, "TURNS", turns)
    monkeypatch.setattr(nd, "BLOCK", 6)
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for g in range(14):  # groups share most words, but too few for a link
        own = [f"g{g}_{k}" for k in range(26)]
        rows += [(100 * g + k, " ".join(shared + [w if rng.random() > 0.05 else f"y{rng.random()}" for w in own])) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(df, 2)) == brute(rows, 2)


def test_query(spark, sf):
    same(nd.op5(spark, sf), duck(sf), nd.OP5_SQL)


def test_cases(spark):
    got = nd.near_duplicates(cases.clashing(spark), 2)
    assert found(got) == brute([r[:2] for r in cases.ROWS], 2)
    kept = {r["doc_id"] for r in got.where("kept").collect()}
    assert {4, 5, 6, None} <= kept and 2 not in kept and 14 not in kept
    assert nd.near_duplicates(cases.empty(spark)).count() == 0


def test_one_of_each_stays(spark):
    docs = cases.clashing(spark)
    kept = nd.keep_one(docs, 5)
    assert kept.columns == docs.columns
    comp = {i: c for i, _, c in brute([r[:2] for r in cases.ROWS], 5)}
    wanted = [i for i in {r[0] for r in cases.ROWS if r[0] is not None} if comp[i] == i] + [None, None]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(wanted, key=repr)
    twice = nd.keep_one(docs.where("doc_id in (2, 4)"), 5)
    assert [r["doc_id"] for r in twice.orderBy("doc_id").collect()] == [2, 4]  # a repeated row stays once
    assert nd.keep_one(cases.empty(spark)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    edges = spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long")
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert {tuple(r) for r in nd.components(edges).collect()} == {(x, root(x)) for x in touched}


@pytest.mark.parametrize("cross", [False, True])
def test_blocks_link_what_is_linked(cross):
    rng = np.random.default_rng(8)
    for _ in range(20):
        base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 1 << 32, 60, dtype=np.uint32), base)) for _ in range(12)]
        comp, own = rng.integers(0, 6, 12), rng.integers(0, 2, 12)
        got = nd.block_links(comp, own, sets, cross, 80)
        j = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        want = [(a, b) for a in range(12) for b in range(a + 1, 12) if comp[a] != comp[b] and not (cross and own[a] == own[b]) and j(sets[a], sets[b]) >= 0.8]

        def parts(pairs):
            up = {int(c): int(c) for c in comp}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in pairs:
                up[find(int(comp[a]))] = find(int(comp[b]))
            return {frozenset(c for c in up if find(c) == find(d)) for d in up}

        linked = [p for p in got if j(sets[p[0]], sets[p[1]]) >= 0.8]
        assert parts(linked) == parts(want) and set(linked) <= set(want)


def test_estimate():
    rng = np.random.default_rng(2)
    for j, n in ((0.5, 3000), (0.8, 500), (0.0, 4000), (1.0, 50)):
        both = int(round(2 * n * j / (1 + j)))
        got = []
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) << np.uint64(1)
            x, y = h[:n], np.concatenate([h[:both], h[n : 2 * n - both]])
            got.append(nd.estimate(nd.registers(x)[None, : nd.KEPT], nd.registers(y)[None, : nd.KEPT], np.array([n]), np.array([n]))[0][0])
        assert abs(np.mean(got) - j) < 0.03


def test_registers_hold_zeros_and_mantissa():
    h = np.array([12345], np.uint64)  # bucket 0
    r, least = nd.registers(h), int(nd._mix(h)[0])
    zeros = 64 - least.bit_length()
    assert (r[1:] == 0).all() and r[0] >> nd.MANTISSA == zeros + 1
    assert r[0] & 1023 == (least << (zeros + 1) & (1 << 64) - 1) >> 54


@pytest.mark.parametrize("n", [12, 200, 3000])
def test_bands_agree_as_the_power_of_similarity(n):
    """Also for texts that leave most buckets empty."""
    rng = np.random.default_rng(n)
    both, agree = int(round(2 * n * 0.8 / 1.8)), []
    j = both / (2 * n - both)
    for _ in range(150):
        h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) << np.uint64(1)
        agree.append((nd.bands(nd.registers(h[:n])) == nd.bands(nd.registers(np.concatenate([h[:both], h[n : 2 * n - both]])))).mean())
    assert 0.7 * j**nd.BAND < np.mean(agree) < 1.6 * j**nd.BAND and min(agree) > 0


def test_pieces_of_long_texts(monkeypatch):
    whole = nd.text_words(cases.LONG)
    monkeypatch.setattr(nd, "_PIECE", 1000)
    assert (nd.text_words(cases.LONG) == whole).all()
    assert len(nd.text_words("x" * 5000 + " y")) == 2


def test_collisions_of_very_long_texts_hide_no_link():
    """In 32 bits a pair just below the threshold comes out above it; it must not stand for the true link beside it."""
    u = 1_000_000
    h = np.unique(np.random.default_rng(3).integers(0, 1 << 64, u + 10, dtype=np.uint64))[:u]
    h = np.random.default_rng(4).permutation(h)
    both = u * 8 // 10 - 1
    half = (u - both) // 2
    long = [h[: both + half], np.concatenate([h[:both], h[both + half :]])]
    assert 100 * both < 80 * u
    sets = [np.unique(x.astype(np.uint32)) for x in (*long, h[:500], h[:500])]
    short_both = len(np.intersect1d(sets[0], sets[1]))
    assert 100 * (short_both - 2) >= 80 * (len(sets[0]) + len(sets[1]) - short_both + 2)  # the old tolerance takes it for sure
    found = nd.block_links(np.array([1, 2, 1, 2]), np.zeros(4, int), sets, False, 80)
    assert (2, 3) in found


def test_copies_without_an_id_stay_once(spark):
    docs = cases.clashing(spark)
    nulls = docs.where("doc_id is null")
    upper = nulls.withColumn("text", F.upper("text"))  # the same shingles
    got = nd.keep_one(union(docs, nulls, nulls, upper), 5)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["text"] or "").lower() for r in got.where("doc_id is null and text is not null").collect()) == [cases.BASE]
    assert got.where("doc_id is null and text is null").count() == 4  # no text, no copy
    assert got.where("doc_id is not null").count() == nd.keep_one(docs, 5).where("doc_id is not null").count()


def test_names_that_the_stage_uses_itself(spark):
    docs = cases.docs(spark).withColumns({c: F.lit(7) for c in ("_stay", "_copy", "copy", "id", "stays", "told", "rep", "part", "member", "c2")})
    assert nd.keep_one(docs, 5).columns == docs.columns
    assert nd.keep_one(docs, 5).count() == nd.keep_one(cases.docs(spark), 5).count()


def test_ids_have_to_be_numbers(spark):
    named = cases.docs(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for use in (nd.near_duplicates, nd.keep_one):
        with pytest.raises(TypeError, match="whole numbers"):
            use(named)


def test_rows_of_one_id_with_different_texts_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "t u v w x y z"), (2, "a b c d e f g")]
    kept = nd.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("chunk", [2, 256])
def test_large_groups_around_a_hub(spark, monkeypatch, chunk):
    """A hub's group in several parts; a bucket that many bands repeat; cheap and dear comparisons."""
    monkeypatch.setattr(nd, "CHUNK", chunk)
    monkeypatch.setattr(nd, "CHEAP", 0 if chunk == 2 else 1024)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.04 else f"x{rng.random()}" for w in base)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(df, 2)) == brute(rows, 2)


def test_buckets_with_equal_members_count_once(spark):
    sets = spark.createDataFrame([(1, b"a", [1, 2, 3]), (2, b"b", [1, 2, 4]), (3, b"c", [3, 5])], "rep long, digest binary, keys array<long>")
    got = sorted(map(tuple, nd.band_members(sets).select("rep", "key").collect()))
    assert got in ([(1, k), (1, 3), (2, k), (3, 3)] for k in (1, 2))


def test_no_scratch_tables_are_left(spark):
    root = scratch_root(spark).removeprefix("file:")
    here = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = here()
    out = nd.near_duplicates(cases.docs(spark), 5)
    assert {n.split("-")[0] for n in here() - before} == {"components"} and out.count() == len(cases.ROWS)
