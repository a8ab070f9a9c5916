import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm import licenses as lic
from tidelog.llm.license_texts import TEMPLATES, whole_licenses
from tidelog.llm.licenses import Scanner, miss_bound, op9, scan_licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def shingles(t):
    w = words(t)
    n = min(5, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []


def brute(text, templates=TEMPLATES):
    """Names of templates of which a stretch of twice their words holds enough, without a search by bands."""
    s, out = shingles(text), set()
    for name, template in templates.items():
        own = set(shingles(template))
        if not own:
            continue
        span, need = 2 * len(words(template)), 0.8 * len(own)
        at = [i for i, x in enumerate(s) if x in own]
        if any(len({s[j] for j in at if i <= j < i + span}) >= need - 1e-9 for i in at):
            out.add(name)
    return out


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES)


def noise(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_whole_templates_are_found_in_place(scanner, name):
    rng = random.Random(name)
    before, after = noise(rng, rng.randrange(300)), noise(rng, 200)
    text = f"{before}\n * {TEMPLATES[name].upper() if rng.random() < 0.5 else TEMPLATES[name]}\n{after}"
    got = scanner.scan(text)
    assert [g[0] for g in got] == [name] and got[0][1] == 1.0
    found = text.encode()[got[0][2] : got[0][3]].decode()
    assert words(found) == words(TEMPLATES[name])


def test_edited_templates(scanner):
    rng = random.Random(1)
    hits = total = 0
    for name in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause"):
        for _ in range(20):
            w = TEMPLATES[name].split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "edited"
            text = f"{noise(rng, 100)} {' '.join(w)} {noise(rng, 50)}"
            wanted = brute(text)
            total += name in wanted
            hits += name in {g[0] for g in scanner.scan(text)} and name in wanted
    assert total > 50 and hits == total


def test_repeats_and_the_longest_wins(scanner):
    text = f"{TEMPLATES['Apache-2.0']} x y z {TEMPLATES['MIT-notice']} {TEMPLATES['MIT-notice']} {TEMPLATES['GPL-2.0']}"
    assert [g[0] for g in scanner.scan(text)] == ["Apache-2.0", "MIT-notice", "MIT-notice", "GPL-2.0"]


def test_clean_text(scanner):
    rng = random.Random(2)
    for text in (None, "", "   ", noise(rng, 5000), "the license", "software provided as is"):
        assert scanner.scan(text) == []


def test_guarantee():
    assert miss_bound(0.25) < 2e-8
    for c in lic.CLASSES:
        least = lic.CLASSES[lic.CLASSES.index(c) - 1] if c > 8 else 4
        shortest = Scanner.holds(least) + 1 if c > 8 else 5
        assert (shortest - 4) / (c - 4) >= 0.25


def test_bands_of_several_rows():
    one = Scanner({"t": TEMPLATES["MIT"]}, bands=32, rows=2)
    assert [g[0] for g in one.scan(f"a b c {TEMPLATES['MIT']} d")] == ["t"]


def test_minhash():
    v = np.arange(100, dtype=np.uint64) * np.uint64(7919)
    seeds = lic._seeds(4)
    got = lic.minhash(v, np.arange(0, 90, 3), 11, seeds)
    for k, s in enumerate(seeds):
        h = lic._mix(v * s)
        assert [int(x) for x in got[:, k]] == [int(h[a : a + 11].min()) for a in range(0, 90, 3)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9(spark, sf).collect()
    assert len(got) == len(texts) and sum(r["n_matches"] for r in got) > 10
    for r in got:
        found, wanted = set(filter(None, r["licenses"].split(","))), brute(texts[r["doc_id"]])
        assert found <= wanted and bool(found) == bool(wanted)
        for span in r["spans"].split():
            name, a, b = re.fullmatch(r"(.+):(\d+)-(\d+)", span).groups()
            piece = texts[r["doc_id"]].encode()[int(a) : int(b)].decode()
            assert name in brute(piece)


def test_cases(spark):
    docs = cases.clashing(spark).withColumn("text", F.when(F.col("doc_id") == 9, F.lit(TEMPLATES["MIT"])).otherwise(F.col("text")))
    got = {r["doc_id"]: r["matches"] for r in scan_licenses(docs).collect()}
    assert [m["name"] for m in got[9]] == ["MIT"] and got[4] == got[5] == got[7] == []
    assert scan_licenses(docs).count() == len(cases.ROWS)
    short = scan_licenses(cases.docs(spark), {"short": "Brown FOX", "none": "  ", "same": "brown fox"}).collect()
    assert not any(r["matches"] for r in short)
    assert scan_licenses(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(cases.docs(spark), {"x": "y" * (lic.TEMPLATE_BYTES + 1)})


def test_short_templates_are_found_in_long_texts():
    rng = random.Random(5)
    known = {"mit": "MIT License", "mit-the": "The MIT License", "one": "Unlicense", "same": "mit license", "long": TEMPLATES["MIT"]}
    scanner = Scanner(known)
    text = f"{noise(rng, 40)} the MIT-License. {noise(rng, 3)}, mit  license; unlicense {noise(rng, 20)}"
    got = scanner.scan(text)
    assert [(n, c, " ".join(words(text.encode()[a:b].decode()))) for n, c, a, b in got] == [("mit-the", 1.0, "the mit license"), ("mit", 1.0, "mit license"), ("one", 1.0, "unlicense")]
    assert [g[0] for g in scanner.scan("MIT License")] == ["mit"] and scanner.scan("MIT") == scanner.scan("the license of mit") == []
    # What stands in a longer template's match is part of it.
    inner = Scanner({"long": TEMPLATES["MIT"], "inner": " ".join(words(TEMPLATES["MIT"])[20:23])})
    assert [g[0] for g in inner.scan(f"x {TEMPLATES['MIT']} y")] == ["long"]


def test_whole_license_files():
    scanner = Scanner(TEMPLATES | whole_licenses())
    rng = random.Random(2)
    for name, text in whole_licenses().items():
        got = scanner.scan(f"{noise(rng, 100)}\n{text}\n{noise(rng, 100)}")
        assert name in {g[0] for g in got} and max(got, key=lambda g: g[3] - g[2])[0] == name
        lines = text.splitlines()
        assert name in {g[0] for g in scanner.scan("\n".join(f"# {x}" for x in lines))}
    assert scanner.scan(noise(rng, 3000)) == []


def test_edits_down_to_the_threshold(scanner):
    """Words put in until hardly enough shingles are left: what a search without bands finds is found."""
    rng = random.Random(9)
    wanted = found = 0
    for name, template in TEMPLATES.items():
        w = words(template)
        if len(w) < 20:
            continue
        for _ in range(12):
            edited = list(w)
            for _ in range(max(1, int(len(w) * 0.2 / 5))):
                edited.insert(rng.randrange(len(edited)), f"zz{rng.randrange(99)}")
            text = " ".join(edited)
            if name in brute(text, {name: template}):
                wanted += 1
                found += name in {g[0] for g in scanner.scan(text)}
    assert wanted > 60 and found == wanted
