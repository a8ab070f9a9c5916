import random

import pytest

from tests.compare import duck, same
from tests.llm import cases
from tidelog.llm.urls import OP7_SQL, RULES, match_rules, op7


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return host, rest[:end]


def brute(rows, rules):
    out = []
    for i, url in rows:
        host, path = split(url)
        fit = [(len(h), len(p), v == "block", h + p, v) for v, h, p in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((i, host, path, best[3] if best else None, best[4] if best else "allow"))
    return sorted(out, key=repr)


def frame(spark, rules):
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def test_query(spark, sf):
    same(op7(spark, sf), duck(sf), OP7_SQL)


def test_native(spark, sf):
    plan = op7(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("most", [200_000, 0])
def test_cases(spark, most):
    """With rules sent to all executors, and joined by a shuffle."""
    rules = [*RULES, ("block", "com", "/"), ("block", None, "/"), ("allow", "net", "/es/"), ("block", "x.net", "")]
    from pyspark.sql import functions as F

    pages = cases.pages(spark).withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "prefix", "digest", "labels")})
    assert cases.rows(match_rules(pages, frame(spark, rules), broadcast_rules=most)) == brute([r[:2] for r in cases.PAGE_ROWS], rules)


def test_random_urls(spark):
    rng = random.Random(4)
    labels, paths = ["com", "net", "a", "b", "a.com", "www"], ["", "/", "/a", "/a/", "/a/b", "/b?x", "#f"]
    urls = [(k, "s://" + ".".join(rng.choices(labels, k=rng.randrange(1, 4))) + rng.choice(paths)) for k in range(200)]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randrange(1, 3))), rng.choice(["", "/", "/a", "/a/"])) for _ in range(25)]
    got = match_rules(spark.createDataFrame(urls, "page_id long, url string"), frame(spark, rules))
    assert cases.rows(got) == brute(urls, rules)


def test_empty(spark):
    none = cases.pages(spark).limit(0)
    assert match_rules(none, frame(spark, RULES)).count() == 0
    free = match_rules(cases.pages(spark), frame(spark, []))
    assert {r["verdict"] for r in free.collect()} == {"allow"} and free.count() == len(cases.PAGE_ROWS)
