"""URL filters [native]: host-suffix and path-prefix expressions against a rule list.

Each URL is expanded into the expressions that a rule could have (every label
count of a rule's host times every length of a rule's path), each expression is
hashed, the first 4 bytes are equi-joined with those of the rules, and the whole
SHA-256 digest confirms.  Of the rules that fit a URL the one with the longest
host, then the longest path, decides; a block beats an allow of the same
expression.  Without a rule the verdict is ``allow``.

The rules are broadcast only up to ``BROADCAST_RULES`` rows, which is checked;
beyond, the join is shuffled and skewed prefixes are split by AQE.

Cases: a null URL or one without ``://`` has empty host and path and fits no
rule; repeated rows stay; empty tables give empty results; other columns of the
pages are not read, whatever their names; rules with null host or path are left
out, and equal rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of at most this number are sent to each executor (about 100 bytes each).
BROADCAST_RULES = 200_000

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/ ? #``, A-Z lower-cased; the path up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, {1} + 3)".format("_url", "locate('://', _url)"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A few (verdict, host, path) as a table, by expressions alone."""
    row = lambda r: F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("verdict", "host", "path"), strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """id, host, path, rule and verdict of each row of pages; rules has verdict, host and path."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    urls = urls.select("_id", host.alias("_host"), path.alias("_path")).withColumn("_row", F.monotonically_increasing_id())

    kept = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    kept = kept.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    digest = F.sha2(F.concat("host", "path"), 256)
    kept = kept.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"), F.length("path").alias("path_len"), F.size(F.split("host", r"\.")).alias("labels"), F.unhex(F.substring(digest, 1, 8)).alias("prefix"), F.unhex(digest).alias("digest"))
    shape = kept.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_len").alias("lens")).first()

    # Expressions of a URL: as many as the rules have label counts and path lengths, not as it has labels and characters.
    parts = F.split("_host", r"\.")
    hosts = F.array_compact(F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in sorted(shape["labels"])])) if shape["n"] else F.array().cast("array<string>")
    lens = F.array_compact(F.array(*[F.when(F.length("_path") >= n, F.lit(n)) for n in sorted(shape["lens"])])) if shape["n"] else F.array().cast("array<int>")
    expressions = urls.select("*", F.explode_outer(hosts).alias("_suffix")).select("*", F.explode_outer(lens).alias("_len"))
    expressions = expressions.withColumn("_expr", F.concat("_suffix", F.substring(F.col("_path"), F.lit(1), F.col("_len"))))
    sha = F.sha2("_expr", 256)
    expressions = expressions.select("_row", "_id", "_host", "_path", F.length("_suffix").alias("_hl"), F.unhex(F.substring(sha, 1, 8)).alias("prefix"), F.unhex(sha).alias("_digest"))

    side = F.broadcast(kept) if shape["n"] <= broadcast_rules else kept
    joined = expressions.join(side, "prefix", "left")
    # The host's length is compared too: "a.co" + "m/" and "a.com" + "/" are the same bytes.
    fits = (F.col("_digest") == F.col("digest")) & (F.col("_hl") == F.col("host_len"))
    best = F.max(F.when(fits, F.struct("host_len", "path_len", "rule", "verdict"))).alias("best")
    out = joined.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_host").alias("_host"), F.first("_path").alias("_path"), best)
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op7(spark, sf_dir: str) -> DataFrame:
    return match_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


OP7_SQL = r"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT r, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rh) DESC, length(rp) DESC) AS k
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)
"""
