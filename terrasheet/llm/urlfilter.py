"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Native: DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of query op6: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark, rules=RULES) -> DataFrame:
    """A small literal rule list as a frame; larger ones come from a table with the same columns."""
    quoted = ["('" + "','".join(x.replace("\\", "\\\\").replace("'", "\\'") for x in r) + "')" for r in rules]
    if not quoted:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {','.join(quoted)} AS t(verdict, host, path)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    there = url.isNotNull() & (at > 0)
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def _directory(path: Column) -> Column:
    """The part of a rule's path up to its last slash: every url path that starts with the rule's has it as a prefix."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct value of `url_col`, null included.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's. The longest rule (host and path together) wins; of equally long
    ones that with the longer host, then `block`. No rule: `default`, rule null.
    A null url or one without `://` has empty host and path, which only a rule
    with an empty host and path would fit.

    Each url is expanded to its host suffixes times its path prefixes that end
    in a slash, none longer than the longest rule needs, so that a long url adds
    no more rows than the rules can use. The expansion joins the rules on 32 bits
    of a SHA-256; the full digest and the rule's exact path are compared after
    it. Rules that are repeated count once. Rule hosts are compared in lower case.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), _directory(F.col("r_path")))).withColumn("r_short", _short(F.col("r_digest")))
    most = rules.agg(F.coalesce(F.max(F.length("r_host")), F.lit(0)).alias("host_most"), F.coalesce(F.max(F.length(_directory(F.col("r_path")))), F.lit(0)).alias("path_most")).first()

    each = urls.select(F.col(url_col).alias("url")).distinct()
    host, path = host_and_path(F.col("url"))
    each = each.select("url", host.alias("host"), path.alias("path"))
    # suffixes from the right; those longer than any rule's host can't be one
    tail = F.substring(F.concat(F.lit("."), F.col("host")), -(most["host_most"] + 1), most["host_most"] + 1)
    parts = F.split(tail, r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = F.when(F.size(parts) >= 2, suffixes).otherwise(F.array("host"))
    head = F.substring("path", 1, most["path_most"])
    cuts = F.split(head, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(cuts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(cuts, 1, i), "/"), F.lit("/"))))
    expanded = (
        each.withColumn("_suffix", F.explode(hosts))
        .withColumn("_prefix", F.explode(prefixes))
        .withColumn("_digest", _digest(F.col("_suffix"), F.col("_prefix")))
        .withColumn("_short", _short(F.col("_digest")))
    )
    hits = expanded.join(rules, F.col("_short") == F.col("r_short")).where((F.col("_digest") == F.col("r_digest")) & F.startswith("path", "r_path"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").cast("int").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy(F.col("url").alias("b_url")).agg(F.max(rank).alias("best"))
    return (
        each.join(best, F.col("url").eqNullSafe(F.col("b_url")), "left")
        .select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def filter_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of `pages` with host, path, rule and verdict of its url; repeated rows stay."""
    judged = judge_urls(pages, rules, url_col, default).withColumnRenamed("url", "_url")
    slim = pages.select(F.col(id_col), F.col(url_col).alias("_u"))
    return slim.join(judged, F.col("_u").eqNullSafe(F.col("_url")), "left").select(id_col, "host", "path", "rule", "verdict")
