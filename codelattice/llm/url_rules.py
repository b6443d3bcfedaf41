"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Every rule is an expression ``host + path``. It fits a URL whose host is the rule's or one below it and
whose path starts with the rule's path. Rules are kept as full SHA-256 digests bucketed by the first
eight hex digits, the way a blocklist is shipped. A URL is expanded into its host suffixes and path
prefixes, but only in the shapes that some rule has (labels of the host, slashes of the path, characters
after the last slash): no other expression can be a rule. The expansions meet the buckets by an equi-join
on the short prefix, full digests confirm a hit, and the longest rule (host and path together, then the
longer host) wins. Everything is DataFrame functions; there is no Python on the way.

Before anything is expanded a URL is reduced to the part that can matter, the last labels of its host and
the first characters of its path, as many as the longest rules have. There are far fewer of these probes than
URLs, they are distinct (combined in the task before the shuffle), and what is joined back has one row per
probe, so a host or URL that holds a third of all rows is only ever the many side of a join with a unique
key, which Spark's skew handling splits. Nothing is broadcast by force. The driver reads the distinct
shapes of the rules (at most labels x slashes x tail lengths, some hundreds for real lists) and two lengths.

Defined results. Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; user names
and ports stay part of it. Path: from there to ``?``, ``#`` or the end. Null URLs and those without ``://`` have
an empty host and path. Rule hosts are lower-cased; a null path counts as empty, rules with a null host or
another verdict than ``allow`` and ``block`` are ignored. Of equal rules with both verdicts ``block`` wins.
A URL that no rule fits gets ``default``. Repeated rows and keys are judged once per row. Empty tables give no
rows, an empty rule table the default. Extra columns are ignored by ``judge`` and kept by ``reject``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host: string, path: string, verdict: string"


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _rest(url: str) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.col(url).substr(at + 3, F.length(F.col(url)))).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    return _lower(F.substring_index(F.translate(_rest(url), "?#", "//"), "/", 1))


def path_of(url: str) -> Column:
    after = _rest(url).substr(F.length(host_of(url)) + 1, F.length(F.col(url)))
    return F.coalesce(F.substring_index(F.translate(after, "#", "?"), "?", 1), F.lit(""))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, verdict, labels, slashes, tail, digest) of the distinct rules."""
    plain = rules.where("host is not null and verdict in ('allow', 'block')").select(
        _lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    one = plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return one.select(
        "host", "path", "verdict", _labels(F.col("host")).alias("labels"), _slashes(F.col("path")).alias("slashes"),
        F.length(F.substring_index(F.col("path"), "/", -1)).alias("tail"),
        F.sha2(F.concat("host", "path"), 256).alias("digest"),
    )


def _expressions(shapes: list) -> Column:
    """Structs (host, path) of a probe in every shape that it has."""
    shape = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["slashes"]).alias("slashes"), F.lit(s["tail"]).alias("tail")) for s in shapes])

    def cut(s: Column) -> Column:
        base = F.call_function("substring_index", F.col("probe_path"), F.lit("/"), s["slashes"])
        base = F.when(s["slashes"] > 0, F.concat(base, F.lit("/"))).otherwise(F.lit(""))
        return F.struct(
            F.call_function("substring_index", F.col("probe_host"), F.lit("."), -s["labels"]).alias("host"),
            F.substring(F.col("probe_path"), F.lit(1), F.length(base) + s["tail"]).alias("path"),
            (F.length(base) + s["tail"]).alias("wanted"),
        )

    has = F.filter(shape, lambda s: (s["labels"] <= _labels(F.col("probe_host"))) & (s["slashes"] <= _slashes(F.col("probe_path"))))
    return F.filter(F.transform(has, cut), lambda x: F.length(x["path"]) == x["wanted"])


def _judged(pages: DataFrame, rules: DataFrame, url: str, carried: Column, default: str) -> DataFrame:
    """(carried, host, path, rule, verdict) of every row."""
    spark = pages.sparkSession
    table = rule_table(rules)
    shapes = table.select("labels", "slashes", "tail").distinct().orderBy("labels", "slashes", "tail").collect()
    parts = pages.select(carried.alias("carried"), F.col(url).cast("string").alias("url"))
    parts = parts.select("carried", host_of("url").alias("host"), path_of("url").alias("path"))
    if not shapes:
        return parts.select("carried", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    longest = table.agg(F.max(F.length("path")).alias("path")).first()["path"]
    labels = max(s["labels"] for s in shapes)
    parts = parts.withColumn("probe_host", F.substring_index(F.col("host"), ".", -labels)).withColumn("probe_path", F.substring(F.col("path"), 1, longest))
    probes = parts.select("probe_host", "probe_path").distinct()
    each = probes.select("probe_host", "probe_path", F.explode(_expressions(shapes)).alias("x"))
    each = each.select("probe_host", "probe_path", F.sha2(F.concat("x.host", "x.path"), 256).alias("full")).withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    entry = F.struct("digest", (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    buckets = table.groupBy(F.substring("digest", 1, PREFIX_DIGITS).alias("prefix")).agg(F.collect_list(entry).alias("bucket"))
    hits = each.join(buckets, "prefix").withColumn("hit", F.explode(F.filter("bucket", lambda r: r["digest"] == F.col("full"))))
    best = hits.groupBy("probe_host", "probe_path").agg(F.max(F.struct("hit.size", "hit.host_size", "hit.rule", "hit.verdict")).alias("best"))
    return parts.join(best, ["probe_host", "probe_path"], "left").select(
        "carried", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict): the winning rule of every URL as ``host + path``, null where none fits."""
    found = _judged(pages, rules, url, F.col(key), default)
    return found.select(F.col("carried").alias(key), "host", "path", "rule", "verdict")


def reject(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Rows whose URL is allowed, all columns unchanged."""
    found = _judged(pages, rules, url, F.struct("*"), default).where("verdict = 'allow'")
    return found.select(*(F.col("carried")[c].alias(c) for c in pages.columns))


def rules_of(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path) triples."""
    entries = [F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for verdict, host, path in rows]
    return spark.range(1).select(F.inline(F.array(*entries).cast(f"array<struct<{RULE_SCHEMA}>>")))


def brute_force(urls: list[str | None], rules: list[tuple[str, str, str]], default: str = "allow") -> list[tuple]:
    """(host, path, rule, verdict) of a few URLs by trying every rule (for tests)."""
    out = []
    for url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            stop = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop]), rest[stop:]
            path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((host, path, *(max(fits)[2:] if fits else (None, default))))
    return out
