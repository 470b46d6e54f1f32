"""URL filters as of the time of each fetch, in DataFrame functions only.

List entries have a scope (a domain with all below it, a host, or a host with
the start of a path), an action and a date. The entries of one pattern follow
each other, which makes them validity intervals; ``clear`` ends one without
starting another. A capture is held against the entries active when it was
fetched; the most specific one decides.

Captures are looked up by pattern and period: an interval is one row for each
period of ``DAYS`` days that it touches and that some capture lies in, so dates
far away cost nothing. A host with a third of all captures is
thereby dealt out over time, equal URLs of one time are looked up once, and a
join that is skewed still is split, as both sides are plain equality joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 64
_PERIOD = DAYS * 86_400
DOMAIN, HOST, PREFIX = "domain", "host", "prefix"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def path_of(url: Column) -> Column:
    """The path of a URL; empty if it has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def steps_of(path: Column) -> Column:
    """The parts of a path that aren't empty."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def intervals(entries: DataFrame) -> DataFrame:
    """``(scope, pattern, action, since, until)`` of entries ``scope, pattern, action, effective``.

    An entry holds until the next one of its scope and pattern (NULL: still),
    both in seconds. Of entries with one date ``block`` outdoes ``allow``, and
    that ``clear``. Entries with a NULL in any of these columns, or another
    action, count for nothing; repeated ones count once.
    """
    weight = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "clear", 0)
    rows = entries.select("scope", "pattern", "action", F.unix_seconds(F.col("effective").cast("timestamp")).alias("since"), weight.alias("weight"))
    rows = rows.dropna().groupBy("scope", "pattern", "since").agg(F.max("weight").alias("weight"))
    of_pattern = Window.partitionBy("scope", "pattern").orderBy("since")
    rows = rows.withColumn("until", F.lead("since").over(of_pattern)).filter(F.col("weight") > 0)
    return rows.select("scope", "pattern", F.when(F.col("weight") == 2, "block").otherwise("allow").alias("action"), "since", "until")


def _patterns(host: Column, steps: Column, depth: int) -> Column:
    """Array of ``(scope, pattern, rank)`` that can hold a URL; a higher rank is more specific."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit(DOMAIN).alias("scope"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i).cast("int").alias("rank")),
    )
    whole = F.array(F.struct(F.lit(HOST).alias("scope"), host.alias("pattern"), F.lit(1000).alias("rank")))
    prefixes = F.when(
        F.least(F.size(steps), F.lit(depth)) > 0,
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps), F.lit(depth))),
            lambda i: F.struct(F.lit(PREFIX).alias("scope"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("pattern"), (i + 1000).cast("int").alias("rank")),
        ),
    ).otherwise(F.array().cast("array<struct<scope:string,pattern:string,rank:int>>"))
    return F.concat(domains, whole, prefixes)


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``blocked``, ``scope`` and ``pattern``; columns of these names are replaced.

    Patterns are ``b.com`` for a domain, ``a.b.com`` for a host, and
    ``a.b.com/x/y`` for a host and whole steps of a path, hosts in lower case.
    The most specific active entry decides: the longest path, the host, the
    longest domain; ``allow`` lifts what is less specific. ``scope`` and
    ``pattern`` name the entry, NULL if none is active. Captures with a NULL
    time or without a host in their URL aren't blocked. Every row is kept,
    repeats included; empty tables are no special case.
    """
    columns = [c for c in captures.columns if c not in ("blocked", "scope", "pattern")]
    active = intervals(entries)
    depth = active.filter(F.col("scope") == PREFIX).agg(F.max(F.size(F.split("pattern", "/")) - 1).alias("d")).first()["d"] or 0
    seconds = F.unix_seconds(F.col(time_col).cast("timestamp"))
    asked = captures.select(F.col(url_col).alias("__url"), seconds.alias("__at")).distinct()
    asked = asked.filter(F.col("__at").isNotNull()).withColumn("__host", host_of(F.col("__url"))).filter(F.col("__host") != "")
    # periods in which there are captures: as many as the calendar has at most, which is 57,000 for years 1 to 9999
    of_capture = F.floor(F.col("__at") / _PERIOD)
    there = sorted(r["p"] for r in asked.select(of_capture.alias("p")).distinct().collect())
    touched = F.col("p") >= F.floor(F.col("since") / _PERIOD), F.col("until").isNull() | (F.col("p") <= F.floor((F.col("until") - 1) / _PERIOD))
    listed = active.withColumn("p", F.explode(F.lit(there).cast("array<bigint>"))).filter(touched[0] & touched[1]).withColumnRenamed("p", "period")
    listed = listed.withColumnsRenamed({"scope": "__scope", "pattern": "__pattern"})
    looked = asked.select("__url", "__at", F.explode(_patterns(F.col("__host"), steps_of(path_of(F.col("__url"))), depth)).alias("p"))
    looked = looked.select("__url", "__at", F.col("p.scope").alias("scope"), F.col("p.pattern").alias("pattern"), F.col("p.rank").alias("rank"), F.floor(F.col("__at") / _PERIOD).alias("__period"))
    held = looked.join(
        listed,
        (F.col("scope") == F.col("__scope")) & (F.col("pattern") == F.col("__pattern")) & (F.col("__period") == F.col("period"))
        & (F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))),
    )
    decided = held.groupBy("__url", "__at").agg(F.max(F.struct("rank", "action", "scope", "pattern")).alias("best"))
    decided = decided.withColumnsRenamed({"__url": "__u", "__at": "__t"})
    return captures.join(decided, (F.col(url_col) == F.col("__u")) & (seconds == F.col("__t")), "left").select(
        *columns, F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), F.col("best.scope").alias("scope"), F.col("best.pattern").alias("pattern")
    )
