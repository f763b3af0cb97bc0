"""URL filters: an as-of join of captures with dated list entries.

A list is a history of entries (pattern, action, at): ``add`` lists a pattern from then on, ``remove``
ends that. Each addition becomes a validity interval up to the pattern's next entry. A pattern is
``d:`` and a domain, which covers its subdomains, ``p:`` and a host with the first part of the path, or
``u:`` and a whole URL without scheme and fragment. A capture expands to all patterns that could cover it,
and is joined with those whose interval holds its fetch time. The most specific one decides (u, p, d; then
the longest, then the first by name).

Defined results: a null url or one without a host, and a null fetch time, are covered by nothing; entries
with a null field or another action are ignored; an entry and its removal at one time leave the pattern
unlisted; repeated entries count once; captures that repeat an id, url and time are one; other columns
are never read; an empty list covers nothing, an empty table has no rows. Very long urls are read whole; blanks
around a url, case, a login, a port and dots after the host don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Bytes of intervals that may be broadcast.
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """The host in small letters; empty where there is none."""
    host = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.lower(F.regexp_replace(host, r"[\s.]+$", ""))


def rest_of(url: Column) -> Column:
    """Path and query, without the fragment."""
    return F.regexp_replace(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1), r"\s+$", "")


def patterns(host: Column, rest: Column) -> Column:
    """All patterns that could cover a URL."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    prefix = F.array(F.concat(F.lit("p:"), host, F.lit("/"), F.regexp_extract(rest, r"^/([^/?]*)", 1)))
    exact = F.array(F.concat(F.lit("u:"), host, rest))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(exact, prefix, domains))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) from (pattern, action, at); until is null while the pattern is listed."""
    valid = entries.select("pattern", "action", "at").filter("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").distinct()
    after = F.lead("at").over(Window.partitionBy("pattern").orderBy("at", "action"))
    return valid.withColumn("until", after).filter("action = 'add' AND (until IS NULL OR until > at)").select("pattern", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each capture (page_id, url, fetched_at): page_id, fetched_at, listed, pattern, since."""
    own = captures.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "fetched_at")
    keyed = own.withColumn("pattern", F.explode_outer(patterns(host_of(F.col("url")), rest_of(F.col("url")))))
    valid = materialize(intervals(entries))
    weight = valid.agg(F.sum(F.length("pattern") + 24)).first()[0] or 0
    if weight <= BROADCAST_BYTES:
        valid = F.broadcast(valid)
    holds = (F.col("k.pattern") == F.col("v.pattern")) & (F.col("k.fetched_at") >= F.col("v.since")) & (F.col("v.until").isNull() | (F.col("k.fetched_at") < F.col("v.until")))
    kind = F.substring("v.pattern", 1, 1)
    rank = F.when(kind == "u", 0).when(kind == "p", 1).otherwise(2)
    hit = F.when(F.col("v.pattern").isNotNull(), F.struct(rank.alias("rank"), (-F.length("v.pattern")).alias("size"), F.col("v.pattern").alias("pattern"), F.col("v.since").alias("since")))
    best = keyed.alias("k").join(valid.alias("v"), holds, "left").groupBy("k.page_id", "k.url", "k.fetched_at").agg(F.min(hit).alias("hit"))
    return best.select("page_id", "fetched_at", F.col("hit").isNotNull().alias("listed"), F.col("hit.pattern").alias("pattern"), F.col("hit.since").alias("since"))
