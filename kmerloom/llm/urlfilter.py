"""URL filters with a dated list: entries become validity intervals, captures are judged as of their fetch time.

A list entry says from a moment on that a key (a host, a parent domain, or a host with a path
prefix) is blocked or allowed again. The entries of a key become disjoint intervals, each up to the
key's next entry. A capture is looked up under all keys of its URL; at most one interval of each key
holds its fetch time, and of the keys found the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket that intervals and captures are dealt by.
BUCKET = 30 * 86400
END = 1 << 40


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column, labels: list[int] | None = None, segments: list[int] | None = None) -> Column:
    """Array of (rank, key), the most specific key with the largest rank; only keys of the given numbers of labels and of path segments, all without them."""
    names = F.split(host(url), r"\.")
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")

    def lengths(most: Column, wanted: list[int] | None) -> Column:
        if wanted is None:
            return F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.array(*map(F.lit, wanted)).cast("array<int>"), lambda i: i <= most)

    domains = F.transform(lengths(F.size(names), labels), lambda i: F.struct(i.alias("rank"), F.array_join(F.slice(names, -i, i), ".").alias("key")))
    prefixes = F.transform(lengths(F.size(parts), segments), lambda i: F.struct((i + F.size(names)).alias("rank"), F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key")))
    none = F.array().cast("array<struct<rank:int,key:string>>")
    return F.when(F.length(host(url)) > 0, F.concat(domains, prefixes)).otherwise(none)


def _listed(entries: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels of the list's domains and of segments of its path prefixes; a few numbers, whatever the list's size."""
    slashes = F.size(F.split("key", "/")) - 1
    found = entries.where("key is not null").agg(
        F.collect_set(F.when(slashes == 0, F.size(F.split("key", r"\.")))).alias("labels"), F.collect_set(F.when(slashes > 0, slashes)).alias("segments")
    ).first()
    return sorted(found["labels"]), sorted(found["segments"])


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(key, since, blocked)`` (seconds) -> ``(key, since, until, blocked)``, disjoint for each key.

    Of entries of one key and moment a blocking one wins. Entries without key, moment or verdict are ignored.
    """
    one = entries.where("key is not null and since is not null and blocked is not null").groupBy("key", "since").agg(F.max("blocked").alias("blocked"))
    nexts = Window.partitionBy("key").orderBy("since")
    return one.select("key", "since", F.coalesce(F.lead("since").over(nexts), F.lit(END)).alias("until"), "blocked")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(id, url, at)`` (at in seconds) -> ``(id, url, at, key, since, blocked)``, one row per capture.

    blocked is false and key null where no entry was active, or url or time is null. Repeated
    rows stay repeated rows. A key that a third of the captures share is a skewed join whose other side
    has one row per key and bucket at most for each entry, so it can be split freely.
    """
    held = captures.select("id", "url", "at")
    asked = held.where("at is not null and url is not null").distinct().select("url", "at", F.inline(keys(F.col("url"), *_listed(entries)))).distinct()
    asked = asked.withColumn("bucket", F.expr(f"floor(at / {BUCKET})"))
    seen = captures.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, high = (seen["low"] or 0), (seen["high"] or 0)
    # intervals are cut to the captures' span before they are dealt to buckets
    near = intervals(entries).where((F.col("since") <= high) & (F.col("until") > low))
    spans = F.sequence(F.floor(F.greatest(F.col("since"), F.lit(low)) / BUCKET), F.floor(F.least(F.col("until") - 1, F.lit(high)) / BUCKET))
    dealt = near.select("key", "since", "until", "blocked", F.explode(spans).alias("bucket"))
    met = asked.join(dealt, ["key", "bucket"]).where("since <= at and at < until")
    best = met.groupBy("url", "at").agg(F.max(F.struct("rank", "key", "since", "blocked")).alias("best")).select(F.col("url").alias("b_url"), F.col("at").alias("b_at"), "best")
    out = held.join(best, (held.url == best.b_url) & (held["at"] == best.b_at), "left")
    return out.select("id", "url", "at", F.col("best.key").alias("key"), F.col("best.since").alias("since"), F.coalesce("best.blocked", F.lit(False)).alias("blocked"))


def _number(text: Column, salt: str, modulus: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt)).cast("binary")), 1, 7), 16, 10).cast("long") % modulus


#: The list and the fetch times of the query are derived from the pages: the span of both in seconds.
SPAN = 365 * 86400


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"), "url", _number(F.col("page_id").cast("string"), "fetch", SPAN).alias("at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Every host of the pages, and its parent domain, is listed up to three times, alternately blocked and allowed."""
    hosts = pages.select(host(F.col("url")).alias("h")).where("h <> ''").distinct()
    parents = hosts.select(F.regexp_replace("h", r"^[^.]*\.", "").alias("h"))
    named = hosts.union(parents).distinct()
    out = None
    for n in range(3):
        part = named.where(_number(F.col("h"), f"use{n}", 4) == 0).select(F.col("h").alias("key"), _number(F.col("h"), f"since{n}", SPAN).alias("since"), F.lit(n != 1).alias("blocked"))
        out = part if out is None else out.union(part)
    return out


def query(pages: DataFrame) -> DataFrame:
    """since is -1 where no entry was active."""
    out = judged(derived_captures(pages), derived_entries(pages))
    return out.select(F.col("id").alias("page_id"), F.col("at").alias("fetched"), F.col("key").alias("matched"), F.coalesce("since", F.lit(-1)).alias("since"), F.col("blocked").cast("int").alias("blocked"))


SQL = r"""
WITH named AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p,
    ('0x' || substr(md5(CAST(page_id AS VARCHAR) || 'fetch'), 1, 7))::BIGINT % 31536000 AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT h FROM named WHERE h <> ''),
listed AS (SELECT h FROM hosts UNION SELECT regexp_replace(h, '^[^.]*\.', '') FROM hosts),
entries AS (
  SELECT h AS key, ('0x' || substr(md5(h || 'since' || n), 1, 7))::BIGINT % 31536000 AS since, n <> '1' AS blocked
  FROM listed, (VALUES ('0'), ('1'), ('2')) AS t(n)
  WHERE ('0x' || substr(md5(h || 'use' || n), 1, 7))::BIGINT % 4 = 0),
one AS (SELECT key, since, bool_or(blocked) AS blocked FROM entries GROUP BY key, since),
spans AS (SELECT key, since, lead(since, 1, 1099511627776) OVER (PARTITION BY key ORDER BY since) AS until, blocked FROM one),
parts AS (
  SELECT *, string_split(h, '.') AS labels, list_filter(string_split(p, '/'), lambda x: x <> '') AS segments FROM named),
asked AS (
  SELECT page_id, fetched, i AS rank, array_to_string(labels[-i:], '.') AS key FROM parts, range(1, 9) AS r(i) WHERE h <> '' AND i <= len(labels)
  UNION ALL
  SELECT page_id, fetched, i + 8, h || '/' || array_to_string(segments[1:i], '/') FROM parts, range(1, 4) AS r(i) WHERE h <> '' AND i <= len(segments)),
best AS (
  SELECT page_id, fetched, max(struct_pack(rank := rank, key := a.key, since := since, blocked := blocked)) AS b
  FROM asked a JOIN spans s ON a.key = s.key AND s.since <= a.fetched AND a.fetched < s.until GROUP BY page_id, fetched)
SELECT n.page_id, n.fetched, b.key AS matched, coalesce(b.since, -1) AS since, CAST(coalesce(b.blocked, FALSE) AS INTEGER) AS blocked
FROM named n LEFT JOIN best USING (page_id, fetched)
"""
