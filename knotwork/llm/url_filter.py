"""URL filters: which list entry held when a page was fetched.

A list is dated events: from its day on, an entry blocks or allows a key, or clears
it. Events become validity intervals [day, next day of the same key). A capture asks
for its keys (host with first path segment, host, parent domains); an as-of join finds
the interval of each key that was active on the fetch day, and the most specific key
decides. Catalyst operators only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of events for one key on one day the first of these holds.
ACTIONS = ("block", "allow", "clear")
ENDLESS = 2**31 - 1


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none. An IPv6 address keeps its brackets."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def keys_of(url: Column) -> Column:
    """The keys of a URL, the most specific first: host/segment, host, parents of two labels or more; addresses have no parents."""
    host = host_of(url)
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels) - 1, F.lit(2))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    address = host.rlike(r"^(\d+(\.\d+){3}|\[.*)$")
    some = F.when((F.size(labels) > 2) & ~address, parents).otherwise(F.array().cast("array<string>"))
    path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(path, F.array(host), some)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, since, until (days; until exclusive) from events key, day, action.

    Events with a null key or day, or an unknown action, take no part. Of several for
    a key and day the first in ACTIONS holds; so a key has one event a day at most,
    and the window over a key stays small however often an entry is repeated.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    daily = (
        entries.filter(F.col("key").isNotNull() & F.col("day").isNotNull() & (rank > 0))
        .groupBy("key", "day").agg(F.min(rank).alias("rank"))
    )
    until = F.coalesce(F.lead("day").over(Window.partitionBy("key").orderBy("day")), F.lit(ENDLESS))
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank").cast("int"))
    out = daily.select("key", action.alias("action"), F.col("day").cast("int").alias("since"), until.cast("int").alias("until"))
    return out.filter(F.col("action") != "clear")


def filter_urls(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """One row per row of captures (id, url, fetch_day): id, url, fetch_day, verdict, list_key, since.

    verdict is the action of the most specific key that had an active entry, and
    "allow" with null list_key where none had: also for a null or malformed URL or a
    null fetch day. A URL has one key of each kind, the most specific that is listed
    decides, so there are no ties. Repeated captures each give a row, those without id
    too; a URL of any length is one row with a key for each of its labels. Without
    entries every capture is allowed, and without captures the result is empty; other
    columns are ignored.
    """
    rows = captures.select(F.col(id_column).alias("id"), "url", F.col("fetch_day").cast("int").alias("fetch_day"))
    keyed = rows.select("id", "url", "fetch_day", F.posexplode_outer(keys_of(F.col("url"))).alias("at", "__key"))
    active = (F.col("__key") == F.col("key")) & (F.col("since") <= F.col("fetch_day")) & (F.col("fetch_day") < F.col("until"))
    joined = keyed.join(intervals(entries), active, "left")
    best = F.min(F.when(F.col("key").isNotNull(), F.struct("at", "key", "action", "since"))).alias("best")
    many = F.count(F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, 1)).alias("n")
    decided = joined.groupBy("id", "url", "fetch_day").agg(best, many)
    return decided.select(
        F.col("id").alias(id_column), "url", "fetch_day",
        F.coalesce(F.col("best.action"), F.lit("allow")).alias("verdict"),
        F.col("best.key").alias("list_key"), F.col("best.since").alias("since"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("__n"),
    ).drop("__n")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dated_captures(pages: DataFrame, days: int = 365) -> DataFrame:
    """page_id, url, fetch_day: the tables hold no dates, so a digest of the id gives the day."""
    return pages.select("page_id", "url", F.pmod(_number(F.concat(F.lit("fetch"), F.col("page_id").cast("string"))), F.lit(days)).cast("int").alias("fetch_day"))


def derived_entries(pages: DataFrame, days: int = 365) -> DataFrame:
    """key, day, action: a list over the keys of the pages, made from digests of the keys.

    Every third key enters the list on some day, to be blocked or (one in four)
    allowed; half of these are cleared later, and half of those blocked again.
    """
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct()
    n = _number(F.col("key"))
    first = F.pmod(n, F.lit(days)).cast("int")
    gap = (F.pmod(n, F.lit(97)) + 1).cast("int")
    listed = keys.filter(F.pmod(n, F.lit(3)) == 0)
    event = lambda day, action: F.struct(day.cast("int").alias("day"), action.alias("action"))
    enters = event(first, F.when(F.pmod(n, F.lit(4)) == 0, F.lit("allow")).otherwise(F.lit("block")))
    events = F.when(F.pmod(n, F.lit(2)) == 0, F.array(enters)).otherwise(
        F.when(F.pmod(n, F.lit(5)) < 2, F.array(enters, event(first + gap, F.lit("clear"))))
        .otherwise(F.array(enters, event(first + gap, F.lit("clear")), event(first + gap * 2, F.lit("block"))))
    )
    return listed.select("key", F.explode(events).alias("e")).select("key", "e.day", "e.action")


#: The hosts of the table pages are names; this SQL does not tell addresses apart.
ORACLE = """
WITH hosts AS (
  SELECT page_id, url, CAST(CAST('0x' || substr(md5('fetch' || CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 365 AS INTEGER) AS fetch_day,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '\\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg,
    row_number() OVER () AS rid
  FROM pages),
keyed AS (
  SELECT rid, 0 AS lvl, host || '/' || seg AS key FROM hosts WHERE host <> '' AND seg <> ''
  UNION ALL SELECT rid, 1, host FROM hosts WHERE host <> ''
  UNION ALL
  SELECT rid, 1 + i, array_to_string(list_slice(string_split(host, '.'), i + 1, len(string_split(host, '.'))), '.')
  FROM (SELECT rid, host, unnest(range(1, len(string_split(host, '.')) - 1)) AS i FROM hosts WHERE len(string_split(host, '.')) > 2)),
keys AS (SELECT key, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS n FROM (SELECT DISTINCT key FROM keyed)),
events AS (
  SELECT key, n % 365 AS day, CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END AS action FROM keys WHERE n % 3 = 0
  UNION ALL SELECT key, n % 365 + n % 97 + 1, 'clear' FROM keys WHERE n % 3 = 0 AND n % 2 = 1
  UNION ALL SELECT key, n % 365 + 2 * (n % 97 + 1), 'block' FROM keys WHERE n % 3 = 0 AND n % 2 = 1 AND n % 5 >= 2),
spans AS (SELECT key, action, day AS since, lead(day, 1, 2147483647) OVER (PARTITION BY key ORDER BY day) AS until FROM events),
hits AS (
  SELECT k.rid, k.lvl, s.key, s.action, s.since FROM keyed k JOIN hosts h ON k.rid = h.rid
  JOIN spans s ON s.key = k.key AND s.since <= h.fetch_day AND h.fetch_day < s.until AND s.action <> 'clear'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS r FROM hits) WHERE r = 1)
SELECT h.page_id, h.url, h.fetch_day, coalesce(b.action, 'allow') AS verdict, b.key AS list_key, CAST(b.since AS INTEGER) AS since
FROM hosts h LEFT JOIN best b ON h.rid = b.rid
"""
