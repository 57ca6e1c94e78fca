"""URL filters by a temporal list join.

A list is a table of dated entries (kind, value, since, action): `add` puts a host, a registered domain with all its
subdomains, or a path prefix on the list from that day on, `remove` takes it off. Entries become validity intervals
[since, until); a capture is blocked if, on the day of its fetch, an entry is active for any of its keys. The keys of a
capture are its host, its domains and its path prefixes, of as many labels and segments as the longest that is listed.
Hosts are compared in lower case and without a final dot, paths as they are.

Captures are first reduced to distinct (key, day) pairs, so a hot host reaches the join as at most one row a day and
task. The list is joined as any other table; Spark broadcasts it when its size is under the session's limit.

Nulls and odd inputs: a null or unparsable url has no key and isn't blocked; a null day matches no interval; entries
with a null value, day or action are dropped; of entries with equal value and day, `remove` wins; an entry added twice
stays active until it is removed; equal rows get equal results; an empty list blocks nothing; other columns are kept,
and those with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.frames import let

#: Groups: the host (an IPv6 address with its brackets), and the path.
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#@:\[]+)(?::\d*)?((?:/[^?#]*)?)"

#: A list for use without one of one's own: kind, value, since, action.
ENTRIES: tuple[tuple[str, str, str, str], ...] = (
    ("domain", "spam-farm.example.org", "2024-01-01", "add"),
    ("domain", "spam-farm.example.org", "2024-09-01", "remove"),
    ("domain", "casino-win.example.net", "2024-02-15", "add"),
    ("host", "blog.ththan.example.net", "2024-03-01", "add"),
    ("host", "blog.ththan.example.net", "2024-06-01", "remove"),
    ("host", "blog.ththan.example.net", "2024-10-01", "add"),
    ("host", "m.ththth.example.net", "2024-07-01", "add"),
    ("prefix", "ththre.example.com/fr", "2024-05-01", "add"),
    ("prefix", "therin.example.net/en", "2024-04-01", "add"),
    ("prefix", "therin.example.net/en", "2024-08-01", "remove"),
)


def default_entries(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', '{v}', date'{d}', '{a}')" for k, v, d, a in ENTRIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, value, since, action)")


def listed(kind: Column, value: Column) -> Column:
    """An entry's value as the keys have it: hosts in lower case without a final dot, paths as they are without empty segments."""
    host = F.regexp_replace(F.lower(F.substring_index(value, "/", 1)), r"\.$", "")
    segments = F.array_remove(F.slice(F.split(value, "/"), 2, F.greatest(F.size(F.split(value, "/")) - 1, F.lit(0))), "")
    return F.when(kind == "prefix", F.array_join(F.concat(F.array(host), segments), "/")).otherwise(host)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until) of each time for which an entry is active; until is null if it still is."""
    clean = entries.select("kind", listed(F.col("kind"), F.col("value")).alias("value"), F.col("since").cast("date").alias("since"), F.lower("action").alias("action")).dropna()
    day = clean.groupBy("kind", "value", "since").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    order = Window.partitionBy("kind", "value").orderBy("since")
    turned = day.withColumn("before", F.lag("on", 1, 0).over(order)).filter("on != before").withColumn("until", F.lead("since").over(order))
    return turned.filter("on = 1").select(F.concat_ws(" ", "kind", "value").alias("key"), "since", "until")


def depths(entries: DataFrame) -> tuple[int, int]:
    """The labels of the longest domain and the segments of the longest prefix that the list has."""
    value = listed(F.col("kind"), F.col("value"))
    of = lambda kind, mark: F.max(F.when(F.col("kind") == kind, F.size(F.split(value, mark))))
    row = entries.dropna(subset=["kind", "value"]).agg(of("domain", "\\.").alias("labels"), of("prefix", "/").alias("segments")).first()
    return row["labels"] or 0, (row["segments"] or 1) - 1


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, no final dot) and path of a url, without user, port, query and fragment; the scheme may be missing, but not `//`."""
    found = lambda group: F.regexp_extract(url, URL, group)
    return F.regexp_replace(F.lower(found(1)), r"\.$", ""), found(2)


def url_keys(url: Column, labels: int, segments: int) -> Column:
    """An array of the keys under which a list of such depths can name a url."""
    host, path = url_parts(url)
    none = F.array().cast("array<string>")

    def firsts(parts: Column, most: int, key: Callable[[Column], Column]) -> Column:
        """A key of each of the first 1, 2, .. `most` parts."""
        return let(F.slice(parts, 1, most), lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x)), lambda n: key(F.slice(x, 1, n)))).otherwise(none)) if most else none

    def keys(h: Column) -> Column:
        domains = firsts(F.reverse(F.split(h, "\\.")), labels, lambda x: F.concat(F.lit("domain "), F.array_join(F.reverse(x), ".")))
        prefixes = firsts(F.array_remove(F.split(path, "/"), ""), segments, lambda x: F.concat(F.lit("prefix "), h, F.lit("/"), F.array_join(x, "/")))
        return F.concat(F.array(F.concat(F.lit("host "), h), F.concat(F.lit("prefix "), h)), domains, prefixes)

    return F.when(F.length(host) > 0, let(host, keys)).otherwise(none)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """`captures` with blocked and listed_since, the day of the earliest active entry."""
    rest = [c for c in captures.columns if c not in ("blocked", "listed_since")]
    site, day, found = "__uf_url", "__uf_day", "__uf_since"
    seen = captures.select(F.col(url).alias(site), F.col(fetched).cast("date").alias(day)).dropna().distinct()
    keyed = seen.select(site, day, F.explode(url_keys(F.col(site), *depths(entries))).alias("key"))
    spans = intervals(entries)
    active = keyed.join(spans, (keyed["key"] == spans["key"]) & (F.col(day) >= spans["since"]) & (spans["until"].isNull() | (F.col(day) < spans["until"])))
    hits = active.groupBy(F.col(site).alias("__uf_u"), F.col(day).alias("__uf_d")).agg(F.min("since").alias(found))
    joined = captures.join(hits, (F.col(url) == F.col("__uf_u")) & (F.col(fetched).cast("date") == F.col("__uf_d")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rest], F.col(found).isNotNull().alias("blocked"), F.col(found).alias("listed_since"))


def fetch_day(page_id: Column) -> Column:
    """A stand-in for the day of fetch where captures carry none: a day of 2024 that follows from the id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 37, F.lit(366)).cast("int"))


ORACLE = (
    r"""
WITH e0(kind, value, since, action) AS (VALUES """
    + ", ".join(f"('{k}', '{v}', DATE '{d}', '{a}')" for k, v, d, a in ENTRIES)
    + r"""),
e1 AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM e0),
e AS (SELECT * FROM e1 WHERE action = 'add'),
p AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_on,
    regexp_replace(lower(regexp_extract(url, '""" + URL + r"""', 1)), '\.$', '') AS host,
    regexp_extract(url, '""" + URL + r"""', 2) AS path
  FROM pages
),
hits AS (
  SELECT p.page_id, min(e.since) AS listed_since FROM p JOIN e ON fetched_on >= since AND (until IS NULL OR fetched_on < until)
    AND ((kind = 'host' AND host = value) OR (kind = 'domain' AND (host = value OR ends_with(host, '.' || value)))
      OR (kind = 'prefix' AND (host || path = value OR starts_with(host || path, value || '/'))))
  GROUP BY p.page_id
)
SELECT p.page_id, p.fetched_on, hits.listed_since IS NOT NULL AS blocked, hits.listed_since FROM p LEFT JOIN hits ON hits.page_id = p.page_id
"""
)
