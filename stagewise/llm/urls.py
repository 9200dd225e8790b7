"""URL filters by a temporal join with dated lists, in DataFrame functions only.

Lists are journals of dated entries: a pattern is added or removed.  Per list and pattern the
journal becomes validity intervals ``[since, until)``, and every capture is judged by the
entries in force when it was fetched.  A pattern is a host, which covers its subdomains, or a
host with the first path segment.  The most specific entry in force decides; of equally
specific ones an allowing list wins, then the list first in the alphabet.

Captures are reduced to distinct (host, segment, day) before they meet the lists, so a host with
a third of all pages is judged once per day, and only these few columns are shuffled.

Defined results: null or malformed urls have no host, match nothing and are kept; captures
without a time match nothing; entries with a null list, pattern, action or date are ignored; of
entries of one list, pattern and date a removal wins; repeated rows count once in a journal and
are judged row by row in the captures; empty tables give empty results or keep everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW = "allow"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host without a closing dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    return F.regexp_extract(url, _SEGMENT, 1)


def patterns_of(host: Column, segment: Column) -> Column:
    """The host, its parents down to two labels, and the host with the first path segment."""
    parts = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(segment != "", F.array_append(parents, F.concat(host, F.lit("/"), segment))).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, since, until`` from a journal ``list, pattern, action, dated``."""
    known = entries.select("list", F.lower("pattern").alias("pattern"), F.lower("action").alias("action"),
                           F.col("dated").cast("date").alias("since"))
    known = known.filter("list IS NOT NULL AND pattern IS NOT NULL AND action IN ('add', 'remove') AND since IS NOT NULL")
    # one row per list, pattern and day, however often the journal repeats it: 'remove' > 'add'
    daily = known.groupBy("list", "pattern", "since").agg(F.max("action").alias("action"))
    later = F.lead("since", 1).over(Window.partitionBy("list", "pattern").orderBy("since"))
    return (daily.withColumn("until", F.coalesce(later, F.lit(FOREVER).cast("date")))
            .filter("action = 'add'").drop("action"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, host, fetched, list, pattern, listed_since, kept`` of every capture."""
    rows = captures.select("page_id", "url", host_of(F.col("url")).alias("host"),
                           segment_of(F.col("url")).alias("segment"), F.col("fetched").cast("date").alias("fetched"))
    asked = rows.filter("host IS NOT NULL AND fetched IS NOT NULL").select("host", "segment", "fetched").distinct()
    asked = asked.withColumn("pattern", F.explode(patterns_of(F.col("host"), F.lower("segment"))))
    valid = intervals(entries)
    active = asked.join(valid, (asked["pattern"] == valid["pattern"]) & (F.col("since") <= F.col("fetched"))
                        & (F.col("fetched") < F.col("until")))
    rank = F.struct(-F.length(valid["pattern"]), (F.col("list") != ALLOW).cast("int"), F.col("list"))
    won = F.min_by(F.struct("list", valid["pattern"].alias("pattern"), F.col("since").alias("listed_since")), rank)
    verdict = active.groupBy("host", "segment", "fetched").agg(won.alias("w")).select("host", "segment", "fetched", "w.*")
    return (rows.join(verdict, ["host", "segment", "fetched"], "left")
            .select("page_id", "url", "host", "fetched", "list", "pattern", "listed_since",
                    F.coalesce(F.col("list") == ALLOW, F.lit(True)).alias("kept")))


# --- the lists and times of the registered query ---------------------------------------
# The pages of the test tables carry no fetch time and come without lists: both are derived
# from their urls and ids by rules that SQL can state too.

def captures_of(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def journal_of(pages: DataFrame) -> DataFrame:
    """Dated entries for a part of the hosts, their domains and first segments."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.lower(segment_of(F.col("url"))).alias("segment")).filter("host IS NOT NULL")
    seen = seen.distinct().withColumn("x", F.conv(F.substring(F.md5(F.concat_ws("/", "host", "segment")), 1, 7), 16, 10).cast("long"))
    seen = seen.withColumn("domain", F.substring_index("host", ".", -2))
    start = F.lit("2024-01-01").cast("date")

    def entry(name: str, pattern: Column, action: str, day: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"),
                                     F.date_add(start, day.cast("int")).alias("dated")))

    x, host = F.col("x"), F.col("host")
    path = F.concat(host, F.lit("/"), F.col("segment"))
    rows = F.array(
        entry("adult", host, "add", x % 300, x % 5 == 0),
        entry("adult", host, "remove", x % 300 + 40, x % 5 == 0),
        entry("adult", host, "add", x % 300 + 70, x % 10 == 0),
        entry("malware", path, "add", x % 350, (x % 3 == 1) & (F.col("segment") != "")),
        entry("malware", path, "remove", x % 350 + x % 90, (x % 6 == 1) & (F.col("segment") != "")),
        entry("spam", F.col("domain"), "add", F.length("domain") * 9 % 200, x % 2 == 0),
        entry("spam", F.col("domain"), "remove", F.length("domain") * 9 % 200 + 25, x % 2 == 0),
        entry(ALLOW, host, "add", x % 250, x % 7 == 3))
    return seen.select(F.explode(F.filter(rows, F.isnotnull)).alias("e")).select("e.*")


URLS_SQL = rf"""WITH seen AS (
  SELECT DISTINCT nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') AS host,
         lower(regexp_extract(url, '{_SEGMENT}', 1)) AS segment FROM pages),
h AS (SELECT *, ('0x' || substr(md5(host || '/' || segment), 1, 7))::BIGINT AS x,
             CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain
      FROM seen WHERE host IS NOT NULL),
j(list, pattern, action, dated) AS (
  SELECT 'adult', host, 'add', DATE '2024-01-01' + (x % 300)::INT FROM h WHERE x % 5 = 0 UNION ALL
  SELECT 'adult', host, 'remove', DATE '2024-01-01' + (x % 300 + 40)::INT FROM h WHERE x % 5 = 0 UNION ALL
  SELECT 'adult', host, 'add', DATE '2024-01-01' + (x % 300 + 70)::INT FROM h WHERE x % 10 = 0 UNION ALL
  SELECT 'malware', host || '/' || segment, 'add', DATE '2024-01-01' + (x % 350)::INT FROM h WHERE x % 3 = 1 AND segment <> '' UNION ALL
  SELECT 'malware', host || '/' || segment, 'remove', DATE '2024-01-01' + (x % 350 + x % 90)::INT FROM h WHERE x % 6 = 1 AND segment <> '' UNION ALL
  SELECT 'spam', domain, 'add', DATE '2024-01-01' + (length(domain) * 9 % 200)::INT FROM h WHERE x % 2 = 0 UNION ALL
  SELECT 'spam', domain, 'remove', DATE '2024-01-01' + (length(domain) * 9 % 200 + 25)::INT FROM h WHERE x % 2 = 0 UNION ALL
  SELECT 'allow', host, 'add', DATE '2024-01-01' + (x % 250)::INT FROM h WHERE x % 7 = 3),
d AS (SELECT list, pattern, dated, max(action) AS action FROM j GROUP BY ALL),
v AS (SELECT list, pattern, action, dated AS since,
             coalesce(lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated), DATE '{FOREVER}') AS until FROM d),
c AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') AS host,
             lower(regexp_extract(url, '{_SEGMENT}', 1)) AS segment, DATE '2024-01-01' + (page_id % 365)::INT AS fetched FROM pages),
m AS (SELECT c.page_id, v.list, v.pattern, v.since AS listed_since,
             row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC, v.list <> 'allow', v.list) AS place
      FROM c JOIN v ON (c.host = v.pattern OR c.host LIKE '%.' || v.pattern OR (c.segment <> '' AND c.host || '/' || c.segment = v.pattern))
             AND v.action = 'add' AND v.since <= c.fetched AND c.fetched < v.until)
SELECT c.page_id, c.url, c.host, c.fetched, m.list, m.pattern, m.listed_since, coalesce(m.list = 'allow', true) AS kept
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.place = 1"""
