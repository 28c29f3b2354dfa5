"""URL filters by a temporal list join (operator 2, DataFrame functions only).

A block list is a log of dated changes (list, domain, action add or remove, day).
Per (list, domain) the log becomes validity intervals [since, until). Each
capture, a URL with its fetch day, is matched as of that day with the entries of
its host and of the host's parent domains: an equality join on domain and period
of days, then the interval test. Intervals are cut at periods of ``PERIOD`` days, so
a domain with a long log meets a capture with at most that many of its intervals.

Of several active entries the longest domain counts, then the first list by name.

Defined cases: on one day a removal is applied after an addition. An addition to
an active entry and a removal of an inactive one change nothing. A null in a log
row drops it. A null or hostless URL or a capture without day is not blocked.
Repeated captures (equal id, url, day) give one row. Empty tables give no rows
(captures) or block nothing (log). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirage.llm.common import table

PERIOD = 32
FOREVER = 1 << 20  # days
LISTS = ["adult", "malware", "spam"]  # fixed values
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def domains_of(host):
    """The host and its parents of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(parents)


def validity_intervals(log: DataFrame) -> DataFrame:
    """(list, domain, since, until) of a change log (list, domain, action, day)."""
    day = log.dropna(subset=["list", "domain", "action", "day"]).groupBy("list", F.lower("domain").alias("domain"), "day").agg(
        F.max((F.col("action") == "remove").cast("int")).alias("off"))
    w = Window.partitionBy("list", "domain").orderBy("day")
    change = day.withColumn("was", F.coalesce(F.lag("off").over(w), F.lit(1))).filter("off <> was")
    until = F.lead("day").over(w)
    return change.withColumn("until", F.coalesce(until, F.lit(FOREVER))).filter("off = 0").select(
        "list", "domain", F.col("day").alias("since"), "until")


def blocked_captures(captures: DataFrame, log: DataFrame, period: int = PERIOD) -> DataFrame:
    """(page_id, url, host, day, blocked, list, entry, since) of ``captures`` (page_id, url, day)."""
    c = captures.select("page_id", "url", "day", host_of(F.col("url")).alias("host")).distinct()
    last = F.lit(FOREVER)
    spans = validity_intervals(log)
    # An entry that is never removed is cut into periods up to the last capture.
    horizon = c.agg(F.max("day").alias("h")).select(F.coalesce("h", F.lit(0)).alias("h"))
    end = horizon.collect()[0]["h"]
    cut = spans.filter(F.col("since") <= end).withColumn("period", F.explode(F.sequence(
        F.expr(f"since div {period}"), F.expr(f"(least(until - 1, {end})) div {period}"))))
    cut = cut.withColumn("until", F.least("until", last)).select(F.col("domain").alias("entry"), "period", "list", "since", "until")
    asked = c.withColumn("_domain", F.explode_outer(domains_of(F.col("host")))).withColumn("_period", F.expr(f"day div {period}"))
    hit = asked.join(cut, (F.col("_domain") == F.col("entry")) & (F.col("_period") == F.col("period"))
                     & (F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")), "left")
    best = F.min(F.when(F.col("entry").isNotNull(), F.struct((-F.length("entry")).alias("l"), "list", "entry", "since"))).alias("b")
    return hit.groupBy("page_id", "url", "host", "day").agg(best).select(
        "page_id", "url", "host", "day", F.col("b").isNotNull().alias("blocked"), "b.list", "b.entry", "b.since")


def _number(c):
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table; it has no dates, so the fetch day (0 to 365)
    follows from the page id."""
    day = (_number(F.col("page_id").cast("string")) % 366).cast("int")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", day.alias("day"))


def derived_log(pages: DataFrame) -> DataFrame:
    """A change log over the domains of the pages: half of them are listed for a
    while, and some of those again later."""
    d = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("domain")).distinct()
    d = d.withColumn("h", _number(F.col("domain"))).filter("h % 2 = 0")
    add = F.expr("cast(h div 2 % 200 as int)")
    gone = F.expr("cast(h div 2 % 200 + 30 + h div 400 % 100 as int)")
    name = F.element_at(F.array(*map(F.lit, LISTS)), F.expr("cast(h div 4 % 3 + 1 as int)"))
    return d.select(name.alias("list"), "domain", "h", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), add.alias("day")), F.struct(F.lit("remove").alias("action"), gone.alias("day")),
        F.struct(F.lit("add").alias("action"), F.when(F.col("h") % 3 == 0, gone + 20).alias("day")))).alias("e")).select(
            "list", "domain", "e.action", "e.day")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return blocked_captures(page_captures(pages), derived_log(pages))


_NUM = "('0x' || substr(md5({}), 1, 8))::BIGINT"
SQL = rf"""WITH c AS (SELECT DISTINCT page_id, url, ({_NUM.format('page_id::VARCHAR')} % 366)::INT AS day,
  lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host FROM pages),
s AS (SELECT page_id, url, day, host, array_to_string(l[i:], '.') AS domain FROM (SELECT *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i
  FROM (SELECT *, string_split(host, '.') AS l FROM c WHERE host <> ''))),
d AS (SELECT domain, {_NUM.format('domain')} AS h FROM (SELECT DISTINCT domain FROM s)),
n AS (SELECT domain, h, (['adult', 'malware', 'spam'])[(h // 4 % 3 + 1)::INT] AS list, (h // 2 % 200)::INT AS a,
  (h // 2 % 200 + 30 + h // 400 % 100)::INT AS r FROM d WHERE h % 2 = 0),
i AS (SELECT list, domain, a AS since, r AS until FROM n UNION ALL SELECT list, domain, r + 20, {FOREVER} FROM n WHERE h % 3 = 0),
m AS (SELECT s.page_id, s.url, list, i.domain AS entry, since,
  row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY length(i.domain) DESC, list, i.domain, since) AS k
  FROM s JOIN i ON s.domain = i.domain AND since <= day AND day < until)
SELECT c.page_id, c.url, host, day, k IS NOT NULL AS blocked, list, entry, since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.url IS NOT DISTINCT FROM m.url AND k = 1"""
