"""URL filters over time: a temporal join of captures with dated lists, in DataFrame functions only.

Entries say on which day a list takes up a host (alone, or with all hosts below it) or gives it up. Per list and key they
become validity intervals [since, until), which never overlap; a capture meets, for its host and every parent domain, the
intervals that hold its fetch day, as of that day and not as the list stands now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import free_name, materialize, table

ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a closing dot; null if there is none. An IPv6 address
    keeps its brackets."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def is_address(host: Column) -> Column:
    """Whether a host is an IP address, which has no domains above it."""
    return host.startswith("[") | host.rlike(r"^[0-9]+(\.[0-9]+){3}$")


def parents(host: Column) -> Column:
    """A host and the domains above it of at least two labels (a host of one label, or an address, is itself alone)."""
    labels = F.when(is_address(host), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (list, key, below, since, until) from entries (list, key, day, action, below); until is null while a key is
    still listed. below tells whether a key covers the hosts below it as well; without that column all do.

    Of several actions on a day the removal counts. A removal of what isn't listed and an addition of what is change
    nothing. Entries with a null key, day or an unknown action are left out. First the entries of a day are made one
    (partly before the shuffle), so a key brings no more rows to its task than there are days."""
    entries = entries if "below" in entries.columns else entries.withColumn("below", F.lit(True))
    days = (
        entries.filter(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin(ADD, REMOVE))
        .select("list", F.lower("key").alias("key"), F.coalesce("below", F.lit(True)).alias("below"), "day", (F.col("action") == REMOVE).alias("off"))
        .groupBy("list", "key", "below", "day").agg(F.max("off").alias("off"))
    )
    w = Window.partitionBy("list", "key", "below").orderBy("day")
    turns = days.withColumn("before", F.lag("off", 1, True).over(w)).filter(F.col("off") != F.col("before"))
    spans = turns.withColumn("until", F.lead("day").over(w))
    return spans.filter(~F.col("off")).select("list", "key", "below", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, spans: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """captures with host, blocked, n_entries (entries active at fetch time) and, of these, matched_list, matched_key and
    matched_since (the most specific key, then the first list by name).

    A capture without a host or a day is not blocked. Rows repeated are judged alike. Columns of captures that bear a
    name of the result are replaced. Captures are written once, narrow joins read them; a host or domain that a third of
    all captures share is split by adaptive execution, as both sides of the join are read from files."""
    made = ("host", "blocked", "n_entries", "matched_list", "matched_key", "matched_since")
    own = [c for c in captures.columns if c.lower() not in made]
    rid = free_name(captures, "rid")
    rows = materialize(captures.select(*own, host_of(F.col(url)).alias("host"), F.monotonically_increasing_id().alias(rid)), "captures")
    spans = materialize(spans.select("list", F.col("key").alias("span_key"), "below", "since", "until"), "list-intervals")
    asked = rows.filter(F.col("host").isNotNull() & F.col(day).isNotNull()).select(F.col(rid).alias("capture"), F.col(day).alias("at"), F.posexplode(parents(F.col("host"))).alias("up", "span_key"))
    active = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))) & (F.col("below") | (F.col("up") == 0))
    met = asked.join(spans.hint("merge"), "span_key").filter(active)
    best = F.min(F.struct((-F.length("span_key")).alias("a"), F.col("list").alias("b"), F.col("span_key").alias("c"), F.col("since").alias("d")))
    hits = met.groupBy("capture").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    out = rows.join(hits, F.col(rid) == F.col("capture"), "left")
    return out.select(
        *own, "host", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.col("best.b").alias("matched_list"), F.col("best.c").alias("matched_key"), F.col("best.d").alias("matched_since"),
    )


#: The tables hold neither fetch days nor lists, so both are drawn by rule: a page is fetched on day page_id mod 365, and
#: digits of a name's MD5 decide whether and when a host (one in three) or a domain (one in five) is listed.
def _digits(name: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(name), at, n), 16, 10).cast("int")


def drawn_entries(hosts: DataFrame) -> DataFrame:
    """Dated entries for a column host of distinct hosts."""
    domain = F.element_at(parents(F.col("host")), -1)
    names = hosts.select(F.lit("hosts").alias("list"), F.col("host").alias("key"), F.lit(False).alias("below"), F.lit(3).alias("one_in")).union(
        hosts.select(F.lit("domains"), domain, F.lit(True), F.lit(5)).distinct()
    )
    k = F.col("key")
    first = _digits(k, 5, 4) % 365
    off = first + 1 + _digits(k, 9, 4) % 120
    acts = F.array(
        F.struct(first.alias("day"), F.lit(ADD).alias("action")), F.struct(off.alias("day"), F.lit(REMOVE).alias("action")),
        F.struct(F.when(_digits(k, 13, 1) % 2 == 0, off + 30).alias("day"), F.lit(ADD).alias("action")),
    )
    return names.filter(_digits(k, 1, 4) % F.col("one_in") == 0).select("list", "key", "below", F.explode(acts).alias("e")).select("list", "key", "below", "e.day", "e.action")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page by the entries that were active when it was fetched; an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 365).cast("int").alias("fetch_day"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    out = evaluate(pages, intervals(drawn_entries(hosts)))
    return out.drop("url")


OP7_SQL = r"""
WITH p AS (SELECT page_id, (page_id % 365)::INT AS fetch_day, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '\.$', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
n AS (SELECT 'hosts' AS list, host AS key, 3 AS one_in FROM h
      UNION ALL SELECT DISTINCT 'domains', CASE WHEN starts_with(host, '[') OR regexp_matches(host, '^[0-9]+(\.[0-9]+){3}$') THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END, 5 FROM h),
m AS (SELECT list, key, one_in, ('0x' || substr(md5(key), 1, 4))::INT AS a, ('0x' || substr(md5(key), 5, 4))::INT % 365 AS first, ('0x' || substr(md5(key), 9, 4))::INT % 120 AS b, ('0x' || substr(md5(key), 13, 1))::INT AS c FROM n),
s AS (SELECT list, key, first AS since, first + 1 + b AS until FROM m WHERE a % one_in = 0
      UNION ALL SELECT list, key, first + 1 + b + 30, NULL FROM m WHERE a % one_in = 0 AND c % 2 = 0),
j AS (SELECT p.page_id, s.list, s.key, s.since FROM p JOIN s ON (p.host = s.key OR (s.list = 'domains' AND ends_with(p.host, '.' || s.key))) AND s.since <= p.fetch_day AND (s.until IS NULL OR p.fetch_day < s.until)),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, list) AS place, count(*) OVER (PARTITION BY page_id) AS n FROM j)
SELECT p.page_id, p.fetch_day, p.host, g.n IS NOT NULL AS blocked, coalesce(g.n, 0)::BIGINT AS n_entries, g.list AS matched_list, g.key AS matched_key, g.since AS matched_since
FROM p LEFT JOIN g ON p.page_id = g.page_id AND g.place = 1
"""
