"""URL filters: an as-of join of captures with dated lists.

A list is a log of dated events: a pattern is added to or removed from a list.
Events become validity intervals (from an addition to the next event of the same
list and pattern), and every capture is evaluated against the entries that were
active when it was fetched.  A pattern without a path covers its host and all
subdomains; one with a path covers that host (with or without ``www.``) and all
paths at or below it.

Few captures are listed, so hosts come first: distinct hosts are matched with the
domains of the lists, and only captures of matching hosts go on, as distinct
(host, path, time).  They ask about entries (list, domain, path).  Questions and
intervals of one entry are merged in time order, and each question takes the last
interval that began before it.  The merge is cut into hours: within an hour the
last interval so far, before that the last one of an earlier hour, which is found
among one row for each hour.  So neither a host with a third of all captures nor
an entry that is toggled very often meets in one task, no interval is multiplied
over time, and the answers join the captures as one row for each (host, path,
time).  All of it is DataFrame code.

Defined results: of events of one list and pattern at the same time a removal
wins; an addition is active from its own time on, until just before the removal;
a capture without a host or without a time has no active entries; null fields of
an event drop it; patterns and hosts are compared in lower case without a final
dot; urls, hosts and paths of any length count whole; rows are returned as often as
they occur; columns of the input named ``host`` or ``lists`` give way to those of
the result, all others pass; empty captures give an empty result, empty lists no
active entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import bounded, table, written

#: Bytes of a row that is broadcast, besides its strings.
ENTRY_BYTES = 256
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null if there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), _HOST, 1), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without a final slash; empty at the root."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r"/+$", "")


def validity(events: DataFrame) -> DataFrame:
    """(list, domain, path, since, until) of ``events`` (list, pattern, action, at).

    ``until`` is null while an entry stays active.  The next event is looked up
    within a day, and from day to day among one row for each day, so that a
    pattern with very many events doesn't meet in one sort.
    """
    rows = events.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    pattern = F.trim(F.col("pattern"))
    path = F.regexp_replace(F.regexp_extract(pattern, r"^[^/]*(/.*)$", 1), r"/+$", "")
    domain = F.regexp_replace(F.lower(F.regexp_extract(pattern, r"^([^/]*)", 1)), r"\.+$", "")
    rows = rows.select(
        "list",
        F.when(path == "", domain).otherwise(F.regexp_replace(domain, r"^www\.", "")).alias("domain"),
        path.alias("path"),
        F.col("at").cast("timestamp").alias("at"),
        (F.col("action") == "add").alias("adds"),
    )
    key = ["list", "domain", "path"]
    rows = rows.groupBy(*key, "at").agg(F.min("adds").alias("adds")).withColumn("day", F.to_date("at"))
    first = rows.groupBy(*key, "day").agg(F.min("at").alias("first"))
    after = first.select(*key, "day", F.lead("first").over(W.partitionBy(*key).orderBy("day")).alias("after"))
    within = rows.withColumn("next", F.lead("at").over(W.partitionBy(*key, "day").orderBy("at")))
    return (
        within.join(after, [*key, "day"])
        .where("adds")
        .select(*key, F.col("at").alias("since"), F.coalesce("next", "after").alias("until"))
    )


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains of at most ``most`` labels."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    return F.transform(F.sequence(first, F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _prefixes(path: Column, most: Column) -> Column:
    """The path and all paths above it but the root, of at most ``most`` steps."""
    parts = F.split(path, "/")
    last = F.least(F.size(parts), most + 1)
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


_ENTRY = ["list", "domain", "path"]


def as_of(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Those ``points`` (list, domain, path, at), each once, at which an interval of their entry is active."""
    span = F.struct("since", "until")
    none = F.lit(None).cast("struct<since: timestamp, until: timestamp>")
    starts = intervals.select(*_ENTRY, F.col("since").alias("at"), F.lit(False).alias("asks"), span.alias("span"))
    both = starts.unionByName(points.select(*_ENTRY, "at", F.lit(True).alias("asks"), none.alias("span")).distinct())
    both = both.withColumn("hour", F.date_trunc("hour", "at"))
    # Within the hour; an interval that begins at a point's time comes before it.
    so_far = W.partitionBy(*_ENTRY, "hour").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = both.withColumn("own", F.last("span", ignorenulls=True).over(so_far)).where("asks")
    earlier = W.partitionBy(*_ENTRY).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    hours = both.groupBy(*_ENTRY, "hour").agg(F.max("span").alias("last"))
    hours = hours.select(*_ENTRY, "hour", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    found = within.join(hours, [*_ENTRY, "hour"]).withColumn("now", F.coalesce("own", "carried"))
    return found.where("now IS NOT NULL AND (now.until IS NULL OR now.until > at)").select(*_ENTRY, "at")


def active_entries(captures: DataFrame, events: DataFrame, *, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host`` and ``lists``: the sorted names of lists that were active then."""
    keep = [c for c in captures.columns if c not in ("host", "lists")]
    host, path, when = "__quillon_host", "__quillon_path", "__quillon_at"
    rows = captures.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path), F.col(at).cast("timestamp").alias(when))
    asked = rows.select(F.col(host).alias("host"), F.col(path).alias("whole"), F.col(when).alias("at")).where("host IS NOT NULL AND at IS NOT NULL")
    intervals = written(validity(events), "validity")
    entries = written(intervals.select(*_ENTRY).distinct(), "entries")

    # Hosts that have entries: by a parent domain, or by paths of their own.
    steps = F.when(F.col("path") != "", F.size(F.split("path", "/")) - 1)
    domains = entries.groupBy("domain").agg(F.max(F.col("path") == "").alias("covers"), F.max(steps).alias("steps"))
    domains = bounded(written(domains.withColumn("labels", F.size(F.split("domain", r"\."))), "domains"), ENTRY_BYTES)
    most = domains.agg(F.max("labels")).first()[0] or 0
    hosts = asked.select("host").distinct()
    over = hosts.select("host", F.explode(_suffixes(F.col("host"), most)).alias("domain")).join(domains.where("covers"), "domain")
    deep = hosts.select("host", F.regexp_replace("host", r"^www\.", "").alias("domain")).join(domains.where("steps IS NOT NULL"), "domain")
    none = F.lit(None).cast("int").alias("steps")
    listed = over.select("host", "domain", none).unionByName(deep.select("host", "domain", "steps"))
    listed = bounded(written(listed, "listed"), ENTRY_BYTES)

    # Each entry that may cover a capture is asked at the capture's time.
    questions = asked.join(listed, "host").distinct()
    paths = F.when(F.col("steps").isNull(), F.array(F.lit(""))).otherwise(_prefixes(F.col("whole"), F.col("steps")))
    questions = questions.select("host", "whole", "at", "domain", F.explode(paths).alias("path")).join(bounded(entries, ENTRY_BYTES), ["domain", "path"])
    questions = written(questions, "questions")
    active = bounded(written(as_of(questions, intervals), "active"), ENTRY_BYTES)
    answers = questions.join(active, [*_ENTRY, "at"], "left_semi")
    answers = answers.groupBy("host", "whole", "at").agg(F.array_sort(F.collect_set("list")).alias("lists"))  # as many as there are lists
    names = [F.col(c).alias(f"__quillon_a_{c}") for c in ("host", "whole", "at", "lists")]
    answers = bounded(written(answers, "answers"), ENTRY_BYTES).select(*names)
    same = (F.col(host) == F.col("__quillon_a_host")) & (F.col(path) == F.col("__quillon_a_whole")) & (F.col(when) == F.col("__quillon_a_at"))
    lists = F.coalesce("__quillon_a_lists", F.array().cast("array<string>"))
    return rows.join(answers, same, "left").select(*[F.col(f"`{c}`") for c in keep], F.col(host).alias("host"), lists.alias("lists"))


def drop_listed(captures: DataFrame, events: DataFrame, **names: str) -> DataFrame:
    """The captures that no active entry covered when they were fetched, with their own columns."""
    return active_entries(captures, events, **names).where(F.size("lists") == 0).select(*captures.columns)


#: The dated events that the query evaluates.
EVENTS = (
    ("adult", "adult-x.example.net", "add", "2024-01-10 00:00:00"),
    ("adult", "adult-x.example.net", "remove", "2024-04-02 12:00:00"),
    ("adult", "adult-x.example.net", "add", "2024-04-20 06:30:00"),
    ("gambling", "free-bets.example.com", "add", "2024-03-01 00:00:00"),
    ("gambling", "free-bets.example.com", "remove", "2024-11-05 00:00:00"),
    ("malware", "spam-farm.example.org/de", "add", "2024-05-05 00:00:00"),
    ("pharma", "cheap-pills.example.com", "add", "2023-06-15 00:00:00"),
    ("pharma", "cheap-pills.example.com", "add", "2024-02-15 00:00:00"),
    ("pharma", "cheap-pills.example.com", "remove", "2024-09-09 09:09:00"),
    ("spam", "spam-farm.example.org", "add", "2024-02-29 00:00:00"),
    ("spam", "spam-farm.example.org", "remove", "2024-02-29 00:00:00"),
    ("spam", "spam-farm.example.org", "add", "2024-06-01 00:00:00"),
    ("spam", "tionsh.example.net/en", "add", "2024-07-01 00:00:00"),
    ("spam", "tionsh.example.net/en", "remove", "2024-08-01 00:00:00"),
    ("takedown", "example.org", "add", "2024-10-01 00:00:00"),
    ("takedown", "example.org", "remove", "2024-10-08 00:00:00"),
    ("takedown", "tiontion.example.com", "add", "2024-12-24 00:00:00"),
)
START = "2024-01-01 00:00:00"
#: Generated entries beside them: a list each for a rule's numbers.
GENERATED = 120_000
#: Parts of the generated domains.
PARTS = ("th", "tion", "sh", "ther", "than", "he", "ed", "es", "on", "ly", "re", "in", "ble", "ti", "wh", "er", "an", "nd", "st", "ou")
TAILS = ("", "tion", "an", "he", "ly", "on", "re", "es", "ble", "ing", "ed", "er", "in", "nd", "st", "ou", "wh", "ti", "sh", "th")
ENDS = ("com", "net", "org")
LISTS = 5


def generated_events(spark: SparkSession, entries: int = GENERATED) -> DataFrame:
    """Dated events of a rule: every entry is added and removed once in about a year, every fourth is added again."""

    def pick(values: tuple[str, ...], step: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("id") / step) % len(values) + 1).cast("int"))

    word = F.concat(pick(PARTS, 1), pick(PARTS, 20), pick(TAILS, 400), F.lit(".example."), pick(ENDS, 8000))
    deep = F.when(F.col("id") % 11 == 0, "/en").otherwise("")
    rows = spark.range(entries).select(
        F.concat(F.lit("auto"), (F.floor(F.col("id") / 24_000) % LISTS).cast("string")).alias("list"),
        F.concat(word, deep).alias("pattern"),
        ((F.col("id") * 37 % 400 - 30) * 1440 + F.col("id") * 7 % 1440).alias("since"),
        (F.col("id") * 13 % 120 + 1).alias("days"),
        (F.col("id") % 4 == 0).alias("again"),
    )
    event = [
        F.struct(F.lit("add").alias("action"), F.col("since").alias("minute")),
        F.struct(F.lit("remove").alias("action"), (F.col("since") + F.col("days") * 1440).alias("minute")),
        F.when(F.col("again"), F.struct(F.lit("add").alias("action"), (F.col("since") + 150 * 1440).alias("minute"))),
    ]
    rows = rows.select("list", "pattern", F.explode(F.array_compact(F.array(*event))).alias("event"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + F.col("event.minute") * 60)
    return rows.select("list", "pattern", "event.action", at.alias("at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages count as fetched at a time of 2024 that follows from page_id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(527_040))
    fetched = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + minute * 60)
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    fixed = spark.createDataFrame(list(EVENTS), "list string, pattern string, action string, at string")
    events = fixed.withColumn("at", F.col("at").cast("timestamp")).unionByName(generated_events(spark))
    found = active_entries(captures, events)
    return found.select(
        "page_id",
        "host",
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched"),
        F.array_join("lists", ",").alias("lists"),
        F.size("lists").cast("long").alias("n_lists"),
        (F.size("lists") > 0).alias("blocked"),
    )


QUERIES = {"op6_url_lists": query}



def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ORACLE_SQL = {
    "op6_url_lists": """
WITH fixed(list, pattern, action, moment) AS (VALUES
"""
    + ",\n".join(f"    ('{name}', '{pattern}', '{action}', TIMESTAMP '{at}')" for name, pattern, action, at in EVENTS)
    + f"""
), r AS (
    SELECT 'auto' || CAST((id // 24000) % {LISTS} AS VARCHAR) AS list,
        {_sql_list(PARTS)}[id % 20 + 1] || {_sql_list(PARTS)}[(id // 20) % 20 + 1] || {_sql_list(TAILS)}[(id // 400) % 20 + 1]
            || '.example.' || {_sql_list(ENDS)}[(id // 8000) % 3 + 1] || CASE WHEN id % 11 = 0 THEN '/en' ELSE '' END AS pattern,
        (id * 37 % 400 - 30) * 1440 + id * 7 % 1440 AS since, id * 13 % 120 + 1 AS days, id % 4 = 0 AS again
    FROM (SELECT range AS id FROM range({GENERATED}))
), made AS (
    SELECT list, pattern, 'add' AS action, since AS minute FROM r
    UNION ALL SELECT list, pattern, 'remove', since + days * 1440 FROM r
    UNION ALL SELECT list, pattern, 'add', since + 150 * 1440 FROM r WHERE again
"""
    + r"""
), e AS (
    SELECT * FROM fixed
    UNION ALL SELECT list, pattern, action, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(minute AS BIGINT)) FROM made
), one AS (
    SELECT list, pattern, moment, bool_and(action = 'add') AS adds FROM e GROUP BY 1, 2, 3
), v AS (
    SELECT *, split_part(pattern, '/', 1) AS domain, regexp_replace(pattern, '^[^/]*', '') AS path FROM (
        SELECT list, pattern, adds, moment AS since, lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment) AS until FROM one
    ) WHERE adds
), c AS (
    SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', ''), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((page_id * 7919) % 527040 AS BIGINT)) AS fetched_at
    FROM pages
), up AS (
    SELECT page_id, fetched_at, array_to_string(labels[k:], '.') AS domain
    FROM (SELECT page_id, fetched_at, labels, unnest(range(1, len(labels) + 1)) AS k FROM (SELECT *, string_split(host, '.') AS labels FROM c))
), hit AS (
    SELECT page_id, list FROM up JOIN v USING (domain)
    WHERE v.path = '' AND v.since <= fetched_at AND (v.until IS NULL OR v.until > fetched_at)
    UNION ALL
    SELECT page_id, list FROM c JOIN v ON regexp_replace(c.host, '^www\.', '') = v.domain
    WHERE v.path <> '' AND starts_with(c.path || '/', v.path || '/') AND v.since <= fetched_at AND (v.until IS NULL OR v.until > fetched_at)
), m AS (
    SELECT page_id, list_sort(list(DISTINCT list)) AS names FROM hit GROUP BY 1
)
SELECT page_id, host, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(array_to_string(names, ','), '') AS lists,
    CAST(coalesce(len(names), 0) AS BIGINT) AS n_lists, names IS NOT NULL AS blocked
FROM c LEFT JOIN m USING (page_id)
""",
}
