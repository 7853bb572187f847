"""URL filters from dated lists: a temporal join of captures with what each list held when the page was fetched.

List events (list, key, day, action) become validity intervals: an "add" is in force from its day until the next event of the same
list and key, "remove" or another "add". A key is a host, which covers its subdomains, or a host and the
first segments of a path. A capture offers every host suffix with every path prefix as a key; the as-of join keeps the interval that holds its fetch time.
Whether a list is broadcast is decided by its counted size; otherwise both sides are shuffled by key, where Spark splits a host that
fills a partition. Only distinct (url, fetch time) pairs enter the join, and only their keys, never page bodies.

Cases: a null url or fetch time matches nothing and is kept, as is a url without a host; scheme, user, port, query, fragment and a trailing dot of the host are no part of a key, hosts compare
in lower case, paths as they are; events of the same list, key and day: "remove" wins; repeated events and repeated captures count once each; an empty list keeps all; other
columns ride along whatever their names; ``lists``, ``entries`` and ``keep`` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.common import columns, others, written

#: Intervals up to which a list is broadcast.
BROADCAST_INTERVALS = 20_000
EVENTS = "list string, key string, day date, action string"

LISTS = ("adult", "feeds", "parked", "spam")


def list_events(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "list string, key string, day string, action string").withColumn("day", F.col("day").cast("date"))


def page_events(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Dated events made from all hosts and first path segments of a table of pages, so that lists grow with it.

    The digest of a key says everything: three keys of eight are listed, from some day of 2024; half of those are removed later and half of these added again; one key of four is also on the list "watch".
    """
    url = columns([url_col])[0]
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    first = F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0))  # null where there is no path
    hosts = pages.select(host_of(url).alias("host"), first.alias("first")).where("host is not null").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)  # where two labels are left
    keys = hosts.select(F.explode(F.array(F.col("host"), parent, F.concat_ws("/", "host", "first"))).alias("key")).where("key <> ''").distinct()
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    named = keys.select("key", F.md5(F.col("key").cast("binary")).alias("h"))
    named = named.select("key", "h", F.element_at(F.array(*map(F.lit, LISTS)), number(1, 2) % len(LISTS) + 1).alias("own"), F.date_add(start, number(4, 4) % 366).alias("added"))
    named = named.withColumn("removed", F.date_add("added", 1 + number(9, 2) % 90)).withColumn("again", F.date_add("removed", 1 + number(12, 2) % 60))
    event = lambda when, name, day, action: F.when(when, F.struct(name.alias("list"), F.col("key"), day.alias("day"), F.lit(action).alias("action")))
    listed, gone, back = number(3, 1) < 6, number(8, 1) < 8, number(11, 1) < 8
    events = [
        event(listed, F.col("own"), F.col("added"), "add"), event(listed & gone, F.col("own"), F.col("removed"), "remove"), event(listed & gone & back, F.col("own"), F.col("again"), "add"),
        event(number(14, 1) < 4, F.lit("watch"), F.date_add(start, number(15, 4) % 366), "add"),
    ]
    return named.select(F.explode(F.array_compact(F.array(*events))).alias("e")).select("e.*")


def intervals(events: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): half-open; valid_to is null while the entry is in force. Hosts of keys are lowered, as those of captures are."""
    low = F.concat(F.lower(F.regexp_extract("key", "^[^/]*", 0)), F.regexp_extract("key", "/.*$", 0))
    days = events.where("list is not null and key is not null and day is not null").withColumn("key", low).groupBy("list", "key", "day").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    until = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return days.withColumn("until", until).where("removed = 0").select("list", "key", F.col("day").alias("valid_from"), F.col("until").alias("valid_to"))


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & (host != ""), host)


def keys_of(url: Column) -> Column:
    """Every host suffix, alone and with every prefix of the path's segments."""
    labels = F.split(host_of(url), r"\.")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    paths = F.concat(F.array(F.lit("")), F.transform(segments, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def apply_lists(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetch_day") -> DataFrame:
    """``captures`` with the lists and entries in force at fetch time, and whether to keep the page."""
    valid = intervals(events)
    valid = written(valid, "intervals")
    few = valid.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    valid = F.broadcast(valid) if few else valid
    kept = others(captures.columns, ["lists", "entries", "keep"])
    asked = captures.select(columns([url_col])[0].alias("u"), columns([time_col])[0].alias("t")).where("u is not null and t is not null").distinct()
    asked = asked.select("u", "t", F.explode(keys_of(F.col("u"))).alias("key"))
    found = asked.join(valid, "key").where((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    found = found.groupBy("u", "t").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set(F.concat_ws(":", "list", "key"))).alias("entries"))
    # the capture's own columns stay together, so that no name of theirs meets one of the plan's
    rows = captures.select(F.struct(*columns(kept)).alias("_row"), columns([url_col])[0].alias("_u"), columns([time_col])[0].alias("_t"))
    rows = rows.join(found, (F.col("_u") == F.col("u")) & (F.col("_t") == F.col("t")), "left")
    own = [F.col("_row").getField(c).alias(c) for c in kept]
    return rows.select(*own, F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), F.coalesce(F.array_join("entries", ","), F.lit("")).alias("entries"), F.col("lists").isNull().alias("keep"))


def fetch_day(page_id: Column) -> Column:
    """Pages carry no fetch time; the query spreads them over the days of 2024 by id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def lists_sql() -> str:
    """DuckDB SQL for the registered query."""
    number = lambda at, n: f"('0x' || substr(h, {at}, {n}))::int"
    lists = "[" + ", ".join(f"'{x}'" for x in LISTS) + "]"
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    return f"""
with captures as (select page_id, url, date '2024-01-01' + (((page_id % 366) + 366) % 366)::int as fetch_day from pages),
parsed as (
  select *, regexp_matches(url, '{scheme}') as fine,
    lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '{scheme}', ''), '^([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')) as host,
    regexp_extract(url, '{scheme}[^/?#]*([^?#]*)', 1) as path from captures),
hosts as (select distinct host, list_filter(string_split(path, '/'), lambda s: s <> '')[1] as first from parsed where fine and host <> ''),
keys as (
  select host as key from hosts union select regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) from hosts
  union select host || coalesce('/' || first, '') from hosts),
named as (select key, md5(key) as h from keys where key <> ''),
dated as (select *, {lists}[{number(1, 2)} % {len(LISTS)} + 1] as own, date '2024-01-01' + {number(4, 4)} % 366 as added from named),
gone as (select *, added + 1 + {number(9, 2)} % 90 as removed from dated),
again as (select *, removed + 1 + {number(12, 2)} % 60 as back from gone),
events as (
  select own as list, key, added as day, 'add' as action from again where {number(3, 1)} < 6
  union all select own, key, removed, 'remove' from again where {number(3, 1)} < 6 and {number(8, 1)} < 8
  union all select own, key, back, 'add' from again where {number(3, 1)} < 6 and {number(8, 1)} < 8 and {number(11, 1)} < 8
  union all select 'watch', key, date '2024-01-01' + {number(15, 4)} % 366, 'add' from again where {number(14, 1)} < 4),
days as (select list, key, day, max(case when action = 'remove' then 1 else 0 end) as removed from events group by list, key, day),
spans as (select list, key, day as valid_from, lead(day) over (partition by list, key order by day) as valid_to, removed from days),
hit as (
  select p.page_id, p.url, p.fetch_day, s.list, s.key from parsed p join spans s
    on s.removed = 0 and s.valid_from <= p.fetch_day and (s.valid_to is null or p.fetch_day < s.valid_to) and p.fine and p.host <> ''
    and (p.host = split_part(s.key, '/', 1) or ends_with(p.host, '.' || split_part(s.key, '/', 1)))
    and (not contains(s.key, '/') or starts_with(regexp_replace(p.path, '/+', '/', 'g') || '/', substr(s.key, strpos(s.key, '/')) || '/')))
select c.page_id, c.url, c.fetch_day::varchar as fetch_day,
  coalesce((select string_agg(distinct h.list, ',' order by h.list) from hit h where h.url = c.url and h.fetch_day = c.fetch_day), '') as lists,
  coalesce((select string_agg(distinct h.list || ':' || h.key, ',' order by h.list || ':' || h.key) from hit h where h.url = c.url and h.fetch_day = c.fetch_day), '') as entries,
  not exists (select 1 from hit h where h.url = c.url and h.fetch_day = c.fetch_day) as keep
from captures c
"""
