"""URL filters by temporal list join.

A block list is a log of dated entries (list, entry, action add or remove, day). Each entry's log becomes validity intervals, from the day of
an `add` to the day of the next `remove`, which is outside. A capture is looked up by its keys, the host and each parent domain, and
host with path, against the entries valid on the day it was fetched. DataFrame operations only.

Several events of an entry on one day: `remove` wins. Repeated adds or removes change nothing. Events with a null or unknown part are void.
Captures without a readable host, or without a date, match nothing and pass; repeated captures are judged each. Of very long hosts only
parents no longer than the longest entry are looked up, as others can't match. An empty list lets everything pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import staged

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: str | Column) -> Column:
    """Lower-case host of an absolute URL, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def page_of(url: str | Column) -> Column:
    """Host and path, without user, port, query and fragment."""
    return F.concat(host_of(url), F.when(F.regexp_extract(url, PATH, 1) == "", "/").otherwise(F.regexp_extract(url, PATH, 1)))


def validity_intervals(events: DataFrame) -> DataFrame:
    """list, entry, valid_from, valid_to (null: still valid). The log of an entry is reduced to one event a day before it is sorted."""
    known = events.filter(
        F.col("list").isNotNull() & F.col("entry").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = known.groupBy("list", "entry", F.col("day").cast("date").alias("day")).agg(F.max("action").alias("action"))
    log = Window.partitionBy("list", "entry").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("action").over(log), F.lit("remove"))).filter("action <> was")
    return changes.withColumn("valid_to", F.lead("day").over(log)).filter("action = 'add'").select(
        "list", "entry", F.col("day").alias("valid_from"), "valid_to")


def lookup_keys() -> Column:
    """Keys of `_host` and `_page`, no longer than `_longest`: the host, its parents, and host with path."""
    # the last `_longest` characters and one before them hold every parent that can match, and the host itself if it is no longer
    tail = F.when(F.length("_host") > F.col("_longest"), F.right("_host", F.col("_longest") + 1)).otherwise(F.col("_host"))
    labels = F.split(tail, r"\.")
    cut = F.when(F.length("_host") > F.col("_longest"), 2).otherwise(1)  # the first label of a tail is no whole label
    parents = F.when(F.size(labels) >= cut, F.transform(
        F.sequence(cut, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    page = F.when(F.length("_page") <= F.col("_longest"), F.array("_page")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parents, page))


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """All columns of the captures as struct `capture`, with host, blocked, n_entries, entries (sorted "list:entry").

    Captures are numbered and written once. Only number, key and day are exploded and joined: a hot host is a skewed join of a large side with
    one row per interval, which Spark splits. Entries found are gathered by number, and the few captures that have any get them back.
    """
    valid = staged(validity_intervals(events), "intervals")
    longest = valid.agg(F.coalesce(F.max(F.length("entry")), F.lit(0)).alias("n")).first()["n"]
    rows = staged(captures.select(F.struct("*").alias("capture"), host_of(url).alias("_host"), page_of(url).alias("_page"), F.col(fetched).cast(
        "date").alias("_day")).withColumn("_id", F.monotonically_increasing_id()), "captures")
    asked = rows.filter(F.col("_host").isNotNull() & F.col("_day").isNotNull()).withColumn("_longest", F.lit(longest))
    keyed = asked.select("_id", "_day", F.explode(lookup_keys()).alias("_key"))
    active = (keyed["_key"] == valid["entry"]) & (keyed["_day"] >= valid["valid_from"]) & (
        valid["valid_to"].isNull() | (keyed["_day"] < valid["valid_to"]))
    found = keyed.join(valid, active).groupBy("_id").agg(F.sort_array(F.collect_set(F.concat_ws(":", "list", "entry"))).alias("entries"))
    judged = rows.join(staged(found, "found"), "_id", "left")
    entries = F.coalesce("entries", F.array().cast("array<string>"))
    return judged.select(
        "capture", F.col("_host").alias("host"), (F.size(entries) > 0).alias("blocked"), F.size(entries).alias("n_entries"), entries.alias("entries"))


def derived_fetches(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched: a day of two years by page_id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2023-01-01', CAST(pmod(page_id * 37, 730) AS INT))").alias("fetched"))


def derived_events(pages: DataFrame) -> DataFrame:
    """A log of list events derived from the pages: hosts, registered domains and single pages, added on a day that follows from their
    name, most of them removed later and some added again."""
    hosts = pages.select(host_of("url").alias("host"), page_of("url").alias("page"))
    names = (
        hosts.groupBy(F.col("host").alias("entry")).agg(F.lit("hosts").alias("list"))
        .unionByName(hosts.groupBy(F.substring_index("host", ".", -2).alias("entry")).agg(F.lit("domains").alias("list")))
        .unionByName(hosts.groupBy(F.col("page").alias("entry")).agg(F.lit("pages").alias("list"))))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "list", "entry").cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = names.filter(F.col("entry").isNotNull()).withColumn("x", number).filter("x % 5 = 0")
    return drawn.select("list", "entry", F.explode(F.expr(
        "filter(array(struct('add' AS action, date_add(DATE'2023-01-01', CAST(x div 5 % 600 AS INT)) AS day),"
        " struct('remove' AS action, date_add(DATE'2023-01-01', CAST(x div 5 % 600 + 20 + x div 7 % 150 AS INT)) AS day),"
        " struct(IF(x div 11 % 2 = 0, 'add', CAST(NULL AS STRING)) AS action, date_add(DATE'2023-01-01', CAST(x div 5 % 600 + 200 AS INT)) AS day)),"
        " e -> e.action IS NOT NULL)")).alias("e")).select("list", "entry", "e.action", "e.day")


def judged_pages(pages: DataFrame) -> DataFrame:
    """page_id, fetched, host, blocked, n_entries, entries (comma-joined): one row per page."""
    judged = filter_captures(derived_fetches(pages), derived_events(pages))
    return judged.select("capture.page_id", "capture.fetched", "host", "blocked", "n_entries", F.array_join("entries", ",").alias("entries"))
