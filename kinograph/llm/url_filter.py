"""Temporal URL filters: dated list entries become validity intervals, captures join them as of fetch time.

An entry says that from ``at`` on a host (with all hosts below it) is on a list (``add``) or off it
(``remove``). Per list and host, an entry holds until the next one, which gives half-open
intervals. A capture is tested with its host and every parent domain against the intervals that
hold at its fetch time. The join is an equi-join on the domain with a range condition, so a hot host
is split by adaptive execution like any other skewed join. DataFrame expressions only.

Cases: entries of one list and host at the same time count once, and ``remove`` wins; entries
or captures with a null host, list, action or time match nothing; a null, empty or host-less URL is
kept; repeated captures each get a row; an empty list keeps everything; an empty capture table
gives an empty result. Capture columns are passed on, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import table, with_columns


def url_host(url: Column) -> Column:
    """Lower-case host of an URL, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entries(list, host, action, at) to (list, host, valid_from, valid_to): when a host was listed.

    valid_to is null while the entry still holds.
    """
    state = (
        entries.where("list is not null and host is not null and at is not null and action in ('add', 'remove')")
        .groupBy("list", F.lower("host").alias("host"), "at")
        .agg(F.max(F.col("action") == "remove").alias("off"))
    )
    following = F.lead("at").over(Window.partitionBy("list", "host").orderBy("at"))
    return state.withColumn("valid_to", following).where(~F.col("off")).select("list", "host", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """Add host, n_active (entries in force), lists (sorted, comma-joined), matched (the most specific domain listed) and blocked.

    ``id_col`` identifies a capture.
    """
    asked = captures.select(F.col(id_col).alias("__id"), F.col(time_col).alias("__at"), F.explode(domains(url_host(F.col(url_col)))).alias("__domain")).distinct()
    held = validity_intervals(entries)
    in_force = (F.col("__domain") == held["host"]) & (F.col("__at") >= held["valid_from"]) & (held["valid_to"].isNull() | (F.col("__at") < held["valid_to"]))
    hits = (
        asked.join(held, in_force)
        .groupBy("__id", "__at")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.array_join(F.array_sort(F.collect_set("list")), ",").alias("__lists"),
            F.max(F.struct(F.length("__domain").alias("l"), F.col("__domain").alias("d")))["d"].alias("__matched"),
        )
    )
    found = captures.join(hits, captures[id_col].eqNullSafe(hits["__id"]) & captures[time_col].eqNullSafe(hits["__at"]), "left")
    out = with_columns(
        found,
        {
            "host": url_host(F.col(url_col)),
            "n_active": F.coalesce("__n", F.lit(0).cast("long")),
            "lists": F.coalesce("__lists", F.lit("")),
            "matched": F.col("__matched"),
            "blocked": F.col("__n").isNotNull(),
        },
    )
    return out.drop("__id", "__at", "__n", "__lists", "__matched")


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages without their bodies; the table has no fetch day, so one follows from the id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", ((F.col("page_id") * 37) % 365).cast("int").alias("fetch_day"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the pages' hosts, as the tables bring none.

    A quarter of the hosts is listed on a day, half of those are cleared 60 days later, a
    fifth listed again 120 days later; one whole domain is listed from day 100 to 129.
    """
    host = pages.select(url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    h = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long")
    host = host.select("host", h.alias("h")).where("h % 4 = 0")
    name = F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam")]), (F.expr("h div 4") % 3 + 1).cast("int"))
    day = (F.expr("h div 16") % 300).cast("int")
    one = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    dated = F.array_compact(F.array(one("add", day), F.when(F.expr("h div 4") % 2 == 0, one("remove", day + 60)), F.when(F.expr("h div 4") % 5 == 0, one("add", day + 120))))
    rows = host.select(name.alias("list"), "host", F.explode(dated).alias("e")).select("list", "host", "e.action", "e.at")
    whole = pages.sparkSession.createDataFrame([("spam", "example.org", "add", 100), ("spam", "example.org", "remove", 130)], "list string, host string, action string, at int")
    return rows.unionByName(whole)
