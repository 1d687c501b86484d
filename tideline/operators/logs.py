"""Search and event extraction over logs (host, host_no, line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import patterns
from tideline.operators.aggregate import preview


def log_search(logs: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False, count_only: bool = False, max_count: int | None = None, extended: bool = True) -> DataFrame:
    """Lines that match, or (host, matches) with ``count_only``; ``max_count`` stops each host there.

    ``extended=False`` reads the pattern as a basic one, in which ``+`` and its like are plain.
    """
    pattern = patterns.linear_pattern(pattern) if extended else patterns.basic_pattern(pattern)
    pattern = patterns.checked(logs.sparkSession, f"(?i){pattern}" if ignore_case else pattern)
    hit = F.col("line").rlike(pattern)
    found = logs.where(~hit if invert else hit)
    if count_only:
        n = F.count(F.lit(1))
        return found.groupBy("host").agg((F.least(n, F.lit(max_count)) if max_count is not None else n).alias("matches"))
    return preview(found, "host", max_count) if max_count is not None else found


def log_report(logs: DataFrame, hosts: DataFrame, pattern: str, first: int = 5, **flags) -> DataFrame:
    """Per host of hosts(host, host_no, reachable): matches, first lines, and a status, by host number.

    A host without matches shows 'No matches', one out of reach 'unreachable'.
    """
    found = log_search(logs, pattern, **flags)
    matches = found.groupBy("host").agg(F.count(F.lit(1)).alias("matches"))
    lines = preview(found, "host", first).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("first"))  # ``first`` lines a host
    out = hosts.join(matches, "host", "left").join(lines, "host", "left")
    n = F.when(F.col("reachable"), F.coalesce("matches", F.lit(0)))
    status = F.when(~F.col("reachable"), "unreachable").when(F.coalesce("matches", F.lit(0)) == 0, "No matches").otherwise("ok")
    return out.select("host", "host_no", n.alias("matches"), F.array_join(F.transform("first", lambda x: x["line"]), "\n").alias("first_lines"), status.alias("status")).orderBy("host_no", "host")


def report_totals(report: DataFrame) -> DataFrame:
    """One row: all matches, and hosts that answered."""
    return report.agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matches"), F.count_if(F.col("status") != "unreachable").alias("responding"))


# The event names that logs carry.
EVENTS = ("TASK START", "TASK END", "TASK RESTART", "TASK FAILED", "RUN START", "RUN END", "UPSCALE TRIGGERED", "DOWNSCALE TRIGGERED")


def parse_events(logs: DataFrame) -> DataFrame:
    """(host, line_no, event, fields, job, task, stage, rate) of the lines that announce an event.

    fields: the 'k=v' pairs after the event's name, separated by commas or spaces.
    """
    pattern = rf"\b({'|'.join(EVENTS)})\b[:\s]*(.*)$"
    out = logs.select("host", "line_no", F.regexp_extract("line", pattern, 1).alias("event"), F.regexp_extract("line", pattern, 2).alias("rest")).where("event <> ''")
    pairs = F.regexp_extract_all("rest", F.lit(r"([A-Za-z_][A-Za-z0-9_]*=[^,\s]*)"), F.lit(1))
    # the first of a repeated key counts
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, F.substring_index(p, "=", 1)) == i + 1)
    fields = F.map_from_entries(F.transform(firsts, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, "=(.*)$", 1))))
    out = out.withColumn("fields", fields)
    value = lambda k: F.try_element_at("fields", F.lit(k))
    return out.select("host", "line_no", "event", "fields", value("job").alias("job"), value("task").alias("task"), F.expr("try_cast(try_element_at(fields, 'stage') as int)").alias("stage"), F.expr("try_cast(try_element_at(fields, 'rate') as double)").alias("rate"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def last_samples(events: DataFrame, k: int = 10) -> DataFrame:
    """The last k scaling events by line."""
    return events.where(F.col("event").endswith("SCALE TRIGGERED")).orderBy(F.desc("line_no"), "host").limit(k)
