"""The library's operators over the test tables, with the same results as SQL.

Lines are composed from whole-number and text columns of ``events``; doubles and timestamps would
print differently elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import csvline
from tideline.functions.ring import ring_id, ring_number
from tideline.operators import aggregate, appendlog, fleet, hashtree, heavy, lineindex, lines, logs, mergedlog, metrics, placement, reconcile
from tideline.plans.keyed import register_state_op
from tideline.plans.pipeline import Pipeline, register_keyed_op, register_row_op
from tideline.sources import records, sinks
from tideline.sources.lines import multi_append, read_lines, read_lines_stream, table_lines
from tideline.sources.snapshots import read_snapshot
from tideline.streaming import expiring, ranges
from tideline.streaming import heavy as heavy_stream
from tideline.streaming import run as streams
from tideline.streaming.sequence import run_sequenced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# SQL that several queries share.
EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS key, event_id || ',"user, ' || (user_id % 7) || '",' || event_type || ',' || props AS value, CAST(event_id AS VARCHAR) AS id FROM events)"""
FIELDS = r"""list_transform(regexp_extract_all(',' || value, ',((?:[^,"]|"[^"]*(?:"|$))*)', 1), lambda x: replace(x, '"', ''))"""
FIRST3 = r"""regexp_extract(value, '^((?:[^,"]|"[^"]*(?:"|$))*(?:,(?:[^,"]|"[^"]*(?:"|$))*){0,2})', 1)"""
COUNTS = f"counts AS (SELECT coalesce({FIELDS}[3], '') AS key, count(*) AS n FROM ev WHERE regexp_matches(value, 'user, [0-4]') GROUP BY 1)"
US = "epoch_us(ts)"


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that can be null, as text: clients print them differently."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.col("event_id"), F.lit(',"user, '), F.col("user_id") % 7, F.lit('",'), F.col("event_type"), F.lit(","), F.col("props"))
    return table_lines(_t(spark, sf_dir, "events"), F.col("event_id"), value)


def _words(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    """In as many parts as the scan has; texts are dealt to ``parts`` where it has fewer."""
    docs = _t(spark, sf_dir, "documents").select("text")
    docs = docs.repartition(parts) if docs.rdd.getNumPartitions() < parts else docs
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("key"))


def grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, n) of lines of users 0 to 4, by event type."""
    return aggregate.count_by_key(lines.grep("user, [0-4]", 3)(event_lines(spark, sf_dir)))


# ---- lines


@query(f"WITH {EV} SELECT key, value, id FROM ev")
def identity(spark, sf_dir):
    return lines.identity()(event_lines(spark, sf_dir))


@query(f"WITH {EV} SELECT key, value || ' processed' AS value, id FROM ev")
def echo(spark, sf_dir):
    return lines.echo()(event_lines(spark, sf_dir))


@query(f"WITH {EV} SELECT key, value, id FROM ev WHERE regexp_matches(value, 'user, [13].*\"k\": 8')")
def grep_lines(spark, sf_dir):
    return lines.grep('user, [13].*"k": 8')(event_lines(spark, sf_dir))


@query(f"WITH {EV} SELECT key, value, id FROM ev WHERE contains(value, 'user, 5')")
def contains_lines(spark, sf_dir):
    return lines.contains("user, 5")(event_lines(spark, sf_dir))


@query(f"WITH {EV} SELECT coalesce({FIELDS}[2], '') AS key, value, id FROM ev")
def key_by_column(spark, sf_dir):
    return lines.key_by(2)(event_lines(spark, sf_dir))


@query(f"WITH {EV}, {COUNTS} SELECT key, key || ',' || n AS value, 'count-' || key AS id, n FROM counts")
def grep_count(spark, sf_dir):
    return Pipeline(lambda s: event_lines(s, sf_dir), [("grep", {"pattern": "user, [0-4]", "column": 3}), ("count", {})]).frame(spark)


@query(f"WITH {EV} SELECT key, {FIRST3} AS value, id FROM ev")
def first_three_fields(spark, sf_dir):
    return lines.transform(3)(event_lines(spark, sf_dir))


@query(f"WITH {EV} SELECT id, array_to_string({FIELDS}, '|') AS fields, CAST(len({FIELDS}) AS INTEGER) AS n FROM ev")
def csv_fields(spark, sf_dir):
    fields = csvline.csv_fields("value")
    return event_lines(spark, sf_dir).select("id", F.array_join(fields, "|").alias("fields"), F.size(fields).alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_id || ',user, ' || (user_id % 7) || ',' || event_type AS value, CAST(event_id AS VARCHAR) AS id FROM events")
def first_three_rfc4180(spark, sf_dir):
    return lines.transform(3, "rfc4180")(event_lines(spark, sf_dir))


@query("SELECT 'user, ' || (user_id % 7) AS key, count(*) AS n FROM events GROUP BY 1")
def key_count_rfc4180(spark, sf_dir):
    return aggregate.count_by_key(lines.key_by(1, base=0, dialect="rfc4180")(event_lines(spark, sf_dir)))


@query(f"WITH {EV}, {COUNTS} SELECT key, n FROM counts ORDER BY n DESC, key")
def top_keys(spark, sf_dir):
    return aggregate.top(grep_counts(spark, sf_dir))


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1),
    f AS (SELECT row_number() OVER (ORDER BY n DESC, key) AS rank, key, n FROM c)
    SELECT rank, key, CAST(n AS VARCHAR) AS n FROM f WHERE rank <= 10
    UNION ALL SELECT 11, '... and ' || (count(*) - 10) || ' more', NULL FROM c HAVING count(*) > 10""")
def top_k_keys(spark, sf_dir):
    users = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"))
    return _as_text(aggregate.top_k(aggregate.count_by_key(users), 10), "n")


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def heavy_keys(spark, sf_dir):
    """The ten customers with the most orders."""
    return heavy.heavy_keys(_t(spark, sf_dir, "orders"), 10, "o_custkey")


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS key FROM documents)
    SELECT key, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, key LIMIT 25""")
def heavy_words(spark, sf_dir):
    """The 25 most frequent words of all documents."""
    return heavy.heavy_keys(_words(spark, sf_dir), 25)


@query(f"WITH {EV}, {COUNTS} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(DISTINCT key) AS unique_keys, floor(sum(n) / 7.0 * 100) / 100 AS rows_per_sec FROM counts")
def totals(spark, sf_dir):
    return aggregate.totals(grep_counts(spark, sf_dir), 7.0)


@query(f"WITH {EV}, {COUNTS} SELECT key || ',x,' || n AS value, key || ',x' AS key, n FROM counts")
def parse_counts(spark, sf_dir):
    made = grep_counts(spark, sf_dir).select(csvline.format_count(F.concat("key", F.lit(",x")), "n").alias("value"))
    key, n = csvline.parse_count("value")
    return made.select("value", key.alias("key"), n.alias("n"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 2 ELSE 4 END::BIGINT AS fields, count(*) AS rows, false AS ok FROM events GROUP BY 1")
def field_count_report(spark, sf_dir):
    rows = event_lines(spark, sf_dir)
    short = F.when(F.col("id").cast("long") % 3 == 0, F.regexp_replace("value", r",[^,]*,[^,]*$", "")).otherwise(F.col("value"))
    return reconcile.field_count_report(rows.withColumn("value", short))


@query(f"WITH {EV} SELECT key, value, id FROM ev ORDER BY CAST(id AS BIGINT) LIMIT 20")
def first_rows(spark, sf_dir):
    rows = event_lines(spark, sf_dir).withColumn("line_no", F.col("id").cast("long"))
    return aggregate.sample_first(rows, 20).drop("line_no")


# ---- files


def _as_files(spark, sf_dir, n: int = 4) -> str:
    path = streams.working_dir(spark, "lines")
    event_lines(spark, sf_dir).select("value").repartition(n, "value").sortWithinPartitions("value").write.text(path)
    return path


@query(f"WITH {EV} SELECT value, count(*) AS n FROM ev GROUP BY value")
def file_lines(spark, sf_dir):
    """Lines written as text files and read back; ids are unique places."""
    found = read_lines(spark, _as_files(spark, sf_dir))
    return found.groupBy("value").agg(F.count_distinct("id").alias("n"))


@query(f"WITH {EV} SELECT value, count(*) AS n FROM ev GROUP BY value")
def source_fallback(spark, sf_dir):
    """The first of two places that exists."""
    path = _as_files(spark, sf_dir)
    return read_lines(spark, [f"{path}-missing", path]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _named_files(spark, df, by: list[str], name: Callable[[dict], str], fmt: str = "text", **options) -> str:
    """A folder with one file for each value of the columns ``by``, called name(values)."""
    made, out = streams.working_dir(spark, "parts"), streams.working_dir(spark, "named")
    df.repartition(*by).write.partitionBy(*by).format(fmt).options(**options).save(made)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(out))
    for status in files.globStatus(path(f"{made}/{'*/' * len(by)}part-*")):
        place = status.getPath().toString().rsplit("/", len(by) + 1)[1:-1]
        files.rename(status.getPath(), path(f"{out}/{name(dict(x.split('=', 1) for x in place))}"))
    return out


@query("SELECT 'node' || (user_id % 4) AS host, CAST(user_id % 4 AS INTEGER) AS host_no, '20250102_000000' AS run, event_id || ' ' || event_type AS line FROM events WHERE event_id % 3 <> 0")
def source_logs(spark, sf_dir):
    """The newest of two logs of each host."""
    ev = _t(spark, sf_dir, "events")
    run = F.when(F.col("event_id") % 3 == 0, "20250101_000000").otherwise("20250102_000000")
    rows = ev.select(F.concat(F.lit("node"), F.col("user_id") % 4).alias("host"), run.alias("run"), F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value"))
    return records.read_logs(spark, _named_files(spark, rows, ["host", "run"], lambda x: f"{x['host']}_{x['run']}.log")).drop("line_no")


@query("""SELECT CAST(hour(ts) AS INTEGER) AS experiment, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS system, 'Small_5K' AS dataset, 'Count' AS app, CAST(event_id AS INTEGER) AS run,
    CAST(user_id AS DOUBLE) AS elapsed_sec, CAST(event_id % 100 AS INTEGER) AS input_tuples, 3 AS output_lines, CAST(user_id AS DOUBLE) AS throughput_tuples_per_sec FROM events""")
def source_results(spark, sf_dir):
    runs = _runs(spark, sf_dir, "event_id").select("experiment", "system", F.col("event_id").alias("run"), "elapsed_sec", (F.col("event_id") % 100).alias("input_tuples"), F.lit(3).alias("output_lines"), "throughput_tuples_per_sec")
    return records.read_results(spark, _named_files(spark, runs, ["experiment", "system"], lambda x: f"exp{x['experiment']}_{x['system']}_Small_5K_Count.csv", "csv", header=True))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS client, count(*) AS n, count(*) AS last_seq, count(*) AS blocks FROM events GROUP BY 1")
def appended_files(spark, sf_dir):
    """Two clients' files appended to one log."""
    rows, paths = event_lines(spark, sf_dir), {}
    for k, client in enumerate("ab"):
        paths[client] = streams.working_dir(spark, "client")
        sinks.write_lines(rows.where(F.col("key").cast("long") % 2 == k), paths[client])
    log = appendlog.sequence_appends(multi_append(spark, paths).withColumn("file", F.lit("log")), "id")
    return log.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.max("seq").cast("long").alias("last_seq"), F.count_distinct("block").alias("blocks"))


@query(f"WITH {EV} SELECT key, value, id FROM ev")
def paced_lines(spark, sf_dir):
    """The saved rows by ranges, 20 batches of them."""
    out = streams.working_dir(spark, "paced")
    n = ranges.save_ranges(event_lines(spark, sf_dir), "id", f"{out}-saved")
    stream, trigger = ranges.paced(spark, f"{out}-saved", -(-n // 20) * 20, f"{out}-checkpoint", tasks=2, seconds=0.05)
    ranges.run_to_end(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(**trigger))
    return spark.read.parquet(out)


# ---- sinks


@query(f"WITH {EV} SELECT value FROM ev")
def sink_lines(spark, sf_dir):
    """Written twice: what was there is replaced."""
    out = streams.working_dir(spark, "values")
    for _ in range(2):
        sinks.write_lines(event_lines(spark, sf_dir), out)
    return spark.read.text(out)


@query(f"WITH {EV} SELECT value FROM ev")
def sink_append(spark, sf_dir):
    out = streams.working_dir(spark, "appended")
    sinks.append_stream(_stream(spark, sf_dir), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.text(out)


@query(f"WITH {EV} SELECT value, true AS wrote, false AS wrote_nothing FROM ev WHERE contains(value, 'user, 5')")
def sink_output(spark, sf_dir):
    out, rows = streams.working_dir(spark, "output"), event_lines(spark, sf_dir)
    wrote = sinks.output(lines.contains("user, 5")(rows), out)
    nothing = sinks.output(lines.contains("user, 8")(rows), f"{out}-none")
    return spark.read.text(out).select("value", F.lit(wrote).alias("wrote"), F.lit(nothing).alias("wrote_nothing"))


@query(f"WITH {EV}, {COUNTS} SELECT key || ': ' || n AS value FROM counts ORDER BY n DESC, key")
def sink_report(spark, sf_dir):
    out = streams.working_dir(spark, "report")
    sinks.save_report(aggregate.top(grep_counts(spark, sf_dir)).select(F.concat_ws(": ", "key", F.col("n").cast("string")).alias("value")), out)
    return spark.read.text(out)


# ---- own operators and stage arguments


@query(f"WITH {EV} SELECT key, unnest(string_split(value, ',')) AS value, id FROM ev")
def own_row_op(spark, sf_dir):
    """An operator of one's own that gives several rows a line."""
    register_row_op("split_commas", lambda b: b.assign(value=b.value.str.split(",")).explode("value"))
    return Pipeline(lambda s: event_lines(s, sf_dir), [("split_commas", {})]).frame(spark)


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value, CAST(count(*) AS VARCHAR) AS id FROM events GROUP BY 1")
def own_keyed_op(spark, sf_dir):
    """An operator of one's own with state over a key's lines, flushed at their end."""

    def newest(b):
        return b.head(1).assign(value=str(b.id.astype("int64").max()), id=str(len(b)))

    register_keyed_op("newest", newest)
    users = F.col("user_id").cast("string")
    rows = _t(spark, sf_dir, "events").select(users.alias("key"), users.alias("value"), F.col("event_id").cast("string").alias("id"))
    return Pipeline(lambda s: rows, [("newest", {})]).frame(spark)


@query(ORACLE["own_keyed_op"])
def own_state_op(spark, sf_dir):
    """The same from a state that tasks merge, so that no key's lines meet."""
    add = lambda s, row: (max(s[0], int(row["id"])), s[1] + 1)
    register_state_op("newest_merged", lambda: (0, 0), add, lambda a, b: (max(a[0], b[0]), a[1] + b[1]), lambda key, s: [(key, str(s[0]), str(s[1]))])
    users = F.col("user_id").cast("string")
    rows = _t(spark, sf_dir, "events").select(users.alias("key"), users.alias("value"), F.col("event_id").cast("string").alias("id"))
    return Pipeline(lambda s: rows, [("newest_merged", {})]).frame(spark)


@query(f"WITH {EV} SELECT coalesce({FIELDS}[2], '') AS key, regexp_extract(value, '^([^,]*,\"[^\"]*\")', 1) AS value, id FROM ev WHERE regexp_matches(value, 'user, [25]')")
def stage_arguments(spark, sf_dir):
    """Arguments by position and by name."""
    return Pipeline(lambda s: event_lines(s, sf_dir), [("grep", ["user, [25]", 2]), ("transform", {"n": 2})]).frame(spark)


@query(f"WITH {EV} SELECT coalesce({FIELDS}[3], '') AS key, count(*) AS n FROM ev GROUP BY 1")
def repartitioned_count(spark, sf_dir):
    return Pipeline(lambda s: event_lines(s, sf_dir), [("key_by", [3]), ("repartition", {"n": 4}), ("count", {})]).frame(spark).select("key", "n")


# ---- reconciliation


@query("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return reconcile.duplicates(_t(spark, sf_dir, "events"), ["user_id", "event_type"])


_ACTUAL = "a AS (SELECT key, n + CASE WHEN key = 'click' THEN 1 ELSE 0 END AS actual FROM counts WHERE key <> 'view' UNION ALL SELECT 'extra', 3)"


def _both_counts(spark, sf_dir):
    expected = grep_counts(spark, sf_dir)
    actual = expected.where("key <> 'view'").select("key", (F.col("n") + F.when(F.col("key") == "click", 1).otherwise(0)).alias("n"))
    return actual.union(actual.agg(F.lit("extra").alias("key"), F.lit(3).cast("long").alias("n"))), expected


@query(f"""WITH {EV}, {COUNTS}, {_ACTUAL} SELECT coalesce(a.key, c.key) AS key, CAST(actual AS VARCHAR) AS actual, CAST(n AS VARCHAR) AS expected, actual IS NOT DISTINCT FROM n AS ok FROM a FULL JOIN counts c ON a.key = c.key""")
def reconcile_counts(spark, sf_dir):
    return _as_text(reconcile.reconcile(*_both_counts(spark, sf_dir)), "actual", "expected")


@query(f"""WITH {EV}, {COUNTS}, {_ACTUAL}, r AS (SELECT actual, n AS expected, actual IS NOT DISTINCT FROM n AS ok FROM a FULL JOIN counts c ON a.key = c.key)
    SELECT CAST(coalesce(sum(actual), 0) AS BIGINT) AS actual, CAST(coalesce(sum(expected), 0) AS BIGINT) AS expected, count(*) FILTER (NOT ok) AS wrong_keys, coalesce(bool_and(ok), true) AS passed FROM r""")
def reconcile_totals(spark, sf_dir):
    return reconcile.reconcile_totals(reconcile.reconcile(*_both_counts(spark, sf_dir)))


@query("SELECT m AS actual, n AS expected, n - m <= greatest(5, n // 200) AS passed FROM (SELECT count(*) AS n, count(*) FILTER (event_id % 1000 <> 7) AS m FROM events)")
def tolerance_check(spark, sf_dir):
    """A copy that lost a row in a thousand."""
    ev = _t(spark, sf_dir, "events").select("event_id")
    return reconcile.row_count_check(ev.where("event_id % 1000 <> 7"), ev)


@query("SELECT conv_id, turn, 'first' AS only_in FROM conversations WHERE turn % 3 = 0 AND turn % 5 <> 1 UNION ALL SELECT conv_id, turn, 'second' FROM conversations WHERE turn % 5 = 1 AND turn % 3 <> 0")
def same_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    return reconcile.same_rows(rows, rows.where("turn % 3 <> 0").union(rows.where("turn % 5 = 1")))


@query(ORACLE["same_rows"])
def same_rows_tree(spark, sf_dir):
    """The same by a tree of digests."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    return hashtree.tree_difference(rows, rows.where("turn % 3 <> 0").union(rows.where("turn % 5 = 1")))


# ---- streams


@query(f"WITH {EV} SELECT key, value, id FROM ev")
def dedup_ids(spark, sf_dir):
    rows = event_lines(spark, sf_dir)
    return lines.dedup()(rows.union(rows))


@query(f"WITH {EV} SELECT key, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'first ' || value ELSE value END AS value, id, CAST(CAST(id AS BIGINT) % 2 AS INTEGER) AS at FROM ev")
def dedup_first(spark, sf_dir):
    """Copies that differ: the earliest of each id stays."""
    rows = event_lines(spark, sf_dir)
    earlier = rows.where(F.col("id").cast("long") % 2 == 0).withColumn("value", F.concat(F.lit("first "), "value")).withColumn("at", F.lit(0))
    return lines.dedup(order="at")(rows.withColumn("at", F.lit(1)).union(earlier).union(rows.withColumn("at", F.lit(2))))


def _stream(spark, sf_dir) -> DataFrame:
    own = F.regexp_extract("value", r"^(\d+)", 1)
    return read_lines_stream(spark, _as_files(spark, sf_dir), own, max_files=2)


@query(f"WITH {EV}, {COUNTS} SELECT key, n FROM counts")
def stream_grep_count(spark, sf_dir):
    out = streams.working_dir(spark, "counts")
    streams.run_counts(streams.running_count(lines.grep("user, [0-4]", 3)(_stream(spark, sf_dir))), out, f"{out}-checkpoint")
    return read_snapshot(spark, out)


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS key FROM documents), c AS (SELECT key, count(*) AS n FROM w GROUP BY 1)
    SELECT key, n, true AS within FROM c WHERE n * 201 > (SELECT count(*) FROM w)""")
def stream_heavy_keys(spark, sf_dir):
    """Words with more than a 201st of all words, which 200 counters can't miss, and whether the stream's bounds hold their counts."""
    out, path = streams.working_dir(spark, "heavy"), streams.working_dir(spark, "rows")
    _words(spark, sf_dir, 8).write.option("maxRecordsPerFile", 2_000_000).parquet(path)
    quarter = -(-len(spark.read.schema("key string").parquet(path).inputFiles()) // 4)  # 2 files of 8: batches grow, not their number
    heavy_stream.run_heavy(spark.readStream.schema("key string").option("maxFilesPerTrigger", quarter).parquet(path), out, f"{out}-checkpoint", capacity=200)
    rows = spark.read.parquet(path)
    bounds = heavy_stream.read_heavy(spark, out)
    counts = aggregate.count_by_key(rows).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("all")))).where("n * 201 > all")
    return counts.join(bounds, "key", "left").select("key", "n", F.coalesce(F.col("n").between(F.col("at_least"), F.col("at_most")), F.lit(False)).alias("within"))


@query(f"WITH {EV} SELECT value, id FROM ev")
def stream_dedup(spark, sf_dir):
    """Every line twice, in two sets of files; each id comes out once."""
    out, path = streams.working_dir(spark, "dedup"), _as_files(spark, sf_dir)
    event_lines(spark, sf_dir).select("value").repartition(2, "value").write.mode("append").text(path)
    stream = read_lines_stream(spark, path, F.regexp_extract("value", r"^(\d+)", 1), max_files=3)
    streams.run_stream(stream.select("value", "id"), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query(f"WITH {EV} SELECT value, id FROM ev UNION ALL SELECT value, NULL FROM ev WHERE contains(value, 'user, 6')")
def stream_dedup_expiring(spark, sf_dir):
    """Every line twice, and some twice without ids; ids are remembered for an hour."""
    out, path = streams.working_dir(spark, "expiring"), streams.working_dir(spark, "lines")
    rows = event_lines(spark, sf_dir).select("value", "id")
    some = rows.where(F.col("value").contains("user, 6")).withColumn("id", F.lit(None).cast("string"))
    rows.union(some).write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)
    expiring.run_expiring(stream, out, f"{out}-checkpoint", 3600)
    return spark.read.parquet(out)


@query("""SELECT CAST(conv_id AS VARCHAR) AS file, role AS client, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS seq,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS block FROM conversations""")
def stream_sequence(spark, sf_dir):
    """Appends that arrive in three batches, by turns."""
    out, path = streams.working_dir(spark, "sequenced"), streams.working_dir(spark, "appends")
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("client"), "turn")
    for part in (rows.where("turn < 2"), rows.where("turn >= 2 and turn < 4"), rows.where("turn >= 4")):
        part.write.mode("append").parquet(path)
        run_sequenced(spark.readStream.schema(rows.schema).parquet(path), "turn", out, f"{out}-checkpoint")
    return read_snapshot(spark, out)


@query(f"WITH {EV} SELECT value, count(*) * 2 AS n FROM ev GROUP BY value")
def stream_without_ids(spark, sf_dir):
    """Lines that carry no id are all kept, repeats too."""
    out, path = streams.working_dir(spark, "anonymous"), _as_files(spark, sf_dir)
    event_lines(spark, sf_dir).select("value").write.mode("append").text(path)
    streams.run_stream(read_lines_stream(spark, path, max_files=3), out, f"{out}-checkpoint")
    return spark.read.parquet(out).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT value, id FROM ev")
def stream_recovery(spark, sf_dir):
    """A job stopped after half of its files goes on from its checkpoint, which knows the ids it has seen."""
    out, path, rows = streams.working_dir(spark, "recovery"), streams.working_dir(spark, "lines"), event_lines(spark, sf_dir).select("value")
    own = F.regexp_extract("value", r"^(\d+)", 1)
    for some in (rows.where("xxhash64(value) % 2 = 0"), rows):
        some.write.mode("append").text(path)
        streams.run_stream(read_lines_stream(spark, path, own).select("value", "id"), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query(f"WITH {EV} SELECT {FIRST3} || ' processed' AS value FROM ev WHERE contains(value, 'user, 2')")
def stream_pipeline(spark, sf_dir):
    out = streams.working_dir(spark, "pipeline")
    made = Pipeline(lambda s: _stream(s, sf_dir), [("contains", ["user, 2"]), ("transform", {}), ("echo", {})]).frame(spark)
    streams.run_stream(made.select("value"), out, f"{out}-checkpoint", "at_least_once")
    return spark.read.parquet(out)


# ---- metrics: user_id is the task, which two jobs share


_JOB = "'job' || (event_id % 2)"


def _with_jobs(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.concat(F.lit("job"), F.col("event_id") % 2).alias("job"), F.col("user_id").cast("string").alias("task_id"), "event_id", "user_id", "ts")


def _samples(spark, sf_dir) -> DataFrame:
    return _with_jobs(spark, sf_dir).select("job", "task_id", "ts", F.col("event_id").alias("tuples_processed"), (F.col("user_id") % 11).cast("double").alias("current_rate"))


def _tasks(spark, sf_dir) -> DataFrame:
    return _with_jobs(spark, sf_dir).groupBy("job", "task_id").agg((F.max("user_id") % 3).alias("stage"), F.min("ts").alias("started_at")).withColumn("state", F.lit("running"))


@query(f"""WITH p AS (SELECT {_JOB} AS job, CAST(user_id AS VARCHAR) AS task_id, date_trunc('second', ts) AS second, CAST(sum(event_id % 100) AS BIGINT) AS in_second FROM events GROUP BY 1, 2, 3),
    s AS (SELECT {_JOB} AS job, CAST(user_id AS VARCHAR) AS task_id, date_trunc('second', min(ts)) AS started FROM events GROUP BY 1, 2)
    SELECT job, task_id, epoch_us(second) AS second_us, in_second, CAST(sum(in_second) OVER w AS BIGINT) AS total,
        in_second / coalesce(date_diff('second', lag(second) OVER w, second), 1)::DOUBLE AS rate,
        CASE WHEN date_diff('second', started, second) = 0 THEN NULL ELSE CAST(sum(in_second) OVER w AS DOUBLE) / date_diff('second', started, second) END AS average
    FROM p JOIN s USING (job, task_id) WINDOW w AS (PARTITION BY job, task_id ORDER BY second)""")
def task_rates(spark, sf_dir):
    samples = _with_jobs(spark, sf_dir).select("job", "task_id", "ts", (F.col("event_id") % 100).alias("tuples"))
    out = metrics.task_rates(samples, _tasks(spark, sf_dir))
    return out.withColumn("second_us", F.unix_micros(F.col("second").cast("timestamp"))).drop("second")


@query(f"""WITH r AS (SELECT {_JOB} AS job, user_id, ts, event_id, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY ts DESC, event_id) AS k FROM events)
    SELECT job, CAST(user_id AS VARCHAR) AS task_id, epoch_us(ts) AS us, event_id AS tuples_processed FROM r WHERE k = 1""")
def latest_metrics(spark, sf_dir):
    return metrics.latest_metrics(_samples(spark, sf_dir)).select("job", "task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "tuples_processed")


@query(f"""WITH r AS (SELECT {_JOB} AS job, user_id, event_id, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY ts DESC, event_id) AS k FROM events)
    SELECT job, user_id % 3 AS stage, count(*) AS tasks, CAST(sum(user_id % 11) AS DOUBLE) AS rate, CAST(sum(event_id) AS BIGINT) AS tuples FROM r WHERE k = 1 AND user_id % 5 <> 0 GROUP BY 1, 2""")
def stage_rollup(spark, sf_dir):
    """Tasks that the table of tasks lacks are left out."""
    return metrics.stage_rollup(metrics.latest_metrics(_samples(spark, sf_dir)), _tasks(spark, sf_dir).where("cast(task_id as long) % 5 <> 0"))


@query(f"SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY {US} RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) / 3600.0 AS flow FROM events")
def flow_rate(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), "ts", F.col("user_id").alias("size"))
    return metrics.flow_rate(ev, seconds=3600).select("event_id", F.col("flow").cast("double").alias("flow"))


@query("""WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS job, user_id % 12 AS task, CAST(floor((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 60000000) AS BIGINT) AS second, event_id AS tuples, CAST(user_id % 23 AS DOUBLE) AS rate FROM events),
    l AS (SELECT job, second, task % 4 AS stage, task, max(tuples) AS tuples, arg_max(rate, tuples) AS rate FROM m WHERE task % 4 > 0 GROUP BY ALL),
    s AS (SELECT job, second, stage, count(*) AS n, sum(rate) / count(*) AS average FROM l WHERE tuples > 0 GROUP BY ALL HAVING sum(tuples) >= 50)
    SELECT job, second, stage, n, average, CASE WHEN average > 12 THEN 'up' ELSE 'down' END AS action FROM s WHERE average > 12 OR average < 8 AND n > 1""")
def scaling_decisions(spark, sf_dir):
    """Days as jobs, their minutes as seconds."""
    day = F.date_trunc("day", "ts")
    at = F.timestamp_seconds(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / 60_000_000))
    rows = _t(spark, sf_dir, "events").select(F.date_format(day, "yyyy-MM-dd").alias("job"), (F.col("user_id") % 12).cast("string").alias("task_id"), at.alias("ts"), F.col("event_id").alias("tuples_processed"), (F.col("user_id") % 23).cast("double").alias("current_rate"))
    tasks = rows.groupBy("job", "task_id").agg(F.min("ts").alias("started_at")).withColumn("stage", F.col("task_id").cast("long") % 4).withColumn("state", F.lit("running"))
    return metrics.scaling_decisions(rows, tasks, 8.0, 12.0)


_TASK_EVENTS = "t AS (SELECT user_id % 20 AS job, user_id AS task_id, CASE event_id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'restart' ELSE 'failed' END AS event, ts FROM events)"


def _task_events(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("start", "end", "restart", "failed")]), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("job"), F.col("user_id").alias("task_id"), kind.alias("event"), "ts")


@query(f"""WITH {_TASK_EVENTS}, o AS (SELECT job, task_id, event, min(ts) AS ts FROM t WHERE event <> 'restart' GROUP BY ALL UNION ALL SELECT job, task_id, event, ts FROM t WHERE event = 'restart'),
    j AS (SELECT job, min(ts) FILTER (event = 'start') AS a, max(ts) FILTER (event = 'end') AS b, count(*) FILTER (event = 'start') AS expected, count(*) FILTER (event = 'end') AS completed,
        count(*) FILTER (event = 'restart') AS restarts, count(*) FILTER (event = 'failed') AS failures FROM o GROUP BY job)
    SELECT job, CAST(epoch_us(a) AS VARCHAR) AS started_us, CAST(epoch_us(b) AS VARCHAR) AS ended_us, expected, completed, restarts, failures,
        CASE WHEN completed >= expected AND expected > 0 THEN 'completed' ELSE 'running' END AS status,
        CASE WHEN completed >= expected AND expected > 0 THEN CAST(epoch_us(b) - epoch_us(a) AS VARCHAR) END AS duration_us FROM j""")
def job_timeline(spark, sf_dir):
    out = metrics.job_timeline(_task_events(spark, sf_dir))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = out.withColumn("started_us", us("started")).withColumn("ended_us", us("ended")).drop("started", "ended")
    return _as_text(out, "started_us", "ended_us", "duration_us")


@query(f"""WITH r AS (SELECT {_JOB} AS job, user_id, event_type, event_id, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT job, user_id AS task_id, event_type AS op, 'running' AS state, 'node' || (user_id % 5) AS host FROM r WHERE k = 1 AND event_id % 4 = 1""")
def task_list(spark, sf_dir):
    state = F.element_at(F.array(*[F.lit(x) for x in ("idle", "running", "failed", "completed")]), (F.col("event_id") % 4 + 1).cast("int"))
    job = F.concat(F.lit("job"), F.col("event_id") % 2)
    ev = _t(spark, sf_dir, "events").select(job.alias("job"), F.col("user_id").alias("task_id"), F.col("event_type").alias("op"), state.alias("state"), F.concat(F.lit("node"), F.col("user_id") % 5).alias("host"), "ts", F.col("event_id").alias("seq"))
    return metrics.task_list(ev, state="running").drop("ts")


# ---- logs: source is the host, doc_id the line number


def _logs(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("host"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("host_no"), F.col("doc_id").alias("line_no"), F.col("text").alias("line"))


@query("SELECT source AS host, doc_id AS line_no FROM documents WHERE regexp_matches(text, '(?i)LICENSED under')")
def log_search(spark, sf_dir):
    return logs.log_search(_logs(spark, sf_dir), "LICENSED under", ignore_case=True).select("host", "line_no")


@query("SELECT source AS host, doc_id AS line_no FROM documents WHERE regexp_matches(text, 'rights reserved|(?i:licensed) under')")
def log_search_indexed(spark, sf_dir):
    """Over lines saved with an index of their trigrams; either branch's blocks are read."""
    path = streams.working_dir(spark, "indexed")
    lineindex.build_index(_logs(spark, sf_dir), path, lines_per_block=50)
    return lineindex.indexed_search(spark, path, "rights reserved|(?i:licensed) under").select("host", "line_no")


@query("SELECT source AS host, doc_id AS line_no FROM documents WHERE contains(text, 'e |')")
def log_search_basic(spark, sf_dir):
    return logs.log_search(_logs(spark, sf_dir), "e |", extended=False).select("host", "line_no")


@query("SELECT source AS host, least(count(*), 30) AS matches FROM documents WHERE NOT regexp_matches(text, 'the|les') GROUP BY 1")
def log_count(spark, sf_dir):
    return logs.log_search(_logs(spark, sf_dir), "the|les", invert=True, count_only=True, max_count=30)


@query("SELECT source AS host, doc_id AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE regexp_matches(text, 'tion')) WHERE k <= 3")
def log_preview(spark, sf_dir):
    return logs.log_search(_logs(spark, sf_dir), "tion", max_count=3).select("host", "line_no")


_HOSTS = "h AS (SELECT DISTINCT source AS host, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS host_no FROM documents)"
_REPORT = f"""{_HOSTS}, m AS (SELECT source AS host, count(*) AS n, md5(array_to_string(list(text ORDER BY doc_id)[1:5], chr(10))) AS f FROM documents WHERE regexp_matches(text, 'rights reserved') GROUP BY 1),
    r AS (SELECT h.host, host_no, CASE WHEN host_no <> 3 THEN coalesce(n, 0) END AS matches, f AS first_lines, CASE WHEN host_no = 3 THEN 'unreachable' WHEN coalesce(n, 0) = 0 THEN 'No matches' ELSE 'ok' END AS status FROM h LEFT JOIN m ON h.host = m.host)"""


def _report(spark, sf_dir):
    """The report over whole lines; the lines themselves as a digest."""
    rows = _logs(spark, sf_dir)
    hosts = rows.select("host", "host_no").distinct().withColumn("reachable", F.col("host_no") != 3)
    return logs.log_report(rows, hosts, "rights reserved").withColumn("first_lines", F.md5("first_lines"))


@query(f"WITH {_REPORT} SELECT host, host_no, CAST(matches AS VARCHAR) AS matches, first_lines, status FROM r")
def log_report(spark, sf_dir):
    return _as_text(_report(spark, sf_dir), "matches")


@query(f"WITH {_REPORT} SELECT CAST(coalesce(sum(matches), 0) AS BIGINT) AS matches, count(*) FILTER (status <> 'unreachable') AS responding FROM r")
def log_totals(spark, sf_dir):
    return logs.report_totals(_report(spark, sf_dir))


_EVENT_NAME = "['TASK START', 'TASK END', 'TASK RESTART', 'TASK FAILED', 'RUN START', 'RUN END', 'UPSCALE TRIGGERED', 'DOWNSCALE TRIGGERED', 'nothing'][event_id % 9 + 1]"


def _event_logs(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (*logs.EVENTS, "nothing")])
    name = F.element_at(names, (F.col("event_id") % 9 + 1).cast("int"))
    text = F.concat(F.lit("2025/01/01 10:00:00 "), name, F.lit(": job=j"), F.col("user_id") % 5, F.lit(", task="), F.col("user_id"), F.lit(", stage="), F.col("user_id") % 3, F.lit(" rate="), F.col("event_id") % 50, F.lit(".5"))
    return _t(spark, sf_dir, "events").select(F.concat(F.lit("node"), F.col("user_id") % 4).alias("host"), F.col("event_id").alias("line_no"), text.alias("line"))


@query(f"""SELECT 'node' || (user_id % 4) AS host, event_id AS line_no, {_EVENT_NAME} AS event, 'j' || (user_id % 5) AS job, CAST(user_id AS VARCHAR) AS task,
    CAST(user_id % 3 AS INTEGER) AS stage, event_id % 50 + 0.5::DOUBLE AS rate FROM events WHERE event_id % 9 < 8""")
def event_extract(spark, sf_dir):
    return logs.parse_events(_event_logs(spark, sf_dir)).drop("fields")


@query(f"SELECT {_EVENT_NAME} AS event, count(*) AS n FROM events WHERE event_id % 9 < 8 GROUP BY 1")
def event_counts(spark, sf_dir):
    return logs.event_counts(logs.parse_events(_event_logs(spark, sf_dir)))


@query(f"SELECT event_id AS line_no, {_EVENT_NAME} AS event FROM events WHERE event_id % 9 IN (6, 7) ORDER BY event_id DESC LIMIT 10")
def last_samples(spark, sf_dir):
    return logs.last_samples(logs.parse_events(_event_logs(spark, sf_dir))).select("line_no", "event")


# ---- placement

_RING = "ring AS (SELECT list(struct_pack(h := left(sha256('node-' || n_nationkey), 16), node := 'node-' || n_nationkey) ORDER BY left(sha256('node-' || n_nationkey), 16)) AS r FROM nation WHERE {where})"
_PLACED = "{name} AS (SELECT 'doc-' || doc_id AS file, unnest(list_concat(list_filter(r, lambda x: x.h >= left(sha256('doc-' || doc_id), 16)), list_filter(r, lambda x: x.h < left(sha256('doc-' || doc_id), 16)))[1:3]).node AS node FROM documents, {ring})"


def _files(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file"))


def _nodes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.concat(F.lit("node-"), "n_nationkey").alias("node"), (F.col("n_nationkey") % 6 != 5).alias("alive"))


@query("SELECT doc_id, left(sha256('doc-' || doc_id), 16) AS ring, CAST('0x' || left(sha256('doc-' || doc_id), 16) AS UBIGINT)::DECIMAL(20,0)::VARCHAR AS number FROM documents")
def ring_ids(spark, sf_dir):
    ring = ring_id(F.concat(F.lit("doc-"), "doc_id"))
    return _t(spark, sf_dir, "documents").select("doc_id", ring.alias("ring"), ring_number(ring).cast("string").alias("number"))


@query(f"""WITH {_RING.format(where="n_nationkey % 6 <> 5")} SELECT file, rank, node FROM (SELECT 'doc-' || doc_id AS file, generate_subscripts(p, 1)::INTEGER - 1 AS rank, unnest(p).node AS node FROM
    (SELECT doc_id, list_concat(list_filter(r, lambda x: x.h >= left(sha256('doc-' || doc_id), 16)), list_filter(r, lambda x: x.h < left(sha256('doc-' || doc_id), 16)))[1:3] AS p FROM documents, ring))""")
def placement_of(spark, sf_dir):
    return placement.place(_files(spark, sf_dir), _nodes(spark, sf_dir)).select("file", "rank", "node")


@query(f"""WITH {_RING.format(where="true").replace("sha256", "sha1")} SELECT file, rank, node FROM (SELECT 'doc-' || doc_id AS file, generate_subscripts(p, 1)::INTEGER - 1 AS rank, unnest(p).node AS node FROM
    (SELECT doc_id, list_concat(list_filter(r, lambda x: x.h >= left(sha1('doc-' || doc_id), 16)), list_filter(r, lambda x: x.h < left(sha1('doc-' || doc_id), 16)))[1:3] AS p FROM documents, ring))""")
def placement_sha1(spark, sf_dir):
    """The SHA-1 ring holds nodes whether alive or not."""
    return placement.place(_files(spark, sf_dir), _nodes(spark, sf_dir), alive_only=False, algo="sha1").select("file", "rank", "node")


@query(f"""WITH {_RING.format(where="n_nationkey % 6 <> 5")}, ring2 AS (SELECT list_filter(r, lambda x: x.node <> 'node-7') AS r FROM ring),
    {_PLACED.format(name="a", ring="ring")}, {_PLACED.format(name="b", ring="ring2")}
    SELECT coalesce(a.file, b.file) AS file, coalesce(a.node, b.node) AS node, CASE WHEN a.file IS NULL THEN 'added' ELSE 'removed' END AS change
    FROM a FULL JOIN b ON a.file = b.file AND a.node = b.node WHERE a.file IS NULL OR b.file IS NULL""")
def movement(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return placement.placement_diff(_files(spark, sf_dir), nodes, nodes.where("node <> 'node-7'"))


@query(f"""WITH {_RING.format(where="n_nationkey % 6 <> 5")}, {_PLACED.format(name="e", ring="ring")},
    h AS (SELECT file, node FROM e WHERE CAST(substr(file, 5) AS BIGINT) % 7 <> 0 UNION ALL SELECT 'doc-' || doc_id, 'node-99' FROM documents WHERE doc_id % 11 = 0)
    SELECT file, node, 'copy' AS action FROM (SELECT * FROM e EXCEPT SELECT * FROM h) UNION ALL SELECT file, node, 'drop' FROM (SELECT * FROM h EXCEPT SELECT * FROM e)""")
def repair_plan(spark, sf_dir):
    due = placement.place(_files(spark, sf_dir), _nodes(spark, sf_dir)).select("file", "node")
    number = F.substring("file", 5, 20).cast("long")
    held = due.where(number % 7 != 0).union(_files(spark, sf_dir).where(number % 11 == 0).select("file", F.lit("node-99").alias("node")))
    return placement.repair_plan(due, held)


# ---- append logs: conversation is the file, role the client


def _blocks(spark, sf_dir) -> DataFrame:
    """Blocks on two nodes that overlap, as replicas hold them."""
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("client"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return rows.where("seq % 3 <> 0").withColumn("node", F.lit("a")).union(rows.where("seq % 3 <> 1").withColumn("node", F.lit("b")))


_BLOCKS = "bl AS (SELECT CAST(conv_id AS VARCHAR) AS file, role AS client, turn AS seq, text AS content, 'a' AS node FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT CAST(conv_id AS VARCHAR), role, turn, text, 'b' FROM conversations WHERE turn % 3 <> 1)"
_MERGED = f"{_BLOCKS}, o AS (SELECT file, client, seq, min_by(content, sha1(content)) AS content, count(*) AS copies, min(sha1(content)) <> max(sha1(content)) AS conflict FROM bl GROUP BY 1, 2, 3), mg AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY client, seq) AS block FROM o)"


@query("""SELECT CAST(conv_id AS VARCHAR) AS file, role AS client, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS seq,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS block FROM conversations""")
def append_sequence(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("client"), "turn")
    return appendlog.sequence_appends(rows, "turn")


@query(f"WITH {_MERGED} SELECT file, CAST(block AS INTEGER) AS block, client, seq, content, copies, conflict FROM mg")
def merge_replicas(spark, sf_dir):
    return appendlog.merge_replicas(_blocks(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT file, CAST(0 AS BIGINT) AS part, string_agg(content, '' ORDER BY block) AS content FROM mg GROUP BY file")
def assemble(spark, sf_dir):
    return appendlog.assemble(appendlog.merge_replicas(_blocks(spark, sf_dir)))


@query(f"WITH {_BLOCKS} SELECT node, file, client, seq, CAST(octet_length(encode(content)) AS INTEGER) AS size, sha1(content) AS sha1 FROM bl")
def checksums(spark, sf_dir):
    return appendlog.checksum(_blocks(spark, sf_dir)).select("node", "file", "client", "seq", "size", "sha1")


@query(f"WITH {_BLOCKS} SELECT node, file, count(*) AS blocks, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, max(seq) AS last_seq FROM bl GROUP BY 1, 2")
def inventory(spark, sf_dir):
    return appendlog.inventory(_blocks(spark, sf_dir))


@query(f"WITH {_BLOCKS}, l AS (SELECT file, client, max(seq) AS seq FROM bl GROUP BY 1, 2) SELECT file, string_agg(client || '=' || seq, ',' ORDER BY client) AS clients FROM l GROUP BY file")
def client_progress(spark, sf_dir):
    shown = F.array_join(F.transform(F.map_entries("clients"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return appendlog.client_progress(_blocks(spark, sf_dir)).select("file", shown.alias("clients"))


@query(f"WITH {_BLOCKS} SELECT file, CAST(0 AS BIGINT) AS part, string_agg(content, '' ORDER BY client, seq) AS content FROM bl WHERE node = 'b' GROUP BY file")
def replica_copy(spark, sf_dir):
    return appendlog.replica_copy(_blocks(spark, sf_dir), "b")


@query(f"""WITH {_BLOCKS.replace("turn AS seq", "row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS seq").replace("role, turn, text, 'b'", "role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn), text, 'b'").replace("FROM conversations WHERE turn % 3 <> 0", "FROM conversations QUALIFY seq % 3 <> 0").replace("FROM conversations WHERE turn % 3 <> 1", "FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) % 3 <> 1")},
    o AS (SELECT file, client, seq, min_by(content, sha1(content)) AS content, count(*) AS copies, min(sha1(content)) <> max(sha1(content)) AS conflict FROM bl GROUP BY 1, 2, 3)
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY client, seq) AS INTEGER) AS block, client, seq, content, copies, conflict FROM o""")
def merge_incremental(spark, sf_dir):
    """Replicas that come in three batches, with gaps in between, merged as they come."""
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("client"), "turn", F.col("text").alias("content"))
    rows = appendlog.sequence_appends(rows, "turn").withColumn("seq", F.col("seq").cast("long")).drop("turn", "block")
    held = rows.where("seq % 3 <> 0").withColumn("node", F.lit("a")).union(rows.where("seq % 3 <> 1").withColumn("node", F.lit("b")))
    path = streams.working_dir(spark, "merged")
    for k in range(3):
        mergedlog.merge_batch(held.where(F.pmod(F.xxhash64("client", "seq", "node"), F.lit(3)) == k), path, k)
    return mergedlog.merged_blocks(spark, path)


@query(f"""WITH {_BLOCKS}, a AS (SELECT file, client, seq, sha1(content) AS sha1 FROM bl WHERE node = 'a'), b AS (SELECT file, client, seq, sha1(content) AS sha1 FROM bl WHERE node = 'b')
    SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def replica_difference(spark, sf_dir):
    return hashtree.replica_difference(_blocks(spark, sf_dir), "a", "b")


@query(f"""WITH {_BLOCKS}, d AS (SELECT file, node, string_agg(client || ':' || seq || ':' || content, ',' ORDER BY client, seq) AS c FROM bl GROUP BY 1, 2)
    SELECT file, count(DISTINCT c) AS versions FROM d GROUP BY file HAVING count(DISTINCT c) > 1""")
def divergent_files(spark, sf_dir):
    return appendlog.divergent_files(_blocks(spark, sf_dir))


# ---- fleet: user_id is the member


_AS_OF = "(SELECT max(ts) FROM events)"


def _beats(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), "ts")


def _now(spark, sf_dir):
    return F.lit(_t(spark, sf_dir, "events").agg(F.max("ts")).first()[0])


@query(f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS id, (epoch_us({_AS_OF}) - epoch_us(max(ts))) / 1000000.0 AS age FROM events GROUP BY 1)
    SELECT id, age, CASE WHEN age > 10800 THEN 'Failed' WHEN age > 3600 THEN 'Suspected' ELSE 'Alive' END AS state FROM a""")
def liveness(spark, sf_dir):
    return fleet.liveness(_beats(spark, sf_dir), _now(spark, sf_dir), t_fail=7200.0, t_suspect=3600.0).select("id", "age", "state")


_MEMBERS = """cur AS (SELECT CAST(user_id AS VARCHAR) AS id, 'host' || (user_id % 40) AS host, CAST(8000 + user_id % 3 AS INTEGER) AS port, min(event_id) AS version, max(ts) AS ts, count(*) AS counter,
    CASE user_id % 4 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Suspected' ELSE 'Alive' END AS state FROM events GROUP BY user_id)"""
_KNOWN = _MEMBERS.replace("GROUP BY user_id", "WHERE user_id % 5 <> 0 GROUP BY user_id")
_INCOMING = """inc AS (SELECT CAST(user_id AS VARCHAR) AS id, 'host' || (user_id % 40) AS host, CAST(CASE WHEN user_id % 9 = 0 THEN 0 ELSE 8000 + user_id % 3 END AS INTEGER) AS port, min(event_id) AS version, min(ts) AS ts,
    count(*) + user_id % 3 - 1 AS counter, CASE user_id % 3 WHEN 0 THEN 'Failed' ELSE 'Alive' END AS state FROM events WHERE user_id % 7 <> 0 GROUP BY user_id)"""


def _members(spark, sf_dir) -> DataFrame:
    state = F.when(F.col("user_id") % 4 == 0, "Failed").when(F.col("user_id") % 4 == 1, "Suspected").otherwise("Alive")
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("version"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("counter"))
    return rows.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("host"), F.col("user_id") % 40).alias("host"), (F.col("user_id") % 3 + 8000).cast("int").alias("port"), "version", "ts", "counter", state.alias("state"))


def _known(spark, sf_dir) -> DataFrame:
    """Members without some, so that there are unknown ones."""
    return _members(spark, sf_dir).where("cast(id as long) % 5 <> 0")


def _incoming(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "events").where("user_id % 7 <> 0").groupBy("user_id").agg(F.min("event_id").alias("version"), F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    port = F.when(F.col("user_id") % 9 == 0, 0).otherwise(F.col("user_id") % 3 + 8000).cast("int")
    return rows.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("host"), F.col("user_id") % 40).alias("host"), port.alias("port"), "version", "ts", (F.col("n") + F.col("user_id") % 3 - 1).alias("counter"), F.when(F.col("user_id") % 3 == 0, "Failed").otherwise("Alive").alias("state"))


def _shown(members: DataFrame) -> DataFrame:
    return members.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query(f"""WITH {_KNOWN}, {_INCOMING}, j AS (SELECT cur AS a, inc AS b FROM cur FULL JOIN (SELECT * FROM inc WHERE port <> 0) inc ON cur.id = inc.id WHERE cur.id IS NOT NULL OR inc.state <> 'Failed'),
    m AS (SELECT CASE WHEN a IS NULL OR a.id IS NULL OR coalesce(b.state = 'Failed' AND a.state <> 'Failed', false) OR coalesce(b.counter > a.counter, false) THEN b ELSE a END AS m FROM j)
    SELECT m.id, m.host, m.port, m.version, epoch_us(m.ts) AS ts, m.counter, m.state FROM m""")
def merge_members(spark, sf_dir):
    return _shown(fleet.merge_members(_known(spark, sf_dir), _incoming(spark, sf_dir)))


@query(f"WITH {_MEMBERS} SELECT id, state FROM cur WHERE NOT (state = 'Failed' AND epoch_us({_AS_OF}) - epoch_us(ts) > 3600000000)")
def purge_failed(spark, sf_dir):
    return fleet.purge_failed(_members(spark, sf_dir), _now(spark, sf_dir), 3600.0).select("id", "state")


@query(f"WITH {_MEMBERS} SELECT host, port, id, version FROM (SELECT *, row_number() OVER (PARTITION BY host, port ORDER BY version DESC, id) AS k FROM cur) WHERE k = 1")
def latest_incarnation(spark, sf_dir):
    return fleet.latest_incarnation(_members(spark, sf_dir)).select("host", "port", "id", "version")


@query(f"""WITH {_KNOWN}, b AS (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1)
    SELECT cur.id, counter + CASE WHEN state <> 'Failed' THEN coalesce(n, 0) ELSE 0 END AS counter, state FROM cur LEFT JOIN b ON cur.id = b.id""")
def heartbeats(spark, sf_dir):
    return fleet.apply_heartbeats(_known(spark, sf_dir), _beats(spark, sf_dir)).select("id", "counter", "state")


@query(f"WITH {_MEMBERS} SELECT id, left(sha256(id), 16) AS ring FROM cur WHERE state = 'Alive' ORDER BY ring")
def members_by_ring(spark, sf_dir):
    return fleet.members_by_ring(_members(spark, sf_dir)).select("id", "ring")


@query(f"WITH {_MEMBERS} SELECT id, host, port FROM cur WHERE state <> 'Failed' ORDER BY host, port")
def members_by_host(spark, sf_dir):
    return fleet.members_by_host(_members(spark, sf_dir)).select("id", "host", "port")


# ---- benchmark summaries: the hour is the experiment, the kind of event the system


_RUNS = "r AS (SELECT hour(ts) AS experiment, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS system, CAST(user_id AS DOUBLE) AS x FROM events)"


def _runs(spark, sf_dir, *more: str) -> DataFrame:
    system = F.when(F.col("event_id") % 2 == 0, "first").otherwise("second")
    x = F.col("user_id").cast("double")
    return _t(spark, sf_dir, "events").select(F.hour("ts").cast("long").alias("experiment"), system.alias("system"), x.alias("throughput_tuples_per_sec"), x.alias("elapsed_sec"), *more)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""WITH {_RUNS}, s AS (SELECT experiment, avg(x) FILTER (system = 'first') AS a, stddev_samp(x) FILTER (system = 'first') AS sa, avg(x) FILTER (system = 'second') AS b, stddev_samp(x) FILTER (system = 'second') AS sb FROM r GROUP BY 1)
    SELECT experiment, round(a, 6) AS mean_1, round(sa, 6) AS std_1, round(b, 6) AS mean_2, round(sb, 6) AS std_2, CASE WHEN a > b OR b IS NULL THEN 'first' ELSE 'second' END AS winner FROM s""")
def bench_summary(spark, sf_dir):
    return _rounded(aggregate.bench_summary(_runs(spark, sf_dir)), "mean_1", "std_1", "mean_2", "std_2")


@query(f"WITH {_RUNS} SELECT experiment, system, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM r GROUP BY 1, 2")
def elapsed_summary(spark, sf_dir):
    return _rounded(aggregate.elapsed_summary(_runs(spark, sf_dir)), "mean", "std")


@query()
def skew_report(spark, sf_dir):
    return aggregate.skew_report(_t(spark, sf_dir, "events"), "user_id", 16)


@query("SELECT CAST(16 AS BIGINT) AS buckets, CAST(count(*) AS BIGINT) AS rows, count(*) / 16.0::DOUBLE AS fair_share, true AS low_under_half FROM events")
def skew_totals(spark, sf_dir):
    """What holds of the report whatever the hash."""
    low = F.bool_and(F.col("low") == (F.col("rows") * 2 < F.col("fair_share")))
    return skew_report(spark, sf_dir).agg(F.count(F.lit(1)).alias("buckets"), F.sum("rows").alias("rows"), F.max("fair_share").alias("fair_share"), low.alias("low_under_half"))
