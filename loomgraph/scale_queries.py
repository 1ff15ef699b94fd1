"""Queries of joins, windows, searches and aggregates that must hold on large tables with hot keys, over the tables that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import operators as op
from . import sources as io
from .query_base import query, table
from .storage import state_path, store
from .streaming import dedup_stream, run_stream, session_stream, similarity_stream, use_rocks, windowed_counts

#: Orders as visits in January 2024, when the events are: each begins at a minute its key decides and lasts for minutes to days.
_VISITS = """v AS (SELECT o_orderkey, o_custkey AS user_id, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey * 37 % 43200)::INT) AS begins,
  TIMESTAMP '2024-01-01' + to_minutes((o_orderkey * 37 % 43200 + CASE WHEN o_orderkey % 100 = 0 THEN 5000 ELSE o_orderkey % 90 END)::INT) AS ends FROM orders)"""


def _visits(spark, sf_dir):
    at = lambda minutes: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({minutes} as int))")
    begins, lasts = "(o_orderkey * 37 % 43200)", "(case when o_orderkey % 100 = 0 then 5000 else o_orderkey % 90 end)"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), at(begins).alias("begins"), at(f"{begins} + {lasts}").alias("ends"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


@query(f"WITH {_VISITS} SELECT o_orderkey, v.user_id, event_id, event_type FROM v LEFT JOIN events e ON e.user_id = v.user_id AND e.ts <= begins QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def asof_latest_event(spark, sf_dir):
    """For every order the user's latest event before it."""
    found = op.asof_join(_visits(spark, sf_dir), _events(spark, sf_dir), "begins", "ts", ["user_id"], tie=["event_id"])
    return found.select("o_orderkey", "user_id", "event_id", "event_type")


@query("""SELECT l.event_id, l.event_type, CASE WHEN r.ts <= l.ts + INTERVAL 40 MINUTE THEN r.event_id END AS error_id FROM (FROM events WHERE event_type <> 'error') l
LEFT JOIN (FROM events WHERE event_type = 'error') r ON r.event_id % 3 = l.event_id % 3 AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 40 MINUTE
QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts NULLS LAST, r.event_id) = 1""")
def asof_next_error(spark, sf_dir):
    """For every other event the next error of its third within 40 minutes: three keys, each of a third of the rows."""
    events = _events(spark, sf_dir).withColumn("third", F.col("event_id") % 3)
    errors = events.where("event_type = 'error'").select("third", "ts", F.col("event_id").alias("error_id"))
    found = op.asof_join(events.where("event_type <> 'error'"), errors, "ts", "ts", ["third"], "forward", exact=False, tolerance=F.expr("interval 40 minutes"))
    return found.select("event_id", "event_type", "error_id")


@query(f"WITH {_VISITS} SELECT o_orderkey, event_id FROM v JOIN events e ON e.user_id = v.user_id AND ts BETWEEN begins AND ends")
def interval_events_of_visits(spark, sf_dir):
    """The events of a user's visits."""
    return op.interval_join(_visits(spark, sf_dir), _events(spark, sf_dir).drop("value"), ("begins", "ends"), ("ts", "ts"), ["user_id"]).select("o_orderkey", "event_id")


@query(f"WITH {_VISITS} SELECT o_orderkey, event_id FROM v JOIN events ON ts BETWEEN begins AND ends WHERE event_type = 'error' AND o_orderkey % 100 <> 0 AND o_orderkey % 90 < 5")
def range_visits_with_errors(spark, sf_dir):
    """Which short visits, anybody's, saw which errors: a join by range alone."""
    visits = _visits(spark, sf_dir).where("o_orderkey % 100 <> 0 and o_orderkey % 90 < 5")
    return op.interval_join(_events(spark, sf_dir).where("event_type = 'error'"), visits, ("ts", "ts"), ("begins", "ends")).select("o_orderkey", "event_id")


@query(f"""WITH {_VISITS}, w AS (FROM v WHERE o_orderkey % 100 = 0) SELECT w.o_orderkey, v.o_orderkey AS other FROM w JOIN v ON v.begins < w.ends AND w.begins < v.ends AND v.begins < v.ends AND w.user_id % 40 = v.user_id % 40""")
def overlapping_visits(spark, sf_dir):
    """Long visits and those of a fortieth of the users that they overlap: wide intervals against narrow ones, ends apart."""
    visits = _visits(spark, sf_dir).withColumn("part", F.col("user_id") % 40)
    found = op.interval_join(visits.where("o_orderkey % 100 = 0"), visits, ("begins", "ends"), ("begins", "ends"), ["part"], closed=False)
    return found.select("o_orderkey", F.col("o_orderkey_rhs").alias("other"))


@query("SELECT event_id, event_type, (sum(value::DECIMAL(12, 2)) OVER w)::DOUBLE AS total, count(*) OVER w AS nth FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf_dir):
    """Running sums per type of event: five keys, each of a fifth of the rows."""
    rows = op.running(_events(spark, sf_dir), ["event_type"], ["ts", "event_id"], {"total": F.col("value").cast("decimal(12,2)"), "nth": F.lit(1)})
    return rows.select("event_id", "event_type", F.col("total").cast("double").alias("total"), F.col("nth").cast("long").alias("nth"))


_SESSIONS = """WITH m AS (SELECT {key} AS key, event_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL {gap} THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
s AS (SELECT *, (sum(opens) OVER (PARTITION BY key ORDER BY ts))::BIGINT AS session FROM m)
SELECT key, session, count(*) AS events, min(event_id) AS first_event, epoch_us(max(ts) - min(ts)) // 1000000 AS seconds FROM s GROUP BY key, session"""


def _sessions(events, key, gap):
    rows = op.sessions(events.select(key.alias("key"), "event_id", "ts"), ["key"], "ts", F.expr(f"interval {gap}"))
    lasted = F.expr("timestampdiff(second, min(ts), max(ts))")
    return rows.groupBy("key", "session").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), lasted.alias("seconds"))


@query(_SESSIONS.format(key="user_id", gap="6 HOUR"))
def user_sessions(spark, sf_dir):
    return _sessions(_events(spark, sf_dir), F.col("user_id"), "6 hours")


@query(_SESSIONS.format(key="event_type", gap="20 MINUTE"))
def type_sessions(spark, sf_dir):
    """Sessions of five keys, each of a fifth of the rows."""
    return _sessions(_events(spark, sf_dir), F.col("event_type"), "20 minutes")


@query()
def top_k_indexed(spark, sf_dir):
    """The three nearest rows to every 50th vector by an index of all rows; its recall is tested."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return op.VectorIndex(vectors, "vec_id", "embedding").search(queries, "query_id", "embedding", 3)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def arrow_files(spark, sf_dir):
    """Lines written as Arrow files by the tasks that hold them, and four of their columns read back, some record batches a task."""
    path = state_path(spark)
    io.write_arrow(table(spark, sf_dir, "lineitem"), path)
    return io.scan_arrow(spark, path, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], split=1 << 18)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 480000)")
def bloom_lines_of_dear_orders(spark, sf_dir):
    """The lines of the few dear orders: a filter of these keys keeps other lines out of the exchange."""
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 480000").select(F.col("o_orderkey").alias("l_orderkey"))
    return op.bloom_semi_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), dear, ["l_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def bloom_orders_without_errors(spark, sf_dir):
    """The orders of those who saw no error."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return op.bloom_anti_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), errors, ["o_custkey"])


@query("""SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, TRUE AS users_hold, TRUE AS medians_hold, TRUE AS counts_hold FROM (FROM events UNION ALL SELECT * REPLACE ('all' AS event_type) FROM events) GROUP BY event_type""")
def sketch_rollup(spark, sf_dir):
    """Sketches of each day and type are stored, then merged by type and over all; whether distinct users, the median and every user's count are as near to the truth as promised."""
    events = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    daily, _ = store(op.sketches(events, ["day", "event_type"], "user_id", "value", "user_id"))
    whole = F.lit("all").alias("event_type")
    merged, _ = store(op.merge_sketches(daily, ["event_type"]).unionByName(op.merge_sketches(daily.withColumn("event_type", whole), ["event_type"])))
    both = events.unionByName(events.withColumn("event_type", whole))
    truth = both.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    guesses = op.estimate_counts(merged, truth, ["event_type"], "user_id").join(truth, ["event_type", "user_id"]).join(merged.select("event_type", "rows"), "event_type")
    users = guesses.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.bool_and(F.col("estimate") >= F.col("n")).alias("above"), F.avg((F.col("estimate") <= F.col("n") + 0.002 * F.col("rows")).cast("double")).alias("near"))
    said = merged.select("event_type", "rows", F.hll_sketch_estimate("distinct").alias("guess"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median"))
    ranks = both.select("event_type", "value").join(said.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("upto"))
    out = said.join(users, "event_type").join(ranks, "event_type")
    near = F.abs(F.col("guess") - F.col("users")) <= 1 + 0.06 * F.col("users")
    return out.select("event_type", "rows", "users", near.alias("users_hold"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("medians_hold"), (F.col("above") & (F.col("near") >= 0.97)).alias("counts_hold"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag, l_linestatus, l_linenumber)::INT AS grouping, count(*) AS rows, sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS distinct_l_suppkey, count(DISTINCT l_partkey) AS distinct_l_partkey
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def cube_with_distinct_counts(spark, sf_dir):
    return op.grouping_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_suppkey", "l_partkey"], {"quantity": F.col("l_quantity")})


_WORDS = "list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query("""SELECT conv_id, turn, doc_id FROM (SELECT conv_id, turn, substr(text, 3, 7) AS said FROM conversations WHERE conv_id % 50 = 0) c JOIN documents d ON contains(d.text, c.said)""")
def substrings_by_index(spark, sf_dir):
    """Which documents hold seven characters of each turn of every 50th conversation."""
    turns = table(spark, sf_dir, "conversations").where("conv_id % 50 = 0").select(F.struct("conv_id", "turn").alias("key"), F.substring("text", 3, 7).alias("said"))
    found = op.SubstringIndex(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").contains(turns, "key", "said", columns=["doc_id"])
    return found.select("key.conv_id", "key.turn", "doc_id")


@query(f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), p AS (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM d),
f AS (SELECT doc_id, size, word, count(*) AS times FROM p GROUP BY ALL), i AS (SELECT word, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f GROUP BY word),
q AS (SELECT conv_id, turn, unnest(list_distinct({_WORDS.format("text")})) AS word FROM conversations WHERE conv_id % 50 = 0),
s AS (SELECT conv_id, turn, doc_id, round(sum(idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size / (SELECT avg(len(w)) FROM d)))), 6) AS score FROM q JOIN f USING (word) JOIN i USING (word) GROUP BY ALL)
SELECT conv_id, turn, doc_id, score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def ranked_text_search(spark, sf_dir):
    """The ten documents that rank best for each turn of every 50th conversation."""
    turns = table(spark, sf_dir, "conversations").where("conv_id % 50 = 0").select(F.struct("conv_id", "turn").alias("key"), "text")
    found = op.RankedIndex(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").search(turns, "key", "text")
    return found.select("key.conv_id", "key.turn", "doc_id", "score", "rank")


def _streamed(spark, rows, make, n=3):
    """What a stream gives to which ``rows`` (ts, ...) come in ``n`` parts, in the order of their times; it is stopped after each part and started again from its checkpoint."""
    whole, path, out, checkpoint = (state_path(spark) for _ in range(4))
    rows.repartitionByRange(n, "ts").withColumn("nth", F.spark_partition_id()).write.partitionBy("nth").parquet(whole)
    for i in range(n):
        spark.read.parquet(whole).where(F.col("nth") == i).select(*rows.columns).write.mode("append").parquet(path)
        made = make(spark.readStream.schema(rows.schema).parquet(path))
        run_stream(made, out, checkpoint).awaitTermination()
    return spark.read.schema(made.schema).parquet(out).select(*made.columns)


def _stamped(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS events FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions of users on a stream that is restarted halfway: those that the watermark has closed."""
    use_rocks(spark)
    return _streamed(spark, _stamped(spark, sf_dir).select("user_id", "ts"), lambda s: session_stream(s, "user_id", "ts", 6 * 3600))


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Events each of which is sent twice, on a stream that is restarted halfway."""
    rows = _stamped(spark, sf_dir).select("event_id", "user_id", "ts")
    twice = rows.unionByName(rows.withColumn("ts", F.col("ts") + F.expr("interval 2 minutes")))
    return _streamed(spark, twice, lambda s: dedup_stream(s, ["event_id"], "ts")).select("event_id", "user_id")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Hourly counts on a stream that is restarted halfway: the hours that the watermark has closed."""
    rows = _stamped(spark, sf_dir).select("ts", "event_type", "value")
    made = _streamed(spark, rows, lambda s: windowed_counts(s, "ts", "event_type"))
    return made.select(F.unix_micros("start").alias("start"), "event_type", "rows", F.round("total", 4).alias("total"))


@query("SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 3) + 0.0 AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0")
def stream_similarity(spark, sf_dir):
    """A stream of vectors against every 50th, which is held."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    held = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    path, out, checkpoint = (state_path(spark) for _ in range(3))
    vectors.write.parquet(path)
    made = similarity_stream(held, spark.readStream.schema(vectors.schema).parquet(path), "query_id", "vec_id", "embedding", "embedding", 3)
    run_stream(made, out, checkpoint).awaitTermination()
    return spark.read.schema(made.schema).parquet(out).select("query_id", "vec_id", "score")
