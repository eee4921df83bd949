"""The domain's tables taken from the given ones; each frame has its DuckDB twin as a CTE."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feat(spark, sf_dir):
    """Feature table out of lineitem; every third line has no duration."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source_file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_row"),
        (F.col("l_linenumber") % 4).alias("cluster"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("duration"),
        F.col("l_extendedprice").alias("base"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("step"),
        (F.col("l_tax") * 100).alias("entry_peak"),
        (-F.col("l_discount") * 100).alias("exit_peak"),
    )


FEAT = """feat AS (SELECT l_returnflag AS source_file, l_orderkey * 8 + l_linenumber AS source_row, l_linenumber % 4 AS cluster,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS duration, l_extendedprice AS base, l_extendedprice * (1 - l_discount) AS step,
  l_tax * 100 AS entry_peak, -l_discount * 100 AS exit_peak FROM lineitem)"""


def sig(spark, sf_dir):
    """Signal out of events: key, i, t (epoch seconds), v, event and kind."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("user_id").alias("key"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("i"),
        (micros / 1000000.0).alias("t"),
        F.col("value").alias("v"),
        F.col("event_id").alias("event"),
        F.col("event_type").alias("kind"),
    )


SIG = """sig AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
  epoch_us(ts) / 1000000.0 AS t, value AS v, event_id AS event, event_type AS kind FROM events)"""


def labels(spark, sf_dir):
    """Labels at every k for each part: labels[k - 1] is the cluster among k."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array(F.lit(0), *[(F.col("p_partkey") * m % k).cast("int") for k, m in ((2, 1), (3, 1), (4, 3))]).alias("labels"), F.col("p_retailprice").alias("duration"), F.col("p_size").cast("double").alias("size"))


LABELS = """lab AS (SELECT p_partkey AS id, k, CAST(CASE k WHEN 1 THEN 0 WHEN 2 THEN p_partkey % 2 WHEN 3 THEN p_partkey % 3 ELSE p_partkey * 3 % 4 END AS INTEGER) AS cluster,
  p_retailprice AS duration, CAST(p_size AS DOUBLE) AS size FROM part, (SELECT unnest([1, 2, 3, 4]) AS k))"""


def rec(spark, sf_dir):
    """Recordings out of supplier."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("rec_id"), F.concat(F.upper("s_name"), F.lit(".ABF")).alias("file_name"), F.col("s_nationkey").alias("exp_id"), (1 + F.abs("s_acctbal")).alias("duration"))


REC = """rec AS (SELECT s_suppkey AS rec_id, upper(s_name) || '.ABF' AS file_name, s_nationkey AS exp_id, 1 + abs(s_acctbal) AS duration FROM supplier)"""


def ev(spark, sf_dir):
    """Annotation events out of lineitem: set = order, recording = supplier."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("set_id"),
        F.col("l_suppkey").alias("recording_id"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("number"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_discount") == 0.0).alias("deleted"),
    )


EV = """ev AS (SELECT l_orderkey AS set_id, l_suppkey AS recording_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS number,
  l_orderkey * 1000000 + l_partkey * 8 + l_linenumber AS id, l_discount = 0.0 AS deleted FROM lineitem)"""


def log(spark, sf_dir):
    """Edit log out of conversations: event = conversation, order = turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("event"), F.col("turn").alias("at"), F.col("role"), F.length("text").alias("size"))


LOG = """log AS (SELECT conv_id AS event, turn AS at, role, length(text) AS size FROM conversations)"""
