"""The driver tables as recordings: events are samples of one channel per event type, embeddings are packed blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import block_stats
from ..operators.timebase import add_index, to_block

BLOCK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir; where that is unset, in the warehouse of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two subchannels, value and the k of the JSON, without index."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.lit("demo").alias("recording_id"), F.lit(0).alias("session_id"), F.col("event_type").alias("channel_id"), "event_id", "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.array("value", k).alias("raw"),
    )


def samples(spark: SparkSession, sf_dir: str, *channels: str) -> DataFrame:
    """Indexed samples; of the named channels only, which are chosen before they are numbered."""
    rows = raw_samples(spark, sf_dir)
    return to_block(add_index(rows.where(F.col("channel_id").isin(*channels)) if channels else rows, "event_id"), BLOCK)


def indexed(spark: SparkSession, sf_dir: str, *channels: str) -> DataFrame:
    """The same, written to the shared folder: for what reads them several times."""
    return written(samples(spark, sf_dir, *channels), "indexed")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as written to the shared folder, for plans that use them several times."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_stats(samples(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block with its times and size."""
    keys = ("recording_id", "session_id", "channel_id", "block_seq")
    return samples(spark, sf_dir).groupBy(*keys).agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n"))


#: The same model in SQL: s are samples, b are blocks (long form), bb are blocks.
SQL = f"""
s AS (SELECT 'demo' AS recording_id, event_type AS channel_id, event_id, user_id, epoch_us(ts) AS t_us, value AS v0, json_extract_string(props, '$.k')::DOUBLE AS v1,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events),
l AS (SELECT channel_id, idx, idx // {BLOCK} AS block_seq, t_us, 0 AS subchannel_id, v0 AS v FROM s UNION ALL SELECT channel_id, idx, idx // {BLOCK}, t_us, 1, v1 FROM s),
b AS (SELECT channel_id, block_seq, subchannel_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n, min(v) AS mn, avg(v) AS av, max(v) AS mx FROM l GROUP BY ALL),
bb AS (SELECT channel_id, block_seq, start_us, end_us, n FROM b WHERE subchannel_id = 0)"""
