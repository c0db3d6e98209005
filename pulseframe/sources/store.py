"""Indexed samples at rest: files by series and run of blocks, and a table of blocks that tells which files a range needs.

path/samples has numbered samples, sorted inside files of BLOCKS_PER_FILE blocks each, in folders by series and file number; path/blocks has a row per block (sample
numbers, times, size, file number), path/stats the summaries of each block and subchannel. A range is looked up in the blocks first; the files of other blocks
are never listed to tasks, since their folders are partitions that the join prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import slices
from ..operators.stats import block_stats, overlapping
from ..schema import K

BLOCKS_PER_FILE = 1024


def write_store(samples: DataFrame, path: str, blocks_per_file: int = BLOCKS_PER_FILE) -> None:
    """Write samples with idx and block_seq, their blocks and the blocks' summaries. What is derived is read from the samples as written."""
    spark = samples.sparkSession
    rows = samples.withColumn("file", F.floor(F.col("block_seq") / blocks_per_file).cast("bigint"))
    rows.repartition(*K, "file").sortWithinPartitions(*K, "file", "idx").write.partitionBy(*K, "file").parquet(f"{path}/samples")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/samples")
    blocks = stored.groupBy(*K, "file", "block_seq").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx0"), (F.max("idx") + 1).alias("idx1"))
    blocks.repartitionByRange(*K, "start_us").sortWithinPartitions(*K, "start_us").write.parquet(f"{path}/blocks")
    block_stats(stored).repartitionByRange(*K, "start_us").sortWithinPartitions(*K, "start_us").write.parquet(f"{path}/stats")


class Store:
    """What write_store wrote; schema: that of its samples."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.samples = spark.read.schema(StructType([*schema.fields, StructField("file", LongType())])).parquet(f"{path}/samples")
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.stats = spark.read.parquet(f"{path}/stats")

    def of_blocks(self, blocks: DataFrame) -> DataFrame:
        """Samples of some blocks; only files that hold one of them are read. A row per file of so many blocks is broadcast."""
        files = blocks.select(*K, "file").distinct()
        return self.samples.join(F.broadcast(files), [*K, "file"]).join(blocks.select(*K, "block_seq"), [*K, "block_seq"], "left_semi").drop("file")

    def time_range(self, start_us: int, end_us: int) -> DataFrame:
        """As slices.time_range of all samples: blocks that touch the range, and the one after it, which may hold the sample that ends a gap."""
        after = F.col("start_us") > end_us
        next_ = self.blocks.where(after).groupBy(*K).agg(F.min_by(F.struct("file", "block_seq"), "start_us").alias("b")).select(*K, "b.*")
        kept = overlapping(self.blocks, start_us, end_us).select(*K, "file", "block_seq").unionByName(next_)
        firsts = self.blocks.groupBy(*K).agg(F.min("start_us").alias("_first"))
        return slices.time_range(self.of_blocks(kept), start_us, end_us, firsts=firsts)

    def index_slice(self, start: int, end: int, step: int = 1) -> DataFrame:
        """Samples [start:end:step] of each series; bounds are not negative."""
        return slices.index_slice(self.of_blocks(self.blocks.where((F.col("idx1") > start) & (F.col("idx0") < end))), start, end, step)

    def summaries(self, start_us: int, end_us: int) -> DataFrame:
        """Stored summaries of the blocks that touch a time range; no sample is read."""
        return overlapping(self.stats, start_us, end_us)
