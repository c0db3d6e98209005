"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: bytes.translate table that lower-cases A-Z only.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, which the cluster names in spark.checkpoint.dir.

    Where that is unset, the warehouse of a local session (as in tests) serves; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, observation: Observation | None = None, *metrics: Column) -> tuple[DataFrame, str]:
    """Write df to the shared folder; what was written, and its path. Metrics are observed as the rows pass."""
    path = shared_path(df.sparkSession, name)
    (df.observe(observation, *metrics) if observation else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    Lost executors then cost a re-read, not a recomputation, and values that depend on partition
    numbers (monotonically_increasing_id) stay as they were written.
    """
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate that no result reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df under their names, whatever characters those hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """16 bytes that tell rows by their id and text; the id's length goes first, so that no two rows read alike."""
    ident = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    ident = ident.cast("string")
    text = F.col(text) if isinstance(text, str) else text
    parts = (F.coalesce(F.length(ident), F.lit(-1)).cast("string"), F.coalesce(ident, F.lit("")), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))


#: Rows of a group that go to one task in join_groups, at least, and the number of groups that may be split.
HOT_ROWS, HOT_GROUPS = 500, 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """Inner join of rows with groups (materialised; one row a key; size: its number of rows) on the key, hot keys split.

    A group with more than HOT_ROWS rows and more than a HOT_GROUPS-th of all is dealt out by the hash of the spread column. There are
    fewer than HOT_GROUPS of those, so their keys and shares can be broadcast.
    """
    most = max(HOT_ROWS, (groups.agg(F.sum(size)).first()[0] or 0) // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > most).select(key, F.ceil(F.col(size) / most).cast("int").alias("_shares")))
    share = F.coalesce(F.col("_shares"), F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_share", F.pmod(F.xxhash64(spread), share).cast("int")).drop("_shares")
    right = groups.join(hot, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), share - 1))).drop("_shares")
    return left.join(right, [key, "_share"]).drop("_share")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df (written before) with rank, from 0, among the rows of its keys (not null) in the order (nulls first), and size, their number.

    Rows are dealt out by ranges of keys, order and a number of their own, so neither a large key nor repeated rows stay in one task; each part is
    sorted and written with its rows' numbers. What goes before a part is summed up on one row per part and key.
    """
    salt, at, part = unused(df, "_salt", "_at", "_part")
    by = [*keys, *order, salt]
    parts = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialise(parts.drop(salt).withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(at, 33))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    starts = per.select(part, *keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("size"))
    # without keys there is one row per part
    return rows.join(starts if keys else F.broadcast(starts), [part, *keys]).withColumn("rank", F.col("_start") + F.col(at) - F.col("_first")).drop(part, at, "_first", "_start")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text as UTF-8 bytes (null: empty); other columns never travel."""
    return docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def with_fields(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """Schema of the kept columns of df, then nullable ones in DDL."""
    return T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(more).fields)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Group row tuples into record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def is_held_out(doc_id: str, modulus: int, held_out: int):
    """Whether crc32 of the id as text, modulo, equals the held-out remainder; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == held_out
