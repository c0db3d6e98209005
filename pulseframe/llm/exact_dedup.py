"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. A batch is reduced to one candidate per digest
(partial aggregation before the shuffle, so a hot group of copies collapses on the map side), the
candidates go through a sort-merge anti-join with the index, and what is new is appended.

A batch has a name. Rows of the index that the same batch has brought in count as absent, and only digests that the
index lacks are appended, so a batch that is repeated after a failure gives the same rows and leaves the index as it is. Each append
adds a file to a bucket; compact() merges them.

Defined cases: null text counts as empty; texts are equal when equal without the characters
[\\x20\\x09-\\x0D]; of equal texts the row with most code points stays, then the smallest doc_id
(null ids last), then, among repeated rows of one id, one of them; an empty table gives an empty result and
leaves the index as it was; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, join_groups, materialise, own_columns, row_key, shared_path, table, unused

INDEX_SCHEMA = "digest binary, keep_id bigint, n_points int, batch string"


def digest(text: str | Column) -> Column:
    """SHA-256 (32 bytes) of the text without its ASCII white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, ""), 256))


def points(text: str) -> Column:
    return F.length(F.coalesce(F.col(text), F.lit("")))


class DigestIndex:
    """Digests of everything kept so far, with the id of the row that stayed and the batch that brought it.

    buckets is the number of files that one append writes; choose it for the size of the full index
    (about 1 GB a bucket), because it can't change later.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or shared_path(spark, "digest-index")
        if spark.catalog.tableExists(self._merged):  # a compaction ended before its last step
            self._replace()
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], INDEX_SCHEMA), self.name, self.path)

    @property
    def _merged(self) -> str:
        return f"{self.name}_merged"

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, path: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", path)
            .saveAsTable(name)
        )

    def add(self, hashed: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch of (row, doc_id, n_points, digest) and append what is new.

        Returns (digest, keep_row, keep_id, group_size): keep_row is the batch row that stays, null where
        another batch already holds the text. batch names the batch; without a name it can't be repeated.
        """
        batch = batch or uuid.uuid4().hex
        first = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        groups = materialise(
            hashed.groupBy("digest")
            .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("first.row").alias("row"), F.col("first.doc_id").alias("doc_id"), (-F.col("first.less")).alias("n_points"), "group_size"),
            "digest-groups",
        )
        old = self.rows().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id")).hint("merge")
        own = self.rows().where(F.col("batch") == batch).select("digest").hint("merge")
        fresh = groups.join(old, "digest", "left_anti")
        known = groups.join(old, "digest").select("digest", F.lit(None).cast("bigint").alias("keep_row"), F.col("old_id").alias("keep_id"), "group_size")
        out = materialise(fresh.select("digest", F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"), "group_size").unionByName(known), "digest-kept")
        self._write(fresh.join(own, "digest", "left_anti").select("digest", F.col("doc_id").cast("bigint").alias("keep_id"), "n_points", F.lit(batch).alias("batch")), self.name, self.path)
        return out

    def compact(self) -> None:
        """Merge the files of each bucket into one. Appends wait meanwhile; a compaction that fails is ended or begun anew by the next use."""
        path = shared_path(self.spark, "digest-index")
        partial = f"{self.name}_partial"
        self.spark.sql(f"DROP TABLE IF EXISTS {partial}")
        self._write(self.rows(), partial, path)
        self.spark.sql(f"ALTER TABLE {partial} RENAME TO {self._merged}")
        self._replace()

    def _replace(self) -> None:
        """Put the merged table, which is whole, in the place of the old one."""
        place = lambda name: self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        old = place(self.name) if self.spark.catalog.tableExists(self.name) else None
        self.path = place(self._merged)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"ALTER TABLE {self._merged} RENAME TO {self.name}")
        if old:
            discard(self.spark, old)

    def drop(self) -> None:
        """Delete the index; results of add() stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def hashed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_points, digest) of every row, written once: the texts are read a single time."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", points("text").alias("n_points"), digest("text").alias("digest"))
    return materialise(rows, "digests")


def _kept(rows: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """What index.add returns for hashed rows; without an index, of a new one that is dropped again."""
    if index:
        return index.add(rows, batch)
    index = DigestIndex(rows.sparkSession)
    out = index.add(rows)
    index.drop()
    return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The join back to the rows is on the digest, of id-sized rows; hot groups are dealt out.
    """
    rows = hashed(docs)
    groups = _kept(rows, index, batch)
    return join_groups(rows, groups, "digest", "group_size", "row").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    (key,) = unused(docs, "row_key")
    rows = hashed(docs)
    stays = rows.join(_kept(rows, index, batch).select(F.col("keep_row").alias("row")), "row", "left_semi")
    keep = stays.select(_row_key("digest", "doc_id", "n_points").alias(key))
    tagged = docs.withColumn(key, _row_key(digest("text"), "doc_id", points("text")))
    # a key has several rows only where rows are repeated; one of them is left of each task's before any text travels
    return tagged.dropDuplicates([key]).join(keep, key, "left_semi").select(*own_columns(docs))


def _row_key(digest: str | Column, doc_id: str, n_points: str | Column) -> Column:
    """A key of 16 bytes for a row, so that the texts are dealt evenly whatever group they are in."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    points = F.col(n_points) if isinstance(n_points, str) else n_points
    return row_key(doc_id, F.concat_ws(":", points.cast("string"), F.hex(digest)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a new index."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""
