"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w over the n terms of a text + sum over pairs of terms of <v_i, v_j> / n), so that two
terms can mean more together than their weights add up to. Terms are the distinct lower-case words and their first
bytes (STEMS), which families of inflected words share, hashed into 2^24 buckets; buckets that fewer than MIN_DOCS training texts have carry no weight. The machine is fitted on a
bounded sample of labelled rows (TRAIN_DOCS, by the hash of the id); scoring is one narrow pass over whole texts.

Defined cases: null text counts as empty, and texts without known terms score sigmoid(b); repeated rows are scored
each; null labels and null ids teach nothing; labels of one class only, or none, give that class's share (none: 0.5) as
every score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, is_held_out, table, texts, with_fields

#: Labelled rows that the machine is fitted on, at most.
TRAIN_DOCS = 12_000
MIN_DOCS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 5, 4, 6, 128, 0.2, 2e-5
#: Bytes of a word that make a stem.
STEMS = (4, 5)
THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
_BUCKETS = (1 << 24) - 1

#: bytes.translate table: ASCII that is neither letter nor digit becomes a space.
_WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> list[int]:
    """Buckets of the distinct words of a text in UTF-8, and of their stems."""
    low = raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()
    words = set(low.translate(_WORDS).split())
    stems = {b"<%d" % n + w[:n] for n in STEMS for w in words if len(w) > n}
    return [zlib.crc32(w) & _BUCKETS for w in (*words, *stems)]


@dataclass
class Machine:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def places(self, found: list[int] | np.ndarray) -> np.ndarray:
        ids = np.asarray(found, np.int32)
        at = np.minimum(np.searchsorted(self.buckets, ids), max(0, len(self.buckets) - 1))
        return at[self.buckets[at] == ids] if len(self.buckets) and len(ids) else np.empty(0, np.int64)

    def score(self, raw: bytes) -> float:
        at = np.sort(self.places(terms(raw)))  # sums then don't depend on the order of a set
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum()) / max(1, len(at))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(found: list[list[int]] | list[np.ndarray], labels: list[int], seed: int = 3) -> Machine:
    """Adagrad on the logistic loss, with weight decay."""
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    buckets, counts = np.unique(np.concatenate([np.asarray(x, np.int32) for x in found]), return_counts=True)
    buckets = buckets[counts >= MIN_DOCS]
    rng = np.random.default_rng(seed)
    m = Machine(buckets, np.zeros(len(buckets)), rng.normal(0, 0.02, (len(buckets), FACTORS)), float(np.log(share / (1 - share))))
    rows = [m.places(x) for x in found]
    sizes = np.array([len(r) for r in rows])
    seen_w, seen_v, seen_b, n = np.full(len(buckets), 1e-2), np.full((len(buckets), FACTORS), 1e-2), 1e-2, len(buckets)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            take = order[s : s + BATCH]
            at, doc = np.concatenate([rows[i] for i in take]), np.repeat(np.arange(len(take)), sizes[take])
            v = m.factors[at]
            total = np.stack([np.bincount(doc, v[:, f], len(take)) for f in range(FACTORS)], 1)
            square = np.bincount(doc, (v**2).sum(1), len(take))
            n_terms = np.maximum(sizes[take], 1)
            z = m.bias + np.bincount(doc, m.weights[at], len(take)) + 0.5 * ((total**2).sum(1) - square) / n_terms
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]
            gb, gd = g.mean(), g[doc] / len(take)
            gw = np.bincount(at, gd, n) + DECAY * m.weights
            inner = (gd / n_terms[doc])[:, None] * (total[doc] - v)
            gv = np.stack([np.bincount(at, inner[:, f], n) for f in range(FACTORS)], 1) + DECAY * m.factors
            seen_w += gw**2
            seen_v += gv**2
            seen_b += gb**2
            m.weights -= RATE * gw / np.sqrt(seen_w)
            m.factors -= RATE * gv / np.sqrt(seen_v)
            m.bias -= RATE * gb / np.sqrt(seen_b)
    return m


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(text, label) of at most so many labelled ids that aren't held out, few enough to broadcast; of an id's rows one is taken by the hash of its text."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", modulus, held_out))
        .groupBy("doc_id")
        .agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = texts(docs, "doc_id").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_y").cast("int").alias("y")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, y = columns(batch, "text", "y")
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms(t)) for t in text], pa.list_(pa.int32())), pa.array(y, pa.int32())], names=["terms", "y"])

    rows = labelled(docs, labels, "toxic", MODULUS, HELD_OUT, TRAIN_DOCS).mapInArrow(run, "terms array<int>, y int").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit([], [])
    lists, y = rows.column("terms").chunk(0), rows.column("y").to_pylist()
    flat, cuts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    found = np.split(flat, np.cumsum(cuts)[:-1])
    order = sorted(range(len(y)), key=lambda i: (len(found[i]), zlib.crc32(found[i].tobytes()), y[i]))  # whatever order tasks end in
    return fit([found[i] for i in order], [y[i] for i in order])


def score_toxicity(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """The kept columns and score of every row."""
    frame = texts(docs, *keep)
    schema = with_fields(frame, list(keep), "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = [machine.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(scores, pa.float64())], names=schema.names)

    return frame.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns, whatever their names; the text travels once, with its row."""
    machine, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score((t.as_py() or "").encode()) for t in batch.column(at)]
            yield batch.filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", is_held_out("doc_id", MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
