"""Nearest neighbours by cosine: score-aware (anisotropic) product quantisation and exact reranking.

Unit vectors are cut into pairs of coordinates, each coded in four bits. The quantiser's loss weighs the
part of the residual that is parallel to the vector more than the rest, because that part alone shifts large
inner products. A coarse partition deals the vectors to cells, each cell to blocks of bounded size. A block with its codes and
vectors stays where it is, and the queries that look into its cell stream past: a scan adds up table entries, two codes to a
look-up, and the best of each query are compared at once by exact cosines of the original vectors in double precision, so that a
block passes on k rows a query. Where codes can't tell vectors apart (tight clusters, a common offset), the shortlist may lack near ones: an exact check
follows, of all vectors whose sum of table entries and own coding error, which bounds the cosine, reach the k-th best of the shortlist. So a
query misses none in the cells that it looks into.

Codebooks and centroids are fitted on a bounded sample (SAMPLE_BYTES); every vector is coded. How many cells a query looks into
is fitted, too: so many that PROBED of the pairs of near neighbours in the sample, and of those of a sample of the queries with it, are found. Near neighbours in the sample are
further apart than those among all vectors, so this errs to the safe side.

Copies: of equal vectors the k + 1 smallest distinct ids are candidates, each with at most k of its rows, since others can't be among the k
nearest of any query (equal score, larger id). That is a partial top-k before the shuffle, so a vector that
a third of the rows share is harmless, and copies can't crowd other vectors out of a shortlist.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no part; null ids take no part;
vectors of each length are searched by themselves, one length after the other; lengths of components don't matter, large or small (vectors are
scaled by powers of two); fewer than k candidates: all of them; rows of one id: none is a candidate of the others; repeated
rows of a query give its rows once; no vectors: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Bytes of the vectors that codebooks and centroids are fitted on, at most; chosen by the hash of their ids.
SAMPLE_BYTES = 10_240_000
#: Queries whose near neighbours in the sample are looked for, to fit the number of cells.
QUERY_SAMPLE = 512
#: Candidates of a query in a block that are compared exactly.
SHORTLIST = 256
#: Vectors of a cell, on average, and bytes of the vectors of a block.
CELL, BLOCK_BYTES = 32_768, 64 << 20
#: Sample vectors to a centroid, at least.
TO_A_CENTROID = 16
#: Share of the sample's pairs of near neighbours that the probed cells must hold.
PROBED = 0.98
#: Bytes of the tables, and number of codes, that are worked on at once.
TABLE_BYTES, CHUNK = 16 << 20, 2048
#: Bytes of the sums of a block that are kept for the exact check.
SUM_BYTES = 64 << 20
#: Cosine from which inner products matter; sets the weight of the parallel residual.
THRESHOLD = 0.2
CENTRES, ROUNDS, PASSES = 16, 8, 2
#: Table entries are whole numbers of this part of one.
SCALE = 1 << 14
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


@dataclass
class Quantiser:
    centres: np.ndarray  # subspaces x 16 x 2
    eta: float

    @property
    def dims(self) -> int:
        return 2 * len(self.centres)

    def split(self, unit: np.ndarray) -> np.ndarray:
        """n x subspaces x 2; an odd dimension gets a zero."""
        return np.pad(unit, ((0, 0), (0, self.dims - unit.shape[1]))).reshape(len(unit), -1, 2)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes (n x subspaces): nearest centres first, then coordinate descent on the anisotropic loss."""
        x = self.split(unit.astype(np.float32))
        codes = np.empty(x.shape[:2], np.uint8)
        for m, c in enumerate(self.centres):
            codes[:, m] = ((x[:, m, None] - c) ** 2).sum(2).argmin(1)
        return self.descend(x, codes)

    def descend(self, x: np.ndarray, codes: np.ndarray, passes: int = PASSES) -> np.ndarray:
        along = np.stack([(x[:, m] * (x[:, m] - c[codes[:, m]])).sum(1) for m, c in enumerate(self.centres)], 1)
        total = along.sum(1)
        for _ in range(passes):
            for m, c in enumerate(self.centres):
                rest = x[:, m, None] - c  # n x 16 x 2
                part = np.einsum("nd,nkd->nk", x[:, m], rest)
                other = total - along[:, m]
                loss = (rest**2).sum(2) + (self.eta - 1) * (other[:, None] + part) ** 2
                codes[:, m] = loss.argmin(1)
                along[:, m] = part[np.arange(len(x)), codes[:, m]]
                total = other + along[:, m]
        return codes

    def packed(self, unit: np.ndarray) -> np.ndarray:
        """Codes of two subspaces to a byte."""
        codes = self.encode(unit)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def errors(self, unit: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Distance of each unit vector from what its codes stand for."""
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, : len(self.centres)]
        return np.sqrt(sum(((x - c[codes[:, m]]) ** 2).sum(1) for m, (x, c) in enumerate(zip(self.split(unit).swapaxes(0, 1), self.centres.astype(np.float64)))))

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Integer inner products of queries with the centres of two subspaces each: queries x pairs x 256."""
        one = np.einsum("qmd,mkd->qmk", self.split(unit.astype(np.float32)), self.centres)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        two = one[:, 0::2, :, None] + one[:, 1::2, None, :]
        return np.rint(two.reshape(len(unit), two.shape[1], -1) * SCALE).astype(np.int32)


def fit(unit: np.ndarray, threshold: float = THRESHOLD, seed: int = 7) -> Quantiser:
    """Codebooks that minimise the anisotropic loss: assignments and least squares by turns."""
    dims = unit.shape[1]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    q = Quantiser(np.zeros(((dims + 1) // 2, CENTRES, 2), np.float32), eta)
    x = q.split(unit.astype(np.float32))
    rng = np.random.default_rng(seed)
    for m in range(len(q.centres)):
        q.centres[m] = x[rng.integers(0, len(x), CENTRES), m] + rng.normal(0, 1e-4, (CENTRES, 2))
    codes = q.encode(unit)
    for _ in range(ROUNDS):
        along = np.stack([(x[:, m] * (x[:, m] - c[codes[:, m]])).sum(1) for m, c in enumerate(q.centres)], 1)
        total = along.sum(1)
        for m in range(len(q.centres)):
            own, code = x[:, m], codes[:, m]
            other = total - along[:, m]
            # minimise |x - c|^2 + (eta - 1) (other + x.x - x.c)^2 over c
            outer = np.einsum("ni,nj->nij", own, own) * (eta - 1) + np.eye(2, dtype=np.float32)
            right = own * (1 + (eta - 1) * (other + (own**2).sum(1)))[:, None]
            for k in range(CENTRES):
                mine = code == k
                if mine.any():
                    q.centres[m, k] = np.linalg.solve(outer[mine].sum(0).astype(np.float64) + 1e-9 * np.eye(2), right[mine].sum(0).astype(np.float64))
            along[:, m] = (own * (own - q.centres[m][code])).sum(1)
            total = other + along[:, m]
        codes = q.descend(x, codes, 1)
    return q


@dataclass
class Coarse:
    """Centroids of the cells, and the number of cells that a query looks into."""

    centroids: np.ndarray
    probes: int = 1

    def closest(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The n cells of each vector with the largest inner products, best first."""
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, :n]


def partition(unit: np.ndarray, cells: int, k: int = 5, seed: int = 11, queries: np.ndarray | None = None) -> Coarse:
    """Spherical k-means, and as many probes as find PROBED of the pairs of near neighbours in the sample, and of those of queries (unit vectors) with it."""
    cells = max(1, min(cells, len(unit) // TO_A_CENTROID))
    rng = np.random.default_rng(seed)
    coarse = Coarse(unit[rng.choice(len(unit), cells, replace=False)])
    for _ in range(ROUNDS if cells > 1 else 0):
        own = coarse.closest(unit)[:, 0]
        sums = np.zeros_like(coarse.centroids)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        coarse.centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), coarse.centroids)
    if cells > 1:
        own = coarse.closest(unit)[:, 0]
        for asked in (unit[rng.choice(len(unit), min(512, len(unit)), replace=False)], queries):
            if asked is None or not len(asked):
                continue
            near = asked @ unit.T
            near[near > 1 - 1e-12] = -2  # the vector itself
            near = np.argpartition(-near, min(k, len(unit) - 2), axis=1)[:, :k]
            place = np.argsort(coarse.closest(asked, cells), axis=1)[np.arange(len(asked))[:, None], own[near]]
            coarse.probes = max(coarse.probes, int(np.quantile(place, PROBED, method="higher")) + 1)
    return coarse


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm): vectors that have a direction, as doubles, scaled by a power of two so that no square over- or underflows."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~bad).withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0")
    scale = F.pow(F.lit(2.0), -F.greatest(F.least(F.floor(F.log2("top")), F.lit(1000)), F.lit(-1000)).cast("double"))
    rows = rows.withColumn("scale", scale).select("vec_id", F.transform("v", lambda x: x * F.col("scale")).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _matrix(v: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(v, pa.Array):
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return np.stack([np.asarray(a, np.float64) for a in v])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ROWS = "cell int, block int, asks boolean, id bigint, row bigint, v array<double>, norm double"
FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Block:
    """Vectors of one block, ready to be asked."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, v: np.ndarray, norm: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that of equal sums the smaller id goes first
        self.quantiser, self.ids, self.v, self.norm = quantiser, ids[order], v[order], norm[order]
        parts = [slice(i, i + CHUNK) for i in range(0, len(ids), CHUNK)]
        self.code = np.concatenate([quantiser.packed(_unit(self.v[i])) for i in parts])
        self.error = np.concatenate([quantiser.errors(_unit(self.v[i]), self.code[i]) for i in parts])

    def ask(self, own: np.ndarray, row: np.ndarray, v: np.ndarray, norm: np.ndarray, k: int, shortlist: int) -> Iterator[pa.RecordBatch]:
        """The k best of each query by exact cosines: of a shortlist that the codes choose, then of all whose bound reaches the shortlist's k-th."""
        step = max(16, min(1024, TABLE_BYTES // (self.code.shape[1] * 1024), SUM_BYTES // (4 * len(self.ids))))
        for q in range(0, len(own), step):
            part = slice(q, q + step)
            unit = _unit(v[part])
            tables = self.quantiser.tables(unit)
            best, sums = np.empty((len(tables), 0), np.int64), np.empty((len(tables), len(self.ids)), np.int32)
            for c in range(0, len(self.ids), CHUNK):
                at = self.code[c : c + CHUNK]
                total = np.zeros((len(tables), len(at)), np.int64)
                for m in range(at.shape[1]):
                    total += np.take(tables[:, m], at[:, m], axis=1)
                sums[:, c : c + CHUNK] = total
                total = (total << 32) | (len(self.ids) - 1 - (c + np.arange(len(at))))  # no ties
                total[own[part, None] == self.ids[None, c : c + CHUNK]] = np.iinfo(np.int64).min
                best = np.concatenate([best, total], 1)
                if best.shape[1] > shortlist:
                    best = np.partition(best, best.shape[1] - shortlist, axis=1)[:, -shortlist:]
            who, at = np.nonzero(best != np.iinfo(np.int64).min)
            who, at, score = self.top(who, len(self.ids) - 1 - (best[who, at] & ((1 << 32) - 1)), v[part], norm[part], k)
            if len(self.ids) > shortlist:
                who, at, score = self.check(who, at, score, unit, sums, own[part], v[part], norm[part], k)
            yield pa.RecordBatch.from_arrays([own[part][who], row[part][who], self.ids[at], score], schema=FOUND)

    def top(self, who: np.ndarray, at: np.ndarray, v: np.ndarray, norm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query among pairs of a query and a place, with their cosines."""
        score = np.zeros(len(at))
        for d in range(v.shape[1]):  # component by component, so that equal vectors have equal sums
            score += v[who, d] * self.v[at, d]
        return self.first(who, at, score / (norm[who] * self.norm[at]), k)

    def first(self, who: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[kept], at[kept], score[kept]

    def check(self, who: np.ndarray, at: np.ndarray, score: np.ndarray, unit: np.ndarray, sums: np.ndarray, own: np.ndarray, v: np.ndarray, norm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query in the block, of those that the codes can't rule out; who, at and score are the shortlist's."""
        slack = (self.code.shape[1] / 2 + 1) / SCALE + 1e-5  # of whole numbers and single precision in the tables
        found = who[:0], at[:0], score[:0]
        reach = np.full(len(unit), -np.inf)
        last = np.bincount(who, minlength=len(unit)).cumsum() - 1
        full = np.bincount(who, minlength=len(unit)) == k
        reach[full] = score[last[full]]
        for c in range(0, len(self.ids), CHUNK):
            part = slice(c, c + CHUNK)
            open_ = (sums[:, part] / SCALE + self.error[part] + slack >= reach[:, None]) & (own[:, None] != self.ids[None, part])
            rows, cols = open_.any(1).nonzero()[0], open_.any(0).nonzero()[0]
            if not len(rows):
                continue
            near = unit[rows] @ _unit(self.v[c + cols]).T
            i, j = np.nonzero(open_[np.ix_(rows, cols)] & (near >= reach[rows, None] - 1e-9))
            new = self.top(rows[i], c + cols[j], v, norm, k)
            found = self.first(*map(np.concatenate, zip(found, new)), k)
            full = np.bincount(found[0], minlength=len(unit)) == k
            last = np.bincount(found[0], minlength=len(unit)).cumsum() - 1
            reach[full] = np.maximum(reach[full], found[2][last[full]])
        return found


def _scan(quantiser: Quantiser, k: int, shortlist: int):
    """Over rows sorted by cell, block and asks: a block's vectors come first and stay, its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if s == e:
                    continue
                if here != (place := tuple(where[:2, s].tolist())):
                    here, held, block = place, [], None
                part = batch.slice(s, e - s)
                ids, row, norm = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 6))
                v = _matrix(part.column(5))
                if not where[2, s]:
                    held.append((ids, v, norm))
                elif block or held:
                    if held:
                        block, held = Block(quantiser, *map(np.concatenate, zip(*held))), []
                    yield from block.ask(ids, row, v, norm, k, shortlist)

    return run


def _nearest(rows: DataFrame, is_query: Column, k: int, shortlist: int, cell: int) -> DataFrame:
    """nearest() for vectors of one length."""
    spark = rows.sparkSession
    dims = len(rows.select("v").first()["v"])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE_BYTES // (8 * dims))).select("v").toPandas()["v"]
    unit = np.unique(_unit(_matrix(picked)), axis=0)  # copies would make neighbours look nearer than they are
    # k + 1 distinct ids of equal vectors, each with at most k of its repeated rows (more can't be among the k nearest)
    again = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    same = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("time", F.row_number().over(again)).where(F.col("time") <= k).withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1).drop("time", "place")
    quantiser = fit(unit)
    asked = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(QUERY_SAMPLE).select("v").toPandas()["v"]
    coarse = partition(unit, -(-rows.count() // cell), k, queries=_unit(_matrix(asked)) if len(asked) else None)

    def dealt(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = coarse.closest(_unit(_matrix(batch.column(1))), n).astype(np.int32)
                who = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([*batch.take(who).columns, pa.array(cells.ravel())], names=[*batch.schema.names, "cell"])

        return run

    schema = "vec_id bigint, v array<double>, norm double, cell int"
    stays = materialise(candidates.select("vec_id", "v", "norm").mapInArrow(dealt(1), schema), "cells")
    asks = rows.where(is_query).select("vec_id", "v", "norm").dropDuplicates(["vec_id", "v"]).mapInArrow(dealt(coarse.probes), schema)
    # blocks of each cell: a row for each of the cells, whose number the sample bounds
    sizes = {r["cell"]: -(-r["count"] * 8 * dims // BLOCK_BYTES) for r in stays.groupBy("cell").count().collect()}
    blocks = F.broadcast(spark.createDataFrame(list(sizes.items()), "cell int, blocks int"))
    mark = F.xxhash64("vec_id", "v")
    stays = stays.join(blocks, "cell").select("cell", F.pmod(mark, F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), F.lit(0).cast("bigint").alias("row"), "v", "norm")
    asks = asks.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), F.col("vec_id").alias("id"), mark.alias("row"), "v", "norm")
    together = stays.unionByName(asks).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    found = together.mapInArrow(_scan(quantiser, k, shortlist), "query_id bigint, query_row bigint, vec_id bigint, score double")
    final = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, shortlist: int = SHORTLIST, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates found nearest to each row that is_query (a Column) picks."""
    rows = materialise(usable(vectors), "vectors")
    lengths = [r["dims"] for r in rows.groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect()]
    parts = [_nearest(rows.where(F.size("v") == n), is_query, k, shortlist, cell) for n in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], RESULT)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
