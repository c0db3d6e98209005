"""Importance resampling of documents towards a target distribution, over hashed word n-grams.

A task joins the texts of a batch into one string with a separator between them, so that one regex pass finds all words and one lookup of their starts in the
sorted offsets of the texts tells whose each is. N-grams are runs of neighbouring words; those that reach over the end of a text are masked out
before the buckets are counted. A bucket is the checksum of the n-gram; checksums of words are combined to those of n-grams for all places at once.
The first pass counts the buckets of all documents and of the target, a row per bucket and task; the second adds up the gains of each
document's n-grams. A bucket's gain is the logarithm of the ratio of its smoothed frequencies, in whole thousandths. Documents
are drawn without replacement by the Gumbel trick: weight plus noise that depends on seed and id only, the highest scores first.
They are ranked by ranges of the score, in all tasks; nothing of a document goes to the driver, which holds one gain a bucket.

Defined cases: null texts have no words; documents without words weigh nothing; those of less than min_words can't be drawn; of
equal scores the smaller id goes first (null before all), then the smaller weight; repeated rows count and are scored each; an empty table gives
no rows; an empty target makes all of its frequencies equal; other columns are ignored, whatever their names. Texts are cut into parts of CHUNK bytes
between words, each with the words that its last n-grams reach into, so memory doesn't grow with a text beyond the text itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, columns, materialise, ranked, table, texts, with_fields

#: A word in lower-cased UTF-8: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. Split gives words at odd places, and what stands between them.
WORD = re.compile(rb"([0-9a-z\x80-\xff]+)")
#: No part of a word; stands between texts.
SENTINEL = b"\n"
#: Bytes of text that are looked at in one pass.
CHUNK = 1 << 22


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 3  # words of an n-gram
    percent: int = 5  # of the documents that can be drawn
    min_words: int = 20
    seed: int = 42


def parts(text: bytes, longest: int, chunk: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Parts of a lower-cased text, and how many of a part's bytes are its own: the rest are the words that n-grams from there reach into."""
    more = re.compile(rb"(?:[^0-9a-z\x80-\xff]*[0-9a-z\x80-\xff]+){0,%d}" % (longest - 1))
    start = 0
    while len(text) - start > chunk:
        end = start + chunk
        inside = WORD.match(text, end)  # a word isn't cut
        end = inside.end() if inside else end
        reach = more.match(text, end).end()
        yield text[start:reach], end - start
        start = end
    if start < len(text) or not text:
        yield text[start:], len(text) - start


def batches(raw: list[bytes], longest: int, chunk: int = CHUNK) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about a chunk: the string, offsets of its parts, ends of what is each part's own, and the number of its text."""
    held, own, owner, size = [], [], [], 0
    for number, text in enumerate(raw):
        for part, mine in parts(text.translate(LOWER_ASCII), longest, chunk):
            held.append(part)
            own.append(mine)
            owner.append(number)
            size += len(part) + 1
            if size >= chunk:
                yield _joined(held, own, owner)
                held, own, owner, size = [], [], [], 0
    if held:
        yield _joined(held, own, owner)


def _joined(held: list[bytes], own: list[int], owner: list[int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, held), np.int64, len(held)) + len(SENTINEL)
    offsets = np.cumsum(sizes) - sizes
    return SENTINEL.join(held), offsets, offsets + np.array(own, np.int64), np.array(owner, np.int64)


#: Word lengths up to which checksums are combined by table.
TABLED = 64


def _tables() -> np.ndarray:
    """[length, byte place, byte]: what that byte of a checksum becomes when so many zero bytes follow; a checksum's is the xor of its four."""
    crc = lambda c: zlib.crc32(b"\0", c ^ 0xFFFFFFFF) ^ 0xFFFFFFFF  # noqa: E731  one zero byte through the bare register
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for place in range(4):
        values = [b << 8 * place for b in range(256)]
        for n in range(TABLED + 1):
            out[n, place] = values
            values = list(map(crc, values))
    return out


_SHIFT = _tables()


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of strings, each put together from a first part and a second one of the given length."""
    shifted = _SHIFT[length, 0, first & 255]
    for place in range(1, 4):
        shifted ^= _SHIFT[length, place, first >> np.uint32(8 * place) & 255]
    return shifted ^ second


def features(raw: list[bytes], how: Resampling, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket of each n-gram, number of its text, words of an n-gram) of all texts, n-grams of one length of a joined batch at a time."""
    space = np.uint32(zlib.crc32(b" "))
    for joined, offsets, ends, owner in batches(raw, how.longest, chunk):
        pieces = WORD.split(joined)
        words = pieces[1::2]
        if not words:
            continue
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, length = (np.cumsum(length) - length)[1::2], length[1::2]
        part = np.searchsorted(offsets, starts, "right") - 1
        mine = starts < ends[part]  # n-grams belong to the part of their first word
        sums = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        short = np.minimum(length, TABLED - 1)
        spaced = combined(np.full(len(words), space), sums, short)  # a space and the word
        (long_words,) = np.nonzero(length >= TABLED)
        for i in long_words:
            spaced[i] = zlib.crc32(b" " + words[i])
        for n in range(1, how.longest + 1):
            if n > 1:
                before, sums = sums, combined(sums[:-1], spaced[n - 1 :], short[n - 1 :] + 1)  # what precedes grows by a space and a word
                for i in long_words[long_words >= n - 1] - (n - 1):
                    sums[i] = zlib.crc32(b" " + words[i + n - 1], int(before[i]))
            inside = mine[: len(sums)] & (part[n - 1 :] == part[: len(sums)])
            yield sums[inside].astype(np.int64) % how.buckets, owner[part[: len(sums)][inside]], n


def bucket_counts(docs: DataFrame, how: Resampling) -> DataFrame:
    """bucket and n: how often n-grams of all texts fall into each bucket; buckets without any have no row."""
    schema = "bucket int, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in features(columns(batch, "text")[0], how):
                total += np.bincount(bucket, minlength=how.buckets)
        (some,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts(docs).mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, how: Resampling) -> np.ndarray:
    """Whole thousandths of the log ratio of target to documents, by bucket. As many numbers as buckets go to the driver."""

    def counts(df: DataFrame) -> list[int]:
        found = dict(bucket_counts(df, how).toLocalIterator())
        return [found.get(b, 0) for b in range(how.buckets)]

    s, t = counts(docs), counts(target)
    ours, theirs = float(sum(s) + how.buckets), float(sum(t) + how.buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * ours / ((a + 1.0) * theirs))) for a, b in zip(s, t)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, how: Resampling, *keep: str) -> DataFrame:
    """The kept columns, n_words, n_features and weight, the sum of its n-grams' gains, of every row."""
    frame = texts(docs, *keep)
    schema = with_fields(frame, list(keep), "n_words bigint, n_features bigint, weight bigint")
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = columns(batch, "text")[0]
            words, some, weight = (np.zeros(len(raw), np.int64) for _ in range(3))
            for bucket, owner, n in features(raw, how):
                counted = np.bincount(owner, minlength=len(raw))
                words += counted if n == 1 else 0
                some += counted
                np.add.at(weight, owner, shared.value[bucket])  # whole numbers, which weights of bincount aren't
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *map(pa.array, (words, some, weight))], names=schema.names)

    return frame.mapInArrow(weigh, schema)


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), *keep: str) -> DataFrame:
    """doc_id, kept columns, n_words, n_features, weight, score and rank (from 1 on, null if not drawn) of every document."""
    rows = weighed(docs, gains(docs, target, how), how, "doc_id", *keep)
    mark = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = materialise(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint")), "weighed")
    able = rows.where(F.col("n_words") >= how.min_words).withColumn("_down", -F.col("score"))
    placed = ranked(able, [], ["_down", "doc_id", "weight"], "resampled").drop("_down")
    number = F.when(F.col("rank") < F.floor(F.col("size") * how.percent / 100), F.col("rank") + 1)
    rest = rows.where(F.col("n_words") < how.min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.withColumn("rank", number.cast("bigint")).drop("size").unionByName(rest)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def oracle(how: Resampling = Resampling()) -> str:
    """The same rows in SQL; checksums go through all different n-grams a byte at a time."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = " UNION ALL ".join(f"SELECT src, k, array_to_string(w[i:i + {n - 1}], ' ') AS f FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM w)" for n in range(1, how.longest + 1))
    return rf"""WITH RECURSIVE
w AS (SELECT 0 AS src, row_number() OVER () AS k, doc_id, {words} AS w FROM documents UNION ALL SELECT 1, -row_number() OVER (), NULL, {words} FROM benchmark),
g AS (SELECT src, k, f, count(*) AS c FROM ({grams}) GROUP BY ALL),
tab AS (SELECT b::UBIGINT AS b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1))) AS v FROM range(256) t(b)),
crc(f, h, i, c) AS (SELECT f, hex(encode(f)), 0, 4294967295::UBIGINT FROM (SELECT DISTINCT f FROM g)
  UNION ALL SELECT f, h, i + 1, xor(c >> 8, v) FROM crc JOIN tab ON b = xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) WHERE 2 * i < length(h)),
fb AS (SELECT f, xor(c, 4294967295) % {how.buckets} AS bucket FROM crc WHERE 2 * i = length(h)),
gb AS (SELECT src, k, bucket, sum(c)::DOUBLE AS c FROM g JOIN fb USING (f) GROUP BY ALL),
st AS (SELECT bucket, coalesce(sum(c) FILTER (src = 0), 0) AS s, coalesce(sum(c) FILTER (src = 1), 0) AS t FROM gb GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM st),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + {how.buckets}) / ((s + 1) * (tt + {how.buckets}))))::BIGINT AS gain FROM st, tot),
d AS (SELECT k, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS weight FROM gb JOIN gain USING (bucket) WHERE src = 0 GROUP BY k),
r AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{how.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (k) WHERE src = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {how.min_words} ORDER BY score DESC, doc_id NULLS FIRST, weight) AS p, count(*) OVER (PARTITION BY n_words >= {how.min_words}) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {how.min_words} AND p <= n * {how.percent} // 100 THEN p END AS rank FROM o"""


ORACLE_OP12 = oracle()
