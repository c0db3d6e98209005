"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a weighted sum of its own features and those of the lines before and
after it; neighbouring labels are tied by two transition weights. Forward-backward recursions give each
line's marginal, and the mean of the marginals, weighted by line length, is the document's raw quality, which a
two-parameter logistic turns into the score.

Fitting: labels are of documents. Lines start with their document's label; between rounds, lines of bad documents
that look good on their own evidence are relabelled. The field is fitted on a bounded sample (TRAIN_DOCS, by
the hash of the id, and only texts of up to TRAIN_LINES lines); tasks make the features, so no text reaches the driver. Scoring is one narrow
pass over whole texts: the features of a line are made in parts of PART bytes, so that memory beyond the text and its lines is that of their evidence.

Defined cases: null text counts as empty, which is one empty line; lines end at newlines; empty lines weigh as
one character; repeated rows are scored each; null labels and null ids teach nothing; labels of one class only, or none,
give that class's share (none: 0.5) as every score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, is_held_out, table, texts, with_fields
from .toxicity import labelled

#: Labelled rows that the field is fitted on, at most.
TRAIN_DOCS = 4_000
#: Lines of a text that the field is fitted on, at most; longer texts teach nothing.
TRAIN_LINES = 512
ROUNDS, STEPS, RATE, DECAY = 2, 60, 0.1, 1e-4
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
#: Bytes of text whose features are computed together.
PART = 1 << 20

_KINDS = 8
_KIND = np.zeros(256, np.int64)  # 0: letters in lower case and bytes beyond ASCII
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isupper() else 0 if _c.islower() else 2 if _c.isdigit() else 3 if _c.isspace() else 5 if _c == "!" else 6 if _c == "|" else 4 if _c in ".,;:?'\"-()" else 7
OWN = 15
WIDTH = 3 * OWN + 1


def _distinct_share(line: bytes) -> float:
    """1 - distinct words / words; a long line is read in parts."""
    words, n, at = set(), 0, 0
    while at < len(line):
        end = at + PART
        if end < len(line):  # a part ends where a word does
            while end < len(line) and not line[end : end + 1].isspace():
                end += 1
        own = line[at:end].split()
        words.update(own)
        n, at = n + len(own), end
    return 1 - len(words) / n if n else 0.0


def _kind_counts(lines: list[bytes]) -> np.ndarray:
    """Characters of each kind in lines that together hold about PART bytes, or in one long line."""
    if len(lines) == 1:
        data = np.frombuffer(lines[0], np.uint8)
        counts = np.zeros(_KINDS, np.int64)
        for i in range(0, len(data), PART):
            counts += np.bincount(_KIND[data[i : i + PART]], minlength=_KINDS)
        return counts[None, :]
    data = np.frombuffer(b"".join(lines), np.uint8)
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(line * _KINDS + _KIND[data], minlength=len(lines) * _KINDS).reshape(len(lines), _KINDS)


def own_features(lines: list[bytes], again: Counter) -> np.ndarray:
    """The features of lines by themselves (lines x OWN); again: how often a text has each line."""
    kinds = _kind_counts(lines).astype(np.float64)
    size = np.array([len(x) for x in lines], np.float64)
    share = kinds[:, 1:] / np.maximum(size, 1)[:, None]
    repeats = np.array([_distinct_share(x) for x in lines])
    twice = np.array([again[x] > 1 for x in lines], np.float64)
    return np.column_stack([share, np.log1p(size) / 6, size / (kinds[:, 3] + 1) / 10, twice, size < 20, kinds[:, 1] > kinds[:, 0], share[:, 6] > 0.1, share[:, 5] > 0.01, repeats])


def line_parts(lines: list[bytes]) -> Iterator[list[bytes]]:
    """The lines in lists of about PART bytes; a longer line is alone."""
    part, held = [], 0
    for x in lines:
        if part and held + len(x) > PART:
            yield part
            part, held = [], 0
        part.append(x)
        held += len(x) + 32
    if part:
        yield part


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Line features (lines x WIDTH) of texts with so many lines each: own, of the line before and after, and one."""
    first = np.r_[0, np.cumsum(counts)[:-1]]
    before, after = np.vstack([np.zeros((1, OWN)), own[:-1]]), np.vstack([own[1:], np.zeros((1, OWN))])
    before[first], after[first + counts - 1] = 0, 0
    return np.column_stack([own, before, after, np.ones(len(own))])


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features (lines x WIDTH), line lengths and the number of lines of each text."""
    lines = [r.split(b"\n") for r in raws]
    counts = np.array([len(x) for x in lines])
    own = np.concatenate([own_features(part, again) for doc in lines for again in [Counter(doc)] for part in line_parts(doc)])
    return with_neighbours(own, counts), np.array([max(1, len(x)) for doc in lines for x in doc], np.float64), counts


@dataclass
class Field:
    weights: np.ndarray
    good_stays: float = 0.0
    bad_stays: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def evidence(self, lines: list[bytes]) -> np.ndarray:
        """Log-odds of good of each line of a text, from its features and its neighbours'."""
        again, out = Counter(lines), np.full(len(lines), self.weights[-1])
        own, before, after = self.weights[:OWN], self.weights[OWN : 2 * OWN], self.weights[2 * OWN : 3 * OWN]
        at = 0
        for part in line_parts(lines):
            x = own_features(part, again)
            end = at + len(part)
            out[at:end] += x @ own
            out[at + 1 : end + 1] += (x @ before)[: len(lines) - at - 1]
            to = slice(max(0, at - 1), end - 1)
            out[to] += (x @ after)[len(part) - (to.stop - to.start) :]
            at = end
        return out

    def marginals(self, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of good from the evidence: forward, backward and both. Texts advance together, a line at a time."""
        first = np.r_[0, np.cumsum(counts)[:-1]]
        order = np.argsort(-counts, kind="stable")
        first, counts = first[order], counts[order]
        f, b = e.copy(), np.zeros(len(e))
        longest = int(counts[0]) if len(counts) else 0
        active = np.searchsorted(-counts, -np.arange(longest + 1), side="left")  # texts with more lines than t
        for t in range(1, longest):
            at = first[: active[t]] + t
            f[at] += np.logaddexp(f[at - 1] + self.good_stays, 0) - np.logaddexp(f[at - 1], self.bad_stays)
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            z = e[at + 1] + b[at + 1]
            b[at] = np.logaddexp(z + self.good_stays, 0) - np.logaddexp(z, self.bad_stays)
        return f, b, f + b

    def raw_quality(self, e: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of good for each text."""
        p = 1 / (1 + np.exp(-np.clip(self.marginals(e, counts)[2], -30, 30)))
        first = np.r_[0, np.cumsum(counts)[:-1]]
        return np.add.reduceat(p * size, first) / np.add.reduceat(size, first)

    def scores(self, raws: list[bytes]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(raws)
        out, e, size, counts, held = [], [], [], [], 0
        for i, r in enumerate(raws):
            lines = r.split(b"\n")
            e.append(self.evidence(lines))
            size.append(np.array([max(1, len(x)) for x in lines], np.float64))
            counts.append(len(lines))
            held += len(r)
            if held > PART or i + 1 == len(raws):
                out += self.calibrated(self.raw_quality(np.concatenate(e), np.concatenate(size), np.array(counts)))
                e, size, counts, held = [], [], [], 0
        return out

    def calibrated(self, quality: np.ndarray) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.slope * _odds(quality) + self.shift, -30, 30)))).tolist()


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


class _Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        return RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def fit(raws: list[bytes], labels: list[int]) -> Field:
    """A field for texts and their labels."""
    return fit_lines(*features(raws), labels) if raws else fit_lines(np.empty((0, WIDTH)), np.empty(0), np.empty(0, np.int64), [])


def fit_lines(x: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: list[int]) -> Field:
    """Gradient ascent on the conditional likelihood, with relabelling, then the two-parameter logistic. The lines are those of features()."""
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Field(np.zeros(WIDTH), constant=share)
    doc = np.repeat(np.arange(len(counts)), counts)
    joined = doc[1:] == doc[:-1]  # line t and t + 1 are of one text
    truth = y[doc]
    weight = (np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / counts)[doc]  # texts count alike, classes too
    field = Field(np.zeros(WIDTH))
    for round_ in range(ROUNDS):
        adam = _Adam(WIDTH + 2)
        for _ in range(STEPS):
            e = x @ field.weights
            f, b, both = field.marginals(e, counts)
            p = 1 / (1 + np.exp(-np.clip(both, -30, 30)))
            z = (e + b)[1:]
            terms = np.stack([f[:-1] + field.good_stays + z, f[:-1], z, np.full(len(z), field.bad_stays)])
            pair = np.exp(terms - np.logaddexp.reduce(terms, axis=0))
            both_good, both_bad = truth[1:] * truth[:-1], (1 - truth[1:]) * (1 - truth[:-1])
            w = weight[1:] * joined
            g = np.r_[(weight * (truth - p)) @ x, (w * (both_good - pair[0])).sum(), (w * (both_bad - pair[3])).sum()] / len(y)
            step = adam.step(g - DECAY * np.r_[field.weights, field.good_stays, field.bad_stays])
            field.weights = field.weights + step[:-2]
            field.good_stays, field.bad_stays = field.good_stays + float(step[-2]), field.bad_stays + float(step[-1])
        if round_ + 1 < ROUNDS:
            e = x @ field.weights
            worst = np.minimum.reduceat(e, np.r_[0, np.cumsum(counts)[:-1]])[doc]
            truth = np.where((y[doc] == 0) & (e > 0) & (e > worst), 1.0, y[doc])  # a bad text keeps a bad line
    q = _odds(field.raw_quality(x @ field.weights, size, counts))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(slope * q + shift, -30, 30)))
        h = p * (1 - p) + 1e-6
        a = np.array([[(h * q * q).sum() + 1, (h * q).sum()], [(h * q).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(a, np.array([((y - p) * q).sum() - (slope - 1), (y - p).sum()]))
        slope, shift = slope + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
    field.slope, field.shift = max(slope, 1e-3), shift
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, y in zip(*columns(batch, "text", "y")):
                lines = raw.split(b"\n")
                if len(lines) <= TRAIN_LINES:
                    own = np.concatenate([own_features(part, Counter(lines)) for part in line_parts(lines)])
                    rows.append({"own": own.ravel(), "size": [max(1, len(x)) for x in lines], "y": y, "mark": zlib.crc32(raw)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("own", pa.list_(pa.float64())), ("size", pa.list_(pa.int64())), ("y", pa.int32()), ("mark", pa.int64())]))

    rows = labelled(docs, labels, "quality", MODULUS, HELD_OUT, TRAIN_DOCS).mapInArrow(run, "own array<double>, size array<bigint>, y int, mark bigint").toArrow()
    if not rows.num_rows:
        return fit([], [])
    rows = rows.take(np.lexsort([rows.column(c).to_numpy() for c in ("y", "mark")])).combine_chunks()  # whatever order tasks end in
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
    counts = pa.compute.list_value_length(rows.column("size")).to_numpy()
    own = flat("own").reshape(-1, OWN)
    return fit_lines(with_neighbours(own, counts), flat("size").astype(np.float64), counts, rows.column("y").to_pylist())


def score_quality(docs: DataFrame, field: Field, *keep: str) -> DataFrame:
    """The kept columns and score of every row."""
    frame = texts(docs, *keep)
    schema = with_fields(frame, list(keep), "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(field.scores(columns(batch, "text")[0]), pa.float64())], names=schema.names)

    return frame.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", is_held_out("doc_id", MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
