"""Spectra and band-limited RMS, of segments and of whole series. A Fourier transform is the one thing here that no column function expresses.

A whole series of any length n is transformed as a convolution with a chirp, on a circle of m = rows x columns places, a power of two of at least 2 n - 1. Each of the two
transforms that this takes goes over the columns of the circle, written as a matrix, and then over its rows; between the two, numbers are turned by their twiddle factors. The
forward one's rows are the inverse one's columns, so series are shuffled by columns, to the chirp, by rows and by columns again. A task holds a few columns or rows, of about
the square root of m numbers each; what a group of columns hands to a group of rows, or back, is one row of a table, a tile. The chirp is made from its formula, once for all
series of a length, and joined tile by tile. Nothing of a series meets in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import K
from .stats import long_form


def band_rms(samples: DataFrame, period_us: float, low_hz: float, high_hz: float, segment: int = 4096) -> DataFrame:
    """RMS of the frequencies in [low, high] of each subchannel in segments of a fixed number of samples, which bound memory."""
    rows = long_form(samples).withColumn("segment", F.floor(F.col("idx") / segment).cast("bigint"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*K, "subchannel_id", "segment").schema) + ", n bigint, rms double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("idx")["v"].to_numpy()
        bins = np.fft.rfft(v, norm="ortho")
        hz = np.fft.rfftfreq(len(v), period_us / 1e6)
        power = np.abs(bins) ** 2 * np.where((hz == 0) | (2 * np.arange(len(bins)) == len(v)), 1, 2)
        return pd.DataFrame([[*key, len(v), float(np.sqrt(power[(hz >= low_hz) & (hz <= high_hz)].sum() / len(v)))]])

    return rows.groupBy(*K, "subchannel_id", "segment").applyInPandas(one, schema)


#: Numbers of a group of columns or rows that go to a task, at least one of them; a power of two.
GROUP = 1 << 16


def _shape(n: int) -> tuple[int, int]:
    """Rows and columns of the circle for n samples."""
    bits = max(2 * n - 2, 1).bit_length()
    return 1 << (bits + 1) // 2, 1 << bits // 2


def _steps(n: int, group: int) -> tuple[int, int]:
    """Rows and columns of a tile: how many of either are a group."""
    high, wide = _shape(n)
    return min(max(group // wide, 1), high), min(max(group // high, 1), wide)


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi j j / n); the square is reduced in whole numbers, so large places lose nothing."""
    j = j % (2 * n)
    return np.exp(-1j * np.pi * ((j * j) % (2 * n)) / n)


def _turn(place: np.ndarray, by: np.ndarray, m: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((place[:, None] * by[None, :]) % m) / m)


def _columns(values: np.ndarray, which: np.ndarray, m: int, sign: int) -> np.ndarray:
    """First half of a transform: values has a row per column of the circle; the result is turned."""
    found = np.fft.fft(values, axis=1) if sign < 0 else np.fft.ifft(values, axis=1)
    return found * _turn(which, np.arange(values.shape[1]), m, sign)


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _table(names: list[str], key: tuple, count: int, **columns: pa.Array) -> pa.Table:
    """count rows with the same key."""
    return pa.table({name: pa.array([x.as_py()] * count, x.type) for name, x in zip(names, key)} | columns)


def _cut(names: list[str], key: tuple, values: np.ndarray, step: int, across: str, kind: str) -> pa.Table:
    """Tiles of a group: values has a row for each of its columns or rows, which is cut into runs of step; across is the number of the run."""
    count = values.shape[1] // step
    tiles = values.reshape(len(values), count, step).transpose(1, 0, 2).reshape(count, -1)
    return _table(names, key, count, **{across: pa.array(np.arange(count)), f"{kind}_re": _lists(tiles.real), f"{kind}_im": _lists(tiles.imag)})


def _laid(table: pa.Table, step: int, across: str, kind: str) -> np.ndarray:
    """The tiles that meet in a group, all there are, as a row for each of its step columns or rows."""
    order = np.argsort(table[across].to_numpy())
    re, im = (table[f"{kind}_{part}"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order] for part in ("re", "im"))
    return (re + 1j * im).reshape(len(order), -1, step).transpose(2, 0, 1).reshape(step, -1)


def spectrum(samples: DataFrame) -> DataFrame:
    """K, subchannel_id, n (samples of the series), k and re, im of each frequency k / n per sample, k up to n / 2, of whole series of numbered samples.

    Null values count as 0. A series whose idx has holes has zeros there.
    """
    keys, group = [*K, "subchannel_id"], GROUP
    ends = samples.groupBy(*K).agg((F.max("idx") + 1).cast("bigint").alias("n"), F.max(F.size("raw")).alias("_subs")).where("_subs > 0")
    bits = F.length(F.bin(F.greatest(2 * F.col("n") - 2, F.lit(1))))
    wide, high = F.pow(F.lit(2), F.floor(bits / 2)).cast("bigint"), F.pow(F.lit(2), F.floor((bits + 1) / 2)).cast("bigint")
    step = F.least(F.greatest(F.floor(F.lit(group) / high), F.lit(1)), wide)
    ends = ends.withColumns({"_wide": wide, "_step": step, "_groups": F.sequence(F.lit(0).cast("bigint"), F.floor(wide / step) - 1)})
    rows = samples.select(*K, "idx", "raw").join(ends, K)
    # the last sample goes to all groups of columns, so that none is without a row where idx has holes
    at = F.when(F.col("idx") == F.col("n") - 1, F.col("_groups")).otherwise(F.array(F.floor(F.col("idx") % F.col("_wide") / F.col("_step"))))
    full = F.transform(F.array_repeat(F.lit(0), F.col("_subs")), lambda _, i: F.get("raw", i).cast("double"))
    rows = long_form(rows.select(*K, "n", F.col("idx").cast("bigint").alias("idx"), F.explode(at).alias("c"), full.alias("raw")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", n bigint"

    def columns_first(key: tuple, table: pa.Table) -> pa.Table:
        """Of the samples with their chirp: place wide * p + q, all p of some q."""
        n, c = (x.as_py() for x in key[-2:])
        (high, wide), (rows, columns) = _shape(n), _steps(n, group)
        place, v = table["idx"].to_numpy(), table["v"].fill_null(0.0).to_numpy()
        own = place % wide // columns == c
        place, v = place[own], v[own]
        held = np.zeros((columns, high), complex)
        held[place % wide - c * columns, place // wide] = v * _chirp(place, n)
        which = np.arange(c * columns, (c + 1) * columns)
        return _cut([*keys, "n", "c"], key, _columns(held, which, high * wide, -1), rows, "r", "a")

    def chirp_columns(key: tuple, table: pa.Table) -> pa.Table:
        """The same of the chirp that the samples are convolved with, from its formula."""
        n, c = (x.as_py() for x in key)
        (high, wide), (rows, columns) = _shape(n), _steps(n, group)
        m, which = high * wide, np.arange(c * columns, (c + 1) * columns)
        place = np.arange(high)[None, :] * wide + which[:, None]
        held = np.where((place < n) | (place > m - n), np.conj(_chirp(np.minimum(place, m - place), n)), 0)
        return _cut(["n", "c"], key, _columns(held, which, m, -1), rows, "r", "b")

    def rows_then_back(key: tuple, table: pa.Table) -> pa.Table:
        """Some rows p: the forward transform at p + high * k, times the chirp's, and the first half of the inverse one, whose columns these are."""
        n, r = (x.as_py() for x in key[-2:])
        (high, wide), (rows, columns) = _shape(n), _steps(n, group)
        a, b = (np.fft.fft(_laid(table, rows, "c", x), axis=1) for x in "ab")
        which = np.arange(r * rows, (r + 1) * rows)
        return _cut([*keys, "n", "r"], key, _columns(a * b, which, high * wide, 1), columns, "c", "a")

    def columns_last(key: tuple, table: pa.Table) -> pa.Table:
        """Some q: the convolution at q + wide * k, with its chirp the spectrum there."""
        n, c = (x.as_py() for x in key[-2:])
        (high, wide), (_, columns) = _shape(n), _steps(n, group)
        found = np.fft.ifft(_laid(table, columns, "r", "a"), axis=1)
        place = np.arange(c * columns, (c + 1) * columns)[:, None] + wide * np.arange(high)[None, :]
        kept = place <= n // 2
        place = place[kept]
        x = found[kept] * _chirp(place, n)
        return _table([*keys, "n"], key[:-1], 1, k=_lists(place[None, :]), re=_lists(x.real[None, :]), im=_lists(x.imag[None, :]))

    tile = "c bigint, r bigint, {0}_re array<double>, {0}_im array<double>"
    turned = rows.select(*keys, "n", "c", "idx", "v").groupBy(*keys, "n", "c").applyInArrow(columns_first, f"{kinds}, {tile.format('a')}")
    sizes = ends.select("n", F.explode("_groups").alias("c")).distinct()
    chirps = sizes.groupBy("n", "c").applyInArrow(chirp_columns, f"n bigint, {tile.format('b')}")
    # Spark takes the chirp for as small as what it is made from and would broadcast it
    met = turned.join(chirps.hint("merge"), ["n", "c", "r"])
    back = met.groupBy(*keys, "n", "r").applyInArrow(rows_then_back, f"{kinds}, r bigint, c bigint, a_re array<double>, a_im array<double>")
    found = back.groupBy(*keys, "n", "c").applyInArrow(columns_last, f"{kinds}, k array<bigint>, re array<double>, im array<double>")
    return found.select(*keys, "n", F.inline(F.arrays_zip("k", "re", "im")))


def series_band_rms(samples: DataFrame, period_us: float, low_hz: float, high_hz: float) -> DataFrame:
    """n and RMS of the frequencies in [low, high] of each subchannel of whole series."""
    rows = spectrum(samples).withColumn("_hz", F.col("k") / (F.col("n") * F.lit(period_us / 1e6)))
    twice = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1).otherwise(2)
    power = F.when((F.col("_hz") >= low_hz) & (F.col("_hz") <= high_hz), (F.col("re") ** 2 + F.col("im") ** 2) * twice).otherwise(0.0)
    return rows.groupBy(*K, "subchannel_id", "n").agg((F.sqrt(F.sum(power)) / F.col("n")).alias("rms"))
