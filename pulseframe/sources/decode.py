"""Packed payloads to samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Format codes: bytes, and the range of values (None: unbounded). Fixed values.
FORMATS = {
    "c": (1, None, None), "b": (1, -128, 127), "B": (1, 0, 255), "?": (1, 0, 1), "h": (2, -32768, 32767), "H": (2, 0, 65535),
    "i": (4, -2147483648, 2147483647), "l": (4, -2147483648, 2147483647), "I": (4, 0, 4294967295), "L": (4, 0, 4294967295),
    "q": (8, -(2**63), 2**63 - 1), "Q": (8, 0, 2**64 - 1), "f": (4, -1.0, 1.0), "d": (8, -1.0, 1.0),
}

Decoder = Callable[[bytes], np.ndarray]
DECODERS: dict[str, Decoder] = {}


def register_decoder(name: str, fn: Decoder) -> None:
    """fn turns a payload into samples x subchannels."""
    DECODERS[name] = fn


def _codes(fmt: str) -> tuple[str, str]:
    return (fmt[0], fmt[1:]) if fmt[0] in "<>=" else ("=", fmt)


def value_type(fmt: str) -> T.DataType:
    """Doubles; formats of whole numbers with 64-bit ones among them keep those exact."""
    _, codes = _codes(fmt) if fmt not in DECODERS else ("=", "d")
    if set(codes) <= set("cbB?hHiIlLqQ") and set(codes) & set("qQ"):
        return T.DecimalType(20, 0) if "Q" in codes else T.LongType()
    return T.DoubleType()


def struct_decoder(fmt: str) -> Decoder:
    """For a format such as '<hHf': byte order, then a code per subchannel."""
    order, codes = _codes(fmt)
    kind = np.dtype([(f"f{i}", order + {"c": "b", "l": "i", "L": "I", "q": "i8", "Q": "u8"}.get(c, c)) for i, c in enumerate(codes)])
    to = {T.LongType(): np.int64, T.DecimalType(20, 0): object}.get(value_type(fmt), np.float64)

    def run(payload: bytes) -> np.ndarray:
        rows = np.frombuffer(payload, kind, len(payload) // kind.itemsize)
        return np.column_stack([rows[n].astype(to) for n in kind.names]) if len(rows) else np.empty((0, len(codes)), to)

    return run


def sample_bytes(fmt: str) -> int:
    return sum(FORMATS[c][0] for c in fmt.lstrip("<>="))


def value_ranges(channels: DataFrame) -> DataFrame:
    """lo and hi that each subchannel's code of a channel's format can hold; rows: channel_id, format. The code table is 14 rows, so it is broadcast."""
    codes = F.broadcast(channels.sparkSession.createDataFrame([(c, *map(float, x[1:])) if x[1] is not None else (c, None, None) for c, x in FORMATS.items()], "code string, lo double, hi double"))
    letters = channels.select("channel_id", F.posexplode(F.split(F.regexp_replace("format", "^[<>=]", ""), "")).alias("subchannel_id", "code")).where("code <> ''")
    return letters.join(codes, "code", "left").select("channel_id", "subchannel_id", "code", "lo", "hi")


def n_samples(payload: str, size: int) -> Column:
    return F.floor(F.octet_length(payload) / size).cast("bigint")


def decode_payload(blocks: DataFrame, fmt: str) -> DataFrame:
    """payload becomes samples, an array of arrays of value_type(fmt): a narrow Arrow stage over flat buffers; a null payload gives null."""
    run, kind = DECODERS.get(fmt) or struct_decoder(fmt), value_type(fmt)
    values = {T.LongType(): pa.int64(), T.DecimalType(20, 0): pa.decimal128(20, 0)}.get(kind, pa.float64())
    keep = [c for c in blocks.columns if c != "payload"]
    schema = T.StructType([*(blocks.schema[c] for c in keep), T.StructField("samples", T.ArrayType(T.ArrayType(kind)))])

    def lists(payloads: list[bytes | None]) -> pa.ListArray:
        rows = [None if x is None else run(x) for x in payloads]
        whole = [r for r in rows if r is not None and len(r)]
        sizes = np.concatenate([np.full(len(r), r.shape[1]) for r in whole]) if whole else np.empty(0, np.int64)
        flat = np.concatenate([r.ravel() for r in whole]) if whole else np.empty(0)
        flat = pa.array(flat.tolist(), values) if flat.dtype == object else pa.array(flat).cast(values)
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
        ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in rows), False])), inner)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = lists(batch.column(batch.schema.get_field_index("payload")).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), out], names=[*keep, "samples"])

    return blocks.mapInArrow(decode, schema)


def pick(decoded: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """A sub-range or stride of each decoded block, before anything is exploded."""
    inside = lambda x, i: (i >= start) & ((i - start) % step == 0) & (F.lit(True) if end is None else i < end)
    return decoded.withColumn("samples", F.filter("samples", inside))


def count_samples(validated: DataFrame, size: str | Column, keys: list[str]) -> DataFrame:
    """Blocks, rejected blocks and samples of those kept, by keys."""
    size = F.col(size) if isinstance(size, str) else size
    n = F.when(F.col("rejected"), F.lit(0)).otherwise(F.floor(F.octet_length("payload") / size))
    return validated.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("rejected").cast("bigint")).alias("rejected"), F.sum(n.cast("bigint")).alias("samples"))


def to_samples(decoded: DataFrame) -> DataFrame:
    keep = [c for c in decoded.columns if c != "samples"]
    return decoded.select(*keep, F.posexplode("samples").alias("pos", "raw"))


def _unsigned(payload: Column, start: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(payload, start, n)), 16, 10).cast("bigint")


def header(payload: Column) -> tuple[Column, Column]:
    """16-bit tick and 8-bit channel at the head of an older block."""
    return _unsigned(payload, 1, 2), _unsigned(payload, 3, 1)


def pressure_temperature(payload: Column) -> tuple[Column, Column]:
    """Five bytes: 18.2 bits of pressure in 24, and 8.4 bits of temperature in 16; the sign is in the first bit."""
    p, t = _unsigned(payload, 1, 3), _unsigned(payload, 4, 2)
    p = F.when(p >= 1 << 23, p - (1 << 24)).otherwise(p)
    t = F.when(t >= 1 << 15, t - (1 << 16)).otherwise(t)
    pressure = F.shiftright(p, 6) + F.shiftright(p, 4).bitwiseAND(F.lit(3)) * 0.25
    return pressure, F.shiftright(t, 8) + F.shiftright(t, 4).bitwiseAND(F.lit(15)) * 0.0625


def inverted_xyz(x: Column, y: Column, z: Column) -> Column:
    return F.array(F.lit(32768) - z, y - 32768, x - 32768)


def validate_blocks(blocks: DataFrame, size: str | Column) -> DataFrame:
    """Rule columns: empty payload, length no multiple of the sample's, ticks out of order; rejected if any holds."""
    size = F.col(size) if isinstance(size, str) else size
    n = F.coalesce(F.octet_length("payload"), F.lit(0))
    rules = {"empty": n == 0, "ragged": n % size != 0, "backwards": F.coalesce(F.col("end_tick") < F.col("start_tick"), F.lit(False))}
    return blocks.withColumns(rules).withColumn("rejected", F.col("empty") | F.col("ragged") | F.col("backwards"))


def route_rejected(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable blocks without the rule columns, and rejected ones with the reason."""
    rules = ("empty", "ragged", "backwards")
    reason = F.concat_ws(",", *(F.when(F.col(c), c) for c in rules))
    return validated.where(~F.col("rejected")).drop(*rules, "rejected"), validated.where("rejected").withColumn("reason", reason).drop(*rules, "rejected")
