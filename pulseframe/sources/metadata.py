"""Attributes, user data, defaults and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import exit_condition, subchannel_name

#: Accelerometer range in g by the number of the recorder's type, of other small numbers, and of larger ones. Fixed values.
ACCEL_RANGE = {16: 25.0, 18: 100.0, 19: 200.0, 20: 500.0, 21: 2000.0, 22: 6000.0}
OTHER_RANGE, UNKNOWN_RANGE = 25.0, 100.0

#: Subchannels of recordings that describe none: channel, subchannel, name, label, unit, lo, hi, sensor. Fixed values.
DEFAULT_SUBCHANNELS = (
    ("0", 0, "Accelerometer Z", "Acceleration", "g", None, None, 0),
    ("0", 1, "Accelerometer Y", "Acceleration", "g", None, None, 0),
    ("0", 2, "Accelerometer X", "Acceleration", "g", None, None, 0),
    ("1", 0, "Pressure", "Pressure", "Pa", 0.0, 120000.0, 1),
    ("1", 1, "Temperature", "Temperature", "°C", -40.0, 80.0, 1),
)

#: Accelerometer transforms of recordings that describe none: each axis scales by the reach; and the one warning range. Fixed values.
DEFAULT_WARNINGS = ((0, "1", 1, -20.0, 60.0),)


def rollup(attributes: DataFrame, multiple: bool = True) -> DataFrame:
    """Attributes of each owner as a map: name to its values in order, or to the last one."""
    value = F.coalesce("v_string", F.col("v_int").cast("string"), F.col("v_double").cast("string"), F.col("v_ts").cast("string"), F.base64("v_binary"))
    rows = attributes.withColumn("_v", value)
    if multiple:
        each = rows.groupBy("recording_id", "owner", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_v"))), lambda x: x["_v"]).alias("_v"))
    else:
        each = rows.groupBy("recording_id", "owner", "name").agg(F.max_by("_v", "ord").alias("_v"))
    return each.groupBy("recording_id", "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "_v")))).alias("attributes"))


def typed_rollup(attributes: DataFrame) -> DataFrame:
    """Attributes of each owner as a map: name to its values in order, each with its kind and in its own type."""
    value = F.struct("kind", "v_int", "v_double", "v_string", "v_binary", "v_ts")
    each = attributes.groupBy("recording_id", "owner", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("_v"))), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)), lambda x: x["_v"]).alias("_v"))
    return each.groupBy("recording_id", "owner").agg(F.map_from_entries(F.collect_list(F.struct("name", "_v"))).alias("attributes"))


def merge_attributes(rows: DataFrame, attributes: DataFrame, *names: str) -> DataFrame:
    """rows (recording_id, owner, ...) with the named attributes as columns, each the array of its values; those of rows' own columns stand before."""
    wide = rollup(attributes.where(F.col("name").isin(*names)))
    out = rows.join(wide, ["recording_id", "owner"], "left")
    return out.select(*rows.columns, *(F.col("attributes")[n].alias(n) for n in names if n not in rows.columns))


def encode_attributes(maps: DataFrame, kinds: Column | None = None) -> DataFrame:
    """Map entries (name to text) as typed rows; the kind is guessed from the text where it isn't given."""
    rows = maps.select("recording_id", "owner", F.posexplode("attributes").alias("ord", "name", "_v"))
    guess = F.when(F.col("_v").rlike(r"^-?\d{1,18}$"), "int").when(F.col("_v").try_cast("double").isNotNull(), "float").when(F.col("_v").try_cast("timestamp").isNotNull(), "date").otherwise("str")
    rows = rows.withColumn("kind", guess if kinds is None else kinds)
    on = lambda k, c: F.when(F.col("kind") == k, c)
    return rows.select(
        "recording_id", "owner", "name", "ord", "kind", on("int", F.col("_v").try_cast("bigint")).alias("v_int"), on("float", F.col("_v").try_cast("double")).alias("v_double"),
        on("str", F.col("_v")).alias("v_string"), on("binary", F.col("_v").cast("binary")).alias("v_binary"), on("date", F.date_trunc("second", F.col("_v").try_cast("timestamp"))).alias("v_ts"),
    )


def exit_conditions(attributes: DataFrame) -> DataFrame:
    """Code and text of each recording's first ExitCond attribute."""
    first = attributes.where("name = 'ExitCond'").groupBy("recording_id").agg(F.min_by("v_int", "ord").alias("code"))
    return first.withColumn("condition", exit_condition(F.col("code")))


def latest_user_data(user_data: DataFrame) -> DataFrame:
    """Value of the latest version of each key; a version of null clears it."""
    last = user_data.groupBy("recording_id", "key").agg(F.max_by("value", "version").alias("value"))
    return last.where(F.col("value").isNotNull())


def replace_user_data(user_data: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (recording_id, key, value) as a new version after the present ones; nothing is rewritten."""
    top = user_data.groupBy("recording_id").agg(F.max("version").alias("_v"))
    fresh = changes.join(top, "recording_id", "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")
    return user_data.unionByName(fresh.select(*user_data.columns))


def accelerometer_range(recorder_type: Column) -> Column:
    """Reach in g, either way of zero. Types above 255 and recordings without a type have the widest default."""
    reach = F.lit(OTHER_RANGE)
    for kind, g in ACCEL_RANGE.items():
        reach = F.when(recorder_type == kind, F.lit(g)).otherwise(reach)
    return F.when(F.coalesce(recorder_type > 255, F.lit(True)), F.lit(UNKNOWN_RANGE)).otherwise(reach)


def default_subchannels(recordings: DataFrame, described: DataFrame) -> DataFrame:
    """The default channels of recordings that describe none, an acceleration's display range by the recorder's type."""
    rows = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, c, k in zip(x, ("channel_id", "subchannel_id", "name", "label", "unit", "lo", "hi", "sensor_id"), ("string", "int", "string", "string", "string", "double", "double", "int")))) for x in DEFAULT_SUBCHANNELS))
    bare = recordings.join(described, "recording_id", "left_anti").withColumn("_g", accelerometer_range(F.col("recorder_type")))
    out = bare.select("recording_id", "_g", F.inline(rows))
    return out.withColumns({"lo": F.coalesce("lo", -F.col("_g")), "hi": F.coalesce("hi", F.col("_g"))}).drop("_g")


def default_sensors(recordings: DataFrame, sensors: DataFrame) -> DataFrame:
    """A sensor and display range for recordings that describe none; recordings: recording_id, recorder_type (a number)."""
    bare, reach = recordings.join(sensors, "recording_id", "left_anti"), accelerometer_range(F.col("recorder_type"))
    return bare.select("recording_id", F.lit(0).alias("sensor_id"), F.lit("Accelerometer").alias("name"), (-reach).alias("lo"), reach.alias("hi"))


def default_warnings(recordings: DataFrame, described: DataFrame) -> DataFrame:
    """The default warning range of recordings that describe none."""
    rows = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, c, k in zip(x, ("warning_id", "channel_id", "subchannel_id", "low", "high"), ("int", "string", "int", "double", "double")))) for x in DEFAULT_WARNINGS))
    return recordings.join(described, "recording_id", "left_anti").select("recording_id", F.inline(rows))


def default_transforms(recordings: DataFrame, described: DataFrame) -> DataFrame:
    """The accelerometer's transform of recordings that describe none: full scale of 16 bits is the reach. recordings: recording_id, recorder_type."""
    bare = recordings.join(described, "recording_id", "left_anti")
    c = F.array(accelerometer_range(F.col("recorder_type")) / 32767.0, F.lit(0.0))
    return bare.select("recording_id", F.lit(0).alias("transform_id"), F.lit("univariate").alias("kind"), c.alias("c"), F.lit(0.0).alias("x_ref"))


# Fixed names of the fields of described sensors, warnings, calibrations and bandwidth limits, and their columns.
SENSOR_FIELDS = {"SensorID": "sensor_id", "SensorName": "name", "TraceabilityData": "trace", "SensorSerialNumber": "serial", "SensorBwLimitIDRef": "bw_limit_id"}
WARNING_FIELDS = {"WarningID": "warning_id", "WarningChannelRef": "channel_id", "WarningSubChannelRef": "subchannel_id", "WarningRangeMin": "low", "WarningRangeMax": "high"}
CALIBRATION_FIELDS = {"CalID": "transform_id", "PolynomialCoef": "c", "CalReferenceValue": "x_ref", "BivariateCalReferenceValue": "y_ref", "BivariateChannelIDRef": "y_channel_id", "BivariateSubChannelIDRef": "y_subchannel_id"}
BANDWIDTH_FIELDS = {"BwLimitID": "bw_limit_id", "BwLimitLower": "lo_cut", "BwLimitUpper": "hi_cut", "BwLimitRolloffLower": "lo_roll", "BwLimitRolloffUpper": "hi_roll"}


def described(recordings: DataFrame, lists: str, fields: dict[str, str]) -> DataFrame:
    """A row for each element of an array column of structs, with the fields of the table under its column names; fields that the structs lack are left out."""
    have = set(recordings.schema[lists].dataType.elementType.names)
    rows = recordings.select("recording_id", F.explode(lists).alias("_x"))
    return rows.select("recording_id", *(F.col("_x")[f].alias(c) for f, c in fields.items() if f in have))


def described_sensors(recordings: DataFrame, lists: str = "sensors") -> DataFrame:
    """Sensors of recordings; those without an id are left out, of an id the first counts."""
    rows = recordings.select("recording_id", F.posexplode(lists).alias("_n", "_x"))
    have = set(recordings.schema[lists].dataType.elementType.names)
    rows = rows.select("recording_id", "_n", *(F.col("_x")[f].alias(c) for f, c in SENSOR_FIELDS.items() if f in have)).where("sensor_id is not null")
    first = rows.groupBy("recording_id", "sensor_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "_n")), "_n").alias("_r"))
    return first.select("_r.*")


def described_warnings(recordings: DataFrame, lists: str = "warnings") -> DataFrame:
    return described(recordings, lists, WARNING_FIELDS)


def described_transforms(recordings: DataFrame, lists: str = "calibrations") -> tuple[DataFrame, DataFrame]:
    """Transforms of recordings, and rejected ones with the reason; four coefficients or a reference to a channel make one bivariate."""
    rows = described(recordings, lists, CALIBRATION_FIELDS)
    for c, kind in (("x_ref", "double"), ("y_ref", "double"), ("y_channel_id", "string"), ("y_subchannel_id", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    two = (F.size("c") == 4) | F.col("y_channel_id").isNotNull()
    return check_transforms(rows.withColumn("kind", F.when(two, "bivariate").otherwise("univariate")))


def described_bandwidths(recordings: DataFrame, lists: str = "bandwidths") -> DataFrame:
    """Bandwidth limits of recordings; those without an id are left out."""
    return described(recordings, lists, BANDWIDTH_FIELDS).where("bw_limit_id is not null")


def subchannel_dimension(described: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per subchannel: the first description wins, undescribed ones get their channel and number for a name, a display range needs
    both ends, a missing label is the unit."""
    order = Window.partitionBy("recording_id", "channel_id", "subchannel_id").orderBy("ord")
    first = described.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "ord")
    every = channels.select("recording_id", "channel_id", *(c for c in channels.columns if c == "channel_name"), F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)).alias("subchannel_id"))
    rows = every.join(first, ["recording_id", "channel_id", "subchannel_id"], "left")
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    channel = F.coalesce("channel_name", F.col("channel_id").cast("string")) if "channel_name" in rows.columns else F.col("channel_id").cast("string")
    name = subchannel_name(F.col("name"), channel, F.col("subchannel_id"))
    return rows.withColumns({"name": name, "label": F.coalesce("label", "unit"), "lo": F.when(both, F.col("lo")), "hi": F.when(both, F.col("hi"))})


def check_transforms(transforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows and rejected ones with the reason."""
    n = F.coalesce(F.size("c"), F.lit(0))
    reason = (
        F.when(F.col("transform_id").isNull(), "no id")
        .when(n < 1, "no coefficients")
        .when((F.col("kind") == "bivariate") & ((n != 4) | F.col("y_channel_id").isNull()), "bivariate needs four coefficients and a channel")
        .when((F.col("kind") == "univariate") & (n > 2), "univariate takes one or two coefficients")
    )
    rows = transforms.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def rename_nested(df: DataFrame, names: dict[str, str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rename and drop fields on every level of nesting, by schema alone."""

    def build(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(build(col[f.name], f.dataType).alias(names.get(f.name, f.name)) for f in kind if f.name not in exclude))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(col, lambda x: build(x, kind.elementType))
        return col

    return df.select(*(build(F.col(f.name), f.dataType).alias(names.get(f.name, f.name)) for f in df.schema if f.name not in exclude))


def bandwidth(sensors: DataFrame, limits: DataFrame) -> DataFrame:
    """Cutoffs and rolloffs of each sensor; a missing reference gives nulls."""
    return sensors.join(limits, ["recording_id", "bw_limit_id"], "left")


def catalogue(subchannels: DataFrame, visibility: int = 0, debug: bool = False) -> DataFrame:
    """Plottable sources by display name: all of them for debugging, else those visible on this level whose name doesn't start with DEBUG."""
    rows = subchannels if debug else subchannels.where((F.col("visibility") <= visibility) & ~F.col("name").startswith("DEBUG"))
    return rows.orderBy("display_name")


def used_channels(channels: DataFrame, subchannels: DataFrame) -> DataFrame:
    return channels.join(subchannels, ["recording_id", "channel_id"], "left_semi")
