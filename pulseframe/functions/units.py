"""Unit conversions as column functions, with a registry of converters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEET = 3.2808399


@dataclass(frozen=True)
class Converter:
    """from_units and to_units are (label, unit) pairs; None in from_units stands for any."""

    name: str
    from_units: tuple[str | None, str | None]
    to_units: tuple[str, str]
    forward: Callable[[Column], Column]
    back: Callable[[Column], Column]


def linear(name: str, from_units, to_units, gain: float, offset: float = 0.0, reference: float = 0.0) -> Converter:
    return Converter(name, from_units, to_units, lambda v: (v - reference) * gain + offset, lambda v: (v - offset) / gain + reference)


# Fixed values of the two-layer atmosphere: ratios of sea level pressure at 11 and 20 km, exponents and slopes.
LAYER_RATIO, TOP_RATIO = 4.47704808656731, 18.507221149648668
LAPSE, LOW_EXPONENT, LAYER_DROP, LAYER_M = -0.0065, 0.1902632365084836, 71.5, 11000.0
LOG_SLOPE, LAYER_SLOPE = -0.03416319473631036, -0.02279120549896569
GRAVITY, MOLAR, GAS, TOP_M, TOP_PA = 9.80665, 0.0289644, 8.31432, 20000.0, 5474.89


def altitude_m(p: Column, temp_c: float = 15.0, sealevel_pa: float = 101325.0) -> Column:
    """Metres for a pressure in pascals, in the two lower layers of the atmosphere; 20,000 beyond them."""
    kelvin, ratio = temp_c + 273.15, F.lit(sealevel_pa) / p
    upper = kelvin - LAYER_DROP
    low = F.lit(kelvin) * (F.pow(p / sealevel_pa, F.lit(LOW_EXPONENT)) - 1.0) / LAPSE
    high = F.ln(p / sealevel_pa) * (upper / LOG_SLOPE) + (upper / LAYER_SLOPE + LAYER_M)
    return F.when(ratio < LAYER_RATIO, low).when(ratio < TOP_RATIO, high).otherwise(F.lit(TOP_M))


def pressure_pa(h: Column, temp_c: float = 15.0, sealevel_pa: float = 101325.0) -> Column:
    """Pascals for a height in metres; 5474.89 above 20,000."""
    kelvin = temp_c + 273.15
    power, upper = GRAVITY * MOLAR / (GAS * LAPSE), kelvin + LAYER_M * LAPSE
    low = F.lit(sealevel_pa) * F.pow(F.lit(kelvin) / (F.lit(kelvin) + h * LAPSE), F.lit(power))
    high = F.lit(sealevel_pa * (kelvin / upper) ** power) * F.exp((h - LAYER_M) * (-GRAVITY * MOLAR / (GAS * upper)))
    return F.when(h < LAYER_M, low).when(h <= TOP_M, high).otherwise(F.lit(TOP_PA))


CONVERTERS: dict[str, Converter] = {}


def register_converter(c: Converter) -> Converter:
    CONVERTERS[c.name] = c
    return c


for _c in (
    linear("celsius_to_fahrenheit", (None, "°C"), ("Temperature", "°F"), 1.8, 32.0),
    linear("celsius_to_kelvin", (None, "°C"), ("Temperature", "K"), 1.0, 273.15),
    linear("gravity_to_mps2", ("Acceleration", "g"), ("Acceleration", "m/s²"), 9.806649999788),
    linear("metres_to_feet", (None, "m"), ("Distance", "ft"), FEET),
    linear("pascal_to_psi", (None, "Pa"), ("Pressure", "psi"), 0.000145037738),
    linear("pascal_to_atm", (None, "Pa"), ("Pressure", "atm"), 9.86923266716e-06),
    Converter("pressure_to_metres", ("Pressure", "Pa"), ("Altitude", "m"), altitude_m, pressure_pa),
    Converter("pressure_to_feet", ("Pressure", "Pa"), ("Altitude", "ft"), lambda p: altitude_m(p) * FEET, lambda h: pressure_pa(h / FEET)),
):
    register_converter(_c)


def convert(name: str, v: Column) -> Column:
    return CONVERTERS[name].forward(v)


def revert(name: str, v: Column) -> Column:
    return CONVERTERS[name].back(v)


def converters_table(spark: SparkSession) -> DataFrame:
    rows = [(c.name, *c.from_units, *c.to_units) for c in CONVERTERS.values()]
    return spark.createDataFrame(rows, "converter string, c_label string, c_unit string, to_label string, to_unit string")


def applicable_converters(sources: DataFrame) -> DataFrame:
    """Converters for each (label, unit) in use. The converter table is as large as the registry, so it is broadcast."""
    c = F.broadcast(converters_table(sources.sparkSession))
    fits = (F.col("c_label").isNull() | (F.col("c_label") == F.col("label"))) & (F.col("c_unit").isNull() | (F.col("c_unit") == F.col("unit")))
    return sources.select("label", "unit").distinct().join(c, fits).select("label", "unit", "converter", "to_label", "to_unit")
