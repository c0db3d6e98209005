"""Names, paths, rates and codes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exit conditions by code. Fixed values.
EXIT_CONDITIONS = {1: "button", 2: "usb", 3: "time limit", 4: "low battery", 5: "file size limit", 128: "i/o error"}

#: Words that can't be column names of an export. Fixed values.
RESERVED = ("break", "case", "catch", "continue", "else", "elseif", "end", "for", "function", "global", "if", "otherwise", "persistent", "return", "switch", "try", "while")

#: Short names that some recorders write, and their full forms. Fixed values.
FULL_NAMES = {"Control Pad P": "Control Pad Pressure", "Control Pad T": "Control Pad Temperature"}


def rate(text: Column) -> Column:
    """A number or a ratio 'a/b' as a double; null where it is neither."""
    parts = F.split(F.trim(text), r"\s*/\s*")
    return F.try_divide(parts[0].try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))


def path(*names: Column) -> Column:
    return F.concat_ws(":", *names)


def session_path(base: Column, session_id: Column) -> Column:
    return F.when(session_id == 0, base).otherwise(F.format_string("%s (session %d)", base, session_id))


def subchannel_name(name: Column, channel: Column, subchannel_id: Column) -> Column:
    """The given name in its full form; without one, the channel's name and the number."""
    full = name
    for short, long in FULL_NAMES.items():
        full = F.when(name == short, F.lit(long)).otherwise(full)
    return F.coalesce(full, F.format_string("%s:%02d", channel, subchannel_id))


def display_name(name: Column, label: Column, default: Column) -> Column:
    """The label before the name, unless the name has it; the label alone where there is no name, the name (or default) where there is no label."""
    plain = F.coalesce(name, default)
    labelled = F.when(name.isNull(), label).when(F.contains(name, label), name).otherwise(F.format_string("%s: %s", label, name))
    return F.when(label.isNull() | (label == ""), plain).otherwise(labelled)


def axis(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+")[0]


def units(own: Column, parent: Column) -> Column:
    return F.coalesce(own, parent)


def wall_time(utc_start_s: Column, t_us: Column) -> Column:
    return F.timestamp_micros((utc_start_s * 1_000_000 + t_us).cast("bigint"))


def map_range(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    return F.try_divide((x - low) * (to_high - to_low), F.lit(high - low)) + to_low


def exit_condition(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in EXIT_CONDITIONS.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def sanitise(name: str) -> str:
    """A column name of letters, digits and underscores; 'v' goes before one that starts with a digit or is reserved."""
    import re

    clean = re.sub(r"\W+", "_", name.strip(), flags=re.ASCII).strip("_") or "v"
    return f"v{clean.title()}" if clean[0].isdigit() or clean in RESERVED else clean
