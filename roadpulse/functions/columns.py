"""Column expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse import fixed_values as V


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict, key: Column, default=None) -> Column:
    """Dictionary lookup as a literal map; no join, no shuffle."""
    found = literal_map(pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def nth(values, index: Column) -> Column:
    """The value at a 0-based index of a fixed list, null outside it."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def flag(condition: Column) -> Column:
    return condition.cast("int")


# --- congestion -------------------------------------------------------------------------

def congestion_code(volume: Column, bins=V.CONGESTION_BINS) -> Column:
    """Right-closed classes, lowest edge included, null outside the outer edges."""
    code = F.when((volume < bins[0]) | (volume > bins[-1]), F.lit(None).cast("int"))
    for i, upper in enumerate(bins[1:]):
        code = code.when(volume <= upper, F.lit(i))
    return code


def nearest_code(volume: Column, bins=V.CONGESTION_BINS) -> Column:
    """As `congestion_code`, with volumes beyond the outer edges in the outer classes."""
    code = F.when(volume <= bins[1], F.lit(0))
    for i, upper in enumerate(bins[2:-1], start=1):
        code = code.when(volume <= upper, F.lit(i))
    return F.when(volume.isNotNull(), code.otherwise(F.lit(len(bins) - 2)))


def level_label(code: Column, labels=V.CONGESTION_LABELS) -> Column:
    return nth(labels, code)


def level_code(label: Column, default: int | None = None) -> Column:
    return lookup({name: i for i, name in enumerate(V.CONGESTION_LABELS)}, label, default)


def risk_score(code: Column) -> Column:
    """Code over the highest code, in percent; a lookup, as there are four codes."""
    top = len(V.CONGESTION_LABELS) - 1
    return nth([round(c / top * 100, 1) for c in range(top + 1)], code)


def segment_code(base_code: Column, factor: Column) -> Column:
    """Left-closed cut of code times factor."""
    x = base_code * factor
    code = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(V.SEGMENT_EDGES):
        code = code.when(x < edge, F.lit(i))
    return code.otherwise(F.lit(len(V.SEGMENT_EDGES)))


# --- calendar ---------------------------------------------------------------------------

def between(col: Column, bounds: tuple) -> Column:
    return col.between(*bounds)


def rush_columns(hour: Column) -> dict[str, Column]:
    morning, evening = between(hour, V.MORNING_RUSH), between(hour, V.EVENING_RUSH)
    return {
        "is_morning_rush": flag(morning),
        "is_evening_rush": flag(evening),
        "is_rush_hour": flag(morning | evening),
        "rush_type": F.when(evening, 2).when(morning, 1).otherwise(0),
    }


def cycle(col: Column, period: int) -> tuple[Column, Column]:
    angle = col * F.lit(2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def cycle_columns(hour: Column, month: Column) -> dict[str, Column]:
    hs, hc = cycle(hour, 24)
    ms, mc = cycle(month, 12)
    return {"hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc}


def day_short(dow: Column) -> Column:
    return nth(V.DAYS_SHORT, dow)


def day_long(dow: Column) -> Column:
    return nth(V.DAYS_LONG, dow)


def month_short(month: Column) -> Column:
    return nth(V.MONTHS_SHORT, month - 1)


def clock(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def iso_text(t: Column) -> Column:
    """ISO text with microseconds, from the fields of the timestamp: no detour through a time zone."""
    seconds = F.lpad(F.extract(F.lit("SECOND"), t).cast("string"), 9, "0")
    return F.format_string("%sT%02d:%02d:%s", F.to_date(t).cast("string"), F.hour(t), F.minute(t), seconds)


def time_texts(t: Column) -> dict[str, Column]:
    return {
        "timestamp": iso_text(t),
        "local_time": F.format_string("%02d:%02d", F.hour(t), F.minute(t)),
        "day_name": day_long(F.weekday(t)),
        "date": F.to_date(t).cast("string"),
    }


# --- weather ----------------------------------------------------------------------------

def rain_level(rain: Column, edge: str = "train") -> Column:
    """`train`: right-closed bins, null outside. `serve`: left-closed at 2.5 and 7.6."""
    if edge == "serve":
        return F.when(rain == 0, 0).when(rain < V.RAIN_EDGES[2], 1).when(rain < V.RAIN_EDGES[3], 2).otherwise(3)
    if edge != "train":
        raise ValueError("edge must be 'train' or 'serve'")
    level = F.when((rain <= V.RAIN_EDGES[0]) | (rain > V.RAIN_EDGES[-1]), F.lit(None).cast("int"))
    for i, upper in enumerate(V.RAIN_EDGES[1:]):
        level = level.when(rain <= upper, F.lit(i))
    return level


def weather_severity(rain: Column, snow: Column, edge: str = "train") -> Column:
    return (rain_level(rain, edge) + flag(snow > 0)).cast("double")


def weather_code(weather: Column) -> Column:
    return lookup(V.WEATHER_CODES, weather, V.UNKNOWN_WEATHER_CODE).cast("double")


# --- text -------------------------------------------------------------------------------

def thousands(x: Column) -> Column:
    """Whole part with thousands separators."""
    return F.format_number(x.cast("long"), 0)


def percent_over(x: Column, base: Column) -> Column:
    """Excess of x over base in percent, the divisor floored at 1."""
    return F.round((x - base) / F.greatest(base, F.lit(1.0)) * 100, 1)


def template(text: str, fields: dict[str, Column]) -> Column:
    """Fill braced words of a text with columns."""
    args, fmt = [], text.replace("%", "%%")
    order = sorted((fmt.index("{" + k + "}"), k) for k in fields if "{" + k + "}" in fmt)
    for _, k in order:
        if fmt.count("{" + k + "}") != 1:
            raise ValueError(f"{k} must occur once")
        fmt = fmt.replace("{" + k + "}", "%s")
        args.append(fields[k].cast("string"))
    return F.format_string(fmt, *args) if args else F.lit(text)


def fixed(value: Column, digits: int) -> Column:
    """Text with `digits` (1 or 2) decimals of a double from 0 to 8,191: its exact binary value rounded half to even.

    Spark's own formatting rounds the shortest decimal instead, half up.
    """
    bits = F.when(value < 4, F.lit(60)).otherwise(F.lit(50))  # the value is a whole number of 2^-bits
    unit = F.pow(F.lit(2.0), bits)
    tens = 10 ** digits
    scaled = (value * unit).cast("bigint").cast("decimal(20,0)") * F.lit(tens).cast("decimal(3,0)")
    whole = unit.cast("bigint").cast("decimal(20,0)")
    rest = scaled % whole
    down = ((scaled - rest) / whole).cast("bigint")
    up = (rest * 2 > whole) | ((rest * 2 == whole) & (down % 2 == 1))
    n = down + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / tens).cast("string"), F.lit("."), F.lpad((n % tens).cast("string"), digits, "0"))
