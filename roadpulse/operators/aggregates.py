"""Aggregate questions over labelled observations.

Means that several answers share start from `volume_cube`, one pass with map-side combination into
a table whose size depends on the calendar and the weather categories only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.ranking import first_max, first_min, seeded_sample

VOLUME = "traffic_volume"
CUBE_KEYS = ("hour", "day_of_week", "month", "weather_main", "is_holiday")


def _mean(where: Column | None = None) -> Column:
    s, n = F.col("sum_volume"), F.col("n")
    if where is not None:
        s, n = F.when(where, s), F.when(where, n)
    return F.sum(s) / F.sum(n)


def volume_cube(df: DataFrame) -> DataFrame:
    return df.groupBy(*CUBE_KEYS).agg(
        F.sum(F.col(VOLUME).cast("long")).alias("sum_volume"), F.count(VOLUME).alias("n")
    )


# --- means ------------------------------------------------------------------------------

def mean_by(df: DataFrame, *keys: str, digits: int = 1, name: str = "avg_volume") -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(VOLUME), digits).alias(name))


def mean_by_day(df: DataFrame) -> DataFrame:
    return mean_by(df, "day_of_week").withColumn("day_name", C.day_short(F.col("day_of_week")))


def weather_ranking(df: DataFrame) -> DataFrame:
    return mean_by(df, "weather_main").orderBy(F.desc("avg_volume"), "weather_main")


def _conditional_means() -> dict[str, Column]:
    dow, hour = F.col("day_of_week"), F.col("hour")
    rush = C.between(hour, V.MORNING_RUSH) | C.between(hour, V.EVENING_RUSH)
    return {
        "weekend_avg": F.round(_mean(dow >= 5), 1),
        "weekday_avg": F.round(_mean(dow < 5), 1),
        "holiday_avg": F.round(F.coalesce(_mean(F.col("is_holiday") == 1), F.lit(0.0)), 1),
        "rush_avg": F.round(_mean(rush), 1),
    }


def conditional_means(df: DataFrame) -> DataFrame:
    return volume_cube(df).agg(*[c.alias(n) for n, c in _conditional_means().items()])


# --- peak analysis ----------------------------------------------------------------------

_SETS = {"hourly_avg": "hour", "daily_avg": "day_of_week", "monthly_avg": "month", "weather_impact": "weather_main"}


def _profile(df: DataFrame) -> DataFrame:
    """Rounded means per hour, day, month and weather plus the grand row, as one grouping-sets job
    over the cube. `metric` is null on the grand row."""
    keys = list(_SETS.values())
    means = _conditional_means()
    g = volume_cube(df).groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id(*keys).alias("_set"),
        F.round(_mean(), 1).alias("avg"),
        *[c.alias(n) for n, c in means.items()],
    )
    # grouping_id has one bit per key, set where the key is rolled up.
    metric = F.lit(None).cast("string")
    full = 2 ** len(keys) - 1
    for i, name in enumerate(_SETS):
        metric = F.when(F.col("_set") == full - 2 ** (len(keys) - 1 - i), name).otherwise(metric)
    return g.withColumn("metric", metric)


def peak_profile(df: DataFrame) -> DataFrame:
    """Long form of the peak analysis: one row per metric and key."""
    key = (
        F.when(F.col("metric") == "daily_avg", C.day_short(F.col("day_of_week")))
        .when(F.col("metric") == "weather_impact", F.col("weather_main"))
        .otherwise(F.coalesce("hour", "month").cast("string"))
    )
    return _profile(df).where(F.col("metric").isNotNull()).select("metric", key.alias("key"), F.col("avg").alias("value"))


def peak_summary(df: DataFrame) -> DataFrame:
    """The scalar fields of the peak analysis as one row."""
    p = _profile(df)
    only = lambda m: F.when(F.col("metric") == m, F.col("avg"))
    grand = F.col("metric").isNull()
    weather = only("weather_impact")
    # Rank by (-mean, name): the minimum heads the descending ranking, the maximum closes it.
    place = F.when(weather.isNotNull(), F.struct((-weather).alias("v"), F.col("weather_main").alias("k")))
    return p.agg(
        first_max(only("hourly_avg"), F.col("hour")).alias("peak_hour"),
        first_min(only("hourly_avg"), F.col("hour")).alias("trough_hour"),
        C.day_short(first_max(only("daily_avg"), F.col("day_of_week"))).alias("peak_day"),
        first_max(only("monthly_avg"), F.col("month")).alias("worst_month"),
        *[F.max(F.when(grand, F.col(n))).alias(n) for n in _conditional_means()],
        F.min(place)["k"].alias("top_weather"),
        F.max(weather).alias("top_weather_avg"),
        F.max(place)["k"].alias("low_weather"),
        F.min(weather).alias("low_weather_avg"),
    )


def peak_position(df: DataFrame, key: str, digits: int | None = 1) -> DataFrame:
    """Arg-max and arg-min of a grouped mean, first key on ties."""
    m = F.avg(VOLUME) if digits is None else F.round(F.avg(VOLUME), digits)
    return df.groupBy(key).agg(m.alias("_m")).agg(
        first_max(F.col("_m"), F.col(key)).alias(f"peak_{key}"),
        first_min(F.col("_m"), F.col(key)).alias(f"trough_{key}"),
    )


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row: counts, range, volume statistics and the peak fields. The volume histogram holds
    one row per distinct volume, so the exact median needs no raw group."""
    counted = df.groupBy(VOLUME, F.year("date_time").alias("_year")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date_time").alias("lo"), F.max("date_time").alias("hi")
    )
    v = F.col(VOLUME)
    stats = counted.agg(
        F.sum("n").alias("total_records"),
        F.to_date(F.min("lo")).alias("start_date"),
        F.to_date(F.max("hi")).alias("end_date"),
        F.size(F.collect_set("_year")).alias("years_covered"),
        F.round(F.sum(v.cast("long") * F.col("n")) / F.sum("n"), 1).alias("avg_volume"),
        F.percentile(VOLUME, 0.5, F.col("n")).alias("median_volume"),
        F.max(VOLUME).alias("max_volume"),
        F.min(VOLUME).alias("min_volume"),
    )
    peak = peak_summary(df).select(
        "peak_hour", "trough_hour", "peak_day", "weekday_avg", "weekend_avg", "holiday_avg", "rush_avg"
    )
    # one row each: the peaks come as a scalar subquery, without a join
    return stats.withColumn("_peak", peak.select(F.struct("*")).scalar()).select("*", "_peak.*").drop("_peak")


# --- class distribution -----------------------------------------------------------------

def class_distribution(df: DataFrame) -> DataFrame:
    """All four classes, zero-filled, from one conditional aggregation."""
    code = F.col("congestion_code")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count_if(code == i) for i in range(len(V.CONGESTION_LABELS))]).alias("counts"),
    )
    rows = counts.select("total", F.posexplode("counts").alias("congestion_code", "n"))
    return rows.select(
        "congestion_code",
        C.level_label(F.col("congestion_code")).alias("congestion_label"),
        "n",
        F.round(F.col("n") / F.greatest("total", F.lit(1)) * 100, 1).alias("pct"),
    )


def class_share_by_hour(df: DataFrame) -> DataFrame:
    """Class shares in percent per hour over the labelled rows."""
    code = F.col("congestion_code")
    total = F.count(code)
    return df.groupBy("hour").agg(
        *[F.round(F.count_if(code == i) / total * 100, 4).alias(n.lower()) for i, n in enumerate(V.CONGESTION_LABELS)]
    )


def data_profile(df: DataFrame) -> DataFrame:
    code = F.col("congestion_code")
    severe = code == len(V.CONGESTION_LABELS) - 1
    n_severe = F.count_if(severe)
    zero = F.count_if(F.col(VOLUME) == 0)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.to_date(F.min("date_time")).alias("date_range_start"),
        F.to_date(F.max("date_time")).alias("date_range_end"),
        F.size(F.collect_set("year")).alias("years_covered"),
        *[F.count_if(code == i).alias(f"{n.lower()}_count") for i, n in enumerate(V.CONGESTION_LABELS)],
        zero.alias("zero_readings"),
        F.when(zero > 0, F.concat(zero.cast("string"), F.lit(" zero-volume readings detected."))).alias("anomaly"),
        F.round(
            F.count_if(severe & (F.col("is_rush_hour") == 1)) / F.greatest(n_severe, F.lit(1)) * 100, 1
        ).alias("severe_during_rush_pct"),
    )


# --- rush hours, weekdays ---------------------------------------------------------------

def rush_statistics(df: DataFrame) -> DataFrame:
    return conditional_means(df).select(
        F.lit(V.MORNING_RUSH[0]).alias("morning_start"), F.lit(V.MORNING_RUSH[1]).alias("morning_end"),
        F.lit(V.EVENING_RUSH[0]).alias("evening_start"), F.lit(V.EVENING_RUSH[1]).alias("evening_end"),
        "rush_avg", "weekday_avg", "weekend_avg", "holiday_avg",
        C.percent_over(F.col("rush_avg"), F.col("weekday_avg")).alias("rush_premium_pct"),
    )


def weekday_weekend(df: DataFrame) -> DataFrame:
    """Means, difference and the peak hour of each side; peak hours use unrounded means."""
    hourly = df.groupBy("hour").agg(
        *[
            agg(F.when(F.col("is_weekend") == side, F.col(VOLUME).cast("long"))).alias(f"{fn}{side}")
            for side in (0, 1) for fn, agg in (("s", F.sum), ("n", F.count))
        ]
    )
    m = lambda side: F.when(F.col(f"n{side}") > 0, F.col(f"s{side}") / F.col(f"n{side}"))
    out = hourly.agg(
        F.round(F.sum("s0") / F.sum("n0"), 1).alias("weekday_avg"),
        F.round(F.sum("s1") / F.sum("n1"), 1).alias("weekend_avg"),
        first_max(m(0), F.col("hour")).alias("peak_weekday_hour"),
        first_max(m(1), F.col("hour")).alias("peak_weekend_hour"),
    )
    wd, we = F.col("weekday_avg"), F.col("weekend_avg")
    return out.withColumn("diff_pct", F.round((wd - we) / F.greatest(wd, F.lit(1.0)) * 100, 1))


def rush_schedule(df: DataFrame) -> DataFrame:
    return peak_summary(df).select(
        F.lit("7:00 – 9:00 AM").alias("morning_rush"),
        F.lit("4:00 – 6:00 PM").alias("evening_rush"),
        "peak_day", "worst_month",
        C.month_short(F.col("worst_month")).alias("worst_month_name"),
        F.col("rush_avg").alias("rush_avg_volume"),
        F.col("weekday_avg").alias("weekday_avg_volume"),
    )


def _sides(df: DataFrame, key: str, digits: int | None) -> DataFrame:
    m = lambda side: F.avg(F.when(F.col("is_weekend") == side, F.col(VOLUME)))
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return df.groupBy(key).agg(r(m(0)).alias("weekday_avg"), r(m(1)).alias("weekend_avg"))


def weekday_weekend_by_hour(df: DataFrame) -> DataFrame:
    return _sides(df, "hour", None)


def weekday_weekend_by_month(df: DataFrame) -> DataFrame:
    """Twelve months, zero where a side has no rows."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return (
        months.join(_sides(df, "month", 0), "month", "left")
        .select("month", C.month_short(F.col("month")).alias("month_name"), z("weekday_avg"), z("weekend_avg"))
    )


def peak_months(df: DataFrame) -> DataFrame:
    s = _sides(df, "month", None).agg(
        first_max(F.col("weekday_avg"), F.col("month")).alias("weekday_peak_month"),
        first_max(F.col("weekend_avg"), F.col("month")).alias("weekend_peak_month"),
    )
    return s.withColumns({
        "weekday_peak_name": C.month_short(F.col("weekday_peak_month")),
        "weekend_peak_name": C.month_short(F.col("weekend_peak_month")),
    })


# --- pivots and calendar ----------------------------------------------------------------

def _hour_day_pivot(df: DataFrame, value: str, digits: int) -> DataFrame:
    wide = df.groupBy("hour").pivot("day_of_week", list(range(7))).agg(F.round(F.avg(value), digits))
    return wide.select(
        C.clock(F.col("hour")).alias("hour"), *[F.col(str(i)).alias(n) for i, n in enumerate(V.DAYS_SHORT)]
    )


def volume_heatmap(df: DataFrame) -> DataFrame:
    return _hour_day_pivot(df, VOLUME, 0)


def congestion_heatmap(df: DataFrame) -> DataFrame:
    return _hour_day_pivot(df.withColumn("congestion_code", F.col("congestion_code").cast("double")), "congestion_code", 2)


def daily_calendar(df: DataFrame, year: int | None = None) -> DataFrame:
    """Daily means of one calendar year, placed by ISO week. The default year has the most days,
    the smallest such year on ties."""
    date = F.col("date")
    daily = df.groupBy(F.to_date("date_time").alias("date")).agg(F.avg(VOLUME).alias("avg_volume"))
    daily = daily.select(
        "date", F.year(date).alias("year"), F.month(date).alias("month"),
        F.weekofyear(date).alias("week_of_year"), F.weekday(date).alias("day_of_week"),
        F.date_format(date, "MMM dd").alias("day_text"), F.round("avg_volume", 0).alias("avg_volume"),
    )
    if year is not None:
        return daily.where(F.col("year") == year)
    usual = daily.groupBy("year").count().agg(first_max(F.col("count"), F.col("year"))).scalar()
    return daily.where(F.col("year") == usual)


def years_available(df: DataFrame) -> DataFrame:
    return df.select("year").distinct().orderBy("year")


# --- weather ----------------------------------------------------------------------------

def weather_box(df: DataFrame) -> DataFrame:
    """Box statistics per weather, largest median first. Everything follows from the histogram of
    (weather, volume), so a dominant category never gathers in one task."""
    hist = df.groupBy("weather_main", VOLUME).agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col(VOLUME), F.col("n")
    box = hist.groupBy("weather_main").agg(
        F.sum("n").alias("n_rows"),
        F.percentile(VOLUME, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n).alias("_q"),
        F.round(F.sum(v.cast("long") * n) / F.sum("n"), 4).alias("mean"),
        F.min(VOLUME).alias("min"),
        F.max(VOLUME).alias("max"),
    ).select(
        "weather_main", "n_rows", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"), "mean", "min", "max",
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    fences = hist.join(box.select("weather_main", "q1", "q3"), "weather_main").groupBy("weather_main").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(~inside, n).otherwise(0)).alias("n_outliers"),
    )
    return box.join(fences, "weather_main").orderBy(F.desc("median"), "weather_main")


def rain_sample(df: DataFrame, rows: int = 3000, seed: int = 42, key: str = "obs_id") -> DataFrame:
    rainy = df.where(F.col("rain_1h") > 0).select(key, "rain_1h", VOLUME, "congestion_label")
    return seeded_sample(rainy, rows, seed, key)


def temperature_profile(df: DataFrame) -> DataFrame:
    """Mean per right-closed temperature bin; outside the edges dropped, empty bins absent."""
    lo, hi, width = V.TEMPERATURE_BINS
    t = F.col("temp_celsius")
    upper = (F.ceil((t - lo) / width) * width + lo).cast("int")
    binned = df.where((t > lo) & (t <= hi)).groupBy(upper.alias("_upper")).agg(F.avg(VOLUME).alias("avg_volume"))
    return binned.select(
        (F.col("_upper") - width).alias("bin_low"),
        F.format_string("(%d, %d]", F.col("_upper") - width, F.col("_upper")).alias("temp_bin"),
        "avg_volume",
    )


def severity_profile(df: DataFrame) -> DataFrame:
    """Mean volume of each severity label, clipped at the last; labels without rows keep a null."""
    last = len(V.SEVERITY_LABELS) - 1
    sev = F.least(F.col("weather_severity"), F.lit(float(last))).cast("int")
    level = F.when(F.col("weather_severity").isNotNull(), sev)
    means = df.agg(
        F.array(*[F.avg(F.when(level == i, F.col(VOLUME))) for i in range(last + 1)]).alias("means")
    )
    return means.select(F.posexplode("means").alias("severity", "avg_volume")).select(
        "severity", C.nth(V.SEVERITY_LABELS, F.col("severity")).alias("severity_label"), "avg_volume"
    )


def weather_extremes(df: DataFrame) -> DataFrame:
    """Best and worst weather on means rounded to whole vehicles and the clear-minus-squall gap."""
    means = mean_by(df, "weather_main", digits=0)
    avg, name = F.col("avg_volume"), F.col("weather_main")
    out = means.agg(
        F.min(F.struct((-avg).alias("v"), name.alias("k")))["k"].alias("best_weather"),
        F.max(avg).cast("long").alias("best_avg"),
        F.min(F.struct(avg.alias("v"), name.alias("k")))["k"].alias("worst_weather"),
        F.min(avg).cast("long").alias("worst_avg"),
        F.coalesce(F.max(F.when(name == "Clear", avg)), F.lit(0.0)).alias("_clear"),
        F.coalesce(F.max(F.when(name == "Squall", avg)), F.min(avg)).alias("_squall"),
    )
    return out.withColumn("clear_gap", (F.col("_clear") - F.col("_squall")).cast("long")).drop("_clear", "_squall")


def wet_dry(df: DataFrame) -> DataFrame:
    rain, v = F.col("rain_1h"), F.col(VOLUME)
    wet, dry = rain > 0, rain == 0
    return df.agg(
        F.count_if(wet).alias("rainy_rows"),
        F.round(F.count_if(wet) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1).alias("rainy_pct"),
        F.avg(F.when(wet, v)).cast("long").alias("wet_avg"),
        F.avg(F.when(dry, v)).cast("long").alias("dry_avg"),
    )


# --- median lags ------------------------------------------------------------------------

LAGS = ("traffic_lag_1h", "traffic_lag_24h", "traffic_rolling_3h", "traffic_rolling_6h")


def median_lags_by_hour(df: DataFrame) -> DataFrame:
    """Exact medians of the four lag features per hour, from histograms of (hour, feature, value)."""
    long = df.select("hour", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(LAGS)
    ])).alias("x"))
    hist = long.groupBy("hour", F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("hour").agg(
        *[F.percentile(F.when(F.col("i") == i, F.col("v")), 0.5, F.col("n")).alias(c) for i, c in enumerate(LAGS)]
    )


def complete_hours(medians: DataFrame) -> DataFrame:
    """24 rows; an hour without history takes the median of the hourly medians."""
    hours = medians.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    every = Window.partitionBy(F.lit(0))  # 24 rows
    return hours.join(medians, "hour", "left").select(
        "hour", *[F.coalesce(c, F.percentile(c, 0.5).over(every)).alias(c) for c in LAGS]
    )
