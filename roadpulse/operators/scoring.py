"""Scoring of condition rows. A scorer is a function DataFrame -> DataFrame that adds `pred_code`
(int) and `probabilities` (array of double, null for rules without them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.features import condition_features

Scorer = Callable[[DataFrame], DataFrame]


def rule_scorer(column: str = "traffic_lag_1h", bins=V.CONGESTION_BINS) -> Scorer:
    """The class of a past volume as prediction; with the default column, persistence."""

    def score(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "pred_code": C.nearest_code(F.col(column), bins),
            "probabilities": F.lit(None).cast("array<double>"),
        })

    score.has_probabilities = False
    return score


def confidence(pred_code: Column, probabilities: Column) -> Column:
    """Probability of the predicted class in percent."""
    return F.round(F.try_element_at(probabilities, (pred_code + 1).cast("int")) * 100, 1)


def with_prediction(df: DataFrame, scorer: Scorer) -> DataFrame:
    scored = scorer(df)
    code, probs = F.col("pred_code"), F.col("probabilities")
    return scored.withColumn("label", C.level_label(code)).withColumn("confidence", confidence(code, probs))


def score_conditions(conditions: DataFrame, scorer: Scorer, edge: str = "serve") -> DataFrame:
    return with_prediction(condition_features(conditions, edge), scorer)


def class_probabilities(probabilities: Column) -> Column:
    """Map from class name to percent, one decimal; empty without probabilities."""
    names = F.array(*[F.lit(n) for n in V.CONGESTION_LABELS])
    pct = F.transform(probabilities, lambda p: F.round(p * 100, 1))
    return F.coalesce(F.map_from_arrays(names, pct), F.create_map().cast("map<string,double>"))


def score_hours(conditions: DataFrame, scorer: Scorer, hours: list[int] | None = None) -> DataFrame:
    """Several hours under the same conditions. `hours` as a list, or an array column of that name
    per row; `position` keeps the input order."""
    listed = F.col("hours") if hours is None else F.array(*[F.lit(h) for h in hours])
    rest = [c for c in conditions.columns if c not in ("hour", "hours")]
    rows = conditions.select(*rest, F.posexplode(listed).alias("position", "hour"))
    return score_conditions(rows, scorer)


def score_now(conditions: DataFrame, scorer: Scorer, at: str = "date_time") -> DataFrame:
    """Time fields from a timestamp column instead of a clock."""
    t = F.col(at)
    timed = conditions.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "as_of": F.to_date(t),
    })
    return score_conditions(timed, scorer).withColumns(C.time_texts(t))


# --- 24-hour risk -----------------------------------------------------------------------

RISK_DEFAULTS = {"snow_1h": 0.0, "clouds_all": 40}


def hourly_conditions(conditions: DataFrame, hourly_lags: DataFrame) -> DataFrame:
    """Each scenario at 24 hours with the typical lags of the hour. `hourly_lags` has 24 rows."""
    lags = ("traffic_lag_1h", "traffic_lag_24h", "traffic_rolling_3h", "traffic_rolling_6h")
    rest = [c for c in conditions.columns if c not in (*lags, "hour", *RISK_DEFAULTS)]
    return (
        conditions.select(*rest, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
        .withColumns({k: F.lit(v) for k, v in RISK_DEFAULTS.items()})
        .join(F.broadcast(hourly_lags), "hour")  # 24 rows
    )


def risk_by_hour(conditions: DataFrame, hourly_lags: DataFrame, scorer: Scorer) -> DataFrame:
    scored = score_conditions(hourly_conditions(conditions, hourly_lags), scorer)
    return scored.withColumn("risk_score", C.risk_score(F.col("pred_code")))


def hour_bits(condition: Column) -> Column:
    """Aggregate: the matching hours as a bit set. A primitive buffer keeps the aggregation hashed,
    where lists or structs would make it sort."""
    return F.bit_or(F.when(condition, F.call_function("shiftleft", F.lit(1), F.col("hour"))).otherwise(0))


def hour_texts(bits: Column) -> Column:
    """The hours of a bit set as clock texts in order."""
    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.getbit(bits, h) == 1)
    return F.transform(hours, C.clock)


def worst_hour(code: Column, hour: Column) -> Column:
    """Aggregate: code and hour of the highest code, the first hour on ties, in one number."""
    return F.max(code * 24 + (23 - hour))


def risk_summary(risk: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Peak hour (the first on ties), mean risk, severe and high hours. The 24 rows of a scenario
    leave the explode together, so they combine before the shuffle."""
    code, hour = F.col("pred_code"), F.col("hour")
    bits = risk.groupBy(key).agg(
        worst_hour(code, hour).alias("_worst"),
        F.round(F.sum("risk_score") / F.count("risk_score"), 1).alias("avg_risk"),
        hour_bits(code == 3).alias("_severe"),
        hour_bits(code == 2).alias("_high"),
    )
    return bits.select(
        key, C.clock(23 - F.col("_worst") % 24).alias("peak_hour"), "avg_risk",
        hour_texts(F.col("_severe")).alias("severe_hours"), hour_texts(F.col("_high")).alias("high_hours"),
    )


# --- next hour --------------------------------------------------------------------------

def next_hour_outlook(conditions: DataFrame, scorer: Scorer) -> DataFrame:
    """The prediction one hour on (same day) beside the current one; the trend compares codes."""
    slots = F.array(*[F.lit(i) for i in (0, 1)])
    both = conditions.withColumn("_slot", F.explode(slots)).withColumn(
        "hour", F.pmod(F.col("hour") + F.col("_slot"), F.lit(24))
    )
    scored = score_conditions(both, scorer)
    pick = lambda slot, c: F.max(F.when(F.col("_slot") == slot, F.col(c)))
    out = scored.groupBy("scenario_id").agg(
        pick(0, "pred_code").alias("code"), pick(1, "hour").alias("next_hour"),
        pick(1, "pred_code").alias("next_code"), pick(1, "confidence").alias("next_confidence"),
    )
    code, following = F.col("code"), F.col("next_code")
    return out.withColumns({
        "label": C.level_label(code), "next_label": C.level_label(following), "trend": trend(code, following)
    })


def trend(code: Column, following: Column) -> Column:
    return F.when(following > code, "up").when(following < code, "down").when(following == code, "steady")
