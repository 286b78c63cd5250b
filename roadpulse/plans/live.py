"""The combined report: now, next hour, 24-hour risk, corridor with its summary, and alerts per condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.aggregates import LAGS
from roadpulse.operators.corridor import at_or_above, coded_segments, summary_columns, with_corridor
from roadpulse.operators.explain import contributing_factors, narrative
from roadpulse.operators.features import condition_features, default_lags
from roadpulse.operators.scoring import RISK_DEFAULTS, Scorer, class_probabilities, score_conditions, trend

NOW, NEXT = -2, -1


def _slots(conditions: DataFrame, hourly_lags: DataFrame) -> DataFrame:
    """26 rows per condition: now, the next hour, and 24 hours under typical lags."""
    typical = hourly_lags.select(F.col("hour").alias("_slot"), *[F.col(c).alias(f"_{c}") for c in LAGS])
    rows = (
        conditions.transform(default_lags)
        .withColumn("_slot", F.explode(F.sequence(F.lit(NOW), F.lit(23))))
        .join(F.broadcast(typical), "_slot", "left")  # 24 rows
    )
    ahead, risk = F.col("_slot") != NOW, F.col("_slot") >= 0
    return rows.withColumns({
        "hour": F.when(risk, F.col("_slot")).when(ahead, F.pmod(F.col("hour") + 1, F.lit(24))).otherwise(F.col("hour")),
        **{c: F.when(risk, F.col(f"_{c}")).otherwise(F.col(c)) for c in LAGS},
        **{c: F.when(ahead, F.lit(v)).otherwise(F.col(c)) for c, v in RISK_DEFAULTS.items()},
    })


def _predictions(conditions: DataFrame, hourly_lags: DataFrame, scorer: Scorer, state: DataFrame) -> DataFrame:
    """The 26 outcomes and the corridor's `state` beside each condition (`scenario_id` is unique). All slots are scored in one
    pass; the aggregation has numeric keys and buffers only, so it hashes and combines before the
    shuffle, and the wide condition columns meet it once per scenario instead of 26 times. Outcomes stay numbers until
    the corridor is joined: texts and nested rows, many times as wide, are made after the last shuffle."""
    scored = score_conditions(_slots(conditions, hourly_lags), scorer)
    slot = F.col("_slot")
    sure = getattr(scorer, "has_probabilities", True)
    picks = [
        F.max(F.when(slot == i, F.col(c))).alias(f"{c}_{i}")
        for i in range(NOW, 24) for c in (("pred_code", "confidence") if sure else ("pred_code",))
    ]
    classes = range(len(V.CONGESTION_LABELS)) if sure else ()
    picks += [
        F.max(F.when(slot == i, F.col("probabilities")[c])).alias(f"share_{c}_{i}") for i in (NOW, NEXT) for c in classes
    ]
    wide = conditions.join(scored.groupBy("scenario_id").agg(*picks), "scenario_id").withColumn("base_code", F.col(f"pred_code_{NOW}"))
    found = [c for c in state.columns if c not in ("corridor_id", "base_code")]
    wide = with_corridor(wide, state, "left")

    def outcome(hour, code, confidence, *more: Column) -> Column:
        return F.struct(
            hour.alias("hour"), C.level_label(code).alias("label"), code.alias("code"),
            confidence.alias("confidence"), C.risk_score(code).alias("risk_score"), *more,
        )

    def probabilities(i: int) -> Column:
        shares = F.array(*[F.col(f"share_{c}_{i}") for c in classes]) if sure else F.lit(None).cast("array<double>")
        return class_probabilities(shares).alias("probabilities")

    unknown = F.lit(None).cast("double")
    conf = lambda i: F.col(f"confidence_{i}") if sure else unknown
    one = lambda i, hour: outcome(hour, F.col(f"pred_code_{i}"), conf(i), probabilities(i))
    # A lambda over the 24 values keeps the generated code small enough to be compiled.
    each = F.array(*[F.struct(F.col(f"pred_code_{i}").alias("c"), conf(i).alias("p")) for i in range(24)])
    hour = F.col("hour")
    return wide.select(
        *conditions.columns, "base_code", *found,
        one(NOW, hour).alias("_now"),
        one(NEXT, F.pmod(hour + 1, F.lit(24))).alias("next_hour"),
        F.transform(each, lambda x, i: outcome(i, x["c"], x["p"])).alias("risk_forecast"),
    )


def live_report(
    conditions: DataFrame, hourly_lags: DataFrame, segments: DataFrame, scorer: Scorer, level: str = "High"
) -> DataFrame:
    """One nested row per condition: current prediction with its class probabilities and explanation, next hour, 24-hour
    risk, corridor, its summary and alerts. Corridor state, summary and alerts are looked up per (corridor, base code);
    a condition without corridor has counts of 0. A scorer without probabilities gives empty maps."""
    t = F.col("date_time")
    timed = conditions.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "as_of": F.to_date(t),
    })
    seg = F.struct("ordinal", "name", "factor", "segment_label", "segment_code", "color_hex", "is_bottleneck")
    state = coded_segments(segments).groupBy("corridor_id", "base_code").agg(
        F.array_sort(F.collect_list(seg)).alias("corridor"),
        F.array_sort(F.collect_list(F.when(at_or_above(level), seg))).alias("_hits"),
        F.struct(*[c.alias(n) for n, c in summary_columns().items()]).alias("_summary"),
    )
    told = (
        _predictions(timed, hourly_lags, scorer, state)
        .transform(condition_features)
        .withColumn("_factors", contributing_factors())
        .withColumn("current", F.struct(
            "_now.*", F.col("_factors").alias("factors"),
            narrative(F.col("_now.label"), F.col("_factors")).alias("narrative"),
        ))
    )
    counts = ("severe_count", "high_count", "total_segments")
    summary = F.struct(
        *[F.coalesce(F.col(f"_summary.{c}"), F.lit(0)).alias(c) for c in counts], "_summary.worst_segment", "_summary.safest_segment"
    )
    hits = F.coalesce("_hits", F.array())  # no segment, no alert
    return told.select(
        "scenario_id",
        *[c.alias(n) for n, c in C.time_texts(t).items()],
        "current", "next_hour",
        trend(F.col("current.code"), F.col("next_hour.code")).alias("trend"),
        "risk_forecast", "corridor", summary.alias("corridor_summary"),
        F.struct(
            hits.alias("segments"), F.size(hits).alias("alert_count"),
            (F.size(hits) > 0).alias("alert_active"),
        ).alias("alerts"),
    )
