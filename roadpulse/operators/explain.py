"""Rule-based explanation, action plans and system findings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.aggregates import peak_summary
from roadpulse.operators.ranking import by_priority
from roadpulse.operators.scoring import Scorer, class_probabilities, score_conditions


# --- contributing factors and narrative -------------------------------------------------

def _factor(when: Column, text: Column | str, impact: str, detail: str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(when, F.struct(
        text.alias("factor"), F.lit(impact).alias("impact"), F.lit(V.FACTOR_DETAIL[detail]).alias("detail")
    ))


def contributing_factors() -> Column:
    """Ordered array of (factor, impact, detail) from the feature columns of the row."""
    hour, rain, snow, lag = (F.col(c) for c in ("hour", "rain_1h", "snow_1h", "traffic_lag_1h"))
    rush, weekend = F.col("is_rush_hour") == 1, F.col("is_weekend") == 1
    at = lambda text: F.format_string(text + " (%d:00)", hour)
    rush_text = F.when(hour < 12, at("Morning rush hour")).otherwise(at("Evening rush hour"))
    volume = C.thousands(lag)
    rules = [
        _factor(rush, rush_text, "high", "rush"),
        _factor(weekend, "Weekend", "reducing", "weekend"),
        _factor(~weekend, F.format_string("Weekday (%s)", C.day_long(F.col("day_of_week"))), "moderate", "weekday"),
        _factor(F.col("is_holiday") == 1, "Public Holiday", "reducing", "holiday"),
        _factor(rain > 5.0, F.format_string("Heavy rain (%s mm/hr)", C.fixed(rain, 1)), "high", "heavy_rain"),
        _factor((rain > 0.5) & (rain <= 5.0), F.format_string("Light rain (%s mm/hr)", C.fixed(rain, 1)), "moderate", "light_rain"),
        _factor(snow > 0, F.format_string("Snow (%s cm)", C.fixed(snow, 2)), "high", "snow"),
        _factor(F.col("weather_code") >= 4, "Poor visibility (fog/thunderstorm)", "high", "visibility"),
        _factor(lag > 4500, F.format_string("Prior hour also heavy (%s vehicles)", volume), "high", "prior_heavy"),
        _factor(lag < 1000, F.format_string("Prior hour was light (%s vehicles)", volume), "reducing", "prior_light"),
        _factor((hour < 5) | (hour >= 23), at("Late night / early morning"), "reducing", "night"),
    ]
    return F.array_compact(F.array(*rules))


def _named(factors: Column, impact: str) -> Column:
    return F.transform(F.filter(factors, lambda f: f["impact"] == impact), lambda f: f["factor"])


def narrative(label: Column, factors: Column) -> Column:
    def sentence(lead: str, impact: str) -> Column:
        names = _named(factors, impact)
        return F.when(F.size(names) > 0, F.concat(F.lit(lead), F.array_join(names, ", "), F.lit(".")))

    return F.concat_ws(
        " ", C.lookup(V.LEVEL_SUMMARY, label), sentence("Primary drivers: ", "high"),
        sentence("Mitigating factors: ", "reducing"), C.lookup(V.LEVEL_IMPACT, label),
    )


def level_info(label: Column) -> Column:
    return F.struct(
        C.lookup(V.LEVEL_EMOJI, label).alias("emoji"),
        C.lookup(V.LEVEL_SUMMARY, label).alias("summary"),
        C.lookup(V.LEVEL_IMPACT, label).alias("impact"),
    )


def explain(scored: DataFrame) -> DataFrame:
    """Adds `factors`, `narrative` and `level_info` to scored feature rows."""
    return scored.withColumn("factors", contributing_factors()).withColumns({
        "narrative": narrative(F.col("label"), F.col("factors")),
        "level_info": level_info(F.col("label")),
    })


# --- action plan ------------------------------------------------------------------------

def immediate_actions(label: Column) -> Column:
    plans = F.create_map(*[
        x for level, texts in V.IMMEDIATE_ACTIONS.items() for x in (F.lit(level), F.array(*[F.lit(t) for t in texts]))
    ])
    return F.coalesce(plans[label], F.array().cast("array<string>"))


def contextual_actions(label: Column, confidence: Column, variant: str = "agent") -> Column:
    """Ordered extra actions. `agent` skips a missing or zero confidence, the other variants assume
    90 when it is missing; `tool` adds the police request; `report` knows rush and rain only."""
    text = V.CONTEXT_ACTIONS[variant]
    rush = F.col("is_rush_hour") == 1
    busy = label.isin("High", "Severe")
    unsure = (confidence < 60) & (confidence != 0) if variant == "agent" else F.coalesce(confidence, F.lit(90.0)) < 60
    rules = {
        "rush": rush & busy, "rain": F.col("rain_1h") > 2, "night": F.col("hour") < 6,
        "confidence": unsure, "police": rush & (label == "Severe"),
    }
    return F.array_compact(F.array(*[F.when(rules[k], F.lit(t)) for k, t in text.items()]))


def urgency(label: Column, variant: str = "agent") -> Column:
    return C.lookup(V.URGENCY, label, "LOW" if variant == "agent" else "NORMAL")


def plan_actions(scored: DataFrame, variant: str = "agent") -> DataFrame:
    label = F.col("label")
    return scored.withColumns({
        "immediate_actions": immediate_actions(label),
        "contextual_actions": contextual_actions(label, F.col("confidence"), variant),
        "urgency": urgency(label, variant),
    })


def describe_levels(requests: DataFrame, column: str = "level") -> DataFrame:
    """Emoji, summary and impact per requested level; unknown levels carry an error text."""
    level = F.col(column)
    known = level.isin(*V.CONGESTION_LABELS)
    error = F.concat(F.lit("Unknown level '"), level, F.lit("'. Use: Low, Medium, High, Severe."))
    info = level_info(level)
    return requests.select(
        "*", *[info[f].alias(f) for f in ("emoji", "summary", "impact")], F.when(~known, error).alias("error")
    )


def predict_explain_plan(conditions: DataFrame, scorer: Scorer, variant: str = "agent") -> DataFrame:
    return (
        score_conditions(conditions, scorer)
        .withColumn("class_probabilities", class_probabilities(F.col("probabilities")))
        .transform(explain)
        .transform(plan_actions, variant)
    )


# --- report -----------------------------------------------------------------------------

def congestion_report(conditions: DataFrame, scorer: Scorer, corridor: str = "Corridor") -> DataFrame:
    """Headline, conditions text, narrative and plan per condition. Temperatures round half to even
    and never print a negative zero."""
    hour, rain, label = F.col("hour"), F.col("rain_1h"), F.col("label")
    headline = F.format_string(
        "%s " + corridor.replace("%", "%%") + " Traffic Alert — %s congestion predicted at %s on %s, %s",
        C.lookup(V.LEVEL_EMOJI, label), label, C.clock(hour),
        C.day_long(F.col("day_of_week")), C.month_short(F.col("month")),
    )
    temp = F.bround("temp_celsius", 0).cast("int").cast("string")
    summary = F.concat_ws(
        " · ", C.clock(hour),
        F.when(rain > 0, F.format_string("Rain %smm/hr", C.fixed(rain, 1))),
        F.when(F.col("is_holiday") == 1, "Holiday"),
        F.when(F.col("is_rush_hour") == 1, "Rush hour"),
        F.concat(temp, F.lit("°C")),
    )
    return (
        predict_explain_plan(conditions, scorer, "report")
        .withColumns({"headline": headline, "conditions_summary": summary})
    )


# --- system findings --------------------------------------------------------------------

def findings_from_peak(peak: DataFrame) -> DataFrame:
    """Up to six findings from the one-row peak summary, in fixed order."""
    wd, we, hol, rush = (F.col(c) for c in ("weekday_avg", "weekend_avg", "holiday_avg", "rush_avg"))
    below = lambda x: F.round((wd - x) / F.greatest(wd, F.lit(1.0)) * 100, 1)
    fields = {
        "rush_pct": C.percent_over(rush, wd), "peak_hour": F.col("peak_hour"), "trough_hour": F.col("trough_hour"),
        "weekday_avg": C.thousands(wd), "weekend_avg": C.thousands(we), "diff_pct": below(we),
        "peak_day": F.col("peak_day"), "holiday_avg": C.thousands(hol), "hol_pct": below(hol),
        "top_weather": F.col("top_weather"), "top_volume": C.thousands(F.col("top_weather_avg")),
        "low_weather": F.col("low_weather"), "low_volume": C.thousands(F.col("low_weather_avg")),
        "month_name": C.month_short(F.col("worst_month")),
    }
    rows = []
    for i, (kind, (title, finding, advice, priority)) in enumerate(V.FINDINGS.items()):
        row = F.struct(
            F.lit(i).alias("ordinal"), C.template(title, fields).alias("title"),
            C.template(finding, fields).alias("finding"), C.template(advice, fields).alias("recommendation"),
            F.lit(priority).alias("priority"),
        )
        rows.append(F.when(F.col("top_weather").isNotNull(), row) if kind == "weather" else row)
    return peak.select(F.inline(F.array_compact(F.array(*rows))))


def system_findings(df: DataFrame) -> DataFrame:
    return findings_from_peak(peak_summary(df))


def system_findings_by_priority(df: DataFrame) -> DataFrame:
    return by_priority(system_findings(df))
