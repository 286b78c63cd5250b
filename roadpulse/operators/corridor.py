"""Corridor state: a prediction projected onto the segments of a corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.scoring import Scorer, hour_bits, hour_texts, score_conditions, worst_hour
from roadpulse.schema import SEGMENT

N_CLASSES = len(V.CONGESTION_LABELS)
SALTS = 16
ALERT_COLUMNS = (
    "name", "exit", "factor", "segment_label", "color_hex", "lat_center", "lon_center", "is_bottleneck"
)


def default_segments(spark: SparkSession, corridor_id: int = 0) -> DataFrame:
    rows = [
        (corridor_id, i, name, exit_, factor, [list(p) for p in points])
        for i, (name, exit_, factor, points) in enumerate(V.DEFAULT_SEGMENTS)
    ]
    return spark.createDataFrame(rows, SEGMENT)


# --- dimension --------------------------------------------------------------------------

def _middle(coords: Column) -> Column:
    return F.element_at(coords, (F.floor(F.size(coords) / 2) + 1).cast("int"))


def segment_metadata(segments: DataFrame) -> DataFrame:
    mid = _middle(F.col("coords"))
    return segments.select(
        "corridor_id", "ordinal", "name", "exit", "factor",
        mid[0].alias("lat_center"), mid[1].alias("lon_center"),
        (F.col("factor") > 1.0).alias("is_bottleneck"),
    )


def segment_list(segments: DataFrame) -> DataFrame:
    return segment_metadata(segments).select(
        "corridor_id", "ordinal", "name", "exit", "factor", "is_bottleneck"
    ).orderBy("corridor_id", "ordinal")


def segments_by_factor(segments: DataFrame) -> DataFrame:
    return segment_metadata(segments).select(
        "corridor_id", "ordinal", "name", "exit", "factor", "is_bottleneck"
    ).orderBy(F.desc("factor"), "corridor_id", "ordinal")


def coded_segments(segments: DataFrame) -> DataFrame:
    """Every segment under each of the four base codes: the adjusted class depends on nothing else,
    so this small table answers any number of conditions."""
    base = F.explode(F.array(*[F.lit(i) for i in range(N_CLASSES)])).alias("base_code")
    code = F.col("segment_code")
    return (
        segment_metadata(segments).select("*", base)
        .withColumn("segment_code", C.segment_code(F.col("base_code"), F.col("factor")))
        .withColumns({
            "segment_label": C.level_label(code),
            "color_hex": C.lookup(V.LEVEL_COLORS, C.level_label(code)),
        })
    )


# --- state ------------------------------------------------------------------------------

def base_predictions(conditions: DataFrame, scorer: Scorer) -> DataFrame:
    return score_conditions(conditions, scorer).select(
        "scenario_id", "corridor_id", F.col("pred_code").alias("base_code"),
        F.col("label").alias("base_label"), F.col("confidence").alias("base_confidence"),
    )


def with_corridor(base: DataFrame, per_code: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`base` joined with rows per (corridor, base code).

    One corridor may hold any share of the conditions, and all of it may have one code. Where the right side is too large for
    Spark to broadcast it by its size, or the left is a stream, such a key would be one task: so conditions are dealt by a
    salt too, and the right side, which does not grow with them, has a copy per salt.
    """
    salted = base.withColumn("_salt", F.pmod(F.xxhash64("scenario_id"), F.lit(salts)).cast("int"))
    copies = per_code.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["corridor_id", "base_code", "_salt"], how).drop("_salt")


def corridor_state(base: DataFrame, segments: DataFrame, salts: int = SALTS, level: str | None = None) -> DataFrame:
    """One row per condition and segment of its corridor, at or above `level` where one is given. The segments of a corridor under a code are one array, so the
    join moves a condition once, whatever the number of segments, and the rows fan out after it."""
    coded = coded_segments(segments)
    if level is not None:
        coded = coded.where(at_or_above(level))
    own = [c for c in coded.columns if c not in ("corridor_id", "base_code")]
    per_code = coded.groupBy("corridor_id", "base_code").agg(F.collect_list(F.struct(*own)).alias("_segments"))
    return with_corridor(base, per_code, salts=salts).select(*base.columns, F.inline("_segments"))


def summary_columns() -> dict[str, Column]:
    """Aggregates over the coded segments of a corridor: counts by level, worst and safest segment."""
    code, factor, ordinal = F.col("segment_code"), F.col("factor"), F.col("ordinal")
    rank = lambda c: F.min(F.struct(c.alias("c"), (-factor).alias("f"), ordinal, F.col("name")))["name"]
    return {
        "severe_count": F.count_if(code == 3),
        "high_count": F.count_if(code == 2),
        "total_segments": F.count(F.lit(1)),
        "worst_segment": rank(-code),
        "safest_segment": rank(code),
    }


def corridor_summary(base: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts, worst and safest segment per condition. The summary is computed once per corridor
    and base code, then looked up, so conditions neither fan out nor shuffle by scenario."""
    per_code = coded_segments(segments).groupBy("corridor_id", "base_code").agg(
        *[c.alias(n) for n, c in summary_columns().items()]
    )
    counts = ("severe_count", "high_count", "total_segments")
    return with_corridor(base, per_code, "left").fillna(0, subset=list(counts))


def at_or_above(level: str | Column) -> Column:
    """Condition for segments at or above a level; an unknown level counts as High."""
    wanted = F.lit(level) if isinstance(level, str) else level
    return F.col("segment_code") >= C.level_code(wanted, V.CONGESTION_LABELS.index("High"))


def bottlenecks(state: DataFrame, level: str | Column = "High", short: bool = False) -> DataFrame:
    hit = state.where(at_or_above(level))
    return hit.select("scenario_id", *ALERT_COLUMNS) if short else hit


def alert_block(base: DataFrame, segments: DataFrame, level: str = "High") -> DataFrame:
    """Alerted segment names in corridor order, their number and an active flag, per condition;
    prepared per corridor and base code like the summary."""
    hit = F.when(at_or_above(level), F.struct("ordinal", "name"))
    per_code = coded_segments(segments).groupBy("corridor_id", "base_code").agg(
        F.array_sort(F.collect_list(hit)).alias("_hits")
    )
    hits = F.coalesce("_hits", F.array())  # a corridor without segments has no alert
    return with_corridor(base, per_code, "left").select(
        "scenario_id", "corridor_id", "base_code",
        hits["name"].alias("segments"),
        F.size(hits).alias("alert_count"),
        (F.size(hits) > 0).alias("alert_active"),
    )


# --- named segments ---------------------------------------------------------------------

def find_segments(requests: DataFrame, segments: DataFrame, query: str = "segment_query") -> DataFrame:
    """Resolve a segment text per request within its corridor: equal ignoring case, else the first
    segment that contains it. Unmatched requests stay, with nulls and an error text."""
    cand = segments.select("corridor_id", "ordinal", "name", "factor")
    # Distinct texts only: repeated requests never multiply the comparison.
    asked = requests.select("corridor_id", F.col(query).alias("_q")).where(F.col(query).isNotNull()).distinct()
    asked = asked.withColumn("_low", F.lower("_q"))
    first = F.min(F.struct("ordinal", "name", "factor")).alias("m")
    equal = (
        asked.join(cand.withColumn("_low", F.lower("name")), ["corridor_id", "_low"])
        .groupBy("corridor_id", "_q", "_low").agg(first)
    )
    part = (
        asked.join(equal, ["corridor_id", "_q", "_low"], "left_anti")
        .join(cand, "corridor_id").where(F.lower("name").contains(F.col("_low")))
        .groupBy("corridor_id", "_q", "_low").agg(first)
    )
    found = equal.unionByName(part).select(
        "corridor_id", "_q", F.col("m.name").alias("segment_name"), F.col("m.factor").alias("segment_factor")
    )
    out = requests.withColumn("_q", F.col(query)).join(found, ["corridor_id", "_q"], "left").drop("_q")
    missing = F.concat(F.lit("Segment '"), F.col(query), F.lit("' not found."))
    known = segments.groupBy("corridor_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name")))["name"].alias("_known"))
    lost = F.col("segment_name").isNull()
    return (
        out.withColumn("error", F.when(lost, missing)).join(known, "corridor_id", "left")
        .withColumn("available_segments", F.when(lost, F.coalesce("_known", F.array().cast("array<string>")))).drop("_known")
    )


def segment_history(requests: DataFrame, segments: DataFrame, scorer: Scorer) -> DataFrame:
    """The named segment of each request at 24 hours; unmatched requests have no hours."""
    matched = find_segments(requests, segments).where(F.col("segment_name").isNotNull())
    rest = [c for c in matched.columns if c != "hour"]
    hours = matched.select(*rest, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    code = F.col("code")
    return (
        score_conditions(hours, scorer)
        .withColumn("code", C.segment_code(F.col("pred_code"), F.col("segment_factor")))
        .select(
            "scenario_id", "segment_name", "segment_factor", "hour", C.clock(F.col("hour")).alias("hour_str"),
            C.level_label(code).alias("label"), "code", C.risk_score(code).alias("risk_score"),
        )
    )


def segment_history_summary(history: DataFrame) -> DataFrame:
    code, hour = F.col("code"), F.col("hour")
    bits = history.groupBy("scenario_id", "segment_name", "segment_factor").agg(
        worst_hour(code, hour).alias("_worst"), hour_bits(code == 0).alias("_safe")
    )
    worst = F.col("_worst")
    return bits.select(
        "scenario_id", "segment_name", "segment_factor",
        C.clock(23 - worst % 24).alias("peak_hour"),
        C.level_label(F.floor(worst / 24).cast("int")).alias("peak_label"),
        hour_texts(F.col("_safe")).alias("safe_hours"),
        (F.col("segment_factor") > 1.0).alias("is_bottleneck"),
    )
