"""The stream writes what the batch computes."""

from pyspark.sql import functions as F

from roadpulse.catalog.scenes import RULE
from roadpulse.schema import CONDITIONS
from roadpulse.sources import bindings as B
from roadpulse.streaming.scoring_stream import corridor_alerts, read_condition_stream, run_alert_stream

KEEP = ("scenario_id", "name", "segment_code")


def _conditions(spark, sf_dir):
    have = B.conditions(spark, sf_dir)
    return have.select(*[
        F.col(f.name).cast(f.dataType) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in CONDITIONS.fields
    ])


def test_stream_equals_batch_over_two_arrivals(spark, sf_dir, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows, seg = _conditions(spark, sf_dir), B.segments(spark, sf_dir)
    for part in (0, 1):
        rows.where(F.col("scenario_id") % 2 == part).write.mode("append").parquet(source)
        q = run_alert_stream(read_condition_stream(spark, source, 1), seg, RULE, out, state)
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select(*KEEP).collect()))
    assert got == sorted(map(tuple, corridor_alerts(rows, seg, RULE).select(*KEEP).collect())) and got


def test_arriving_files_are_bounded_in_rows(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from roadpulse.catalog import scenes

    paths, place = [], scenes.scratch_path
    monkeypatch.setattr(scenes, "ARRIVING_ROWS", 100)
    monkeypatch.setattr(scenes, "scratch_path", lambda *a: paths.append(place(*a)) or paths[-1])
    scenes._stream(spark, sf_dir)
    sizes = [r["count"] for r in spark.read.parquet(paths[0]).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 110


def test_alerts_do_not_depend_on_salts(spark, sf_dir):
    from roadpulse.catalog import scenes
    from roadpulse.operators.corridor import bottlenecks

    conditions, segments = scenes.B.conditions(spark, sf_dir), scenes.B.segments(spark, sf_dir)
    found = [corridor_alerts(conditions, segments, scenes.RULE, salts=n) for n in (1, 16)] + [bottlenecks(scenes._state(spark, sf_dir))]
    a, b, c = (sorted(map(str, d.select("scenario_id", "ordinal", "name", "segment_code").collect())) for d in found)
    assert a == b == c and a
