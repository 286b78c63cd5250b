"""Broken lines of observation files."""

import datetime as dt

from roadpulse.sources import observations as O

HEADER = "obs_id," + ",".join(O.OBSERVATION.names)
GOOD = "1,None,280.5,0.0,0.0,40,Clouds,few clouds,2023-01-01 05:00:00,512"
EMPTY = "2,,,,,,,,,"
QUOTED = '3,"New, Year",281.0,0.25,0.0,75,Rain,"light, rain",2023-01-01 06:00:00,9'
BROKEN = {
    "4,None,280.5,0.0": "fields",
    GOOD + ",more": "fields",
    "x,None,280.5,0.0,0.0,40,Clouds,few clouds,2023-01-01 05:00:00,512": "obs_id",
    "6,None,warm,0.0,0.0,40,Clouds,few clouds,2023-01-01 05:00:00,512": "temp",
    "7,None,280.5,0.0,0.0,40.5,Clouds,few clouds,2023-01-01 05:00:00,512": "clouds_all",
    "8,None,280.5,0.0,0.0,40,Clouds,few clouds,2023-02-30 05:00:00,512": "date_time",
    "9,None,280.5,0.0,0.0,40,Clouds,few clouds,noon,many": "date_time",
    "10,None,280.5,0.0,0.0,40,Clouds,few clouds,2023-01-01 05:00:00,99999999999": "traffic_volume",
}


def written(tmp_path, lines):
    path = tmp_path / "observations.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_rows_and_rejected_lines(spark, tmp_path):
    path = written(tmp_path, [GOOD, EMPTY, QUOTED, *BROKEN, "", GOOD])
    rows, rejected = O.split_observations(spark, path, extra="obs_id long")
    assert {(r.text, r.reason) for r in rejected.collect()} == set(BROKEN.items())
    got = sorted(rows.collect(), key=lambda r: r.obs_id)
    assert [r.obs_id for r in got] == [1, 1, 2, 3] and got[2].date_time is None and got[2].holiday is None
    assert got[3].holiday == "New, Year" and got[3].date_time == dt.datetime(2023, 1, 1, 6)
    assert rows.select("obs_id").count() == 4 and rejected.count() == len(BROKEN)  # also where few columns are asked for
    clean = written(tmp_path, [GOOD, EMPTY, QUOTED])
    assert rows.dtypes == O.read_observations(spark, clean, extra="obs_id long").dtypes
    both = O.split_observations(spark, clean, extra="obs_id long")
    assert both[1].count() == 0 and both[0].collect() == O.read_observations(spark, clean, extra="obs_id long").collect()


def test_other_time_formats_and_zones(spark, tmp_path):
    """The hour that a zone leaves out in spring stays what the file says."""
    lines = [GOOD.replace("2023-01-01 05:00:00", t) for t in ("26.03.2023 02:30", "31.12.2023 23:59", "2023-01-01 05:00:00")]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        rows, rejected = O.split_observations(spark, written(tmp_path, lines), extra="obs_id long", time_format="dd.MM.yyyy HH:mm")
        times = sorted(r.t for r in rows.selectExpr("CAST(date_time AS STRING) AS t").collect())
        assert times == ["2023-03-26 02:30:00", "2023-12-31 23:59:00"]
        assert [r.reason for r in rejected.collect()] == ["date_time"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_quarantine_grows(spark, tmp_path):
    _, rejected = O.split_observations(spark, written(tmp_path, [GOOD, *BROKEN]), extra="obs_id long")
    kept = str(tmp_path / "kept")
    O.quarantine(rejected, kept)
    O.quarantine(rejected, kept)
    counts = {r.reason: r["count"] for r in spark.read.parquet(kept).groupBy("reason").count().collect()}
    assert counts == {"fields": 4, "obs_id": 2, "temp": 2, "clouds_all": 2, "date_time": 4, "traffic_volume": 2}
