"""The versioned log: atomic replacement, repeated batches, crashes, and streams that equal batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidecal.operators import evaluation, weather
from tidecal.sources import versions
from tidecal.streaming.weather import daily_stream

LOG = "made_on date, source string, entity_id int, prediction double"


def rows(spark, *found):
    return spark.createDataFrame([(datetime.date(2024, 1, d), s, e, float(p)) for d, s, e, p in found], LOG)


def held(df):
    return sorted((r.made_on.day, r.source, r.entity_id, r.prediction) for r in df.collect())


BATCHES = [
    [(1, "live", 1, 10), (1, "backtest", 1, 11), (2, "live", 1, 12)],
    [(2, "backtest", 7, 1), (3, "live", 7, 2)],
    # Days 1 and 3 and both sources occur, though not as pairs: all of days 1 and 3 go.
    [(1, "backtest", 2, 20), (3, "live", 2, 21)],
    [(4, None, 3, 30)],
]


def test_batches_replace_what_append_log_replaces(spark, tmp_path):
    log = versions.VersionedLog(spark, str(tmp_path / "log"))
    assert log.read() is None and log.version().number == 0
    want = spark.createDataFrame([], LOG)
    for k, batch in enumerate(BATCHES):
        want = evaluation.append_log(want, rows(spark, *batch))
        assert log.replace(rows(spark, *batch)) and log.version().number == k + 1
        assert held(log.read()) == held(want)
    assert held(log.read(1)) == sorted((d, s, e, float(p)) for d, s, e, p in BATCHES[0])
    assert held(log.read()) == [(1, "backtest", 2, 20.0), (2, "backtest", 7, 1.0), (3, "live", 2, 21.0), (4, "live", 3, 30.0)]
    # A batch writes its own rows alone, and a new column is null in older rows.
    log.replace(rows(spark, (5, "live", 9, 90)).withColumn("more", F.lit("x")))
    assert {r.entity_id: r.more for r in log.read().collect()}[9] == "x" and log.read().where("more is null").count() == 4
    assert sum(f.startswith("load=5/") for f in log.version().folders) == 1


def test_a_crash_before_the_pointer_keeps_the_old_log(spark, tmp_path, monkeypatch):
    log = versions.VersionedLog(spark, str(tmp_path / "log"))
    log.replace(rows(spark, *BATCHES[0]), "s", 0)
    before = held(log.read())

    def crash(self, new):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions.VersionedLog, "_point", crash)
        with pytest.raises(OSError, match="lost"):
            log.replace(rows(spark, (1, "live", 5, 50), (9, "live", 5, 51)), "s", 1)
    assert held(log.read()) == before and log.version().batches == {"s": 0}
    # The batch comes again, with other rows: what the crash left is overwritten.
    assert log.replace(rows(spark, *BATCHES[2]), "s", 1)
    assert held(log.read()) == held(evaluation.append_log(rows(spark, *BATCHES[0]), rows(spark, *BATCHES[2])))
    assert not log.replace(rows(spark, (1, "live", 8, 80)), "s", 1) and not log.replace(rows(spark, (1, "live", 8, 80)), "s", 0)
    assert log.version().number == 2 and log.replace(rows(spark).limit(0), "s", 2) and log.version().batches == {"s": 2}
    # Two writers of one version: the second finds the pointer there.
    with pytest.raises(versions.ConflictError):
        log._point(versions.Version(3, []))


def test_a_stream_into_the_log_equals_its_batches(spark, tmp_path):
    log, source = versions.VersionedLog(spark, str(tmp_path / "log")), str(tmp_path / "in")
    want = spark.createDataFrame([], LOG)
    for k, batch in enumerate(BATCHES):
        rows(spark, *batch).coalesce(1).write.mode("append").parquet(source)
        want = evaluation.append_log(want, rows(spark, *batch))
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(log.writer("live feed")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert held(log.read()) == held(want) and set(log.version().batches) == {"live feed"}
    # The stream's state is lost and everything is delivered again, with the same batch ids: nothing changes.
    number = log.version().number
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(log.writer("live feed")).option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start().awaitTermination()
    assert log.version().number == number and held(log.read()) == held(want)


def test_streamed_station_days_equal_the_batch(spark, tmp_path):
    hours = spark.range(24 * 12).selectExpr("concat('s', id % 2) as station", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id div 2 as int)) as hour", "cast(id % 17 as double) as temp", "if(id % 5 = 0, null, cast(id % 3 as double) / 10) as precip", "1 as lead")
    hours.orderBy("hour").coalesce(1).write.parquet(str(tmp_path / "in"))
    # A row of a later month moves the watermark past every day.
    spark.sql("select 's0' as station, timestamp'2024-03-01 00:00:00' as hour, 0.0D as temp, 0.0D as precip, 1 as lead").write.mode("append").parquet(str(tmp_path / "in"))
    log = versions.VersionedLog(spark, str(tmp_path / "log"), keys=("date",))
    stream = daily_stream(spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("append").foreachBatch(log.writer("hours")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((str(r.date), r.station, r.lead, r.temp_max, r.temp_min, r.rain and round(r.rain, 9), r.wet_hours) for r in df.collect())
    assert key(log.read()) == key(weather.hourly_to_daily(hours)) and log.version().number >= 1
