"""Light-curve views don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.views import days


def test_days_in_any_time_zone(spark):
    found = []
    for zone in ("Asia/Seoul", "America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        t = spark.range(1).select(F.expr("timestamp_ntz'2024-01-02 12:00:00'").alias("ts"))
        found.append(t.select(days("ts").alias("d")).first().d)
    assert found == [1.5, 1.5, 1.5]
