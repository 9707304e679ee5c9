"""The session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps day and month windows independent of where a job runs; files cannot be
#: read by path in SQL, so a scoped view cannot be bypassed.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def session(app: str = "quarry", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=CONF | conf).getOrCreate()
