"""Registered jobs run correctly in a caller's session with another time zone."""

import __spark_entry__ as E
from support import SF_SMALL


def test_jobs_normalise_session_zone(spark):
    q = E.queries()
    base = sorted(tuple(r) for r in q["avg_load_3h"](spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        again = sorted(tuple(r) for r in q["avg_load_3h"](spark, SF_SMALL).collect())
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        assert again == base
        assert E.entry(spark).count() > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
