"""Plan-shape guards for the scale design (checked on the physical plan)."""

from support import SF_SMALL
from tankwise.operators import anomaly as A
from tankwise.operators import features as FE
from tankwise.plans import views as V
from tankwise.sources.store import telemetry_store
from tankwise.sources.tables import telemetry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_windows_share_one_exchange_on_unit_and_chunk(spark):
    import re
    p = _plan(FE.features_all(telemetry(spark, SF_SMALL)))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    # the 13 window columns ride on one exchange keyed by (unit, chunk) ...
    assert sum("_chunk" in e for e in exchanges) == 1
    # ... and nothing repartitions the readings by unit alone or by type
    assert not any(re.fullmatch(r"equipment_id#\d+, \d+", e) for e in exchanges)
    assert "hashpartitioning(equipment_type" not in p


def test_scan_reads_only_needed_columns(spark):
    df = V.consumption_history(telemetry_store(spark, SF_SMALL))
    p = _plan(df)
    import re
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("props" not in x for x in schemas)   # no scan reads unused columns
    assert any("fuel_consumed" in x for x in schemas) and any(x == "struct<last:bigint>" for x in schemas)
    assert not any("fuel_level" in x for x in schemas)


def test_statistical_detector_broadcasts_bounds(spark):
    t = telemetry(spark, SF_SMALL)
    d = A.detect_statistical(t, A.sigma_thresholds(A.unannotated(t)))
    p = _plan(d)
    assert "BroadcastHashJoin" in p and "hashpartitioning(equipment_type" not in p
