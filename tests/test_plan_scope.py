"""Which journal rows count for a plan: version, binding, context, age, and what happened last."""

import datetime

import pytest

from pagegrain.operators import journal

NOW = datetime.datetime(2024, 5, 1, 12)
ROW = ("trace_id string, attempt_ordinal int, observed_at timestamp, domain string, path_pattern string, operation string, adapter string, adapter_version string, "
       "adapter_binding_id string, identity_class string, acquisition_context string, provider string, provider_version string, provider_binding_id string, outcome string, "
       "latency_ms double, verified boolean")
BASE = {"attempt_ordinal": 0, "domain": "example.com", "path_pattern": "/items/{number}", "operation": "extract", "adapter": "json", "adapter_version": "legacy", "adapter_binding_id": None,
        "identity_class": "public", "acquisition_context": None, "provider": "working", "provider_version": "1", "provider_binding_id": None, "outcome": "observed", "latency_ms": 10.0,
        "verified": False}


def _row(index, **changed):
    names = [part.split()[0] for part in ROW.split(", ")]
    whole = {**BASE, "trace_id": str(index), "observed_at": NOW - datetime.timedelta(seconds=100 - index), **changed}
    return tuple(whole[name] for name in names)


def _preferred(spark, rows, minimum=2, ttl=3600, version="1", binding=None, adapter_binding=None, context=None, verified_only=False, tools=("first", "working")):
    plans = spark.createDataFrame([(1, NOW, "example.com", "/items/{number}", "extract", "json", "legacy", adapter_binding, context)],
                                  "plan_id long, planned_at timestamp, domain string, path_pattern string, operation string, adapter string, adapter_version string, adapter_binding_id string, "
                                  "acquisition_context string")
    definitions = spark.createDataFrame([("working", version, binding, None, None), ("first", "1", None, None, None)],
                                        "provider string, provider_version string, provider_binding_id string, valid_from timestamp, valid_until timestamp")
    candidates = spark.createDataFrame([(1, name, at) for at, name in enumerate(tools)], "plan_id long, provider string, position int")
    got = journal.plan_order(spark.createDataFrame(rows, ROW), plans, definitions, candidates, ttl, minimum, verified_only).orderBy("rank").collect()
    assert [row["provider"] for row in got if not row["eligible"]] == [name for name in tools if name not in [row["provider"] for row in got if row["eligible"]]]
    return got[0]["provider"] if got[0]["eligible"] else None


A, B = "1" * 64, "2" * 64
GOOD = [_row(0), _row(1)]
CASES = [
    (GOOD, {}, "working"),
    # The latest outcome is a failure; another version is defined now.
    ([*GOOD, _row(2, outcome="failed")], {}, None), (GOOD, {"version": "2"}, None),
    # Samples are earned anew after a failure.
    ([*GOOD, _row(2, outcome="failed"), _row(3)], {}, None), ([*GOOD, _row(2, outcome="failed"), _row(3), _row(4)], {}, "working"),
    # Contexts do not mix, nulls included.
    ([_row(i, acquisition_context="direct") for i in range(3)], {"context": "direct", "minimum": 3}, "working"),
    ([_row(i, acquisition_context="direct") for i in range(3)], {"context": "category", "minimum": 3}, None),
    ([_row(i, acquisition_context="direct") for i in range(3)], {"minimum": 3}, None),
    # Bindings: a definition that names one takes no rows of another, nor rows without one.
    ([_row(i, provider_binding_id=A, adapter_binding_id=B) for i in (1, 2)], {"binding": A, "adapter_binding": B}, "working"),
    ([_row(i, provider_binding_id=A, adapter_binding_id=B) for i in (1, 2)], {"binding": "9" * 64, "adapter_binding": B}, None),
    ([_row(i, provider_binding_id=A, adapter_binding_id=B) for i in (1, 2)], {"binding": A, "adapter_binding": "9" * 64}, None),
    (GOOD, {"binding": A}, None), ([_row(i, provider_binding_id="no digest") for i in (1, 2)], {}, None),
    # Older than the TTL, or later than the plan.
    (GOOD, {"ttl": 60}, None), ([_row(0, observed_at=NOW - datetime.timedelta(seconds=3600)), _row(1, observed_at=NOW)], {}, "working"),
    ([_row(0), _row(1, observed_at=NOW + datetime.timedelta(seconds=1))], {}, None),
    ([_row(0), _row(1, identity_class="named")], {}, None),
    # Verified evidence needs as many verified and timed rows.
    (GOOD, {"verified_only": True}, None), ([_row(i, verified=True) for i in range(2)], {"verified_only": True}, "working"),
    ([_row(i, verified=True, latency_ms=-1.0) for i in range(2)], {"verified_only": True}, None),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_evidence_scope(spark, at):
    rows, changed, want = CASES[at]
    assert _preferred(spark, rows, **changed) == want


def test_definitions_hold_for_their_time(spark):
    rows = [_row(0), _row(1)]
    plans = spark.createDataFrame([(n, NOW + datetime.timedelta(minutes=n), "example.com", "/items/{number}", "extract", "json", "legacy", None, None) for n in (0, 10)],
                                  "plan_id long, planned_at timestamp, domain string, path_pattern string, operation string, adapter string, adapter_version string, adapter_binding_id string, "
                                  "acquisition_context string")
    change = NOW + datetime.timedelta(minutes=5)
    definitions = spark.createDataFrame([("working", "1", None, None, change), ("working", "2", None, change, None)],
                                        "provider string, provider_version string, provider_binding_id string, valid_from timestamp, valid_until timestamp")
    found = journal.in_scope(spark.createDataFrame(rows, ROW), plans, definitions, 3600).groupBy("plan_id").count().collect()
    assert [tuple(row) for row in found] == [(0, 2)]
