from __future__ import annotations

import datetime as dt

from marquetry.operators import references as R

T = dt.datetime(2024, 3, 1)
REFS = "table_name string, record_id string, ref string, created_at timestamp_ntz"
PARENTS = "id string, created_at timestamp_ntz, table_name string"
REMOVALS = "entity string, entity_id string, removed_at timestamp_ntz, restored_at timestamp_ntz"


def build(spark, refs, hot=R.HOT_REFERENCES):
    day = dt.timedelta(days=1)
    parents = spark.createDataFrame([("A", T, "clash"), ("a ", T - 9 * day, "clash"), ("late", T + day, "x"), ("gone", T - day, "x"), ("back", T - day, "x"), ("bare", None, "x"), (None, T, "x")], PARENTS)
    log = spark.createDataFrame([("users", "GONE ", T, None), ("users", "back", T, T), ("users", "ghost", T, None), ("users", "was", T, T), ("sections", "a", T, None), ("users", None, T, None)], REMOVALS)
    return R.reference_states(spark.createDataFrame(refs, REFS), R.parent_intervals(parents, log, "users"), hot=hot, salts=3)


CASES = {"1": (" a\t", "ok"), "2": ("LATE", "late"), "3": ("gone", "deleted"), "4": ("back", "ok"), "5": ("nobody", "missing"), "6": (None, None), "7": ("  ", None), "8": ("ghost", "deleted"), "9": ("was", "missing"), "10": ("bare", "ok")}


def test_states_and_periods(spark):
    refs = [("t", k, v[0], T) for k, v in CASES.items()] + [("t", "11", "late", None)]
    states = build(spark, refs)
    assert {r.record_id: r.state for r in states.collect()} == {k: v[1] for k, v in CASES.items()} | {"11": "ok"}
    p = {r.period: (r.refs, r.missing, r.deleted, r.late, r.orphans) for r in R.orphans_by_period(states).collect()}
    assert p == {"2024-03": (8, 2, 2, 1, 5), None: (1, 0, 0, 0, 0)}


def test_hot_key_is_salted_alike(spark):
    refs = [("t", f"h{i}", "gone", T) for i in range(50)] + [("t", k, v[0], T) for k, v in CASES.items()]
    got = {r.record_id: r.state for r in build(spark, refs, hot=5).collect()}
    assert got == {f"h{i}": "deleted" for i in range(50)} | {k: v[1] for k, v in CASES.items()}


def test_empty(spark):
    assert build(spark, []).collect() == []
