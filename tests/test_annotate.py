import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterloom.operators.annotate import annotate, control_timeline, effective_edits, label_states
from meterloom.scratch import Scratch

T0 = dt.datetime(2024, 1, 1)
CONTROL = "ts timestamp, seq long, action string, name string, value string"
DATA = "id int, ts timestamp, labels map<string,string>"


def fold(data, control):
    """Replay the actions one by one and look at the state before each row's instant."""
    actions = sorted((c for c in control if c[0] is not None), key=lambda c: (c[0], c[1]))
    out = {}
    for row_id, ts, labels in data:
        if labels is None:
            continue
        add, drop = {}, set()
        for at, _, action, name, value in actions:
            if at >= ts:
                break
            if action == "clear":
                add, drop = {}, set()
            elif name is None:
                continue
            elif action == "set" and value is not None:
                add[name] = value
            elif action == "unset":
                add.pop(name, None)
            elif action == "delete":
                drop.add(name)
            elif action == "undelete":
                drop.discard(name)
        out[row_id] = {k: v for k, v in {**labels, **add}.items() if k not in drop}
    return out


def run(spark, data, control, **kw):
    got = annotate(spark.createDataFrame(data, DATA), spark.createDataFrame(control, CONTROL), **kw)
    assert got.columns == ["id", "ts", "labels"]
    rows = got.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.labels for r in rows}


def random_case(seed, rows, actions, names, span):
    rng = random.Random(seed)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(span))
    control = []
    for seq in range(actions):
        action = rng.choice(["set"] * 5 + ["unset", "delete", "delete", "undelete", "bogus"] + ["clear"])
        name = rng.choice(names + [None]) if rng.random() < 0.95 else None
        control.append((at(), seq, action, name, rng.choice(["v1", "v2", None])))
    data = [(i, at(), {"host": "h", rng.choice(names): "own"}) for i in range(rows)]
    data += [(rows, T0 - dt.timedelta(days=1), {"host": "h"}), (rows + 1, T0 + dt.timedelta(days=9), {"host": "h"})]
    data += [(rows + 2, T0 + dt.timedelta(seconds=span // 2), None)]
    return data, control


@pytest.mark.parametrize("strategy", ["auto", "merge"])
@pytest.mark.parametrize("rows_per_range", [1_000_000, 9])
def test_random_edits_equal_a_fold(spark, strategy, rows_per_range):
    data, control = random_case(7, 300, 120, ["host", "phase", "run", "gpu"], 400)
    got = run(spark, data, control, strategy=strategy, rows_per_range=rows_per_range)
    assert got == fold(data, control)


def test_one_name_and_one_instant_hold_most_rows(spark):
    data, control = random_case(11, 100, 40, ["host", "phase"], 100)
    hot = T0 + dt.timedelta(seconds=50)
    data += [(1000 + i, hot, {"host": "h"}) for i in range(200)]
    control += [(hot, 1000 + i, "set", "phase", f"p{i}") for i in range(200)]
    for strategy in ("auto", "merge"):
        assert run(spark, data, control, strategy=strategy, rows_per_range=9) == fold(data, control)


def test_bursts_fall_back_to_the_merge(spark):
    burst = [(T0 + dt.timedelta(microseconds=i), i, "set", f"n{i % 3}", str(i)) for i in range(60)]
    control = burst + [(T0 + dt.timedelta(days=300), 99, "clear", None, None)]
    data = [(i, T0 + dt.timedelta(microseconds=i * 2), {"host": "h"}) for i in range(40)]
    data += [(99, T0 + dt.timedelta(days=400), {"host": "h"})]
    assert run(spark, data, control, max_per_bin=8) == fold(data, control)
    assert run(spark, data, control, broadcast_bytes=10) == fold(data, control)


@pytest.mark.parametrize(
    "actions, want",
    [
        ([("set", "phase", "warm")], {"host": "h", "phase": "warm"}),
        ([("set", "host", "x")], {"host": "x"}),
        ([("set", "a", "1"), ("delete", "a", None)], {"host": "h"}),
        ([("delete", "a", None), ("set", "a", "1")], {"host": "h"}),
        ([("delete", "host", None), ("undelete", "host", None)], {"host": "h"}),
        ([("set", "a", "1"), ("delete", "host", None), ("clear", "x", None)], {"host": "h"}),
        ([("set", "a", "1"), ("clear", None, None), ("set", "b", "2")], {"host": "h", "b": "2"}),
        ([("unset", "nobody", None)], {"host": "h"}),
        ([("rename", "a", "1")], {"host": "h"}),
        ([("set", "a", None)], {"host": "h"}),
    ],
)
def test_small_cases(spark, actions, want):
    data = [(1, T0 + dt.timedelta(hours=1), {"host": "h"})]
    for step in (0, 1):  # all at one instant, then one after the other
        control = [(T0 + dt.timedelta(seconds=step * i), i, *a) for i, a in enumerate(actions)]
        assert run(spark, data, control) == {1: want}
        assert fold(data, control) == {1: want}


def test_an_action_at_the_rows_own_instant_comes_too_late(spark):
    control = [(T0, 0, "set", "a", "1")]
    data = [(1, T0, {"host": "h"}), (2, T0 + dt.timedelta(microseconds=1), {"host": "h"})]
    for strategy in ("auto", "merge"):
        assert run(spark, data, control, strategy=strategy) == {1: {"host": "h"}, 2: {"host": "h", "a": "1"}}


def test_no_valid_action_leaves_rows_alone(spark):
    data = [(1, T0, {"host": "h"})]
    assert run(spark, data, [(T0, 0, "bogus", "a", "1")]) == {1: {"host": "h"}}


def test_small_control_is_broadcast_and_rows_stay_put(spark):
    data, control = random_case(3, 50, 20, ["host", "phase"], 100)
    got = annotate(spark.createDataFrame(data, DATA), spark.createDataFrame(control, CONTROL))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def states(spark, control, own):
    scratch = Scratch(spark, "test")
    edits, clears = effective_edits(spark.createDataFrame(control, CONTROL))
    timeline = control_timeline(edits, clears, scratch)
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    own = spark.createDataFrame([(us(t), name) for t, name in own], "_lo bigint, name string")
    return label_states(own, edits, timeline, scratch).collect()


def test_states_only_for_instants_that_rows_find(spark):
    day = dt.timedelta(days=1)
    control = [(T0 + i * day, i, "set", f"n{i}", "1") for i in range(50)]
    control += [(T0 + i * day, 100 + i, "delete", f"d{i}", None) for i in range(50)]
    got = states(spark, control, [(T0 + 9 * day, "d3"), (T0 + 9 * day, "d30"), (T0 + 9 * day, "host")])
    assert len(got) == 1
    assert sorted(got[0]["_add"]) == sorted(f"n{i}" for i in range(10)) and got[0]["_hide"] == ["d3"]


def test_states_leave_out_instants_that_change_nothing(spark):
    control = [(T0, 0, "set", "a", "1"), (T0 + dt.timedelta(seconds=9), 1, "clear", None, None)]
    got = states(spark, control, [(T0, "host"), (T0 + dt.timedelta(seconds=9), "host")])
    assert [r["_add"] for r in got] == [{"a": "1"}]


def test_thousands_of_ranges(spark):
    data, control = random_case(5, 1500, 1200, ["host", "phase", "run"], 100_000)
    assert run(spark, data, control, strategy="merge", rows_per_range=1) == fold(data, control)


def test_many_names_and_few_rows(spark):
    hour = dt.timedelta(hours=1)
    control = [(T0 + i * hour, 3 * i, "set", f"n{i}", str(i)) for i in range(4000)]
    control += [(T0 + (i + 24) * hour, 3 * i + 1, "unset", f"n{i}", None) for i in range(4000)]
    control += [(T0 + i * hour, 3 * i + 2, "delete", f"d{i}", None) for i in range(4000)]
    data = [(i, T0 + 400 * i * hour, {"host": "h", f"d{i}": "x", f"d{3000 + i}": "y"}) for i in range(10)]
    assert run(spark, data, control) == fold(data, control)


def test_timeline_frames_grow_and_a_million_instants_are_linear(spark):
    import time

    from meterloom.operators.annotate import control_timeline
    from meterloom.scratch import Scratch

    edits = spark.range(1_000_000).select((F.col("id") * 1000).alias("us"))
    clears = spark.range(1_000_000).where(F.col("id") % 97 == 0).select((F.col("id") * 1000 + 500).alias("us"), F.lit(1).alias("seq"))
    plans = []

    class Seen(Scratch):
        def keep(self, df):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().keep(df)

    scratch = Seen(spark, "timeline-test")
    start = time.time()
    timeline = control_timeline(edits, clears, scratch)
    rows = {r["us"]: (r["hi"], r["until_us"]) for r in timeline.where(F.col("us").isin(0, 500, 1000, 96_000, 97_000, 97_500, 999_999_000)).collect()}
    assert time.time() - start < 60
    assert rows == {0: (500, 500), 500: (1000, 97_500), 1000: (2000, 97_500), 96_000: (97_000, 97_500), 97_000: (97_500, 97_500),
                    97_500: (98_000, 194_500), 999_999_000: (None, None)}
    scratch.drop_all()
    assert any("windowspecdefinition" in p.replace(" ", "").lower() for p in plans)
    assert all("unboundedfollowing" not in p.replace(" ", "").lower() for p in plans)


@pytest.mark.parametrize("strategy", ["auto", "merge"])
def test_many_own_names_at_an_instant_are_looked_up_by_label_set(spark, strategy):
    hour = dt.timedelta(hours=1)
    control = [(T0 + i * hour, 2 * i, "delete", f"d{j}", None) for i in range(3) for j in range(i * 40, i * 40 + 40)]
    control += [(T0 + 2 * hour, 900 + j, "set", f"s{j}", str(j)) for j in range(30)] + [(T0 + 2 * hour, 990, "undelete", "d5", None)]
    data = [(i, T0 + (1 + i % 4) * hour, {"host": "h", f"d{i}": "x", f"s{i % 50}": "own"}) for i in range(300)] + [(999, T0 + 9 * hour, {})]
    got = annotate(spark.createDataFrame(data, DATA), spark.createDataFrame(control, CONTROL), strategy=strategy)
    # no state holds the names that all its rows carry between them
    assert "_hide" not in got._jdf.queryExecution().analyzed().toString()
    assert {r.id: r.labels for r in got.collect()} == fold(data, control)


@pytest.mark.parametrize("seed", [7, 8])
def test_added_counts_what_is_set_beside_a_rows_own_names(spark, seed):
    data, control = random_case(seed, 300, 120, ["host", "phase", "run", "gpu", "rack"], 400)
    got = annotate(spark.createDataFrame(data, DATA), spark.createDataFrame(control, CONTROL), added="n")
    assert got.columns == ["id", "ts", "labels", "n"]
    own, want = {r[0]: r[2] for r in data}, fold(data, control)
    assert {r.id: (r.labels, r.n) for r in got.collect()} == {
        i: ({k: v for k, v in m.items() if k in own[i]}, sum(k not in own[i] for k in m)) for i, m in want.items()
    }
