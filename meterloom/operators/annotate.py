"""Label edits from a control table, applied to samples by event time.

A control row says ``set``/``unset`` (add a label, stop adding it), ``delete``/``undelete`` (drop a
label, stop dropping it) or ``clear`` (forget all of it). A sample at ``ts`` gets the state after
every action strictly before ``ts``: added labels are set on top of its own, then dropped ones
are removed.

How it runs. Control rows are first reduced to one edit per instant, name and side. Each edit is in
force for an *interval*, up to the next edit of the same name and side or the next ``clear``. Rows
find the last control instant before them in one of two exact ways:

* ``bins`` - control instants are few and even enough: they are laid out in equal time bins and
  broadcast, so rows are not shuffled at all;
* ``merge`` - otherwise: the distinct row instants are merged with the control instants, range by
  range, and joined back on the instant. A hot instant is one row of that merge, and the join back
  is an equi-join whose hot keys adaptive execution can split.

Only control instants that some row finds get a *state*, and a state holds the labels to add and, of
the labels its own rows carry, those to drop. So work follows the rows and the labels they get, not
the number of control instants times the number of names.

Where the rows after one instant carry many names between them, a state does not hold those to drop. Each *label
set* (an instant and the names of a row) is then told which of its own names change, and rows
look their set up, so a row's work is bounded by its own labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import epoch_micros
from ..scratch import Scratch

# The actions and what they edit.
ADD_ACTIONS = ("set", "unset")
DROP_ACTIONS = ("delete", "undelete")
CLEAR_ACTION = "clear"

BROADCAST_BYTES = 32 << 20
MAX_PER_BIN = 64
ROWS_PER_RANGE = 1_000_000
# Names that the rows of one instant carry, up to which its state holds those to drop.
MAX_OWN_NAMES = 64


def effective_edits(control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edits, clears)`` that change anything, one per instant.

    Edits are ``us, name, side, live, value``: the last one of an instant per name and side, unless
    a ``clear`` of the same instant comes after it. Clears are ``us, seq``.
    """
    rows = control.select(
        epoch_micros(control, "ts").alias("us"), "seq", "action", "name", "value"
    ).where(F.col("us").isNotNull())
    clears = rows.where(F.col("action") == CLEAR_ACTION).groupBy("us").agg(F.max("seq").alias("seq"))
    action = F.col("action")
    valid = action.isin(*ADD_ACTIONS, *DROP_ACTIONS) & F.col("name").isNotNull()
    valid = valid & ((action != "set") | F.col("value").isNotNull())
    last = F.max(F.struct("seq", action.isin("set", "delete").alias("live"), "value"))
    edits = (
        rows.where(valid)
        .groupBy("us", "name", action.isin(*ADD_ACTIONS).alias("adds"))
        .agg(last.alias("e"))
        .join(clears.withColumnRenamed("seq", "clear_seq"), "us", "left")
        .where(F.col("clear_seq").isNull() | (F.col("e.seq") > F.col("clear_seq")))
        .select("us", "name", "adds", F.col("e.live").alias("live"), F.col("e.value").alias("value"))
    )
    return edits, clears


def _ranged(table: DataFrame, column: str, rows_per_range: int, scratch: Scratch) -> DataFrame:
    """A written table with ``part``: ranges of ``column`` of about equal row count, as many as it takes."""
    n = math.ceil(table.count() / max(1, rows_per_range))
    if n <= 1:
        return table.withColumn("part", F.lit(0))
    return scratch.keep(table.repartitionByRange(n, column).withColumn("part", F.spark_partition_id()))


def control_timeline(edits: DataFrame, clears: DataFrame, scratch: Scratch, *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``us, part, hi, until_us`` of each control instant: the next one, and the next ``clear``.

    Instants are sorted range by range; one row a range tells what the ranges after it begin with.
    """
    marks = edits.select("us", F.lit(False).alias("clears")).union(clears.select("us", F.lit(True)))
    instants = _ranged(scratch.keep(marks.groupBy("us").agg(F.max("clears").alias("clears"))), "us", rows_per_range, scratch)
    clear_us = F.when(F.col("clears"), F.col("us"))
    per_part = instants.groupBy("part").agg(F.min("us").alias("first_us"), F.min(clear_us).alias("first_clear"))
    # "the next one after" is a running value over the descending order: a frame that grows, row by row,
    # where one that ends at UNBOUNDED FOLLOWING would be summed anew for every row
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(
        "part",
        F.lag("first_us").over(Window.orderBy(F.col("part").desc())).alias("after_us"),
        F.last("first_clear", ignorenulls=True).over(later).alias("after_clear"),
    )
    here = Window.partitionBy("part").orderBy("us")
    rest = Window.partitionBy("part").orderBy(F.col("us").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return scratch.keep(
        instants.select(
            "us", "part", F.lead("us").over(here).alias("hi"), F.last(clear_us, ignorenulls=True).over(rest).alias("until")
        )
        .join(per_part, "part")
        .select("us", "part", F.coalesce("hi", "after_us").alias("hi"), F.coalesce("until", "after_clear").alias("until_us"))
    )


def _last_instants(
    times: DataFrame, timeline: DataFrame, scratch: Scratch, rows_per_range: int
) -> DataFrame:
    """``_us, _lo``: for every distinct time after a control instant, the last one before it."""
    marks = timeline.select(F.col("us").alias("_us"), F.col("us").alias("lo"))
    points = scratch.keep(times.distinct().select("_us", F.lit(None).cast("bigint").alias("lo")).union(marks))
    points = _ranged(points, "_us", rows_per_range, scratch)
    # At one instant the row comes first: an action takes effect only after its own time.
    order = Window.partitionBy("part").orderBy("_us", F.col("lo").isNotNull())
    running = F.last("lo", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("part").agg(F.max("lo").alias("lo")).select("part", F.max("lo").over(before).alias("carried"))
    resolved = points.withColumn("_lo", running).where("lo is null").join(carried, "part")
    return resolved.select("_us", F.coalesce("_lo", "carried").alias("_lo")).where("_lo is not null")


def _bins(timeline: DataFrame, broadcast_bytes: int, max_per_bin: int) -> tuple[DataFrame, Column] | None:
    """``_bin, _from, _to`` for each bin that a stretch between instants reaches into (at most three a stretch
    over all), and the bin of ``_us``; None where they are too large or too dense to be broadcast."""
    seen = timeline.agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    if seen["n"] * 3 * 64 > broadcast_bytes:
        return None
    width = F.lit(max(1, (seen["hi"] - seen["lo"]) // (2 * seen["n"])))

    def bin_of(us: Column) -> Column:
        # whatever lies outside the control period falls in the nearest edge bin
        inside = F.least(F.greatest(us, F.lit(seen["lo"])), F.lit(seen["hi"] + 1))
        return F.call_function("div", inside - seen["lo"], width)

    lo, hi = F.col("us"), F.coalesce("hi", F.lit(2**63 - 1).cast("bigint"))
    bins = timeline.select(F.explode(F.sequence(bin_of(lo + 1), bin_of(hi))).alias("_bin"), lo.alias("_lo"), hi.alias("_hi"))
    densest = bins.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (bins, bin_of(F.col("_us"))) if densest <= max_per_bin else None


def _judged(
    own: DataFrame, edits: DataFrame, timeline: DataFrame, scratch: Scratch, rows_per_range: int
) -> tuple[DataFrame, DataFrame]:
    """``(name, block, nth, value, own, dropped; _lo, nth)``: every name that is set after an instant that rows find, every
    name of ``own``, and whether it is dropped there; and the numbers of those instants."""
    found = own.select(F.col("_lo").alias("us")).distinct().withColumn("found", F.lit(1))
    counted = timeline.join(found, "us", "left").select("us", "part", "until_us", F.coalesce("found", F.lit(0)).alias("found"))
    # numbers of the found instants: those up to an instant are counted range by range
    before = counted.groupBy("part").agg(F.sum("found").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    upto = F.sum("found").over(Window.partitionBy("part").orderBy("us"))
    numbers = scratch.keep(
        counted.withColumn("upto", upto).join(before, "part")
        .select("us", "until_us", "found", (F.col("upto") + F.col("base")).alias("nth"), "all")
    )
    key = ["name", "adds"]
    ended = edits.withColumn("next_us", F.lead("us").over(Window.partitionBy(*key).orderBy("us")))
    starts = ended.where("live").join(numbers, "us").withColumn("end_us", F.least("next_us", "until_us"))
    ends = numbers.select(F.col("us").alias("end_us"), (F.col("nth") - F.col("found")).alias("to"))
    spans = scratch.keep(
        starts.join(ends, "end_us", "left")
        .select("adds", "name", "value", (F.col("nth") - F.col("found") + 1).alias("first"), F.coalesce("to", "all").alias("last"))
        .where("first <= last")
    )
    # no row explodes into an unbounded array: spans are cut into stretches first
    block = lambda c: F.floor(F.col(c) / rows_per_range)
    cut = spans.withColumn("block", F.explode(F.sequence(block("first"), block("last")))).select(
        "adds", "name", "value", "block",
        F.greatest("first", F.col("block") * rows_per_range).alias("first"),
        F.least("last", F.col("block") * rows_per_range + rows_per_range - 1).alias("last"),
    )
    instants = numbers.where("found = 1").select(F.col("us").alias("_lo"), "nth")
    added = cut.where("adds").select(F.explode(F.sequence("first", "last")).alias("nth"), "name", "value", F.lit(False).alias("own"))
    carried = own.where("name is not null").join(instants, "_lo").select("nth", "name", F.lit(None).cast("string").alias("value"), F.lit(True).alias("own"))
    asked = added.union(carried).select("name", block("nth").alias("block"), "nth", F.lit(None).cast("bigint").alias("until"), "value", "own")
    drops = cut.where(~F.col("adds")).select("name", "block", F.col("first").alias("nth"), F.col("last").alias("until"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("boolean").alias("own"))
    # a name's drops follow each other, so the last one that began tells
    so_far = Window.partitionBy("name", "block").orderBy("nth", F.col("until").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    judged = asked.union(drops).withColumn("dropped", F.coalesce(F.last("until", ignorenulls=True).over(so_far) >= F.col("nth"), F.lit(False)))
    return judged.where("own is not null").drop("until"), instants


def label_states(
    own: DataFrame, edits: DataFrame, timeline: DataFrame, scratch: Scratch, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``_lo, _add, _hide`` for those control instants of ``own`` (``_lo, name``) after which labels change.

    ``own`` has the label names that rows carry after each instant that any row finds. ``_add`` are the labels
    to set, ``_hide`` the rows' own names to drop.
    """
    judged, instants = _judged(own, edits, timeline, scratch, rows_per_range)
    kept = F.when(~F.col("own") & ~F.col("dropped"), F.struct("name", "value"))
    gone = F.when(F.col("own") & F.col("dropped"), F.col("name"))
    states = judged.groupBy("nth").agg(F.map_from_entries(F.collect_list(kept)).alias("_add"), F.collect_list(gone).alias("_hide"))
    return scratch.keep(states.where((F.size("_add") > 0) | (F.size("_hide") > 0)).join(instants, "nth").select("_lo", "_add", "_hide"))


def label_fates(
    own: DataFrame, edits: DataFrame, timeline: DataFrame, scratch: Scratch, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``_lo, name, value, own``: the names that are set after an instant of ``own`` (with ``value``) and those of its own
    that are dropped (without), a row each."""
    judged, instants = _judged(own, edits, timeline, scratch, rows_per_range)
    # a block follows from the number, so this needs no exchange of its own
    fates = judged.groupBy("name", "block", "nth").agg(
        F.max(F.when(~F.col("own") & ~F.col("dropped"), F.col("value"))).alias("value"),
        F.bool_or("own").alias("carried"),
        F.bool_or(F.col("own") & F.col("dropped")).alias("gone"),
    )
    fates = fates.where(F.col("value").isNotNull() | F.col("gone")).join(instants, "nth")
    return scratch.keep(fates.select("_lo", "name", "value", F.col("carried").alias("own")))


def set_changes(sets: DataFrame, fates: DataFrame, scratch: Scratch) -> DataFrame:
    """``_lo, _keys, _off, _new`` of the label sets (``_lo, _keys``) that change: their own names that are dropped or set, and
    the values of those set."""
    names = sets.select("_lo", "_keys", F.explode("_keys").alias("name"))
    new = F.when(F.col("value").isNotNull(), F.struct("name", "value"))
    changed = names.join(fates.where("own").drop("own"), ["_lo", "name"]).groupBy("_lo", "_keys")
    return scratch.keep(changed.agg(F.collect_list("name").alias("_off"), F.map_from_entries(F.collect_list(new)).alias("_new")))


def _small(states: DataFrame, texts: Column, broadcast_bytes: int) -> DataFrame:
    """With a broadcast hint if the ``texts`` of the states are counted to be few bytes."""
    bytes_ = F.aggregate(texts, F.lit(64).cast("bigint"), lambda n, s: n + F.octet_length(s) + 16)
    return F.broadcast(states) if (states.agg(F.sum(bytes_)).first()[0] or 0) <= broadcast_bytes else states


def annotate(
    data: DataFrame,
    control: DataFrame,
    *,
    ts: str = "ts",
    labels: str = "labels",
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    max_per_bin: int = MAX_PER_BIN,
    rows_per_range: int = ROWS_PER_RANGE,
    added: str | None = None,
) -> DataFrame:
    """``data`` with its label map edited by ``control`` (``ts, seq, action, name, value``).

    Rows without a label map are dropped. Unknown actions, actions without the name or value they
    need, and actions without a time are ignored. ``strategy`` is ``auto`` or ``merge``; ``auto``
    measures the control instants first. With ``added``, label maps keep to the names that rows carry themselves, and
    a column of that name counts the labels set beside them: for controls that set more names at
    a time than should be copied into each row. ``data`` is read twice: for the instants and names it holds, and for the
    result. It must not be a stream: call this inside ``foreachBatch``.
    """
    if data.isStreaming:
        raise ValueError("annotate a stream inside foreachBatch, see meterloom.streaming")
    if strategy not in ("auto", "merge"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if added in data.columns:
        raise ValueError(f"there is a column {added!r}")
    data = data.where(F.col(labels).isNotNull())
    scratch = Scratch(data.sparkSession, "annotate")
    edits, clears = effective_edits(control)
    edits = scratch.keep(edits)
    timeline = control_timeline(edits, clears, scratch, rows_per_range=rows_per_range)
    if timeline.isEmpty():
        scratch.drop_all()
        return data.withColumn(added, F.lit(0).cast("bigint")) if added else data
    rows = data.withColumn("_us", epoch_micros(data, ts))
    bins = _bins(timeline, broadcast_bytes, max_per_bin) if strategy == "auto" else None
    if bins:
        table, row_bin = bins
        between = (row_bin == F.col("_bin")) & (F.col("_us") > F.col("_lo")) & (F.col("_us") <= F.col("_hi"))
        placed, read = rows.join(F.broadcast(table), between, "left"), timeline
    else:
        read = scratch.keep(_last_instants(rows.select("_us"), timeline, scratch, rows_per_range))
        placed = rows.join(read, "_us", "left")
    placed = placed.withColumn("_keys", F.map_keys(labels))
    sets = scratch.keep(placed.where("_lo is not null").select("_lo", "_keys").distinct())
    own = scratch.keep(sets.select("_lo", F.explode_outer("_keys").alias("name")).distinct())
    most = own.groupBy("_lo").agg(F.count("name").alias("n")).agg(F.max("n")).first()[0] or 0
    if not added and most <= MAX_OWN_NAMES:
        states = label_states(own, edits, timeline, scratch, rows_per_range=rows_per_range)
        texts = F.concat(F.map_keys("_add"), F.map_values("_add"), F.col("_hide"))
        found, kept = placed.join(_small(states, texts, broadcast_bytes), "_lo", "left"), [states]
        # what a row keeps of its own
        mine = F.map_filter(labels, lambda k, _: ~F.array_contains("_hide", k) & ~F.map_contains_key("_add", k))
        mine = F.when(F.col("_add").isNull(), F.col(labels)).otherwise(mine)
    else:
        fates = label_fates(own, edits, timeline, scratch, rows_per_range=rows_per_range)
        changes = set_changes(sets, fates, scratch)
        news = fates.where("value is not null").groupBy("_lo")
        if added:
            states = scratch.keep(news.agg(F.count(F.lit(1)).alias("_n")))
            joined = states
        else:
            states = scratch.keep(news.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_add")))
            joined = _small(states, F.concat(F.map_keys("_add"), F.map_values("_add")), broadcast_bytes)
        found, kept = placed.join(changes, ["_lo", "_keys"], "left").join(joined, "_lo", "left"), [changes, states]
        mine = F.map_filter(labels, lambda k, _: ~F.array_contains("_off", k))
        mine = F.when(F.col("_off").isNull(), F.col(labels)).otherwise(mine)
    # the result reads only the rows, where they fall, the states and what changes in label sets
    scratch.drop_all(read, *kept)
    if added:
        new_labels = F.when(F.col("_new").isNull(), F.col(labels)).otherwise(F.map_concat(mine, "_new"))
        n_new = F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new"))
        found = found.withColumn(added, F.coalesce("_n", F.lit(0)) - n_new)
    else:
        new_labels = F.when(F.col("_add").isNull(), mine).otherwise(F.map_concat(mine, "_add"))
    columns = [*data.columns, added] if added else data.columns
    return found.select(*[new_labels.alias(c) if c == labels else F.col(f"`{c}`") for c in columns])
