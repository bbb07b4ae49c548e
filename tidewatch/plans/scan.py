"""Ordered fold (scan) per key that stays parallel when one key holds most of the rows.

Some operators are order-dependent folds that no window function expresses: a counter that
resets when it fires (burst detection) or a running sum clamped after every step (mood
line). Folding each key's whole sequence in one task does not scale: a hot key may hold a
third of all rows. Instead each step is described by a *summary* of what it does to the
state (a transition table for a small finite state machine, or a clamp triple), and
summaries compose associatively. This is the parallel-prefix formulation of sequential
state machines (Blelloch 1990; Mytkowicz et al., "Data-parallel finite-state machines",
ASPLOS 2014).

Plan, with fan-out ``C`` and ``L`` levels so that ``C**L > max(order)``:

* ascent: level 1 groups rows by ``(key, order div C)`` and composes their summaries in
  order; level j groups level j-1 results by ``(key, g div C)``. Every group holds at most
  ``C`` items, whatever the key skew, and the hot key is spread over many groups.
* descent: the single top group per key is scanned from the initial state, which gives the
  start state of each of its children; each level below joins its groups to their start
  states and scans again; level 1 finally emits per-row outputs.

All folding happens in JVM higher-order functions (``aggregate``/``transform``) inside
bounded arrays; shuffles are on ``(key, group)``, so no task ever sees an unbounded group.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

Fn = Callable[..., Column]

# Items per group at every level. Small groups keep each sequential fold short and spread
# the work over many tasks; the number of levels grows only as log_C(rows per key).
DEFAULT_FANOUT = 128


@dataclass
class Monoid:
    """How steps act on the state.

    identity: summary that leaves every state unchanged.
    leaf(item): summary of one row (``item`` is the struct of payload columns).
    compose(a, b): summary of doing ``a`` then ``b``.
    apply(s, state): state after applying summary ``s``.
    """
    identity: Column
    leaf: Fn
    compose: Fn
    apply: Fn
    # Optional shortcuts: fold(summary, item) = compose(summary, leaf(item)) and
    # advance(state, item) = apply(leaf(item), state), without building the leaf summary.
    fold: Fn | None = None
    advance: Fn | None = None

    def fold_item(self, acc, it):
        return self.fold(acc, it) if self.fold else self.compose(acc, self.leaf(it))

    def advance_state(self, st, it):
        return self.advance(st, it) if self.advance else self.apply(self.leaf(it), st)


def levels_for(max_order: int, fanout: int) -> int:
    lv, span = 1, fanout
    while span <= max(max_order, 0):
        lv += 1
        span *= fanout
    return lv


def _grp(col: str, fanout: int) -> Column:
    return F.expr(f"`{col}` div {int(fanout)}")


def _nullable(dt):
    """Same type with every field / element nullable (so folded values can be cast to it)."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_nullable(dt.elementType), True)
    if isinstance(dt, T.MapType):
        return T.MapType(_nullable(dt.keyType), _nullable(dt.valueType), True)
    return dt


def _data_type(df: DataFrame, c: Column):
    return _nullable(df.select(c.alias("x")).schema["x"].dataType)


def first_level(items: DataFrame, keys: list[str], order: str, payload: list[str], m: Monoid, fanout: int) -> DataFrame:
    """L1: keys, g1, items (array), s (summary)."""
    lvl1 = (items.withColumn("g1", _grp(order, fanout))
            .groupBy(*keys, "g1")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *payload))).alias("items")))
    stype = _data_type(items, m.identity)
    return lvl1.withColumn("s", F.aggregate("items", m.identity.cast(stype),
                                            lambda acc, it: m.fold_item(acc, it).cast(stype)))


def ascend(items: DataFrame, keys: list[str], order: str, payload: list[str], m: Monoid,
           fanout: int, levels: int) -> list[DataFrame]:
    """Level tables [L1, ..., LL]. Lj has keys, g<j>, items (array), s (summary)."""
    return ascend_from(first_level(items, keys, order, payload, m, fanout), keys, m, fanout, levels)


def ascend_from(lvl1: DataFrame, keys: list[str], m: Monoid, fanout: int, levels: int) -> list[DataFrame]:
    """Level tables above a given L1, with it."""
    out = [lvl1]
    stype = lvl1.schema["s"].dataType
    for j in range(2, levels + 1):
        prev = out[-1]
        g_prev, g = f"g{j-1}", f"g{j}"
        lvl = (prev.withColumn(g, _grp(g_prev, fanout))
               .groupBy(*keys, g)
               .agg(F.array_sort(F.collect_list(F.struct(F.col(g_prev).alias("o"), F.col("s")))).alias("items")))
        lvl = lvl.withColumn("s", F.aggregate("items", m.identity.cast(stype),
                                              lambda acc, it: m.compose(acc, it["s"]).cast(stype)))
        out.append(lvl)
    return out


def _starts(level: DataFrame, keys: list[str], j: int, m: Monoid, init: Column, state_type,
            start: Column | None) -> DataFrame:
    """Scan a level-j table (j >= 2) and return (keys, g<j-1>, start) for its children."""
    st0 = (start if start is not None else init).cast(state_type)
    child_t = T.StructType([T.StructField("o", T.LongType()), T.StructField("st", state_type)])
    zero = F.struct(st0.alias("st"), F.array().cast(T.ArrayType(child_t)).alias("out"))

    def step(acc, it):
        return F.struct(
            m.apply(it["s"], acc["st"]).cast(state_type).alias("st"),
            F.array_append(acc["out"], F.struct(it["o"].cast("bigint").alias("o"),
                                                 acc["st"].alias("st")).cast(child_t)).alias("out"))

    # explode_outer + null filter: a plain explode would make the optimizer add a
    # size(...) > 0 filter that evaluates the whole fold a second time.
    return (level.select(*keys, F.explode_outer(F.aggregate("items", zero, step)["out"]).alias("c"))
            .where(F.col("c").isNotNull())
            .select(*keys, F.col("c.o").alias(f"g{j-1}"), F.col("c.st").alias("start")))


def _settled(items: DataFrame, keys: list[str], order: str, payload: list[str], m: Monoid,
             fanout: int) -> tuple[DataFrame, int]:
    """L1 as a stored table, which every level and the descent read, so that the items are dealt to their groups once
    whatever the number of levels; and that number, from the largest group."""
    lvl1 = written(first_level(items, keys, order, payload, m, fanout), "scan-level")
    top = int(lvl1.agg(F.max("g1")).first()[0] or 0)
    return lvl1, 1 + levels_for(top, fanout) if top > 0 else 1


def ordered_scan(items: DataFrame, keys: list[str], order: str, payload: list[str], m: Monoid,
                 init: Column, emit: Fn, keep: Fn | None = None, *, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Fold each key's rows in ``order`` and emit one output struct per kept row.

    ``emit(item, state_before)`` builds the output struct for a row, ``keep(item,
    state_before)`` selects rows to emit (default all). ``order`` must be a non-negative
    integer unique within a key. Returns ``keys`` + the fields of the emitted struct.
    """
    lvl1, levels = _settled(items, keys, order, payload, m, fanout)
    state_type = _data_type(items, init)
    lv = ascend_from(lvl1, keys, m, fanout, levels)

    starts = None  # (keys, g<j>, start) for the level being descended into
    for j in range(levels, 1, -1):
        level = lv[j - 1]
        if starts is not None:
            level = level.join(starts, on=[*keys, f"g{j}"], how="inner")
            starts = _starts(level, keys, j, m, init, state_type, F.col("start"))
        else:
            starts = _starts(level, keys, j, m, init, state_type, None)

    lvl1 = lv[0]
    if starts is not None:
        lvl1 = lvl1.join(starts, on=[*keys, "g1"], how="inner")
        st0 = F.col("start").cast(state_type)
    else:
        st0 = init.cast(state_type)

    probe = lvl1.select(F.col("items")[0].alias("it"))
    out_type = _data_type(probe, emit(F.col("it"), init.cast(state_type)))
    zero = F.struct(st0.alias("st"), F.array().cast(T.ArrayType(out_type)).alias("out"))
    keep = keep or (lambda it, st: F.lit(True))

    def step(acc, it):
        st = acc["st"]
        out = F.when(keep(it, st), F.array_append(acc["out"], emit(it, st).cast(out_type))).otherwise(acc["out"])
        return F.struct(m.advance_state(st, it).cast(state_type).alias("st"), out.alias("out"))

    res = (lvl1.select(*keys, F.explode_outer(F.aggregate("items", zero, step)["out"]).alias("e"))
           .where(F.col("e").isNotNull()))
    return res.select(*keys, "e.*")


def final_states(items: DataFrame, keys: list[str], order: str, payload: list[str], m: Monoid,
                 init: Column, *, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """State per key after all its rows (keys, state)."""
    lvl1, levels = _settled(items, keys, order, payload, m, fanout)
    state_type = _data_type(items, init)
    top = ascend_from(lvl1, keys, m, fanout, levels)[-1]
    return top.select(*keys, m.apply(F.col("s"), init).cast(state_type).alias("state"))
