"""Plans to lazy DataFrames. Catalyst does the rest: pushdown, pruning, join strategies, partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.functions.aggregates import Aggregates
from gnomon.functions.dimensions import bucket
from gnomon.operators import formula
from gnomon.operators.predicates import compare, every
from gnomon.plans.planner import Branch, Plan
from gnomon.plans.registry import Edge, Registry, Source


def frame(registry: Registry, identifier: str) -> DataFrame:
    """A table with its columns named by identifier, so that no two tables clash. Unused columns are pruned."""
    df = registry.schema.by_id[identifier].load(registry.spark)
    return df.select(*[F.col(f"`{c}`").alias(f"{identifier}.{c}") for c in df.columns])


def col(source: Source) -> Column:
    return F.col(f"`{source.key}`")


def _at(identifier: str, column: str) -> Column:
    return F.col(f"`{identifier}.{column}`")


def _condition(e: Edge) -> Column:
    on = _at(e.source, e.left) == _at(e.target, e.right)
    if e.type_is:
        side, column, value = e.type_is
        on = on & (_at(e.source if side == "source" else e.target, column) == F.lit(value))
    return on


def _step(registry: Registry, df: DataFrame, e: Edge, how: str) -> DataFrame:
    if e.bridge:
        name, near, far = e.bridge
        pairs = registry.table(name).load(registry.spark).select(F.col(near).alias("__near"), F.col(far).alias("__far")).distinct()
        df = df.join(pairs, _at(e.source, e.left) == F.col("__near"), how)
        return df.join(frame(registry, e.target), F.col("__far") == _at(e.target, e.right), how).drop("__near", "__far")
    return df.join(frame(registry, e.target), _condition(e), how)


def branch(registry: Registry, aggregates: Aggregates, b: Branch) -> DataFrame:
    df = frame(registry, b.root)
    for way, filters in b.semi:
        # Rows of the fact table for which one row at the end of the way satisfies all conditions together.
        first, rest = way[0], way[1:]
        if first.bridge:
            name, near, far = first.bridge
            ends = frame(registry, first.target)
            for e in rest:
                ends = _step(registry, ends, e, "inner")
            ends = ends.where(every([compare(col(s), op, v) for s, op, v in filters]))
            pairs = registry.table(name).load(registry.spark).select(F.col(near).alias("__near"), F.col(far).alias("__far"))
            pairs = pairs.join(ends, F.col("__far") == _at(first.target, first.right), "left_semi")
            df = df.join(pairs, _at(b.root, first.left) == F.col("__near"), "left_semi")
            continue
        ends = frame(registry, first.target)
        for e in rest:
            ends = _step(registry, ends, e, "inner")
        ends = ends.where(every([compare(col(s), op, v) for s, op, v in filters]))
        df = df.join(ends, _condition(first), "left_semi")
    for e in b.joins:
        df = _step(registry, df, e, "left")
    if b.filters:
        df = df.where(every([compare(col(s), op, v) for s, op, v in b.filters]))
    outputs = []
    for m in b.measures:
        value = col(m.source)
        if m.measure.conditions:
            test = every([compare(_at(m.source.table.identifier, c), op, v) for c, op, v in m.measure.conditions])
            value = F.when(test, value)
        outputs.append(aggregates.compile(m.measure.func, value).alias(m.alias))
    keys = [bucket(d.dim, col(d.source)).alias(d.alias) for d in b.dims]
    if not outputs:  # the base table's own branch, where no metric is of it
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*outputs) if keys else df.agg(*outputs)


_HERE = "__in_base"


def merged(plan: Plan, parts: list[DataFrame]) -> DataFrame:
    """Branches side by side: one row for each group of any branch, or of the base table if there is one. A metric has
    one value in a group, the rest are null; so any aggregate that skips nulls picks it. Counts of groups without rows
    are 0 where a base table brought the group in."""
    if plan.base is not None and len(parts) > 1 and plan.aliases:
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts[0].withColumn(_HERE, F.lit(True)), *parts[1:]])
        counted = {m.alias for m in plan.measures if m.measure.func in ("count", "count_distinct")}
        pick = [F.first(f"`{m.alias}`", ignorenulls=True).alias(m.alias) for m in plan.measures]
        out = whole.groupBy(*[F.col(f"`{a}`") for a in plan.aliases]).agg(F.max(_HERE).alias(_HERE), *pick).where(_HERE).drop(_HERE)
        return out.withColumns({a: F.coalesce(F.col(f"`{a}`"), F.lit(0)) for a in counted}) if counted else out
    if len(parts) == 1:
        return parts[0]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    pick = [F.first(f"`{m.alias}`", ignorenulls=True).alias(m.alias) for m in plan.measures]
    keys = [F.col(f"`{a}`") for a in plan.aliases]
    return whole.groupBy(*keys).agg(*pick) if keys else whole.agg(*pick)


def finished(plan: Plan, df: DataFrame) -> DataFrame:
    for d in plan.derived:
        value = formula.column(d.formula) if isinstance(d.formula, str) else d.formula({m: F.col(f"`{m}`") for m in df.columns})
        df = df.withColumn(d.named, value)
    shown = {m.alias: dict(m.measure.shown) for m in plan.measures if m.measure.shown}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=shown[c]) if c in shown else F.col(f"`{c}`") for c in plan.outputs])


def lower(registry: Registry, aggregates: Aggregates, plan: Plan) -> DataFrame:
    if plan.rollup is not None:
        return finished(plan, plan.rollup)
    branches = [b for b in plan.branches if b.measures or plan.aliases]
    return finished(plan, merged(plan, [branch(registry, aggregates, b) for b in branches]))
