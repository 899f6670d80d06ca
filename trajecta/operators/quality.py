"""Data-quality checks as DataFrames of (check, violations).

A check never returns data rows, only how many break the rule, so a report over many
tables stays a handful of rows.  Rules about single rows are conditions; ``row_checks``
counts all of them in one pass over the table.  Comparisons of totals are null-safe: the
sum of an empty table is null and must not pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.labels import is_search_key
from trajecta.functions.numbers import ratio
from trajecta.operators.quantiles import exact_quantiles
from trajecta.operators.trajectory import ENTITY
from trajecta.session import materialise


def _row(df: DataFrame, name: str, violations: Column) -> DataFrame:
    """Aggregate ``df`` to one (check, violations) row."""
    count = F.coalesce(violations, F.lit(0)).cast("long")
    return df.agg(count.alias("violations")).select(F.lit(name).alias("check"), "violations")


def _flag(df: DataFrame, name: str, broken: Column) -> DataFrame:
    """One (check, 0 or 1) row from a scalar condition; an undecidable one is broken."""
    count = F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0).cast("long")
    return df.sparkSession.range(1).select(F.lit(name).alias("check"), count.alias("violations"))


def _total(df: DataFrame, column: str) -> Column:
    return df.agg(F.sum(column)).scalar()


Rule = tuple[str, Column]


def row_checks(df: DataFrame, *rules: Rule) -> DataFrame:
    """Rows that break each rule, for any number of rules in a single scan.

    A null condition is not a violation.
    """
    counts = [
        F.struct(F.lit(name).alias("check"), F.count_if(broken).alias("violations"))
        for name, broken in rules
    ]
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def measured(df: DataFrame, label: str, **aggregates: Column) -> tuple[DataFrame, dict[str, Any]]:
    """The table, written once, and aggregates that are taken while it is written.

    They are taken in the tasks that write, which count once each, also if executors are lost; a
    value observed before a shuffle might count twice.  No distinct aggregates.
    """
    seen = Observation(label)
    table = materialise(df.observe(seen, *[c.alias(name) for name, c in aggregates.items()]), label)
    return table, seen.get


def counted_rules(df: DataFrame, label: str, *rules: Rule, **aggregates: Column) -> tuple[DataFrame, dict[str, Any], DataFrame]:
    """``measured``, with the rows that break each rule as checks: no scan of their own."""
    counts = {name: F.count_if(broken) for name, broken in rules}
    table, seen = measured(df, label, **counts, **aggregates)
    return table, seen, known(df.sparkSession, {name: seen[name] for name in counts})


def known(spark: SparkSession, violations: Mapping[str, int | bool | None]) -> DataFrame:
    """(check, violations) rows from values that are known; an undecided one is broken."""
    rows = [(name, 1 if v is None else int(v)) for name, v in violations.items()]
    return spark.createDataFrame(rows, "check string, violations long")


def differ(a: Any, b: Any) -> bool:
    """Conservation of two measured sums: both exist and agree."""
    return a is None or b is None or a != b


Final = Callable[[Column], Column]


def grouped_checks(df: DataFrame, aggregates: Mapping[str, Column],
                   *checks: tuple[str, Sequence[str], Final]) -> DataFrame:
    """Checks on the groups of one table, for any number of keys in one scan.

    ``aggregates`` are taken per group.  A check has a name, its keys, and an aggregate over groups,
    a function of the condition that a group belongs to these keys.  One key is a plain grouping,
    several are grouping sets.
    """
    sets = list(dict.fromkeys(tuple(keys) for _, keys, _ in checks))
    columns = list(dict.fromkeys(c for keys in sets for c in keys))
    values = [c.alias(name) for name, c in aggregates.items()]
    if len(sets) == 1:
        grouped = df.groupBy(*columns).agg(*values).withColumn("_set", F.lit(0))
        numbers = {sets[0]: 0}
    else:
        grouped = df.groupingSets([list(keys) for keys in sets], *columns).agg(F.grouping_id().alias("_set"), *values)
        # A bit for every column that a set leaves out, the first column highest.
        numbers = {
            keys: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for keys in sets
        }
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            F.coalesce(final(F.col("_set") == numbers[tuple(keys)]).cast("long"), F.lit(1)).alias("violations"),
        )
        for name, keys, final in checks
    ]
    return grouped.agg(F.array(*rows).alias("counts")).select(F.inline("counts"))


def repeated(where: Column) -> Column:
    """Groups of more than one row; needs an aggregate ``rows``."""
    return F.count_if(where & (F.col("rows") > 1))


def broken(condition: Column) -> Final:
    """Groups that break a rule; an undecided one is broken."""
    return lambda where: F.count_if(where & F.coalesce(condition, F.lit(True)))


def compared(keys: Sequence[str], **sides: tuple[DataFrame, Mapping[str, Column]]) -> DataFrame:
    """One row per key with the sums that each side has under it, null where the side has no row.

    Columns are named side_value, and side_rows counts.  All sides are stacked and meet in one
    exchange, after each task has summed its own, so there is no join and a hot key is one row a task.
    """
    names = [(side, value) for side, (_, values) in sides.items() for value in ("rows", *values)]
    parts = []
    for own, (df, values) in sides.items():
        given = {"rows": F.lit(1).cast("long"), **values}
        parts.append(
            df.select(
                *keys,
                *[(given[value] if side == own else F.lit(None)).alias(f"{side}_{value}") for side, value in names],
            )
        )
    stacked = reduce(DataFrame.union, parts)
    return stacked.groupBy(*keys).agg(*[F.sum(f"{s}_{v}").alias(f"{s}_{v}") for s, v in names])


def over_keys(both: DataFrame, **checks: Column) -> DataFrame:
    """(check, violations) of aggregates over the rows of ``compared``, in one pass; underscores in
    the names are blanks, and an undecided aggregate is broken."""
    rows = [
        F.struct(F.lit(name.replace("_", " ")).alias("check"), F.coalesce(value.cast("long"), F.lit(1)).alias("violations"))
        for name, value in checks.items()
    ]
    return both.agg(F.array(*rows).alias("counts")).select(F.inline("counts"))


def unique_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys that occur more than once."""
    return _row(df.groupBy(*keys).agg(F.count("*").alias("n")), name, F.count_if(F.col("n") > 1))


def orphans(fact: DataFrame, dim: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Distinct fact keys without a dimension row; swap the sides for the other direction.

    The keys are reduced first, so a key that fills the fact is joined once.
    """
    keys = fact.select(*on).distinct()
    return _row(keys.join(dim.select(*on), list(on), "left_anti"), name, F.count("*"))


def same_total(a: DataFrame, column_a: str, b: DataFrame, column_b: str, name: str) -> DataFrame:
    """Conservation: both sums exist and agree."""
    return _flag(a, name, _total(a, column_a) != _total(b, column_b))


def less_total(a: DataFrame, column_a: str, b: DataFrame, column_b: str, name: str) -> DataFrame:
    """The sum of ``a`` must stay below the sum of ``b`` (a forgotten level filter breaks it)."""
    return _flag(a, name, _total(a, column_a) >= _total(b, column_b))


def same_entities(rows: DataFrame, dim: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct key combinations of ``rows`` equal the rows of ``dim``; null keys count."""
    distinct = rows.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    return _flag(rows, name, distinct != dim.agg(F.count(F.lit(1))).scalar())


def margins_agree(cells: DataFrame, value: str, sides: Sequence[Sequence[str]], name: str) -> DataFrame:
    """The grand total equals the sum of the sums along each side."""
    total = _total(cells, value)
    along = [
        _total(cells.groupBy(*side).agg(F.sum(value).alias("_s")), "_s") != total for side in sides
    ]
    return _flag(cells, name, reduce(lambda a, b: a | b, along))


def grains_reconcile(fine: DataFrame, fine_value: str, coarse: DataFrame, coarse_value: str,
                     keys: Sequence[str], name: str) -> DataFrame:
    """Cells whose two grains differ; a cell on one side only counts as different."""
    rolled = fine.groupBy(*keys).agg(F.sum(fine_value).alias("_fine"))
    both = rolled.join(coarse.select(*keys, F.col(coarse_value).alias("_coarse")), list(keys), "full")
    return _row(both, name, F.count_if(~F.col("_fine").eqNullSafe(F.col("_coarse"))))


def sparsity(cells: DataFrame, name: str, bound: float = 0.10, slack: float = 1e-9) -> DataFrame:
    """0 ≤ (Σ observed − Σ expected) / Σ observed < bound; the slack covers a full grid."""
    seen = F.sum("observed")
    gap = ratio(seen - F.sum("expected"), seen)
    out = F.coalesce((gap < -slack) | (gap >= bound), F.lit(True))
    return _row(cells, name, out.cast("int"))


def dense_grid_complete(profiles: DataFrame, periods: DataFrame, name: str,
                        keys: Sequence[str] = ENTITY) -> DataFrame:
    """Entities whose number of rows is not the number of periods."""
    expected = periods.agg(F.count(F.lit(1))).scalar()
    per_entity = profiles.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_expected", expected)
    return _row(per_entity, name, F.count_if(F.col("n") != F.col("_expected")))


def sums_to_one(df: DataFrame, groups: Sequence[str], value: str, name: str,
                tolerance: float = 1e-9) -> DataFrame:
    """Groups whose values do not add up to 1."""
    sums = df.groupBy(*groups).agg(F.sum(value).alias("s"))
    return _row(sums, name, F.count_if(F.coalesce(F.abs(F.col("s") - 1) > tolerance, F.lit(True))))


def outside(columns: Iterable[str], low: float, high: float, name: str) -> Rule:
    """A value outside [low, high] in any column; nulls pass."""
    bad = [F.coalesce(~F.col(c).between(low, high), F.lit(False)) for c in columns]
    return name, reduce(lambda a, b: a | b, bad)


def not_positive(columns: Iterable[str], name: str) -> Rule:
    """A value that is zero, negative or missing."""
    bad = [F.coalesce(F.col(c) <= 0, F.lit(True)) for c in columns]
    return name, reduce(lambda a, b: a | b, bad)


def flag_coherent(flag: Column, definition: Column, name: str) -> Rule:
    """A stored flag that differs from its definition."""
    return name, ~flag.eqNullSafe(definition)


def not_multiple(column: str, step: int, name: str) -> Rule:
    """No multiple of the source's rounding step."""
    return name, F.col(column) % F.lit(step) != 0


def blank(column: str, name: str) -> Rule:
    return name, F.col(column).isNull() | (F.trim(F.col(column)) == "")


def not_normalised(column: str, name: str) -> Rule:
    """A search key that still carries an accent or a capital."""
    return name, ~is_search_key(F.col(column))


def distance_coherent(name: str) -> Rule:
    """A distance if and only if the entity is classified, and never a negative one."""
    distance = F.col("distance")
    undue = distance.isNotNull() != (F.col("archetype") != 0)
    return name, undue | F.coalesce(distance < 0, F.lit(False))


def period_range(df: DataFrame, low: int, high: int, name: str) -> DataFrame:
    """The first and last period are exactly the declared ones."""
    broken = (F.min("period") != F.lit(low)) | (F.max("period") != F.lit(high))
    return _row(df, name, F.coalesce(broken, F.lit(True)).cast("int"))


def distinct_codes(df: DataFrame, column: str, expected: int, name: str) -> DataFrame:
    codes = df.select(column).distinct()
    return _row(codes, name, (F.count(column) != F.lit(expected)).cast("int"))


def missing_codes(df: DataFrame, column: str, required: Sequence[str], name: str) -> DataFrame:
    """Required codes that are absent."""
    found = F.count_distinct(F.when(F.col(column).isin(list(required)), F.col(column)))
    return _row(df, name, F.lit(len(required)) - found)


def median_index(cells: DataFrame, name: str, floor: int = 500,
                 low: float = 0.9, high: float = 1.2) -> DataFrame:
    """The median index of large cells lies strictly between the bounds."""
    large = cells.filter(F.col("observed") >= floor).withColumn(
        "_index", ratio(F.col("observed"), F.col("expected"))
    )
    middle = exact_quantiles(large, "_index", {"median": 0.5})
    broken = (F.max("median") <= low) | (F.max("median") >= high)
    return _row(middle, name, F.coalesce(broken, F.lit(True)).cast("int"))


def membership(bridge: DataFrame, traits: DataFrame, name: str,
               keys: Sequence[str] = ENTITY) -> DataFrame:
    """Group 0 if and only if the entity has no traits, in both directions."""
    marked = traits.select(*keys, F.lit(True).alias("_has"))
    both = bridge.join(marked, list(keys), "full")
    has = F.coalesce("_has", F.lit(False))
    grouped = F.coalesce(F.col("archetype") != 0, F.lit(False))
    return _row(both, name, F.count_if(has != grouped))


def empty_groups(dim: DataFrame, bridge: DataFrame, name: str) -> DataFrame:
    """Groups of the dimension without a member."""
    used = bridge.select("archetype").distinct()
    named = dim.filter(F.col("archetype") > 0)
    return _row(named.join(used, "archetype", "left_anti"), name, F.count("*"))


def ineligible(rows: DataFrame, dim: DataFrame, threshold: int, name: str) -> DataFrame:
    """Entities with a profile although their total is under the threshold."""
    low = dim.filter(F.col("total") < F.lit(threshold)).select("entity_id")
    entities = rows.select("entity_id").distinct()
    return _row(entities.join(low, "entity_id", "left_semi"), name, F.count("*"))


def label_count(labels: Sequence[str], groups: int, dim: DataFrame, name: str) -> DataFrame:
    """One configured label per group, and one dimension row per label plus group 0."""
    rows = dim.agg(F.count(F.lit(1))).scalar()
    return _flag(dim, name, (rows != len(labels) + 1) | F.lit(len(labels) != groups))


def report(checks: Iterable[DataFrame]) -> DataFrame:
    """All checks as (check, violations, passed)."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.withColumn("passed", F.col("violations") == 0)


def gate(rows: DataFrame) -> DataFrame:
    """Raise if any check fails; called before a single file is written."""
    outcome = rows.collect()
    failed = [f"{r['check']}: {r['violations']}" for r in outcome if not r["passed"]]
    if failed:
        raise AssertionError("checks failed: " + "; ".join(failed))
    return rows
