"""One entity, cell or territory holds a third of all rows: results stay whole."""

import pytest
from pyspark.sql import functions as F

from trajecta.operators import geo, measures, star, trajectory
from trajecta.plans import observations

ROWS = 60_000
KEYS = ["entity", "grp"]


@pytest.fixture(scope="module")
def lines(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        F.when(hot, 7).otherwise(F.col("id") % 997).alias("entity"),
        F.when(hot, "O").otherwise(F.when(F.col("id") % 2 == 0, "O").otherwise("F")).alias("grp"),
        F.when(hot, 1).otherwise(F.col("id") % 41).cast("int").alias("period"),
        F.when(hot, "03").otherwise(F.lpad((F.col("id") % 19).cast("string"), 2, "0")).alias("territory"),
        F.lit(1).cast("long").alias("n"),
    )


@pytest.fixture(scope="module")
def fact(lines):
    return lines.groupBy(*KEYS, "period").agg(F.sum("n").alias("n")).cache()


def test_lines_are_pruned_and_summed_before_they_are_shuffled(spark, sf_dir, capsys):
    observations.part_fact(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.index("partial_sum(l_quantity") < plan.index("hashpartitioning(")
    read = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "l_extendedprice" not in read and "l_quantity" in read


def test_shares_of_a_hot_cell_are_whole(fact):
    shares = star.with_cell_share(fact)
    assert shares.count() == fact.count()
    sums = shares.groupBy("period", "grp").agg(F.sum("share").alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").count() == 0


def test_traits_cover_every_entity(fact):
    found = trajectory.shape_traits(fact, fact.select("period").distinct(), KEYS)
    assert found.count() == fact.select(*KEYS).distinct().count()
    hot = found.filter("entity = 7 AND grp = 'O'").first()
    assert (hot["peak_period"], hot["start_period"]) == (0, 1)


def test_margins_of_a_hot_territory(lines):
    cells = lines.groupBy(*KEYS, "territory").agg(F.sum("n").alias("observed"))
    quotients = geo.location_quotient(cells, KEYS)
    assert quotients.count() == cells.count()
    row = quotients.filter("entity = 7 AND grp = 'O' AND territory = '03'").first()
    entity = cells.filter("entity = 7 AND grp = 'O'").agg(F.sum("observed")).first()[0]
    place = cells.filter("territory = '03'").agg(F.sum("observed")).first()[0]
    assert row["expected"] == pytest.approx(entity * place / ROWS, rel=1e-12)
    scores = [r["divergence"] for r in measures.divergence(cells, KEYS).collect()]
    assert len(scores) == 19 and all(0 <= s <= 1 for s in scores)
