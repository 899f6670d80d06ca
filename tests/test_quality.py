"""Checks that are fused into writes and into one scan per table."""

import re

import pytest
from pyspark.sql import functions as F

from trajecta.operators import quality
from trajecta.plans.queries import checks


def _rows(df):
    return {r["check"]: r["violations"] for r in df.collect()}


@pytest.fixture()
def cells(spark):
    rows = [("a", "x", 1, 5), ("a", "y", 2, 10), ("a", "y", 2, 10), ("b", None, None, 3), (None, "x", 1, -1)]
    return spark.createDataFrame(rows, "e string, t string, p int, n int")


def test_rules_and_sums_are_counted_while_the_table_is_written(cells):
    rules = [quality.not_multiple("n", 5, "fives"), quality.not_positive(["n"], "positive"), quality.blank("t", "named")]
    table, seen, found = quality.counted_rules(cells, "cells", *rules, total=F.sum("n"), first=F.min("p"))
    assert _rows(found) == _rows(quality.row_checks(cells, *rules)) == {"fives": 2, "positive": 1, "named": 1}
    assert (seen["total"], seen["first"]) == (27, 1)
    assert table.exceptAll(cells).isEmpty() and cells.exceptAll(table).isEmpty()
    _, empty = quality.measured(cells.limit(0), "none", total=F.sum("n"), rows=F.count(F.lit(1)))
    assert empty == {"total": None, "rows": 0}
    assert quality.differ(None, None) and quality.differ(1, 2) and not quality.differ(3, 3)


def test_known_values_become_checks(spark):
    assert _rows(quality.known(spark, {"a": 3, "b": False, "c": True, "d": None})) == {"a": 3, "b": 0, "c": 1, "d": 1}


def test_several_keys_are_checked_in_one_scan(cells, capsys):
    found = quality.grouped_checks(
        cells,
        {"rows": F.count(F.lit(1)), "s": F.sum("n")},
        ("pairs", ["e", "t"], quality.repeated),
        ("entities", ["e"], quality.repeated),
        ("places", ["t"], quality.broken(F.col("s") < 5)),
        ("two places", ["t"], lambda where: F.count_if(where & F.col("t").isNotNull()) != 2),
    )
    # A null key is a key, and is not taken for one that its set leaves out.
    assert _rows(found) == {"pairs": 1, "entities": 1, "places": 2, "two places": 0}
    found.explain("formatted")
    assert len(re.findall(r"^\(\d+\) Scan", capsys.readouterr().out, re.M)) == 1
    one = quality.grouped_checks(cells, {"rows": F.count(F.lit(1))}, ("entities", ["e"], quality.repeated))
    assert _rows(one) == {"entities": 1}


def test_sides_meet_by_key_without_a_join(spark, cells, capsys):
    dim = spark.createDataFrame([("a", 25), ("c", 1), (None, -1)], "e string, total int")
    both = quality.compared(["e"], cells=(cells, {"n": F.col("n")}), dim=(dim, {"total": F.col("total")}))
    found = quality.over_keys(
        both,
        without_dim=F.count_if(F.col("cells_rows").isNotNull() & F.col("dim_rows").isNull()),
        without_cell=F.count_if(F.col("cells_rows").isNull()),
        totals_agree=F.count_if(F.col("cells_n") != F.col("dim_total")),
        undecided=F.sum(F.lit(None).cast("int")),
    )
    assert _rows(found) == {"without dim": 1, "without cell": 1, "totals agree": 0, "undecided": 1}
    found.explain("formatted")
    assert "Join" not in capsys.readouterr().out


def _reads(plan: str) -> dict[str, int]:
    """How often a plan scans each Parquet folder."""
    places = re.findall(r"Location: \w+ ?\[[^\]]*?/([\w-]+?)(?:-[0-9a-f]{32}|\.parquet)", plan)
    return {p: places.count(p) for p in places}


def test_a_report_reads_each_table_once_for_each_set_of_keys(spark, sf_dir, capsys):
    checks.conservation_margins(spark, sf_dir).explain("formatted")
    assert _reads(capsys.readouterr().out) == {"lineitem": 1, "fact": 1, "territory-fact": 1, "cells": 2}
    checks.quality_report(spark, sf_dir).explain("formatted")
    reads = _reads(capsys.readouterr().out)
    assert reads["dim"] == 2 and reads["states"] == 1 and reads["national"] <= 2 and "quotients" not in reads
    assert sum(reads.values()) <= 16


@pytest.mark.parametrize("fault", ["lost", "doubled"])
def test_a_fault_planted_in_one_grain_fires(spark, fault):
    fine = spark.createDataFrame([(k % 4, k % 3, 1) for k in range(24)], "e int, t int, n int")
    coarse = fine.groupBy("e", "t").agg(F.sum("n").alias("n"))
    bad = coarse.filter("e <> 2 OR t <> 1") if fault == "lost" else coarse.union(coarse.limit(1))
    for side, want in ((coarse, 0), (bad, 1)):
        both = quality.compared(["e", "t"], fine=(fine, {"n": F.col("n")}), coarse=(side, {"n": F.col("n")}))
        differs = F.count_if(~F.col("fine_n").eqNullSafe(F.col("coarse_n")))
        assert _rows(quality.over_keys(both, cells_reconcile=differs)) == {"cells reconcile": want}
