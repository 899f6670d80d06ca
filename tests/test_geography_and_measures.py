import math

import pytest
from pyspark.sql import functions as F

from trajecta.operators import geo, measures

KEYS = ["entity"]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("a", "01", 30), ("a", "02", 10), ("b", "01", 20), ("c", "02", 40)]
    return spark.createDataFrame(rows, "entity string, territory string, observed bigint")


def test_location_quotient(cells):
    got = {(r["entity"], r["territory"]): r["expected"] for r in geo.location_quotient(cells, KEYS).collect()}
    assert got == {("a", "01"): 20.0, ("a", "02"): 20.0, ("b", "01"): 10.0, ("c", "02"): 20.0}


def test_margins_beyond_a_bigint_product(spark):
    big = 4_000_000_000_000_000_000
    df = spark.createDataFrame([("a", "01", big), ("a", "02", 10), ("b", "01", 20)],
                               "entity string, territory string, observed bigint")
    top = geo.location_quotient(df, KEYS).filter("entity = 'a' AND territory = '01'").first()
    assert top["expected"] == pytest.approx(float(big), rel=1e-12)


def test_expected_is_planned_without_a_single_partition_window(cells, capsys):
    geo.location_quotient(cells, KEYS).explain("formatted")
    main = capsys.readouterr().out.split("===== Subqueries =====")[0]
    assert "SinglePartition" not in main and "CartesianProduct" not in main


def test_index_is_a_ratio_of_sums(cells):
    quotients = geo.location_quotient(cells, KEYS)
    regions = quotients.withColumn("region", F.lit("R"))
    row = measures.index_by(regions.filter("entity = 'a'"), "region").first()
    assert (row["observed"], row["expected"], row["index"]) == (40, 40.0, 1.0)


def test_territory_without_counts_stays(spark, cells):
    codes = spark.createDataFrame([("01", "Ain", "84"), ("971", "G", "01"), ("02", "Aisne", "XX")],
                                  "territory string, label string, region string")
    rows = {r["territory"]: r for r in geo.territory_dim(codes, geo.region_labels(spark), cells).collect()}
    assert (rows["01"]["total"], rows["01"]["region_label"], rows["01"]["overseas"]) == (50, "Auvergne-Rhône-Alpes", False)
    assert (rows["971"]["total"], rows["971"]["overseas"]) == (0, True)
    assert rows["02"]["region_label"] is None


def test_frequency_and_single_territory_filter(spark, cells):
    territories = spark.createDataFrame([("01", 50), ("02", 0)], "territory string, total bigint")
    got = {(r["entity"], r["territory"]): r["frequency"] for r in measures.frequency(cells, territories).collect()}
    assert got[("a", "01")] == 6000.0 and got[("c", "02")] is None
    kept = measures.in_several_territories(cells, KEYS).select("entity").distinct().collect()
    assert [r[0] for r in kept] == ["a"]


def test_divergence_matches_the_dense_definition(cells):
    got = {r["territory"]: r["divergence"] for r in measures.divergence(cells, KEYS).collect()}
    overall = {"a": 0.4, "b": 0.2, "c": 0.4}
    for place, mix in {"01": {"a": 0.6, "b": 0.4}, "02": {"a": 0.2, "c": 0.8}}.items():
        want = sum(abs(mix.get(e, 0) - p) for e, p in overall.items()) / 2
        assert got[place] == pytest.approx(want, abs=1e-12)


def test_diversity(spark):
    fact = spark.createDataFrame([("a", 1, 6), ("b", 1, 2), ("c", 1, 0), ("a", 2, 5)],
                                 "entity string, period int, n bigint")
    rows = {r["period"]: r for r in measures.diversity(fact, KEYS, top=1).collect()}
    assert rows[1]["entities"] == 2 and rows[1]["top_share"] == 0.75
    assert rows[1]["entropy"] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    assert rows[2]["entropy"] == pytest.approx(0.0)


def test_search_curve_and_trend(spark):
    dim = spark.createDataFrame([(1, "leo"), (2, "leonie")], "entity_id bigint, search string")
    assert [r[0] for r in measures.search(dim, "LÉO").collect()] == [1]
    assert measures.search(dim, "léo", prefix=True).count() == 2
    fact = spark.createDataFrame([(1, 1999, 5), (1, 2001, 7), (1, 2009, 1)], "entity_id int, period int, n int")
    assert measures.curve(fact, entity_id=1, period=2001).first()["n"] == 7
    assert {r["decade"]: r["n"] for r in measures.decade_trend(fact).collect()} == {1990: 5, 2000: 8}


def test_coverage_by_band(spark):
    local = spark.createDataFrame([(1900, 80)], "period int, n bigint")
    national = spark.createDataFrame([(1901, 100), (1930, 10)], "period int, n bigint")
    band = F.col("period") - F.col("period") % 25
    got = {r["band"]: r["coverage"] for r in measures.coverage_by_band(local, national, band).collect()}
    assert got == {1900: 0.8, 1925: 0.0}
