"""Data-quality checks over the given tables and over what is built from them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.constants import DEPARTMENT, NATIONAL
from trajecta.operators import archetypes, cluster, geo, quality, star, trajectory
from trajecta.plans import observations as obs
from trajecta.plans.catalog import registered
from trajecta.plans.queries.clusters import ASSIGNED, CENTRES, LABELS
from trajecta.plans.queries.star import _DIM, stored_register
from trajecta.session import materialise, scratch_dir
from trajecta.sources.register import department_rows, national_rows, row_fate
from trajecta.sources.store import TableStore

KEYS = obs.KEYS


def _counts(*checks: tuple[str, str]) -> str:
    """Oracle text: one (check, violations) row per entry."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", CAST(({sql}) AS BIGINT) AS violations" for name, sql in checks
    )


@registered(
    "orphan_facts",
    """SELECT doc_id AS key, 'document without label' AS gap FROM documents
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)
       UNION ALL
       SELECT c_custkey, 'customer without order' FROM customer ANTI JOIN orders ON o_custkey = c_custkey""",
)
def orphan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels, customers, orders = (
        obs.table(spark, sf_dir, n) for n in ("documents", "labels", "customer", "orders")
    )
    unlabelled = documents.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    idle = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return unlabelled.select(
        F.col("doc_id").alias("key"), F.lit("document without label").alias("gap")
    ).unionByName(
        idle.select(F.col("c_custkey").alias("key"), F.lit("customer without order").alias("gap"))
    )


@registered(
    "unmatched_both_ways",
    _counts(
        ("orders without customer",
         "SELECT COUNT(DISTINCT o_custkey) FROM orders ANTI JOIN customer ON o_custkey = c_custkey"),
        ("customers without order",
         "SELECT COUNT(DISTINCT c_custkey) FROM customer ANTI JOIN orders ON o_custkey = c_custkey"),
        ("documents without label",
         "SELECT COUNT(DISTINCT doc_id) FROM documents ANTI JOIN labels USING (doc_id)"),
        ("labels without document",
         "SELECT COUNT(DISTINCT doc_id) FROM labels ANTI JOIN documents USING (doc_id)"),
        ("lines without order",
         "SELECT COUNT(DISTINCT l_orderkey) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey"),
        ("orders without line",
         "SELECT COUNT(DISTINCT o_orderkey) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey"),
    ),
)
def unmatched_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keys(name: str, column: str) -> DataFrame:
        return obs.table(spark, sf_dir, name).select(F.col(column).alias("key"))

    pairs = [
        (keys("orders", "o_custkey"), keys("customer", "c_custkey"), "orders without customer", "customers without order"),
        (keys("documents", "doc_id"), keys("labels", "doc_id"), "documents without label", "labels without document"),
        (keys("lineitem", "l_orderkey"), keys("orders", "o_orderkey"), "lines without order", "orders without line"),
    ]
    checks = []
    for left, right, forth, back in pairs:
        checks += [quality.orphans(left, right, ["key"], forth), quality.orphans(right, left, ["key"], back)]
    return quality.report(checks).drop("passed")


def _repeated(table: str, keys: str) -> str:
    return f"SELECT COUNT(*) FROM (SELECT {keys} FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1)"


@registered(
    "grain_duplicates",
    _counts(
        ("order lines", _repeated("lineitem", "l_orderkey, l_linenumber")),
        ("lines per part and month", _repeated("(SELECT *, month(l_shipdate) AS m FROM lineitem)", "l_partkey, m")),
        ("orders", _repeated("orders", "o_orderkey")),
        ("texts", _repeated("documents", "text")),
        ("turns", _repeated("conversations", "conv_id, turn")),
        ("pages", _repeated("pages", "url")),
    ),
)
def grain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, documents, conversations, pages = (
        obs.table(spark, sf_dir, n) for n in ("lineitem", "orders", "documents", "conversations", "pages")
    )
    monthly = lines.select("l_partkey", F.month("l_shipdate").alias("m"))
    # A digest and the length stand for a text, which is never shuffled.
    digests = documents.select(F.length("text").alias("length"), F.sha2("text", 256).alias("sha256"))
    return quality.report(
        [
            quality.unique_key(lines, ["l_orderkey", "l_linenumber"], "order lines"),
            quality.unique_key(monthly, ["l_partkey", "m"], "lines per part and month"),
            quality.unique_key(orders, ["o_orderkey"], "orders"),
            quality.unique_key(digests, ["length", "sha256"], "texts"),
            quality.unique_key(conversations, ["conv_id", "turn"], "turns"),
            quality.unique_key(pages, ["url"], "pages"),
        ]
    ).drop("passed")


@registered(
    "distinct_keys",
    """SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT (l_partkey, l_linestatus)) AS pairs,
              MIN(year(l_shipdate)) AS first_year, MAX(year(l_shipdate)) AS last_year,
              ROUND(SUM(l_extendedprice * l_discount) / SUM(l_extendedprice), 9) AS mean_discount,
              (SELECT COUNT(*) FROM part) - COUNT(DISTINCT l_partkey) AS parts_never_sold
       FROM lineitem""",
)
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct columns and rows, ranges, a ratio of sums and a scalar subquery."""
    lines = obs.table(spark, sf_dir, "lineitem")
    known = obs.table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    discounted = F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")
    return lines.agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct(F.struct("l_partkey", "l_linestatus")).alias("pairs"),
        F.min(F.year("l_shipdate")).cast("long").alias("first_year"),
        F.max(F.year("l_shipdate")).cast("long").alias("last_year"),
        F.round(discounted, 9).alias("mean_discount"),
    ).withColumn("parts_never_sold", known - F.col("parts"))


@registered(
    "grain_reconciliation",
    f"""WITH {obs.REGISTER},
    fine AS (SELECT level, grp, entity, period, SUM(n) AS fine FROM clean WHERE level = 'DEP' GROUP BY 1, 2, 3, 4),
    coarse AS (SELECT grp, entity, period, n AS coarse FROM national)
    SELECT grp, entity, period, CAST(fine AS BIGINT) AS fine, CAST(coarse AS BIGINT) AS coarse,
           fine IS NOT DISTINCT FROM coarse AS agrees
    FROM fine FULL JOIN coarse USING (grp, entity, period)""",
)
def grain_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the register with the sum of its territories and the national count."""
    register = stored_register(spark, sf_dir, DEPARTMENT, NATIONAL)
    cell = ["grp", "entity", "period"]
    fine = department_rows(register).groupBy(*cell).agg(F.sum("n").alias("fine"))
    coarse = national_rows(register).select(*cell, F.col("n").alias("coarse"))
    both = fine.join(coarse, cell, "full")
    return both.withColumn("agrees", F.col("fine").eqNullSafe(F.col("coarse")))


@registered(
    "levels_before_cleaning",
    f"""WITH {obs.REGISTER}
    SELECT sexe, CAST(SUM(valeur) FILTER (WHERE niveau_geographique = 'FRANCE') AS BIGINT) AS raw_total,
           (SELECT CAST(SUM(n) AS BIGINT) FROM local l WHERE l.grp = CAST(r.sexe AS SMALLINT)) AS clean_fine
    FROM register r GROUP BY sexe""",
)
def levels_before_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw national total of each group next to its cleaned territorial one, which lies below
    by the rows without a year and the buckets of rare names."""
    register = stored_register(spark, sf_dir, DEPARTMENT, NATIONAL)
    raw = register.filter(F.col("niveau_geographique") == NATIONAL).groupBy("sexe").agg(F.sum("valeur").alias("raw_total"))
    fine = department_rows(register).groupBy(F.col("grp").cast("string").alias("sexe")).agg(F.sum("n").alias("clean_fine"))
    return raw.join(fine, "sexe", "left")


@registered(
    "register_row_fates",
    f"""WITH {obs.REGISTER},
    dirty AS (
      SELECT niveau_geographique, prenom, CASE WHEN rang = 6 THEN '40000' ELSE periode END AS periode,
             CASE WHEN rang = 5 THEN 'X' ELSE sexe END AS sexe FROM register)
    SELECT niveau_geographique,
           CASE WHEN TRY_CAST(periode AS INTEGER) IS NULL THEN 'no_period'
                WHEN prenom[1] = '_' THEN 'rare'
                WHEN TRY_CAST(periode AS SMALLINT) IS NULL THEN 'bad_period'
                WHEN TRY_CAST(sexe AS SMALLINT) IS NULL THEN 'bad_group' ELSE 'kept' END AS fate,
           COUNT(*) AS cells
    FROM dirty GROUP BY 1, 2""",
)
def register_row_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are kept, dropped and refused, with years and groups that do not fit put in."""
    dirty = obs.register(spark, sf_dir).withColumns(
        {
            "periode": F.when(F.col("rang") == 6, "40000").otherwise(F.col("periode")),
            "sexe": F.when(F.col("rang") == 5, "X").otherwise(F.col("sexe")),
        }
    )
    return dirty.groupBy("niveau_geographique", row_fate().alias("fate")).agg(F.count("*").alias("cells"))


_CONSERVED = (
    ("lines to facts",
     "SELECT CAST((SELECT SUM(l_quantity) FROM lineitem) <> (SELECT SUM(n) FROM fact) AS INT)"),
    ("facts to cells",
     "SELECT CAST((SELECT SUM(n) FROM fact) <> (SELECT SUM(observed) FROM cells) AS INT)"),
    ("fine to coarse",
     "SELECT CAST((SELECT SUM(n) FROM tfact) <> (SELECT SUM(observed) FROM cells) AS INT)"),
    ("eligible part only",
     "SELECT CAST((SELECT SUM(total) FROM eligible) <> (SELECT SUM(n) FROM fact) AS INT)"),
    ("margins agree",
     """SELECT CAST((SELECT SUM(s) FROM (SELECT SUM(observed) AS s FROM cells GROUP BY territory)) <> t
          OR (SELECT SUM(s) FROM (SELECT SUM(observed) AS s FROM cells GROUP BY entity, grp)) <> t AS INT)
        FROM (SELECT SUM(observed) AS t FROM cells)"""),
    ("cells reconcile",
     """SELECT COUNT(*) FROM (SELECT entity, grp, territory, SUM(n) AS s FROM tfact GROUP BY 1, 2, 3)
        FULL JOIN cells USING (entity, grp, territory) WHERE s IS DISTINCT FROM observed"""),
    ("entities kept",
     """SELECT CAST((SELECT COUNT(DISTINCT (l_partkey, l_linestatus)) FROM lineitem)
          <> (SELECT COUNT(*) FROM (SELECT DISTINCT entity, grp FROM fact)) AS INT)"""),
    ("entities eligible",
     """SELECT CAST((SELECT COUNT(DISTINCT (l_partkey, l_linestatus)) FROM lineitem)
          <> (SELECT COUNT(*) FROM eligible) AS INT)"""),
)


@registered("conservation_margins", f"WITH {obs.TRAJECTORY},{obs.CELLS} " + _counts(*_CONSERVED))
def conservation_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals are measured while the tables are written; the rest reads each of them once."""
    total = F.sum("n")
    with obs.summing_lines(spark, sf_dir):
        fact, facts = quality.measured(obs.part_fact(spark, sf_dir), "fact", total=total)
    fine, fines = quality.measured(obs.territorial_fact(spark, sf_dir), "territory-fact", total=total)
    cells, coarse = quality.measured(geo.territory_cells(fine, KEYS), "cells", total=F.sum("observed"))
    lines = obs.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity"), F.col("l_linestatus").alias("grp"), "l_quantity"
    )
    entities = star.entity_profile(fact, rank=None)
    kept = F.col("entities_total") >= obs.THRESHOLD
    by_entity = quality.compared(
        KEYS, lines=(lines, {"n": F.col("l_quantity")}), entities=(entities, {"total": F.col("total")})
    )
    cell = [*KEYS, "territory"]
    by_cell = quality.compared(cell, fine=(fine, {"n": F.col("n")}), coarse=(cells, {"n": F.col("observed")}))
    named = F.count("lines_rows")

    def margin(where: Column) -> Column:
        return F.sum(F.when(where, F.col("s"))) != F.lit(coarse["total"])

    margins = [("by territory", ["territory"], margin), ("by entity", KEYS, margin)]
    sides = quality.grouped_checks(cells, {"s": F.sum("observed")}, *margins)
    return quality.report(
        [
            quality.known(
                spark,
                {
                    "facts to cells": quality.differ(facts["total"], coarse["total"]),
                    "fine to coarse": quality.differ(fines["total"], coarse["total"]),
                },
            ),
            quality.over_keys(
                by_entity,
                lines_to_facts=F.sum("lines_n") != F.lit(facts["total"]),
                eligible_part_only=F.sum(F.when(kept, F.col("entities_total"))) != F.lit(facts["total"]),
                entities_kept=named != F.count("entities_rows"),
                entities_eligible=named != F.count_if(kept),
            ),
            quality.over_keys(by_cell, cells_reconcile=F.count_if(~F.col("fine_n").eqNullSafe(F.col("coarse_n")))),
            sides.agg(F.max("violations").alias("violations")).select(F.lit("margins agree").alias("check"), "violations"),
        ]
    ).drop("passed")


_REPORT = (
    ("national counts conserved",
     """SELECT CAST((SELECT SUM(valeur) FROM register WHERE niveau_geographique = 'FRANCE')
          <> (SELECT SUM(n) FROM national) AS INT)"""),
    ("territorial below national",
     """SELECT CAST((SELECT SUM(n) FROM local)
          >= (SELECT SUM(valeur) FROM register WHERE niveau_geographique = 'FRANCE') AS INT)"""),
    ("entities conserved",
     """SELECT CAST((SELECT COUNT(DISTINCT (prenom, sexe)) FROM register WHERE niveau_geographique = 'FRANCE')
          <> (SELECT COUNT(*) FROM dim) AS INT)"""),
    ("natural key", "SELECT COUNT(*) FROM (SELECT entity, grp FROM dim GROUP BY 1, 2 HAVING COUNT(*) > 1)"),
    ("segment label", "SELECT COUNT(*) FROM (SELECT segment FROM dim GROUP BY 1 HAVING COUNT(*) > 1)"),
    ("facts without entity",
     "SELECT COUNT(*) FROM (SELECT DISTINCT entity, grp FROM local) ANTI JOIN dim USING (entity, grp)"),
    ("multiples of 5", "SELECT COUNT(*) FROM national WHERE n % 5 <> 0"),
    ("search key", "SELECT COUNT(*) FROM dim WHERE search <> lower(strip_accents(search))"),
    ("shares of periods",
     """SELECT COUNT(*) FROM (SELECT SUM(x) AS s FROM (
          SELECT period, grp, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY period, grp) AS x FROM national)
        GROUP BY period, grp) WHERE ABS(s - 1) > 1e-9"""),
    ("declared periods",
     "SELECT CAST(MIN(period) <> 1995 OR MAX(period) <> 2001 AS INT) FROM national"),
    ("two groups", "SELECT CAST(COUNT(DISTINCT grp) <> 2 AS INT) FROM dim"),
    ("grid complete",
     """SELECT COUNT(*) FROM (SELECT COUNT(*) AS c FROM profiles GROUP BY entity, grp)
        WHERE c <> (SELECT COUNT(*) FROM calendar)"""),
    ("profile shares",
     "SELECT COUNT(*) FROM (SELECT SUM(share) AS s FROM profiles GROUP BY entity, grp) WHERE ABS(s - 1) > 1e-9"),
    ("smoothed shares",
     "SELECT COUNT(*) FROM (SELECT SUM(smooth) AS s FROM profiles GROUP BY entity, grp) WHERE ABS(s - 1) > 0.05"),
    ("traits in [0, 1]",
     """SELECT COUNT(*) FROM traits WHERE concentration NOT BETWEEN 0 AND 1 OR recency NOT BETWEEN 0 AND 1
          OR asymmetry NOT BETWEEN 0 AND 1"""),
    ("strong run", "SELECT COUNT(*) FROM traits WHERE strong_width < 1 OR strong_runs < 1"),
    ("ongoing flag", f"SELECT COUNT(*) FROM traits WHERE ongoing <> (peak_period >= {obs.VINTAGE} - 9)"),
    ("peak within periods",
     f"SELECT COUNT(*) FROM traits WHERE peak_period NOT BETWEEN {obs.PIVOT} AND {obs.VINTAGE}"),
    ("group 0 without traits",
     """SELECT COUNT(*) FROM (SELECT DISTINCT entity, grp FROM fact) LEFT JOIN assigned USING (entity, grp)
        LEFT JOIN (SELECT entity, grp, true AS has FROM traits) USING (entity, grp)
        WHERE (archetype IS NOT NULL) <> COALESCE(has, false)"""),
    ("distance of members", "SELECT COUNT(*) FROM assigned WHERE distance IS NULL OR distance < 0"),
    ("no empty group", "SELECT 5 - COUNT(DISTINCT archetype) FROM assigned"),
    ("one label per group",
     f"""SELECT CAST(COUNT(DISTINCT label) <> {len(CENTRES)} OR COUNT(*) <> {len(CENTRES)} AS INT)
        FROM (VALUES {", ".join(f"('{label}')" for label in LABELS)}) AS l(label)"""),
    ("cells positive", "SELECT COUNT(*) FROM quotients WHERE observed <= 0 OR expected <= 0"),
    ("sparsity",
     """SELECT CAST((SUM(observed) - SUM(expected)) / SUM(observed) < -1e-9
          OR (SUM(observed) - SUM(expected)) / SUM(observed) >= 0.10 AS INT) FROM quotients"""),
    ("median index",
     """SELECT CAST(NOT (median(observed / expected) > 0.9 AND median(observed / expected) < 1.2) AS INT)
        FROM quotients WHERE observed >= 60"""),
    ("overseas flag",
     f"""SELECT COUNT(*) FROM nation JOIN codes ON label = n_name
        WHERE (length(territory) = 3) <> (n_nationkey >= 20)"""),
    ("territory labels", "SELECT COUNT(*) FROM codes WHERE label IS NULL OR trim(label) = ''"),
    ("region labels",
     """SELECT COUNT(*) FROM codes LEFT JOIN regions USING (region)
        WHERE region_label IS NULL OR trim(region_label) = ''"""),
    ("territory totals",
     """SELECT COUNT(*) FROM codes LEFT JOIN (SELECT territory, SUM(observed) AS s FROM cells GROUP BY 1)
        USING (territory) WHERE s <= 0"""),
    ("codes kept", "SELECT 3 - COUNT(*) FROM codes WHERE territory IN ('01', '970', '2A')"),
    ("territories without cell",
     "SELECT COUNT(*) FROM codes ANTI JOIN (SELECT DISTINCT territory FROM cells) USING (territory)"),
    ("territory totals conserved",
     """SELECT CAST((SELECT SUM(s) FROM codes
                     JOIN (SELECT territory, SUM(observed) AS s FROM cells GROUP BY 1) USING (territory))
          <> (SELECT SUM(observed) FROM cells) AS INT)"""),
)


@registered(
    "quality_report",
    f"""WITH {ASSIGNED},{obs.REGISTER},{_DIM},{obs.QUOTIENTS},{obs.CODE_LIST}
    SELECT *, violations = 0 AS passed FROM ({_counts(*_REPORT)})""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of check over a star, trajectories, archetypes and cells built here.

    Some rules do not hold for these tables (their counts are not rounded to 5, and the
    register keeps sentinel periods), so the report also shows checks that fire.  Rules of single
    rows and totals are counted while a table is written; what needs groups reads a table once for
    all its keys.
    """
    register = stored_register(spark, sf_dir)
    source = register.filter("niveau_geographique = 'FRANCE'")
    local = department_rows(register)
    national, nation, rounded = quality.counted_rules(
        national_rows(register), "national", quality.not_multiple("n", 5, "multiples of 5"),
        total=F.sum("n"), first=F.min("period"), last=F.max("period"),
    )
    dim, _, search = quality.counted_rules(
        star.entity_dim(national), "dim", quality.not_normalised("search", "search key")
    )

    fact = obs.landed_fact(spark, sf_dir)
    periods, calendar = quality.measured(star.period_dim(fact), "periods", rows=F.count(F.lit(1)))
    grid = trajectory.dense_grid(fact, periods, KEYS, obs.THRESHOLD)
    # The sums of an entity's profile are taken with its traits, so the dense rows are never stored.
    sums = {"rows": F.count(F.lit(1)), "share_sum": F.sum("share"), "smooth_sum": F.sum("smooth")}
    dense = trajectory.states(trajectory.profile(grid, KEYS), KEYS)
    states = materialise(
        trajectory.traits(dense, KEYS, pivot=obs.PIVOT, vintage=obs.VINTAGE, also=sums), "states"
    )
    traits, _, trait_rules = quality.counted_rules(
        states.drop(*sums),
        "traits",
        quality.outside(["concentration", "recency", "asymmetry"], 0.0, 1.0, "traits in [0, 1]"),
        quality.not_positive(["strong_width", "strong_runs"], "strong run"),
        quality.flag_coherent(F.col("ongoing"), F.col("peak_period") >= obs.VINTAGE - 9, "ongoing flag"),
        quality.outside(["peak_period"], obs.PIVOT, obs.VINTAGE, "peak within periods"),
    )
    model = cluster.Archetypes(cluster.fit_scale(cluster.weighted_points(traits)), CENTRES, 0.0)
    groups = archetypes.archetype_dim(spark, LABELS)
    bridge, _, distances = quality.counted_rules(
        archetypes.bridge(fact.select(*KEYS).distinct(), cluster.assign(traits, model), KEYS),
        "bridge",
        quality.distance_coherent("distance of members"),
    )

    cells, coarse = quality.measured(obs.cells(spark, sf_dir), "cells", total=F.sum("observed"))
    quotients, quotient, positive = quality.counted_rules(
        geo.location_quotient(cells, KEYS),
        "quotients",
        quality.not_positive(["observed", "expected"], "cells positive"),
        observed=F.sum("observed"), expected=F.sum("expected"),
    )
    territories, territory, territory_rules = quality.counted_rules(
        geo.territory_dim(obs.code_list(spark, sf_dir), obs.region_list(spark, sf_dir), cells),
        "territories",
        quality.flag_coherent(F.col("overseas"), F.length("territory") == 3, "overseas flag"),
        quality.blank("label", "territory labels"),
        quality.blank("region_label", "region labels"),
        quality.not_positive(["total"], "territory totals"),
        total=F.sum("total"), required=F.count_if(F.col("territory").isin("01", "970", "2A")),
    )

    # Groups as text, as the source writes them.
    pair = ["entity", "grp"]
    by_pair = quality.compared(
        pair,
        source=(source.select(F.col("prenom").alias("entity"), F.col("sexe").alias("grp"), "valeur"), {"n": F.col("valeur")}),
        local=(local.select("entity", F.col("grp").cast("string").alias("grp"), "n"), {"n": F.col("n")}),
        dim=(dim.select("entity", F.col("grp").cast("string").alias("grp")), {}),
    )
    smooth = F.abs(F.col("smooth_sum") - 1) > 0.05
    gap = None if not quotient["observed"] else (quotient["observed"] - quotient["expected"]) / quotient["observed"]
    return quality.report(
        [
            rounded, search, trait_rules, distances, positive, territory_rules,
            quality.known(
                spark,
                {
                    "declared periods": (nation["first"], nation["last"]) != (1995, 2001),
                    "sparsity": gap is None or gap < -1e-9 or gap >= 0.10,
                    "codes kept": 3 - territory["required"],
                    "territory totals conserved": quality.differ(territory["total"], coarse["total"]),
                },
            ),
            quality.over_keys(
                by_pair,
                national_counts_conserved=F.sum("source_n") != F.lit(nation["total"]),
                territorial_below_national=F.sum("local_n") >= F.sum("source_n"),
                entities_conserved=F.count("source_rows") != F.sum("dim_rows"),
                facts_without_entity=F.count_if(F.col("local_rows").isNotNull() & F.col("dim_rows").isNull()),
            ),
            quality.grouped_checks(
                dim, {"rows": F.count(F.lit(1))},
                ("natural key", pair, quality.repeated),
                ("segment label", ["segment"], quality.repeated),
                ("two groups", ["grp"], lambda where: F.count_if(where & F.col("grp").isNotNull()) != 2),
            ),
            quality.sums_to_one(star.with_cell_share(national), ["period", "grp"], "share", "shares of periods"),
            quality.grouped_checks(
                states,
                {name: F.sum(name) for name in sums},
                ("grid complete", KEYS, quality.broken(F.col("rows") != F.lit(calendar["rows"]))),
                ("profile shares", KEYS, quality.broken(F.abs(F.col("share_sum") - 1) > 1e-9)),
                ("smoothed shares", KEYS, quality.broken(smooth)),
            ),
            quality.membership(bridge, traits, "group 0 without traits", KEYS),
            quality.empty_groups(groups, bridge, "no empty group"),
            quality.label_count(LABELS, len(CENTRES), groups, "one label per group"),
            quality.median_index(quotients, "median index", floor=60),
            quality.orphans(territories, cells, ["territory"], "territories without cell"),
        ]
    )


_SIZES = """
  SELECT r_name AS region, n_name AS nation, CAST(COUNT(*) AS BIGINT) AS customers
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY 1, 2"""


@registered(
    "gated_snapshots",
    f"""WITH sizes AS ({_SIZES}), by_region AS (SELECT region, CAST(SUM(customers) AS BIGINT) AS customers FROM sizes GROUP BY 1),
    seen(run, gate, snapshot, step) AS (VALUES (1, 'passed', 1, 1), (2, 'fired', 1, 1), (3, 'passed', 2, 3))
    SELECT run, gate, snapshot, 'nations' AS "table", COUNT(*) AS "rows", CAST(SUM(customers * step) AS BIGINT) AS customers
    FROM seen, sizes GROUP BY 1, 2, 3
    UNION ALL
    SELECT run, gate, snapshot, 'regions', COUNT(*), CAST(SUM(customers * step) AS BIGINT)
    FROM seen, by_region GROUP BY 1, 2, 3""",
)
def gated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of two tables after each of three runs of a stage, whose gate compares their
    totals.  The second run loses a region in one of them, so its gate fires."""
    customers, nations, regions = (obs.table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    sizes = materialise(
        customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
        .agg(F.count("*").alias("customers")),
        "sizes",
    )
    store = TableStore(spark, f"{scratch_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    seen = []
    for run in (1, 2, 3):
        nation_sizes = sizes.withColumn("customers", F.col("customers") * run)
        region_sizes = nation_sizes.groupBy("region").agg(F.sum("customers").alias("customers"))
        if run == 2:
            region_sizes = region_sizes.filter("region <> 'ASIA'")
        with store.stage({"nations": nation_sizes, "regions": region_sizes}) as staged:
            check = quality.same_total(staged.read("nations"), "customers", staged.read("regions"), "customers", "totals agree")
            try:
                quality.gate(quality.report([check]))
                staged.publish()
                fate = "passed"
            except AssertionError:
                fate = "fired"
        for table in ("nations", "regions"):
            seen.append(
                store.read(table)
                .agg(F.count("*").alias("rows"), F.sum("customers").alias("customers"))
                .select(
                    F.lit(run).alias("run"), F.lit(fate).alias("gate"), F.lit(max(store.versions())).alias("snapshot"),
                    F.lit(table).alias("table"), "rows", "customers",
                )
            )
    return reduce(DataFrame.unionByName, seen)
