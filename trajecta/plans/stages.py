"""The four table-building stages: compute, check, then export.

Each stage hands over through the table store, so a stage can be run again alone.  Its
tables are written once, beside the published ones; the checks read that copy, which is moved to
its name if all gate checks pass and deleted if one fails.  ``verify`` runs the gate checks again
on the exported tables together with the wider contract of each table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.config import Settings
from trajecta.functions.constants import DEPARTMENT, NATIONAL
from trajecta.operators import archetypes as arch
from trajecta.operators import cluster, describe, geo, quality, star, trajectory
from trajecta.schemas import TABLES, from_contract, to_contract
from trajecta.session import materialise, scratch_scope
from trajecta.sources.provenance import (
    fingerprints,
    manifest_entries,
    provenance_status,
    require_content,
    require_provenance,
    save_manifest,
    stored_manifest,
    upsert_manifest,
)
from trajecta.sources.register import (
    department_rows,
    land_register,
    national_rows,
    read_code_list,
    read_register,
)
from trajecta.sources.store import TableStore

Tables = dict[str, DataFrame]


def _load(store: TableStore, *names: str) -> list[DataFrame]:
    return [from_contract(name, store.read(name)) for name in names]


def _export(store: TableStore, tables: Mapping[str, DataFrame],
            gate: Callable[[Tables], list[DataFrame]]) -> dict[str, int]:
    """Write each table once, check that very copy, and publish it if the gate lets it pass."""
    with store.stage({name: to_contract(name, df) for name, df in tables.items()}) as staged:
        copies = {name: from_contract(name, staged.read(name)) for name in tables}
        quality.gate(quality.report(gate(copies)))
        return staged.publish()


# --- national ------------------------------------------------------------------------


def national_tables(register: DataFrame) -> Tables:
    rows = national_rows(register)
    dim = star.entity_dim(rows)
    return {
        "d_prenom": dim,
        "d_annee": star.period_dim(rows),
        "d_sexe": star.group_dim(register.sparkSession),
        "f_naissances": star.period_fact(rows, dim),
    }


def _unfiltered(register: DataFrame, level: str) -> DataFrame:
    return register.filter(F.col("niveau_geographique") == level)


def national_gate(t: Tables, register: DataFrame) -> list[DataFrame]:
    dim, fact = t["d_prenom"], t["f_naissances"]
    source = _unfiltered(register, NATIONAL)
    return [
        quality.same_total(source, "valeur", fact, "n", "national counts conserved"),
        quality.unique_key(fact, ["entity_id", "period"], "f_naissances grain"),
        quality.orphans(fact, dim, ["entity_id"], "facts without entity"),
    ]


def national_contract(t: Tables, register: DataFrame, settings: Settings) -> list[DataFrame]:
    dim, fact, periods, groups = (t[n] for n in ("d_prenom", "f_naissances", "d_annee", "d_sexe"))
    source = _unfiltered(register, NATIONAL)
    cell = fact.join(dim.select("entity_id", "grp"), "entity_id")
    return [
        quality.unique_key(dim, ["entity_id"], "d_prenom key"),
        quality.unique_key(dim, ["entity", "grp"], "d_prenom natural key"),
        quality.unique_key(dim, ["segment"], "segment label unique"),
        quality.unique_key(periods, ["period"], "d_annee key"),
        quality.unique_key(groups, ["grp"], "d_sexe key"),
        quality.orphans(fact, periods, ["period"], "facts without period"),
        quality.orphans(dim, groups, ["grp"], "entities without group"),
        quality.same_total(dim, "total", fact, "n", "dimension totals conserved"),
        quality.same_entities(source.select("prenom", "sexe"), dim, ["prenom", "sexe"], "entities conserved"),
        quality.row_checks(fact, quality.not_multiple("n", 5, "national multiples of 5")),
        quality.period_range(periods, settings.first_period, settings.vintage, "declared periods"),
        quality.distinct_codes(dim, "grp", 2, "two groups"),
        quality.row_checks(dim, quality.not_normalised("search", "search key normalised")),
        quality.sums_to_one(cell, ["period", "grp"], "share", "shares per period and group"),
    ]


def run_national(store: TableStore, register: DataFrame) -> dict[str, int]:
    with scratch_scope(store.spark):
        return _export(store, national_tables(register), lambda t: national_gate(t, register))


# --- trajectories --------------------------------------------------------------------


def trajectory_tables(fact: DataFrame, periods: DataFrame, settings: Settings) -> Tables:
    grid = trajectory.dense_grid(fact, periods, threshold=settings.threshold)
    stated = materialise(trajectory.states(trajectory.profile(grid)), "states")
    return {
        "profil": stated.select("entity_id", "period", "n", "share", "smooth", "cumulative"),
        "traits": trajectory.traits(stated, pivot=settings.pivot, vintage=settings.vintage),
    }


def trajectory_gate(t: Tables, periods: DataFrame) -> list[DataFrame]:
    return [quality.dense_grid_complete(t["profil"], periods, "grid complete")]


def trajectory_contract(t: Tables, dim: DataFrame, settings: Settings) -> list[DataFrame]:
    profiles, traits = t["profil"], t["traits"]
    kept = trajectory.eligible(dim, settings.threshold)
    first, last = settings.first_period, settings.vintage
    return [
        quality.same_entities(profiles, kept, ["entity_id"], "one profile per eligible entity"),
        quality.ineligible(profiles, dim, settings.threshold, "eligibility respected"),
        quality.same_entities(traits, kept, ["entity_id"], "one trait row per eligible entity"),
        quality.unique_key(traits, ["entity_id"], "traits key"),
        quality.sums_to_one(profiles, ["entity_id"], "share", "profile shares"),
        quality.sums_to_one(profiles, ["entity_id"], "smooth", "smoothed shares", tolerance=0.05),
        quality.row_checks(
            traits,
            quality.outside(["concentration", "recency", "asymmetry"], 0.0, 1.0, "traits in [0, 1]"),
            quality.outside(["peak_period"], first, last, "peak within periods"),
            quality.not_positive(["strong_width", "strong_runs"], "at least one strong run"),
            quality.flag_coherent(
                F.col("ongoing"), F.col("peak_period") >= settings.vintage - 9, "ongoing flag"
            ),
        ),
    ]


def run_trajectories(store: TableStore, settings: Settings) -> dict[str, int]:
    periods, fact = _load(store, "d_annee", "f_naissances")
    with scratch_scope(store.spark):
        tables = trajectory_tables(fact, periods, settings)
        return _export(store, tables, lambda t: trajectory_gate(t, periods))


def trajectory_report(store: TableStore, settings: Settings) -> Tables:
    dim, traits = _load(store, "d_prenom", "traits")
    return {
        "coverage": describe.eligibility_coverage(dim, settings.threshold),
        "distribution": describe.trait_distribution(traits).orderBy("trait"),
        "runs": describe.run_distribution(traits).orderBy("strong_runs"),
        "witnesses": describe.witness_panel(traits, dim, settings.witnesses).orderBy("peak_period"),
    }


# --- archetypes ----------------------------------------------------------------------


def fit(traits: DataFrame, settings: Settings) -> cluster.Archetypes:
    points = cluster.weighted_points(traits, settings.features)
    scale = cluster.fit_scale(points, settings.features)
    return cluster.fit_archetypes(points, scale, settings.groups, settings.restarts, settings.seed)


def archetype_tables(dim: DataFrame, traits: DataFrame, profiles: DataFrame,
                     model: cluster.Archetypes, settings: Settings) -> Tables:
    assignment = cluster.assign(traits, model)
    arch.expose_assignment(assignment)
    return {
        "d_archetype": arch.archetype_dim(dim.sparkSession, settings.labels),
        "prenom_archetype": arch.bridge(dim, assignment),
        "profil_archetype": arch.mean_curve(profiles, assignment),
    }


def archetype_gate(t: Tables, dim: DataFrame) -> list[DataFrame]:
    bridge = t["prenom_archetype"]
    return [quality.same_entities(bridge, dim, ["entity_id"], "every entity has a group")]


def archetype_contract(t: Tables, dim: DataFrame, traits: DataFrame, periods: DataFrame,
                       settings: Settings) -> list[DataFrame]:
    groups, bridge, curves = (t[n] for n in ("d_archetype", "prenom_archetype", "profil_archetype"))
    return [
        quality.unique_key(bridge, ["entity_id"], "bridge key"),
        quality.orphans(bridge, dim, ["entity_id"], "bridge without entity"),
        quality.orphans(bridge, groups, ["archetype"], "bridge without group"),
        quality.label_count(settings.labels, settings.groups, groups, "one label per group"),
        quality.membership(bridge, traits, "group 0 without traits"),
        quality.row_checks(bridge, quality.distance_coherent("distance only where classified")),
        quality.empty_groups(groups, bridge, "no empty group"),
        quality.dense_grid_complete(curves, periods, "curves complete", ["archetype"]),
        quality.sums_to_one(curves, ["archetype"], "mean_share", "curve shares", tolerance=0.05),
    ]


def run_archetypes(store: TableStore, settings: Settings) -> dict[str, int]:
    dim, traits, profiles = _load(store, "d_prenom", "traits", "profil")
    with scratch_scope(store.spark):
        model = fit(traits, settings)
        tables = archetype_tables(dim, traits, profiles, model, settings)
        return _export(store, tables, lambda t: archetype_gate(t, dim))


def archetype_report(store: TableStore, settings: Settings) -> Tables:
    dim, traits, groups, bridge = _load(store, "d_prenom", "traits", "d_archetype", "prenom_archetype")
    model = fit(traits, settings)
    labelled = cluster.assign(cluster.weighted_points(traits, settings.features), model)
    axes = [f"z_{c}" for c in settings.features]
    scores = cluster.stability_by_draw(
        traits, model, ["entity_id"], draws=settings.draws, restarts=settings.restarts, seed=settings.seed
    )
    return {
        "silhouette": cluster.silhouette(cluster.standardise(labelled, model.scale), axes),
        "stability": cluster.stability(scores),
        "composition": describe.group_composition(bridge, groups, traits).orderBy("archetype"),
        "representatives": describe.representatives(bridge, dim).orderBy("archetype"),
    }


# --- geography -----------------------------------------------------------------------


def geography_tables(register: DataFrame, codes: DataFrame, dim: DataFrame) -> Tables:
    fact = materialise(geo.territory_fact(department_rows(register), dim), "territory-fact")
    cells = geo.territory_cells(fact)
    return {
        "f_naissances_dep": fact,
        "f_specificite": geo.location_quotient(cells),
        "d_departement": geo.territory_dim(codes, geo.region_labels(register.sparkSession), cells),
    }


def _named_department_rows(register: DataFrame) -> DataFrame:
    """Buckets of rare names are no entity; a sentinel period would still show up here."""
    return _unfiltered(register, DEPARTMENT).filter(~F.col("prenom").startswith("_"))


def geography_gate(t: Tables, register: DataFrame) -> list[DataFrame]:
    fact, cells, territories = (t[n] for n in ("f_naissances_dep", "f_specificite", "d_departement"))
    return [
        quality.orphans(cells, territories, ["territory"], "cells without territory"),
        quality.margins_agree(cells, "observed", [["territory"], ["entity_id"]], "margins agree"),
        quality.row_checks(cells, quality.not_positive(["observed", "expected"], "cells positive")),
        quality.same_total(fact, "n", cells, "observed", "grain totals agree"),
        quality.same_total(territories, "total", cells, "observed", "territory totals conserved"),
        quality.same_total(
            _named_department_rows(register), "valeur", cells, "observed", "territorial counts conserved"
        ),
        quality.sparsity(cells, "sparsity"),
    ]


def geography_contract(t: Tables, register: DataFrame, dim: DataFrame, periods: DataFrame) -> list[DataFrame]:
    fact, cells, territories = (t[n] for n in ("f_naissances_dep", "f_specificite", "d_departement"))
    national = _unfiltered(register, NATIONAL)
    return [
        quality.unique_key(territories, ["territory"], "d_departement key"),
        quality.distinct_codes(cells, "territory", 101, "101 territories"),
        quality.missing_codes(territories, "territory", ["2A", "2B"], "Corsican codes kept"),
        quality.row_checks(
            territories,
            quality.blank("label", "territory labels"),
            quality.blank("region_label", "region labels"),
            quality.flag_coherent(F.col("overseas"), F.length("territory") == 3, "overseas flag"),
            quality.not_positive(["total"], "territory totals"),
        ),
        quality.unique_key(fact, ["entity_id", "territory", "period"], "f_naissances_dep grain"),
        quality.unique_key(cells, ["entity_id", "territory"], "f_specificite grain"),
        quality.orphans(cells, dim, ["entity_id"], "cells without entity"),
        quality.orphans(territories, cells, ["territory"], "territories without cell"),
        quality.orphans(fact, periods, ["period"], "territorial periods known"),
        quality.less_total(cells, "observed", national, "valeur", "territorial below national"),
        quality.grains_reconcile(fact, "n", cells, "observed", ["entity_id", "territory"], "grains reconcile"),
        quality.row_checks(cells, quality.not_multiple("observed", 5, "territorial multiples of 5")),
        quality.median_index(cells, "median index"),
    ]


def run_geography(store: TableStore, register: DataFrame, codes: DataFrame) -> dict[str, int]:
    (dim,) = _load(store, "d_prenom")
    with scratch_scope(store.spark):
        tables = geography_tables(register, codes, dim)
        return _export(store, tables, lambda t: geography_gate(t, register))


def geography_report(store: TableStore) -> Tables:
    dim, territories, cells = _load(store, "d_prenom", "d_departement", "f_specificite")
    return {
        "coverage": describe.cell_coverage(cells),
        "specificities": describe.top_specificities(cells, dim, territories),
    }


# --- sources -------------------------------------------------------------------------


def run_sources(spark: SparkSession, declared: DataFrame, folder: str, manifest_path: str) -> bool:
    """Measure the landed files and bring the manifest up to date; True if it was written."""
    old = stored_manifest(spark, manifest_path)
    with scratch_scope(spark):
        current = materialise(manifest_entries(fingerprints(spark, folder), declared), "entries")
        require_content(current)
        return save_manifest(upsert_manifest(current, old), manifest_path)


# --- everything ----------------------------------------------------------------------


def check_sources(spark: SparkSession, manifest_path: str, **paths: str) -> None:
    """Compare each source file with the manifest; one it does not list passes, as do all
    sources before there is a manifest."""
    manifest = stored_manifest(spark, manifest_path)
    for name, path in paths.items():
        found = fingerprints(spark, path).withColumn("nom", F.lit(name))
        if found.filter("octets > 0").isEmpty():
            raise FileNotFoundError(f"{name}: no content under {path}")
        require_provenance(provenance_status(found, manifest))


def verify(store: TableStore, register: DataFrame, settings: Settings) -> DataFrame:
    """(check, violations, passed) for every gate and contract check on the exported tables."""
    t = {name: from_contract(name, store.read(name)) for name in TABLES}
    dim, periods = t["d_prenom"], t["d_annee"]
    return quality.report(
        national_gate(t, register)
        + national_contract(t, register, settings)
        + trajectory_gate(t, periods)
        + trajectory_contract(t, dim, settings)
        + archetype_gate(t, dim)
        + archetype_contract(t, dim, t["traits"], periods, settings)
        + geography_gate(t, register)
        + geography_contract(t, register, dim, periods)
    )


def run(spark: SparkSession, register_path: str, codes_path: str, out: str,
        settings: Settings | None = None, manifest_path: str | None = None,
        landing: str | None = None) -> dict[str, int]:
    """All stages in order; returns the rows written per table.

    With ``landing`` the register is first copied there by geographic level, which pays
    when it is too large to be scanned whole for each level.
    """
    settings = settings or Settings()
    if manifest_path:
        check_sources(spark, manifest_path, prenoms=register_path, departements=codes_path)
    store = TableStore(spark, out)
    register, codes = read_register(spark, register_path), read_code_list(spark, codes_path)
    if landing:
        register = land_register(register, landing)
    rows = run_national(store, register)
    rows |= run_trajectories(store, settings)
    rows |= run_archetypes(store, settings)
    rows |= run_geography(store, register, codes)
    return rows
