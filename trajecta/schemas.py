"""Contract of the exported tables: column names and types a report relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (our column, exported column, exported type) per table, in column order.
TABLES: dict[str, list[tuple[str, str, str]]] = {
    "d_prenom": [
        ("entity_id", "prenom_id", "bigint"),
        ("entity", "prenom", "string"),
        ("display", "prenom_affichage", "string"),
        ("search", "prenom_recherche", "string"),
        ("segment", "libelle_segment", "string"),
        ("shared", "prenom_mixte", "boolean"),
        ("grp", "sexe_code", "smallint"),
        ("total", "naissances_totales", "bigint"),
        ("first_period", "premiere_annee", "smallint"),
        ("last_period", "derniere_annee", "smallint"),
        ("peak_period", "annee_pic", "smallint"),
        ("peak_n", "effectif_pic", "bigint"),
        ("best_rank", "meilleur_rang", "int"),
    ],
    "d_annee": [("period", "annee", "smallint"), ("decade", "decennie", "smallint")],
    "d_sexe": [("grp", "sexe_code", "smallint"), ("label", "sexe_libelle", "string")],
    "f_naissances": [
        ("entity_id", "prenom_id", "bigint"),
        ("period", "annee", "smallint"),
        ("n", "effectif", "bigint"),
        ("rank", "rang_source", "int"),
        ("share", "part_dans_annee_sexe", "double"),
    ],
    "profil": [
        ("entity_id", "prenom_id", "bigint"),
        ("period", "annee", "smallint"),
        ("n", "effectif", "bigint"),
        ("share", "part", "double"),
        ("smooth", "lisse", "double"),
        ("cumulative", "cumul", "double"),
    ],
    "traits": [
        ("entity_id", "prenom_id", "bigint"),
        ("peak_period", "annee_pic", "smallint"),
        ("strong_width", "largeur_forte", "bigint"),
        ("strong_runs", "nb_periodes", "bigint"),
        ("concentration", "concentration", "double"),
        ("recency", "part_apres_2000", "double"),
        ("start_period", "annee_debut", "smallint"),
        ("end_period", "annee_fin", "smallint"),
        ("asymmetry", "asymetrie", "double"),
        ("ongoing", "en_cours", "boolean"),
    ],
    "d_archetype": [
        ("archetype", "archetype_id", "int"),
        ("label", "libelle", "string"),
        ("classified", "classe", "boolean"),
    ],
    "prenom_archetype": [
        ("entity_id", "prenom_id", "bigint"),
        ("archetype", "archetype_id", "int"),
        ("distance", "distance_centre", "double"),
    ],
    "profil_archetype": [
        ("archetype", "archetype_id", "int"),
        ("period", "annee", "smallint"),
        ("mean_share", "part_moyenne", "double"),
    ],
    "d_departement": [
        ("territory", "dep_code", "string"),
        ("label", "dep_libelle", "string"),
        ("region", "region_code", "string"),
        ("region_label", "region_libelle", "string"),
        ("overseas", "est_dom", "boolean"),
        ("total", "naissances_departement", "bigint"),
    ],
    "f_naissances_dep": [
        ("entity_id", "prenom_id", "bigint"),
        ("period", "annee", "smallint"),
        ("territory", "dep_code", "string"),
        ("n", "effectif", "bigint"),
    ],
    "f_specificite": [
        ("entity_id", "prenom_id", "bigint"),
        ("territory", "dep_code", "string"),
        ("observed", "observe", "bigint"),
        ("expected", "attendu", "double"),
    ],
}


def to_contract(table: str, df: DataFrame) -> DataFrame:
    """Exported names and types."""
    return df.select(*[F.col(ours).cast(kind).alias(theirs) for ours, theirs, kind in TABLES[table]])


def from_contract(table: str, df: DataFrame) -> DataFrame:
    """Back to our vocabulary, refusing a table that lost a column."""
    missing = [theirs for _, theirs, _ in TABLES[table] if theirs not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*[F.col(theirs).alias(ours) for ours, theirs, _ in TABLES[table]])
