"""Fixed values that the output tables must carry as they are."""

# Labels of the two group codes.
GROUP_LABELS = [(1, "Masculin"), (2, "Féminin")]

# Fixed value: label of the group that holds unclassified entities.
UNCLASSIFIED = (0, "Non classé")

# The 18 French regions since the 2016 reform (code, label).
REGION_LABELS = [
    ("01", "Guadeloupe"),
    ("02", "Martinique"),
    ("03", "Guyane"),
    ("04", "La Réunion"),
    ("06", "Mayotte"),
    ("11", "Île-de-France"),
    ("24", "Centre-Val de Loire"),
    ("27", "Bourgogne-Franche-Comté"),
    ("28", "Normandie"),
    ("32", "Hauts-de-France"),
    ("44", "Grand Est"),
    ("52", "Pays de la Loire"),
    ("53", "Bretagne"),
    ("75", "Nouvelle-Aquitaine"),
    ("76", "Occitanie"),
    ("84", "Auvergne-Rhône-Alpes"),
    ("93", "Provence-Alpes-Côte d'Azur"),
    ("94", "Corse"),
]

# Entities whose traits are shown at each run.
WITNESSES = [
    "Marie (F)", "Jean (M)", "Camille (M)", "Camille (F)",
    "Kevin (M)", "Louise (F)", "Emma (F)", "Léo (M)",
]

# Literals of the geographic levels in the source.
NATIONAL = "FRANCE"
DEPARTMENT = "DEP"
