import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajecta.functions.labels import (
    accent_table,
    group_suffix,
    is_search_key,
    search_key,
    segment_label,
    title_case,
)

NAMES = [
    # name, display, search
    ("JEAN-PIERRE", "Jean-Pierre", "jean-pierre"),
    ("ÉLIE", "Élie", "elie"),
    ("LÉO", "Léo", "leo"),
    ("ŒIL", "Œil", "œil"),
    ("A--B", "A--B", "a--b"),
    ("ŸANN", "Ÿann", "yann"),
    ("-X-", "-X-", "-x-"),
    ("ßA", "ẞa", "ßa"),
    ("ØRSTED", "Ørsted", "ørsted"),
    ("ΝΙΚΟΣ", "Νικοσ", "νικοσ"),
    ("élan", "Élan", "elan"),
    ("", "", ""),
    (None, None, None),
]


def test_labels(spark):
    df = spark.createDataFrame([(n[0],) for n in NAMES], "name string")
    rows = df.select("name", title_case(F.col("name")), search_key(F.col("name"))).collect()
    assert [tuple(r) for r in rows] == NAMES


def test_search_key_is_its_own_search_key(spark):
    df = spark.createDataFrame([(n[0],) for n in NAMES if n[0]], "name string")
    keys = df.select(search_key(F.col("name")).alias("k"))
    assert keys.filter(~is_search_key(F.col("k"))).count() == 0
    assert df.filter(is_search_key(F.col("name"))).count() == 0 + sum(
        1 for n in NAMES if n[0] and n[0] == n[2]
    )


@pytest.mark.parametrize("block", [(0xC0, 0x24F), (0x370, 0x3FF), (0x1E00, 0x1EFF)])
def test_accents_follow_canonical_decomposition(block):
    source, target = accent_table()
    table = dict(zip(source, target))
    for code in range(*block):
        kept = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c)[0] != "M"]
        assert table.get(chr(code), chr(code)) == unicodedata.normalize("NFC", "".join(kept))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=12), max_size=20))
def test_search_key_has_no_accent_left(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for (key,) in df.select(search_key(F.col("name"))).collect():
        assert not [c for c in unicodedata.normalize("NFD", key) if unicodedata.combining(c)]


def test_segment_label_is_unique(spark):
    rows = [("Camille", True, 1), ("Camille", True, 2), ("Marie", False, 2)]
    df = spark.createDataFrame(rows, "display string, shared boolean, grp smallint")
    label = segment_label(F.col("display"), F.col("shared"), group_suffix(F.col("grp")))
    assert [r[0] for r in df.select(label).collect()] == ["Camille (M)", "Camille (F)", "Marie"]
