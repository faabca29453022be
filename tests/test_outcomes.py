"""Registered queries whose data must reach every branch of what they check."""

import pytest

from quarry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, column, outcomes", [
    ("f4_rich_symbols", "kind", {"function", "type", "method", "class", "variable", "struct"}),
    ("f29_rich_drift", "modified", {True, False}),
    ("d2_overtime_lines", "factor", {1.0, 0.9, 0.75, 0.5, 0.0}),
    ("r1_changed_snapshot", "status", {"added", "removed", "modified", "same"}),
    ("a7_listed_directories", "small", {True, False}),
])
def test_every_outcome_occurs(spark, name, column, outcomes):
    assert {r[column] for r in QUERIES[name](spark, SF).select(column).distinct().collect()} == outcomes


def test_names_of_invalid_syntax_are_read(spark):
    names = {r.symbol for r in QUERIES["f4_rich_symbols"](spark, SF).collect()}
    assert any(n.startswith("broken") for n in names) and any(n.startswith("Odd") for n in names) and "grow" in names


def test_keywords_are_found(spark):
    ratios = {r.ratio for r in QUERIES["f34_cited_keywords"](spark, SF).collect()}
    assert 0.0 in ratios and 1.0 in ratios
