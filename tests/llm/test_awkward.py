"""Training-text queries on empty tables, and on null rows, copies and clashing columns."""

from __future__ import annotations

import pytest

from filigree.llm import catalogue
from tests import awkward

pytestmark = pytest.mark.skipif(not awkward.SOURCE.is_dir(), reason="needs the test tables")


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries(spark, tmp_path, kind):
    d = awkward.write(tmp_path, kind)
    for name, q in catalogue.QUERIES.items():
        n = q(spark, d).count()
        if kind == "empty":
            assert n == 0, name


def test_extra_rows_change_nothing(spark, tmp_path):
    d = awkward.write(tmp_path, "nulls")
    for name in ("p1_found", "p3_found", "p5_found", "p7_found", "p9_found"):
        q = catalogue.QUERIES[name]
        rows = lambda x: {tuple(r) for r in q(spark, x).collect()}
        assert rows(d) == rows(str(awkward.SOURCE)), name
