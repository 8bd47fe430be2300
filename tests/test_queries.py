"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest
from conftest import same

from verisift import registry

NO_ORACLE = {"append_runs", "sample_story"}  # new ids, and a random pick


def test_every_query_has_an_oracle():
    assert set(registry.queries()) - set(registry.oracle_sql()) == NO_ORACLE


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, duck, sf_dir):
    same(registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf())


def test_entry_guard_names_no_missing_part():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_append_runs_fills_ids(spark, sf_dir):
    rows = registry.queries()["append_runs"](spark, sf_dir)
    assert rows.where("id IS NULL OR created_at IS NULL").count() == 0
    assert rows.select("id").distinct().count() == rows.count()


def test_the_comparison_sees_nulls_and_types():
    import pandas as pd

    one = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    same(one, one.copy())
    for other in ({"a": [1, None], "b": ["x", None]}, {"a": [1, 2], "b": ["x", ""]}, {"a": [1, 3], "b": ["x", None]}, {"a": [1.0, 2.0], "b": ["x", None]}, {"a": pd.array([1, None], "Int64"), "b": ["x", None]}):
        for pair in ((one, pd.DataFrame(other)), (pd.DataFrame(other), one)):
            with pytest.raises(AssertionError):
                same(*pair)
    with pytest.raises(AssertionError):
        same(pd.DataFrame({"a": [0]}), pd.DataFrame({"a": pd.array([None], "Int64")}))
