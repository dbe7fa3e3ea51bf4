from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govspark.operators.stats import page, page_after


@pytest.fixture(scope="module")
def view(spark):
    """Null and repeated leading values; one value of ``team`` holds half of the rows."""
    teams = [None, "a", "b", "hot", "hot", "hot"]
    rows = [
        (teams[i % 6], datetime(2024, 1, 1) + timedelta(minutes=(i * 7919) % 3000) if i % 11 else None, i)
        for i in range(6000)
    ]
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or datetime.min, r[2])
    df = spark.createDataFrame(rows, "team string, at timestamp, n bigint").repartition(4).cache()
    return df, sorted(rows, key=key)


@pytest.mark.parametrize("number", [1, 2, 9, 40, 60, 61, 500])
def test_pages_at_any_depth(view, number):
    df, want = view
    rows, total = page(df, number, 100, ["team", "at", "n"], max_sorted=150)
    assert [tuple(r) for r in rows.collect()] == want[(number - 1) * 100 : number * 100]
    assert tuple(total.first()) == (6000, 60)


def test_a_page_over_many_equal_keys(spark):
    df = spark.range(3000).select(F.lit("same").alias("k"), "id")
    assert page(df, 20, 100, ["k"], max_sorted=200)[0].count() == 100
    assert page(df.limit(0), 20, 100, ["k"], max_sorted=200)[0].count() == 0


def test_deep_page_sorts_few_rows(view):
    from govspark.operators.stats import _around

    df, _ = view
    near, skip = _around(df, 4321, 50, ["team", "at", "n"], 200)
    assert near.count() <= 250 and skip < 250


def test_page_after_a_row(view):
    df, want = view
    order = ["team", "at", "n"]
    assert [tuple(r) for r in page_after(df, None, 5, order).collect()] == want[:5]
    for place in (0, 89, 90, 1000, 5990):
        assert [tuple(r) for r in page_after(df, want[place], 20, order).collect()] == want[place + 1 : place + 21]
    assert page_after(df, want[-1], 20, order).count() == 0
