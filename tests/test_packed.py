"""Packed sequence keys: any labels and any dictionary give the same groups as the strings; the shuffle is narrower."""

import itertools

import pytest
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS
from cartlane.functions.labels import lag_names
from cartlane.functions.packed import KEY, OTHER, bits_of, pack, unpack
from cartlane.operators import sequences as S
from cartlane.plans.catalog import CATALOG, labeled
from cartlane.plans.inspect import plan_text
from conftest import SF001

LABELS = ("purchase", "begin_checkout", "Payment Method", "never heard of", "", None)


def _rows(spark, n=2):
    rows = [(f"u{i % 7}", *labels) for i, labels in enumerate(itertools.product(LABELS, repeat=n + 1))] * 2
    schema = ", ".join(f"{c} string" for c in (S.USER, S.LABEL, *lag_names(n)))
    return spark.createDataFrame(rows, schema)


def _plain(rows, n):
    return rows.groupBy(F.col(S.LABEL).alias("event"), *lag_names(n)).agg(
        F.count(F.lit(1)).alias("sequences"), F.countDistinct(S.USER).alias("users"))


@pytest.mark.parametrize("dictionary", [DEFAULTS.checkout.labels, ("purchase",), (), tuple(f"x{i}" for i in range(1 << 16)[:200]),
                                        ("", "never heard of", *DEFAULTS.checkout.labels)],
                         ids=["default", "one", "none", "strange", "all"])
def test_groups_equal_those_of_strings(spark, dictionary):
    rows = _rows(spark)
    got = S.group_sequences(rows, S.LABEL, "event", 2, dictionary=dictionary)
    want = _plain(rows, 2)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_dictionary_too_large_for_the_sequence(spark):
    """Six labels of 11 bits do not fit 63: all sequences go as their labels."""
    dictionary = tuple(f"label {i}" for i in range(1500))
    assert bits_of(6, dictionary) == 0 and bits_of(5, dictionary) == 11 and bits_of(6, DEFAULTS.checkout.labels) == 5
    rows = _rows(spark, 1).select(S.USER, S.LABEL, *[F.col("one_event_before").alias(c) for c in lag_names(5)])
    got = S.group_sequences(rows, S.LABEL, "event", 5, dictionary=dictionary)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, _plain(rows, 5).collect()), key=repr)


def test_last_number_and_last_place(spark):
    """The highest number in every place, where the sign bit is nearest."""
    for n, count in ((9, 127), (7, 511), (3, (1 << 10) - 1)):
        dictionary = tuple(f"l{i}" for i in range(count))
        names = [f"c{i}" for i in range(n)]
        assert bits_of(n, dictionary) * n <= 63
        row = spark.range(1).select(*[F.lit(dictionary[-1]).alias(c) for c in names])
        packed = row.select(*pack([F.col(c) for c in names], dictionary))
        assert packed.first()[KEY] >= 0 and packed.first()[OTHER] is None
        assert tuple(packed.select(*unpack(names, dictionary)).first()) == (dictionary[-1],) * n


def _shuffled_bytes(df):
    """Bytes that the topmost exchange wrote, by Spark's own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().executedPlan()
    while plan.nodeName() != "Exchange":
        # A stage hides its plan.
        plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.children().head()
    return plan.metrics().apply("dataSize").value()


def test_half_the_shuffle_bytes(spark):
    events = labeled(spark, SF001)
    seq = S.prior_events(events).where(F.col(S.LABEL) == "purchase")
    packed = _shuffled_bytes(S.group_sequences(seq, S.LABEL, "current_event"))
    plain = _shuffled_bytes(_plain(seq, 5))
    assert 0 < packed * 2 < plain


@pytest.mark.parametrize("name", ["completer_sequences", "churner_sequences", "friction_segments"])
def test_no_string_key_and_no_sort_in_the_group_by(spark, name):
    text = plan_text(CATALOG[name](spark, SF001))
    above = text.split("Window [")[0].split("Generate inline(array")[-1]
    assert "SortAggregate" not in text
    assert "_key" in above and "hashpartitioning(event_label" not in text
