"""A user-clustered table: same results as from the events, no exchange for ordinary users, hot users over many buckets."""

import pytest
from pyspark.sql import functions as F

from cartlane.config import DEFAULTS
from cartlane.operators import facts, friction, sequences as S
from cartlane.operators.events import label_checkout_events, normalize_events
from cartlane.plans.catalog import CATALOG, normalized
from cartlane.session import shared_dir
from cartlane.plans.inspect import plan_stats, plan_text
from cartlane.sources import by_user, clustered_history, read_clustered, write_clustered
from conftest import SF001
from test_history_store import REPORTS
from test_skew import _hot_raw


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "events")
    assert write_clustered(normalized(spark, SF001), path, buckets=5) == 0
    return read_clustered(spark, path)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A user with a third of all rows."""
    path = str(tmp_path_factory.mktemp("clustered") / "hot")
    events = normalize_events(_hot_raw(spark, 30000))
    assert write_clustered(events, path, buckets=6, most_rows=1000) == 1
    return events, path


@pytest.mark.parametrize("operator", [facts.user_day_facts, facts.purchase_revenue_user_day,
                                      lambda e: facts.user_day_facts(e, paired=True)], ids=["facts", "revenue", "paired"])
def test_facts_without_an_exchange(spark, table, operator):
    df = by_user(table, operator)
    assert _rows(df) == _rows(operator(normalized(spark, SF001)))
    stats = plan_stats(df)
    assert stats["exchanges"] == 0 and stats["scans"] == 1


def test_history_without_an_exchange(spark, table):
    history = clustered_history(table)
    assert _rows(S.prior_events(history)) == _rows(CATALOG["prior_event_sequence"](spark, SF001))
    assert plan_stats(history)["exchanges"] == 0
    sessions = clustered_history(table, partition_by=S.SESSION)
    assert plan_stats(sessions)["exchanges"] == 0
    got = friction.friction_segments(sessions, aov=DEFAULTS.aov, partition_by=S.SESSION)
    assert _rows(got) == _rows(CATALOG["friction_segments_session"](spark, SF001))


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_from_the_clustered_history(spark, table, name):
    got = REPORTS[name](clustered_history(table))
    assert _rows(got) == _rows(CATALOG[name](spark, SF001))


def test_buckets_are_sorted_files(spark, table):
    files = table.ordinary.select(F.input_file_name().alias("f"), S.USER).groupBy(S.USER).agg(F.countDistinct("f").alias("n"))
    assert files.where("n > 1").count() == 0
    assert table.ordinary.select(F.input_file_name()).distinct().count() == 5


def test_a_hot_user_lies_in_many_buckets(spark, hot):
    events, path = hot
    found = read_clustered(spark, path)
    assert found.ordinary.where(f"{S.USER} = 'hot'").count() == 0
    sizes = [r["count"] for r in found.hot.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 10000 and len(sizes) == 6 and max(sizes) < 5000
    want = _rows(facts.user_day_facts(events))
    df = by_user(found, facts.user_day_facts)
    assert _rows(df) == want
    # The hot part alone is shuffled, after a partial aggregate.
    assert "partial_min" in plan_text(df)
    assert plan_stats(facts.user_day_facts(found.ordinary))["exchanges"] == 0


@pytest.mark.parametrize("split_rows", [300, 1_000_000])
def test_history_of_a_hot_user(spark, hot, split_rows):
    events, path = hot
    history = clustered_history(read_clustered(spark, path), split_rows=split_rows)
    want = S.prior_events(label_checkout_events(events), split_rows=None)
    assert _rows(S.prior_events(history)) == _rows(want)
    got = friction.churn_summary(history)
    assert _rows(got) == _rows(friction.churn_summary(label_checkout_events(events)))


def test_a_new_session_reads_the_folder(spark, hot):
    _, path = hot
    other = spark.newSession()
    for row in spark.sql("SHOW TABLES LIKE 'clustered_*'").collect():
        spark.sql(f"DROP TABLE {row['tableName']}")  # external: the files stay
    found = read_clustered(other, path)
    assert found.ordinary.count() + found.hot.count() == 30000
    assert plan_stats(facts.user_day_facts(found.ordinary))["exchanges"] == 0


def test_unfinished_or_written_folders_are_refused(spark, tmp_path, hot):
    events, path = hot
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_clustered(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="already|ALREADY"):
        write_clustered(events, path, buckets=6)
    assert read_clustered(spark, path).ordinary.count() == 20000


def test_empty_events(spark, tmp_path):
    path = str(tmp_path / "empty")
    assert write_clustered(normalized(spark, SF001).limit(0), path, buckets=3) == 0
    table = read_clustered(spark, path)
    assert by_user(table, facts.user_day_facts).count() == 0 and clustered_history(table).count() == 0
    with pytest.raises(ValueError, match="scope"):
        clustered_history(table, partition_by=("event_date",))


def test_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, **held):
            self.held = held

        def get(self, key, default=None):
            return self.held.get(key, default)

    class Session:
        def __init__(self, **held):
            self.conf = Conf(**held)

    with pytest.raises(ValueError, match="shared folder"):
        shared_dir(Session(**{"spark.master": "spark://somewhere:7077"}))
    assert shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
