"""The skew-safe history equals a brute-force per-user LAG, also
for a hot user holding about a third of all events and for ties."""

import random

from pyspark.sql import functions as F

from cartlane.config import CHURN_STEPS
from cartlane.operators import sequences as S
from cartlane.operators.events import label_checkout_events
from cartlane.operators.friction import churn_summary
from cartlane.functions.labels import lag_names
from cartlane.plans.inspect import plan_text

LABELS = ["begin_checkout", "add_shipping_info", "add_payment_info", "add_to_cart", "purchase", "view_item"]


def _random_events(events, seed=7):
    rnd = random.Random(seed)
    users = [f"u{i}" for i in range(12)]
    for _ in range(1200):
        user = "hot" if rnd.random() < 0.35 else rnd.choice(users)
        name = rnd.choice(LABELS) if user != "hot" else rnd.choice(LABELS[:4])
        minute = rnd.randrange(0, 3 * 24 * 60, 7)  # coarse grid -> many ties
        events.add(user, name, minute % (24 * 60), date=f"2024010{5 + minute // (24 * 60)}")
    return events


def _brute(rows, n=5):
    by_user = {}
    for r in rows:
        by_user.setdefault(r["user_pseudo_id"], []).append(r)
    out = {}
    for user, rs in by_user.items():
        rs.sort(key=lambda r: (r["event_us"], r["event_seq"]))
        for i, r in enumerate(rs):
            out[r["event_seq"]] = tuple(rs[i - k]["event_label"] if i - k >= 0 else None for k in range(1, n + 1))
    return out


def _brute_by(rows, keys, n=5):
    return _brute([{**r, "user_pseudo_id": tuple(r[k] for k in keys)} for r in rows], n)


def test_history_matches_brute_force(spark, events):
    lab = label_checkout_events(_random_events(events).norm(spark))
    rows = [r.asDict() for r in lab.collect()]
    names = lag_names(5)
    for keys in ((S.USER,), S.SESSION):
        expected = _brute_by(rows, keys)
        for split in (1_000_000, 100, 20, 6, 1):
            got = {r.event_seq: tuple(r[c] for c in names)
                   for r in S.prior_events(lab, partition_by=keys, split_rows=split).collect()}
            assert got == expected, (keys, split)


def test_all_at_one_timestamp(spark, events):
    for k in range(60):
        events.add("tied", LABELS[k % 4], 5).add("other", LABELS[k % 3], 5)
    lab = label_checkout_events(events.norm(spark))
    expected = _brute([r.asDict() for r in lab.collect()])
    got = {r.event_seq: tuple(r[c] for c in lag_names(5)) for r in S.prior_events(lab, split_rows=10).collect()}
    assert got == expected


def _brute_churners(rows, keys):
    """Rows at the last timestamp of scopes without a purchase, on a checkout step, with their lags."""
    lags, out = _brute_by(rows, keys), []
    for r in rows:
        own = [x for x in rows if all(x[k] == r[k] for k in keys)]
        last = max((x["event_us"] for x in own if x["event_us"] is not None), default=None)
        if last is not None and r["event_us"] == last and r["event_label"] in CHURN_STEPS and not any(
                x["event_label"] == "purchase" for x in own):
            out.append((r["user_pseudo_id"], r["event_date"], r["event_timestamp"], r["event_label"], *lags[r["event_seq"]]))
    return sorted(out, key=repr)


def test_churners_from_tails(spark, events):
    """Tails give what whole histories give, with ties at the last timestamp, and from a split frame too."""
    for k in range(9):
        events.add("tied", CHURN_STEPS[k % 4], 50)
    lab = label_checkout_events(_random_events(events, seed=11).norm(spark))
    rows = [r.asDict() for r in lab.collect()]
    for keys in ((S.USER,), S.SESSION):
        want = _brute_churners(rows, keys)
        assert want
        assert sorted(map(tuple, S.checkout_churners(lab, partition_by=keys).collect()), key=repr) == want
        for split in (None, 50, 3):
            frame = S.history_frame(lab, 5, keys, split).where(S.churn_row_predicate())
            got = frame.select(S.USER, "event_date", "event_timestamp", "event_label", *lag_names(5)).collect()
            assert sorted(map(tuple, got), key=repr) == want


def test_tails_are_shuffled_not_histories(spark, events):
    """The limit stands below the exchange, and a busy user leaves each map task as its last timestamps."""
    for k in range(4000):
        events.add("busy", LABELS[k % 4], k % 1400)
    lab = label_checkout_events(events.norm(spark)).repartition(4)
    for frame in (S.checkout_churners(lab), churn_summary(lab)):
        text = plan_text(frame)
        partial = next(x for x in text.splitlines() if "WindowGroupLimit" in x and "Partial" in x)
        assert "Exchange hashpartitioning(user_pseudo_id" in text[:text.index(partial)].splitlines()[-1]
    parts = {}
    for r in lab.withColumn("_part", F.spark_partition_id()).collect():
        parts.setdefault(r["_part"], []).append(r["event_us"])
    passed = sum(sum(us in set(sorted(set(p))[-6:]) for us in p) for p in parts.values())
    assert passed < 0.1 * sum(map(len, parts.values()))


def test_null_timestamps_and_an_early_event(spark, events):
    """Rows without a timestamp come first, split or not."""
    for k in range(43):
        events.add("hot", LABELS[k % 4], k)
    for k in (5, 17, 30):
        events.rows[k] = (*events.rows[k][:4], None, *events.rows[k][5:])
    lab = label_checkout_events(events.norm(spark))
    whole = sorted(map(tuple, S.history_frame(lab, split_rows=None).collect()), key=repr)
    for split in (1, 3, 10, 20):
        assert sorted(map(tuple, S.history_frame(lab, split_rows=split).collect()), key=repr) == whole, split


def test_splitters_follow_the_rows(spark):
    """One early event moves no slice: the hot user's rows are spread evenly over tasks."""
    us = F.when(F.col("id") == 0, F.lit(1702000000000000)).otherwise(F.lit(1705017600000000) + F.col("id") * 1_000_000)
    raw = spark.range(0, 4001, 1, 8).withColumn("event_us", us).selectExpr(
        "'hot' AS user_pseudo_id", "DATE'2024-01-05' AS event_date", "timestamp_micros(event_us) AS event_timestamp",
        "event_us", "id AS event_seq", "concat('e', id % 7) AS event_label")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frame = S.history_frame(raw, 5, split_rows=200).withColumn("_task", F.spark_partition_id())
        rows = frame.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_task = {}
    for r in rows:
        by_task[r["_task"]] = by_task.get(r["_task"], 0) + 1
    assert len(rows) == 4001 and max(by_task.values()) < 0.2 * len(rows)
    want = [tuple(f"e{(i - k) % 7}" if i >= k else None for k in range(1, 6)) for i in range(4001)]
    assert [tuple(r[c] for c in lag_names(5)) for r in sorted(rows, key=lambda r: r["event_seq"])] == want


def test_hot_user_is_spread_over_tasks(spark, events):
    """The largest task's share of a split user, with all lag columns kept, so that no window is pruned."""
    lab = label_checkout_events(_random_events(events).norm(spark))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frame = S.history_frame(lab, 5, split_rows=40).withColumn("_task", F.spark_partition_id())
        rows = [r for r in frame.collect() if r["user_pseudo_id"] == "hot"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_task = {}
    for r in rows:
        by_task[r["_task"]] = by_task.get(r["_task"], 0) + 1
    assert len(rows) > 300 and max(by_task.values()) < 0.4 * len(rows) and len(by_task) >= 6
