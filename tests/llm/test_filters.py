"""Quality rules (op5) and the positive-unlabelled classifier (op10)."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
from edge_cases import docs, empty, prose, texts

from cartlane.llm import pu_classifier as U
from cartlane.llm import quality_rules as Q
from cartlane.llm.common import ship_package
SF01 = "/root/testdata/sf0.01"


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    r = random.Random(2)
    rows = texts() + [(100 + k, "".join(r.choice(["a ", "b ", "c ", "\n", "# ", "- x\n", "|", "\x0b"]) for _ in range(r.randint(0, 60))))
                      for k in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
           for r in Q.judge(frame).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute_measures(t)) for i, t in rows), key=str)
    for r in Q.judge(frame).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])


def test_rules_by_name(spark):
    rules = {r["doc_id"]: r["failed_rules"] for r in Q.judge(docs(spark)).collect() if r["doc_id"] is not None}
    assert "length" in rules[4] and "length" in rules[5] and "symbols" in rules[13] and "repetition" in rules[12]
    one = (Q.Rule("few", "n_words", None, None, 3),)
    assert {r["doc_id"] for r in Q.keep_documents(docs(spark), rules=one).collect()} == {4, 5, 6, 8, 9, 10, -5, None, 13, 16} - {13}
    kept = Q.keep_documents(docs(spark))
    assert kept.columns == docs(spark).columns and Q.keep_documents(empty(spark)).count() == 0


def test_nnpu_finds_junk_without_seeing_it_labelled():
    r = np.random.default_rng(1)
    good = np.stack([U.features(prose(100, k).encode()) for k in range(300)])
    junk = np.stack([U.features((" ".join(["BUY!!"] * 40 + [prose(10, 900 + k)])).encode()) for k in range(80)])
    unlabelled = np.concatenate([good[150:], junk[:50]])
    model = U.fit_nnpu(good[:150], unlabelled[r.permutation(len(unlabelled))], 0.75)
    assert (model.score(good[:150]) > 0.7).mean() > 0.95 and (model.score(junk[50:]) < 0.3).mean() > 0.95


def test_held_out_accuracy(spark):
    ship_package(spark)
    documents, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    scored = U.classify(documents, labels)
    assert scored.count() == documents.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(good) >= 0.98


def test_classifier_edge_cases(spark):
    ship_package(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (7, None, 0), (14, 1, 1), (14, 1, 1), (2, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = U.classify(docs(spark), labels).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in U.classify(docs(spark), none).collect()} == {U.UNTRAINED}
    assert U.classify(empty(spark), labels).count() == 0
    assert U.keep_documents(docs(spark), none).columns == docs(spark).columns
