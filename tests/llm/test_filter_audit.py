"""Filter interaction audit (op13) against a plain simulation of every order."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
from edge_cases import NAMES, docs, empty, prose, texts

from cartlane.llm import filter_audit as A
from cartlane.llm.common import ship_package

LABELS = "doc_id long, quality int, toxic int, mask int, part string"


def brute(rows, labels):
    """rows (doc_id, text, part): {(part, order, step): the seven counts}."""
    facts = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and min(same) < i}
        own = [x for x in labels if x[0] == i and i is not None]
        facts.append((part or "", fails, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                hit = [x for x in left if x[1][f]]
                kept = [x for x in left if not x[1][f]]
                failing = [x for x in mine if x[1][f]]
                out[part, order, step] = [len(kept), len(hit), len(failing) - len(hit),
                                          sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in hit), sum(x[3] for x in hit)]
                removed_by[f] += len(hit)
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_audit_matches_simulation(spark):
    ship_package(spark)
    extra = ["Upper CASE Words " * 30, "fine " + prose(90, 5), "50 % off & more " + prose(70, 6), prose(60, 7) + " |"]
    rows = [(i, t, ("a", "b", None, "")[k % 4]) for k, (i, t) in enumerate(texts() * 2)]
    rows += [(100 + k, t, "a") for k, t in enumerate(extra * 3)]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (2, 0, 1), (101, 1, 1), (None, 1, 1), (7, None, 1), (100, 1, 0), (105, 1, 0)]
    frame = spark.createDataFrame([(i, t, None, "x", 1, None, True, "t", None, "p", s) for i, t, s in rows], NAMES + ", source string")
    known = spark.createDataFrame([(*x, 0, "z") for x in labels], LABELS)
    for n in (1, 5):
        got = A.audit(frame.repartition(n), known).collect()
        assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == brute(rows, labels)
        assert len(got) == 3 * 600


def test_defined_cases(spark):
    ship_package(spark)
    none = spark.createDataFrame([], LABELS)
    assert A.audit(empty(spark).withColumnRenamed("lang", "source"), none).count() == 0
    got = A.audit(docs(spark).withColumnRenamed("lang", "source"), none).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)


def test_positional_counts():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 7, 100, 1001):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [(int(((words >> np.uint32(k)) & 1).sum())) for k in range(32)]
        assert A.positional_counts(words).tolist() == want
    # A word has a bit for each subset that the document survives.
    assert [m for m in range(32) if A.WORDS[m] >> 31 & 1] == [0] and A.WORDS[0] == (1 << 32) - 1
    assert all((A.WORDS[m] >> s & 1) == (not m & s) for m in range(32) for s in range(32))


def test_text_mask():
    cases = {"": 1, "ok " * 50: 2, "É" * 3: 1, " ".join(f"w{k}" for k in range(50)): 0, " ".join(f"W{k}" for k in range(50)): 4,
             " ".join(f"w{k}" for k in range(50)) + " a&b": 8, "\x1c".join(["a"] * 60): 1}
    assert {t: A.text_mask(t.encode()) for t in cases} == cases
