"""Exact dedup (op9) and the n-gram Jaccard join (op6) against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from edge_cases import docs, empty, prose, texts

from cartlane.llm import jaccard_rtree as J
from cartlane.llm import patricia
from cartlane.llm.common import ship_package


def test_trie_holds_what_a_dict_holds():
    r, trie, want = random.Random(1), patricia.PatriciaTrie("smallest"), {}
    for i in range(2000):
        key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 9)))
        trie.insert(key, i)
        owner, n = want.get(key, (i, 0))
        want[key] = (min(owner, i), n + 1)
    assert {k: (o, n) for k, o, n in trie.terminals()} == want


def test_texts_with_a_common_beginning_share_a_path():
    """A thousand texts with ten thousand bytes in common cost little more than their ends."""
    trie, start = patricia.PatriciaTrie(), b"the same long beginning " * 400
    for i in range(1000):
        trie.insert(start + b"%d" % i, i)
    assert trie.bytes < len(start) + 1200 * (patricia.NODE_BYTES + 8)
    assert sum(1 for _ in trie.terminals()) == 1000


def test_subtrees_go_and_come_back():
    """Whatever the budget, taken subtrees and what stays hold every text, and the trie stays near its budget."""
    r = random.Random(4)
    keys = [b"common " * r.randint(0, 3) + bytes(r.choice(b"abc") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    want = collections.Counter(keys)
    for budget in (6_000, 20_000, 200_000, 10_000_000):
        trie, gone, most = patricia.PatriciaTrie("largest", budget), collections.Counter(), 0
        for i, key in enumerate(keys):
            trie.insert(key, i)
            if trie.overfull():
                for k, _, n in trie.take():
                    gone[k] += n
            most = max(most, trie.bytes)
        assert gone + collections.Counter({k: n for k, _, n in trie.terminals()}) == want
        assert most <= 2 * budget
        rows = list(patricia.merge_side("largest", budget)(iter([_partial_batch(keys)])))
        got = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for b in rows for r in b.to_pylist()}
        last = {k: i for i, k in enumerate(keys)}
        assert got == {hashlib.sha256(k).hexdigest(): (last[k], n) for k, n in want.items()}


def _partial_batch(keys):
    return pa.RecordBatch.from_pylist([{"length": len(k), "hash": 0, "payload": k, "owner": i, "n": 1} for i, k in enumerate(keys)],
                                      patricia.PARTIAL)


def brute_groups(rows, better=max):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = better(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    ship_package(spark)
    for keep, better in (("largest", max), ("smallest", min)):
        # With a budget of a few bytes every subtree spills on both sides of the shuffle.
        for budget in (patricia.TRIE_BUDGET, 500):
            got = patricia.exact_groups(docs(spark).repartition(3), keep=keep, budget=budget).collect()
            assert sorted(map(tuple, got), key=str) == brute_groups(texts(), better)
    assert patricia.exact_groups(empty(spark)).count() == 0


def test_exact_keep_documents(spark):
    ship_package(spark)
    kept = patricia.keep_documents(docs(spark))
    assert kept.columns == docs(spark).columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    want = {(k, h) for _, k, _, _, h in brute_groups(texts())}
    assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got if i is not None) == sorted(
        x for x in want if x[0] is not None)
    assert len(got) == len(want)


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            members[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(members[find(i)], default=None) if sets[i] else rows[i][0])
                   for i in range(len(rows))), key=str)


def near_rows():
    """Groups of near copies at many distances, a passage that many share, short texts and copies."""
    r, rows, shared = random.Random(7), [], prose(40, 99)
    for g in range(12):
        words = prose(r.choice([8, 30, 90, 200]), 100 + g).split()
        for _ in range(r.randint(1, 14)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                own[r.randrange(len(own))] = f"edit{r.randrange(1000)}"
            rows.append(" ".join(own))
    rows += [shared + " " + prose(r.randint(3, 60), 500 + k) for k in range(40)]
    # A chain: every text is near the next, the ends are far apart.
    chain = prose(100, 77).split()
    for k in range(30):
        chain[k * 3] = f"link{k}"
        rows.append(" ".join(chain))
    rows += rows[:10]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_components_of_near_copies(spark, monkeypatch):
    ship_package(spark)
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert sorted((tuple(r) for r in J.jaccard_groups(frame).drop("node").collect()), key=str) == want
    # Blocks in many tiles, hubs with several tasks, and a sketch that tells next to nothing.
    monkeypatch.setattr(J, "TILE", 6)
    monkeypatch.setattr(J, "STAR", 2)
    monkeypatch.setattr(J, "SKETCH", 16)
    assert sorted((tuple(r) for r in J.jaccard_groups(frame).drop("node").collect()), key=str) == want


def test_edge_cases_and_kept_rows(spark):
    ship_package(spark)
    got = sorted((tuple(r) for r in J.jaccard_groups(docs(spark)).drop("node").collect()), key=str)
    assert got == brute_components(texts())
    kept = J.keep_documents(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # One row of every component with an id, the one row without an id that links to nothing, all empty texts.
    assert ids == sorted([1, 4, 5, 6, 7, -5, 11, None, 12, 13, 14, 15, 16], key=str)
    assert J.jaccard_groups(empty(spark)).count() == 0 and J.keep_documents(empty(spark)).count() == 0


def test_tree_drops_no_link():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)) for _ in range(60)]
    for k in range(60):
        own = sets[k].copy()
        own[r.integers(0, len(own), r.integers(1, 60))] = r.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    nodes, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    points = np.stack([J.point(s) for s in sets])
    zero = np.zeros(len(sets), np.int64)
    block = J.Block(nodes, sizes, nodes, zero, zero, points, np.zeros((len(sets), J.BEFORE), np.int64))
    found = set(J.block_pairs(block))
    links = {(a, b) for a in nodes for b in nodes if a < b and
             100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - i)}
    assert links and links <= found and len(found) < len(sets) ** 2 / 8


def doubling(a, b, n):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def test_doubling_patterns_of_letters_and_words_differ(spark):
    """Texts of equal letters in patterns that cancel out in sums of powers of one base."""
    ship_package(spark)
    one, two = "".join(doubling("a", "b", 1024)), "".join(doubling("b", "a", 1024))
    rows = [(1, one), (2, two), (3, " ".join(doubling("x", "y", 1024))), (4, " ".join(doubling("y", "x", 1024))), (5, one), (6, one.upper())]
    got = sorted(tuple(r) for r in J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("node").collect())
    assert got == brute_components(rows)
    assert {i: c for i, _, c in got}[2] == 2 and {i: c for i, _, c in got}[6] == 1


def test_sequences_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of two values nearly all nodes clash; the second hash tells the sequences apart."""
    ship_package(spark)
    rows = near_rows()[:90]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    real = J.clashing_nodes
    monkeypatch.setattr(J, "clashing_nodes", lambda d: frozenset(r["c"] for r in d.where("kind = 0 and b > 0 and c % 2 = 0").select("c").distinct().collect()) | real(d))
    assert sorted((tuple(r) for r in J.jaccard_groups(frame).drop("node").collect()), key=str) == brute_components(rows)


def test_clashing_column_names(spark):
    ship_package(spark)
    names = ["__node", "__id", "__spread", "__kept_node", "__kept_id", "__owner_sha"]
    frame = docs(spark)
    for name in names:
        frame = frame.withColumn(name, F.lit("x"))
    kept = J.keep_documents(frame)
    assert kept.columns == frame.columns and kept.count() == J.keep_documents(docs(spark)).count()
    exact = patricia.keep_documents(frame)
    assert exact.columns == frame.columns and exact.count() == patricia.keep_documents(docs(spark)).count()


def test_pairs_come_from_one_block():
    """A pair whose blocks follow each other is given by the first; a place too late for a link gives none."""
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 2**63, 100).astype(np.uint64))
    points, n = np.stack([J.point(keys)] * 2), np.array([len(keys)] * 2)
    nodes, zero = np.array([1, 2]), np.zeros(2, np.int64)
    before = np.zeros((2, J.BEFORE), np.int64)
    assert list(J.block_pairs(J.Block(nodes, n, nodes, zero, zero, points, before))) == [(1, 2)]
    assert not list(J.block_pairs(J.Block(nodes, n, nodes, zero, zero + 15, points, before)))
    before[:, 3] = 77
    assert not list(J.block_pairs(J.Block(nodes, n, nodes, zero, zero, points, before)))
    before[0, 3] = 78
    assert list(J.block_pairs(J.Block(nodes, n, nodes, zero, zero, points, before))) == [(1, 2)]
