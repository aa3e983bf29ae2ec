"""Language-model scores (op3), shards (op4), archives (op7), packing (op8) and the pipeline."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from edge_cases import LONG, NAMES, docs, empty, prose, texts
from test_dedup import brute_components, brute_groups
from tokenizers import Tokenizer

from cartlane.llm import interpolated_lm as L
from cartlane.llm import pu_classifier, quality_rules, splitters, sum_of_squares, warc_chunks
from cartlane.llm.common import ship_package
SF001 = "/root/testdata/sf0.001"

WORDS = P.path("word_bpe_49k.json")


def fold(i, n):
    return zlib.crc32(str(i).encode() if i is not None else b"") % n


# --- op3 --------------------------------------------------------------------
def brute_lm(rows):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    folds = [fold(i, 10) for i, _ in rows]

    def counts(parts):
        one, two = collections.Counter(), collections.Counter()
        for w, f in zip(tokens, folds, strict=True):
            if f in parts:
                one.update(w)
                two.update(zip(["<"] + w, w, strict=False))
        one["<"] = one[None]
        return one, two

    train, kept = counts(range(1, 10)), counts(range(2, 10))
    total = sum(n for w, n in train[0].items() if w != "<")
    total_kept = sum(n for w, n in kept[0].items() if w != "<")
    distinct = len([w for w in train[0] if w != "<" and train[0][w]])
    cells = collections.Counter()
    for w, f in zip(tokens, folds, strict=True):
        if f == 1:
            for v, x in zip(["<"] + w, w, strict=False):
                c = kept[0][v]
                p2, p1 = kept[1][v, x] / max(c, 1) * (distinct + 1), kept[0][x] / max(total_kept, 1) * (distinct + 1)
                cells[tuple(int(y[0]) for y in (L._bucket(np.array([c])), L._ratio_bin(np.array([p2])), L._ratio_bin(np.array([p1]))))] += 1
    weights = L.learn_weights(sorted((*k, n) for k, n in cells.items()))
    out = []
    for (i, _), w, f in zip(rows, tokens, folds, strict=True):
        base = sum(math.log10((train[0][x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        score = 0.0
        for v, x in zip(["<"] + w, w, strict=False):
            c = train[0][v]
            lam = weights[int(L._bucket(np.array([c]))[0])]
            score += math.log10(lam[2] * train[1][v, x] / max(c, 1) + lam[1] * train[0][x] / max(total, 1) + lam[0] / (distinct + 1))
        out.append((i, f == 0, len(w), sum(train[0][x] > 0 for x in w), total, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["edge", "prose"])
def test_scores(spark, case):
    ship_package(spark)
    rows = texts() if case == "edge" else [(k, prose(60, k % 40)) for k in range(120)]
    frame = docs(spark) if case == "edge" else spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, L.score_documents(frame).collect()), key=str)
    for g, w in zip(got, brute_lm(rows), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert L.score_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("range_bytes,fan,levels", [(3000, 2, 1), (1000, 3, 2), (300, 2, 4)])
def test_scores_do_not_depend_on_levels(spark, monkeypatch, range_bytes, fan, levels):
    ship_package(spark)
    rows = [*[(k, prose(60, k % 40)) for k in range(90)], (None, None), (200, ""), (201, "a " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    merged = []
    monkeypatch.setattr(L, "_merge_family", lambda n, merge=L._merge_family: merged.append(n) or merge(n))
    got = sorted(map(tuple, L.score_documents(frame, block_bytes=500, ranges=3, range_bytes=range_bytes, fan=fan).collect()), key=str)
    assert len(merged) >= levels
    for g, w in zip(got, brute_lm(rows), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_rows_between_stages_grow_with_the_input(spark):
    """A block leaves at most ``RANGES`` rows, and so does every family of blocks for each of its blocks."""
    block = pa.table({"payload": [b"one two three", b"two three four"] * 50, "block": [3] * 100})
    for ranges in (1, 64, 4096):
        rows = L._count_block(ranges)(block)
        assert len(rows) <= min(ranges, 5 + 8)  # no row for a range without a key
        keys = np.concatenate([L.unpack_keys(r) for r in rows.column("words").to_pylist()])
        assert len(keys) == 5 and (np.diff(keys.astype(object)) > 0).all()
        assert sum(L.unpack_counts(r).sum() for r in rows.column("word_counts").to_pylist()) == 400
    family = rows.append_column("family", pa.array([0] * len(rows), pa.int64()))
    for r in set(family.column("range").to_pylist()):
        finer = L._merge_family(4096 * 8)(family.filter(pa.compute.equal(family.column("range"), r)))
        assert {x // 8 for x in finer.column("range").to_pylist()} == {r}


def test_weights_follow_the_better_estimate():
    middle = 64 * L.STEP
    weights = L.learn_weights([(3, middle + 80, middle + 8, 900), (3, -1, middle + 8, 100), (5, -1, middle + 40, 500)])
    assert weights.sum(1) == pytest.approx(np.ones(L.BUCKETS)) and weights[3, 2] > 0.8 and weights[5, 1] > 0.9
    assert (weights > 0)[1:].all() and weights[0, 2] == 0


# --- op4 --------------------------------------------------------------------
def shard_facts(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    return {k: sum(r["size"] for r in s) for k, s in by.items()}


def test_shards_are_level(spark):
    ship_package(spark)
    rows = [(k, prose(20 + k % 50, k)) for k in range(900)] + [(5000 + k, "copy of one text " * 8) for k in range(600)]
    got = splitters.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
    sizes = shard_facts(got)
    mean = sum(sizes.values()) / 10
    assert set(sizes) == set(range(10)) and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean


def test_shards_of_edge_cases(spark):
    ship_package(spark)
    got = splitters.shard_documents(docs(spark), shards=4).collect()
    shard_facts(got)
    assert sorted((r["size"] for r in got)) == sorted(len((t or "").encode()) + 16 for _, t in texts())
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert splitters.shard_documents(empty(spark), shards=4).count() == 0


# --- op7 --------------------------------------------------------------------
def pages(spark):
    rows = [(1, "http://a/ü?q=\r\nx", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://c", ""),
            (5, "http://d", LONG), (6, "http://e", "é" * 70_000), (7, "http://f", LONG), (None, "http://g", "no id"),
            (8, "http://h", "WARC/1.1\r\n\r\n\r\n\r\n"), (9, "http://i", "x" * 65_000), (2, None, "<p>one</p>")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_archive_round_trip(spark):
    ship_package(spark)
    rows, frame = pages(spark)
    owners = collections.defaultdict(lambda: None)
    for i, _, h in rows:
        owners[h or ""] = max((x for x in (owners[h or ""], i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        data, owner = (h or "").encode(), owners[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if i == owner else "revisit", None if i == owner else owner))
    archive = warc_chunks.write_archive(frame, chunk=1000)
    assert sorted(map(tuple, warc_chunks.read_archive(archive).collect()), key=str) == sorted(want, key=str)
    assert archive.agg({"chunk": "max"}).first()[0] > 100
    stream = bytearray()
    assert warc_chunks.export(archive, stream.extend) == len(stream)
    assert stream.startswith(b"WARC/1.1\r\nWARC-Type: ") and stream.endswith(b"\r\n\r\n")
    # A plain reader finds the records by their lengths alone.
    at = count = 0
    while at < len(stream):
        head = bytes(stream[at:stream.index(b"\r\n\r\n", at) + 4])
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[15:])
        at, count = at + len(head) + length + 4, count + 1
        assert stream[at - 4:at] == b"\r\n\r\n"
    assert count == len(rows)
    assert warc_chunks.round_trip(frame.where("false")).count() == 0


def test_damage_is_noticed():
    head = warc_chunks.record_head(1, None, 3, warc_chunks.base32_sha1(hashlib.sha1(b"abc").digest()), None, False)
    rows = list(warc_chunks.chunk_rows(0, [head, b"abc", warc_chunks.END], 50))
    assert list(warc_chunks.read_rows(rows))[0][:2] == (1, 3)
    for broken in (rows[:-1], rows[:1] + rows[2:], [(*rows[0][:2], b"X" + rows[0][2][1:], rows[0][3]), *rows[1:]]):
        with pytest.raises(ValueError):
            list(warc_chunks.read_rows(broken))


# --- op8 --------------------------------------------------------------------
def pack_facts(rows, pieces, window):
    library = Tokenizer.from_file(WORDS)
    ids = collections.Counter()
    for i, t in rows:
        ids[i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    expected = collections.Counter(i for i, _ in ids.elements())
    assert {p["doc_id"] for p in pieces} == set(expected)
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for (i, data), n in ids.items():
        own = [p for p in pieces if p["doc_id"] == i and p["doc_tokens"] == len(data) // 4
               and zlib.crc32(data[4 * p["start"]:4 * (p["start"] + p["length"])]) == p["ids_crc32"]]
        assert sum(p["length"] for p in own) == n * len(data) // 4
        if n == 1 and expected[i] == 1:
            at = 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    return 1 - sum(p["length"] for p in pieces) / window / len(windows)


def test_packing(spark):
    ship_package(spark)
    got = sum_of_squares.pack(docs(spark).coalesce(1), WORDS).collect()
    pack_facts(texts(), got, 4096)
    rows = [(k, prose(5 + k * 7 % 300, k)) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert pack_facts(rows, sum_of_squares.pack(frame, WORDS, window=512).collect(), 512) < 0.02
    # With few items held, windows are closed early and everything still lies in one piece.
    assert pack_facts(rows, sum_of_squares.pack(frame, WORDS, window=512, open_items=20).collect(), 512) < 0.1
    assert sum_of_squares.pack(empty(spark), WORDS).count() == 0


def test_sum_of_squares_picks_the_least():
    packer = sum_of_squares.SumOfSquares(10)
    r = np.random.default_rng(1)
    for size in r.integers(1, 11, 500):
        n = packer.levels.copy()
        number, level = packer.place(int(size))
        if size == 10:
            continue

        def after(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 10:
                m[h + size] += 1
            return (m ** 2).sum()

        allowed = [0, *[h for h in range(1, 11 - size) if n[h]]]
        assert level in allowed and after(level) == min(map(after, allowed))


def test_written_shards_hold_every_row(spark, tmp_path):
    """Whole records, also where the input has columns named as the result's."""
    frame = docs(spark).withColumns({"shard": F.lit("mine"), "slot": F.lit(1), "row": F.lit("r")})
    splitters.write_shards(frame, f"{tmp_path}/own", shards=5)
    back = spark.read.parquet(f"{tmp_path}/own")
    assert set(back.columns) == {*frame.columns, "__shard"}
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(back.select(*frame.columns).collect()) == key(frame.collect())
    splitters.write_shards(docs(spark), f"{tmp_path}/plain", shards=5)
    plain = spark.read.parquet(f"{tmp_path}/plain")
    assert set(plain.columns) == {*docs(spark).columns, "shard"} and plain.count() == docs(spark).count()
    want = {(r["doc_id"], r["shard"]) for r in splitters.shard_documents(docs(spark), shards=5).collect()}
    assert {(r["doc_id"], r["shard"]) for r in plain.collect()} == want


def test_ranges_follow_the_bytes(spark, monkeypatch):
    """More ranges than shards ask for give the same law."""
    monkeypatch.setattr(splitters, "RANGE_BYTES", 1000)
    rows = splitters.shard_documents(docs(spark).unionByName(docs(spark)), shards=3).collect()
    assert len(rows) == 2 * docs(spark).count()
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_archive_with_long_urls(spark):
    """A URL over a mebibyte is written and read back."""
    rows = [(1, "http://x/" + "a" * (2 << 20), "<p>one"), (2, "http://x/é" * 70_000, "<p>one"), (3, None, "<p>two")]
    got = warc_chunks.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, "revisit", 2), (2, "response", None), (3, "response", None)]


# --- the pipeline -----------------------------------------------------------
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C

    documents = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    good = {r["doc_id"] for r in pu_classifier.classify(documents, labels).collect() if r["predicted"]}
    good &= {r["doc_id"] for r in quality_rules.judge(documents).collect() if r["kept"]}
    left = [(i, t) for i, t in rows.items() if i in good]
    left = [(i, rows[i]) for i, _, _, kept, _ in brute_groups(left) if kept]
    left = [(i, rows[i]) for i, _, component in brute_components(left) if i == component]
    assert 0.5 * len(rows) < len(left) < len(rows)
    pack_facts(left, C.run(spark, SF001).collect(), 4096)


def test_stages_take_edge_cases(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(1, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for source in (docs, empty):
        for name, stage in C.STAGES[:-1]:
            assert stage(spark, source(spark), str(tmp_path)).columns == [c.split()[0] for c in NAMES.split(", ")], name
    stages, rows = dict(C.STAGES), [(i, t or "") for i, t in texts()]
    ids = lambda name: sorted((r["doc_id"] for r in stages[name](spark, docs(spark), str(tmp_path)).collect()), key=str)
    # Rules: what ``judge`` keeps, by the plain rules of its own test. Copies: one row of each text and of each group.
    assert set(ids("quality_rules")) == {r["doc_id"] for r in quality_rules.judge(docs(spark)).collect() if r["kept"]}
    assert len(ids("exact_dedup")) == len({t for _, t in rows})
    assert ids("ngram_jaccard") == sorted([1, 4, 5, 6, 7, -5, 11, None, 12, 13, 14, 15, 16], key=str)
    packed = stages["packing"](spark, docs(spark), str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows}
    assert sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(r["length"] for r in packed)
    assert stages["packing"](spark, empty(spark), str(tmp_path)).count() == 0


def gaussians(share, n=4000, width=30, seed=1):
    """Vectors of positives, and of unlabelled rows with that share of positives; eight coordinates tell the classes apart."""
    r = np.random.default_rng(seed)
    shift = np.r_[np.ones(8), np.zeros(width - 8)]
    draw = lambda k, sign: r.normal(0, 1, (k, width)) + sign * shift
    mixed = np.concatenate([draw(int(n * share), 1), draw(n - int(n * share), -1)])
    r.shuffle(mixed)
    return draw(n, 1).astype(np.float32), mixed.astype(np.float32)


def test_prior_from_positives_and_unlabelled_text():
    for share in (0.2, 0.5, 0.8, 0.95):
        assert abs(pu_classifier.estimate_prior(*gaussians(share)) - share) < 0.06


def plain_risk(positive, unlabelled, prior, model, decay):
    """The non-negative risk, term by term."""
    w = np.append(model.weights, model.bias).astype(float)
    score = lambda x: ((x - model.mean) * model.scale) @ w[:-1] + w[-1]
    cost = lambda z, y: np.log1p(np.exp(-z if y else z)).mean()
    r_pos, r_unl, r_pos_as_neg = cost(score(positive), 1), cost(score(unlabelled), 0), cost(score(positive), 0)
    return prior * r_pos + max(0.0, r_unl - prior * r_pos_as_neg) + decay / 2 * (w[:-1] ** 2).sum()


def test_fit_minimises_the_plain_risk(monkeypatch):
    monkeypatch.setattr(pu_classifier, "WIDTH", 30)
    positive, unlabelled = gaussians(0.6, n=1500)
    model = pu_classifier.fit_nnpu(positive, unlabelled, 0.6, steps=600, decay=1e-2)
    best, r = plain_risk(positive, unlabelled, 0.6, model, 1e-2), np.random.default_rng(0)
    for _ in range(60):
        other = model._replace(weights=model.weights + r.normal(0, 0.05, 30).astype(np.float32), bias=model.bias + r.normal(0, 0.05))
        assert plain_risk(positive, unlabelled, 0.6, other, 1e-2) > best - 1e-4


def test_label_zero_is_never_read(spark):
    """Without any row of label 0 the scores are the same."""
    ship_package(spark)
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    all_rows = sorted(map(tuple, pu_classifier.classify(documents, labels).collect()))
    assert sorted(map(tuple, pu_classifier.classify(documents, labels.where("quality = 1")).collect())) == all_rows
