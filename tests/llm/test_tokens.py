"""Byte-level BPE (op1) and prefix token counts (op2) against the libraries."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from edge_cases import docs, empty, texts
from tokenizers import Tokenizer

from cartlane.llm import byte_bpe, prefix_counts
from cartlane.llm.common import ship_package

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_is_the_librarys(spark, library, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(byte_bpe, "FOLD_BYTES", 64)  # some words take the heap
    rows = docs(spark).select("doc_id", "text")
    native = byte_bpe.digests(byte_bpe.encode_native(rows, RANKS, known_words=20), RANKS)
    got = sorted(map(tuple, byte_bpe.round_trip(docs(spark), RANKS).collect()), key=str)
    assert got == sorted(map(tuple, native.collect()), key=str)
    want = []
    for i, t in texts():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip(empty(spark), RANKS).count() == 0


def test_heap_and_fold_agree_with_the_library(library):
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}
    r = random.Random(3)
    for _ in range(300):
        word = "".join(r.choice("aeinrst") for _ in range(r.randint(1, 90)))
        assert byte_bpe.heap_merge(word.encode(), ranks) == library.encode_ordinary(word)
        assert byte_bpe.coder(RANKS).encode(word) == library.encode_ordinary(word)


def test_java_classes_split_every_code_point_as_the_library(spark, library):
    points = [cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000]
    r = random.Random(5)
    # The split shows in the ids: a letter joins the letters before it, a number the numbers.
    chosen = [chr(cp) for cp in r.sample(points, 3000)]
    rows = spark.createDataFrame([(c, f"ab{c}12{c} {c}!") for c in chosen], "c string, text string")
    encoder = byte_bpe.NativeEncoder(RANKS)
    from pyspark.sql import functions as F
    import regex
    pattern = regex.compile(P.PATTERN)
    for row in rows.select("text", encoder.words(F.col("text")).alias("w")).collect():
        assert row["w"] == pattern.findall(row["text"]), ascii(row["text"])


def test_prefix_counts_are_exact_at_every_prefix():
    library, counter = Tokenizer.from_file(JSON), prefix_counts.PrefixCounter(JSON)
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'ll", "'s", " the", "12", "!", "...", "é", "日本", "😀", "ñ", "\xa0",
             "<|endoftext|>", "----------------", "ࡰ", "\x1c"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == want, text
        assert counter.total(text) == want[-1]
        budget = r.randint(0, 6)
        assert counter.longest_within(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_counts_of_documents(spark):
    ship_package(spark)
    library = Tokenizer.from_file(JSON)
    got = sorted(map(tuple, prefix_counts.token_counts(docs(spark), JSON, limit=100).collect()), key=str)
    counts = [(i, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()]
    assert got == sorted(((i, len(t.encode()), n, n > 100) for i, t, n in counts), key=str)
    assert prefix_counts.token_counts(empty(spark), JSON).count() == 0
    cut = {r["doc_id"]: r["text"] for r in prefix_counts.truncated(docs(spark), JSON, 3).collect()}
    assert cut[8] == "a b c" and cut[4] is None and cut[5] == ""
    assert len(library.encode(cut[1], add_special_tokens=False).ids) <= 3
    table = {r["doc_id"]: r["prefix_tokens"] for r in prefix_counts.prefix_table(docs(spark), JSON).collect()}
    assert table[8] == [len(library.encode("a b c"[:i], add_special_tokens=False).ids) for i in range(6)]
