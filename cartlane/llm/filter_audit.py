"""Filter interaction audit: what five filters remove in every order, from truth-table survival words.

A document fails some of the filters A to E; the failed ones are its mask. Its survival word has one bit for each of the
32 subsets of filters, set where the document survives the whole subset (no failed filter in it). Words are added up by
position: carry-save adders turn three words into a sum word and a carry word until a few words of each weight are
left, and only those are unpacked. The counts of survivors by subset, per part and label, hold all that is asked:
a prefix of an order is a subset, so what a step keeps and removes, its redundant and unique failures and its Shapley
sum are differences of counts.

Filters (whole texts, null as empty; words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive): A under 50 words; B fewer than
65 % distinct words; C more than 5 % capitals A-Z of the code points; D one of ``#$%&*|``; E the text of a row with a
smaller id, anywhere in the table.

Plan: one scan makes narrow rows (id, part, mask, digest) that are written; the smallest id of each digest with copies
and the labels come by joins that deal hot keys out; every task adds up its words by part, and Spark sums the counts.
No text is shuffled.

Defined cases: a null or empty text has no word, fails A only (0 is not under 65 % of 0), and E where a smaller id is
empty too; rows of one id and text are no copies of each other; a null id has no smaller one and makes nothing a copy; a
document counts as good or toxic if any of its label rows says so, and labels with a null id count for none; null and
empty sources are one part; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import left_join_hot, payload, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The word of a mask: bit s is set where mask and subset s have no filter in common.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)
CLASSES = ("all", "good", "toxic")
_CAPITALS, _CONTINUATION, _SYMBOLS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), re.compile(rb"[#$%&*|]")


# --- the scan -----------------------------------------------------------------
def text_mask(text: bytes) -> int:
    """The failed ones of A to D as bits 0 to 3."""
    words, points = text.split(), len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2
            | bool(_SYMBOLS.search(text)) << 3)


def _described(texts: pa.Array) -> pa.Array:
    held = [t.as_py() for t in texts]
    return pa.StructArray.from_arrays([pa.array([text_mask(t) for t in held], pa.int32()),
                                       pa.array([hashlib.sha256(t).digest() for t in held], pa.binary())],
                                      ["mask", "digest"])


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per row: id, part, mask (bits 0 to 4 for A to E)."""
    scanned = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                          F.arrow_udf(_described, "mask int, digest binary")(payload(text)).alias("d"))
    rows = written(scanned.select("id", "part", "d.mask", "d.digest"), "audit-rows")
    owners = rows.groupBy("digest").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    found = left_join_hot(rows, written(owners.where("copies > 1"), "audit-owners"), "digest", "copies")
    copy = F.coalesce(F.col("id") > F.col("owner"), F.lit(False)).cast("int")
    return found.select("id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``masks`` with the flags good and toxic."""
    flags = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Ids are nearly unique; AQE splits a partition of one that is not.
    none = F.lit(False)
    return masks.join(flags, "id", "left").select("part", "mask", F.coalesce("good", none).alias("good"),
                                                  F.coalesce("toxic", none).alias("toxic"))


# --- positional popcounts -------------------------------------------------------
def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set."""
    counts, weight, level = np.zeros(SUBSETS, np.int64), 1, np.asarray(words, np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third:]])
        for word in level:
            counts += weight * ((int(word) >> np.arange(SUBSETS)) & 1)
        level = np.concatenate(carries) if carries else np.empty(0, np.uint32)
        weight *= 2
    return counts


_COUNTS = pa.schema([("part", pa.string()), ("class", pa.int32()), *[(f"s{s}", pa.int64()) for s in range(SUBSETS)]])
_COUNTS_DDL = "part string, class int, " + ", ".join(f"s{s} long" for s in range(SUBSETS))


def _count_words(source) -> Iterator[pa.RecordBatch]:
    """Rows (part, mask, good, toxic) -> survivors by subset for every part and class of the batch."""
    for batch in source:
        parts = batch.column(0).dictionary_encode()
        code = parts.indices.to_numpy(zero_copy_only=False)
        words = WORDS[batch.column(1).to_numpy(zero_copy_only=False)]
        flags = [np.ones(len(words), bool), *(batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))]
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
        names, classes, counts = [], [], []
        for k, name in enumerate(parts.dictionary.to_pylist()):
            own = order[edges[k]:edges[k + 1]]
            for c, flag in enumerate(flags):
                chosen = words[own][flag[own]]
                if len(chosen) or not c:
                    names.append(name)
                    classes.append(c)
                    counts.append(positional_counts(chosen))
        if names:
            table = np.stack(counts).T
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(classes, pa.int32()), *map(pa.array, table)],
                                             schema=_COUNTS)


def survivors(rows: DataFrame) -> DataFrame:
    """Per part: arrays ``all``, ``good`` and ``toxic`` of survivors by subset, from (part, mask, good, toxic)."""
    counted = rows.select("part", "mask", "good", "toxic").mapInArrow(_count_words, _COUNTS_DDL)
    summed = counted.groupBy("part", "class").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(SUBSETS)])
    arrays = summed.select("part", "class", F.array(*[f"s{s}" for s in range(SUBSETS)]).alias("n"))
    none = F.array_repeat(F.lit(0).cast("long"), SUBSETS)
    return arrays.groupBy("part").agg(*[
        F.coalesce(F.max(F.when(F.col("class") == k, F.col("n"))), none).alias(c) for k, c in enumerate(CLASSES)])


# --- the report -----------------------------------------------------------------
def _steps() -> list[dict]:
    """The 600 steps of the 120 orders: the filter's number and the subsets before and after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "f": f, "b": before, "a": after})
            before = after
    return out


def shapley_sum(f: int, n: str = "all") -> Column:
    """What filter ``f`` removes, summed over all orders: each subset without it comes before it in
    ``|S|! (4 - |S|)!`` orders."""
    total, others = F.lit(0).cast("long"), len(FILTERS) - 1
    for s in range(SUBSETS):
        if not s >> f & 1:
            size = s.bit_count()
            orders = factorial(size) * factorial(others - size)
            total = total + (F.col(n)[s] - F.col(n)[s | 1 << f]) * orders
    return total


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the survivors of :func:`survivors`."""
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,f:int,b:int,a:int>>")
    sums = F.array(*[shapley_sum(f) for f in range(len(FILTERS))]).alias("sums")
    rows = counts.select("part", *CLASSES, sums).select("*", F.inline(steps))
    full = SUBSETS - 1
    at = lambda c, s: F.element_at(c, s + 1)
    lost = lambda c: at(c, F.col("b")) - at(c, F.col("a"))
    own = F.expr("shiftleft(1, f)")
    return rows.select(
        "part", "filter_order", "step", at("all", F.col("a")).alias("kept"), lost("all").alias("removed"),
        (F.col("all")[0] - at("all", own) - lost("all")).alias("redundant"),
        (at("all", F.lit(full) - own) - F.col("all")[full]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("sums", F.col("f")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(survivors(labelled(failure_masks(docs, doc_id, text, part), labels)))
