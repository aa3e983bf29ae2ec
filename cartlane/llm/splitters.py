"""Sharding by sampled splitters: shards of near-equal bytes.

1. Rows get a key: the 64-bit hash of the text, then the id. Equal texts are neighbours in key order, and a group of
   copies of any size can still be cut, because the id is part of the key.
2. Records larger than 1 / (``HEAVY`` x shards) of all bytes, of which there are fewer than ``HEAVY`` x shards, are
   dealt first, the largest to the emptiest shard. What is left of each shard is its quota.
3. From the rest a size-weighted sample is drawn (a row of w bytes with probability w x draws / total, by a hash of
   its key, so the same rows on every run). Quantiles of the sample split the key space into ranges.
4. The exact bytes of every range are counted. A range over ``OVERFULL`` times its share is subdivided: a new sample
   is drawn within it, until none is overfull or the range is one key.
5. Rows are dealt by range; each range is sorted by key on its own and running sums give every row its exact place
   in the global order. The place picks the shard by the cumulated quotas, and the slot.

The driver sees samples and range totals, never rows: ``DRAWS`` keys and one total for each range, of which there are
``RANGES`` a shard, or one for every ``RANGE_BYTES`` where that is more (25,000 at 100 TB). So no task holds more than a
small part of a shard.

Defined cases: a null text has no bytes and the size ``EXTRA``; a null id sorts first; repeated rows get slots of
their own; an empty table gives an empty result; other columns of the input are carried along, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlane.llm.common import hidden, payload, written

EXTRA = 16
#: Ranges for each shard, draws for each range, and times its share from which a range is subdivided.
RANGES, DRAWS, OVERFULL = 16, 8, 2.0
#: The most bytes of records that a range is meant for: beyond them there are more ranges, so one fits a task at any size.
RANGE_BYTES = 4 << 30
#: A record over 1 / (HEAVY x shards) of all bytes is dealt by itself.
HEAVY = 50
LEAST = -(1 << 63)


def _range_of(keys: np.ndarray, ids: np.ndarray):
    """Arrow function (key, id) -> number of splitters that are not greater."""

    @F.arrow_udf("int")
    def place(key: pa.Array, ident: pa.Array) -> pa.Array:
        k, i = key.to_numpy(zero_copy_only=False), ident.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for at in np.unique(low[low < high]):  # the key of one or more splitters: the id decides
            rows = (low == at) & (low < high)
            end = int(high[rows][0])
            low[rows] = at + np.searchsorted(ids[at:end], i[rows], "right")
        return pa.array(low.astype(np.int32))

    return place


def _draw(rows: DataFrame, rate: Column, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with probability ``__size x rate``, sorted. A row is drawn or not by a hash of its key."""
    u = F.pmod(F.xxhash64("__key", "__id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return sorted((r[0], r[1]) for r in rows.where(u < F.col("__size") * rate).select("__key", "__id").collect())


def _ranges(rows: DataFrame, total: int, ranges: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``rows`` with ``__range``, and the bytes and rows of every range."""
    share = total / ranges
    drawn = _draw(rows, F.lit(ranges * DRAWS / total), 0)
    splitters = sorted({drawn[len(drawn) * q // ranges] for q in range(1, ranges)}) if drawn else []
    for seed in range(1, 6):
        keys, ids = (np.array([s[x] for s in splitters], np.int64) for x in (0, 1))
        placed = rows.withColumn("__range", _range_of(keys, ids)("__key", "__id"))
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("__range").agg(
            F.sum("__size"), F.count(F.lit(1))).collect()}
        over = [r for r, (size, n) in sums.items() if size > OVERFULL * share and n > 1]
        if not over:
            break
        # The same rate again inside the overfull ranges alone, from other draws.
        more = _draw(placed.where(F.col("__range").isin(over)), F.lit(ranges * DRAWS / total), seed)
        grown = sorted({*splitters, *more[DRAWS // 2::DRAWS // 2]})
        if grown == splitters:
            break
        splitters = grown
    return placed, sums


def _quotas(heavy: list[int], rest: int, shards: int) -> tuple[list[int], list[float]]:
    """Shards of the heavy records (largest first), and what each shard takes of the rest so that all end level."""
    heap = [(0, s) for s in range(shards)]
    dealt = []
    for size in heavy:
        filled, s = heapq.heappop(heap)
        dealt.append(s)
        heapq.heappush(heap, (filled + size, s))
    filled = [f for f, _ in sorted(heap, key=lambda x: x[1])]
    level, left = 0.0, float(rest)
    for n, f in enumerate(sorted(filled), 1):  # water-filling: raise the n lowest together
        level = (left + sum(sorted(filled)[:n])) / n
        if n == shards or level <= sorted(filled)[n]:
            break
    return dealt, [max(0.0, level - f) for f in filled]


def assign_shards(rows: DataFrame, size: Column, key: Column, ident: Column, shards: int = 40) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``, whatever their names) with ``shard`` (int) and ``slot`` (long,
    gapless from 0 in every shard)."""
    keyed = written(rows.select(F.struct("*").alias("__row"), size.cast("long").alias("__size"),
                                key.cast("long").alias("__key"),
                                F.coalesce(ident.cast("long"), F.lit(LEAST)).alias("__id")), "keyed")
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    cut = max(total // (HEAVY * shards), 1)
    order = Window.partitionBy("__range").orderBy("__key", "__id")
    large = keyed.where(F.col("__size") > cut)
    heavy = large.select("__size", "__key", "__id").orderBy(F.desc("__size"), "__key", "__id").collect()
    rest = total - sum(r[0] for r in heavy)
    dealt, quota = _quotas([r[0] for r in heavy], rest, shards)
    spark = rows.sparkSession
    # A row of the table may be there twice, so heavy rows are matched by their rank among equal keys.
    again: dict[tuple, int] = {}
    entries, used = [], [0] * shards
    for r, s in zip(heavy, dealt, strict=True):
        again[tuple(r)] = again.get(tuple(r), 0) + 1
        entries.append((*r, again[tuple(r)], s, used[s]))
        used[s] += 1
    plan = spark.createDataFrame(entries, "__size long, __key long, __id long, __nth int, shard int, slot long")
    nth = F.row_number().over(Window.partitionBy("__size", "__key", "__id").orderBy(F.lit(0)))
    first = large.withColumn("__nth", nth).join(
        F.broadcast(plan), ["__size", "__key", "__id", "__nth"]).select("__row", "shard", "slot")

    placed, sums = _ranges(keyed.where(F.col("__size") <= cut), max(rest, 1), max(shards * RANGES, rest // RANGE_BYTES))
    starts, at, count = [], 0, 0
    for r in sorted(sums):
        starts.append((r, at, count))
        at, count = at + sums[r][0], count + sums[r][1]
    offsets = spark.createDataFrame(starts, "__range int, __bytes long, __rows long")
    before = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumns({"__before": before, "__rank": F.row_number().over(order) - 1}).join(
        F.broadcast(offsets), "__range")
    middle = F.col("__bytes") + F.col("__before") + F.col("__size") / 2
    ends = [float(e) for e in np.cumsum(quota)[:-1]]
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle)) if ends else F.lit(0)
    ranked = written(ranked.select("__row", shard.cast("int").alias("shard"),
                                   (F.col("__rows") + F.col("__rank")).alias("__rank")), "ranked")
    heads = {r[0]: r[1] for r in ranked.groupBy("shard").agg(F.min("__rank")).collect()}
    shift = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, used[s] - heads.get(s, 0))])
    second = ranked.select("__row", "shard", (F.col("__rank") + shift[F.col("shard")]).cast("long").alias("slot"))
    return first.unionByName(second).select(F.col("__row").alias("row"), "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    bare = docs.select(F.col(doc_id).alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA).cast("long").alias("size"),
                       F.crc32(payload(text)).alias("text_crc32"), F.xxhash64(payload(text)).alias("text_key"))
    done = assign_shards(bare, F.col("size"), F.col("text_key"), F.col("doc_id"), shards).select("row.*", "shard", "slot")
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write whole records as one folder per shard, named by ``shard`` or, where the input has such a column, by the
    first of ``__shard``, ``__shard_`` ... that it has not. Rows stay in the ranges' tasks, so a shard has several files."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA
    done = assign_shards(docs, size, F.xxhash64(payload(text)), F.col(doc_id), shards)
    name = hidden(docs, "shard") if "shard" in {c.lower() for c in docs.columns} else "shard"
    done.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
