"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

``P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)``, where the bucket ``b`` is the power of two of
the context's count c(v). Training documents fall into a kept and a deleted part by a hash of the id. The weights of
every bucket are learnt by expectation-maximisation on the deleted part's tokens, with counts of the kept part
alone; the scores use the counts of both.

How the counts travel: documents are dealt into blocks by a hash of id and text (a block lies within one part). A
block's task counts its own words and bigrams, so a frequent word leaves it as one entry, and sends its sorted keys
(64-bit hashes) as compact arrays, cut into ``RANGES`` key ranges. The task of a key range adds all blocks up and answers
each block with the counts in the order of the block's own keys, so the answer carries no keys. The block's task meets
the answers, finds its keys again and scores its documents.

Where a range would hold more than ``RANGE_BYTES`` of the input, ``FAN`` blocks are first merged, range by range, into
one family, whose ranges are cut into ``FAN`` finer ones; families merge in the same way until the ranges are small
enough. The answers come back the same way. Every such level has at most ``RANGES`` rows a block, so rows grow with the
input (times its logarithm), not with its square; a task holds a block, ``FAN`` pieces of a range, or one fine range,
and a word that every block has reaches the last task once a family. Levels never change a result.

What the driver sees is bounded: totals, and a histogram of the deleted part (buckets x ratio bins), on which
the expectation-maximisation runs; ratios are taken at the middle of bins of 1/8 of a power of two.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token. The first token's context is the
beginning, whose count is the number of documents. Two words are one where their 64-bit hashes agree.

Defined cases: a null or empty text is the end token alone; texts are read whole; repeated rows count as often as
they occur; a null id counts as the empty text in the folds; without training documents every count is 0 and the
model is uniform over V + 1 = 1 tokens; an empty table gives an empty result; other columns of the input, whatever
their names, are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import crc_mod, payload, written
from cartlane.llm.words import word_hashes

#: Bytes of text in a block, and the fewest blocks.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 24
#: Key ranges that a block is cut into, bytes of the input whose keys one range may hold, and how many blocks merge.
RANGES, RANGE_BYTES, FAN = 64, 32 << 20, 64
FOLDS, DELETED_FOLD = 10, 1
BUCKETS, STEP, ROUNDS = 24, 8, 60
KEPT, DELETED, HELD = 0, 1, 2
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

COUNTED = "range int, block long, words binary, word_counts binary, bigrams binary, bigram_counts binary"
ANSWERED = "range int, block long, word_train binary, word_kept binary, bigram_train binary, bigram_kept binary"
TOTALS = "tokens long, kept_tokens long, distinct long"
KINDS = (("words", "word_counts"), ("bigrams", "bigram_counts"))
SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as the byte planes that they need: one byte with the number of planes, then these."""
    planes = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    return bytes([planes]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return out.view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: their number, then their differences."""
    return len(keys).to_bytes(8, "little") + pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data[8:], int.from_bytes(data[:8], "little")), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return len(counts).to_bytes(8, "little") + pack(counts)


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[8:], int.from_bytes(data[:8], "little")).astype(np.int64)


def token_keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in order: the tokens' keys, the bigrams' keys and each text's number of tokens."""
    parts, sizes = [], []
    for words in word_hashes(texts):
        parts += [words, np.array([END])]
        sizes.append(len(words) + 1)
    tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    sizes = np.array(sizes, np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    mixed = (before * np.uint64(0xFF51AFD7ED558CCD)) ^ ((tokens << np.uint64(32)) | (tokens >> np.uint64(32)))
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return tokens, mixed ^ (mixed >> np.uint64(29)), sizes


def _texts(table: pa.Table) -> list:
    return [v.as_py() for v in table.column("payload")]


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal ranges (fewer than 2^32) each key lies in; rises with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _cut(block: int, counts: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> pa.Table:
    """Rows of COUNTED from sorted keys and counts of words and of bigrams: one for every range that has a key."""
    held = [_range_of(keys, ranges) for keys, _ in counts]
    met = np.union1d(*held)
    columns = [pa.array(met, pa.int32()), pa.array([block] * len(met), pa.int64())]
    for (keys, n), own in zip(counts, held, strict=True):
        spans = list(zip(np.searchsorted(own, met), np.searchsorted(own, met, "right"), strict=True))
        columns += [pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()),
                    pa.array([pack_counts(n[a:b]) for a, b in spans], pa.binary())]
    return pa.Table.from_arrays(columns, ["range", "block", "words", "word_counts", "bigrams", "bigram_counts"])


def _count_block(ranges: int):
    def count(table: pa.Table) -> pa.Table:
        tokens, pairs, _ = token_keys(_texts(table))
        return _cut(table.column("block")[0].as_py(), [np.unique(k, return_counts=True) for k in (tokens, pairs)], ranges)

    return count


def _merge_family(ranges: int):
    """One range of a family's blocks as the family's own rows, in finer ranges (``ranges`` of them in all)."""

    def merge(table: pa.Table) -> pa.Table:
        rows, counts = table.to_pylist(), []
        for kind, n in KINDS:
            keys, place = np.unique(np.concatenate([unpack_keys(r[kind]) for r in rows]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.concatenate([unpack_counts(r[n]) for r in rows]))
            counts.append((keys, sums))
        return _cut(rows[0]["family"], counts, ranges)

    return merge


def _hand_down(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """A family's answers in one range, back to its blocks in the order of their keys."""
    rows, found = blocks.to_pylist(), sorted(answers.to_pylist(), key=lambda r: r["range"])
    out = {"range": [r["range"] for r in rows], "block": [r["block"] for r in rows]}
    for (kind, _), stem in zip(KINDS, ("word", "bigram"), strict=True):
        keys = [unpack_keys(r[kind]) for r in rows]
        everything = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        for which in ("train", "kept"):
            packed = [r[f"{stem}_{which}"] for r in found]
            if not all(packed):  # only the deleted part is told the kept part's counts
                out[f"{stem}_{which}"] = [b""] * len(rows)
                continue
            counts = np.concatenate([unpack_counts(p) for p in packed]) if packed else np.empty(0, np.int64)
            out[f"{stem}_{which}"] = [pack_counts(counts[np.searchsorted(everything, k)]) for k in keys]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _add_range(table: pa.Table) -> pa.Table:
    """Sum the blocks' counts of one key range; answer each block in the order of its keys."""
    rows = table.to_pylist()
    answers = [[r["range"], r["block"]] for r in rows]
    totals = []
    for kind, counts in KINDS:
        keys = [unpack_keys(r[kind]) for r in rows]
        everything, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((2, len(everything)), np.int64)
        ends = np.cumsum([len(k) for k in keys])
        places = np.split(place, ends[:-1])
        for r, p in zip(rows, places, strict=True):
            if (part := r["block"] % 3) != HELD:
                sums[part, p] += unpack_counts(r[counts])  # a block's keys are distinct
        train = sums.sum(0)
        for a, r, p in zip(answers, rows, places, strict=True):
            a += [pack_counts(train[p]), pack_counts(sums[KEPT, p]) if r["block"] % 3 == DELETED else b""]
        totals.append((int(train.sum()), int(sums[KEPT].sum()), int((train > 0).sum())))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 3]
    names = ["range", "block", "word_train", "word_kept", "bigram_train", "bigram_kept", "tokens", "kept_tokens",
             "distinct"]
    done = [(*a, *totals[0]) for a in answers]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)


class _Block(NamedTuple):
    """A block's documents with the counts of each token: own, of the bigram, of the context."""

    sizes: np.ndarray
    word: np.ndarray
    bigram: np.ndarray
    context: np.ndarray


def _look_up(docs: pa.Table, answers: pa.Table, which: str) -> _Block:
    tokens, pairs, sizes = token_keys(_texts(docs))
    rows = sorted(answers.to_pylist(), key=lambda r: r["range"])
    join = lambda name: np.concatenate([unpack_counts(r[f"{name}_{which}"]) for r in rows])
    words, place = np.unique(tokens, return_inverse=True)
    counts = join("word")
    word = counts[place]
    _, place = np.unique(pairs, return_inverse=True)
    bigram = join("bigram")[place]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    # As many texts begin as end.
    context[np.cumsum(sizes) - sizes] = counts[np.searchsorted(words, END)]
    return _Block(sizes, word, bigram, context)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0: the context was never met; else 1 + the power of two of its count, at most ``BUCKETS`` - 1."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _ratio_bin(ratio: np.ndarray) -> np.ndarray:
    """-1 for 0, else the ratio's power of two in steps of 1 / STEP, from 0 up."""
    with np.errstate(divide="ignore"):
        log = np.floor(np.log2(ratio) * STEP)
    return np.where(ratio > 0, np.clip(log, -64 * STEP, 64 * STEP) + 64 * STEP, -1).astype(np.int32)


def _deleted_histogram(kept_tokens: int, distinct: int):
    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not (len(docs) and len(answers)):
            return pa.table({k: pa.array([], t) for k, t in HISTOGRAM})
        b = _look_up(docs, answers, "kept")
        two = b.bigram / np.maximum(b.context, 1) * (distinct + 1)
        one = b.word / max(kept_tokens, 1) * (distinct + 1)
        cells, n = np.unique(np.stack([_bucket(b.context), _ratio_bin(two), _ratio_bin(one)]), axis=1, return_counts=True)
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(HISTOGRAM, [*cells, n], strict=True)})

    return count


HISTOGRAM = (("bucket", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("n", pa.int64()))


def learn_weights(cells: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, [uniform, unigram, bigram]) by expectation-maximisation on (bucket, two, one, n) cells. A
    bucket that the deleted part never meets takes the weights of the nearest one below that it does."""
    weights = np.tile([0.2, 0.4, 0.4], (BUCKETS, 1))
    weights[0] = [0.5, 0.5, 0]
    table = np.array(cells, np.float64).reshape(-1, 4)
    value = lambda b: np.where(b < 0, 0, 2 ** ((b - 64 * STEP + 0.5) / STEP))
    learnt = np.zeros(BUCKETS, bool)
    for b in range(BUCKETS):
        rows = table[table[:, 0] == b]
        if not len(rows):
            continue
        # In units of the uniform estimate; a context that was never met has no bigram estimate.
        p = np.stack([np.ones(len(rows)), value(rows[:, 2]), value(rows[:, 1]) if b else np.zeros(len(rows))], 1)
        w = weights[b]
        for _ in range(rounds):
            share = p * w
            share *= (rows[:, 3] / share.sum(1))[:, None]
            w = share.sum(0) / share.sum()
        # No weight goes to zero for want of an example, so every token keeps a probability.
        w = np.maximum(w, [1e-6, 1e-6, 1e-6 if b else 0])
        weights[b], learnt[b] = w / w.sum(), True
    for b in range(1, BUCKETS):
        if not learnt[b] and learnt[1:b].any():
            weights[b] = weights[b - 1]
    return weights


def _score(tokens: int, distinct: int, weights: np.ndarray):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not (len(docs) and len(answers)):
            sizes = known = base = model = np.empty(0)
        else:
            b = _look_up(docs, answers, "train")
            w = weights[_bucket(b.context)]
            p = (w[:, 2] * b.bigram / np.maximum(b.context, 1) + w[:, 1] * b.word / max(tokens, 1)
                 + w[:, 0] / (distinct + 1))
            sums = lambda x: np.add.reduceat(x, np.cumsum(b.sizes) - b.sizes)
            sizes, known, model = b.sizes, sums((b.word > 0).astype(np.int64)), sums(np.log10(p))
            base = sums(np.log10((b.word + 0.1) / (tokens + 0.1 * (distinct + 1))))
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * len(docs), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(model, pa.float64())})

    return score


def _answers(counted: DataFrame, size: int, ranges: int, range_bytes: int, fan: int) -> tuple[DataFrame, tuple[int, ...]]:
    """Each block's answers, and the totals: training tokens, kept tokens, distinct training words."""
    levels = []
    while ranges * range_bytes < size:
        # Blocks of a family lie within one part, which block % 3 goes on naming.
        rows = written(counted, "counts").withColumn("family", F.expr(f"block div 3 div {fan} * 3 + block % 3"))
        levels.append(rows)
        ranges *= fan
        counted = rows.groupBy("range", "family").applyInArrow(_merge_family(ranges), COUNTED)
    answers = written(counted.groupBy("range").applyInArrow(_add_range, f"{ANSWERED}, {TOTALS}"), "answers")
    names = ("tokens", "kept_tokens", "distinct")
    totals = answers.groupBy("range").agg(*[F.first(c).alias(c) for c in names]).agg(*[F.sum(c) for c in names]).first()
    answers = answers.drop(*names)
    for rows in reversed(levels):
        found = answers.groupBy((F.col("range") / fan).cast("int").alias("_range"), F.col("block").alias("_family"))
        answers = written(rows.groupBy("range", "family").cogroup(found).applyInArrow(_hand_down, ANSWERED), "answers")
    return answers, tuple(x or 0 for x in totals)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    block_bytes: int = BLOCK_BYTES, ranges: int = RANGES, range_bytes: int = RANGE_BYTES,
                    fan: int = FAN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The sizes never change a result."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // block_bytes))
    fold = crc_mod(doc_id, FOLDS)
    part = F.when(fold == 0, HELD).when(fold == DELETED_FOLD, DELETED).otherwise(KEPT)
    # Blocks of each part in proportion to its tenths; block % 3 names the part.
    share = F.when(fold <= DELETED_FOLD, max(1, blocks // FOLDS)).otherwise(max(1, blocks * (FOLDS - 2) // FOLDS))
    dealt = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), share) * 3 + part
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), payload(text).alias("payload"),
                       dealt.cast("long").alias("block"))
    counted = rows.groupBy("block").applyInArrow(_count_block(ranges), COUNTED)
    answers, (tokens, kept, distinct) = _answers(counted, size, ranges, range_bytes, fan)

    deleted = F.col("block") % 3 == DELETED
    asked = lambda which: answers.select("range", "block", f"word_{which}", f"bigram_{which}")
    cells = rows.where(deleted).groupBy("block").cogroup(asked("kept").where(deleted).groupBy("block")).applyInArrow(
        _deleted_histogram(kept, distinct), "bucket int, two int, one int, n long")
    cells = cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(sorted(tuple(c) for c in cells))
    scored = rows.groupBy("block").cogroup(asked("train").groupBy("block")).applyInArrow(
        _score(tokens, distinct, weights), SCORED)
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
