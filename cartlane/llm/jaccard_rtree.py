"""N-gram Jaccard self-join on a count-vector R-tree, and the groups that its links form.

A document's set are the hashed 5-word shingles. Shingles are hashed once more into ``GROUPS`` groups; the group
counts are the document's point. For two documents the overlap is at most the sum of the coordinates' minima, so an
R-tree whose nodes keep the largest count of every group beneath them drops whole subtrees that cannot reach the
overlap a link needs; what survives is verified on the full shingle sets.

Points of all documents in one tree would have to meet in one task, so blocks come first, and lose no link: with
shingles in one global order, two linked sets share one of their first ``n - ceil(0.8 n) + 1`` shingles. Documents that
share such a shingle are a block; blocks with the same members are one. The order puts frequent shingles last: a sketch
of fixed size holds, for each of ``SKETCH`` hash values, the logarithm of the largest number of documents that a
shingle there has. Any order is exact; this one keeps blocks small. Then:

1. Stars. In each block the document with the most block places is the hub; a document is verified against the hub
   that it shares most blocks with, if their points allow a link. Groups of near copies, small or very large, become one
   label this way, with one pair per document.
2. Trees. Blocks that still hold two labels get an R-tree over their points, which gives the pairs of different
   label that the bound allows. A pair is left out where the shingles after this one are too few for a link (``1 + min(n -
   place - 1)`` of both must reach the overlap), and where one of the last ``BEFORE`` blocks of both is the same: that
   block gives the pair. The others are verified. Blocks over ``TILE`` documents are cut into tiles, each with the
   pairs of two parts, so that no task holds more than two parts.
3. Components of all verified links.

Copies (equal word sequences) are one node throughout, so they cost one row each. A node is a 64-bit hash of the
sequence; a second hash beside it shows where two sequences have one, and such sequences are known by the second.
Shingles are 64-bit hashes.

Defined cases: a text without words has no shingle, links with nothing (not even with another empty one) and is its
own component; a text of fewer than five words has one shingle, the whole sequence; a null id is no component's
smallest id unless all its ids are null; repeated rows share a component; an empty table gives an empty result; other columns of the
input, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlane.llm.common import BATCH_BYTES, batches, hidden, left_join_hot, payload, written
from cartlane.llm.components import components
from cartlane.llm.words import sequence_digest, word_hashes

SHINGLE, PERCENT = 5, 80
GROUPS, LEAF = 128, 16
#: Documents of a block that one tree takes, and members verified in one task for a hub.
TILE, STAR = 4096, 1000
#: A shingle is counted from so many documents of one slice of the scan; entries of the sketch of counts.
SLICE, FREQUENT, SKETCH = 4_000_000, 2, 1 << 20
#: Earlier blocks that a document carries in a block.
BEFORE = 16


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a text's word hashes, sorted."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(out)]
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (value.as_py() for value in column)


def needed(a, b):
    """The least overlap of linked sets of a and b elements: 100 i >= 80 (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def point(keys: np.ndarray) -> np.ndarray:
    """Group counts; a count past 65,534 is kept as 65,535 and read as unbounded."""
    counts = np.bincount((keys >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 65_535).astype(np.uint16)


# --- scans ------------------------------------------------------------------
def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _describe(source) -> Iterator[pa.RecordBatch]:
    """(id, payload) -> rows (kind 0: id, n, node, check) of every document and (kind 1: shingle, documents) of the
    frequent shingles of each slice. Documents also have their point."""
    names, seen, held, size = ["kind", "a", "b", "c", "d", "point"], set(), [], 0

    def frequent():
        keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64),) * 2
        keys, n = keys[n >= FREQUENT], n[n >= FREQUENT]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(_signed(keys)),
                                           pa.array(n.astype(np.int64)), *[pa.nulls(len(keys), pa.int64())] * 2,
                                           pa.nulls(len(keys), pa.binary())], names)

    for batch in source:
        n, nodes, checks, points = [], [], [], []
        for words in word_hashes(_texts(batch.column(1))):
            keys, (node, check) = shingles(words), sequence_digest(words)
            n.append(len(keys))
            nodes.append(node)
            checks.append(check)
            points.append(point(keys).tobytes())
            if node not in seen:
                seen.add(node)
                held.append(keys)
                size += len(keys)
            if size >= SLICE:
                yield frequent()
                seen, held, size = set(), [], 0
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), batch.column(0), pa.array(n, pa.int64()),
                                          pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()),
                                          pa.array(points, pa.binary())], names)
    yield frequent()


def _node(words: np.ndarray, clashes: frozenset[int]) -> int:
    node, check = sequence_digest(words)
    return check if node in clashes else node


def _prefixes(sketch: np.ndarray, clashes: frozenset[int]):
    """For mapInArrow over payloads: (shingle, node, n, place, rank) of every text's first shingles by rank (the
    sketch's entry) and hash."""
    shift = np.uint64(64 - (len(sketch) - 1).bit_length())

    def postings(source) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in source:
            rows, held = [], 0
            for words in word_hashes(_texts(batch.column(0))):
                node = _node(words, clashes)
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                own = shingles(words)
                n = len(own)
                if not n:
                    continue
                rank = sketch[(own >> shift).astype(np.int64)]
                # Shingles come sorted, so a stable sort by rank is the order of (rank, hash).
                first = np.argsort(rank, kind="stable")[:n + (-PERCENT * n // 100) + 1]
                rows.append((own[first], np.full(len(first), node, np.int64), np.full(len(first), n, np.int32),
                             np.arange(len(first), dtype=np.int32), rank[first].astype(np.int32)))
                held += 28 * len(first)
                if held > BATCH_BYTES:
                    yield _posting_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _posting_batch(rows)

    return postings


def _posting_batch(rows) -> pa.RecordBatch:
    shingle, *others = (np.concatenate(c) for c in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(_signed(shingle)), *map(pa.array, others)], ["shingle", "node", "n", "place", "rank"])


def _node_column(clashes: frozenset[int]):
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([_node(w, clashes) for w in word_hashes(_texts(texts))], pa.int64())

    return F.arrow_udf(column, "long")


def sketch_of(frequent: DataFrame) -> np.ndarray:
    """For each of ``SKETCH`` hash values the logarithm of the most documents of a shingle there; ``frequent`` has
    (shingle a, documents b) of slices. The driver gets at most ``SKETCH`` small rows."""
    shift = 64 - (SKETCH - 1).bit_length()
    counts = frequent.groupBy("a").agg(F.sum("b").alias("n"))
    entries = counts.groupBy(F.shiftrightunsigned("a", shift).cast("int").alias("at")).agg(
        F.floor(F.log2(F.max("n"))).cast("byte").alias("rank")).toArrow()
    out = np.zeros(SKETCH, np.uint8)
    out[entries["at"].to_numpy()] = entries["rank"].to_numpy()
    return out


def clashing_nodes(described: DataFrame) -> frozenset[int]:
    """Nodes that two different sequences have: none, or a few among very many documents."""
    checks = described.where("kind = 0 and b > 0").groupBy("c").agg(F.min("d").alias("l"), F.max("d").alias("h"))
    return frozenset(r["c"] for r in checks.where("l <> h").select("c").collect())


def _allowed(left: pa.Array, right: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    """Whether the bound of two points reaches the overlap that a link needs."""
    a, b = (_unbounded(np.frombuffer(b"".join(_texts(x)), np.uint16).reshape(-1, GROUPS)) for x in (left, right))
    sizes = n.to_numpy(zero_copy_only=False).astype(np.int64) + m.to_numpy(zero_copy_only=False)
    return pa.array(np.minimum(a, b).sum(1) >= needed(sizes, 0))


def _unbounded(points: np.ndarray) -> np.ndarray:
    return np.where(points == 65_535, 1 << 30, points.astype(np.int64))


# --- the tree ---------------------------------------------------------------
class CountVectorTree:
    """Points packed by size and by their most scattered coordinates; each level keeps the largest count of every
    group and the least size beneath its nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        points = _unbounded(points)
        spread = np.argsort(points.std(0))[-4:]
        self.order = np.lexsort((*points[:, spread].T, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][0]) > LEAF:
            corners, least = self.levels[-1]
            cuts = np.arange(0, len(corners), LEAF)
            self.levels.append((np.maximum.reduceat(corners, cuts), np.minimum.reduceat(least, cuts)))

    def search(self, at: int) -> np.ndarray:
        """Original numbers of the points that may link with point ``at`` (in tree order)."""
        q, n = self.points[at], int(self.sizes[at])
        found = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
                found = found[found < len(corners)]
            bound = np.minimum(corners[found], q).sum(1)
            # A partner of a set of n elements has at least ceil(0.8 n).
            fewest = np.maximum(least[found], -(-PERCENT * n // 100))
            found = found[bound >= needed(n, fewest)]
        return self.order[found]


class Block(NamedTuple):
    """A block's members: node, set size, label, side, the place of its shingle, points and earlier blocks (0: none)."""

    nodes: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    sides: np.ndarray
    places: np.ndarray
    points: np.ndarray
    before: np.ndarray


def block_pairs(block: Block, across: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of nodes of different label that the bounds allow and no earlier block gives; ``across``: only pairs of
    two sides."""
    nodes, sizes, labels, sides, places, points, before = block
    tree, rest = CountVectorTree(points, sizes), sizes - places
    for at, i in enumerate(tree.order):
        hits = tree.search(at)
        hits = hits[(nodes[hits] > nodes[i]) & (labels[hits] != labels[i])]
        if across:
            hits = hits[sides[hits] != sides[i]]
        # The shared shingles are this one and some of those after it, or the pair is an earlier block's.
        hits = hits[np.minimum(rest[hits], rest[i]) >= needed(sizes[hits] + sizes[i], 0)]
        own = before[i][before[i] != 0]
        if len(own) and len(hits):
            hits = hits[~np.isin(before[hits], own).any(1)]
        for j in hits:
            yield int(nodes[i]), int(nodes[j])


def _tree_pairs(source) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, node, n, label, side, place, before, point) sorted by (block, i, j) -> candidates (a, b)."""

    def runs():
        held, key = [], None
        for batch in source:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)]
            arrays = [np.frombuffer(b"".join(_texts(batch.column(c))), kind).reshape(len(batch), width)
                      for c, kind, width in ((9, np.uint16, GROUPS), (8, np.int64, BEFORE))] if len(batch) else []
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            edges = [0, *change.tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                this = tuple(int(c[a]) for c in columns[:3])
                if this != key and held:
                    yield key, held
                    held = []
                key = this
                held.append([c[a:b] for c in (*columns[3:], *arrays)])
        if held:
            yield key, held

    def pairs():
        for (_, i, j), held in runs():
            block = Block(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield from block_pairs(block._replace(sizes=block.sizes.astype(np.int64)), i != j)

    return batches(pairs(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _packed(lists: pa.Array) -> pa.Array:
    """Lists of up to ``BEFORE`` numbers as bytes of one length, padded by 0."""
    return pa.array([np.array((v + [0] * BEFORE)[:BEFORE], np.int64).tobytes() for v in lists.to_pylist()], pa.binary())


# --- verification -----------------------------------------------------------
def _verify(source) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, payload) sorted so that a's own row (b null) comes before its partners: the linked pairs."""

    def links():
        key, own = None, None
        for batch in source:
            rows = zip(*(batch.column(c).to_pylist() for c in range(3)), word_hashes(_texts(batch.column(3))), strict=True)
            for a, salt, b, words in rows:
                if b is None:
                    key, own = (a, salt), shingles(words)
                    continue
                if key != (a, salt):
                    raise ValueError(f"the text of node {a} is missing")
                other = shingles(words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(other) - both):
                    yield a, b

    return batches(links(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


class Nodes:
    """The distinct word sequences: node, n, point and the smallest id of a row that has it."""

    def __init__(self, docs: DataFrame, described: DataFrame, text: str, ids: str, clashes: frozenset[int]):
        least = F.lit(-(1 << 63))
        rows = described.where("kind = 0 and b > 0")
        self.table = written(rows.groupBy(F.col("c").alias("node")).agg(
            F.min(F.coalesce("a", least)).alias("id"), F.first("b").cast("int").alias("n"), F.first("point").alias("point")), "nodes")
        named = docs.select(F.coalesce(F.col(ids).cast("long"), least).alias("id"), payload(text).alias("payload"))
        self.rows = named.withColumn("node", _node_column(clashes)("payload"))

    def texts(self, pairs: DataFrame) -> DataFrame:
        """The texts of the nodes in ``pairs(a, b)``, one for each node."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        first = self.table.select("id", "node").join(wanted, "node", "left_semi")
        chosen = self.rows.join(first, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
        return written(chosen.select("node", "payload"), "texts")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that their points allow."""
        a, b = (self.table.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "point")]) for side in "ab")
        both = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
        allowed = F.arrow_udf(_allowed, "boolean")("a_point", "b_point", "a_n", "b_n")
        return both.where(allowed).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs(a, b)``. A node's partners come to it, at most ``STAR`` to a task."""
        texts = self.texts(pairs)
        sums = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
        salted = pairs.join(sums, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
        partners = salted.join(texts.select(F.col("node").alias("b"), "payload"), "b").select("a", "salt", "b", "payload")
        # Only the salts that occur: a node without partners in one of them sends no text there.
        own = salted.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), "payload"), "a").select(
            "a", "salt", F.lit(None).cast("long").alias("b"), "payload")
        dealt = partners.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return written(dealt.mapInArrow(_verify, "a long, b long"), "links")


# --- the join ---------------------------------------------------------------
def _unsigned(c: str):
    """Orders signed numbers as the unsigned ones that they stand for."""
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def _near_sizes(a: str, b: str):
    return (F.greatest(a, b) * PERCENT) <= (F.least(a, b) * 100)


def node_links(docs: DataFrame, text: str, described: DataFrame, ids: str, clashes: frozenset[int]) -> DataFrame:
    """Verified links (a, b) between nodes, enough of them to connect all that is linked."""
    nodes = Nodes(docs, described, text, ids, clashes)
    sketch = sketch_of(described.where("kind = 1"))
    postings = docs.select(payload(text)).mapInArrow(_prefixes(sketch, clashes), "shingle long, node long, n int, place int, rank int")
    distinct = postings.repartition("shingle").dropDuplicates(["shingle", "node"])
    shared = distinct.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("members > 1")
    shared = written(shared, "shared")
    # Blocks with equal members are one, the first in the order; members are compared by two 64-bit sums.
    lists = shared.groupBy("shingle").agg(
        F.first("members").alias("m"), F.first("rank").alias("rank"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = lists.groupBy("m", "x", "y").agg(F.min(F.struct("rank", _unsigned("shingle"), "shingle")).alias("f")).select("f.shingle")
    places = shared.groupBy("node").agg(F.count(F.lit(1)).alias("places"))
    blocks = written(shared.join(kept, "shingle", "left_semi").join(places, "node"), "blocks")

    # Stars.
    hubs = blocks.groupBy("shingle").agg(F.max(F.struct("places", "node", F.col("n").alias("hub_n"))).alias("hub"))
    star = blocks.join(hubs, "shingle").where(F.col("node") != F.col("hub.node")).where(_near_sizes("n", "hub.hub_n"))
    star = star.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
    star = star.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best"))
    star = written(nodes.bounded(star.select(F.col("best.hub").alias("a"), F.col("node").alias("b"))), "stars")
    starred = nodes.verified(star)

    # Trees in the blocks that still hold two labels. A hub keeps its own label.
    hub_nodes = starred.select(F.col("a").alias("b")).distinct()
    labels = starred.join(hub_nodes, "b", "left_anti").select(F.col("b").alias("node"), F.col("a").alias("hub"))
    labelled = blocks.join(labels, "node", "left").select("shingle", "rank", "place", "node", "n", F.coalesce("hub", "node").alias("label"))
    labelled = written(labelled, "labelled")
    sizes = labelled.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("m"))
    mixed = sizes.where("l <> h").select("shingle", F.ceil(F.col("m") / (TILE // 2)).cast("int").alias("parts"), "m")
    mixed = mixed.withColumn("parts", F.when(F.col("m") > TILE, F.col("parts")).otherwise(1)).drop("m")
    rows = labelled.join(mixed, "shingle")
    # The blocks of the document before this one, in the global order.
    earlier = Window.partitionBy("node").orderBy("rank", _unsigned("shingle")).rowsBetween(-BEFORE, -1)
    rows = rows.withColumn("before", F.arrow_udf(_packed, "binary")(F.collect_list("shingle").over(earlier)))
    side = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("shingle", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "n",
                       "label", "side", "place", "before")
    rows = rows.join(nodes.table.select("node", "point"), "node").select(
        "shingle", "i", "j", "node", "n", "label", "side", "place", "before", "point")
    dealt = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    pairs = written(dealt.mapInArrow(_tree_pairs, "a long, b long").distinct(), "pairs")
    return starred.unionByName(nodes.verified(pairs))


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, node (the word sequence's hash)."""
    return _grouped(docs, doc_id, text)[0]


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, frozenset[int]]:
    bare = docs.select(F.col(doc_id).cast("long"), payload(text))
    described = written(bare.mapInArrow(_describe, "kind int, a long, b long, c long, d long, point binary"), "described")
    clashes = clashing_nodes(described)
    if clashes:
        described = described.withColumn("c", F.when(F.col("c").isin(*clashes), F.col("d")).otherwise(F.col("c")))
    links = node_links(docs, text, described, doc_id, clashes)
    rows = described.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select("node", "copies", "component_id"), "components")
    found = left_join_hot(rows, named, "node", "copies")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), "node"), clashes


def keep_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, that with the smallest id, with all its columns; texts without words all stay."""
    node, ident, spread, kept_node, kept_id = (hidden(docs, x) for x in ("node", "id", "spread", "kept_node", "kept_id"))
    found, clashes = _grouped(docs, doc_id, text)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
    least = F.lit(-(1 << 63))
    kept = kept.select(F.col("node").alias(kept_node), F.coalesce("doc_id", least).alias(kept_id))
    empty = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     ")) == ""
    marked = docs.withColumns({node: _node_column(clashes)(payload(text)),
                               ident: F.coalesce(F.col(doc_id).cast("long"), least),
                               spread: F.when(empty, F.monotonically_increasing_id()).otherwise(F.lit(-1))})
    full = marked.where(F.col(spread) == -1).join(
        kept, (F.col(node) == F.col(kept_node)) & (F.col(ident) == F.col(kept_id)), "left_semi")
    chosen = full.dropDuplicates([node, ident]).unionByName(marked.where(F.col(spread) != -1))
    return chosen.drop(node, ident, spread)
