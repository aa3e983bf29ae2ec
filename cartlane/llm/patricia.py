"""Exact deduplication with Patricia-trie owners.

A task inserts whole texts, byte by byte, into one compressed radix trie: texts with a common beginning share its path,
and equal texts end in one terminal node, which stores the owner (the largest or smallest id) and the number of rows.
Equality is decided by the bytes along the path. Tries are built twice: in the tasks that read the table, so that a
group of copies leaves each of them as one row, and after a shuffle by (length, content hash), where the owners of
equal texts meet; the hash only deals texts out. Rows find the owner of their text by its SHA-256.

Memory is bounded by ``budget``: over it, subtrees go, from the place in the trie where they are largest, until a
quarter of the budget is free. A reading task hands their terminals to the shuffle early. A merging task writes them to
a temporary file of its own, to which later texts of these subtrees go as well, and merges the file when its input
ends. What cannot go, a path that all texts share or a single text, may exceed the budget.

Defined cases: a null text counts as empty and empty texts are equal to each other; a null id is smaller than any
id, so it owns a group only where all of its ids are null; rows that repeat an id and a text count in
``group_size``, and ``keep_documents`` keeps one of them; an empty table gives an empty result; other columns of
the input, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import batches, hidden, left_join_hot, payload, written

#: Bytes of strings that the trie of one task holds before a subtree goes.
TRIE_BUDGET = 96 << 20
#: What a node costs beside its label.
NODE_BYTES = 400

PARTIAL = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("payload", pa.binary()), ("owner", pa.int64()),
                     ("n", pa.int64())])
OWNERS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _better(a: int | None, b: int | None, keep: str) -> int | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if keep == "largest" else min(a, b)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie of byte strings. A node is [terminal, edges, sink]; a terminal is [owner, rows]; edges map
    a first byte to [label, node]; the sink of a subtree that went takes its later entries (key, owner, rows)."""

    def __init__(self, keep: str = "largest", budget: int = TRIE_BUDGET):
        self.keep, self.root, self.bytes = keep, [None, {}, None], 0
        self.budget = self.limit = budget

    def insert(self, key: bytes, owner: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key) and node[2] is None:
            edge = node[1].get(key[at])
            if edge is None:
                child = [None, {}, None]
                node[1][key[at]] = [key[at:], child]
                self.bytes += len(key) - at + NODE_BYTES
                node = child
                break
            label = edge[0]
            if key.startswith(label, at):
                at, node = at + len(label), edge[1]
                continue
            n = _shared(label, key[at:at + len(label)])
            middle = [None, {label[n]: [label[n:], edge[1]]}, None]
            edge[:] = [label[:n], middle]
            self.bytes += NODE_BYTES
            at, node = at + n, middle
        if node[2] is not None:
            node[2](key, owner, rows)
        elif node[0] is None:
            node[0] = [owner, rows]
        else:
            node[0] = [_better(node[0][0], owner, self.keep), node[0][1] + rows]

    def terminals(self, prefix: bytes = b"", node: list | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(prefix, self.root if node is None else node)]
        while stack:
            prefix, node = stack.pop()
            if node[0] is not None:
                yield prefix, *node[0]
            stack += [(prefix + label, child) for label, child in node[1].values()]

    def overfull(self) -> bool:
        return self.bytes > self.limit

    def _sizes(self) -> tuple[dict[int, int], set[int]]:
        """Bytes of every subtree, by the node's id, and the nodes with a sink in their subtree."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [child for _, child in node[1].values()]
        sizes: dict[int, int] = {}
        cut: set[int] = set()
        for node in reversed(order):
            sizes[id(node)] = sum(len(label) + NODE_BYTES + sizes[id(child)] for label, child in node[1].values())
            if node[2] is not None or any(id(child) in cut for _, child in node[1].values()):
                cut.add(id(node))
        return sizes, cut

    def take(self, sink=None) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove the largest subtrees of at most half the budget and give their terminals; ``sink`` gets what is
        inserted there later. One such subtree stays, so what was taken is less than the whole."""
        (sizes, cut), found, stack = self._sizes(), [], [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for edge in node[1].values():
                label, child = edge
                weight = len(label) + NODE_BYTES + sizes[id(child)]
                if child[2] is not None:
                    continue
                # A subtree around a sink stays, so that a text has one place.
                if (weight > self.budget // 2 or id(child) in cut) and child[1]:
                    stack.append((prefix + label, child))
                else:
                    found.append((weight, prefix + label, node, edge))
        found.sort(key=lambda f: -f[0])
        freed, gone = 0, []
        for weight, path, node, edge in found[:-1]:
            if freed >= self.budget // 4:
                break
            freed += weight
            gone.append((path, edge[1]))
            if sink is None:
                del node[1][edge[0][0]]
            else:
                edge[1] = [None, {}, sink]
                freed -= len(edge[0]) + NODE_BYTES
        self.bytes -= freed
        # Where little can go, the next try waits until a quarter of the budget has come.
        self.limit = self.budget if freed >= self.budget // 8 else self.bytes + self.budget // 4
        for path, child in gone:
            yield from self.terminals(path, child)


def _partial(entry: tuple[bytes, int | None, int]) -> tuple:
    text, owner, n = entry
    mark = hashlib.blake2b(text, digest_size=8).digest()
    return len(text), int.from_bytes(mark, "big", signed=True), text, owner, n


def read_side(keep: str, budget: int):
    """For mapInArrow over (id, payload): the terminals of the task's trie."""

    def entries(source):
        trie = PatriciaTrie(keep, budget)
        for batch in source:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.insert(value.as_py(), i)
                if trie.overfull():
                    yield from trie.take()
        yield from trie.terminals()

    return lambda source: batches(map(_partial, entries(source)), PARTIAL, weigh=lambda r: len(r[2]) + 40)


def merge_side(keep: str, budget: int):
    """For mapInArrow over rows of ``PARTIAL`` dealt by (length, hash): one row for each different text."""

    def merged(entries):
        trie, files = PatriciaTrie(keep, budget), []
        try:
            for key, owner, n in entries:
                trie.insert(key, owner, n)
                if trie.overfull():
                    files.append(file := tempfile.TemporaryFile())
                    sink = _sink(file)
                    for entry in trie.take(sink):
                        sink(*entry)
            yield from trie.terminals()
            del trie
            for file in files:
                file.seek(0)
                yield from merged(_unpickled(file))
                file.close()
        finally:
            for file in files:
                file.close()

    def received(source):
        for batch in source:
            for value, owner, n in zip(batch.column("payload"), *(batch.column(c).to_pylist() for c in ("owner", "n")), strict=True):
                yield value.as_py(), owner, n

    def rows(source):
        for text, owner, n in merged(received(source)):
            yield hashlib.sha256(text).hexdigest(), owner, n

    return lambda source: batches(rows(source), OWNERS)


def _sink(file):
    return lambda key, owner, n: pickle.dump((key, owner, n), file)


def _unpickled(file):
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def text_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
                budget: int = TRIE_BUDGET) -> DataFrame:
    """One row for each different text: text_sha256, keep_id (its owner) and group_size (its rows)."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    pairs = docs.select(F.col(doc_id).cast("long"), payload(text))
    partial = pairs.mapInArrow(read_side(keep, budget), "length long, hash long, payload binary, owner long, n long")
    return partial.repartition("length", "hash").mapInArrow(
        merge_side(keep, budget), "text_sha256 string, keep_id long, group_size long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
                 budget: int = TRIE_BUDGET) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    owners = written(text_owners(docs, doc_id, text, keep, budget), "owners")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(payload(text), 256).alias("text_sha256"))
    found = left_join_hot(rows, owners, "text_sha256", "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256")


def keep_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The owners' rows with all their columns, one for each different text. Rows are dealt by (id, content), so a
    group of copies is spread, and only the owner's rows find a partner."""
    mark, ident, owner_sha, owner_id = (hidden(docs, x) for x in ("sha", "id", "owner_sha", "owner_id"))
    owners = text_owners(docs, doc_id, text, keep).select(F.col("text_sha256").alias(owner_sha), F.col("keep_id").alias(owner_id))
    marked = docs.withColumns({mark: F.sha2(payload(text), 256), ident: F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))})
    same = (F.col(mark) == F.col(owner_sha)) & (F.col(ident) == F.coalesce(F.col(owner_id), F.lit(-1)))
    return marked.join(owners, same, "left_semi").dropDuplicates([mark, ident]).drop(mark, ident)
