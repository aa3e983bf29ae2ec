"""Packing by sum of squares: documents into token windows of one size, with little padding.

A document is its token ids and one end id. It is cut at the window size; whole windows stand alone and the rest is
placed online. The packer tracks one array of levels: how many open windows are filled to each level. An item goes
to the level (or a new window) that makes the sum of the squared counts of partly filled windows least; of equal
levels the fullest wins. Many different levels stay in stock this way, so that some window is soon closed exactly.

When a task's rows end, its open windows are closed: the emptiest are dissolved and their items, cut where need be,
fill the gaps of the others, so that all but at most one window of a task are full or have a gap below
``least_cut``. For this the task holds the items of its open windows (ids included), and no others; over
``open_items`` items the closing runs early, so the memory is bounded.

Each task of the scan packs what it reads (a lane), so nothing is shuffled and no key can be hot. A lane is named by
the task's partition number, so a task that runs again gives the same rows. Pieces say where their ids lie; windows
are padded to ``window``.

Defined cases: a null or empty text is a document of the end id alone; a text of any length is cut into as many
windows as it needs; repeated rows are packed each on its own; an empty table gives an empty result; other columns of
the input, whatever their names, are not touched.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import batches, byte_letters
from cartlane.llm.splits import BLANK, LETTERS, NUMBERS

WINDOW = 4096
#: The least piece that closing cuts off, and the most items that a task holds before it closes its windows.
LEAST_CUT, OPEN_ITEMS = 16, 50_000
#: Chunks and words whose ids a worker keeps in each of two generations, and the longest of them.
CACHED_CHUNKS, CACHED_WORDS, CACHED_CHARS = 50_000, 150_000, 40
#: Bytes of text whose words are numbered together; a longer text is a group of its own.
GROUP = 1 << 20
#: A run of anything but Unicode white space, which the vocabulary's normaliser and splitter drop.
CHUNK = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: The vocabulary's split for Latin-1, where lower-casing is character by character and NFC changes nothing: these
#: stand alone, letters between them and blanks are a word.
MARKS = f"('(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{BLANK}{LETTERS}{NUMBERS}]+)"
#: Blanks beyond ASCII.
WIDE_BLANK = "[\\x{85}\\x{a0}]"

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Kept(dict):
    """What ``make`` gives for a string, kept in two generations of ``size`` at most: when the younger is full it
    becomes the older, and what is asked for again moves up."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class ChunkEncoder:
    """Ids of the tokenizers library as little-endian unsigned 32-bit numbers, for many texts at a time.

    The vocabulary lower-cases, drops white space and merges within words. Latin-1 texts are cut into words by Arrow: a
    blank is put around everything but letters, and the pieces between blanks are numbered, so each word of a group of
    texts is looked up once; new ones go to the library's model. The texts' ids are gathered from one flat array. Any
    other text's chunks between white space go to the library as a whole. A worker keeps the ids of words and chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        #: What makes a text go to the library: letters beyond Latin-1, and special strings.
        self.other = "|".join([r"[^\x{00}-\x{ff}]", *special])
        self.letters = {b: c for c, b in byte_letters().items()}
        self.chunks, self.words = _Kept(self._chunk, CACHED_CHUNKS), _Kept(self._word, CACHED_WORDS)

    def _word(self, word: str) -> bytes:
        # Printable ASCII is written as itself.
        written = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return _numbers([t.id for t in self.model.tokenize(written)])

    def _chunk(self, chunk: str) -> bytes:
        return _numbers(self.library.encode(chunk, add_special_tokens=False).ids)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text; a null one has none."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(sizes, np.arange(GROUP, sizes[-1] if len(sizes) else 0, GROUP)) + 1
        edges = [0, *np.unique(cuts[cuts < len(texts)]).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:], strict=False):
            group = pc.fill_null(texts[a:b], "")
            other = pc.match_substring_regex(group, self.other)
            latin = self._latin(group.filter(pc.invert(other)))
            for text, alone in zip(group, other.to_pylist(), strict=True):
                yield b"".join(map(self.chunks.__getitem__, CHUNK.findall(text.as_py()))) if alone else next(latin)

    def _latin(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(
            pc.replace_substring_regex(pc.utf8_lower(texts), WIDE_BLANK, " "), MARKS, r" \1 "))
        flat = lists.flatten().dictionary_encode()
        known = [self.words[w] if w else b"" for w in flat.dictionary.to_pylist()]
        table = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = flat.indices.to_numpy(zero_copy_only=False)
        counts, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(counts)
        ids = table[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(texts) else []
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b].tobytes()


def _numbers(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class SumOfSquares:
    """Online packing into windows of ``window``. ``place`` gives (window number, offset) of an item."""

    def __init__(self, window: int = WINDOW):
        self.window, self.made = window, 0
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        if size >= self.window:
            return self.new(), 0
        n, room = self.levels, self.window - size
        # What the sum of squares changes by when a window at level h = 1..room rises to h + size.
        change = 2 * (n[size + 1:] - n[1:room + 1]) + 2
        change[-1] = 1 - 2 * n[room]
        change[n[1:room + 1] == 0] = np.iinfo(np.int64).max
        best = len(change) - int(np.argmin(change[::-1]))
        if change[best - 1] <= 2 * n[size] + 1:
            level, number = best, self.open[best].pop()
            n[level] -= 1
        else:
            level, number = 0, self.new()
        if level + size < self.window:
            n[level + size] += 1
            self.open.setdefault(level + size, []).append(number)
        return number, level


class Lane:
    """One task's packer. Items of open windows are held until the window is full or closed."""

    def __init__(self, lane: int, window: int, least_cut: int, open_items: int):
        self.first, self.window, self.least_cut, self.open_items = lane << 32, window, least_cut, open_items
        self.packer, self.held, self.items, self.closed = SumOfSquares(window), {}, 0, 0

    def _row(self, item: tuple, number: int, offset: int) -> tuple:
        doc_id, start, ids, tokens = item
        return doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, self.first + self.closed + number, offset

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        tokens, step = len(ids) // 4, self.window
        for start in range(0, tokens, step):
            item = (doc_id, start, ids[4 * start:4 * (start + step)], tokens)
            size = len(item[2]) // 4
            number, offset = self.packer.place(size)
            window = self.held.setdefault(number, [])
            window.append(item)
            self.items += 1
            if offset + size == step:
                yield from self._emit(number, self.held.pop(number))
        if self.items > self.open_items:
            yield from self.close()

    def _emit(self, number: int, items: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for item in items:
            yield self._row(item, number, offset)
            offset += len(item[2]) // 4
        self.items -= len(items)

    def close(self) -> Iterator[tuple]:
        """Empty the open windows: from the emptiest on, items are cut to fill the gaps of the fullest."""
        fill = lambda items: sum(len(i[2]) // 4 for i in items)
        windows = sorted(((fill(i), n) for n, i in self.held.items()), reverse=True)
        loose: list[tuple] = []
        for at, (level, number) in enumerate(windows):
            if number not in self.held:
                continue
            gap = self.window - level
            while gap >= self.least_cut:
                if not loose:
                    last = next((n for _, n in reversed(windows[at + 1:]) if n in self.held), None)
                    if last is None:
                        break
                    loose = self.held.pop(last)
                doc_id, start, ids, tokens = loose.pop()
                size = len(ids) // 4
                if size > gap:
                    cut = gap if size - gap >= self.least_cut else max(size - self.least_cut, 1)
                    loose.append((doc_id, start + cut, ids[4 * cut:], tokens))
                    self.items += 1
                    ids, size = ids[:4 * cut], cut
                self.held[number].append((doc_id, start, ids, tokens))
                gap -= size
                if size < self.least_cut and gap < self.least_cut:
                    break
            yield from self._emit(number, self.held.pop(number))
        number = self.packer.new()
        while loose:
            room, items = self.window, []
            while loose and room:
                doc_id, start, ids, tokens = loose.pop()
                if len(ids) // 4 > room:
                    loose.append((doc_id, start + room, ids[4 * room:], tokens))
                    self.items += 1
                    ids = ids[:4 * room]
                room -= len(ids) // 4
                items.append((doc_id, start, ids, tokens))
            yield from self._emit(number, items)
            number = self.packer.new()
        self.closed += self.packer.made
        self.packer, self.held, self.items = SumOfSquares(self.window), {}, 0


def packer(path: str, end_id: int, window: int, least_cut: int, open_items: int):
    """For mapInArrow over (id, text): rows of ``PIECES``."""

    def pieces(source):
        encoder, end = ChunkEncoder(path), np.array([end_id], "<u4").tobytes()
        lane = Lane(TaskContext.get().partitionId(), window, least_cut, open_items)
        for batch in source:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                yield from lane.add(doc_id, ids + end)
        yield from lane.close()

    return lambda source: batches(pieces(source), PIECES)


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, least_cut: int = LEAST_CUT,
         open_items: int = OPEN_ITEMS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        packer(path, end_id, window, least_cut, open_items), DDL)
