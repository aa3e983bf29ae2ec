"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern; a word becomes its bytes, and ranked merges fold them: the pair with
the least rank goes first, of equal ones the leftmost, until no pair has a rank. Decoding looks every id's bytes up
in a literal array and concatenates the pieces, in Spark expressions.

There are two encoders with the same results:

* ``NativeEncoder``: Spark higher-order functions alone. The ranks are one literal (buckets of pairs and of the ids
  that they merge to); a fold step looks up the two ranks that the last merge made. The most frequent distinct
  words of all documents are folded once and put into a second literal, others are folded where they stand.
* ``WordCoder``: the same merges in an Arrow function. A worker keeps the ids of the distinct words that it has met.

``encode`` takes the Arrow function: Spark interprets higher-order functions, and a fold takes about 0.1 ms a word
there, which the README sets against the time that the corpus allows. In both a merge copies the rest of the word,
so words over ``FOLD_BYTES`` bytes (pages of letters without a space) take a heap instead.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded alike; an empty table gives an
empty result; other columns of the input, whatever their names, are not touched. Special strings inside a text are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import hidden, written
from cartlane.llm.splits import LATIN, PATTERN, is_latin

#: Most words in the literal of known words, and the most bytes of one.
KNOWN_WORDS, KNOWN_BYTES = 1 << 17, 48
#: Buckets of the literals.
RANK_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 16
#: Words over so many bytes are merged with a heap.
FOLD_BYTES = 2048
#: Words whose ids a worker keeps, and the most characters of one.
CACHED_WORDS, CACHED_CHARS = 400_000, 40
NONE = (1 << 31) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in file if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(4)
def _tables(path: str) -> tuple[str, str, str, str]:
    """The literals as JSON: pairs by bucket, merged ids by bucket (after ``NONE``), the bytes' ids, the tokens as
    hexadecimal digits."""
    tokens = read_ranks(path)
    ids = {t: i for i, t in enumerate(tokens)}
    keys: list[list[int]] = [[] for _ in range(RANK_BUCKETS)]
    merged: list[list[int]] = [[NONE] for _ in range(RANK_BUCKETS)]
    for i, token in enumerate(tokens):
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                bucket = (a * 31 + b) % RANK_BUCKETS
                keys[bucket].append(a << 20 | b)
                merged[bucket].append(i)
    dump = lambda x: json.dumps(x, separators=(",", ":"))
    return dump(keys), dump(merged), dump([ids[bytes([b])] for b in range(256)]), dump([t.hex() for t in tokens])


def _newer(kind: str) -> str:
    """Ranges of the letters (L) or numbers (N) that Unicode 3.2 did not have as such, for a Java class: whatever
    Unicode a Java has, its own class and these are what the library's engine knows."""
    want, ranges, start = regex.compile(rf"\p{{{kind}}}"), [], None
    for cp in range(0x80, 0x110001):
        new = (cp < 0x110000 and not 0xD800 <= cp < 0xE000 and unicodedata.ucd_3_2_0.category(chr(cp))[0] != kind
               and want.match(chr(cp)))
        if new and start is None:
            start = cp
        elif not new and start is not None:
            ranges.append(rf"\x{{{start:x}}}-\x{{{cp - 1:x}}}")
            start = None
    return "".join(ranges)


@lru_cache(1)
def java_pattern() -> str:
    r"""The vocabulary's split for Java's expressions, where ``\s`` and the newest letters differ. A class decides
    ASCII before it looks at the long lists."""
    letters, numbers = (rf"\p{{{k}}}[[{_newer(k)}]&&[^\x00-\x7f]]" for k in ("L", "N"))
    blank = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blank}{letters}{numbers}]+"
            f"|[{blank}]+(?![^{blank}])|[{blank}]+")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literal(text: str, kind: str) -> Column:
    return F.from_json(F.lit(text), kind)


def _probe(keys: Column, values: Column, bucket: Column, key: Column) -> Column:
    """The value at a key, or the bucket's first value where the key is missing."""
    return F.get(F.get(values, bucket), F.array_position(F.get(keys, bucket), key).cast("int"))


class NativeEncoder:
    """Column expressions for one rank file."""

    def __init__(self, path: str):
        keys, merged, first, self.pieces = _tables(path)
        self.path, self.first = path, first
        self.tables = F.struct(_literal(keys, "array<array<bigint>>").alias("k"),
                               _literal(merged, "array<array<int>>").alias("v"), _literal(first, "array<int>").alias("b"))

    @staticmethod
    def _rank(t: Column, a: Column, b: Column) -> Column:
        bucket = ((a * 31 + b) % RANK_BUCKETS).cast("int")
        return _probe(t["k"], t["v"], bucket, a.cast("long") * (1 << 20) + b)

    def _step(self, t: Column, acc: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def merge(low: Column) -> Column:
            def at(i: Column) -> Column:
                left = F.when(i > 1, F.array(self._rank(t, F.get(p, i - 2), low))).otherwise(F.array().cast("array<int>"))
                right = F.when(i < F.size(r), F.array(self._rank(t, low, F.get(p, i + 1)))).otherwise(F.array().cast("array<int>"))
                pieces = F.concat(F.slice(p, 1, i - 1), F.array(low), F.slice(p, i + 2, F.size(p)))
                ranks = F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(p)))
                return F.struct(pieces.alias("p"), ranks.alias("r"))

            return F.when(low == NONE, acc).otherwise(_let(F.array_position(r, low).cast("int"), at))

        return _let(F.coalesce(F.array_min(r), F.lit(NONE)), merge)

    def fold(self, t: Column, word: Column) -> Column:
        """ids of a word by folded merges; ``t`` are the bound tables."""
        letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        start = F.transform(letters, lambda c: F.get(t["b"], F.ascii(c)))

        def merged(p: Column) -> Column:
            ranks = F.transform(F.slice(p, 2, F.size(p)), lambda b, i: self._rank(t, F.get(p, i), b))
            steps = F.slice(p, 2, F.size(p))  # one merge less than bytes
            return F.aggregate(steps, F.struct(p.alias("p"), ranks.alias("r")), lambda acc, _: self._step(t, acc),
                               lambda acc: acc["p"])

        return _let(start, merged)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern()), F.lit(0))

    def known_words(self, docs: DataFrame, text: str, count: int) -> Column:
        """The most frequent distinct words of all documents, folded, as one literal (struct of buckets)."""
        word = docs.select(F.explode(self.words(F.col(text))).alias("word"))
        counted = word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.octet_length("word") <= KNOWN_BYTES)
        chosen = written(counted.orderBy(F.desc("n"), "word").limit(count).select("word"), "words")
        spread = chosen.repartition(chosen.sparkSession.sparkContext.defaultParallelism * 2, "word")
        folded = spread.select("word", F.pmod(F.hash("word"), F.lit(WORD_BUCKETS)).alias("bucket"),
                               _let(self.tables, lambda t: self.fold(t, F.col("word"))).alias("ids"))
        keys: list[list] = [[] for _ in range(WORD_BUCKETS)]
        values: list[list] = [[None] for _ in range(WORD_BUCKETS)]
        for row in folded.toLocalIterator():
            keys[row["bucket"]].append(row["word"])
            values[row["bucket"]].append(list(row["ids"]))
        return F.struct(_literal(json.dumps(keys), "array<array<string>>").alias("k"),
                        _literal(json.dumps(values), "array<array<array<int>>>").alias("v"))

    def ids(self, words: Column, known: Column, long_words: Column, long_ids: Column) -> Column:
        """ids of an array of words in order."""
        def one(w: Column, t: Column, d: Column) -> Column:
            bucket = F.pmod(F.hash(w), F.lit(WORD_BUCKETS))
            long = F.get(long_ids, (F.array_position(long_words, w) - 1).cast("int"))
            folded = F.when(F.octet_length(w) > FOLD_BYTES, long).otherwise(self.fold(t, w))
            return F.coalesce(_probe(d["k"], d["v"], bucket, w), folded)

        return _let(F.struct(self.tables.alias("t"), known.alias("d")),
                    lambda x: F.flatten(F.transform(words, lambda w: one(w, x["t"], x["d"]))))


def decode(path: str, ids: Column) -> Column:
    """The bytes that ids stand for: binary pieces, concatenated."""
    return _let(_literal(_tables(path)[3], "array<string>"),
                lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one word with a heap of pairs over a linked list: O(n log n)."""
    n = len(word)
    piece: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes, bytes]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n and (rank := ranks.get(piece[i] + piece[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, piece[i], piece[after[i]]))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if piece[i] == a else n
        if j >= n or piece[j] != b:
            continue  # one of the two has been merged since
        piece[i], piece[j], after[i] = a + b, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(before[i])
        push(i)
    return [ranks[p] for p in piece if p is not None]


class WordCoder:
    """ids of texts, with the ids of the distinct words it has met."""

    def __init__(self, path: str):
        self.ranks = {t: i for i, t in enumerate(read_ranks(path))}
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ranked merges over the bytes of a word; the ranks of the pairs are kept beside them."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        if len(word) > FOLD_BYTES:
            return heap_merge(word, ranks)
        parts = [word[i:i + 1] for i in range(len(word))]
        pairs = [ranks.get(word[i:i + 2], NONE) for i in range(len(word) - 1)]
        while pairs:
            least = min(pairs)
            if least == NONE:
                break
            i = pairs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        return [ranks[p] for p in parts]

    def _new(self, word: str) -> list[int]:
        ids = self.merge(word.encode())
        if len(word) <= CACHED_CHARS:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.known.get, []
        for word in (LATIN if is_latin(text) else self.pattern).findall(text):
            ids = known(word)
            out += self._new(word) if ids is None else ids
        return out


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One for each worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _over_texts(path: str):
    def encoded(texts: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([c.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return F.arrow_udf(encoded, "array<int>")


def _over_words(path: str):
    def merged(words: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([[c.merge(w.encode()) for w in row] for row in words.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(merged, "array<array<int>>")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows with their ids (array of int) as column ``ids``."""
    return docs.withColumn(ids, _over_texts(path)(F.col(text)))


def encode_native(docs: DataFrame, path: str, text: str = "text", ids: str = "ids",
                  known_words: int = KNOWN_WORDS) -> DataFrame:
    """The same by expressions alone, but for words over ``FOLD_BYTES``. The known words' counts are a pass of
    their own."""
    encoder = NativeEncoder(path)
    known = encoder.known_words(docs, text, known_words)
    words, long, long_ids = (hidden(docs, x) for x in ("words", "long", "long_ids"))
    split = docs.withColumn(words, encoder.words(F.col(text)))
    split = split.withColumn(long, F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > FOLD_BYTES)))
    split = split.withColumn(long_ids, _over_words(path)(long))
    out = split.withColumn(ids, encoder.ids(F.col(words), known, F.col(long), F.col(long_ids)))
    return out.drop(words, long, long_ids)


def digests(coded: DataFrame, path: str) -> DataFrame:
    """Of rows with ``doc_id`` and ``ids``: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space),
    decoded_sha256."""
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(decode(path, F.col("ids")), 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, then decode the ids."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return digests(encode(bare, path).select("doc_id", "ids"), path)
