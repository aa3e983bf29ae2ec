"""Token counts by prefix dynamic programming.

For byte-level BPE the encoding of a string is the one sequence of tokens in which every token is what BPE makes of
its own bytes and every two neighbours are what BPE makes of theirs together. So the last token of a prefix fixes
the rest: ``count[i] = count[i - len(t)] + 1`` for the one token ``t`` that ends at ``i`` and may follow the last
token at ``i - len(t)``. One pass over a word gives the exact count at every prefix of it, and a text adds its words
up. Nothing is encoded again for a shorter prefix, so truncation and budget questions are look-ups.

A prefix of a text is not always split into words as the text is; the two cases are corrected: a prefix that ends
with a run of white space (the run is then one word), and one that ends inside a contraction such as ``'re``
(``'r`` alone is two words). Prefixes end between code points.

Texts run through Arrow in the tasks that read them, without a shuffle. A worker keeps the tables of the words it
has met, up to ``CACHED_WORDS``; the tables only save time. The work is linear in the text: long words are not
kept, and a token is at most as long as the longest of the vocabulary.

Defined cases: a null or empty text has one prefix, of 0 tokens; the tokenizer's special strings inside a text are
one token each, and text on each side of one is split on its own, as the library does by default; a text of any
length is counted whole; repeated rows are counted alike; an empty table gives an empty result; other columns of
the input, whatever their names, are not touched.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import byte_letters
from cartlane.llm.splits import LATIN, PATTERN, is_latin

#: Words whose tables a worker keeps, and the most code points of such a word.
CACHED_WORDS, CACHED_CHARS = 150_000, 40


def later_code_points() -> str:
    """A character class of the code points that Unicode 3.2 does not have. Engines of different age disagree on
    some of these, so texts with one are split by the library's own pre-tokenizer."""
    ranges, start = [], None
    for cp in range(0x80, 0x110001):
        new = cp < 0x110000 and unicodedata.ucd_3_2_0.category(chr(cp)) == "Cn"
        if new and start is None:
            start = cp
        elif not new and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "[" + "".join(ranges) + "]"


class PrefixCounter:
    """Exact token counts at every prefix, for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                    if all(c in letters for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(bytes(letters[c] for c in a), bytes(letters[c] for c in b)): r
                     for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern, self.space, self.later = regex.compile(PATTERN), regex.compile(r"\s"), re.compile(later_code_points())
        self.path, self.library = path, None
        self.words: dict[str, list[int]] = {}
        self.totals: dict[str, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.parents = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.tokens = {t for t in self.ids if len(t) == 1 or self._made(t)}
        self.spines: dict[bytes, tuple[list, list]] = {}

    def split(self, text: str) -> list[str]:
        if is_latin(text):
            return LATIN.findall(text)
        if self.later.search(text) is None:
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def merge(self, text: bytes) -> list[bytes]:
        """BPE of a short string by its ranked merges."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _made(self, token: bytes) -> bool:
        """Whether BPE makes one token of the token's bytes: its parents are tokens that may meet."""
        return token in self.parents and self.merge(token) == [token]

    def _spines(self, token: bytes) -> tuple[list, list]:
        """The tokens that lie at the token's right end and at its left end while it is built, from a byte up, each
        with the rank at which it becomes part of the next."""
        found = self.spines.get(token)
        if found is None:
            sides: tuple[list, list] = ([(token, 1 << 60)], [(token, 1 << 60)])
            for side, child in ((sides[0], 1), (sides[1], 0)):
                while len(side[-1][0]) > 1:
                    pair = self.parents[side[-1][0]]
                    side.append((pair[child], self.rank[pair]))
                side.reverse()
            found = self.spines[token] = sides
        return found

    def _follows(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves two tokens as they are when they meet: while both are built, no pair across their
        border is merged first. Of equal ranks the leftmost pair goes first."""
        ends, starts = self._spines(left)[0], self._spines(right)[1]
        i = j = 0
        while True:
            (a, next_a), (b, next_b) = ends[i], starts[j]
            across = self.rank.get((a, b), 1 << 61)
            if across < next_a and across <= next_b:
                return False
            if next_a == next_b == 1 << 60:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def byte_counts(self, word: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes of a word."""
        counts, last, tokens, pairs, longest = [0], [b""], self.tokens, self.pairs, self.longest
        for end in range(1, len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = word[start:end]
                if token not in tokens:
                    continue
                if start:
                    pair = (last[start], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) > 1 << 19:
                            pairs.clear()
                        fits = pairs[pair] = self._follows(*pair)
                    if not fits:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def word_table(self, word: str) -> list[int]:
        """Tokens at every code point of a word, from 1 on."""
        found = self.words.get(word)
        if found is None:
            raw = word.encode()
            counts = self.byte_counts(raw)
            ends = [i for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            found = [counts[i] for i in ends]
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= CACHED_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def _total(self, word: str) -> int:
        total = self.word_table(word)[-1]
        if len(word) <= CACHED_CHARS:
            if len(self.totals) >= 4 * CACHED_WORDS:
                self.totals.clear()
            self.totals[word] = total
        return total

    def _parts(self, text: str):
        """(is special, string) in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield False, text[at:m.start()]
            yield True, m.group()
            at = m.end()
        yield False, text[at:]

    def prefix_counts(self, text: str | None) -> list[int]:
        """count[i]: tokens of the first i code points. Inside a special string the prefix is ordinary text, so it
        is split together with the text before it."""
        counts, before, base = [0], "", 0
        for special, part in self._parts(text or ""):
            if special:
                counts += [base + n for n in self._plain(before + part)[len(before) + 1:-1]]
                base += self._plain(before)[-1] + 1
                counts.append(base)
                before = ""
            else:
                counts += [base + n for n in self._plain(part)[1:]]
                before = part
        return counts

    def _plain(self, text: str) -> list[int]:
        """Prefix counts of a text without special strings."""
        counts, base, earlier, words = [0], 0, 0, self.split(text)
        for k, word in enumerate(words):
            table = self.word_table(word)
            entries = [base + n for n in table]
            if word in ("'re", "'ve", "'ll"):  # its first two letters alone are two words
                entries[1] = base + sum(self.word_table(c)[0] for c in word[:2])
            if k and self.space.match(word) and self.space.match(words[k - 1][-1]):
                # A prefix that ends with a whole run of white space has the run as one word.
                entries[0] = earlier + self.word_table(words[k - 1] + word[0])[-1]
            counts += entries
            base, earlier = base + table[-1], base
        return counts

    def total(self, text: str | None) -> int:
        """The count at the last prefix alone, from the words' last entries."""
        total, known = 0, self.totals
        for special, part in self._parts(text or ""):
            if special:
                total += 1
                continue
            for word in self.split(part):
                n = known.get(word)
                total += self._total(word) if n is None else n
        return total

    def longest_within(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= max(budget, 0))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _over_texts(path: str, kind, one):
    """Arrow function of a text column: ``one(counter, text)`` for each value."""

    @F.arrow_udf(kind)
    def applied(texts: pa.Array) -> pa.Array:
        c = counter(path)
        values = [one(c, t.as_py()) for t in texts]
        return pa.array(values, pa.list_(pa.int32()) if kind.startswith("array") else pa.int64())

    return applied


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                          _over_texts(path, "long", PrefixCounter.total)(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and prefix_tokens, whose element i is the exact count of the first i code points. Truncation
    (``truncated``) and any budget question read it with array functions."""
    return docs.select(F.col(doc_id).alias("doc_id"),
                       _over_texts(path, "array<int>", PrefixCounter.prefix_counts)(F.col(text)).alias("prefix_tokens"))


def truncated(docs: DataFrame, path: str, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and the longest prefix of the text with at most ``budget`` tokens; null stays null."""
    size = _over_texts(path, "long", lambda c, t: c.longest_within(t, budget))(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"), size.alias("__n")).select(
        "doc_id", F.expr("substring(__t, 1, cast(__n AS int))").alias("text"))
