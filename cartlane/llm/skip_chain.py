"""Personal data by rules and a skip-chain conditional random field.

Base spans come from four rules (email, ip, card, phone). The field adds what the rules miss where the same document
says so elsewhere: a phone number that comes back without its country code, a card number written with other
separators, the local part of an address.

Nodes are a text's words that hold a digit or an ``@``, or equal the local part of an address of the text; all other
words are outside. Labels are ``none`` and the four kinds. Potentials:

- A word under a base span has that kind, as observed.
- Another word has, for each kind that its letters allow, the evidence of its shape and of the word before it, from
  counts of base labels in the whole table. The rules have seen the word and said no: evidence is discounted by their
  recall and bounded (``LOCAL_CAP``), so that no word becomes personal data by its own look, and none is ruled out.
- Neighbours that are both unobserved share a chain potential, from counts of adjacent labels.
- Repeated words (equal, or with the same last seven digits, or the same local part) share a skip potential that
  favours one label, however far apart; its weight comes from how often linked base words agree. In a group of such
  words each is linked to the next and to the nearest observed one, so edges grow with the words.

Loopy sum-product messages run for a fixed number of rounds; a word takes the kind whose marginal is over one half.
A complete word (digits enough, an address's parts) is a span, and so is a run of incomplete ones that is complete.

Plan: one scan counts features in every task and Spark adds them up; the model is a table of bounded size (hashed
features). A second scan finds the spans. Nothing but counts is shuffled.

Defined cases: a null or empty text has no span; texts of any length are read whole, and the rules run in linear time;
a text without a base span has nothing to be consistent with and keeps none; repeated rows give the same spans; a
table without personal data gives a model of the priors; an empty table gives an empty result; other columns of the
input, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(1, 5)
LABELS = 1 + len(KINDS)

# --- fixed values: the base rules ----------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (12, 19), (9, 15), 255
# ------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_NUMERIC = re.compile(r"[0-9+()./-]+")
_CORE = re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9]+$")
_DIGIT = re.compile(r"[^0-9]+")

#: Hashed features, and the pseudo-counts of the estimates.
BUCKETS, SMOOTH = 4096, 0.5
#: The share of personal data that the rules are taken to find, and the least and most that a word's look says for a
#: kind that its letters allow.
RECALL, LOCAL_FLOOR, LOCAL_CAP = 0.99, -6.5, -2.0
#: Agreeing linked pairs that count as seen beforehand, with one that disagrees; the bound of a chain potential.
SKIP_PRIOR, CHAIN_CAP = 1000, 1.5
ROUNDS, DAMPING = 16, 0.3
#: Digits that make numbers similar, and the least of a number that is added.
SUFFIX, LEAST_REPEAT = 7, 3
_NEVER = -60.0


# --- base spans -----------------------------------------------------------------
def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            # The letters before this mark belong to no address any more.
            done = at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    numbers = [int(c) for c in reversed(digits)]
    return (sum(numbers[::2]) + sum(sum(divmod(2 * x, 10)) for x in numbers[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order; leftmost and non-overlapping within each kind."""
    out = [(a, EMAIL, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_PART for p in m.groups()):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0]) if m.end() - m.start() < 2 * CARD_DIGITS[1] else ""
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind - 1]}:{start}:{end}" for start, kind, end in spans])


# --- the graph of one text ------------------------------------------------------
class Words(NamedTuple):
    """A text's nodes: place among all words, core's start, end and text, the base span that ends here, observed kind
    (0: none), the kinds it may have, shape and cue features."""

    place: list[int]
    start: list[int]
    end: list[int]
    core: list[str]
    whole: list[str]
    seen: list[int]
    allowed: list[tuple[int, ...]]
    shape: list[int]
    cue: list[int]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(core: str) -> str:
    out: list[str] = []
    for c in core[:40]:
        sign = "9" if c.isdigit() else "a" if c.isalpha() else c
        if sign not in "9a" or out[-4:] != [sign] * 4:
            out.append(sign)
    return "".join(out)


def _allowed(core: str, locals_: frozenset[str]) -> tuple[int, ...]:
    if "@" in core or core.lower() in locals_:
        return (EMAIL,)
    if _NUMERIC.fullmatch(core) and any(c.isdigit() for c in core):
        return (IP, CARD, PHONE) if core.count(".") >= 2 else (CARD, PHONE)
    return ()


def local_part(core: str) -> str:
    return core[:core.find("@")].lower()


def nodes(text: str, spans: list[tuple[int, int, int]]) -> Words:
    """The words of ``text`` that take part; a word under several base spans has the first kind listed."""
    # Local parts that cannot be plain words.
    locals_ = frozenset(x for a, k, b in spans if k == EMAIL and len(x := local_part(text[a:b])) >= 5
                        and not x.isalpha())
    out, cover, at, before = Words([], [], [], [], [], [], [], [], []), sorted(spans), 0, ""
    for place, m in enumerate(_WORD.finditer(text)):
        word = m[0]
        if not _MARKED.search(word) and (not locals_ or _CORE.sub("", word).lower() not in locals_):
            before = word
            continue
        while at < len(cover) and cover[at][2] <= m.start():
            at += 1
        over = list(_overlapping(cover, at, m.start(), m.end()))
        core = _CORE.sub("", word)
        shift = word.find(core) if core else 0
        out.place.append(place)
        out.start.append(m.start() + shift)
        out.end.append(m.start() + shift + len(core))
        out.core.append(core)
        out.whole.append(next((text[a:b] for a, _, b in over if b <= m.end()), ""))
        out.seen.append(min((k for _, k, _ in over), default=0))
        out.allowed.append(_allowed(core, locals_))
        out.shape.append(_bucket(_shape(core)))
        out.cue.append(_bucket(before.lower()[:40]))
        before = "#"
    return out


def _overlapping(cover, at, start, end):
    # Spans of different kinds overlap each other by a few, so those before ``end`` from ``at`` on are few.
    while at < len(cover) and cover[at][0] < end:
        if cover[at][2] > start:
            yield cover[at]
        at += 1


def keys(core: str) -> list[str]:
    """What makes words similar: an equal core, the last digits, the local part."""
    digits = _DIGIT.sub("", core)
    out = []
    if "@" in core:
        out += ["=" + core.lower(), "l" + local_part(core)]
    elif _NUMERIC.fullmatch(core):
        if len(digits) >= LEAST_REPEAT:
            out.append("=" + digits)
        if len(digits) >= SUFFIX:
            out.append("s" + digits[-SUFFIX:])
    elif core:
        out.append("l" + core.lower())
    return out


def edges(words: Words) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges between adjacent unobserved words, skip edges between similar words)."""
    open_ = [bool(a) and not s for a, s in zip(words.allowed, words.seen, strict=True)]
    chain = [(i, i + 1) for i in range(len(open_) - 1)
             if open_[i] and open_[i + 1] and words.place[i + 1] == words.place[i] + 1]
    groups: dict[str, list[int]] = {}
    for i, core in enumerate(words.core):
        if open_[i] or words.seen[i]:
            # A number of several words is known by all its digits at its last word.
            for key in dict.fromkeys(keys(core) + keys(words.whole[i].replace(" ", ""))):
                groups.setdefault(key, []).append(i)
    skip: dict[tuple[int, int], None] = {}
    for members in groups.values():
        last = None
        for a, b in zip(members, members[1:], strict=False):
            skip[a, b] = None
        for order in (members, members[::-1]):
            last = None
            for i in order:
                if words.seen[i]:
                    last = i
                elif last is not None:
                    skip[min(i, last), max(i, last)] = None
    return chain, list(skip)


# --- counts and potentials ------------------------------------------------------
SHAPE, CUE, PRIOR, CHAIN, SKIP = range(5)


def count_features(text: str, counts: Counter) -> None:
    """Add a text's base labels by feature: keys (table, feature, label)."""
    if not _MARKED.search(text):
        return
    words = nodes(text, base_spans(text))
    for shape, cue, seen in zip(words.shape, words.cue, words.seen, strict=True):
        counts[SHAPE, shape, seen] += 1
        counts[CUE, cue, seen] += 1
        counts[PRIOR, 0, seen] += 1
    for i in range(len(words.place) - 1):
        if words.place[i + 1] == words.place[i] + 1:
            counts[CHAIN, words.seen[i], words.seen[i + 1]] += 1
    for a, b in edges(words)[1]:
        if words.seen[a] and words.seen[b]:
            counts[SKIP, 0, int(words.seen[a] == words.seen[b])] += 1


def _counted(source) -> Iterator[pa.RecordBatch]:
    """(text) -> a task's rows (what, feature, label, n); at most two tables of hashed features and a few rows."""
    counts: Counter = Counter()
    for batch in source:
        for text in batch.column(0):
            count_features(text.as_py() or "", counts)
    if counts:
        what, feature, label = (pa.array(c, pa.int32()) for c in zip(*counts, strict=True))
        yield pa.RecordBatch.from_arrays([what, feature, label, pa.array(counts.values(), pa.int64())],
                                         ["what", "feature", "label", "n"])


class Field(NamedTuple):
    """Log potentials: shape and cue tables (bucket, label), the prior, and the two kinds of edges."""

    shape: np.ndarray
    cue: np.ndarray
    prior: np.ndarray
    pair: np.ndarray

    def local(self, shape: int, cue: int, allowed: tuple[int, ...]) -> np.ndarray:
        """Log odds of every kind against none for a word that the rules left out."""
        out = np.full(LABELS, _NEVER)
        out[0] = 0.0
        own = [0, *allowed]
        score = (self.prior + self.shape[shape] + self.cue[cue])[own]
        p = np.exp(score - np.logaddexp.reduce(score))[1:]
        out[list(allowed)] = np.clip(np.log(np.maximum(p, 1e-12) * (1 - RECALL) / (1 - RECALL * p)), LOCAL_FLOOR, LOCAL_CAP)
        return out


def field(counts: dict[tuple[int, int, int], int]) -> Field:
    """Potentials from counts: evidence is how much more often a feature has a label than labels in general."""
    shape, cue = (np.full((BUCKETS, LABELS), 0.0) for _ in range(2))
    prior, chain, agree = np.full(LABELS, SMOOTH), np.full((LABELS, LABELS), SMOOTH), np.array([1.0, SKIP_PRIOR])
    for (what, feature, label), n in counts.items():
        if what == SHAPE:
            shape[feature, label] += n
        elif what == CUE:
            cue[feature, label] += n
        elif what == PRIOR:
            prior[label] += n
        elif what == CHAIN:
            chain[feature, label] += n
        else:
            agree[label] += n
    share = prior / prior.sum()

    def evidence(table):
        own = table + SMOOTH * LABELS * share
        return np.log(own / own.sum(1, keepdims=True)) - np.log(share)

    joint = chain / chain.sum()
    ratio = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    weight = max(np.log(agree[1] / agree[0]), 0.0)
    return Field(evidence(shape), evidence(cue), np.log(share),
                 np.stack([np.clip(ratio, -CHAIN_CAP, CHAIN_CAP), weight * np.eye(LABELS)]))


def fit(docs: DataFrame, text: str = "text") -> Field:
    """The field of all whole texts; the driver gets at most ``2 * BUCKETS * LABELS`` counts and a few."""
    rows = docs.select(F.col(text)).mapInArrow(_counted, "what int, feature int, label int, n long").groupBy(
        "what", "feature", "label").agg(F.sum("n").alias("n")).collect()
    return field({(r["what"], r["feature"], r["label"]): r["n"] for r in rows})


# --- inference ------------------------------------------------------------------
def marginals(local: np.ndarray, pairs: np.ndarray, kinds: np.ndarray, potentials: np.ndarray,
              seen: np.ndarray) -> np.ndarray:
    """Loopy sum-product: label marginals from log potentials of nodes (N, L) and of edges (by ``kinds``). Evidence
    goes first: in the first round only the ``seen`` nodes speak."""
    n = len(pairs)
    ends = np.concatenate([pairs, pairs[:, ::-1]])
    # The table of an edge walked from its second end is the transpose.
    table = np.concatenate([potentials[kinds], potentials[kinds].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    message = np.where(seen[ends[:, :1]], np.logaddexp.reduce(local[ends[:, 0]][:, :, None] + table, axis=1), 0.0)
    for _ in range(ROUNDS):
        belief = local.copy()
        np.add.at(belief, ends[:, 1], message)
        rest = belief[ends[:, 0]] - message[back]
        new = np.logaddexp.reduce(rest[:, :, None] + table, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    belief = local.copy()
    np.add.at(belief, ends[:, 1], message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def _complete(text: str, kind: int) -> bool:
    digits = sum(c.isdigit() for c in text)
    if kind == EMAIL:
        return True
    if kind == IP:
        return text.count(".") >= 3
    return (CARD_DIGITS[0] if kind == CARD else SUFFIX) <= digits <= CARD_DIGITS[1]


def added_spans(text: str, spans: list[tuple[int, int, int]], model: Field) -> list[tuple[int, int, int]]:
    """What the field adds to the base spans of ``text``."""
    if not spans:
        return []
    words = nodes(text, spans)
    chain, skip = edges(words)
    if not any(a and not s for a, s in zip(words.allowed, words.seen, strict=True)) or not skip:
        return []
    local = np.full((len(words.place), LABELS), _NEVER)
    for i, seen in enumerate(words.seen):
        if seen or not words.allowed[i]:
            local[i, seen] = 0.0
        else:
            local[i] = model.local(words.shape[i], words.cue[i], words.allowed[i])
    share = marginals(local, np.array(chain + skip, np.int64).reshape(-1, 2),
                      np.array([0] * len(chain) + [1] * len(skip), np.int64), model.pair, np.array(words.seen) > 0)
    best = np.where(share.max(1) > 0.5, share.argmax(1), 0)
    best[np.array(words.seen) > 0] = 0
    out, i = [], 0
    while i < len(best):
        j, kind = i + 1, int(best[i])
        if kind:
            # A complete word is a span of its own; incomplete ones are joined with those that follow.
            whole = _complete(words.core[i], kind)
            while not whole and j < len(best) and best[j] == kind and words.place[j] == words.place[j - 1] + 1 and not _complete(
                    words.core[j], kind):
                j += 1
            a, b = words.start[i], words.end[j - 1]
            if whole or _complete(text[a:b], kind):
                out.append((a, kind, b))
        i = j
    return out


def all_spans(text: str, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans)."""
    if not _MARKED.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model))


def spans_column(model: Field, text: str = "text") -> Column:
    """An Arrow function to (base, spans): arrays of (kind, start, end) in code points."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("base array<struct<kind string, start int, end int>>, spans array<struct<kind string, start int, end int>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [[[{"kind": KINDS[k - 1], "start": a, "end": b} for a, k, b in s] for s in all_spans(t.as_py() or "", model)]
                for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], pa.list_(span)) for c in (0, 1)], ["base", "spans"])

    return found(F.col(text))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans (arrays of kind, start, end by start, then kind as listed)."""
    model = fit(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), spans_column(model, text).alias("s"))
    return rows.select("doc_id", "s.base", "s.spans")


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of the base spans and all spans as a string."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))
