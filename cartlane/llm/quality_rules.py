"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule names a measure (or the ratio of two) and its least and greatest allowed value. ``rule_columns`` turns the
table into one native expression: the text is split once, the measures are bound as lambda variables (so nothing is
evaluated twice), and the rules compare them. Work per text is O(n log n) in its words; no shuffle.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated words are those in 3-word windows that occur twice or more in the text,
compared by a 64-bit hash of the three words within one text.

Defined cases: a null text counts as empty: no words, every measure 0, every ratio of an empty measure 0, and it
fails the length rule; texts of any length are read whole; repeated rows are judged alike; an empty table gives an
empty result; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import hidden

# --- fixed values: frequent function words of the corpus languages ----------
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this have from or had by not but what",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont elle ou",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este es",
}
# ---------------------------------------------------------------------------
BLANK = r" \t-\r"


class Rule(NamedTuple):
    """``low <= measure / per <= high``; without ``per`` the measure itself, an open end is None. A measure of 0
    over a ``per`` of 0 counts as 0."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: The production table.
RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("repetition", "n_repeat_words", "n_words", None, 0.5),
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("marks", "n_marks", "n_words", None, 0.1),
    Rule("capitals", "n_capitals", "word_chars", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("equal_lines", "n_dup_lines", "n_lines", None, 0.5),
)
#: The rules that the base verdict consists of.
BASE = ("length", "repetition")


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _stop_list() -> str:
    words = sorted({w for text in STOP_WORDS.values() for w in text.split()})
    return ", ".join(f"'{w}'" for x in words for w in dict.fromkeys((x, x.capitalize())))


#: Words that lie in a repeated window, from h: the window hashes in the order of the text. Only a text with a
#: repeated hash is sorted; the sorted (hash, place) pairs show each window with an equal neighbour, and a window
#: adds the words that the one before it has not covered.
_REPEATED = "if(size(array_distinct(h)) = size(h), 0L, " + _let(
    "array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))", "s", _let(
        "array_sort(filter(transform(s, (e, k) -> if((k > 0 AND s[k - 1].x = e.x)"
        " OR (k < size(s) - 1 AND s[k + 1].x = e.x), e.i, -1)), p -> p >= 0))", "places",
        "aggregate(places, named_struct('last', -3, 'n', 0L), (a, p) ->"
        " named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)")) + ")"


def _measures(text: str) -> str:
    """One struct of all measures of a text expression."""
    words = rf"if(btrim(t, ' \t\n\u000b\f\r') = '', array(), split(btrim(t, ' \t\n\u000b\f\r'), '[{BLANK}]+'))"
    windows = "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    lines = r"filter(split(t, '\n'), l -> btrim(l, ' \t\n\u000b\f\r') != '')"
    count = lambda pattern: f"cast(regexp_count(t, '{pattern}') AS bigint)"
    fields = {
        "n_words": "cast(size(w) AS bigint)",
        "word_chars": "cast(length(array_join(w, '')) AS bigint)",
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_marks": count(r"[!?]{2,}"),
        "n_capitals": count(r"\\p{Lu}"),
        "n_stop_words": f"cast(size(filter(w, x -> x IN ({_stop_list()}))) AS bigint)",
        "n_repeat_words": _let(windows, "h", _REPEATED),
        "n_lines": "cast(size(l) AS bigint)",
        "n_dup_lines": "cast(size(l) - size(array_distinct(l)) AS bigint)",
        "n_bullet_lines": r"cast(size(filter(l, x -> ltrim(x) rlike '^[-*•]')) AS bigint)",
        "n_ellipsis_lines": r"cast(size(filter(l, x -> rtrim(x) rlike '(…|[.]{3})$')) AS bigint)",
    }
    made = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return _let(f"coalesce({text}, '')", "t", _let(words, "w", _let(lines, "l", made)))


def _passes(rule: Rule) -> str:
    # Comparisons are multiplied out, so a ratio is exact at its bound and a ``per`` of 0 needs no division.
    value, per = f"m.{rule.measure}", f"m.{rule.per}" if rule.per else "1"
    parts = [f"{value} >= {rule.low}D * {per}"] if rule.low is not None else []
    parts += [f"{value} <= {rule.high}D * {per}"] if rule.high is not None else []
    return "(" + (" AND ".join(parts) or "true") + ")"


def rule_columns(text: str = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct column: ``m`` (the measures) and ``failed`` (names of the rules that the text breaks)."""
    failed = ", ".join(f"if({_passes(r)}, null, '{r.name}')" for r in rules)
    return F.expr(_let(_measures(f"`{text}`"), "m", f"named_struct('m', m, 'failed', array_compact(array({failed})))"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, kept and the names of the broken rules."""
    judged = docs.select(F.col(doc_id).alias("doc_id"), rule_columns(text, rules).alias("r"))
    m = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = F.expr("r.m.n_words < 50 OR 100 * r.m.n_repeat_words > 50 * r.m.n_words")
    return judged.select("doc_id", *[F.col(f"r.m.{c}") for c in m], base.alias("base_failed"),
                         (~base & (F.size("r.failed") == 0)).alias("kept"), F.col("r.failed").alias("failed_rules"))


def keep_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that break no rule, with all their columns."""
    name = hidden(docs, "rules")
    return docs.withColumn(name, rule_columns(text, rules)).where(F.size(f"{name}.failed") == 0).drop(name)
