"""Personal data (op12): the rules against plain patterns, the field against enumeration and planted cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from edge_cases import docs, empty, texts

from cartlane.llm import skip_chain as S
from cartlane.llm.common import ship_package


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    out = [(m.start(), k, m.end()) for k, (kind, (pattern, ok)) in enumerate(rules.items(), 1)
           for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def test_base_rules_match_plain_patterns():
    r = random.Random(3)
    pieces = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (170) 123-4567", "+1",
              ".", "-", " ", "9", "55", "007", "é", "\n", "@@", "+", "(", ")", "%", "12345678901234567890123", "_"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert S.base_spans(text) == brute_base(text), text
    for _, t in texts():
        assert S.base_spans(t or "") == brute_base(t or "")
    # Long runs take linear time.
    for run in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1" + "." * 300_000, "1 " * 150_000):
        assert isinstance(S.base_spans(run), list)


def model(texts_):
    counts = Counter()
    for t in texts_:
        S.count_features(t, counts)
    return S.field(counts)


CORPUS = ["write to jane.roe7@mail.example.org or +1 (988) 555-2485 now", "server 42.144.35.254 took 4111 1111 1111 1111 today",
          "version 3. of 12 rules, 2021-04-05", "call +49 170 1234567 before 5 pm"] * 30


def found(text, field):
    return [(S.KINDS[k - 1], text[a:b]) for a, k, b in S.all_spans(text, field)[1]]


def test_consistency_within_a_document():
    f = model(CORPUS)
    assert found("call +49 170 1234567 today. Later: 0170-1234567, please", f) == [
        ("phone", "+49 170 1234567"), ("phone", "0170-1234567")]
    assert found("to jane.roe7@mail.example.org, then jane.roe7 and jane.roe7@mail answered", f) == [
        ("email", "jane.roe7@mail.example.org"), ("email", "jane.roe7"), ("email", "jane.roe7@mail")]
    assert found("card 4111 1111 1111 1111 or 4111/1111/1111/1111.", f) == [
        ("card", "4111 1111 1111 1111"), ("card", "4111/1111/1111/1111")]
    # Far apart, and many times.
    text = "call +49 170 1234567 today. " + "word " * 3000 + " 0170-1234567 " + "x " * 2000 + "0170-1234567 " * 40
    assert Counter(found(text, f))["phone", "0170-1234567"] == 41


def test_clean_text_is_left_alone():
    f = model(CORPUS)
    for text in ("555-2485 and 988-555-2485 without any other", "4111/1111/1111/1111", "see 12.05.2021, 3.4 and 1234567890",
                 "call +49 170 1234567 on 2021-04-05 about 12 things, 4.0 of 300", "jane.roe7 wrote; info 42", ""):
        assert S.all_spans(text, f)[1] == S.all_spans(text, f)[0], text


def test_field_potentials_and_training():
    f, empty_field = model(CORPUS), model([])
    assert np.isfinite(f.shape).all() and np.isfinite(empty_field.pair).all()
    words = S.nodes(CORPUS[3], S.base_spans(CORPUS[3]))
    assert [w for w, s in zip(words.core, words.seen, strict=True) if s == S.PHONE] == ["+49", "170", "1234567"]
    local = f.local(words.shape[2], words.cue[2], (S.CARD, S.PHONE))
    assert all(S.LOCAL_FLOOR <= local[k] <= S.LOCAL_CAP for k in (S.PHONE, S.CARD)) and local[S.IP] == S._NEVER
    # Linked base words of different kinds weaken the skip potential.
    counts = Counter({(S.SKIP, 0, 0): 500, (S.SKIP, 0, 1): 100})
    assert S.field(counts).pair[1].max() < f.pair[1].max()


def test_messages_are_exact_on_trees(monkeypatch):
    monkeypatch.setattr(S, "ROUNDS", 60)
    r = np.random.default_rng(4)
    for _ in range(10):
        n = 5
        local = r.normal(size=(n, S.LABELS))
        pairs = np.array([(int(r.integers(0, k)), k) for k in range(1, n)])
        kinds, table = r.integers(0, 2, n - 1), r.normal(size=(2, S.LABELS, S.LABELS))
        want = np.zeros((n, S.LABELS))
        for labels in itertools.product(range(S.LABELS), repeat=n):
            score = sum(local[i, y] for i, y in enumerate(labels))
            score += sum(table[k][labels[a], labels[b]] for (a, b), k in zip(pairs, kinds, strict=True))
            for i, y in enumerate(labels):
                want[i, y] += np.exp(score)
        want /= want.sum(1, keepdims=True)
        assert S.marginals(local, pairs, kinds, table, r.random(n) < 0.5) == pytest.approx(want, abs=1e-6)


def test_edges_grow_with_the_words():
    text = "+49 170 1234567 " + "0170-1234567 " * 500
    words = S.nodes(text, S.base_spans(text))
    chain, skip = S.edges(words)
    assert len(chain) + len(skip) <= 6 * len(words.place)


def test_query_rows(spark):
    ship_package(spark)
    own = [(i, t) for i, t in texts()] + [(100 + k, t) for k, t in enumerate(CORPUS)] + [
        (500, "call +49 170 1234567 today. Later: 0170-1234567, please"), (501, "mail a_b9@x.yz 😀 then 1.2.3.4")]
    frame = spark.createDataFrame(own, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "'q' as spans", "1 as base")
    f = model([t or "" for _, t in own])
    want = []
    for i, t in own:
        base, every = S.all_spans(t or "", f)
        assert base == brute_base(t or "")
        kinds = Counter(k for _, k, _ in base)
        want.append((i, *(kinds[k] for k in range(1, 5)), hashlib.sha256(S.written_spans(base).encode()).hexdigest(), S.written_spans(every)))
    for n in (1, 6):
        got = [tuple(r) for r in S.digests(S.find_personal_data(frame.repartition(n))).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert S.find_personal_data(empty(spark)).count() == 0
    assert S.digests(S.find_personal_data(docs(spark))).count() == len(texts())
