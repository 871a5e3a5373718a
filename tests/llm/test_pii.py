import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = st.text("ab.@-%+ 0129()\n", max_size=60) | st.lists(st.sampled_from(["1.2.3.4", "999.1.1.1", ".5", "4539578763621486", " ", "-", "+1 (017) 555-7713", "a@b.c", "@d.e", "+", "0", "x", "2390409500648960"]), max_size=8).map("".join)


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def luhn(numbers):
    total = 0
    for i, d in enumerate(reversed(numbers)):
        total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=500)
@given(TEXTS)
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "a." * 100_000 + "@", "1" * 200_000, "1." * 100_000, "+" + "1 " * 100_000, "@" * 100_000, "1@" * 50_000, "+1(" * 50_000])
def test_long_texts_take_linear_time(text):
    assert pii.base_spans(text) is not None


def random_field():
    random = np.random.default_rng(3)
    field = pii.Field()
    field.moves = random.normal(size=field.moves.shape)
    return field, random


@pytest.mark.parametrize("n", [1, 3, 4])
def test_dynamic_programming_equals_all_labellings(n, monkeypatch):
    monkeypatch.setattr(pii, "LONGEST", 2)
    field, random = random_field()
    scores = {(i, j): random.normal(size=len(pii.KINDS)) for i in range(n) for j in range(i + 1, min(n, i + 2) + 1)}

    def ways(at):
        if at == n:
            yield ()
        for end in range(at + 1, min(n, at + 2) + 1):
            for kind in range(len(pii.KINDS) + 1):
                if kind or end == at + 1:
                    for rest in ways(end):
                        yield ((at, end, kind), *rest)

    def weight(way):
        return sum(scores[a, b][k - 1] for a, b, k in way if k) + sum(field.moves[x, y] for x, y in itertools.pairwise([0, *(k for *_, k in way)]))

    everything = list(ways(0))
    assert field.best(n, scores) == [s for s in max(everything, key=weight) if s[2]]
    total = sum(np.exp(weight(w)) for w in everything)
    shares = field.shares(n, scores)
    for at, got in shares.items():
        for kind in range(len(pii.KINDS) + 1):
            want = sum(np.exp(weight(w)) for w in everything if (*at, kind) in w) / total
            assert got[kind] == pytest.approx(want)


CARDS = [str(n) for n in range(4539578763621400, 4539578763621440) if luhn(digits(str(n)))]


def corpus():
    rows = []
    for i in range(60):
        rows.append((i, f"plain words {i} and {i}.5 more w@ords a.{i}@mail{i % 9}.example.com then {CARDS[i % 3]} or +1 ({100 + i}) 555-{1000 + i} at 10.{i}.3.{i} end token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" x"))
    return rows


def test_finds_what_the_patterns_miss_and_keeps_the_base(spark):
    two = f"pay {CARDS[0]} {CARDS[1]} now"
    rows = [(i, t, 1) for i, t in corpus()] + [(100, None, 1), (101, "", 1), (102, two, 1), (103, "clean words only", 1), (None, "me@x.yz", 1), (104, "a@b.c a@b.c", 1), (104, "a@b.c a@b.c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ip int").repartition(3)
    field = pii.learn(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, field).collect()}
    for i, text, _ in rows:
        base = brute(text or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and {(k, str(a), str(b)) for k, a, b in base} <= {tuple(s.split(":")) for s in r["spans"].split(",")}
    assert got[102]["n_card"] == 0 and got[102]["spans"] and set(got[102]["spans"].split(",")) <= {"card:4:20", "card:21:37"}
    assert got[103]["spans"] == "" and got[101]["spans"] == "" and got[100]["n_email"] == 0
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in got.values())
    assert "secret:" in got[7]["spans"]
    clean = pii.redact(docs, field)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "[CARD]" in texts[102] and texts[100] is None and texts[103] == "clean words only" and texts[104] == "[EMAIL] [EMAIL]"


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    field = pii.learn(empty)
    assert pii.find(empty, field).count() == 0 and pii.redact(empty, field).count() == 0
    assert pii.all_spans("a@b.c 12", field)[1] == [("email", 0, 5)]
