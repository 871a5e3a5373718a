import re

import pytest
from brute import LOWER

from listwright.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HEADERS = {label: text for label, text, _ in license_scan.NOTICES}


def tokens(words):
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    words = split(text)
    base = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found, (block, step) = [], license_scan.blocking()
    for k in range(0, max(1, len(words) - block + step), step):
        held = tokens(words[k : k + block])
        for label, notice, telling in license_scan.NOTICES:
            wanted = tokens(split(notice))
            if len(wanted & held) / len(wanted) >= license_scan.CONTAINMENT - 1e-9 and held.issuperset(telling):
                found.append((len(wanted & held) / len(wanted), label))
    at = [i for i, _ in base]
    known = {label for _, label in base}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(known)), ",".join(sorted(known | {x for _, x in found})), 1.0 if base else max((c for c, _ in found), default=0.0)


def labels(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r["labels"] for r in rows.orderBy("doc_id").collect()]


def test_equals_brute_force(spark):
    longest = license_scan.blocking()[1]
    texts = [None, "", " .,; ", "word", "MIT License", "mit-LICENSE mit license", "the cc BY by", "Ünï GNU General Public License!", HEADERS["mit"].upper(), " ".join(reversed(HEADERS["gpl"].split())), "x " * 47 + HEADERS["mit"], "y " * 200_000 + HEADERS["bsd"] + " z" * 70]
    texts += [" ".join(n.split()[: len(n.split()) * keep // 100]) for n in HEADERS.values() for keep in (95, 85, 80, 75)]
    texts += [f"{'pad ' * k}{HEADERS['lgpl']}{' pad' * k}" for k in (1, longest - 1, longest, longest + 1, 2 * longest, 5 * longest // 2)]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(0, "apache license apache license", "x"), (None, "apache license", "x")]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string, labels string").repartition(3)).drop("blocks").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d, *brute(t)) for d, t, _ in docs), key=repr)


def test_headers_are_found_with_comment_marks_and_small_changes(spark):
    texts = []
    for text in HEADERS.values():
        words = text.split()
        texts += ["/*\n * " + "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n */", " ".join(w for i, w in enumerate(words) if i != len(words) - 3)]
    expected = [{label, *brute(text)[4].split(",")} - {""} for label, text in HEADERS.items() for _ in range(2)]
    assert [set(x.split(",")) for x in labels(spark, texts)] == expected


@pytest.mark.parametrize("foreign", [
    "Released under the Apache License",
    "Released under the BSD License together with mit tools",
    "Mozilla Public License version 2.0",
    "Der Text steht mit freundlicher Genehmigung unter der Apache License, Version 2.0, mit allen Rechten und mit the software released under the license",
    "Licensed under the GNU General Public License version 2.0, mit Ausnahmen",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions",
    " ".join(sorted(HEADERS["mit"].split())),
])
def test_other_texts_get_the_base_labels_only(spark, foreign):
    assert labels(spark, [foreign]) == [brute(foreign)[4]]


def test_gnu_licenses_are_told_apart(spark):
    assert labels(spark, [HEADERS["lgpl"], HEADERS["agpl"], HEADERS["gpl"].replace("version 3", "version 2")]) == ["lgpl", "agpl", "gpl"]


def test_empty(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
