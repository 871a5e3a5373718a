"""License scan: fixed phrases, and an exact set-similarity join between text blocks and license headers.

Words are runs of digits, a-z and non-ASCII letters after A-Z is lower-cased. The tokens of the join are pairs of neighbouring
words, so order and adjacency count. The words of a text are cut into overlapping blocks, sized by the longest header so that a
passage one and a half times as long lies whole in some block. A block matches a header when it holds at least ``CONTAINMENT`` of the header's
different tokens, among them each of those that tell this license from others with much the same words. The join is exact:

* header tokens are ordered by the number of documents that hold them in the whole corpus, rarest first;
* prefix filter: a matching block holds one of the first ``size - need + 1`` tokens of the header;
* length filter: it holds at least ``need`` header tokens at all;
* positional filter: if the first token found is number i of the header, at most ``size - i`` tokens can be shared.

Only the headers' tokens (a fixed vocabulary) are counted and broadcast, so nothing broadcast grows with the corpus.

Defined cases: null text is empty text; a text without words has no blocks; repeated rows are scanned each for itself;
other columns are ignored; an empty table gives no rows. Documents are scanned whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import map_rows

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The headers as the licenses' owners publish them.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."
)
#: (label, header, tokens that a match must hold)
NOTICES = (
    ("agpl", _GNU.format("Affero General"), ("affero general",)),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License '
        'at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license", "version 2"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("binary forms", "following disclaimer"),
    ),
    (
        "cc-by",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send "
        "a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        ("attribution 4",),
    ),
    ("gpl", _GNU.format("General"), ("gnu general",)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        ("without fee",),
    ),
    ("lgpl", _GNU.format("Lesser General"), ("lesser general",)),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        ("deal in",),
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        ("mozilla public",),
    ),
)
CONTAINMENT = 0.8
#: Every byte that is no word character becomes a space, A-Z is lower-cased.
_CLEAN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<first:long, words:long, label:string, containment:double>>"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()


def pairs(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    return zip(words, words[1:])


def tokens_of(text: str) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(pairs(words_of(text)))


def blocking(notices=NOTICES) -> tuple[int, int]:
    """Words of a block and from one block to the next."""
    longest = max((len(words_of(text)) for _, text, _ in notices), default=1)
    return 5 * longest // 2, longest


def need(size: int, containment: float) -> int:
    return ceil(round(containment * size, 9))


def document_frequency(docs: DataFrame, notices=NOTICES) -> dict[tuple[bytes, bytes], int]:
    """In how many documents each token of the headers stands; counted over all documents."""
    vocabulary = frozenset().union(*(tokens_of(text) for _, text, _ in notices))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(vocabulary.intersection(pairs(words_of(text))))
        if seen:
            yield pd.DataFrame({"token": [b" ".join(t).decode() for t in seen], "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in vocabulary} | {tuple(r["token"].encode().split()): r["n"] for r in rows}


class Join:
    """The headers, ordered and indexed by their prefixes."""

    def __init__(self, frequency: dict[tuple[bytes, bytes], int], notices, containment: float):
        self.notices = []
        self.prefixes: dict[tuple[bytes, bytes], list[int]] = {}
        for label, text, telling in notices:
            order = sorted(tokens_of(text), key=lambda t: (frequency[t], t))
            least = need(len(order), containment)
            for t in order[: len(order) - least + 1]:
                self.prefixes.setdefault(t, []).append(len(self.notices))
            self.notices.append((label, order, least, frozenset(tuple(t.encode().split()) for t in telling)))
        self.rare = frozenset(self.prefixes)
        self.vocabulary = frozenset(frequency)

    def matches(self, words: list[bytes], block: int, step: int) -> list[tuple[int, int, str, float]]:
        """(first word, words, label, containment) of every block and header that match."""
        if self.rare.isdisjoint(pairs(words)):
            return []
        held: dict[int, set[tuple[bytes, bytes]]] = {}
        last = max(0, -(-(len(words) - block) // step))  # the last block reaches the end
        for at, t in enumerate(pairs(words)):
            if t in self.vocabulary:  # a block holds both words of the pair
                for k in range(max(0, (at + 1 - block) // step + 1), min(last, at // step) + 1):
                    held.setdefault(k, set()).add(t)
        found = []
        for k, tokens in sorted(held.items()):
            for n in sorted({n for t in tokens & self.rare for n in self.prefixes[t]}):
                label, order, least, telling = self.notices[n]
                first = next(i for i, t in enumerate(order) if t in tokens)
                if len(tokens) >= least and len(order) - first >= least and telling <= tokens and (shared := len(tokens.intersection(order))) >= least:
                    found.append((k * step, min(block, len(words) - k * step), label, shared / len(order)))
        return found


def places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    return [(i, label) for i, w in enumerate(words) for phrase, label in phrases if w == phrase[0] and words[i : i + len(phrase)] == phrase]


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document with the phrases' places, all labels, the highest containment (1 with a phrase) and the matching blocks."""
    frequency = document_frequency(docs, notices)
    block, step = blocking(notices)

    def make():
        join = Join(frequency, notices, containment)
        split = [(p.encode().split(), label) for p, label in phrases.items()]
        seconds = frozenset(p[-1] for p, _ in split)

        def work(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                words = words_of(text)
                base = [] if seconds.isdisjoint(words) else places(words, split)
                found = join.matches(words, block, step)
                at, known = [i for i, _ in base], {label for _, label in base}
                labels = known | {m[2] for m in found}
                score = 1.0 if base else max((m[3] for m in found), default=0.0)
                blocks = [dict(zip(("first", "words", "label", "containment"), m)) for m in found]
                rows.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(known)), ",".join(sorted(labels)), score, blocks))
            yield rows

        return work

    return map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, SCHEMA)
