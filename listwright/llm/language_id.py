"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language by forward-backward over the whole text, so code-switched text gets its words
labelled where they stand. Features of a word are its affixes, character n-grams and, for words frequent in the training
sample, the word itself, hashed to ``DIMENSIONS`` weights per language. Transitions between languages are learned with them by
maximum likelihood. The training sequences are spliced from runs of words of labelled documents, as code-switched text is.

The model is fitted on a bounded sample: about ``SAMPLE`` documents of a language, chosen by a hash of doc_id, and up to ``RUNS``
runs of ``RUN`` words spread evenly over each. Everything else covers all documents and whole texts.

The chain of a text is cut into blocks of ``STEP`` words whose transfer matrices are multiplied first, which gives the exact
messages at the cuts; then all blocks run forward and backward side by side.

Defined cases: null text, and text without a letter, is ``und`` with score 0; so is everything if no language could be learned. Null
lang teaches nothing, nor does a null doc_id. Ties go to the language first by code point; repeated rows get the same answer; other
columns are ignored; an empty table gives no rows. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import map_rows

UNKNOWN = "und"
DIMENSIONS, LETTERS = 1 << 15, 24
_MIX = np.uint64(0x9E3779B97F4A7C15)
SAMPLE, RUNS, RUN = 150, 8, 32
FREQUENT, ROUNDS, RATE, RIDGE, SWITCH = 3, 50, 0.15, 1e-4, 16
STEP, WORDS, KEPT = 16, 60_000, 200_000
#: Bound of the difference of a word's scores, so that products over a block stay within double precision.
SPAN = 30.0
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    return found if not any(w[0] > "\x7f" for w in found) else [w for w in found if any(map(str.isalpha, w))]


def _hashed(kind: int, *letters: np.ndarray) -> np.ndarray:
    mixed = np.full(letters[0].shape, kind, np.uint64)
    for part in letters:
        mixed = (mixed + part) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(DIMENSIONS)).astype(np.int32)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places of the weights, which of them hold) of each word: affixes of up to 3 letters, n-grams of 2 and 3 of its first
    LETTERS letters, its length and, from the lexicon, the word itself. All but the last are hashed, for all words at once."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.array(words, f"<U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    tail = np.array([w[-3:].rjust(3, "\0") for w in words], "<U3").view(np.uint32).reshape(len(words), 3).astype(np.uint64)
    two = _hashed(7, letter[:, :-1], letter[:, 1:])
    three = _hashed(8, letter[:, :-2], letter[:, 1:-1], letter[:, 2:])
    heads = [_hashed(k, *letter[:, :k].T) for k in (1, 2, 3)]
    tails = [_hashed(3 + k, *tail[:, 3 - k :].T) for k in (1, 2, 3)]
    size = _hashed(9, np.minimum(length, 12).astype(np.uint64))
    own = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    places = np.column_stack([*heads, *tails, size, DIMENSIONS + np.maximum(own, 0), two, three])
    seen = np.minimum(length, LETTERS)[:, None]
    enough = [length >= k for k in (1, 2, 3)]
    return places, np.column_stack([*enough, *enough, np.ones(len(words), bool), own >= 0, np.arange(2, LETTERS + 1) <= seen, np.arange(3, LETTERS + 1) <= seen])


def _softened(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -SPAN))


class Chain:
    """Weights of the features and log transitions between the languages; the state before the first word is unknown."""

    def __init__(self, languages: list[str], lexicon: list[str]):
        n = len(languages)
        self.languages, self.lexicon = languages, {w: i for i, w in enumerate(lexicon)}
        self.weights, self.moves = np.zeros((DIMENSIONS + len(lexicon) + 1, n)), np.zeros((n, n))

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words, each taken alone."""
        out = np.empty((len(words), len(self.languages)))
        for at in range(0, len(words), 4096):
            places, held = features(words[at : at + 4096], self.lexicon)
            out[at : at + 4096] = self.weights[np.where(held, places, -1)].sum(axis=1)  # the last row stays 0
        return out

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each language at each word of texts laid end to end, ``lengths`` words each (all above 0)."""
        n, count = scores.shape[1], -(-lengths // STEP)
        first_block, first_word = np.cumsum(count) - count, np.cumsum(lengths) - lengths
        text = np.repeat(np.arange(len(lengths)), count)
        nth = np.arange(count.sum()) - first_block[text]
        size = np.minimum(STEP, lengths[text] - nth * STEP)
        valid = np.arange(STEP) < size[:, None]
        at = np.where(valid, (first_word[text] + nth * STEP)[:, None] + np.arange(STEP), 0)
        emit = _softened(scores)[at]
        move = np.exp(self.moves - self.moves.max())
        transfer = np.broadcast_to(np.eye(n), (len(text), n, n)).copy()
        for t in range(STEP):
            own = valid[:, t]
            transfer[own] = (transfer[own].reshape(-1, n) @ move).reshape(-1, n, n) * emit[own, t][:, None, :]
        transfer /= transfer.max(axis=(1, 2), keepdims=True)
        # What reaches a block from its left (before the move into it) and from its right.
        left, right = np.ones((len(text), n)), np.ones((len(text), n))
        deepest = int(count.max())
        by_depth = [np.flatnonzero(count > k) for k in range(deepest)]
        for k in range(1, deepest):
            blocks = first_block[by_depth[k]] + k
            message = np.einsum("bi,bij->bj", left[blocks - 1], transfer[blocks - 1])
            left[blocks] = message / message.sum(axis=1, keepdims=True)
        for k in range(deepest - 2, -1, -1):
            blocks = first_block[by_depth[k + 1]] + k
            message = np.einsum("bij,bj->bi", transfer[blocks + 1], right[blocks + 1])
            right[blocks] = message / message.sum(axis=1, keepdims=True)
        forward = np.empty((len(text), STEP, n))
        message = left
        for t in range(STEP):
            message = (message @ move) * emit[:, t]
            message = np.where(valid[:, t, None], message / np.maximum(message.sum(axis=1, keepdims=True), 1e-300), message)
            forward[:, t] = message
        out = np.empty_like(scores)
        message = right
        for t in range(STEP - 1, -1, -1):
            own = valid[:, t]
            both = forward[own, t] * message[own]
            out[at[own, t]] = both / both.sum(axis=1, keepdims=True)
            back = (emit[own, t] * message[own]) @ move.T
            message = message.copy()
            message[own] = back / back.sum(axis=1, keepdims=True)
        return out


def _sample(docs: DataFrame, learn: Column) -> dict[str, list[list[str]]]:
    """Runs of words by language from the bounded sample of the documents that may teach."""
    teaching = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in teaching.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    cuts = docs.sparkSession.createDataFrame([(lang, min(1.0, SAMPLE / n) * 2**31) for lang, n in sizes.items()], "lang string, cut double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    chosen = teaching.where("text is not null").join(F.broadcast(cuts), "lang").where(place < F.col("cut")).select("lang", "doc_id", "text")

    def make():
        def work(langs, ids, texts):
            rows = []
            for lang, doc_id, text in zip(langs, ids, texts):
                words = words_of(text)
                last = max(0, len(words) - RUN)
                starts = sorted({i * last // max(1, RUNS - 1) for i in range(RUNS)})
                rows += [(lang, doc_id, at, " ".join(words[at : at + RUN])) for at in starts if words]
            yield rows

        return work

    runs: dict[str, list[list[str]]] = {}
    for row in sorted(map(tuple, map_rows(chosen, make, "lang string, doc_id long, at long, words string").collect())):
        runs.setdefault(row[0], []).append(row[3].split(" "))
    return runs


def _spliced(runs: dict[str, list[list[str]]], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """As many sequences as runs, of RUN words each, whose language changes about every SWITCH words."""
    random = np.random.default_rng(11)
    words: list[str] = []
    labels: list[int] = []
    for _ in range(sum(map(len, runs.values()))):
        left = RUN
        while left:
            lang = int(random.integers(len(languages)))
            own = runs[languages[lang]]
            run = own[int(random.integers(len(own)))]
            at = int(random.integers(len(run)))
            part = run[at : at + min(left, int(random.geometric(1 / SWITCH)))]
            words += part
            labels += [lang] * len(part)
            left -= len(part)
    return words, np.array(labels).reshape(-1, RUN)


def fit(runs: dict[str, list[list[str]]]) -> Chain | None:
    """Maximum likelihood by full-batch gradient steps (Adam); None without training text."""
    languages = sorted(runs)
    if not languages:
        return None
    words, labels = _spliced(runs, languages)
    counts = Counter(words)
    types = sorted(counts)
    chain = Chain(languages, [w for w in types if counts[w] >= FREQUENT])
    place = {w: i for i, w in enumerate(types)}
    ids = np.fromiter((place[w] for w in words), int, len(words))
    places, held = features(types, chain.lexicon)
    flat, sizes = places[held], held.sum(axis=1)
    edges, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(types)), sizes)
    n, count = len(languages), len(labels)
    gold = np.eye(n)[labels]
    seen_moves = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    first = {k: np.zeros_like(v) for k, v in (("w", chain.weights), ("m", chain.moves))}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    for step in range(1, ROUNDS + 1):
        emit = _softened(np.add.reduceat(chain.weights[flat], edges, axis=0))[ids].reshape(count, RUN, n)
        move = np.exp(chain.moves - chain.moves.max())
        forward, message = np.empty_like(emit), np.ones((count, n))
        for t in range(RUN):
            message = (message @ move) * emit[:, t]
            forward[:, t] = message = message / message.sum(axis=1, keepdims=True)
        expected, moved, message = np.empty_like(emit), np.zeros((n, n)), np.ones((count, n))
        for t in range(RUN - 1, -1, -1):
            both = forward[:, t] * message
            expected[:, t] = both / both.sum(axis=1, keepdims=True)
            into = emit[:, t] * message
            if t:
                pair = forward[:, t - 1, :, None] * move * into[:, None, :]
                moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            message = into @ move.T
            message /= message.sum(axis=1, keepdims=True)
        rest = (gold - expected).reshape(-1, n)
        by_type = np.stack([np.bincount(ids, rest[:, i], len(types)) for i in range(n)], axis=1)
        slope = {"w": np.stack([np.bincount(flat, by_type[owner, i], len(chain.weights)) for i in range(n)], axis=1) / count - RIDGE * chain.weights, "m": (seen_moves - moved) / count}
        for key, value in (("w", chain.weights), ("m", chain.moves)):
            first[key] = 0.9 * first[key] + 0.1 * slope[key]
            second[key] = 0.99 * second[key] + 0.01 * slope[key] ** 2
            value += RATE * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-8)
    return chain


def learn(docs: DataFrame, may_teach: Column) -> Chain | None:
    return fit(_sample(docs, may_teach))


class Labeller:
    """Labels texts; scores of words are kept in a bounded table."""

    def __init__(self, chain: Chain | None):
        self.chain, self.known = chain, {}
        self.table = np.empty((0, 0))

    def _ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if new and len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(set(words))
        if new:
            start = len(self.known)
            if len(self.table) < start + len(new):
                self.table = np.vstack([self.table.reshape(-1, len(self.chain.languages))[:start], np.empty((max(start, len(new)), len(self.chain.languages)))])
            self.table[start : start + len(new)] = self.chain.score(new)
            self.known.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), int, len(words))

    def _shares(self, texts: list[list[str]]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        ids = self._ids([w for t in texts for w in t])
        posterior = self.chain.posteriors(self.table[ids], lengths)
        return np.add.reduceat(posterior, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, mean probability of that language over the words) of each text."""
        waiting, words_waiting = [], 0
        for at, text in enumerate(texts):
            waiting.append(words_of(text) if self.chain else [])
            words_waiting += len(waiting[-1])
            if at + 1 == len(texts) or words_waiting > WORDS:
                full = [w for w in waiting if w]
                shares = iter(self._shares(full)) if full else iter(())
                for words in waiting:
                    if not words:
                        yield UNKNOWN, 0.0
                        continue
                    share = next(shares)
                    best = int(share.argmax())
                    yield self.chain.languages[best], min(1.0, float(share[best]))
                waiting, words_waiting = [], 0


def predict(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        labeller = Labeller(shared.value)

        def work(ids, texts):
            yield [(doc_id, *found) for doc_id, found in zip(ids, labeller.label(texts))]

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, chain: Chain | None, least: float) -> DataFrame:
    """The documents whose language is known with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(shared.value)
        for texts in batches:
            yield pd.Series([lang != UNKNOWN and score >= least for lang, score in labeller.label(texts.tolist())], dtype=bool)

    return docs.where(keep("text"))
