"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the whole texts gives each document ``STATISTICS``. Scaled to mean 0 and deviation 1 over the labelled rows, they
are mapped to ``FEATURES`` cosines of random projections, whose inner products approximate a Gaussian kernel of width
``WIDTH``. Ridge weights solve the normal equations, which every task sums over its labelled rows and the cluster sums
over tasks; only the sums (of fixed size) reach the driver. Raw scores are calibrated by isotonic regression over counts in ``BINS``
fixed bins of the score, again of fixed size; the scores it sees come from weights solved without the row's own of ``FOLDS`` parts. A share of ``RANKING`` of the score rises with the raw
score, so documents of one isotonic level are ranked as well. All labelled rows are used.

Defined cases: null text is empty text and is scored like any other; labels that are null or whose doc_id is null or
missing teach nothing, a doc_id labelled several times teaches once per label; without labels every score is 0.5; repeated
rows get the same score; other columns are ignored; an empty table gives no rows. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import add_up, map_rows
from listwright.session import stage

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "letters", "digits", "upper", "spaces", "stops", "shouts", "symbols", "bars", "other",
    "distinct", "top_word", "repeats", "line_words", "repeated_lines", "short_words", "long_words", "symbol_words", "cased_words",
)
#: WIDTH and RIDGE by cross-validation over labelled rows that are not held out.
FEATURES, WIDTH, RIDGE, BINS, CLIP, FOLDS = 384, 9.0, 1e-5, 2048, 6.0, 4
#: Share of the score that rises with the raw score, so documents of one isotonic level keep their order.
RANKING = 0.02
THRESHOLD = 0.3
#: Classes of bytes: letters (all of a non-ASCII letter's bytes too), digits, upper case, white space, sentence marks, shouts, bars, other symbols, quotes and hyphens.
_CLASS = bytes(
    2 if 65 <= b <= 90 else 0 if 97 <= b <= 122 or b >= 128 else 1 if 48 <= b <= 57 else 3 if b in b" \t\n\r\x0b\x0c" else 4 if b in b".,;:?" else 5 if b == 33 else 6 if b == 124 else 8 if b in b"'\"-()" else 7
    for b in range(256)
)
_SYMBOLS = bytes(b for b in range(33, 127) if _CLASS[b] in (5, 6, 7))


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw.translate(_CLASS), np.uint8), minlength=9) / size
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    marked = sum(c for w, c in counts.items() if len(w.translate(None, _SYMBOLS)) < len(w))
    cased = sum(c for w, c in counts.items() if w[:1].isupper())
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    top = max(counts.values(), default=0) / n
    return np.array([
        log1p(len(raw)), log1p(len(words)), lengths.mean(), lengths.std(), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[7], kinds[6], kinds[8],
        log1p(len(counts)) / log1p(n), top, repeats / n, log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), (lengths <= 3).mean(), (lengths >= 14).mean(), marked / n, cased / n,
    ])


class Kernel:
    """Scaling of the statistics and the random projections."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float):
        random = np.random.default_rng(7)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = random.normal(size=(len(mean), features)) / width
        self.phases = random.uniform(0, 2 * np.pi, features)

    def features(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.deviation, -CLIP, CLIP)
        cosines = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(rows), 1))])


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Non-decreasing means of consecutive bins (pool adjacent violators); empty bins take the value of the bin before."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(weights):
        blocks.append([sums[i], weights[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, _ = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
    out = np.full(len(weights), 0.5)
    for total, weight, start in blocks:
        out[int(start) if start != blocks[0][2] else 0 :] = total / weight
    return out


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, len(STATISTICS))


def _sums(labelled: DataFrame, per_batch) -> dict[int, np.ndarray]:
    """Adds up the arrays ``per_batch(statistics, labels, parts)`` gives by chunk, over batches, tasks and the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = per_batch(_matrix(batch.column(0)), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"chunk": list(range(len(total))), "values": [row.tobytes() for row in total]}, schema=pa.schema([("chunk", pa.int64()), ("values", pa.binary())]))

    part = F.pmod(F.xxhash64("statistics"), F.lit(FOLDS)).cast("int")
    return add_up(labelled.select("statistics", F.col("quality").cast("int"), part).mapInArrow(run, "chunk long, values binary"), "<f8")


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE):
    """The scorer of rows of statistics, learned from columns statistics and quality (0 or 1); None without rows."""
    moments = _sums(labelled, lambda x, y, part: np.array([np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)]))
    if not moments:
        return None
    n, mean = moments[0][0], moments[1] / moments[0]
    kernel = Kernel(mean, np.sqrt(np.maximum(0, moments[2] / moments[0] - mean**2)), features, width)

    def normal(x, y, part):
        z = kernel.features(x)
        each = (part == k for k in range(FOLDS))
        return np.vstack([np.vstack([z[own].T @ z[own], y[own] @ z[own], np.full(z.shape[1], own.sum())]) for own in each])

    sums = _sums(labelled, normal)
    parts = np.array([sums[i] for i in range(len(sums))]).reshape(FOLDS, -1, len(sums[0]))

    def solve(total):
        return np.linalg.solve(total[:-2] + ridge * max(1.0, total[-1, 0]) * np.eye(total.shape[1]), total[-2])

    weights = solve(parts.sum(axis=0))
    without = np.array([solve(parts.sum(axis=0) - p) for p in parts])

    def count(x, y, part):
        at = _bin((kernel.features(x) * without[part]).sum(axis=1))
        return np.array([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)], float)

    seen = _sums(labelled, count)
    levels = isotonic(seen[0], seen[1])

    def calibrated(x):
        raw = kernel.features(x) @ weights
        return (1 - RANKING) * levels[_bin(raw)] + RANKING * np.clip((raw + 0.5) / 2, 0, 1)

    return calibrated


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted. Rows with ``held_out`` (a column over doc_id) teach nothing."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make():
        def work(ids, texts):
            for i in range(0, len(ids), 2_000):
                yield [(d, statistics(t).tobytes()) for d, t in zip(ids[i : i + 2_000], texts[i : i + 2_000])]

        return work

    rows = stage(map_rows(texts, make, "doc_id long, statistics binary").withColumn("held_out", F.coalesce(held_out, F.lit(False))), "quality-statistics")
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    labelled = stage(rows.where(~F.col("held_out")).join(known, "doc_id").select("statistics", "quality"), "quality-labelled")
    model = fit(labelled)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model(_matrix(batch.column(2))) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    out = rows.select("doc_id", "held_out", "statistics").mapInArrow(predict, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
