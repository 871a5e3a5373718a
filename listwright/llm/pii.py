"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole candidate spans.

The base patterns always stay. Around digits and @ signs the text's parts between white space are the positions of a
semi-Markov chain: a segment is one part that is nothing, or up to ``LONGEST`` parts that are one entity. Features look at
the whole segment (digits, groups, Luhn sum, address parts, separators, the word before), and dynamic programming over
bounded segments chooses boundaries and types together. It finds what the patterns refuse or don't know: two card numbers in one run of
digits, phone numbers without a plus, secrets. What overlaps a base span is left to that.

The field is trained on a bounded sample: about ``SAMPLE`` documents, chosen by a hash of doc_id, of whose runs of
candidate parts ``EXAMPLES`` different ones teach, weighted by how often they occur. Their labels are the base spans and, for secrets, long mixed strings behind a
telling word. Everything else covers all documents and whole texts; all scans are linear in the length of a text.

Defined cases: null text is empty text and has no spans; a null doc_id teaches like any other; repeated rows are scanned each
for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from ast import literal_eval
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import map_rows, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LONGEST, SAMPLE, EXAMPLES, ROUNDS, RATE = 6, 6000, 250, 60, 0.5
#: Least probability of a segment the field adds to the base.
SURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PART = re.compile(r"\S+")
_FRONT, _BACK = re.compile(r"[A-Za-z0-9+(]"), re.compile(r"[^A-Za-z0-9)]+$")
_SECRET_WORD = re.compile(r"(?:token|secret|password|passwd|api_?key|key)[\"'=:]*$", re.IGNORECASE)
_SECRET = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_/+-]{20,}")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the pattern, found from the @ signs so that no text takes quadratic time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four numbers of a dotted chain are a match of the pattern; kept if none exceeds 255."""
    found = []
    for chain in _CHAIN.finditer(text):
        numbers = [(m.start() + chain.start(), m.end() + chain.start()) for m in re.finditer("[0-9]+", chain[0])]
        for i in range(0, len(numbers) - 3, 4):
            four = [text[a:b].lstrip("0") for a, b in numbers[i : i + 4]]
            if all(len(n) <= 3 and int(n or 0) <= 255 for n in four):
                found.append((numbers[i][0], numbers[i + 3][1]))
    return found


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """kind, start, end in code points, by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", a, b) for a, b in addresses(text)]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def runs(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of neighbouring parts with a digit or an @ sign: start and end without outer punctuation, and the text before."""
    if "@" not in text and not _DIGIT.search(text):
        return
    run: list[tuple[int, int, str]] = []
    before: list[str] = []
    for part in _PART.finditer(text):
        own = part[0]
        front = _FRONT.search(own) if "@" in own or _DIGIT.search(own) else None
        if front:
            back = _BACK.search(own)
            run.append((part.start() + front.start(), part.start() + (back.start() if back else len(own)), " ".join(before)))
        elif run:
            yield run
            run = []
        before = [*before[-1:], own[-16:]]
    if run:
        yield run


def features(text: str, start: int, end: int, before: str, parts: int) -> tuple[str, ...]:
    """What a whole segment looks like."""
    own = text[start:end]
    digits = _digits(own) if len(own) <= 64 else ""
    rest = set(own) - set("0123456789")
    letters = any(c.isalpha() for c in rest)
    found = ["all", f"digits {len(digits)}" if not letters else "letters", f"parts {parts}", "plus" if own[:1] == "+" else "no plus"]
    if not letters:
        found.append("marks " + "".join(sorted(rest)))
        found.append(("luhn " if digits and luhn(digits) else "no luhn ") + ("card length" if 16 <= len(digits) <= 19 else "other length"))
        found.append("groups " + " ".join(str(len(g)) for g in re.findall("[0-9]+", own)[:8]))
        if addresses(own) == [(0, len(own))]:
            found.append("address")
    elif emails(own) == [(0, len(own))]:
        found.append("mail")
    elif _SECRET.fullmatch(own):
        found.append(f"mixed {min(len(own), 48) // 8} {'hex' if re.fullmatch('[0-9a-fA-F]+', own) else 'other'}")
    if _SECRET_WORD.search(before.replace(" ", "").rstrip("=:\"' ")):
        found.append("secret word")
    return tuple(found)


class Field:
    """Weights of (feature, kind) and of moves between the kinds of neighbouring segments; kind 0 is nothing."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, segments: dict[tuple[int, int], tuple[str, ...]]) -> dict[tuple[int, int], np.ndarray]:
        none = np.zeros(len(KINDS))
        return {at: sum((self.weights.get(f, none) for f in names), none) for at, names in segments.items()}

    def messages(self, n: int, scores: dict[tuple[int, int], np.ndarray]):
        """Log weights of all ways up to and from each place, by the kind of the segment that ends there (or ended there)."""
        kinds = len(KINDS) + 1
        ahead, after = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
        ahead[0, 0], after[n] = 0.0, 0.0
        for end in range(1, n + 1):
            ways = []
            for start in range(max(0, end - LONGEST), end):
                into = np.logaddexp.reduce(ahead[start][:, None] + self.moves, axis=0)
                into[1:] += scores[start, end]
                into[0] = into[0] if end - start == 1 else -np.inf
                ways.append(into)
            ahead[end] = np.logaddexp.reduce(ways, axis=0)
        for start in range(n - 1, -1, -1):
            ways = []
            for end in range(start + 1, min(n, start + LONGEST) + 1):
                out = after[end].copy()
                out[1:] += scores[start, end]
                out[0] = out[0] if end - start == 1 else -np.inf
                ways.append(np.logaddexp.reduce(self.moves + out[None, :], axis=1))
            after[start] = np.logaddexp.reduce(ways, axis=0)
        return ahead, after

    def shares(self, n: int, scores) -> dict[tuple[int, int], np.ndarray]:
        """Probability of each kind for each segment of up to LONGEST parts (kind 0: nothing, single parts only)."""
        ahead, after = self.messages(n, scores)
        total = np.logaddexp.reduce(ahead[n])
        out = {}
        for (start, end), own in scores.items():
            into = np.logaddexp.reduce(ahead[start][:, None] + self.moves, axis=0) + after[end] - total
            into[1:] += own
            into[0] = into[0] if end - start == 1 else -np.inf
            out[start, end] = np.exp(into)
        return out

    def best(self, n: int, scores) -> list[tuple[int, int, int]]:
        """The segments (start, end, kind) of the best labelling that are entities."""
        kinds = len(KINDS) + 1
        value, back = np.full((n + 1, kinds), -np.inf), {}
        value[0, 0] = 0.0
        for end in range(1, n + 1):
            for start in range(max(0, end - LONGEST), end):
                ways = value[start][:, None] + self.moves
                came = ways.argmax(axis=0)
                into = ways.max(axis=0)
                into[1:] += scores[start, end]
                for kind in range(kinds):
                    if (kind or end - start == 1) and into[kind] > value[end, kind]:
                        value[end, kind] = into[kind]
                        back[end, kind] = start, int(came[kind])
        out, end, kind = [], n, int(value[n].argmax())
        while end:
            start, came = back[end, kind]
            if kind:
                out.append((start, end, kind))
            end, kind = start, came
        return out[::-1]


def segments(text: str, run: list[tuple[int, int, str]]) -> dict[tuple[int, int], tuple[str, ...]]:
    return {(i, j): features(text, run[i][0], run[j - 1][1], run[i][2], j - i) for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST) + 1)}


def _gold(text: str, run: list[tuple[int, int, str]], base: list[Span]) -> tuple[tuple[int, int, int], ...]:
    """The base spans, and secrets behind a telling word, as segments of a run."""
    out: list[tuple[int, int, int]] = []
    taken: set[int] = set()
    for kind, start, end in base:
        own = [i for i, (a, b, _) in enumerate(run) if a < end and start < b]
        if own and len(own) <= LONGEST and not taken & set(own):
            taken |= set(own)
            out.append((own[0], own[-1] + 1, KINDS.index(kind) + 1))
    for i, (a, b, before) in enumerate(run):
        if i not in taken and _SECRET.fullmatch(text[a:b]) and "secret word" in features(text, a, b, before, 1):
            out.append((i, i + 1, KINDS.index("secret") + 1))
    return tuple(sorted(out))


def _examples(docs: DataFrame, sample: int) -> list[tuple[int, dict, tuple, int]]:
    """(parts, features of the segments, gold segments, count) of the most frequent runs of the bounded sample."""
    cut = min(1.0, sample / max(1, docs.count())) * 2**31
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < cut).select("text")

    def make():
        def work(texts):
            rows = []
            for text in texts:
                base = base_spans(text or "")
                for run in runs(text or ""):
                    if len(run) <= 2 * LONGEST:  # longer runs repeat what shorter ones teach
                        near = [s for s in base if s[1] < run[-1][1] and run[0][0] < s[2]]
                        rows.append((repr((len(run), sorted(segments(text, run).items()), _gold(text, run, near))),))
            yield rows

        return work

    rows = map_rows(chosen, make, "example string").groupBy("example").count().orderBy(F.desc("count"), "example").limit(EXAMPLES).collect()
    parsed = [(literal_eval(r["example"]), r["count"]) for r in rows]
    return [(n, dict(own), gold, count) for (n, own, gold), count in parsed]


def fit(examples: list[tuple[int, dict, tuple, int]]) -> Field:
    """Maximum likelihood by gradient steps (Adagrad) over the examples, each weighted by the logarithm of its count."""
    field = Field()
    field.weights = {f: np.zeros(len(KINDS)) for _, own, _, _ in examples for names in own.values() for f in names}
    seen = {f: np.full(len(KINDS), 1e-6) for f in field.weights}
    seen_moves = np.full_like(field.moves, 1e-6)
    for _ in range(ROUNDS):
        slope = {f: -1e-3 * w for f, w in field.weights.items()}
        moved = -1e-3 * field.moves
        for n, own, gold, count in examples:
            weight = np.log1p(count)
            scores = field.scores(own)
            shares = field.shares(n, scores)
            truth = {(a, b): k for a, b, k in gold}
            for at, names in own.items():
                rest = -weight * shares[at][1:]
                if at in truth:
                    rest[truth[at] - 1] += weight
                for f in names:
                    slope[f] = slope[f] + rest
            path = [0]
            at = 0
            while at < n:
                step = next(((b, k) for a, b, k in gold if a == at), (at + 1, 0))
                moved[path[-1], step[1]] += weight
                path.append(step[1])
                at = step[0]
            ahead, after = field.messages(n, scores)
            total = np.logaddexp.reduce(ahead[n])
            for (start, end), own_scores in scores.items():
                into = after[end].copy()
                into[1:] += own_scores
                into[0] = into[0] if end - start == 1 else -np.inf
                moved -= weight * np.exp(ahead[start][:, None] + field.moves + into[None, :] - total)
        for f, s in slope.items():
            seen[f] = seen[f] + s * s
            field.weights[f] = field.weights[f] + RATE * s / np.sqrt(seen[f])
        seen_moves += moved**2
        field.moves = field.moves + RATE * moved / np.sqrt(seen_moves)
    return field


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    return fit(_examples(docs, sample))


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and what the field adds), by kind as listed, then start."""
    base = base_spans(text)
    covered = sorted((a, b) for _, a, b in base)
    added: list[Span] = []
    for run in runs(text):
        open_at = _open(run, covered)
        if not any(open_at):
            continue
        own = segments(text, run)
        scores = field.scores(own)
        shares = None
        for start, end, kind in field.best(len(run), scores):
            if all(open_at[start:end]):
                shares = shares or field.shares(len(run), scores)
                if shares[start, end][kind] >= SURE:
                    added.append((KINDS[kind - 1], run[start][0], run[end - 1][1]))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _open(run: list[tuple[int, int, str]], covered: list[tuple[int, int]]) -> list[bool]:
    """Which parts no base span touches: the farthest end of the spans that start before the part's end decides."""
    starts = np.array([a for a, _ in covered])
    if not covered:
        return [True] * len(run)
    farthest = np.maximum.accumulate([b for _, b in covered])
    return [(k := int(np.searchsorted(starts, b))) == 0 or farthest[k - 1] <= a for a, b, _ in run]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, counts of the base spans, base_sha256, spans, n_spans (all of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def work(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                base, every = all_spans(text or "", shared.value)
                counts = Counter(kind for kind, _, _ in base)
                rows.append((doc_id, *(counts[k] for k in BASE), sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            yield rows

        return work

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def redacted(text: str | None, field: Field) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    if not text:
        return text
    out, free = [], 0
    spans = sorted(all_spans(text, field)[1], key=lambda s: (s[1], -s[2]))
    for i, (kind, start, end) in enumerate(spans):
        if start >= free:
            out.append(text[free:start] + f"[{kind.upper()}]")
        free = max(free, end)
    return "".join(out) + text[free:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The documents, all columns, with personal data replaced in ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, shared.value) for t in texts], dtype=object)

    return docs.select(*(clean(F.col(c)).alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns))
