"""Operator 8: a quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation estimates
each labeller's behaviour on good and on bad documents and the share of good ones, from the counts of vote
patterns over all documents (labellers are taken as independent given the quality). The posterior labels of at
most `sample_docs` documents (the first by a hash of key and text, each with the votes on its own text) train a hashed linear scorer over words, word shapes and
how often words repeat, which then scores every whole text.

Defined cases: a null or blank text has no words, so the labellers call it bad, and its score is that of the
bias alone with no feature, at most its posterior; repeated rows are scored one by one and learned from once, texts of a
repeated key each with their own votes; null keys are scored but not learned from; very long texts are read whole; a score
of just one half is kept; extra columns of any name take no part; an empty table gives an empty result. Hand-made
labels take no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, mark_of, sample_cutoff
from .quality_rules import STOP_WORDS

GOOD, BAD, NONE = "+", "-", "0"
LABELLERS = ("length", "symbols", "shouting", "case", "repetition", "stop_words", "word_length", "lines", "digits", "punctuation")
SLOTS = 1 << 16
#: Words over which distinct ones are counted: a long text has few of them for its length, however good it is.
SECTION = 2_000
_STOPS = frozenset(STOP_WORDS)


def _vote(good: bool, bad: bool) -> str:
    return BAD if bad else GOOD if good else NONE


def votes(text: str | None) -> str:
    """One character for each labeller: + good, - bad, 0 abstains."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return BAD + NONE * (len(LABELLERS) - 1)
    letters = sum(map(len, words))
    symbols = sum(map(text.count, "#*$%&|<>{}[]\\^~=_")) / chars
    shouts = text.count("!") / n
    upper = sum(map(str.isupper, words)) / n
    distinct = sum(len(set(words[i : i + SECTION])) for i in range(0, n, SECTION)) / n
    repeated = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2) if n > 2 else 0.0  # of the 3-word windows
    stops = sum(w in _STOPS for w in map(str.lower, words)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    digits = sum(map(text.count, "0123456789")) / chars
    ends = sum(w[-1] in ".,;:?" for w in words) / n
    mean = letters / n
    return "".join(
        _vote(good, bad)
        for good, bad in (
            (n >= 50, n < 5),
            (symbols < 0.005, symbols > 0.03),
            (shouts < 0.05, shouts > 0.3),
            (upper < 0.1, upper > 0.4),
            (distinct > 0.4 or n < 50, distinct < 0.2 or repeated > 0.5),
            (stops > 0.15, stops < 0.02),
            (2.5 < mean < 9, mean > 14 or mean < 1.5),
            (again < 0.1, again > 0.4),
            (digits < 0.05, digits > 0.2),
            (0.02 < ends < 0.4, ends < 0.001),
        )
    )


class LabelModel:
    """Share of good documents, and for each labeller the chances of each vote on good and on bad ones."""

    def __init__(self, patterns: dict[str, int], rounds: int = 100):
        names = sorted(patterns)
        count = np.array([patterns[p] for p in names], float)
        hot = np.array([[[c == v for v in (GOOD, NONE, BAD)] for c in p] for p in names], float).reshape(len(names), len(LABELLERS), 3)
        # At first a document is good as far as more labellers call it good than bad; one bad vote weighs as much as several good ones.
        lean = hot[:, :, 0].sum(axis=1) - 4 * hot[:, :, 2].sum(axis=1)
        good = 1 / (1 + np.exp(-lean))
        for _ in range(rounds):
            self.share = float((count @ good + 1) / (count.sum() + 2))
            self.chance = np.stack([(np.einsum("p,plv->lv", count * g, hot) + 0.1) / (count @ g + 0.3) for g in (good, 1 - good)])
            new = self._posterior(hot)
            if len(new) == 0 or np.abs(new - good).max() < 1e-9:
                break
            good = new

    def _posterior(self, hot: np.ndarray) -> np.ndarray:
        good, bad = (np.einsum("plv,lv->p", hot, np.log(c)) for c in self.chance)
        z = np.clip(good - bad + math.log(self.share / (1 - self.share)), -50, 50)
        return 1 / (1 + np.exp(-z))

    def posterior(self, pattern: str) -> float:
        return float(self._posterior(np.array([[[c == v for v in (GOOD, NONE, BAD)] for c in pattern]], float))[0])

    def accuracies(self) -> dict[str, float]:
        """Of the votes each labeller gives, the share that is right."""
        right = self.share * self.chance[0, :, 0] + (1 - self.share) * self.chance[1, :, 2]
        wrong = self.share * self.chance[0, :, 2] + (1 - self.share) * self.chance[1, :, 0]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist(), strict=True))


def shape(word: str) -> str:
    """The word's classes of characters, without repeats: `Abc!!` is `Xx!`."""
    out = []
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def slots(word: str) -> tuple[int, int]:
    """The word's own slot and that of its shape; the latter lie in the first sixteenth."""
    return SLOTS // 16 + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (SLOTS - SLOTS // 16), zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % (SLOTS // 16)


def marks(freq: Counter, n: int) -> list[int]:
    """Slots of what the words as a whole are like: how many, how distinct, how common the commonest is."""
    if not n:
        return []
    said = (f"size {n.bit_length()}", f"distinct {n.bit_length()} {10 * len(freq) // n}", f"top {10 * max(freq.values()) // n}")
    return [zlib.crc32(s.encode()) % (SLOTS // 16) for s in said]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = (text or "").split()
    own: Counter = Counter()
    freq = Counter(words)
    for w, n in freq.items():
        for s in slots(w):
            own[s] += n / len(words)
    for s in marks(freq, len(words)):
        own[s] += 1
    return np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), float, len(own))


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, passes: int = 6, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps on the log loss; both kinds of documents weigh the same."""
    w, seen, bias, seen_bias = np.zeros(SLOTS), np.full(SLOTS, 1e-4), 0.0, 1.0
    share = min(max(float(goal.mean()) if len(goal) else 0.5, 1e-3), 1 - 1e-3)
    for turn in range(passes):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            (at, x), y = rows[i], goal[i]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ x) + bias))))
            g = (p - y) * (0.5 / share * y + 0.5 / (1 - share) * (1 - y))
            step = g * x
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            seen_bias += g * g
            bias -= rate * g / math.sqrt(seen_bias)
    return w, bias


def _voting(batches: Iterator[list]) -> Iterator[tuple]:
    for texts in batches:
        yield ([votes(t) for t in texts],)


def quality_classifier(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 3_000) -> DataFrame:
    """key, votes, posterior, score (chance that the text is good) and kept (score >= 0.5), one row per row of docs."""
    body = F.col(f"`{text}`").cast("string")
    docs = docs.select(F.col(f"`{key}`").alias("id"), body.alias("text"), mark_of(F.col(f"`{key}`"), body).alias("mark"))
    voted = map_text(docs, [], "text", "votes string", _voting, "string")
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # three to the number of labellers at most
    model = LabelModel(patterns)

    def featurise(batches: Iterator[list]) -> Iterator[tuple]:
        for texts in batches:
            made = [features(t) for t in texts]
            yield [votes(t) for t in texts], [a.astype(np.int32).tobytes() for a, _ in made], [x.astype(np.float32).tobytes() for _, x in made]

    keyed = docs.filter("id is not null")
    last = sample_cutoff(keyed.select("mark"), sample_docs)
    sample = map_text(keyed.filter(F.col("mark") <= F.lit(last)), ["mark"], "text", "votes string, at binary, x binary", featurise, "string")
    alike = sample.groupBy("mark").agg(*[F.first(c).alias(c) for c in ("votes", "at", "x")])  # rows that are alike count once
    got = sorted(alike.collect(), key=lambda r: r["mark"])  # at most sample_docs rows
    rows = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float)) for r in got]
    weights, bias = train_scorer(rows, np.array([model.posterior(r["votes"]) for r in got]))
    weights = weights.astype(np.float32)

    def score(batches: Iterator[list]) -> Iterator[tuple]:
        known: dict[str, float] = {}
        posteriors: dict[str, float] = {}
        for texts in batches:
            if len(known) > 500_000:
                known.clear()
            cast, post, points = [], [], []
            for t in texts:
                words = (t or "").split()
                freq = Counter(words)
                z = bias + float(sum(weights[s] for s in marks(freq, len(words))))
                for w, n in freq.items():
                    if w not in known:
                        a, b = slots(w)
                        known[w] = float(weights[a] + weights[b])
                    z += known[w] * n / len(words)
                v = votes(t)
                if v not in posteriors:
                    posteriors[v] = model.posterior(v)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                cast.append(v)
                post.append(posteriors[v])
                points.append(p if words else min(p, posteriors[v]))
            yield cast, post, points, [p >= 0.5 for p in points]

    return map_text(docs.select(F.col("id").alias(key), F.col("text").alias("body")), [key], "body", "votes string, posterior double, score double, kept boolean", score, "string")
