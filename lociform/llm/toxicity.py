"""Operator 7: toxicity by a weighted finite-state pattern grammar.

Words become weighted tags: threat, target, negation and report (fixed lists in four languages), and insult (a lexicon
of other words and stems, learned from labels). Each rule of the grammar is a weighted transducer, a table of arcs (state, tag)
to (state, tag written, weight): a threat counts if a target follows it, an insult is addressed if a target is near,
negations before a match and reported speech around it change its weight. `compose` multiplies the tables into one
machine once (states are pairs, weights products); what depends on words that follow is read from the right by one
composed machine, the rest from the left by another. A clause's score is the sum over its matches of the lexical
weight times the weights of the arcs, and a document's mass, the sum over its clauses, gives a score by a logistic curve.

Lexicon, arc weights (target, threat, negation, report) and curve are learned from at most `sample_docs` labelled
documents of the learning folds (the first by a hash of key and text; rows that are alike count once). A stem enters the
lexicon if the lower bound of its log odds is high enough, however many do: a support that noise cannot reach, alike at
every size. Every whole text is scored.

Defined cases: a null or empty text has no clause and gets the curve's value at mass 0; without labelled rows
only the fixed lists and the weights' starting values work; rows with a null key are in no fold and are not learned from;
several labels of one key count as toxic if one is; repeated rows are scored one by one; very long texts are read whole;
ties of the sample's hash are one document; columns of other names, `score` too, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, is_fold, map_text, mark_of, sample_cutoff

#: Fixed word lists (English, German, French, Spanish).
THREATS = "kill hurt destroy beat burn shoot stab töte töten vernichte verletze tuer tuerai frapper brûler matar mataré golpear quemar".split()
TARGETS = "you your yours yourself he she they him them these those du dich dir dein ihr euch sie tu toi te vous ton ta vos tú ti usted ustedes tus".split()
NEGATIONS = "not never isn't aren't don't nicht kein keine niemals nie ne pas jamais no nunca jamás".split()
REPORTS = "said says wrote called claimed quoted reported sagte sagt schrieb nannte behauptete dit écrit appelé affirmé dijo dice escribió llamó afirmó".split()
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITYNR."
#: Written by the machines: an insult near a target, a threat with a target; the marks of negated and reported matches.
ADDRESSED, AIMED, NEGATED, QUOTED = "A", "H", "-", '"'
_FIXED = {w: tag for tag, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;\n]+")
#: What a match may be: its kind, whether it is negated, whether it is reported.
CLASSES = tuple(kind + n + q for kind in (INSULT, ADDRESSED, AIMED) for n in ("", NEGATED) for q in ("", QUOTED))


@dataclass(frozen=True)
class Weights:
    """Arc weights: of an addressed insult, an aimed threat, a negated match, a reported match."""

    target: float = 1.5
    threat: float = 4.0
    negation: float = 0.25
    report: float = 0.4


@dataclass(frozen=True)
class Machine:
    """A weighted transducer that reads a tag at a time; arcs[state][tag] is (next state, tag written, weight)."""

    arcs: tuple[dict[str, tuple[int, str, float]], ...]

    @classmethod
    def of(cls, alphabet: tuple[str, ...], start, arc: Callable) -> Machine:
        """The states that can be reached from start by arc(state, tag)."""
        place, todo, arcs = {start: 0}, [start], []
        for state in todo:
            row = {}
            for tag in alphabet:
                to, out, weight = arc(state, tag)
                if to not in place:
                    place[to] = len(todo)
                    todo.append(to)
                row[tag] = (place[to], out, weight)
            arcs.append(row)
        return cls(tuple(arcs))

    def written(self) -> tuple[str, ...]:
        return tuple(sorted({out for row in self.arcs for _, out, _ in row.values()}))

    def run(self, tags: list[str]) -> tuple[list[str], list[float]]:
        state, out, weights = 0, [], []
        for t in tags:
            state, made, w = self.arcs[state][t]
            out.append(made)
            weights.append(w)
        return out, weights


def near(alphabet: tuple[str, ...], before: str, rewrite: dict[str, str], reach: int, weight: Callable[[str], float]) -> Machine:
    """Rewrites a tag that comes at most `reach` words after a `before` tag; the state is the distance from the last one."""

    def arc(state: int, tag: str) -> tuple[int, str, float]:
        to = 1 if tag == before else min(state + 1, reach + 1)
        return (to, rewrite[tag], weight(tag)) if state <= reach and tag in rewrite else (to, tag, 1.0)

    return Machine.of(alphabet, reach + 1, arc)


def after(alphabet: tuple[str, ...], seen: str, rewrite: dict[str, str], weight: float) -> Machine:
    """Rewrites tags anywhere after a `seen` tag; the state tells whether there was one."""
    return Machine.of(alphabet, False, lambda state, tag: (state or tag == seen, rewrite[tag], weight) if state and tag in rewrite else (state or tag == seen, tag, 1.0))


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that does what second does with what first writes."""

    def arc(state: tuple[int, int], tag: str) -> tuple[tuple[int, int], str, float]:
        a, between, w = first.arcs[state[0]][tag]
        b, out, x = second.arcs[state[1]][between]
        return (a, b), out, w * x

    return Machine.of(tuple(first.arcs[0]), (0, 0), arc)


@dataclass(frozen=True)
class Grammar:
    """The composed machines, one for each direction of reading."""

    from_right: Machine
    from_left: Machine

    @classmethod
    def of(cls, weights: Weights) -> Grammar:
        aimed = {INSULT: ADDRESSED, THREAT: AIMED}
        quoted = lambda tags: {t: t + QUOTED for t in tags if t.rstrip(NEGATED) in (INSULT, ADDRESSED, AIMED)}
        right = [near((INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER), TARGET, aimed, 4, lambda t: weights.threat if t == THREAT else weights.target)]
        right.append(after(right[-1].written(), REPORT, quoted(right[-1].written()), weights.report))
        left = [near(right[-1].written(), TARGET, {INSULT: ADDRESSED, INSULT + QUOTED: ADDRESSED + QUOTED}, 4, lambda t: weights.target)]
        matches = [t for t in left[-1].written() if t[0] in (INSULT, ADDRESSED, AIMED)]
        left.append(near(left[-1].written(), NEGATION, {t: t[0] + NEGATED + t[1:] for t in matches}, 3, lambda t: weights.negation))
        left.append(after(left[-1].written(), REPORT, quoted(left[-1].written()), weights.report))
        return cls(reduce(compose, right), reduce(compose, left))

    def matches(self, tags: list[str]) -> Iterator[tuple[int, str, float]]:
        """Place, class and weight of each match of a clause."""
        back, one = self.from_right.run(tags[::-1])
        out, two = self.from_left.run(back[::-1])
        for i, (t, w, x) in enumerate(zip(out, reversed(one), two, strict=True)):
            if t[0] in (INSULT, ADDRESSED, AIMED):
                yield i, t, w * x


def head(word: str) -> str:
    return word[:4]


@dataclass(frozen=True)
class Lexicon:
    """Insults: whole words (with a $ at the end) and stems, with weights."""

    entries: dict[str, float]
    heads: frozenset[str]

    @classmethod
    def of(cls, entries: dict[str, float]) -> Lexicon:
        return cls(entries, frozenset(head(e.rstrip("$")) for e in entries))

    def insult(self, word: str) -> float:
        if head(word) not in self.heads:
            return 0.0
        return max((self.entries.get(p, 0.0) for p in stems(word)), default=0.0)


def stems(word: str) -> list[str]:
    """Prefixes of four letters or more, the word itself, and the word with an end mark."""
    return [*(word[:k] for k in range(4, min(len(word), 12) + 1)), word + "$"]


class Tagger:
    def __init__(self, lexicon: Lexicon, grammar: Grammar, remembered: int = 500_000):
        self.lexicon, self.grammar, self.remembered, self.known = lexicon, grammar, remembered, {}

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.remembered:
                self.known.clear()
            insult = 0.0 if word in _FIXED else self.lexicon.insult(word)
            got = self.known[word] = (INSULT, insult) if insult else (_FIXED.get(word, OTHER), 1.0)
        return got

    def matches(self, text: str | None) -> Iterator[tuple[str, float, float]]:
        """Class, lexical weight and arc weight of each match of all clauses."""
        text = (text or "").lower()
        if not any(self.symbol(w)[0] in (INSULT, THREAT) for w in set(_WORD.findall(text))):
            return
        for clause in _CLAUSE.split(text):
            symbols = [self.symbol(w) for w in _WORD.findall(clause)]
            if any(t in (INSULT, THREAT) for t, _ in symbols):
                for i, kind, weight in self.grammar.matches([t for t, _ in symbols]):
                    yield kind, symbols[i][1], weight

    def mass(self, text: str | None) -> float:
        """The weight of all matched clauses."""
        return sum(lexical * weight for _, lexical, weight in self.matches(text))

    def by_class(self, text: str | None) -> list[float]:
        """The lexical weights of a text's matches by their class."""
        out = dict.fromkeys(CLASSES, 0.0)
        for kind, lexical, _ in self.matches(text):
            out[kind] += lexical
        return list(out.values())


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: Weights
    bias: float
    slope: float

    def score(self, mass: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(mass)))))


def _stem_counts(candidates: frozenset[str] | None):
    """(stem, toxic, n): in how many documents of each label a stem occurs, per task; of all stems only toxic documents' ones are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if candidates is None and not toxic:
                    continue
                found = {s for w in set(_WORD.findall((text or "").lower())) for s in stems(w)}
                counts[toxic].update(found if candidates is None else found & candidates)
        rows = [(s, t, n) for t, c in counts.items() for s, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["stem", "toxic", "n"])

    return run


def log_odds(with_stem: tuple[float, float], documents: tuple[int, int]) -> tuple[float, float]:
    """A stem's log odds and their lower bound, from its (clean, toxic) documents and all of them."""
    n, t = with_stem
    odds = math.log((t + 0.5) / (documents[1] + 1)) - math.log((n + 0.5) / (documents[0] + 1))
    return odds, odds - 2 * math.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))


def pick_lexicon(counts: dict[str, tuple[int, int]], documents: tuple[int, int], odds: float = 2.0, sure: float = 2.0) -> Lexicon:
    """counts: stem to its documents (clean, toxic). A stem weighs the lower bound of its log odds. The longest of equally common stems is taken, and none that a taken one begins."""
    measured = {s: log_odds(n, documents) for s, n in counts.items()}
    good = {s: low for s, (w, low) in measured.items() if w >= odds and low >= sure}
    longer: dict[str, int] = {}
    for s in good:
        shorter = s[:-1] if len(s) > 4 else ""
        longer[shorter] = max(longer.get(shorter, 0), counts[s][1])
    taken: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        if longer.get(s, 0) < 0.9 * counts[s][1] and not any(s[:k] in taken for k in range(4, len(s))):
            taken[s] = good[s]
    return Lexicon.of(taken)


#: Which of the four weights (target, threat, negation, report) each class multiplies.
_USES = np.array([[k[0] == ADDRESSED, k[0] == AIMED, NEGATED in k, QUOTED in k] for k in CLASSES], float)


def fit(by_class: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[Weights, float, float]:
    """Arc weights, bias and slope of a logistic regression on log(1 + mass); both labels weigh the same.

    Damped Gauss-Newton steps on the logarithms of the weights, which a ridge ties to their starting values, so that
    labels which never show a class leave its weight as it is.
    """
    start = Weights()
    first = np.array([-2.0, 1.0, *np.log([start.target, start.threat, start.negation, start.report])])
    if not len(labels) or labels.min() == labels.max():
        return start, -2.0, 1.0
    share = labels.mean()
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    ridge = np.array([1e-2, 1e-2, 1.0, 1.0, 1.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = w[0] + w[1] * np.log1p(by_class @ np.exp(_USES @ w[2:]))
        return float(importance @ (np.logaddexp(0, z) - labels * z) + 0.5 * ridge @ (w - first) ** 2)

    w, damp = first.copy(), 1e-3
    best = loss(w)
    for _ in range(rounds):
        parts = by_class * np.exp(_USES @ w[2:])
        mass = parts.sum(axis=1)
        x = np.concatenate([np.ones((len(labels), 1)), np.log1p(mass)[:, None], w[1] * (parts @ _USES) / (1 + mass)[:, None]], axis=1)
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * np.log1p(mass), -30, 30)))
        slope = x.T @ (importance * (p - labels)) + ridge * (w - first)
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        while damp < 1e8:
            new = w - np.linalg.solve(curve + damp * np.diag(np.diag(curve)), slope)
            if (now := loss(new)) < best:
                break
            damp *= 4
        else:
            break
        done, w, best, damp = best - now < 1e-9 * abs(best), new, now, damp / 8
        if done:
            break
    return Weights(*np.exp(w[2:]).tolist()), float(w[0]), float(w[1])


def learning_documents(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_docs: int) -> DataFrame:
    """(mark, text, toxic) of at most `sample_docs` labelled documents of the learning folds, whose keys' crc32 mod 5 is not 0."""
    marks = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    marks = marks.filter(F.col("toxic").isNotNull() & F.coalesce(fold("id", 5) != 0, F.lit(False))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = cut(marks.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_docs))
    own = docs.select(F.col(f"`{key}`").alias("own"), F.col(f"`{text}`").cast("string").alias("text"))
    met = own.join(F.broadcast(some), F.col("own") == F.col("id")).select(mark_of(F.col("own"), F.col("text")).alias("mark"), "text", "toxic")
    last = sample_cutoff(met.select("mark"), sample_docs)
    return cut(met.filter(F.col("mark") <= F.lit(last)).groupBy("mark").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))


def _could_be(n: Column, documents: tuple[int, int], sure: float = 2.0) -> Column:
    """Whether a stem of n toxic documents reaches the lower bound if no clean document has it: no other one needs counting."""
    odds = F.log((n + 0.5) / (documents[1] + 1)) - math.log(0.5 / (documents[0] + 1))
    return odds - 2 * F.sqrt(1 / (n + 0.5) + 2.0) >= sure


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_docs: int) -> Model:
    sample = learning_documents(docs, labels, key, text, label, sample_docs)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    documents = (n.get(0, 0), n.get(1, 0))

    def counted(candidates: frozenset[str] | None) -> DataFrame:
        return sample.select("text", "toxic").mapInArrow(_stem_counts(candidates), "stem string, toxic int, n long").groupBy("stem", "toxic").agg(F.sum("n").alias("n"))

    candidates = frozenset(counted(None).filter(_could_be(F.col("n"), documents)).select("stem").toArrow().column("stem").to_pylist())
    counts = {s: [0, 0] for s in candidates}
    if candidates:
        for r in counted(candidates).toArrow().to_pylist():
            counts[r["stem"]][r["toxic"]] = r["n"]
    words = pick_lexicon({s: (c[0], c[1]) for s, c in counts.items()}, documents)

    def featurise(batches: Iterator[list]) -> Iterator[tuple]:
        tagger = Tagger(words, Grammar.of(Weights()))
        for texts in batches:
            yield ([tagger.by_class(t) for t in texts],)

    got = map_text(sample, ["mark", "toxic"], "text", "parts array<double>", featurise, "string").orderBy("mark").toArrow()  # at most sample_docs rows
    parts = np.array(got.column("parts").to_pylist(), float).reshape(-1, len(CLASSES))
    return Model(words, *fit(parts, got.column("toxic").to_numpy()))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 20_000) -> DataFrame:
    """key, held_out, score, predicted and mass, one row per row of docs."""
    model = train(docs, labels, key, text, label, sample_docs)

    def score(batches: Iterator[list]) -> Iterator[tuple]:
        tagger = Tagger(model.lexicon, Grammar.of(model.weights))
        for texts in batches:
            masses = [tagger.mass(t) for t in texts]
            points = [model.score(m) for m in masses]
            yield points, [int(p >= 0.5) for p in points], masses

    rows = docs.select(F.col(f"`{key}`").alias(key), is_fold(key, 5, 0).alias("held_out"), F.col(f"`{text}`").alias("body"))
    return map_text(rows, [key, "held_out"], "body", "score double, predicted int, mass double", score, "string")
