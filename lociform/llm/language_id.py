"""Operator 2: language identification.

Features are TF-IDF weights of character n-grams (one to three code points of the lower-cased text), hashed
to a fixed number of slots. A multinomial logistic regression is trained by follow-the-regularised-leader
with elastic-net penalties on at most `sample_docs` labelled documents (the first by a hash of key and text) and the first
`label_docs` of each label, so that a rare language is learned too. Its
probabilities are calibrated by one temperature on a part of the sample that training left out. Document
frequencies are counted over all learning rows, and every whole text is scored.

Defined cases: text that is null or has no letter gets `und` with score 0; without labelled rows every text
gets `und`; repeated rows are scored one by one and learned from once; very long texts are read whole; between labels of the same
probability the first by name is taken; null keys are in no fold and are not learned from; extra columns of any name take
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_fold, map_text, mark_of, sample_cutoff

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
#: Odd multipliers of the n-gram hash, one row per order.
_MIX = ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 2869860233))


def slot_counts(text: str) -> np.ndarray:
    """How many n-grams of the text fall in each slot."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(SLOTS, np.int64)
    for mix in _MIX:
        if len(points) >= len(mix):
            h = points[: len(points) - len(mix) + 1] * np.uint32(mix[0])
            for k, m in enumerate(mix[1:], 1):
                h += points[k : len(points) - len(mix) + 1 + k] * np.uint32(m)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            out += np.bincount(h >> np.uint32(32 - SLOT_BITS), minlength=SLOTS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and unit-length TF-IDF values."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / (math.sqrt(float(x @ x)) or 1.0)


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: np.ndarray  # slots x names
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not has_letter(text):
            return "und", 0.0
        at, x = weighted(slot_counts(text), self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (slots x classes) by follow-the-regularised-leader; l1 keeps them sparse."""
    z, n = np.zeros((SLOTS, classes)), np.zeros((SLOTS, classes))

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    for _ in range(passes):
        for (at, x), y in zip(rows, labels, strict=True):
            zs, ns = z[at], n[at]
            w = solve(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    return solve(z, n)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / math.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, g = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many rows each slot occurs, and the number of rows; each task sends one row per slot."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(SLOTS + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen[:SLOTS] += slot_counts(t) > 0
                rows += 1
        seen[SLOTS] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])

    got = docs.select(F.col(text).cast("string")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in got:  # SLOTS + 1 rows at most
        out[slot] = n
    return out[:SLOTS], int(out[SLOTS])


def train(learn: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_docs: int = 3000, label_docs: int = 30) -> Model:
    """A model from the rows of learn with a label: a sample of sample_docs texts and of each label's label_docs ones, so that none is missing."""
    name, body = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
    learn = learn.filter(F.col(f"`{label}`").isNotNull()).select(mark_of(name, body).alias("mark"), body.alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    seen, rows = document_frequencies(learn, "text")
    idf = np.log((1 + rows) / (1 + seen)) + 1
    marks = learn.select("mark", "label")
    last = sample_cutoff(marks.select("mark"), sample_docs)
    first_of = Window.partitionBy("label").orderBy("mark")
    # A row a label: the model has a class for each, so this table is smaller than what travels with the tasks.
    least = marks.distinct().withColumn("place", F.row_number().over(first_of)).filter(F.col("place") <= label_docs).groupBy("label").agg(F.max("mark").alias("least"))
    chosen = learn.join(F.broadcast(least), "label").filter(F.col("mark") <= F.greatest(F.lit(last), "least"))

    def featurise(batches: Iterator[list]) -> Iterator[tuple]:
        for texts in batches:
            made = []
            for t in texts:
                at, x = weighted(slot_counts(t), idf) if t and has_letter(t) else (np.zeros(0), np.zeros(0))
                made.append((at.astype(np.uint16).tobytes(), x.astype(np.float32).tobytes()))
            yield [m[0] for m in made], [m[1] for m in made]

    picked = map_text(chosen, ["mark", "label"], "text", "slots binary, vals binary", featurise, "string")
    # Rows that are alike count once; of those that differ in the label alone each counts.
    alike = picked.groupBy("mark", "label").agg(F.first("slots").alias("slots"), F.first("vals").alias("vals"))
    got = sorted((r for r in alike.collect() if r["slots"]), key=lambda r: (r["mark"], r["label"]))  # sample_docs marks at most, and label_docs for each label
    names = tuple(sorted({r["label"] for r in got}))
    if not names:
        return Model((), np.zeros((SLOTS, 0)), idf, 1.0)
    order = np.random.default_rng(5).permutation(len(got))
    data = [(np.frombuffer(got[i]["slots"], np.uint16).astype(np.int64), np.frombuffer(got[i]["vals"], np.float32).astype(float)) for i in order]
    labels = np.array([names.index(got[i]["label"]) for i in order])
    held = len(data) // 5
    weights = train_ftrl(data[held:], labels[held:], len(names))
    logits = np.array([x @ weights[at] for at, x in data[:held]]).reshape(held, len(names))
    return Model(names, weights.astype(np.float32), idf.astype(np.float32), calibrate(logits, labels[:held]))


def scorer(model: Model):
    def score(batches: Iterator[list]) -> Iterator[tuple]:
        for texts in batches:
            made = [model.predict(t) for t in texts]
            yield [m[0] for m in made], [m[1] for m in made]

    return score


def learning_rows(key: str) -> Column:
    """Rows whose crc32(key as text) mod 4 is not 2; null keys have no fold and are not learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 != 2, F.lit(False))


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_docs: int = 3000) -> DataFrame:
    """key, held_out, lang_pred, score for every row of docs."""
    model = train(docs.filter(learning_rows(key)), key, text, label, sample_docs)
    rows = docs.select(F.col(f"`{key}`").alias(key), is_fold(key, 4, 2).alias("held_out"), F.col(f"`{text}`").alias("body"))
    return map_text(rows, [key, "held_out"], "body", "lang_pred string, score double", scorer(model), "string")
