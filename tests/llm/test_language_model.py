"""Language identification against plain Python: hashed n-grams, TF-IDF, one pass and more of the online fit, the temperature, the verdict."""

import math

import numpy as np
import pytest
from conftest import SF

from lociform.llm import language_id as D
from lociform.llm.common import table

MIX = ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 2869860233))
WORD = 1 << 32


def slots(text):
    """Slot: how often, n-gram by n-gram."""
    out, points = {}, [ord(c) for c in text.lower()]
    for mix in MIX:
        for i in range(len(points) - len(mix) + 1):
            h = sum(p * m for p, m in zip(points[i:], mix, strict=False)) % WORD
            h = (h ^ h >> 15) * 2246822519 % WORD
            out[h >> 32 - D.SLOT_BITS] = out.get(h >> 32 - D.SLOT_BITS, 0) + 1
    return out


def vector(text, idf):
    raw = {s: math.log1p(n) * idf[s] for s, n in slots(text).items()}
    norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
    return {s: v / norm for s, v in sorted(raw.items())}


def shares(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


class Leader:
    """Follow the regularised leader, a weight at a time."""

    def __init__(self, classes, alpha=1.0, beta=1.0, l1=0.02, l2=0.01):
        self.classes, self.alpha, self.beta, self.l1, self.l2, self.z, self.n = classes, alpha, beta, l1, l2, {}, {}

    def weight(self, s, c):
        z, n = self.z.get((s, c), 0.0), self.n.get((s, c), 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def logits(self, x):
        return [sum(v * self.weight(s, c) for s, v in x.items()) for c in range(self.classes)]

    def learn(self, x, y):
        p = shares(self.logits(x))
        steps = {(s, c): (v * (p[c] - (c == y)), self.weight(s, c)) for s, v in x.items() for c in range(self.classes)}
        for at, (g, w) in steps.items():
            n = self.n.get(at, 0.0)
            self.z[at] = self.z.get(at, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
            self.n[at] = n + g * g


TEXTS = [("the cat and the dog", 0), ("der Hund und die Katze", 1), ("le chat et le chien", 2), ("a house with a door", 0), ("ein Haus mit Tür", 1), ("une maison avec porte", 2), ("The End", 0), ("Ende", 1), ("fin", 2)]


def test_counts_of_hashed_grams():
    for text in ("", "a", "Ab", "grüße ΑΒ 日本 \U0001f600!", "aaaa" * 50):
        got = D.slot_counts(text)
        assert {int(s): int(got[s]) for s in np.flatnonzero(got)} == slots(text)


@pytest.mark.parametrize("passes", [1, 3])
def test_fit_and_temperature(passes):
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 4, D.SLOTS)
    plain, rows = Leader(3), []
    for text, _ in TEXTS:
        at, x = D.weighted(D.slot_counts(text), idf)
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx(vector(text, idf))
        rows.append((at, x))
    labels = np.array([y for _, y in TEXTS])
    for _ in range(passes):
        for text, y in TEXTS:
            plain.learn(vector(text, idf), y)
    weights = D.train_ftrl(rows, labels, 3, passes)
    known = sorted({s for s, _ in plain.z})
    assert weights[known] == pytest.approx(np.array([[plain.weight(s, c) for c in range(3)] for s in known]))
    assert not weights[[s for s in range(D.SLOTS) if s not in set(known)]].any() and (weights[known] == 0).any()  # sparse

    logits = np.array([x @ weights[at] for at, x in rows])
    wrong = labels.copy()
    wrong[:2] = 2  # so that confidence has a cost

    def loss(t):
        return -sum(math.log(max(shares((z / t).tolist())[y], 1e-12)) for z, y in zip(logits, wrong.tolist(), strict=True)) / len(wrong)

    found = D.calibrate(logits, wrong)
    assert loss(found) <= min(loss(math.exp(k / 50)) for k in range(-195, 150)) + 1e-6
    model = D.Model(("de", "en", "fr"), weights, idf, found)
    for text, _ in TEXTS:
        want = shares([z / found for z in plain.logits(vector(text, idf))])
        name, p = model.predict(text)
        assert name == model.names[want.index(max(want))] and p == pytest.approx(max(want))
    assert model.predict(None) == model.predict("") == model.predict("12 !") == ("und", 0.0)


def test_document_frequencies_cover_all_rows(spark):
    docs = table(spark, SF, "documents").select("text").limit(60).repartition(4)
    texts = [r[0] for r in docs.collect()]
    seen, rows = D.document_frequencies(docs, "text")
    want = np.zeros(D.SLOTS, np.int64)
    for t in texts:
        for s in slots(t or ""):
            want[s] += 1
    assert rows == len(texts) and (seen == want).all()
