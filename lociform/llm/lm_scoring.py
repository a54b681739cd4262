"""Operator 5: language-model scores by context-tree weighting.

A text is its lower-cased words joined by one space, then an end. The base score is a smoothed unigram model
over words; the model is a byte-level context tree. Each byte is eight binary decisions; each decision has a
Krichevsky-Trofimov estimate at every depth of the byte context from 0 to `depth`, and all depths are mixed
by context-tree weights: a node's block probability is half its own estimate and half the product over its
children, and a prediction mixes the nodes of its context path by their posterior weights.

Counts come from all learning rows: tasks count byte grams and words in chunks, Spark adds them up. The tree
holds every context that occurs, as rows of Spark tables: a row per context and binary decision. Grams of the
other rows are there too, with no count: such nodes change no weight, so a gram that was not learned gets what
its deepest learned context says. The two deepest levels are worked out next to the grams, a context of
`depth` - 1 bytes (65,536 grams at most) at a time, the levels above by groups and joins. Neither grams nor
words are bounded: the most frequent ones (`common_grams`, `common_words`) travel with the tasks, all others
are joined.

Defined cases: a null text counts as empty, which has one token, the end; a null key is in no fold, so it is
neither held out nor learned from; repeated rows are scored one by one; very long texts are scored whole, in pieces;
without learning rows N and V are 0, the base score is 0 and the score that of a tree without counts; ties among frequent
grams or words change only where they are looked up; extra columns of any name take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RUN_BYTES, arrow_fields, cut, fold, is_fold, map_text, most_frequent, runs

DEPTH = 4
END = 10  # the byte that ends a text and stands before it
#: Bytes or words that a task gathers before it counts them.
_CHUNK = 2_000_000
#: Bytes that a task scores, and grams of which it weighs the nodes, at once.
_PIECE, _RUN = 500_000, 70_000
#: Rows of counts that a task hands on at once.
_ROWS = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes with `depth` ends before each, where each text's own bytes begin and where they end."""
    pad = bytes([END]) * depth
    parts = [pad + b" ".join(w) + bytes([END]) for w in texts]
    size = np.array([len(p) for p in parts], np.int64)
    stop = np.cumsum(size)
    return np.frombuffer(b"".join(parts), np.uint8), stop - size + depth, stop


def pieces(texts: list) -> Iterator[list]:
    """The texts in runs of about _PIECE bytes, so that memory follows a run and the longest text, not a batch."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or b"")
        if size >= _PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def own_positions(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    size = stop - first
    done = np.cumsum(size)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(first - done + size, size)


def gram_counts(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (depth context bytes, then the byte, as one number) and how often each occurs."""
    data, first, stop = stream(texts, depth)
    at = own_positions(first, stop)
    gram = np.zeros(len(at), np.int64)
    for k in range(depth, -1, -1):
        gram = (gram << 8) | data[at - k]
    return np.unique(gram, return_counts=True)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series after shifting x above 7."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(7):
        low = y < 7
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _arrow(df: DataFrame, made: str, work) -> DataFrame:
    schema = T.StructType.fromDDL(made)
    fields = arrow_fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, fields, strict=True)], names=fields.names)

    return df.mapInArrow(run, schema)


def _gather(depth: int):
    """(gram, word, n): chunks' counts of grams (word null) and of words (gram null; the end is the word \\n).

    Rows that are not learned from give their grams with no count, and no words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        texts, others, size, words = [], [], 0, Counter()
        grams, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, n = gram_counts(texts, depth)
            more, _ = gram_counts(others, depth)
            out, at = np.unique(np.concatenate([grams, g, more]), return_inverse=True)
            return out, np.bincount(at, np.concatenate([times, n, np.zeros(len(more), np.int64)])).astype(np.int64)

        def counted() -> Iterator[list]:
            for k in range(0, max(1, len(grams)), _ROWS):
                some = grams[k : k + _ROWS]
                yield [some, [None] * len(some), times[k : k + _ROWS]]
            for some in batched(words.items(), _ROWS):
                yield [[None] * len(some), *zip(*some, strict=True)]

        for b in runs(batches, 0):
            for t, learned in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = words_of(t)
                (texts if learned else others).append(own)
                if learned:
                    words.update(own)
                    words[b"\n"] += 1
                size += len(t or b"") + 1
                if size >= _CHUNK:
                    grams, times = merged()
                    texts, others, size = [], [], 0
                    if len(grams) > 2_000_000 or len(words) > 1_000_000:
                        yield from counted()
                        words = Counter()
                        grams, times = grams[:0], times[:0]
        grams, times = merged()
        yield from counted()

    return work


def gather(docs: DataFrame, text: str, learned: Column, depth: int) -> DataFrame:
    return _arrow(docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("body"), learned.alias("learned")), "gram long, word binary, n long", _gather(depth))


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes' log block probabilities, the weights of their own estimates and their estimates of a one."""
    own, one = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if leaf:
        return own, np.ones(len(own)), one
    whole = np.logaddexp(own, below) - math.log(2)
    return whole, np.exp(own - math.log(2) - whole), one


class Twigs:
    """The nodes of some grams from `depth` up to, not including, `top`; all grams of a context of top + 1 bytes are there.

    A node's number is its context, then a byte for the decision, so a context's parent is the same number with fewer bits.
    """

    def __init__(self, grams: np.ndarray, times: np.ndarray, depth: int, top: int):
        byte, bit = grams & 255, np.arange(8)[:, None]
        nodes, self.at = np.unique(((grams & ~255) | (1 << bit) | (byte >> (8 - bit))).ravel(), return_inverse=True)
        self.ones = (byte >> (7 - bit)) & 1
        ones = np.bincount(self.at, (times * self.ones).ravel(), len(nodes))
        zeros, below = np.bincount(self.at, (times * (1 - self.ones)).ravel(), len(nodes)), np.zeros(len(nodes))
        self.levels = []
        for d in range(depth, top, -1):
            whole, stay, one = weigh(zeros, ones, below, d == depth)
            nodes, up = np.unique(nodes & ((1 << 8 * d) - 1), return_inverse=True)
            self.levels.append((up, stay, one))
            zeros, ones, below = (np.bincount(up, x, len(nodes)) for x in (zeros, ones, whole))
        self.top = nodes, zeros, ones, below

    def log10(self, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the grams' bytes, from what the nodes of `top` mix down to there and leave for deeper ones."""
        for up, stay, one in reversed(self.levels):
            mixed, left = mixed[up] + left[up] * stay * one, left[up] * (1 - stay)
        p = np.clip(mixed, 1e-9, 1 - 1e-9)[self.at].reshape(self.ones.shape)
        return np.log10(np.where(self.ones, p, 1 - p)).sum(axis=0)


def _runs(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows in runs of about _RUN that do not part rows of the same value in column `of`."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows >= _RUN:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            stop = int(np.flatnonzero(whole[of] != whole[of][-1])[-1]) + 1 if (whole[of] != whole[of][-1]).any() else 0
            if stop:
                yield [c[:stop] for c in whole]
            held, rows = [[c[stop:] for c in whole]], rows - stop
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, n, log10) of (gram, n): log10 of each gram's byte in its context by the tree of all these grams."""
    top = max(depth - 2, 0)
    trunk, twig = (F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * d) - 1)) for d in (top, min(top + 1, depth)))
    # Rows of the nodes at `top` come first among those of their trunk: their twig is -1.
    dealt = grams.select(trunk.alias("trunk"), twig.alias("twig"), "gram", "n", F.lit(None).cast("double").alias("mixed"), F.lit(None).cast("double").alias("left"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for _, _, gram, n, _, _ in _runs(batches, 1):
            yield list(Twigs(gram, n, depth, top).top)

    def sort(df: DataFrame) -> DataFrame:
        return df.repartition("trunk").sortWithinPartitions("trunk", "twig")

    level = _arrow(sort(dealt), "node long, zeros double, ones double, below double", up)
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    levels = {}
    for d in range(top, -1, -1):

        def weighed(batches: Iterator[pa.RecordBatch], leaf: bool = d == depth) -> Iterator[list]:
            for b in batches:
                node, zeros, ones, below = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                yield [node, zeros, ones, *weigh(zeros, ones, below, leaf)]

        levels[d] = cut(_arrow(level.groupBy("node").agg(*sums), "node long, zeros double, ones double, whole double, stay double, one double", weighed))
        level = levels[d].select(F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("node"), "zeros", "ones", F.col("whole").alias("below"))
    down = levels[0].select("node", (F.col("stay") * F.col("one")).alias("mixed"), (1 - F.col("stay")).alias("left"))
    for d in range(1, top + 1):
        above = down.select(F.col("node").alias("up"), F.col("mixed").alias("before"), F.col("left").alias("rest"))
        down = levels[d].join(above, F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("up")).select(
            "node", (F.col("before") + F.col("rest") * F.col("stay") * F.col("one")).alias("mixed"), (F.col("rest") * (1 - F.col("stay"))).alias("left")
        )
    tops = down.select(F.shiftright("node", 8).alias("trunk"), F.lit(-1).cast("long").alias("twig"), F.col("node").alias("gram"), F.lit(0).cast("long").alias("n"), "mixed", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # the nodes at `top` of the trunks that are under way
        for trunk, twig, gram, n, mixed, left in _runs(batches, 1):
            is_top = twig < 0
            last = known[0] >> 8 == trunk[0]
            known = [np.concatenate([old[last], new[is_top]]) for old, new in zip(known, (gram, mixed, left), strict=True)]
            order = np.argsort(known[0])
            known = [k[order] for k in known]
            gram, n = gram[~is_top], n[~is_top]
            if len(gram):
                twigs = Twigs(gram, n, depth, top)
                at = np.searchsorted(known[0], twigs.top[0])
                yield [gram, n, twigs.log10(known[1][at], known[2][at])]
            known = [k[known[0] >> 8 == trunk[-1]] for k in known]

    return cut(_arrow(sort(dealt.unionByName(tops)), "gram long, n long, log10 double", score))


class Lookup:
    """A hash table of grams and their values, for whole arrays of grams."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, len(grams).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, slot = np.arange(len(grams)), self._slot(grams)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = grams[left[free]]
            there = self.keys[slot] == grams[left]
            self.values[slot[there]] = values[left[there]]
            left, slot = left[~there], (slot[~there] + 1) & (len(self.keys) - 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """The grams' values; not a number for those that are not in the table."""
        slot = self._slot(grams)
        found = self.keys[slot]
        out = np.where(found == grams, self.values[slot], np.nan)
        left = np.flatnonzero((found != grams) & (found >= 0))
        while len(left):
            slot_left = (slot[left] + 1) & (len(self.keys) - 1)
            slot[left] = slot_left
            found = self.keys[slot_left]
            hit = found == grams[left]
            out[left[hit]] = self.values[slot_left[hit]]
            left = left[~hit & (found >= 0)]
        return out

    def score(self, texts: list[list[bytes]], depth: int) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
        """Sums over each text's grams that are in the table; the other grams, text by text: how many, which and how often."""
        data, first, stop = stream(texts, depth)
        at = own_positions(first, stop)
        out, rare_at, rare_gram = np.zeros(len(at)), [], []
        for a in range(0, len(at), 1 << 18):  # in pieces that stay in a processor's cache
            piece = at[a : a + (1 << 18)]
            gram = np.zeros(len(piece), np.int64)
            for k in range(depth, -1, -1):
                gram = (gram << 8) | data[piece - k]
            got = self.get(gram)
            gone = np.flatnonzero(np.isnan(got))
            got[gone] = 0.0
            out[a : a + (1 << 18)] = got
            rare_at.append(piece[gone])
            rare_gram.append(gram[gone])
        total = np.concatenate([[0.0], np.cumsum(out)])
        size = np.cumsum(stop - first)
        where, gram = np.searchsorted(stop, np.concatenate([at[:0], *rare_at]), side="right"), np.concatenate([at[:0], *rare_gram])
        order = np.lexsort((gram, where))
        where, gram = where[order], gram[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), (where[1:] != where[:-1]) | (gram[1:] != gram[:-1])]))
        return (total[size] - total[size - (stop - first)]).tolist(), np.bincount(where[start], minlength=len(texts)), gram[start], np.diff(np.append(start, len(gram)))


def lm_score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, depth: int = DEPTH, common_words: int = 100_000, common_grams: int = 1_000_000, common_bytes: int = 64) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, one row per row of docs."""
    spark = docs.sparkSession
    counts = cut(gather(docs, text, F.coalesce(fold(key, folds) != held, F.lit(False)), depth).groupBy("gram", "word").agg(F.sum("n").alias("n")))
    words = counts.filter("word is not null").select("word", "n")
    total, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = {bytes(w): n for w, n in words.filter(F.octet_length("word") <= common_bytes).orderBy(F.desc("n"), "word").limit(common_words).toArrow().select(["word", "n"]).to_pandas().itertuples(index=False)}
    others = (F.col("n") <= min(common.values())) | (F.octet_length("word") > common_bytes) if common else F.lit(True)
    logs = {w: math.log10(n + 0.5) for w, n in common.items()}
    scores = gram_scores(counts.filter("gram is not null").select("gram", "n"), depth)
    is_common = most_frequent(scores, common_grams)
    near = scores.filter(is_common).select("gram", "log10").toArrow()
    sent = spark.sparkContext.broadcast((Lookup(near.column("gram").to_numpy(), near.column("log10").to_numpy()), logs))

    def score(some: list) -> tuple:
        lookup, counted = sent.value
        texts = [words_of(t) for t in some]
        tokens, hits, sums, rare, sizes = [], [], [], [], []
        for own in texts:
            freq = Counter(own)
            freq[b"\n"] += 1
            there = [(w, n) for w, n in freq.items() if w in counted]
            tokens.append(len(own) + 1)
            hits.append(sum(n for _, n in there))
            sums.append(math.fsum(counted[w] * n for w, n in there))
            rare.append([{"word": w, "times": n} for w, n in freq.items() if w not in counted])
            sizes.append(sum(map(len, own)) + len(own))
        return tokens, hits, sums, rare, sizes, *lookup.score(texts, depth)

    marked = docs.select(F.col(f"`{key}`").alias("key"), is_fold(key, folds, held).alias("held_out"), F.col(f"`{text}`").cast("string").alias("body"), F.monotonically_increasing_id().alias("row"))

    def flat(batches: Iterator[list]) -> Iterator[tuple]:
        for texts in batches:
            whole: list[list] = [[] for _ in range(6)]
            far: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for some in pieces(texts):
                *lists, many, gram, times = score(some)
                for column, more in zip(whole, lists, strict=True):
                    column.extend(more)
                for column, more in zip(far, (many, gram, times), strict=True):
                    column.append(more)
            many, gram, times = map(np.concatenate, far)
            pairs = pa.StructArray.from_arrays([pa.array(gram), pa.array(times)], names=["gram", "times"])
            yield *whole, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pairs)

    made = "n_tokens long, hits long, part double, rare array<struct<word binary, times long>>, bytes long, near double, grams array<struct<gram long, times long>>"
    scored = cut(map_text(marked, ["key", "held_out", "row"], "body", made, flat, most=RUN_BYTES))
    rare = scored.select("row", F.inline("rare")).join(words.filter(others), "word")
    rest = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(0.5))).alias("gain"))
    far = scores.filter(~is_common).select("gram", "log10")
    deep = scored.select("row", F.inline("grams")).join(far, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("far"))
    out = scored.drop("rare", "grams").join(rest, "row", "left").join(deep, "row", "left").fillna({"more": 0, "gain": 0.0, "far": 0.0}).withColumn("score", F.col("near") + F.col("far"))
    unknown = F.col("n_tokens") - F.col("hits")  # as if none of them were known; `gain` puts that right for those that are
    base = F.col("part") + F.col("gain") + unknown * math.log10(0.5) - F.col("n_tokens") * math.log10(total + 0.5 * (known + 1))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("hits") + F.col("more")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
