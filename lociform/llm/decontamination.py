"""Operator 6: benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about `_SHARD` bytes in a task, which holds the words of one shard at a time
and splits texts anew for each block of a larger benchmark. Words become numbers of the benchmark's vocabulary; a word outside it ends a run, and runs shorter than the shortest window cannot hold one, so the index is built
over the remaining runs only: exact, and small where training text is clean. All windows are searched
backwards together through the ranks of a wavelet matrix; occurrences are located by walking to sampled
suffix positions; their spans are merged per document. No training text is shuffled or collected, and documents are
scanned once, whatever the benchmark's size is.

The benchmark's items are dealt to blocks of about `block_words` words by a hash (a longer item makes its block longer); a task works out a
block's distinct windows, which become a row of a table. A benchmark of one block, whose size is thus known, is broadcast. The blocks of a larger
one stay in files of the shared folder: the driver sees their names alone, and a task reads them one after the other for each of its batches,
holds one at a time and merges the blocks' spans where the document is. They are opened with pyarrow (local, hdfs, s3, gs, abfs).

Defined cases: a null or wordless text has no words, no hits and the digest of no items; benchmark rows
with a null item_id or without words are ignored; items with equal text or repeated ids count once per id;
repeated document rows and null keys are judged one by one; very long texts are searched whole; overlapping and equal
occurrences are one span; columns of any type pass through, and their names may be those of the result's own columns only
in the benchmark; empty tables give zero hits or an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_fields, map_text, written

WINDOW = 13
#: Bytes that separate words become spaces; A-Z become a-z. Bytes from 0x80 are parts of words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class FMIndex:
    """Backward search and location in a sequence of numbers from 1; a 0 is put at its end."""

    def __init__(self, sequence: np.ndarray, sample: int = 8):
        text = np.append(sequence.astype(np.int64), 0)
        n = len(text)
        order, rank, step = np.argsort(text, kind="stable"), text, 1
        while True:  # prefix doubling
            head = rank[order]
            tail = np.where(order + step // 2 < n, rank[np.minimum(order + step // 2, n - 1)], -1) if step > 1 else np.zeros(n, np.int64)
            fresh = np.ones(n, np.int64)
            fresh[0] = 0
            fresh[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
            now = np.empty(n, np.int64)
            now[order] = np.cumsum(fresh)
            rank = now
            if rank[order[-1]] == n - 1:
                break
            next_rank = np.full(n, -1, np.int64)
            if step < n:
                next_rank[: n - step] = rank[step:]
            order = np.argsort(rank * (n + 1) + next_rank + 1, kind="stable")
            step *= 2
        self.last = text[order - 1]
        top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits = max(1, top.bit_length())
        self.ones, self.zeros, level = [], [], self.last
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        # Of the suffixes' positions only every sample-th is kept: `place` counts the kept ones before a row.
        self.sampled = (order % sample == 0) | (order == n - 1)
        self.position, self.place = order[self.sampled], np.cumsum(self.sampled) - 1

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the last column before end."""
        low = np.zeros_like(end)
        for ones, zeros, b in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            bit = ((symbol >> b) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [first, last) of each pattern; patterns are right-aligned in the matrix."""
        first = np.zeros(len(patterns), np.int64)
        last = np.full(len(patterns), len(self.last), np.int64)
        width, known = patterns.shape[1], len(self.before) - 1
        for k in range(width):
            symbol = patterns[:, width - 1 - k]
            live = np.flatnonzero((k < lengths) & (last > first))
            if not len(live):
                break
            c = symbol[live]
            there = c < known
            last[live[~there]] = first[live[~there]]
            live, c = live[there], c[there]
            first[live], last[live] = self.before[c] + self.rank(c, first[live]), self.before[c] + self.rank(c, last[live])
        return first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the rows' suffixes: steps to a sampled suffix plus its position."""
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            out[open_[done]] = self.position[self.place[at[done]]] + walked
            open_, at = open_[~done], at[~done]
            c = self.last[at]
            rows[open_] = self.before[c] + self.rank(c, at)
            walked += 1
        return out


BLOCK = "words array<binary>, names array<string>, lengths array<int>, patterns array<int>, holding array<int>, holders array<int>"


def windows_of(items: list[tuple[str, list[bytes]]], size: int = WINDOW) -> list:
    """The values of BLOCK for some items: their vocabulary and names, and each distinct window's length, words and holders.

    A word's number is its place in the vocabulary plus 2; a window's row of `size` numbers begins with zeros if it is shorter.
    """
    vocabulary: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[int]] = {}
    names = sorted({name for name, _ in items})
    place = {name: i for i, name in enumerate(names)}
    for name, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words]
        for a in range(max(1, len(ids) - size + 1)):
            holders.setdefault(tuple(ids[a : a + size]), set()).add(place[name])
    rows = np.zeros((len(holders), size), np.int32)
    for row, w in enumerate(holders):
        rows[row, size - len(w) :] = w
    held = [sorted(h) for h in holders.values()]
    return [list(vocabulary), names, np.array([len(w) for w in holders], np.int32), rows.ravel(), np.array([len(h) for h in held], np.int32), np.array([i for h in held for i in h], np.int32)]


class Windows:
    """A block of the benchmark, from a table with a row of BLOCK."""

    def __init__(self, row: pa.Table, size: int = WINDOW):
        words, self.names = row.column("words")[0].as_py(), row.column("names")[0].as_py()
        self.vocabulary = {w: i + 2 for i, w in enumerate(words)}
        lengths, patterns, holding, self.held_by = (row.column(c)[0].values.to_numpy().astype(np.int64) for c in ("lengths", "patterns", "holding", "holders"))
        self.lengths, self.patterns = lengths, patterns.reshape(-1, size)
        self.held_at = np.concatenate([[0], np.cumsum(holding)])
        self.shortest = int(lengths.min())

    def spans(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """First and end of each occurrence, counted over the words of all docs in a row, and the items of each doc."""
        none, found = np.zeros(0, np.int64), [set() for _ in docs]
        total = sum(map(len, docs))
        if not total:
            return none, none, found
        get = self.vocabulary.get
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, total)
        owner = np.repeat(np.arange(len(docs)), np.diff(starts))
        known = ids > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (owner[1:] != owner[:-1])
        run_at, run_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = run_end - run_at >= self.shortest
        run_at, run_end = run_at[long], run_end[long]
        if not len(run_at):
            return none, none, found
        # Runs one after the other, each followed by the number 1, which no window holds.
        size = run_end - run_at + 1
        base = np.concatenate([[0], np.cumsum(size)])
        from_ = np.arange(base[-1]) - np.repeat(base[:-1] - run_at, size)
        text = ids[np.minimum(from_, total - 1)]
        text[base[1:] - 1] = 1
        index = FMIndex(text)
        first, last = index.search(self.patterns, self.lengths)
        count = last - first
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
        at = index.locate(rows)
        at = from_[at]
        for d, w in set(zip(owner[at].tolist(), which.tolist(), strict=True)):
            found[d].update(self.held_by[self.held_at[w] : self.held_at[w + 1]].tolist())
        return at, at + self.lengths[which], found


#: Bytes of texts whose words a task holds at once, for which there is an index (a longer text is a shard of its own).
_SHARD = 2_000_000


def shards(texts: list[bytes | None]) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or b"")
        if held and held + size > _SHARD:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if texts:
        yield slice(start, len(texts))


def merged(hit: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Each document's runs of hit words, as first, end, first, end ...; starts: where documents begin, and the end of the last."""
    padded = np.zeros(len(hit) + 2, bool)
    padded[1:-1] = hit
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    # A document's first word begins a run anew.
    inner = starts[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(hit))])
    split = inner[hit[inner - 1] & hit[inner]]
    edge = np.sort(np.concatenate([edge, split, split]))
    out: list[list[int]] = [[] for _ in range(len(starts) - 1)]
    owner = np.searchsorted(starts, edge[::2], side="right") - 1
    for d, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out[d] += [a - int(starts[d]), b - int(starts[d])]
    return out


def _judge(one: Broadcast | None, files: list[str]):
    """Per batch: n_words, hit spans (merged, as flat list of first and end), names of items."""
    sent: list[Windows] = []

    def blocks() -> Iterator[Windows]:
        if one is not None:
            if not sent:
                sent.append(Windows(one.value))
            yield sent[0]
        for file in files:
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as opened:
                for row in pq.ParquetFile(opened).iter_batches(batch_size=1):
                    yield Windows(pa.Table.from_batches([row]))

    def score(batches: Iterator[list]) -> Iterator[tuple]:
        for texts in batches:
            runs, starts, hits = list(shards(texts)), [], []
            n_words, names = [], [set() for _ in texts]
            for block in blocks():
                for k, some in enumerate(runs):
                    docs = [words_of(t) for t in texts[some]]
                    if k == len(hits):
                        n_words += map(len, docs)
                        starts.append(np.concatenate([[0], np.cumsum(n_words[some])]).astype(np.int64))
                        hits.append(np.zeros(starts[k][-1], bool))
                    at, end, found = block.spans(docs)
                    edge = np.zeros(starts[k][-1] + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, end, -1)
                    hits[k] |= np.cumsum(edge)[:-1] > 0
                    for held, more in zip(names[some], found, strict=True):
                        held.update(block.names[i] for i in more)
            if not hits:  # no block
                yield [len(words_of(t)) for t in texts], [[] for _ in texts], [[] for _ in texts]
                continue
            yield n_words, [spans for hit, at in zip(hits, starts, strict=True) for spans in merged(hit, at)], [sorted(n) for n in names]

    return score


def _items(batches: Iterator[list]) -> Iterator[tuple]:
    for texts in batches:
        own = [words_of(t) for t in texts]
        yield [b" ".join(w) for w in own], [len(w) for w in own]


def _building(fields: pa.Schema):
    """A row of fields, those of BLOCK, for each block of rows (block, name, said) that are sorted by block."""

    def row(items: list[tuple[str, list[bytes]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(windows_of(items), fields, strict=True)], names=fields.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, items = None, []
        for b in batches:
            for own, name, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != block and items:
                    yield row(items)
                    items = []
                block = own
                items.append((name, said.split()))
        if items:
            yield row(items)

    return build


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> tuple[DataFrame, int]:
    """A table with a row of BLOCK for each block of the benchmark that has an item, and the number of blocks."""
    name = F.col(f"`{item}`")
    rows = benchmark.filter(name.isNotNull()).select(name.cast("string").alias("name"), F.col(f"`{text}`").cast("string").alias("body"))
    items = map_text(rows, ["name"], "body", "said binary, n long", _items).filter("n > 0").distinct()
    parts = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    dealt = items.select(F.pmod(F.xxhash64("name", "said"), F.lit(parts)).alias("block"), "name", "said")
    build = _building(arrow_fields(T.StructType.fromDDL(BLOCK)))
    return written(dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(build, BLOCK)), parts


def find_overlap(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """The kept columns of docs with n_words, spans (words first, end, first, end ...) and items (names), a row per row."""
    blocks, parts = benchmark_blocks(benchmark, item, item_text, block_words)
    one, files = None, []
    if parts > 1:
        files = sorted(blocks.inputFiles())
    elif (row := blocks.toArrow()).num_rows:  # one row, of a benchmark of block_words words at most
        one = docs.sparkSession.sparkContext.broadcast(row)
    return map_text(docs, keep, text, "n_words long, spans array<long>, items array<string>", _judge(one, files))


def hit_words(spans) -> object:
    ends = F.filter(spans, lambda _, i: i % 2 == 1)
    firsts = F.filter(spans, lambda _, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return total(ends) - total(firsts)


def contaminated(n_hit, n_words) -> object:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and the spans to remove, a row per row of docs."""
    found = find_overlap(docs, benchmark, [key], text, item, item_text, block_words).withColumn("n_hit", hit_words(F.col("spans")))
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "spans",
    )
