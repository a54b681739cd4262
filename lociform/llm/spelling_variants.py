"""Operator 13: grouping spelling variants, with a forward and a reversed dictionary.

1. Tasks count their words and Spark adds the counts up. Words of at least `least_length` letters and `least_count`
   occurrences are the dictionary.
2. Two words that one edit parts share the half before or the half after it. So each word stands in the forward dictionary,
   in the block of words that begin with its first half, and in the reversed one, in the block of those that end with its last
   half; twice in each, as the shorter word of a pair (half of its own length) and as the longer one (of one letter less).
3. A block of more than `block_words` words is subdivided: what the words of a block share is set aside, and the rest is
   halved again in the same way, until blocks are small or the rest is a letter or two. Such last blocks have at most as many
   words as there are texts of two letters.
4. Blocks are ranges of the sorted dictionaries. A task scans them and verifies pairs by their common prefix and suffix,
   with arrays. Of all blocks that hold a pair it counts in one: at each halving the prefix block, if the pair shares that half.
5. Each word's near words are added up, from rows that a task has combined by word, and forms are followed to their last one
   by pointer jumping: an occurrence count doubles with each step, so chains are short.

Blocks and their sizes are Spark rows; a block's words are in one task, and a block is never larger than stated above.
A key that holds many rows is met by broadcast (`meet`).

Defined cases: null and empty texts have no words; a null key counts as empty text in the rule that drops a letter; repeated rows
count as often as they stand; very long texts and words are read whole; among near words that are equally frequent the first in
code-point order counts; an empty table gives an empty result; other columns take no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, meet

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, DROP_ONE_IN = 5, 3, 97
#: Rows of blocks and pairs that a task holds at once; longer words than _WIDE are compared one by one.
_ROWS, _PAIRS, _WIDE = 20_000, 200_000, 64


def words_of(key: str, text: bytes, drop_one_in: int = DROP_ONE_IN) -> Iterator[tuple[str, int]]:
    """The words of a UTF-8 text with their counts, A-Z in lower case; a letter is dropped where a hash of key and word says so."""
    start = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(_RUN.findall(text.lower().decode())).items():  # bytes: A-Z only
        h = zlib.crc32(run.encode(), start)
        if h % drop_one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN, held: int = 500_000) -> DataFrame:
    """(word, n). A task holds `held` words at most before it sends their counts on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in words_of(k or "", t or b"", drop_one_in):
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) > held:
                    yield sent()
        yield sent()

    picked = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """The blocks below each row's own: `front` and `back` letters are shared already, `short` is the length of a pair's shorter word.

    path is 1 and then a binary digit for each halving: 0 for the prefix, 1 for the suffix.
    """
    once = rows.withColumn("half", F.floor((F.col("short") - F.col("front") - F.col("back")) / 2).cast("int"))
    front = F.struct((F.col("path") * 2).alias("path"), (F.col("front") + F.col("half")).alias("front"), F.col("back").alias("back"))
    back = F.struct((F.col("path") * 2 + 1).alias("path"), F.col("front").alias("front"), (F.col("back") + F.col("half")).alias("back"))
    made = once.select("word", "n", "short", F.explode(F.array(front, back)).alias("b")).select("word", "n", "short", "b.*")
    size = F.length("word")
    # The shared letters make the block; where two hashes are equal, blocks are scanned together and no pair counts twice.
    block = F.xxhash64("short", "path", F.substring("word", F.lit(1), F.col("front")), F.substring("word", size - F.col("back") + 1, F.col("back")))
    return made.withColumn("block", block)


def blocks(words: DataFrame, block_words: int = 400, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(block, word, n, short, path) of all blocks, skewed ones subdivided."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda x: x >= least_length)
    start = {"path": F.lit(1).cast("long"), "front": F.lit(0), "back": F.lit(0)}
    rows, done = _halved(words.select("word", "n", F.explode(lengths).alias("short"), *[c.alias(k) for k, c in start.items()])), None
    while True:
        left = F.max(F.col("short") - F.col("front") - F.col("back")).alias("left")  # less than two letters cannot be halved
        sizes = rows.groupBy("block").agg(F.count("*").alias("rows"), left).filter((F.col("rows") > block_words) & (F.col("left") > 1))
        large = cut(sizes.select("block", "rows"))
        total = large.agg(F.sum("rows")).first()[0]
        if total is None:
            return rows if done is None else done.unionByName(rows.select(*done.columns))
        marked = cut(meet(rows, large, "block", F.col("rows") * HOT_KEYS > total, keep=True))
        small = marked.filter("rows is null").select("block", "word", "n", "short", "path")
        done = small if done is None else done.unionByName(small)
        rows = _halved(marked.filter("rows is not null"))


def common_ends(a: bytes, b: bytes) -> tuple[int, int]:
    """Lengths of the common prefix and the common suffix of two words, one letter a byte."""

    def shared(x: np.ndarray, y: np.ndarray) -> int:
        m = min(len(x), len(y))
        unlike = x[:m] != y[:m]
        return int(unlike.argmax()) if unlike.any() else m

    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return shared(x, y), shared(x[::-1], y[::-1])


class Scan:
    """Verifies the pairs of blocks whose rows follow each other."""

    def __init__(self, block: np.ndarray, words: list[bytes], n: np.ndarray, short: np.ndarray, path: np.ndarray):
        self.words, self.n, self.short, self.path = words, n, short, path
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        self.end = np.repeat(np.append(heads[1:], len(block)), np.diff(np.append(heads, len(block))))
        # The words that are not too long as rows of letters, flush left and flush right, with two kinds of padding.
        own = [w if len(w) <= _WIDE else b"" for w in words]
        width = max(map(len, own)) + 1
        rows = lambda pad, fill: np.frombuffer(b"".join(pad(w, width, fill) for w in own), np.uint8).reshape(-1, width)
        self.left, self.right = ([rows(pad, fill) for fill in (b"\0", b"\1")] for pad in (bytes.ljust, bytes.rjust))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of a block, some at a time."""
        after = self.end - np.arange(len(self.end)) - 1
        stop = np.cumsum(after)
        at = 0
        while at < len(after):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + _PAIRS, "right")))
            own = after[at:to]
            i = np.repeat(np.arange(at, to), own)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
            at = to

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j) of words that one edit parts, each pair of the corpus in just one block."""
        found = [self._verified(i, j) for i, j in self.candidates()]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shorter, longer, short = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j]), self.short[i]
        fits = (self.short[j] == short) & (self.path[i] == self.path[j]) & (shorter == short) & (longer - shorter <= 1)
        i, j, short, longer = i[fits], j[fits], short[fits], longer[fits]
        wide = longer > _WIDE
        prefix, suffix = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        prefix[~wide], suffix[~wide] = self._ends(i[~wide], j[~wide])
        for k in np.flatnonzero(wide).tolist():
            prefix[k], suffix[k] = common_ends(self.words[i[k]], self.words[j[k]])
        one = (prefix + suffix >= short - (longer == short)) & ((prefix < short) | (longer > short))
        one &= self._own_block(prefix, short, self.path[i])
        return i[one], j[one]

    def _ends(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`common_ends` of pairs of rows. Their paddings differ, so each comparison finds an end."""
        return (self.left[0][i] == self.left[1][j]).argmin(axis=1), (self.right[0][i] == self.right[1][j])[:, ::-1].argmin(axis=1)

    @staticmethod
    def _own_block(prefix: np.ndarray, short: np.ndarray, path: np.ndarray) -> np.ndarray:
        """True where a pair with this common prefix belongs to the block: its way through the halvings is the block's path."""
        front, back, way = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64), np.ones(len(short), np.int64)
        for _ in range(int(path.max()).bit_length() - 1 if len(path) else 0):
            on = way < (1 << (np.frexp(path.astype(np.float64))[1] - 1))  # not yet as many digits as the path
            half = (short - front - back) // 2
            first = prefix - front >= half
            way = np.where(on, way * 2 + ~first, way)
            front, back = front + half * (on & first), back + half * (on & ~first)
        return way == path

    def summed(self) -> tuple[list, np.ndarray, np.ndarray, list]:
        """Each word that has near words here: word, how many, the largest count among them, and the word that has it."""
        i, j = self.near()
        if not len(i):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
        names = sorted({self.words[k] for k in np.unique(np.concatenate([i, j])).tolist()})
        rank = {w: k for k, w in enumerate(names)}
        number = lambda rows: np.fromiter((rank[self.words[k]] for k in rows.tolist()), np.int64, len(rows))
        own, other = np.concatenate([i, j]), np.concatenate([j, i])
        own_rank, other_rank, n = number(own), number(other), self.n[other]
        order = np.lexsort((other_rank, -n, own_rank))
        own_rank, other_rank, n = own_rank[order], other_rank[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], own_rank[1:] != own_rank[:-1]]))
        text = lambda ranks: [names[k].decode("latin-1") for k in ranks.tolist()]
        return text(own_rank[head]), np.diff(np.append(head, len(own_rank))), n[head], text(other_rank[head])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best_n, best) from (block, word, n, short, path) in the order of blocks."""

    def made(t: pa.Table) -> pa.RecordBatch:
        block, n, short, path = (t.column(c).to_numpy() for c in ("block", "n", "short", "path"))
        got = Scan(block, [w.encode("latin-1") for w in t.column("word").to_pylist()], n, short.astype(np.int64), path).summed()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < _ROWS:
            continue
        t = pa.Table.from_batches(held)
        block = t.column("block").to_numpy()
        last = int(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))[-1])  # this block may go on
        if last:
            yield made(t.slice(0, last))
            held = t.slice(last).to_batches()
    if held:
        yield made(pa.Table.from_batches(held))


def near_words(words: DataFrame, block_words: int = 400, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones: best is the most frequent of them."""
    rows = blocks(words, block_words, least_length).select("block", "word", "n", "short", "path")
    # The entry of the dictionary that the block is a range of: the forward or the reversed one.
    entry = F.when(F.col("path") % 2 == 0, F.col("word")).otherwise(F.reverse("word"))
    scan = rows.repartition("block").sortWithinPartitions("block", entry).mapInArrow(_scanned, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return scan.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, twice as far in each round."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 2, block_words: int = 400, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the dictionary. A form is at least `times` as frequent as its word."""
    words = cut(dictionary(docs, key, text, least_length, least_count, drop_one_in))
    near = words.join(near_words(words, block_words, least_length), "word", "left")
    is_form: Column = F.col("best_n") >= times * F.col("n")
    found = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
