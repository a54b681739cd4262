"""Operator 11: near duplicates by SimHash, with a self-join of binary tries.

1. A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles, repeats included. Documents
   of one fingerprint form a class; from here on each fingerprint is a row of its own, whatever the number of its copies.
2. Two fingerprints that differ in at most `errors` bits agree in one of `errors + 1` blocks of bits. So each fingerprint
   goes into that many tries, turned so that another block comes first; the block's value names a cell, which is the subtree
   below it, and no pair is lost. A cell of more than `cell_sets` fingerprints is dealt to parts of that size, each with the
   cell's least and greatest fingerprint. What links leave outside a large cell's largest group is compared with the
   whole cell, but one level deeper: the remaining bits are cut into blocks again, and only subtrees with such a fingerprint
   go on. A level makes `errors + 1` copies, and a subtree that is deep enough holds few values whatever the input.
3. A task joins the compressed binary tries of many cells with themselves. It goes down pairs of nodes together, from (root,
   root); the bits in which two nodes differ above their splits add up, and a pair beyond the budget is dropped with all
   below it. The budget grows from one bit to `errors`, and pairs of nodes whose leaves are all linked already are dropped
   too, so that a group of very many near copies is not compared pair by pair. A task returns a forest of its links.
4. Forests are combined by connected components.

Only fingerprints, edges and keys are shuffled, never texts. A very common fingerprint is met by broadcast (`meet`).

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle's size
are one shingle; a bit that is set in just half of the hashes is 0; repeated rows have one fingerprint; very long texts are
read whole; a null key never is a component_id unless all keys of a component are null; an empty table gives an empty result;
other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, map_text, meet
from .components import connected

SHINGLE, ERRORS, SEED = 3, 3, 42
#: Fingerprints that a task joins at once, and pairs of nodes that it holds at once.
_ROWS, _PAIRS = 50_000, 1_000_000
#: Shingles of a text whose bits are counted at once.
_CHUNK = 100_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACE = (np.arange(8) * 256)[None, :]
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and the separators are \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(size)), strict=False) if len(words) > size else [words]
    n = max(1, len(words) - size + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, shingles)), np.uint64, n)
    # How often each byte value stands at each of the eight places, and from that how often each bit is set.
    octets = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    seen = sum(np.bincount((octets[k : k + _CHUNK] + _PLACE).ravel(), minlength=2048) for k in range(0, n, _CHUNK)).reshape(8, 256)
    ones = (seen @ _BITS) * 2 > n
    return int(np.packbits(ones.ravel(), bitorder="little").view("<i8")[0])


class Tries:
    """The compressed binary tries of several cells, side by side.

    keys: ascending and distinct; those of a cell share all bits above `bits`. A node is a range of keys and the bit at which
    they part, 0 for a single key; the children of a node are neighbours.
    """

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys = keys
        cell = keys >> np.uint64(bits) if bits < 64 else np.zeros(len(keys), np.uint64)
        lo = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        hi = np.append(lo[1:], len(keys))
        self.roots, made, n = np.arange(len(lo)), [], len(lo)
        while len(lo):
            apart = keys[lo] ^ keys[hi - 1]
            split = np.where(hi - lo > 1, _ONE << (np.maximum(np.frexp(apart.astype(np.float64))[1], 1) - 1).astype(np.uint64), np.uint64(0))
            inner = split > 0
            middle = np.searchsorted(keys, (keys[lo] & ~(split + split - _ONE)) | split)
            child = np.where(inner, n + 2 * (np.cumsum(inner) - 1), -1)
            made.append((lo, hi, split, child))
            a, m, b = lo[inner], middle[inner], hi[inner]
            lo, hi = np.stack([a, m], 1).ravel(), np.stack([m, b], 1).ravel()
            n += len(lo)
        self.lo, self.hi, self.split, self.child = (np.concatenate(x) for x in zip(*made, strict=True))
        self.known = ~np.where(self.split > 0, self.split + self.split - _ONE, np.uint64(0))  # bits above the split
        self.value = keys[self.lo]

    def labels(self, errors: int) -> np.ndarray:
        """For each key the least position of those that links of at most `errors` bits connect it with."""
        label = np.arange(len(self.keys))
        for budget in range(1, errors + 1):
            todo, same = [(self.roots, self.roots)], self._alike(label)
            while todo:
                a, b = todo.pop()
                if len(a) > _PAIRS:
                    half = len(a) // 2
                    todo += [(a[half:], b[half:]), (a[:half], b[:half])]
                    continue
                differ = np.bitwise_count((self.value[a] ^ self.value[b]) & self.known[a] & self.known[b])
                live = (differ <= budget) & ((same[a] != same[b]) | (same[a] < 0))
                a, b = a[live], b[live]
                leaves = (self.child[a] < 0) & (self.child[b] < 0)
                if leaves.any():
                    label = _merged(label, self.lo[a[leaves]], self.lo[b[leaves]])
                    same = self._alike(label)
                    a, b = a[~leaves], b[~leaves]
                if len(a):
                    todo.append(self._below(a, b))
        return label

    def _alike(self, label: np.ndarray) -> np.ndarray:
        """Each node's label, if all its keys have the same one; else -1."""
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        return np.where(change[self.hi - 1] == change[self.lo], label[self.lo], -1)

    def _below(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next pairs: a node with itself gives three, of two nodes the one that parts higher up is split."""
        own = a == b
        left = self.child[a[own]]
        a, b = a[~own], b[~own]
        upper = self.split[a] >= self.split[b]
        c, d = np.where(upper, a, b), np.where(upper, b, a)
        return np.concatenate([left, left, left + 1, self.child[c], self.child[c] + 1]), np.concatenate([left, left + 1, left + 1, d, d])


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with the groups of i and j joined, pair by pair."""
    label = label.copy()
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def _forest(agreed: int, errors: int):
    """Edges (a, b) of fingerprints from (cell, part, value, fp) in the order of cell and part."""

    def joined(cell: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        bits = 64 - agreed
        ids = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]).any(axis=1)])).astype(np.uint64)
        keys, first = np.unique((ids << np.uint64(bits)) | (value.view(np.uint64) & np.uint64((1 << bits) - 1)), return_index=True)
        label, names = Tries(keys, bits).labels(errors), fp[first]
        tied = np.flatnonzero(label != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[label[tied]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = [], (1 << min(agreed, 62)) - 1
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                held.append(np.stack([c.to_numpy() for c in b.slice(at, _ROWS).columns], 1))
                if sum(map(len, held)) < _ROWS:
                    continue
                rows = np.concatenate(held)
                starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
                # Whole cells only: the last one may go on. As many cells at once as their numbers have room for.
                for k in range(0, len(starts) - 1, most):
                    s = slice(starts[k], starts[min(k + most, len(starts) - 1)])
                    yield joined(rows[s, :2], rows[s, 2], rows[s, 3])
                held = [rows[starts[-1] :]]
        rows = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
        starts = np.append(np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else [], len(rows)).astype(int)
        for k in range(0, len(starts) - 1, most):
            s = slice(starts[k], starts[min(k + most, len(starts) - 1)])
            yield joined(rows[s, :2], rows[s, 2], rows[s, 3])

    return run


def _deeper(rows: DataFrame, agreed: int, path_bits: int, width: int, errors: int) -> DataFrame:
    """(cell, value, fp, out) of the next level: value has another block of `width` bits after the `agreed` first ones."""
    low, full = 64 - agreed, F.lit(-1 << (64 - agreed) if agreed else 0)
    below = F.lit((1 << low) - 1 if agreed else -1)
    step = path_bits  # bits of a path's step

    def turned(r: int) -> Column:
        tail = F.col("value").bitwiseAND(below)
        moved = tail if not r else F.shiftleft(tail, r * width).bitwiseOR(F.shiftrightunsigned(tail, low - r * width)).bitwiseAND(below)
        value = F.col("value").bitwiseAND(full).bitwiseOR(moved)
        path = F.shiftleft(F.col("path"), step) + r
        return F.struct(path.alias("path"), value.alias("value"))

    out = rows.select("fp", "out", F.explode(F.array(*[turned(r) for r in range(errors + 1)])).alias("t")).select("fp", "out", "t.*")
    prefix = F.shiftrightunsigned("value", 64 - agreed - width)
    return out.withColumn("cell", F.shiftleft("path", agreed + width).bitwiseOR(prefix))


def fingerprint_links(prints: DataFrame, errors: int = ERRORS, cell_sets: int = 8_192) -> DataFrame:
    """(id, component) of every fingerprint of prints (fp: distinct longs) that has a link; component is the least one that it reaches."""
    if not 1 <= errors <= 4:
        raise ValueError("errors is 1 to 4")
    path_bits = errors.bit_length()
    level, agreed, edges, tied = 0, 0, None, None
    rows = prints.select("fp", F.col("fp").alias("value"), F.lit(0).cast("long").alias("path"), F.lit(True).alias("out"))
    while True:
        width = (64 - agreed) // (errors + 1)
        # A cell's number has its path and all agreed bits; one level more must still fit into 64 bits and leave bits to compare.
        next_width = (64 - agreed - width) // (errors + 1)
        last = next_width < 1 or (level + 2) * path_bits + agreed + width + next_width > 64
        rows = _deeper(rows, agreed, path_bits, width, errors)
        agreed += width
        sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("out").alias("any_out"), F.min("fp").alias("first"), F.max("fp").alias("last")).filter("n > 1 and any_out"))
        total = sizes.agg(F.sum("n")).first()[0]
        if total is None:
            break
        parts = F.lit(1) if last else F.ceil(F.col("n") / cell_sets)
        dealt = cut(meet(rows, sizes.withColumn("parts", parts.cast("long")).drop("any_out"), "cell", F.col("n") * HOT_KEYS > total))
        own = F.pmod(F.xxhash64("fp"), "parts")
        everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        at = F.when(F.col("fp").isin(F.col("first"), F.col("last")), everywhere).otherwise(F.array(own))
        spread = dealt.select("cell", F.explode(at).alias("part"), "value", "fp").repartition("cell", "part").sortWithinPartitions("cell", "part")
        found = cut(spread.mapInArrow(_forest(agreed, errors), "a long, b long"))
        edges, tied = found if edges is None else edges.unionByName(found), None
        large = dealt.filter("parts > 1")
        if last or large.isEmpty():
            break
        tied = connected(edges)
        rows = _left_over(large, tied)
        if rows is None:
            break
        level += 1
    if edges is None:
        return prints.select(F.col("fp").alias("id"), F.col("fp").alias("component")).filter("false")
    return connected(edges) if tied is None else tied


def _left_over(large: DataFrame, tied: DataFrame) -> DataFrame | None:
    """The rows of large cells of which links leave something outside the largest group; `out` marks what is outside."""
    grouped = large.join(tied.withColumnsRenamed({"id": "fp", "component": "tree"}), "fp", "left").withColumn("tree", F.coalesce("tree", "fp"))
    groups = grouped.groupBy("cell", "tree").agg(F.count("*").alias("size"))
    main = groups.groupBy("cell").agg(F.max_by("tree", F.struct("size", "tree")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"))
    main = cut(main.filter("most < `all`"))
    if main.isEmpty():
        return None
    met = meet(grouped, main, "cell", F.col("all") * HOT_KEYS > large.count())
    return cut(met.select("fp", "value", "path", (F.col("tree") != F.col("main")).alias("out")))


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, errors: int = ERRORS, cell_sets: int = 8_192) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id, and links: how many other fingerprints the component has; one row per row of docs."""

    def score(batches: Iterator[list]) -> Iterator[tuple]:
        for texts in batches:
            yield (pa.array([fingerprint(t, size) for t in texts], pa.int64()),)

    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = cut(map_text(named, ["key"], "text", "fp long", score))
    classes = cut(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("rows")))
    tied = fingerprint_links(classes.select("fp"), errors, cell_sets)

    joined = cut(classes.join(tied.withColumnRenamed("id", "fp"), "fp"))
    ends = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    linked = meet(joined, ends, "component", F.col("prints") * HOT_KEYS > joined.count()).select("fp", "component_id", "prints", "rows")
    alone = classes.filter("rows > 1").join(joined.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.lit(1).cast("long").alias("prints"), "rows")
    out = meet(rows, linked.unionByName(alone), "fp", F.col("rows") * HOT_KEYS > rows.count(), keep=True)
    return out.select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "key").alias("component_id"),
        (F.coalesce("prints", F.lit(1).cast("long")) - 1).alias("links"),
    )
