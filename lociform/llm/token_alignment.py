"""Operator 12: alignment of two tokenizers' tokens of the same texts, and how often tokens are linked over the corpus.

1. A task encodes texts with both vocabularies, in runs of about `_RUN` characters, and works on the bytes that each token stands for.
   The libraries encode a pre-token, which no merge reaches over, once and not each time that it occurs, many in one call.
   With arrays over a whole run: cumulative sums are the tokens' ends; where ends of both sides meet (`intersect1d`) is a cut, and
   a token's place among the cuts (`searchsorted`) is its group; a token of the first side overlaps a range of tokens of the
   other one, which `repeat` expands to links. A text's links are kept as distinct pairs with their times, in a table.
2. Pairs are counted by the documents that hold them: Spark adds up within a task and within one of `salts` parts of a pair
   first, then over all. So a pair that each document holds sends one row a task, to several reducers.
3. Counts return to the documents: the `common` most frequent pairs, of fixed width, travel with the tasks as sorted arrays; the
   others are listed by document and joined by a shuffle. None of those is frequent, so no key of that join is hot.

Texts and tokens are not shuffled. The best count of each token of the first side is a table of one row per vocabulary entry.

Defined cases: texts that are null, empty or that one of the vocabularies cannot give back byte by byte have no tokens: their
numbers are 0 and their groups are empty; strings of special tokens are plain text; repeated rows and null keys are documents of
their own, each counted; of pairs with the same count all are best; very long texts are aligned whole; an empty table gives an
empty result; other columns take no part, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import most_frequent, written
from .token_counts import pre_tokens

#: Characters of the texts that a task aligns at once; a longer text makes a run of its own. Characters of pre-tokens that it remembers.
_RUN, _REMEMBERED = 200_000, 4_000_000
#: Pre-tokens that a byte-level vocabulary encodes at once.
_IN_A_ROW = 256
#: Before a space with a printable ASCII character after it, a byte-level vocabulary always begins a new pre-token.
_START = re.compile(" (?=[!-~])")
_LINKS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable Latin-1 bytes for themselves, the others from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Coder:
    """A vocabulary: `pieces` are the bytes of each id. Called with texts, it gives the ids of a space and each text.

    Ids are 32-bit integers in a row, or None where their bytes are not the text's. parts: cuts a text where no merge reaches over;
    each part is encoded, with a space before it, once and not each time that it occurs, until _REMEMBERED characters are known.
    encode: orders a list of parts as it likes and gives all their ids in a row and how many each part has.
    faithful: false for texts whose parts are not the text itself.
    """

    def __init__(self, pieces: list[bytes], parts: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[list[int], list[int]]], faithful: Callable[[str], bool] = lambda text: True):
        self.pieces, self.parts, self.encode, self.faithful = pieces, parts, encode, faithful
        self.known, self.wrong, self.size = {}, set(), 0

    def learn(self, new: list[str]) -> None:
        """Remember the ids of parts, and which parts' bytes they do not give back: all are compared at once, and one by one only where those differ."""
        ids, counts = self.encode(new)
        packed, stops = np.array(ids, np.int32).tobytes(), np.cumsum(counts) * 4
        self.known.update(zip(new, map(packed.__getitem__, map(slice, [0, *stops.tolist()], stops.tolist())), strict=True))
        self.size += sum(map(len, new))
        made = [*map(self.pieces.__getitem__, ids)]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])[np.concatenate([[0], stops // 4])]
        joined, said = b"".join(made), [*map(str.encode, new)]
        if joined != b" " + b" ".join(said) or (np.diff(ends) != np.fromiter(map(len, said), np.int64, len(said)) + 1).any():
            self.wrong.update(p for p, x, a, b in zip(new, said, ends.tolist(), ends[1:].tolist(), strict=False) if joined[a:b] != b" " + x)

    def __call__(self, texts: list[str]) -> list[bytes | None]:
        if self.size > _REMEMBERED:
            self.known, self.wrong, self.size = {}, set(), 0
        cut = [self.parts(t) for t in texts]
        if new := list(set().union(*cut).difference(self.known)):
            self.learn(new)
        good = [self.faithful(t) and (not self.wrong or self.wrong.isdisjoint(ps)) for t, ps in zip(texts, cut, strict=True)]
        return [b"".join(map(self.known.__getitem__, ps)) if ok else None for ps, ok in zip(cut, good, strict=True)]


def byte_level(file: str) -> Coder:
    """A byte-level vocabulary, which encodes a space and the text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    coder, letters = Tokenizer.from_file(file), byte_letters()
    coder.encode_special_tokens = True
    pieces = [b""] * coder.get_vocab_size()
    for entry, i in coder.get_vocab().items():
        pieces[i] = bytes(letters[c] for c in entry)

    def each(parts: list[str]) -> tuple[list[int], list[int]]:
        ids = [e.ids for e in coder.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return [*chain.from_iterable(ids)], [*map(len, ids)]

    sizes = np.array([len(p) for p in pieces], np.int64)

    def encode(parts: list[str]) -> tuple[list[int], list[int]]:
        # Parts that begin with printable ASCII are encoded in a row, as the texts have them; a part's ids are those up to its last byte.
        ids, counts = each(others := [p for p in parts if not "!" <= p[:1] <= "~"])
        plain = [p for p in parts if "!" <= p[:1] <= "~"]
        parts[:] = others + plain
        for at in range(0, len(plain), _IN_A_ROW):
            some = plain[at : at + _IN_A_ROW]
            (row,) = coder.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            own = row.ids
            ends = np.cumsum(sizes[own])
            stops = np.cumsum([len(p.encode()) + 1 for p in some])
            last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            more = np.diff(last, prepend=-1).tolist()
            if ends[-1] != stops[-1] or (ends[last] != stops).any():  # a vocabulary that changes the text
                own, more = each(some)
            ids += own
            counts += more
        return ids, counts

    return Coder(pieces, _START.split, encode)


def word_pieces(file: str) -> Coder:
    """A vocabulary of pieces with marks for spaces and bytes as last resort; it adds the space itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=file)
    names = [(coder.id_to_piece(i), coder.is_byte(i)) for i in range(coder.get_piece_size())]
    pieces = [bytes([int(p[3:-1], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in names]
    bare = [coder.piece_to_id("▁")]  # what an empty pre-token stands for

    def encode(parts: list[str]) -> tuple[list[int], list[int]]:
        ids = [ids if p else bare for p, ids in zip(parts, coder.encode(parts, num_threads=1), strict=True)]
        return [*chain.from_iterable(ids)], [*map(len, ids)]

    return Coder(pieces, pre_tokens, encode, lambda text: "▁" not in text)  # a mark in the text comes back as a space


class Aligner:
    """Aligns runs of texts; all arrays run over the texts of a run."""

    def __init__(self, a: Coder, b: Coder):
        self.a, self.b = a, b
        self.sizes = [np.array([len(p) for p in c.pieces], np.int64) for c in (a, b)]
        self.width = max(len(a.pieces), len(b.pieces))
        self.shown = [b"%d%b" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.width)]

    def __call__(self, texts: list[str | None]) -> tuple:
        """The columns of _LINKS."""
        used = [k for k, t in enumerate(texts) if t]
        coded = [c([texts[k] for k in used]) for c in (self.a, self.b)]
        good = [n for n in range(len(used)) if all(ids[n] is not None for ids in coded)]
        a, b = ([ids[n] for n in good] for ids in coded)
        counts = np.zeros((4, len(texts)), np.int64)
        groups, pairs, times = [""] * len(texts), np.zeros(0, np.int32), np.zeros(0, np.int32)
        offsets = np.zeros(len(texts) + 1, np.int32)
        if good:
            rows = np.array(used)[good]
            made, shown, pair_of, pairs, times = self.aligned(a, b)
            counts[:, rows] = made
            for k, text in zip(rows.tolist(), shown, strict=True):
                groups[k] = text
            offsets[1:] = np.cumsum(np.bincount(rows[pair_of], minlength=len(texts)))
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (pairs, times)]
        return *(pa.array(c) for c in counts), pa.array(groups, pa.string()), *lists

    def aligned(self, a: list[bytes], b: list[bytes]) -> tuple:
        """Counts (a, b, groups, links by text), the groups as text, and the distinct pairs: their text, pair and times."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b))
        ids_a, ids_b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (a, b))
        ends_a, ends_b = (np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, (ids_a, ids_b), strict=True))
        text_ends = ends_a[np.cumsum(n_a) - 1]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_groups = np.diff(np.searchsorted(cuts, text_ends, "right"), prepend=0)
        # Each token of a overlaps the tokens of b from the one that holds its first byte to the one that holds its last.
        first = np.searchsorted(ends_b, ends_a - self.sizes[0][ids_a], "right")
        span = np.searchsorted(ends_b, ends_a) - first + 1
        link_a = np.repeat(np.arange(len(ids_a)), span)
        link_b = np.arange(len(link_a)) + np.repeat(first - np.cumsum(span) + span, span)
        text_a = np.repeat(np.arange(len(a)), n_a)
        n_links = np.bincount(text_a, weights=span, minlength=len(a)).astype(np.int64)
        found, times = np.unique((text_a[link_a] << 32) | (ids_a[link_a] * len(self.b.pieces) + ids_b[link_b]), return_counts=True)
        shown = self.text_of(ids_a, ids_b, group_a, group_b, np.cumsum(n_a + n_b))
        return np.stack([n_a, n_b, n_groups, n_links]), shown, found >> 32, found & 0xFFFFFFFF, times

    def text_of(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, stops: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: a group's tokens of a, then those of b."""
        groups = int(group_a[-1]) + 1
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        entry = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        entry[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + self.width * last_a
        entry[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + self.width * 2 * last_b
        starts = np.concatenate([[0], stops[:-1]])
        return [b"".join(map(self.shown.__getitem__, entry[s:e].tolist()))[:-1].decode() for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]


def token_links(docs: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs and times; one row per row of docs.

    pairs: the distinct linked ids of the text, each as a times the size of the second vocabulary plus b; times: how many links each has.
    """

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL(_LINKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(byte_level(file_a), word_pieces(file_b))
        for b in batches:
            stops = pc.cumulative_sum(pc.fill_null(pc.utf8_length(b.column(1)), 0)).to_numpy() if b.num_rows else np.zeros(0, np.int64)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + _RUN, "right")))
                own = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([own.column(0), *align(own.column(1).to_pylist())], names=schema.names)
                at = to

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(links: DataFrame, b_size: int, salts: int = 16) -> DataFrame:
    """(pair, n, best): the documents that hold each pair, and whether no other pair of its first token has more."""
    each = links.select(F.explode("pairs").alias("pair"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    counts = written(each.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")))
    a = (F.col("pair") / b_size).cast("int")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row per entry of the first vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def token_alignment(
    docs: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text", shown: Callable[[Column], Column] = lambda groups: groups,
    common: int = 1_000_000, salts: int = 16,
) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups; one row per row of docs.

    n_best: links whose pair has the highest count of its first token; count_sum: the sum of the links' counts. shown: what to keep of
    the groups' text, where whole texts of it are not needed.
    """
    made = token_links(docs, file_a, file_b, key, text).withColumn("groups", shown(F.col("groups"))).withColumn("row", F.monotonically_increasing_id())
    links = written(made)
    counts = written(pair_counts(links, len(word_pieces(file_b).pieces), salts))
    is_common = most_frequent(counts, common)
    near = counts.filter(is_common).toArrow().sort_by("pair")  # `common` rows of 13 bytes at most
    sent = docs.sparkSession.sparkContext.broadcast([near.column(c).to_numpy() for c in ("pair", "n", "best")])
    own = ("key", "row", "n_a", "n_b", "n_groups", "n_links", "groups")
    schema = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in own) + ", n_best long, count_sum long, rare array<struct<pair int, times int>>"

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            lists, times = b.column(len(own)), b.column(len(own) + 1).flatten().to_numpy()
            mine = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
            known = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            summed = lambda x: np.concatenate([[0], np.cumsum(x)])
            stops = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            total = np.where(known, times.astype(np.int64) * n[at], 0) if len(pair) else np.zeros(len(mine), np.int64)
            chosen = np.where(known & best[at], times, 0).astype(np.int64) if len(pair) else total
            sums = [np.diff(summed(x)[stops]) for x in (chosen, total)]
            few = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=b.num_rows))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(few), pa.StructArray.from_arrays([pa.array(mine[~known]), pa.array(times[~known])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *(pa.array(s) for s in sums), rare], names=[*own, "n_best", "count_sum", "rare"])

    part = links.select(*own, "pairs", "times").mapInArrow(weighed, schema)
    numbers = [F.col(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    if near.num_rows == counts.count():
        return part.select(F.col("key").alias(key), *numbers, "n_best", "count_sum", "groups")
    part = written(part)
    far = part.select("row", F.inline("rare")).join(counts.filter(~is_common), "pair").groupBy("row")
    more = far.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = lambda own, other: (F.col(own) + F.coalesce(F.col(other), F.lit(0))).cast("long").alias(own)
    return part.join(more, "row", "left").select(F.col("key").alias(key), *numbers, both("n_best", "more_best"), both("count_sum", "more_sum"), "groups")
