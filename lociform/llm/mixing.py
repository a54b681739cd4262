"""Operator 9: mixing sources to target weights by pivotal dependent rounding.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `budget` times all
sizes; a target stops at `cap` times its source's size and the excess is reshared by weight until none is
above. That level is found from two sums over the sources a round, so the number of sources is not bounded.

Rounding. A document of a source whose target is r times its size is taken floor(r) times, and once more
with probability r - floor(r). Pairs exchange word mass at random until one side is taken or left for
certain; each document keeps its probability in expectation and the source's words stay the same. Rows that
are alike in key, source and size are rounded among themselves first: m of them are one entry, of which the
whole part of m times the probability is taken, and only the rest is open. Each source deals its entries to
buckets of about `bucket_rows` by a hash of all three; in a bucket the largest open document is paired with the
smaller ones together, which share one probability, so that what a bucket leaves open is one small document. These
residuals are combined by a reduction tree of `fan_in` buckets a node, a tree for each source. The last open
document of a source is drawn by its probability, so a source misses its target by less than one document.

No group grows with the input: sources never exchange mass, a bucket holds about `bucket_rows` entries whatever
keys or sources are common, and buckets are dealt to tasks together by hash, so that many small sources share one.
Every draw comes from the seed, the level, the source and the bucket: reruns agree, whatever the partitions are.

Defined cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own,
ordered last; keys of any type that can be grouped, nulls too, come back as they were; repeated rows are copies of
their own, of which some may be taken once more than others; very long texts are counted whole; ties in size are ordered
by a hash of the key, then the key; an empty table gives an empty result. Other columns of the input, whatever their
names, take no part.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

WEIGHTS = (5, 2, 1)
_TINY = 1e-9


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    edges = body.rlike(f"\\A{SPACE}").cast("int") + body.rlike(f"{SPACE}\\z").cast("int")
    return F.when(body.rlike("[^\\x20\\x09-\\x0D]"), F.size(F.split(body, SPACE)) - edges).otherwise(0).cast("long")


def ranked(df: DataFrame, name: str) -> DataFrame:
    """df with `rank`, the row number by `name` (nulls last) from 0, without one task that holds all rows."""
    dealt = df.repartitionByRange(F.col(name).asc_nulls_last()).sortWithinPartitions(F.col(name).asc_nulls_last())
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid")))
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in counts:
        starts += [F.lit(part), F.lit(before)]
        before += n
    start = F.create_map(*starts)[F.col("part")] if starts else F.lit(0)
    return dealt.withColumn("rank", start + F.col("mid") - F.shiftleft(F.col("part").cast("long"), 33)).drop("part", "mid")


def targets(sources: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources, a DataFrame with source and source_size, with `target`."""
    by = ranked(sources, "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    by = cut(by.withColumn("weight", weight))
    most, level = cap * F.col("source_size"), 0.0
    share = budget * float(by.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("weight") * level > most
        row = by.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            return by.select(*sources.columns, most.alias("target"))
        now = (share - row[0]) / row[1]
        if now <= level:
            break
        level = now
    return by.select(*sources.columns, F.least(most, F.col("weight") * level).alias("target"))


def pivot(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Exchange word mass along the list until all chances but one at most are 0 or 1."""
    out, open_at = list(chances), -1
    for j, b in enumerate(out):
        if b <= _TINY or b >= 1 - _TINY:
            out[j] = float(round(b))
            continue
        if open_at < 0:
            open_at = j
            continue
        i, a, si, sj = open_at, out[open_at], sizes[open_at], sizes[j]
        up, down = min((1 - a) * si, b * sj), min(a * si, (1 - b) * sj)
        move = up if draw.random() * (up + down) < down else -down
        out[i], out[j] = a + move / si, b - move / sj
        still = []
        for k in (i, j):
            if _TINY < out[k] < 1 - _TINY:
                still.append(k)
            else:
                out[k] = float(round(out[k]))
        open_at = still[0] if still else -1
    return out


def settle(sizes: list[int], chance: float, draw: random.Random) -> list[float]:
    """The same for documents that share one chance, largest first: each is paired with all that follow it."""
    out, total = [chance] * len(sizes), sum(sizes)
    for i, s in enumerate(sizes):
        if chance <= _TINY or chance >= 1 - _TINY:
            out[i:] = [float(round(chance))] * (len(sizes) - i)
            break
        rest = total - s
        up, down = min((1 - chance) * s, chance * rest), min(chance * s, (1 - chance) * rest)
        if up + down <= _TINY:
            continue
        move = up if draw.random() * (up + down) < down else -down
        mine, chance, total = chance + move / s, chance - move / rest, rest
        if _TINY < mine < 1 - _TINY:
            out[i] = mine
            out[i + 1 :] = [float(round(chance))] * (len(sizes) - i - 1)
            break
        out[i] = float(round(mine))
    return out


def resolved(sizes: list[int], chances: list[float], alone: list[bool], draw: random.Random) -> list[float]:
    """settle for the open documents that share one chance (alone), then pivot for what that leaves and the others."""
    out = list(chances)
    same = [i for i, one in enumerate(alone) if one and chances[i] > 0]
    for i, p in zip(same, settle([sizes[i] for i in same], chances[same[0]], draw) if same else [], strict=True):
        out[i] = p
    return pivot(sizes, out, draw)


def _resolver(seed: int, level: int):
    """Rounds the entries of some buckets; a source's only bucket is its tree's root, where the last one is drawn."""

    def resolve(entries: pa.Table) -> pa.Table:
        # Large documents first: the many small ones after them settle them, so what stays open is small.
        order = [("tree", "ascending"), ("bucket", "ascending"), ("size", "descending"), ("place", "ascending"), ("name", "ascending")]
        entries = entries.sort_by(order)
        tree, bucket, roots, sizes, chance, m = (entries.column(c).to_pylist() for c in ("tree", "bucket", "buckets", "size", "chance", "m"))
        start = 0
        for end in range(1, len(tree) + 1):
            if end == len(tree) or (tree[end], bucket[end]) != (tree[start], bucket[start]):
                draw = random.Random(f"{seed}|{level}|{tree[start]}|{bucket[start]}")
                part = resolved(sizes[start:end], chance[start:end], [level == 0 and x == 1 for x in m[start:end]], draw)
                chance[start:end] = [float(draw.random() < p) for p in part] if roots[start] == 1 else part
                start = end
        return entries.set_column(entries.schema.get_field_index("chance"), "chance", pa.array(chance, pa.float64()))

    return resolve


#: Up to so many rows that are alike are entries of their own; repeated rows that one task writes at once.
_ALONE, _COPIES = 64, 4_096


def _rows(entries: DataFrame) -> DataFrame:
    """A row for each of the m rows of an entry, with `nth` from 0; an entry of very many rows is spread over tasks."""
    few = entries.filter(F.col("m") <= _COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("nth"))
    runs = entries.filter(F.col("m") > _COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _COPIES))).alias("run")).repartition("place", "run")
    last = F.least(F.col("run") * _COPIES + _COPIES, F.col("m")) - 1
    return few.unionByName(runs.select("*", F.explode(F.sequence(F.col("run") * _COPIES, last)).alias("nth")).drop("run"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: float = 1.5, cap: float = 2.0, seed: int = 17, bucket_rows: int = 8192, fan_in: int = 64) -> DataFrame:
    """key, size, source_size, target, taken (words, copies counted) and copies, one row per row of docs."""
    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    alike = named.groupBy("id", "source", "size").agg(F.count("*").alias("m"))
    alone = F.when(F.col("m") <= _ALONE, F.array_repeat(F.lit(1).cast("long"), F.col("m").cast("int"))).otherwise(F.array("m"))
    alike = cut(alike.select("id", "source", "size", F.explode(alone).alias("m")))
    sources = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.ceil(F.count("*") / bucket_rows).alias("buckets"))
    goal = targets(sources, budget, cap).withColumnRenamed("source", "goal_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.col("id").cast("string")
    rows = alike.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        "id", "size", "source_size", "target", "m", F.floor(ratio).cast("long").alias("whole"), F.when(F.col("size") > 0, (ratio - F.floor(ratio)) * F.col("m")).otherwise(0.0).alias("more"),
        F.concat(F.lit("="), "source").alias("tree"), name.alias("name"), F.xxhash64(name, "source", "size").alias("place"), "buckets",
    )
    # Whole copies among rows that are alike are certain; rounding noise just below a whole number is none.
    sure = F.floor(F.col("more") + _TINY)
    rows = rows.select(
        "id", "size", "source_size", "target", "m", "whole", sure.cast("long").alias("extra"), F.greatest(F.col("more") - sure, F.lit(0.0)).alias("chance"),
        F.coalesce("tree", F.lit("")).alias("tree"), "name", "place", F.pmod("place", "buckets").alias("bucket"), "buckets",
    )
    settled, level = [], 0
    total = rows.count()
    while True:
        deals = max(1, -(-total // bucket_rows))
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("tree", "bucket"), F.lit(deals)))
        rows = cut(dealt.groupBy("deal").applyInArrow(_resolver(seed, level), dealt.schema)).drop("deal")
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(rows.filter(~is_open))
        rows = rows.filter(is_open).withColumns({"bucket": F.floor(F.col("bucket") / fan_in), "buckets": F.ceil(F.col("buckets") / fan_in)})
        total, level = rows.count(), level + 1
        if not total:
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + (F.col("nth") < F.col("extra") + F.col("chance").cast("long")).cast("long")
    return _rows(out).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
