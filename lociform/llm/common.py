"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Word separators of the contract: `[^\x20\x09-\x0D]+` are words.
SPACE = "[\\x20\\x09-\\x0D]+"


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def is_fold(key: str, parts: int, which: int) -> Column:
    """True where the key falls in the fold; false for a null key."""
    return F.coalesce(fold(key, parts) == which, F.lit(False))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def arrow_fields(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])


def map_text(df: DataFrame, keep: list[str], text: str, made: str, score: Callable[[Iterator], Iterator], compute_text: str = "binary", most: int | None = None) -> DataFrame:
    """Append columns that Python derives from whole texts, batch by batch, without a shuffle.

    score: takes an iterator of lists of texts (bytes, or str if compute_text is "string"; None for null)
    and yields a tuple of column values for each list. made: DDL of these columns.
    keep: the columns that pass through as they are. most: bytes of texts in a list, about; None: a list for each batch.
    """
    extra = T.StructType.fromDDL(made) if not isinstance(made, T.StructType) else made
    out = T.StructType([*[df.schema[c] for c in keep], *extra])
    fields = arrow_fields(extra)
    body = free_name(df, "body__")
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast(compute_text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def texts() -> Iterator[list]:
            for b in batches if most is None else runs(batches, len(keep), most):
                kept.append(b)
                yield b.column(len(keep)).to_pylist()

        for made_columns in score(texts()):
            b = kept.pop(0)
            new = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made_columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *new], names=[*keep, *fields.names])

    return picked.mapInArrow(run, out)


#: Bytes of a batch's texts that a task takes up at once where it makes much of each.
RUN_BYTES = 2_000_000


def runs(batches: Iterator[pa.RecordBatch], column: int, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about `most` bytes of a binary column; a longer value is a run of its own."""
    for b in batches:
        stops = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(b.column(column)), 0), pa.int64())).to_numpy()
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there.

    The folder is what spark.checkpoint.dir names. Where that is unset, a session on one machine (tests) takes a folder
    under its warehouse; on a cluster it is an error, as executors would not see each other's files.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"


def most_frequent(scores: DataFrame, most: int) -> Column:
    """Which rows of a table with counts n to send with the tasks: the classes of the largest n, as long as they have `most` rows at most."""
    level = F.floor(F.log2(F.col("n") + 1.0) * 16).cast("int")
    total, least = 0, 1 << 20
    for r in sorted(scores.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):  # 1,024 classes at most
        total += r["rows"]
        if total > most:
            break
        least = r["level"]
    return level >= least


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: `cut` for wide rows, which it holds in less space."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: At most so many keys can hold more than 1/HOT_KEYS of the rows each, so a table of them can be broadcast.
HOT_KEYS = 1_000


def meet(rows: DataFrame, found: DataFrame, key: str, hot: Column, keep: bool = False) -> DataFrame:
    """rows joined with found by key; found has each key once and no other column of rows. keep: rows without a match stay.

    hot: which rows of found have a key that holds more than 1/HOT_KEYS of the rows. There are HOT_KEYS of them at most;
    they are broadcast, so that their rows stay where they are. All other keys are joined by a shuffle. Rows with a null
    key match nothing and are not shuffled.
    """
    hot = F.coalesce(hot, F.lit(False))
    few, rest = F.broadcast(found.filter(hot)), found.filter(~hot)
    have = rows.filter(F.col(key).isNotNull())
    out = have.join(few, key).unionByName(have.join(few.select(key), key, "left_anti").join(rest, key, "left" if keep else "inner"))
    return out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True) if keep else out


def sample_cutoff(marks: DataFrame, most: int) -> int | None:
    """The largest of the `most` smallest distinct values of a DataFrame of one long column; null for none.

    Rows whose mark is not above it are a bounded sample, however often a row is repeated.
    """
    (name,) = marks.columns
    return marks.distinct().orderBy(name).limit(most).agg(F.max(name)).first()[0]


def mark_of(key: Column, text: Column) -> Column:
    """A hash of key and text: alike for repeated rows only."""
    return F.xxhash64(key.cast("string"), text.cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
