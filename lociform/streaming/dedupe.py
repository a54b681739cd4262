"""Duplicate policies on a stream of records: one record for each key over all batches, with the place of the one that is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import POLICIES
from ..sources import datasource
from ..sources.header import Header
from ..sources.scan import from_lines

_PLACE = ["file", "line_no"]


def stream_records(spark: SparkSession, folder: str, header: Header, mode: str = "PERMISSIVE") -> DataFrame:
    """Records of the files that come into a folder, with file, line_no and `text`, their line. Files have headers, and later ones later names."""
    datasource.register(spark)
    lines = spark.readStream.format("vcf").schema("file string, line_no long, value string").load(folder)
    return from_lines(lines.withColumn("text", F.col("value")), header, mode=mode)


def dedupe_stream(records: DataFrame, keys: list[str], policy: str = "FAIL") -> DataFrame:
    """keys, file, line_no and text of the record that is kept for each key, each time that it changes (update mode).

    KEEP_FIRST and KEEP_LAST go by file and line, in whatever order batches bring them, so the last row for a key is what
    `store.dedupe` keeps of all files. FAIL stops the query at a key that comes twice, in one batch or in two. A key's state is one place;
    it is restored from the checkpoint. Records with a null in a key, and malformed lines, have no key and pass nothing on.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    columns = [*keys, *_PLACE, "text"]
    picked = records.filter(F.col("error").isNull()).select(*columns).dropna(subset=keys)

    def kept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for rows in batches:  # a key with very many records comes in several; one row is held
            if policy == "FAIL" and (len(rows) > 1 or best is not None or state.exists):
                raise ValueError(f"Duplicate key: {key}")
            some = rows if best is None else pd.concat([best, rows])
            best = some.sort_values(_PLACE, ascending=policy != "KEEP_LAST").head(1)
        at = (best["file"].iloc[0], int(best["line_no"].iloc[0]))
        if not state.exists or (at > state.get if policy == "KEEP_LAST" else at < state.get):
            state.update(at)
            yield best[columns]

    out = T.StructType([picked.schema[c] for c in columns])
    return picked.groupBy(*keys).applyInPandasWithState(kept, out, "file string, line_no long", "update", GroupStateTimeout.NoTimeout)
