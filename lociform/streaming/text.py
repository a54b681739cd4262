"""Records of a growing folder of variant text, with the same expressions as in batch; no state is kept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writer import guarded
from ..sources import datasource
from ..sources.header import Header, header_lines
from ..sources.scan import from_lines


def stream_vcf(spark: SparkSession, folder: str, header: Header, rsids_only: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """A streaming DataFrame of the data lines of files with this header; header lines are left out, line numbers are unknown."""
    lines = spark.readStream.text(folder).filter(~(F.col("value").startswith("##") | F.col("value").startswith("#CHROM")))
    return from_lines(lines, header, rsids_only, mode)


def write_stream(rows: DataFrame, header: Header, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A running query that writes each batch's records as files with their header, by the same sink as in batch.

    A batch is committed as a whole, and one that runs again after a restart replaces its own files. A record that must not be
    written stops the query.
    """
    datasource.register(rows.sparkSession)
    lines = guarded(rows, header).select("guard", "value").writeStream.format("vcf").option("headers", json.dumps([header_lines(header)]))
    return lines.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start(folder)
