"""User code on single records: a Python function sees each one as a dictionary, edits it, drops it, or fails with its line's number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.header import FormatError, Header

#: header, record: False drops the record, a dictionary replaces it, anything else keeps it with the edits made in place.
RecordFunction = Callable[[Header, dict], object]


def each_record(rows: DataFrame, header: Header, function: RecordFunction, schema: T.StructType | None = None, flag: str | None = None) -> DataFrame:
    """rows after the function has seen each record, in batches, without a shuffle.

    schema: the columns of what the function returns, if it does not return records. flag: do not drop a record but tell in this
    boolean column whether the function keeps it. Malformed lines, which PERMISSIVE mode keeps, are no records and pass by. An
    exception of the function fails the query with the record's line number and section, as any other error of that line.
    """
    out = T.StructType([*(schema or rows.schema).fields, *([T.StructField(flag, T.BooleanType())] if flag else [])])
    fields = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out])

    def answered(record: dict) -> dict | None:
        if record.get("error") is not None:
            return record | {flag: True} if schema is None else None
        try:
            answer = function(header, record)
        except Exception as e:
            where = f"{record['file']}: " if record.get("file") else ""
            raise FormatError(f"{where}{type(e).__name__}: {e}", record.get("line_no"), "data") from e
        made = answer if isinstance(answer, dict) else record
        return made | {flag: answer is not False} if flag else None if answer is False else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x for x in map(answered, b.to_pylist()) if x is not None]
            yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in fields.names} for x in made], schema=fields)

    return rows.mapInArrow(run, out)


def parse_with(rows: DataFrame, header: Header, on_record: Callable[[Header, dict], None], on_header: Callable[[Header], None] = lambda h: None) -> int:
    """Call on_header once, also without records, then on_record for each record, where it is; returns how many there were."""
    on_header(header)
    seen = T.StructType([T.StructField("seen", T.IntegerType())])

    def count(head: Header, record: dict) -> dict:
        on_record(head, record)
        return {"seen": 1}

    return each_record(rows, header, count, seen).count()
