"""The readers as functions of SQL: register(spark), then SELECT ... FROM t, LATERAL file_records(kind, content).

A table function is called for each row and gives as many rows as a file has records. Of many small
files, SELECT ... FROM t LATERAL VIEW inline(file_rows(kind, content)) reads a batch a call.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from proofbase.sources import formats

FILES = 500  # files whose records are held at once


@udtf(returnType="section int, section_text string", useArrow=True)
class Sections:
    """sections(text): a text's sections in order."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(formats.split_sections(text or ""))


def _records(kind: str, content: bytes) -> Iterator[tuple]:
    try:
        for _, _, sheet, n, cells in formats._file_rows("", kind, bytes(content or b"")):
            yield sheet, n, {k: None if v is None else str(v) for k, v in cells.items()}, None
    except Exception as e:  # noqa: BLE001
        yield None, None, None, f"{type(e).__name__}: {e}"[:200]


@udtf(returnType="sheet string, row_no bigint, cells map<string,string>, problem string", useArrow=True)
class FileRecords:
    """file_records(kind, content): the records of a CSV, XLSX or JSON file; one that can't be read is a row with its problem."""

    def eval(self, kind: str, content: bytes) -> Iterator[tuple]:
        yield from _records(kind, content)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row_no", T.LongType()), T.StructField("cells", T.MapType(T.StringType(), T.StringType())), T.StructField("problem", T.StringType())])))
def file_rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """file_rows(kind, content): the rows of file_records as an array."""
    names = ("sheet", "row_no", "cells", "problem")
    shape = pa.list_(pa.struct([("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("problem", pa.string())]))
    for kinds, contents in batches:
        for at in range(0, len(kinds), FILES):
            files = zip(kinds.slice(at, FILES).to_pylist(), contents.slice(at, FILES).to_pylist(), strict=True)
            yield pa.array([[dict(zip(names, (s, n, None if cells is None else list(cells.items()), p), strict=True)) for s, n, cells, p in _records(k, c)] for k, c in files], shape)


def register(spark: SparkSession) -> None:
    spark.udtf.register("sections", Sections)
    spark.udtf.register("file_records", FileRecords)
    spark.udf.register("file_rows", file_rows)
