"""Lines of files by number, without reading the files: a sparse index of where lines begin, and reads of byte ranges.

``index`` keeps the offset of every 64th line. ``ranges`` joins what is asked for with the index and has each task
read, for a range, the bytes from the mark before its first line to the one after its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVERY = 64


def index(files: DataFrame, every: int = EVERY) -> DataFrame:
    """(path, size, lines, marks) of files (path, content): marks are the offsets of lines 1, 1 + every, ... A final line
    end opens no further line. A null content is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, marks = [], [], []
            for raw in batch.column(1).to_pylist():
                data = np.frombuffer(raw or b"", np.uint8)
                begins = np.concatenate([np.zeros(min(1, len(data)), np.int64), np.flatnonzero(data == 10) + 1])
                begins = begins[begins < len(data)]
                sizes.append(len(data)), counts.append(len(begins)), marks.append(begins[::every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["path", "size", "lines", "marks"])

    return files.select("path", "content").mapInArrow(run, "path string, size bigint, lines bigint, marks array<bigint>")


def ranges(wanted: DataFrame, marks: DataFrame, root: str, every: int = EVERY) -> DataFrame:
    """(path, number, text, bytes) of the lines that wanted (path, first, last) asks for and that exist; bytes: how many were
    read for the range. Line ends are taken off; what is no UTF-8 becomes U+FFFD. Paths without an index give no rows."""
    known = wanted.select("path", F.greatest("first", F.lit(1)).cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")).join(marks, "path")
    known = known.withColumn("last", F.least("last", "lines")).where("first <= last")
    begin, end = F.floor((F.col("first") - 1) / every), F.floor((F.col("last") - 1) / every) + 1
    spans = known.select("path", "first", "last", (begin * every + 1).alias("line"), F.get("marks", begin.cast("int")).alias("at"), F.coalesce(F.get("marks", end.cast("int")), "size").alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        for batch in batches:
            out: list[tuple] = []
            for path, first, last, line, at, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{top}/{path}") as f:
                    f.seek(at)
                    data = f.read(to - at)
                rows = data.split(b"\n")
                out += [(path, n, rows[n - line].decode("utf-8", "replace"), len(data)) for n in range(first, last + 1)]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["path", "number", "text", "bytes"])

    return spans.mapInArrow(run, "path string, number bigint, text string, bytes bigint")
