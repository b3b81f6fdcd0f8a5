"""Large JSON arrays read in byte ranges.

Whether a byte of a JSON file lies inside a string, and how deep, depends on all bytes before it. So a file is read twice
by its ranges: first each range gives its number of quotes and the change of depth for both cases, that it begins
inside a string or outside; running sums over a file's ranges (a row each) then tell where every range really
begins. Second, each range cuts out the elements of the outer array that begin in it, reading on past its end
for the last one, and Spark parses their texts. A range is a task's work, an element is whole in one task.

An element that isn't a record of the schema, or that the file breaks off in, lands in ``_corrupt`` with its text; the
others are not lost with it. A file whose outermost value is no array is one record. Empty elements are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLIT = 32 << 20        # bytes of a range
MORE = 1 << 20          # bytes read at a time past a range's end
_ESCAPED = re.compile(rb"\\.", re.S)
_QUOTE, _COMMA = ord('"'), ord(",")


def opened(path: str):
    """A file that tasks read by ranges: a URI that ``pyarrow.fs`` knows, or a local path."""
    uri = re.sub(r"^file:/+", "file:///", path)
    fs, inner = pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def range_bytes(file, start: int, end: int) -> bytes:
    """A range with escaped characters blanked out, also one whose backslash stands before the range."""
    back = 0
    while start - back > 0:
        file.seek(start - back - 1)
        if file.read(1) != b"\\":
            break
        back += 1
    file.seek(start)
    data = file.read(end - start)
    if back % 2 and data:
        data = b" " + data[1:]
    return _ESCAPED.sub(b"  ", data)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(path) as file:
                data = range_bytes(file, start, end)
            parts = data.split(b'"')
            change = [sum(p.count(b"{") + p.count(b"[") - p.count(b"}") - p.count(b"]") for p in parts[k::2]) for k in (0, 1)]
            rows.append((path, start, end, len(parts) - 1, *change, data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "end", "quotes", "outside", "inside", "first"), r)) for r in rows],
                                         schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in (
                                             "start", "end", "quotes", "outside", "inside")], ("first", pa.string())]))


def placed(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it lies outside strings, and the depth after it."""
    raw = np.frombuffer(data, dtype=np.uint8)
    outside = ((np.cumsum(raw == _QUOTE) + inside) & 1) == 0
    step = np.isin(raw, [ord("{"), ord("[")]).astype(np.int64) - np.isin(raw, [ord("}"), ord("]")])
    return outside, depth + np.cumsum(step * outside)


def separators(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, bool, int]:
    """Places of the outer array's opening, commas and closing; the state at the end."""
    if not data:
        return np.zeros(0, dtype=np.int64), inside, depth
    raw = np.frombuffer(data, dtype=np.uint8)
    outside, after = placed(data, inside, depth)
    opening = (raw == ord("[")) & (after == 1)
    closing = (raw == ord("]")) & (after == 0)
    found = np.flatnonzero(outside & (opening | closing | (raw == _COMMA) & (after == 1)))
    return found, not outside[-1], int(after[-1])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end, length, inside, depth, root in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(path) as file:
                if root != "[":
                    if start == 0 and root:
                        file.seek(0)
                        yield _texts(path, [file.read(length)])
                    continue
                found, inside, depth = separators(range_bytes(file, start, end), bool(inside), depth)
                if not len(found):
                    continue
                file.seek(start)
                data, at = file.read(end - start), end
                places = found.tolist()
                closed = data[places[-1]:places[-1] + 1] == b"]" and depth == 0
                while not closed and at < length:       # the last element goes on past the range
                    more, inside, depth = separators(range_bytes(file, at, min(at + MORE, length)), inside, depth)
                    file.seek(at)
                    data += file.read(min(MORE, length - at))
                    if len(more):
                        places.append(at - start + int(more[0]))
                        break
                    at += MORE
                else:
                    if not closed:
                        places.append(len(data))        # the file breaks off
                yield _texts(path, [data[a + 1:b] for a, b in zip(places, places[1:])])


def _texts(path: str, pieces: list[bytes]) -> pa.RecordBatch:
    texts = [t for t in (p.decode("utf-8", "replace").strip("﻿ \t\r\n") for p in pieces) if t]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(texts, pa.string())], ["file", "text"])


def array_elements(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(file, text) of every element of the arrays in the files under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")     # the contents aren't read
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")).select(
        "path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    # a range a task: by their few bytes, Spark would put all ranges into one
    parts = max(1, ranges.count())
    dealt = ranges.repartition(min(parts, 100_000), "path", "start")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = (dealt.mapInArrow(_summary, "path string, start long, end long, quotes long, outside long, inside long, first string")
             .withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
             .withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
             .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
             .withColumn("root", F.first("first").over(Window.partitionBy("path").orderBy("start")))
             .withColumn("length", F.max("end").over(Window.partitionBy("path")))
             .select("path", "start", "end", "length", "in_string", "depth", "root"))
    return known.repartition(min(parts, 100_000), "path", "start").mapInArrow(_elements, "file string, text string")


def read_json_array_ranges(spark: SparkSession, path: str, schema: StructType, split_bytes: int = SPLIT) -> DataFrame:
    """The records of JSON array files, each file read by many tasks; broken elements land in ``_corrupt``."""
    from corpusloom.sources.readers import _empty_if_missing, _with_corrupt

    full = _with_corrupt(schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return _empty_if_missing(lambda: array_elements(spark, path, split_bytes).select(
        F.from_json("text", full, options).alias("r")).select("r.*"), spark, path, full)
