"""Sources and sinks.

Readers always take an explicit schema (no inference on large inputs).
JSON Lines is preferred at scale: a multi-line JSON array is one task per
file. Unreadable records go to a ``_corrupt`` column instead of failing the
job.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

log = logging.getLogger(__name__)


def _with_corrupt(schema: StructType) -> StructType:
    if "_corrupt" in schema.fieldNames():
        return schema
    return StructType(list(schema.fields) + [StructField("_corrupt", StringType())])


def _empty_if_missing(read, spark: SparkSession, path: str, schema) -> DataFrame:
    """The result of ``read()``, or an empty frame and a log line if the path doesn't exist; other errors are raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("%s does not exist", path)
        return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files holding one JSON array each. A missing path gives an empty
    frame and a log line; broken records land in ``_corrupt``."""
    s = _with_corrupt(schema)
    return _empty_if_missing(lambda: spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE")
                             .option("columnNameOfCorruptRecord", "_corrupt").json(path), spark, path, s)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per line (splittable)."""
    s = _with_corrupt(schema)
    return _empty_if_missing(lambda: spark.read.schema(s).option("mode", "PERMISSIVE")
                             .option("columnNameOfCorruptRecord", "_corrupt").json(path), spark, path, s)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """S3: mixed folder -> (file_path, stem, text, broken) per file.

    ``.json``: the ``output`` field of each item (default ''), joined by a blank
    line; ``.csv``: column 2 of rows with more than one column, joined by a
    blank line; ``.txt``/``.py``: the whole file. Other extensions are skipped.
    Per-file joins are bounded by the file itself. ``broken`` counts a file's records that
    can't be read; they give no text. A missing folder gives an empty frame; other errors are raised.
    """
    schema = "file_path string, stem string, text string, broken long"
    item = StructType([StructField("output", StringType()), StructField("_corrupt", StringType())])

    def joined(rows):
        texts = F.array_sort(F.collect_list(F.when(F.col("_broken") == 0, F.struct("_i", "t"))))
        return rows.groupBy("file_path").agg(F.array_join(F.transform(texts, lambda x: x["t"]), "\n\n").alias("text"),
                                             F.sum("_broken").alias("broken"))

    def read():
        where = F.col("_metadata.file_path").alias("file_path")
        js = (spark.read.schema(item).option("multiLine", True).option("pathGlobFilter", "*.json")
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
              .select(where, F.coalesce("output", F.lit("")).alias("t"),
                      F.col("_corrupt").isNotNull().cast("long").alias("_broken"),
                      F.monotonically_increasing_id().alias("_i")))
        csv = (spark.read.schema("_c0 string, _c1 string").option("pathGlobFilter", "*.csv").option("header", False)
               .option("mode", "PERMISSIVE").csv(folder)
               .select(where, F.col("_c1").alias("t"), F.lit(0).cast("long").alias("_broken"),
                       F.monotonically_increasing_id().alias("_i"))
               .filter(F.col("t").isNotNull()))
        whole = [spark.read.option("pathGlobFilter", f"*.{ext}").text(folder, wholetext=True)
                 .select(where, F.col("value").alias("text"), F.lit(0).cast("long").alias("broken"))
                 for ext in ("txt", "py")]
        out = joined(js).unionByName(joined(csv))
        for part in whole:
            out = out.unionByName(part)
        stem = F.split(F.regexp_extract(F.col("file_path"), r"([^/]+)$", 1), r"\.").getItem(0)
        return out.select("file_path", stem.alias("stem"), "text", "broken")

    return _empty_if_missing(read, spark, folder, schema)


def parse_edge_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Edge-list text -> (src, dst); '#' lines skipped, CRLF tolerated, tab separated."""
    clean = lines.select(F.regexp_replace(F.col(col), "\r$", "").alias("l"))
    body = clean.filter(~F.col("l").startswith("#") & (F.col("l") != ""))
    parts = F.split("l", "\t")
    return body.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def edge_header(lines: DataFrame, col: str = "value") -> DataFrame:
    """S7 header: node and edge counts from '# Nodes: n Edges: m'."""
    h = lines.filter(F.col(col).rlike(r"^#.*Nodes:\s*\d+"))
    return h.select(F.regexp_extract(col, r"Nodes:\s*(\d+)", 1).cast("long").alias("nodes"),
                    F.regexp_extract(col, r"Edges:\s*(\d+)", 1).cast("long").alias("edges"))


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Plain or gzip text files."""
    lines = spark.read.text(path)
    return parse_edge_lines(lines), edge_header(lines)


def write_artifacts(frames: dict[str, DataFrame], base: str, run_id: str, fmt: str = "json") -> list[str]:
    """Each frame to ``base/<name>/run_id=<run_id>``; never overwrites a run."""
    paths = []
    for name, df in frames.items():
        p = f"{base.rstrip('/')}/{name}/run_id={run_id}"
        df.write.mode("errorifexists").format(fmt).save(p)
        paths.append(p)
    return paths


def write_by_category(df: DataFrame, path: str, category_col: str = "category", fmt: str = "json") -> None:
    """One folder per non-empty category (partitioned write)."""
    df.filter(F.col(category_col).isNotNull()).write.mode("errorifexists").partitionBy(category_col) \
      .format(fmt).save(path)


def preprocess_folder(spark: SparkSession, folder: str, out: str, tag_rules=None) -> DataFrame:
    """S3 -> X14 -> X15 -> S6: read a mixed folder, drop files without text
    (F7), collapse blank lines, insert tags, and write one
    ``preprocessed_<stem>`` text output per input stem (partitioned write)."""
    from corpusloom import rules as R
    from corpusloom.functions.text import collapse_blank_lines, non_empty, tag_text
    docs = read_folder(spark, folder).filter(non_empty("text"))
    cleaned = docs.select(F.concat(F.lit("preprocessed_"), F.col("stem")).alias("stem"),
                          tag_text(collapse_blank_lines(F.col("text")), tag_rules or R.TAG_RULES).alias("value"))
    cleaned.write.mode("errorifexists").partitionBy("stem").text(out)
    return cleaned
