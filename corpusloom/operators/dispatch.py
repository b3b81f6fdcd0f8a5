"""Typed dispatch, pluggable predictors, output validation (J6, U3, U4, M5,
M7, A18, A19, E8).

Routing is a join to a broadcast dispatch map (a handful of rows by
construction); predictors run per partition over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import rules as R


def dispatch_map(spark, rows=R.DISPATCH_MAP) -> DataFrame:
    return spark.createDataFrame(rows, "data_type string, model string")


def route(records: DataFrame, dmap: DataFrame, type_col: str = "data_type") -> DataFrame:
    """Records without a type are dropped; typed records get their model."""
    typed = records.filter(F.col(type_col).isNotNull())
    return typed.join(F.broadcast(dmap), type_col)


def unrouted(records: DataFrame, dmap: DataFrame, type_col: str = "data_type") -> DataFrame:
    """Typed records whose type has no model (left anti join)."""
    typed = records.filter(F.col(type_col).isNotNull())
    return typed.join(F.broadcast(dmap), type_col, "left_anti")


def dummy_predictor(pdf: pd.DataFrame) -> pd.Series:
    """U3 default: 'Prediction for <type>' for every record."""
    return "Prediction for " + pdf["data_type"].astype(str)


PREDICTORS: dict[str, Callable[[pd.DataFrame], pd.Series]] = {}


def register_predictor(model: str, fn: Callable[[pd.DataFrame], pd.Series]) -> None:
    PREDICTORS[model] = fn


def batch_predict(routed: DataFrame, out_col: str = "prediction") -> DataFrame:
    """Per partition, group the Arrow batch by model and call its predictor."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(routed.schema.fields) + [StructField(out_col, StringType())])
    cols = routed.columns

    def run(batches):
        for pdf in batches:
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for model, part in pdf.groupby("model"):
                fn = PREDICTORS.get(model, dummy_predictor)
                out.loc[part.index] = fn(part).values
            res = pdf[cols].copy()
            res[out_col] = out
            yield res

    return routed.mapInPandas(run, schema=schema)


def strip_fences(text: Column) -> Column:
    """M5: remove ```json newline and ``` fences, then strip."""
    return F.trim(F.regexp_replace(text, r"(?m)```json\n|```", ""))


def format_prompt(text: Column, task_type: Column, templates=R.PROMPT_TEMPLATES) -> Column:
    """Decomposition / summarisation templates, other task types unchanged."""
    out = None
    for task, tpl in templates.items():
        pre, post = tpl.split("{text}")
        expr = F.concat(F.lit(pre), text, F.lit(post))
        out = F.when(task_type == task, expr) if out is None else out.when(task_type == task, expr)
    return out.otherwise(text)


def latency_bucket(ms: Column, bounds=(5.0, 10.0, 25.0, 50.0)) -> Column:
    """Histogram bucket label (upper bound or +Inf)."""
    out = None
    for b in bounds:
        out = F.when(ms <= b, F.lit(f"le_{b:g}")) if out is None else out.when(ms <= b, F.lit(f"le_{b:g}"))
    return out.otherwise(F.lit("le_inf"))


# --- pluggable validators (U4) -------------------------------------------------

DECOMPOSITION_SCHEMA = ("operation STRING, steps ARRAY<STRUCT<step: INT, action: STRING, expected_time: STRING, "
                        "resource: STRING>>")
VALIDATORS: dict[str, str] = {"decomposition": DECOMPOSITION_SCHEMA}


def register_validator(task_type: str, ddl_schema: str) -> None:
    VALIDATORS[task_type] = ddl_schema


def validate(text: Column, task_type: str) -> Column:
    """M5 + U4: parse fenced/plain JSON against the task type's schema; a
    struct with ``valid`` (all required fields present, steps typed) and the
    parsed ``value`` (null when invalid)."""
    schema = VALIDATORS[task_type]
    parsed = F.from_json(strip_fences(text), schema, {"mode": "PERMISSIVE"})
    if task_type == "decomposition":
        ok = (parsed["operation"].isNotNull() & parsed["steps"].isNotNull() &
              F.forall(parsed["steps"], lambda s: s["step"].isNotNull() & s["action"].isNotNull() &
                       s["expected_time"].isNotNull() & s["resource"].isNotNull()))
    else:
        ok = parsed.isNotNull()
    return F.struct(F.coalesce(ok, F.lit(False)).alias("valid"), F.when(ok, parsed).alias("value"))
