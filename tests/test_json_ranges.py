"""JSON arrays read in byte ranges equal the whole-file reader, wherever the ranges cut."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.sources import json_ranges as J
from corpusloom.sources.readers import read_json_array

SCHEMA = StructType([StructField("id", LongType()), StructField("s", StringType()),
                     StructField("a", ArrayType(StructType([StructField("x", LongType())]))),
                     StructField("m", StructType([StructField("k", StringType())]))])
NASTY = ['plain', 'quote " inside', 'back\\slash', 'ends with \\', '\\"', 'a, b ] } [ {', 'ünï 日本 🎉', '', 'new\nline', '\\\\\\"[']


def _rows(n):
    return [{"id": i, "s": NASTY[i % len(NASTY)] * (1 + i % 3), "a": [{"x": k} for k in range(i % 4)], "m": {"k": NASTY[(i * 7) % len(NASTY)]}}
            for i in range(n)]


def _set(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.drop("_corrupt").collect())


@pytest.mark.parametrize("split, indent", [(11, None), (200, 2), (1 << 20, 1)])
def test_equals_the_whole_file_reader(spark, tmp_path, split, indent):
    n = 4 if split < 100 else 40
    for name, rows in (("a", _rows(n)), ("b", _rows(3)), ("empty", []), ("one", _rows(1))):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=name == "b"))
    got = J.read_json_array_ranges(spark, str(tmp_path), SCHEMA, split)
    want = read_json_array(spark, str(tmp_path), SCHEMA)
    assert _set(got) == _set(want) and len(_set(got)) == n + 4
    assert got.where("_corrupt is not null").count() == 0


def test_one_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_rows(400)))
    parts = J.array_elements(spark, str(tmp_path), 2000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 4


def test_broken_elements_do_not_lose_the_others(spark, tmp_path):
    good = [json.dumps(r) for r in _rows(20)]
    (tmp_path / "a.json").write_text("[" + ",".join([*good[:5], '{"id": "text"}', "17", '{"id": 1,, }', *good[5:]]) + "]")
    (tmp_path / "cut.json").write_text("[" + ",".join(good[:3]) + ', {"id": 99, "s": "brok')
    (tmp_path / "object.json").write_text(good[4])
    (tmp_path / "void.json").write_text("")
    for split in (33, 1 << 20):
        got = J.read_json_array_ranges(spark, str(tmp_path), SCHEMA, split).cache()
        fine = got.where("_corrupt is null")
        assert sorted(r["id"] for r in fine.collect()) == sorted([*range(20), 0, 1, 2, 4])
        assert sorted(r["_corrupt"][:8] for r in got.where("_corrupt is not null").collect()) == sorted(
            x[:8] for x in ('17', '{"id": "text"}', '{"id": 1,, }', '{"id": 99, "s": "brok'))


def test_missing_path(spark, tmp_path):
    assert J.read_json_array_ranges(spark, str(tmp_path / "none"), SCHEMA).collect() == []
