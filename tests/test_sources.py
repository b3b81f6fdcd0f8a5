"""Sources and sinks on small files."""

import gzip
import json
import os

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.sources import readers as S

EX = StructType([StructField("instruction", StringType()), StructField("input", StringType()),
                 StructField("output", StringType())])


def test_json_array_and_jsonl(spark, tmpdir_path):
    seeds = [{"instruction": "Write code", "input": "URL", "output": "import requests"},
             {"instruction": "Create server", "input": "Port: 8080", "output": "import socket"}]
    p = os.path.join(tmpdir_path, "a.json")
    with open(p, "w") as f:
        json.dump(seeds, f)
    df = S.read_json_array(spark, p, EX)
    assert [r["output"] for r in df.orderBy("instruction").collect()] == ["import socket", "import requests"]
    missing = S.read_json_array(spark, os.path.join(tmpdir_path, "nope.json"), EX)
    assert missing.count() == 0
    q = os.path.join(tmpdir_path, "b.jsonl")
    with open(q, "w") as f:
        f.write(json.dumps(seeds[0]) + "\n{broken\n" + json.dumps(seeds[1]) + "\n")
    jl = S.read_jsonl(spark, q, EX).cache()
    assert jl.filter(F.col("_corrupt").isNull()).count() == 2
    assert jl.filter(F.col("_corrupt").isNotNull()).count() == 1


def test_folder_ingest(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "in")
    os.makedirs(d)
    with open(os.path.join(d, "x.json"), "w") as f:
        json.dump([{"output": "a = 1"}, {"other": 1}, {"output": "b = 2"}], f)
    with open(os.path.join(d, "y.csv"), "w") as f:
        f.write("1,first\nonly\n3,third\n")
    with open(os.path.join(d, "z.py"), "w") as f:
        f.write("print('hi')\n")
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{broken")
    with open(os.path.join(d, "skip.bin"), "w") as f:
        f.write("zzz")
    out = {r["stem"]: (r["text"], r["broken"]) for r in S.read_folder(spark, d).collect()}
    assert out == {"x": ("a = 1\n\n\n\nb = 2", 0), "y": ("first\n\nthird", 0), "z": ("print('hi')\n", 0),
                   "bad": ("", 1)}
    assert S.read_folder(spark, os.path.join(d, "nowhere")).count() == 0


def test_edge_list_gz(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "g.txt.gz")
    with gzip.open(p, "wt") as f:
        f.write("# Directed graph\r\n# Nodes: 3 Edges: 2\r\n1\t2\r\n2\t3\r\n")
    edges, head = S.read_edge_list(spark, p)
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2), (2, 3)]
    assert tuple(head.first()) == (3, 2)


def test_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "t1"), ("b", "t2"), (None, "t3")], "category string, text string")
    base = os.path.join(tmpdir_path, "out")
    S.write_by_category(df, base)
    assert sorted(x for x in os.listdir(base) if x.startswith("category=")) == ["category=a", "category=b"]
    paths = S.write_artifacts({"stats": df.groupBy("category").count()}, base, "r1")
    assert spark.read.json(paths[0]).count() == 3


def test_page_parsers(spark):
    from corpusloom.operators import pages as P
    html = ('<html><head><title> T </title><script>var t="</p>";</script></head><body><nav>menu</nav>'
            '<article><h1>Head</h1><p>one <b>two</b></p><pre class="x">code()</pre>'
            '<div class="highlight">hl</div></article><footer>f</footer></body></html>')
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(P.main_text_parsed("html").alias("m"), P.all_text_parsed("html").alias("a"),
                  P.title(F.col("html")).alias("t"), P.select_udf({})("html").alias("auto"),
                  P.select_udf({"content": ["p"], "ex": [".highlight"]})("html").alias("sel"),
                  P.split_code_text("html").alias("split")).first()
    assert r["m"] == "Head one two code() hl"
    assert r["a"] == "T Head one two code() hl f"
    assert r["t"] == "T"
    assert r["auto"]["auto_code"] == ["code()", "hl"]
    assert r["sel"] == {"content": ["one two"], "ex": ["hl"]}
    assert list(r["split"]["code"]) == ["code()"]


def test_one_text_per_element(spark):
    from corpusloom.operators import pages as P
    cases = [
        ("<p>a <b>b</b> c</p><p>d</p>", ["a b c", "d"]),
        ("<p>open <b>bold<br><p>next\n line</p><p>", ["open bold", "next line"]),
        ("<div><p>in div<div>not p</div></div><p>x", ["in div", "x"]),
        ("<script>'<p>no</p>'</script><style>p{}</style><p>yes</p>", ["yes"]),
        ("<ul><li>1<li>2 <p>two</p></ul><p>&lt;3&amp;</p>", ["two", "<3&"]),
        ("", []), (None, []),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r["i"]: r["s"]["p"] for r in df.select("i", P.select_udf({"p": ["p"]})("html").alias("s")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}
    split = spark.createDataFrame([("<pre>a <code>b</code></pre>t <code>c</code> u",)], "html string").select(
        P.split_code_text("html").alias("s")).first()["s"]
    assert (split["text"], list(split["code"])) == ("t u", ["a b", "c"])


def test_preprocess_folder(spark, tmpdir_path):
    import re

    from corpusloom import rules as R
    code = "import socket\n\n\n\ns = socket.socket()\ntry:\n    requests.get(u)\nexcept:\n    raise\n"
    d = os.path.join(tmpdir_path, "raw")
    os.makedirs(d)
    with open(os.path.join(d, "net.py"), "w") as f:
        f.write(code)
    with open(os.path.join(d, "empty.txt"), "w") as f:
        f.write("")
    out = os.path.join(tmpdir_path, "pre")
    S.preprocess_folder(spark, d, out)
    assert sorted(x for x in os.listdir(out) if x.startswith("stem=")) == ["stem=preprocessed_net"]
    got = "\n".join(r[0] for r in spark.read.text(os.path.join(out, "stem=preprocessed_net")).collect())
    want = re.sub(R.BLANK_LINES_PATTERN, "\n\n", code)
    for pat, tag in R.TAG_RULES:
        want = re.sub(pat, tag + "\\1", want)
    assert got == want  # the text sink adds one line separator after the value
