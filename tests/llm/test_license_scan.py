import math
import re

import pytest

from corpusloom.llm import license_scan as L
from tests.conftest import SF001


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    return docs, L.fit_licenses(docs)


EXTRA = [
    (1, "intro\nLicensed under the Foo Bar License, Version 7.\nend", ["unknown"]),
    (2, "Everything here: Licensed under the Apache License Version 2.0 ok", ["Apache-2.0"]),
    (3, "This program is free software you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by others", ["GPL"]),
    (4, "LICENSED UNDER CC BY-NC 4.0.\r\n\nAll rights reserved.", ["CC-BY-NC", "reserved"]),
    (5, "nothing to see in these plain words", []),
    (6, None, []),
]


def test_families(spark, fitted):
    docs, model = fitted
    extra = spark.createDataFrame([(i, t) for i, t, _ in EXTRA], "doc_id long, text string")
    rows = L.find_licenses(extra, model).orderBy("doc_id", "paragraph").collect()
    got = {i: [r["family"] for r in rows if r["doc_id"] == i] for i, *_ in EXTRA}
    assert got == {i: f for i, _, f in EXTRA}


def test_every_licence_line_of_the_documents(fitted):
    docs, model = fitted
    expected = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "reserved",
                "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
                "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    lines = sorted((r["doc_id"], p, expected[line]) for r in docs.collect()
                   for p, line in enumerate(r["text"].split("\n")) if line in expected)
    found = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in L.find_licenses(docs, model).collect())
    assert lines and found == lines


def test_probability_by_hand(spark, fitted):
    _, model = fitted
    weights = {r["gram"]: r["w"] for r in model.weights.collect()}
    text = "Licensed under the Apache License, Version 2.0."
    words = re.findall("[0-9a-z]+", text.lower())
    grams = {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    grams = [g for g in grams if set(g.split()) & set(model.cues)]
    z = [sum(v) for v in zip(weights[""], *(weights[g] for g in grams if g in weights))]
    p = max(math.exp(v) for v in z) / sum(math.exp(v) for v in z)
    row = L.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row["probability"] == pytest.approx(p) and row["overlap"] == 1.0


def test_plan_has_no_python(fitted):
    docs, model = fitted
    plan = L.find_licenses(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def common_licence_words(spark):
    """Documents with a hot line of licence words, and a notice outside the templates in one line of twenty."""
    hot = "Software license version of copyright and redistribution with modification."
    texts = [f"{hot}\nplain words number a{i}\nsome more b{i} of them c{i}" for i in range(300)]
    texts += [f"Copyright {1900 + i} Holder{i} and friends\nnothing d{i} here\nat all e{i}" for i in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_common_licence_words_stay_cues(spark):
    docs = common_licence_words(spark)
    counts = L.cue_counts(docs, L.TEMPLATES)
    assert counts[""] == 1 + 600 + 180 and counts["version"] == 1 and counts["copyright"] == 61
    model = L.fit_licenses(docs)
    assert {"license", "copyright", "software", "redistribution", "version"} <= set(model.cues)
    assert not {"of", "and"} & set(model.cues)
    notices = [t for _, t in L.TEMPLATES]
    rows = L.find_licenses(spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(notices)))


def test_a_line_without_a_cue_cannot_match_a_template():
    everywhere = {w: 1000 for w in ["", *L.licence_vocabulary(L.TEMPLATES)]}
    cues = set(L.choose_cues(everywhere, L.TEMPLATES))
    for _, text in L.TEMPLATES:
        pairs = L.pairs_of(text)
        assert sum(cues.isdisjoint(p.split()) for p in pairs) < L.LEAST_OVERLAP * len(pairs)


WRAPPED = {
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General "
           "Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
           "(at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
           "the following conditions are met:",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
           "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without "
           "limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the "
           "Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "Apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except "
                  "in compliance with the License.",
}


def test_wrapped_notices(spark, fitted):
    _, model = fitted
    around = "some plain words here\n\n{}\n\nand plain words there"
    docs = [(i, around.format(t)) for i, t in enumerate(WRAPPED.values())]
    # back to back, without a blank line; and in the midst of a paragraph of prose
    docs.append((10, "\n".join([WRAPPED["GPL"], WRAPPED["BSD"], WRAPPED["GPL"]])))
    docs.append((11, "plain words before it\n" + WRAPPED["BSD"] + "\nplain words after it\nAll rights reserved."))
    # a blank line within it parts it; the halves hold too little
    docs.append((12, WRAPPED["BSD"].replace("\n", "\n\n")))
    rows = L.find_licenses(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["paragraph"])):
        text = dict(docs)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(text[r["paragraph"]:r["last"] + 1])
        got.setdefault(r["doc_id"], []).append((r["family"], r["paragraph"], r["last"]))
    for i, (family, t) in enumerate(WRAPPED.items()):
        assert got[i] == [(family, 2, 2 + t.count("\n"))], (family, got[i])
    assert got[10] == [("GPL", 0, 3), ("BSD", 4, 5), ("GPL", 6, 9)]
    assert got[11] == [("BSD", 1, 2), ("reserved", 4, 4)]
    assert {f for f, *_ in got.get(12, [])} <= {"unknown"}


def test_windows_against_brute_force(spark, fitted):
    """Windows of the scan are those found by trying all ends of all lines with a cue."""
    _, model = fitted
    text = "\n".join(["plain", *WRAPPED.values(), "", WRAPPED["GPL"].replace("software", "soft\nware"), "license", "x"])
    lines = text.split("\n")
    words = [re.findall("[0-9a-z]+", x.lower()) for x in lines]
    longest = max(len(re.findall("[0-9a-z]+", t.lower())) for _, t in L.TEMPLATES)

    def held(pairs, some):
        run = [w for x in some for w in x]
        return len(set(pairs) & {f"{a} {b}" for a, b in zip(run, run[1:])})

    expected = []
    for i in range(len(lines)):
        if not set(words[i]) & set(model.cues):
            continue
        end = i + 1
        while end < len(lines) and lines[end].strip() and len(words[i]) < longest and sum(
                map(len, words[i + 1:end])) < longest:
            end += 1
        best = None
        for order, (_, t) in enumerate(L.TEMPLATES):
            pairs = L.pairs_of(t)
            n = held(pairs, words[i:end])
            if n >= L.LEAST_OVERLAP * len(pairs) and held(pairs, words[i:i + 1]) < n:
                last = next(e for e in range(i + 1, end) if held(pairs, words[i:e + 1]) == n)
                if held(pairs, words[i + 1:last + 1]) < n:
                    best = max(best or (0, 0, 0), (n, -order, last))
        if best:
            expected.append((i, best[2]))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = L.windows_of(L.cue_lines(docs, model.cues, longest).selectExpr("*", "paragraph as line"), L.TEMPLATES)
    assert expected and sorted((r["paragraph"], r["last"]) for r in found.collect()) == expected


def test_ties_go_to_the_first_window(spark):
    rows = [(1, p, p + 2, 1, "t", "GPL", 0.9, o) for p, o in ((0, 0.8), (1, 0.8), (2, 0.8), (3, 0.8), (9, 0.7), (8, 0.9))]
    df = spark.createDataFrame(rows, "row long, paragraph int, last int, doc_id long, text string, label string, "
                                     "probability double, overlap double")
    kept = L.without_shared_lines(df).first()["kept"]
    assert sorted((w["paragraph"], w["last"]) for w in kept) == [(0, 2), (3, 5), (8, 10)]
