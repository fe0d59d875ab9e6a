import re

from metricloom.llm import licenses as X

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_texts(spark):
    parts = MIT.split("\n\n")
    texts = {
        1: MIT, 2: "\n\n".join([parts[0], parts[3], parts[2], parts[1]]), 3: None, 4: "", 5: "No licence here. Licensed.",
        6: "prose without end\nLicensed under the Apache License, Version 2.0.\nmore", 7: "x. Released under the MIT License. ALL  RIGHTS reserved.",
        8: "\n\n".join(X.SENTENCES[k] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
        9: "\n\n".join(X.SENTENCES[k] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary")),
        10: "Licensed under CC BY-NC 4.0.", 11: "Not licensed under CC BY-NC 4.0 I think.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 AS licences")
    got = {r["doc_id"]: r["licences"] for r in X.scan_licences(df).collect()}
    want = {1: ["MIT"], 6: ["Apache-2.0"], 7: ["MIT", "all-rights-reserved"], 8: ["BSD-3-Clause"], 9: ["BSD-2-Clause"], 10: ["CC-BY-NC-4.0"]}
    assert got == {k: want.get(k, []) for k in texts}
    assert X.scan_licences(df.limit(0)).count() == 0
    assert X.scan_licences(df, sentences={}, rules=[]).where("size(licences) > 0").count() == 0


def test_every_rule_is_reached(spark):
    assert not any(re.search(X.SENTENCE_END, x) for x in X.SENTENCES.values())
    rows = [(i, "\n\n".join(X.SENTENCES[k] + "." for k in ids)) for i, (_, ids) in enumerate(X.RULES)]
    got = X.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["licences"][0] for r in got] == [name for name, _ in X.RULES]
    assert {k for _, ids in X.RULES for k in ids} == set(X.SENTENCES)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r["licences"] for r in X.scan_licences(docs).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved"}
    for r in docs.collect():
        for line, name in lines.items():
            assert (line in (r["text"] or "").split("\n")) <= (name in found[r["doc_id"]])
