from tillroll.llm import licenses


def test_every_template_is_found(spark):
    known = [(family, t) for family, ts in licenses.TEMPLATES.items() for t in ts]
    docs = spark.createDataFrame([(i, f"text\n{t}\nmore text") for i, (_, t) in enumerate(known)], "doc_id long, text string")
    model = licenses.fit(docs)
    got = {(r.doc_id, r.line_no): r.family for r in licenses.scan(docs, model).collect()}
    assert {i: got.get((i, 1)) for i in range(len(known))} == dict(enumerate(f for f, _ in known))
    wrapped = "Released under\nthe GPL version 3\n\nPermission is hereby granted, free of\ncharge, to any person obtaining\na copy of this software"
    notice = spark.createDataFrame([(1, wrapped), (2, "Released under GPLv2 or later"), (3, "SPDX: MIT"), (4, "CC BY 4.0"), (5, "Apache 2.0")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.family for r in licenses.scan(notice, model).collect()}
    assert got[1, 3] == "MIT" and {d for d, _ in got} == {1, 2, 3, 4, 5}
    assert (got[4, 0], got[5, 0]) == ("CC-BY", "Apache-2.0")


def test_grams_are_looked_up_by_slot(spark):
    weights = {f"word{i}": [float(i), 0.0] for i in range(5000)}
    model = licenses.LicenseModel(["MIT", licenses.UNKNOWN], weights, [-5.0, 0.0], 1.0)
    rows = spark.createDataFrame([(i, f"word{i}") for i in (1, 7, 4999)], "doc_id long, text string")
    found = licenses.scan(rows, model)
    assert {r["doc_id"]: r["family"] for r in found.collect()} == {7: "MIT", 4999: "MIT"}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "crc32(" in plan and "element_at(" not in plan
