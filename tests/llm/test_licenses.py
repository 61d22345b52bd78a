from pathlib import Path

import duckdb
import pytest

from lodestar.llm import licenses, registry


def scan(spark, texts, known=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license_id): (r.whole_text, r.n_lines) for r in licenses.scan(docs, licenses.known(spark, known)).collect()}


def test_spelling_case_punctuation_and_copyright_lines_don_t_count(spark):
    mit = licenses.KNOWN["MIT"]
    changed = "Copyright (c) 2020 A. Person\r\n\r\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(".", " .") + "\nAll rights reserved."
    assert scan(spark, [mit, changed, mit + "\nmore", mit.replace("\n", " ")]) == {(0, "MIT"): (True, 0), (1, "MIT"): (True, 0), (3, "MIT"): (True, 1)}


def test_how_lines_are_broken_makes_no_difference(spark):
    texts = {"a": "The copyright owner and the non commercial use of ten per cent, a sub license: permission", "b": licenses.KNOWN["MIT"]}
    other = ["The copyright\nholder and the non\ncommercial use of ten per\r\ncent, a sublicence;\n permission", "\n".join(licenses.KNOWN["MIT"].split()), licenses.KNOWN["MIT"].replace(" ", "\n  * ", 40)]
    assert scan(spark, other, texts) == {(0, "a"): (True, 0), (1, "b"): (True, 0), (2, "b"): (True, 0)}
    assert scan(spark, other[1:]) == {(0, "MIT"): (True, 0), (1, "MIT"): (True, 0)}


@pytest.mark.parametrize("one, other", [("fulfil", "fulfill"), ("wilful", "willful"), ("organisations", "organizations"), ("cancelled", "canceled"), ("centre", "center"), ("judgement", "judgment"), ("honour", "honor"), ("a non profit", "a nonprofit")])
def test_equivalent_spellings(spark, one, other):
    assert scan(spark, [f"Software {other} x"], {"k": f"software: {one.upper()} X"}) == {(0, "k"): (True, 1)}


def test_texts_without_a_stem_are_found_if_a_known_one_has_none(spark):
    known = {"x": "Do what you like.", "y": "Free software"}
    assert scan(spark, ["do WHAT you-like", "free  software!", "something"], known) == {(0, "x"): (True, 1), (1, "y"): (True, 1)}


def test_only_what_may_be_one_is_normalised(spark, sf):
    plan = registry.op8_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    guards = [line for line in plan.split("\n") if "Filter" in line and "Contains(" in line]
    assert guards and not any("colo|favo" in line for line in guards)


def test_lines(spark):
    line = licenses.KNOWN["MIT-notice"]
    assert scan(spark, [f"x\n  {line.lower()} \ny\nreleased under the mit licence!", line, "Released under the MIT"]) == {(0, "MIT-notice"): (False, 2), (1, "MIT-notice"): (True, 1)}


def test_equal_licences_and_empty_ones(spark):
    assert scan(spark, ["Colour!", "", None, "...", "© 2020"], {"a": "colour", "b": "COLOR", "none": "", "odd": "(c) 1999"}) == {(0, "a"): (True, 1), (0, "b"): (True, 1)}


def test_odd_documents(spark, odd, empty):
    known = licenses.known(spark, {"tie": "tie, tie", "a": "a", "x": "x" * 5000})
    rows = {(r.doc_id, r.license_id): (r.whole_text, r.n_lines) for r in licenses.scan(odd, known).collect()}
    assert rows == {(9, "tie"): (True, 2), (10, "tie"): (True, 1), (None, "a"): (True, 1), (7, "x"): (True, 1)}
    assert licenses.scan(empty, known).collect() == [] == licenses.scan(odd, known.limit(0)).collect()


def test_no_python_in_the_plan(spark, sf):
    plan = registry.op8_licenses(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_queries_agree_with_sql(spark, sf):
    with duckdb.connect() as c:
        for f in Path(sf).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        for name, sql in registry.oracle_sql().items():
            ours, theirs = registry.queries()[name](spark, sf).toArrow(), c.execute(sql).to_arrow_table()
            names = sorted(ours.column_names)
            assert names == sorted(theirs.column_names)
            assert sorted(zip(*(ours[n].to_pylist() for n in names), strict=True)) == sorted(zip(*(theirs[n].to_pylist() for n in names), strict=True))


def test_usual_files_and_lines_are_known(spark):
    k = licenses.KNOWN
    apache, bsd = k["Apache-2.0"], k["BSD-3-Clause"]
    texts = ["MIT License\n\nCopyright (c) 2020 A. Person\n\n" + k["MIT"], "The ISC License\nCopyright 2019 B\n" + k["ISC"], "BSD 3-Clause License\n\nCopyright (c) 2009, C\nAll rights reserved.\n\n" + bsd, (licenses.TEXTS / "Apache-2.0.txt").read_text(), apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2024 D"), (licenses.TEXTS / "GPL-3.0.txt").read_text(), "x\n# SPDX-License-Identifier: GPL-2.0-or-later\ny", "This project is licensed under the MIT License.", (licenses.TEXTS / "Unlicense.txt").read_text(), "Permission is hereby granted"]
    found = {i: [] for i in range(len(texts))}
    for (i, name), (whole, lines) in scan(spark, texts).items():
        found[i].append((name.split("-titled")[0].split("-notice")[0], whole, lines))
    assert found == {0: [("MIT", True, 0)], 1: [("ISC", True, 0)], 2: [("BSD-3-Clause", True, 0)], 3: [("Apache-2.0", True, 0)], 4: [("Apache-2.0-filled", True, 0)], 5: [("GPL-3.0", True, 0)], 6: [("GPL-2.0-or-later-SPDX", False, 1)], 7: [("MIT", True, 1)], 8: [("Unlicense", True, 0)], 9: []}


def test_every_known_text_agrees_with_sql(spark):
    ours = scan(spark, list(licenses.KNOWN.values()))
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(licenses.KNOWN.values())])
        theirs = {(r[0], r[1]): (r[2], r[3]) for r in c.execute(licenses.scan_sql()).fetchall()}
    assert ours == theirs and all(ours[i, name][0] for i, name in enumerate(licenses.KNOWN))
