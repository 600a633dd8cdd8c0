from trailmark.llm import license_scan as ls


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in ls.scan(docs).collect()}


def test_entire_texts_match_in_any_case_spelling_and_layout(spark):
    got = scan(spark, [
        "Copyright (c) 2020 Somebody\n\n" + ls.MIT.upper().replace(" ", "  \n"),
        "(c) 1999 A. Body. All rights reserved.\r\n" + ls.ISC.replace(",", ";"),
        ls.APACHE_NOTICE.replace("License", "Licence").replace("http:", "https:"),
        ls.MIT + " and more",
        None, "", "!!! ---", "plain prose",
        "words before\n  LICENSED under cc by-nc 4.0\nReleased under the MIT Licence!\nwords after",
    ])
    assert [got[k].license_id for k in range(9)] == ["MIT", "ISC", "Apache-2.0", None, None, None, None, None, None]
    assert [got[k].digest is None for k in (4, 5, 6, 7)] == [True, True, True, False]
    assert got[8].line_licenses == ["CC-BY-NC-4.0", "MIT"]
    assert got[7].line_licenses == got[4].line_licenses == []


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, ls.MIT, "a", "b")] * 2 + [(None, None, "a", "b")], "doc_id long, text string, digest string, license_id string")
    rows = ls.scan(docs).collect()
    assert sorted(str(r.license_id) for r in rows) == ["MIT", "MIT", "None"]
    assert ls.scan(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    assert scan(spark, ["word " * 200_000 + "\nReleased under the MIT License."])[0].line_licenses == ["MIT"]


def test_no_python_on_the_main_path(spark):
    plan = ls.op6_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan


def test_neighbours_are_spelled_alike(spark):
    got = scan(spark, ["licence licence licence per cent per cent", "license license license percent percent", "SPDX-License-Identifier: GPL-3.0-or-later"])
    assert got[0].digest == got[1].digest and got[2].license_id == "GPL-3.0-or-later"


def test_copyright_lines_go_and_clauses_stay(spark):
    gone = [
        "Copyright Alice Smith", "COPYRIGHT The Regents of the University", "Copyright: A. Body and others", "# Copyright Alice 2020, a holder with a rather long name of more than eight words",
        "Copyright (c) A", "copyright 2020", "Copyright <YEAR> <HOLDER>", "(c) 2020 A", "(C) Copyright A", "(c) A. Body, 2020.", "(c) A. Body. All rights reserved.", "© A", "All rights reserved.",
    ]
    stays = [
        "(c) you must keep notices", "(c) you must, as of 2020, keep notices", "copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "copyright, patent and trademark notices",
        "copyright license to reproduce works of 2020", "copyrighted works of 2020", "the copyright 2020", "Copyright is held by nobody whom we could name in so short a line as this",
    ]
    plain = scan(spark, [ls.MIT, "plain words"] + [line + "\n" + ls.MIT for line in gone] + [line + "\nplain words" for line in stays])
    assert [plain[2 + k].license_id for k in range(len(gone))] == ["MIT"] * len(gone)
    assert all(plain[2 + len(gone) + k].digest != plain[1].digest for k in range(len(stays)))
    assert scan(spark, [ls.BSD_3])[0].license_id == "BSD-3-Clause" != scan(spark, [ls.BSD_2])[0].license_id


def test_sql_sees_the_same_lines(spark, tmp_path):
    import duckdb

    lines = ["Copyright Alice", "copyright notices", "copyright notice", "Copyright: holder", "copyright :notice", "copyright, patent", "(c) you must", "(c) 2020 x", "copyright", "copyright  the a b c d e f g", "copyright the a b c d e f g h", "copyright norma", "copyrights 2020", "- copyright (c)", "copyright by law is", "copyright by A", "© x", "copyright\tis", "copyright İx", "copyright or", "copyright license 2020"]
    docs = spark.createDataFrame([(k, f"{line}\r\nsome words\n{line}") for k, line in enumerate(lines)] + [(99, None), (100, "")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    told = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, digest FROM ({ls.oracle()})").fetchall()}
    assert {r.doc_id: r.digest for r in ls.scan(docs).collect()} == told


def test_whole_licences_identifiers_and_holders_on_the_next_line(spark):
    whole = {name: text for name, text in ls.known_licenses() if len(text) > 5_000}
    texts = [*whole.values(), "Copyright (C) 2020\nAlice Smith\n\n" + ls.MIT, "/* Copyright 2019-2021\n * The Authors of It */\n\n" + ls.ISC]
    texts += [f"x\n// SPDX-License-Identifier: {x}\ny" for x in ls.SPDX] + ["Copyright (C) 2020\n" + ls.MIT, "\n".join("> " + line for line in whole["GPL-2.0"].split("\n"))]
    got, n = scan(spark, texts), len(whole)
    assert [got[k].license_id for k in range(n)] == list(whole)
    assert [got[n].license_id, got[n + 1].license_id, got[len(texts) - 2].license_id, got[len(texts) - 1].license_id] == ["MIT", "ISC", "MIT", "GPL-2.0"]
    assert [got[n + 2 + k].line_licenses for k in range(len(ls.SPDX))] == [[x] for x in ls.SPDX]
