import duckdb

from tablecare.llm import licence_texts, licences

from .helpers import EDGES, documents

MIT = dict(reversed(licences.KNOWN))["MIT"]


def test_forms_match_and_others_do_not(spark, tmp_path):
    full = [t for n, t in licences.KNOWN if n == "MIT"][-1]
    rows = [(20, "Copyright (c) 2020 Someone Else\n\n" + full.upper().replace(", ", ",\n"), "a"),
            (21, "Some text.\nreleased under the M I T licence!\nReleased under the MIT Licence\nEnd", "a"),
            (22, "Released under the MIT License. But not quite", "a"), (23, "© 2019 X\nAll rights reserved.\nLicensed under CC BY-SA 4.0", "b"),
            (23, "© 2019 X\nAll rights reserved.\nLicensed under CC BY-SA 4.0", "b")]
    docs = documents(spark, EDGES + rows, tmp_path)
    got = sorted(tuple(r) for r in licences.scan_licences(docs).collect())
    assert got == [(20, "text", -1, "MIT"), (21, "line", 2, "MIT"), *[(23, "line", 2, "CC-BY-SA-4.0")] * 2, *[(23, "text", -1, "CC-BY-SA-4.0")] * 2]
    pandas = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", pandas)
    assert sorted(con.execute(licences.scan_sql()).fetchall()) == got
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, tmp_path, capsys):
    licences.scan_licences(documents(spark, EDGES, tmp_path)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning(digest" not in plan


def test_standard_files(spark, tmp_path):
    text = {n: t for n, t in reversed(licences.KNOWN) if len(t) > 300}
    first = {n: next(t for m, t in licence_texts.FULL if m == n) for n, _ in licence_texts.FULL}
    mit, isc = [t for n, t in licences.KNOWN if n == "MIT"][-1], text["ISC"]
    wrapped = mit.replace("\n", " ").replace(" copyright notice", "\ncopyright notice").replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    files = [("MIT", f"MIT License\n\nCopyright (c) 2024 Jane\n\n{mit}\n"), ("MIT", f"The MIT License (MIT)\n\nCopyright (c) Facebook, Inc. and its affiliates.\n\n{wrapped}"),
             ("MIT", f"Copyright Jane Doe and contributors\n(c) Jane Doe\n© Jane\n{mit}"), ("ISC", f"ISC License\n\nCopyright (c) 2004, Jane Doe\n\n{isc}"),
             ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2017, Jane Doe\nAll rights reserved.\n\n{first['BSD-3-Clause']}"),
             ("BSD-2-Clause", "Copyright (c) The Project Authors. All rights reserved.\n\n" + first["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")),
             ("Apache-2.0", first["Apache-2.0"]), ("Apache-2.0", first["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Jane Doe")),
             ("Apache-2.0", first["Apache-2.0"].split("END OF TERMS AND CONDITIONS")[0]), ("Apache-2.0", first["Apache-2.0"].split("licenses/\n")[1]),
             *[(n, first[n]) for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")],
             ("GPL-3.0", first["GPL-3.0"].replace("https://", "http://")), (None, first["GPL-3.0"].replace("Program", "Work")), (None, "MIT License\n\nCopyright (c) 2024 Jane")]
    docs = documents(spark, [(i, t, "a") for i, (_, t) in enumerate(files)], tmp_path)
    got = sorted(tuple(r) for r in licences.scan_licences(docs).where("unit = 'text'").collect())
    assert got == [(i, "text", -1, n) for i, (n, _) in enumerate(files) if n]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(r for r in con.execute(licences.scan_sql()).fetchall() if r[1] == "text") == got
