from stowage.llm.licences import TEMPLATES, TEXTS, scan_licences

SCHEMA = "file long, path string, text string, lines string, tag long, dir string"


def files(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, "d") for r in rows], SCHEMA)


def scan(spark, rows):
    return {(r.file, r.path): r for r in scan_licences(files(spark, rows)).collect()}


ROWS = [
    (1, "LICENSE", TEMPLATES["MIT"]),
    (2, "src/COPYING", TEMPLATES["GPL-3.0"] + "\n" + "padding " * 2000),
    (3, "src/a/b/c.py", "code only"),
    (4, "src/a/d.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\n" + "y = 2\n" * 500),
    (5, "src/a/e.py", "no notice here"),
    (6, "other/f.py", "nothing"),
    (7, "srcs/g.py", "a sibling with the same prefix"),
    (8, None, None),
    (9, "src/a/empty.py", ""),
    (10, "src/odd.py", "our licence office is closed on mondays during the summer months"),
]


def test_own_and_nearest_ancestor(spark):
    got = scan(spark, ROWS)
    assert len(got) == len(ROWS)
    by = {k[0]: (r.licence, r.inherited_from) for k, r in got.items()}
    assert by == {1: ("MIT", None), 2: ("GPL-3.0", None), 3: ("GPL-3.0", "src"), 4: ("Apache-2.0", None), 5: ("GPL-3.0", "src"), 6: ("MIT", ""), 7: ("MIT", ""), 8: ("MIT", ""), 9: ("GPL-3.0", "src"), 10: ("GPL-3.0", "src")}
    assert got[2, "src/COPYING"].is_licence_file and not got[4, "src/a/d.py"].is_licence_file and got[10, "src/odd.py"].n_statements == 1


def test_every_template_is_recognised(spark):
    got = scan(spark, [(i, f"d{i}/x.py", f"line\n{words}\nline") for i, words in enumerate(TEMPLATES.values())])
    assert [got[i, f"d{i}/x.py"].own_licence for i in range(len(TEMPLATES))] == list(TEMPLATES)


def test_repeats_ties_and_empty(spark):
    rows = scan_licences(files(spark, [ROWS[3], ROWS[3], (None, "src/a/d.py", ROWS[3][2])])).collect()
    assert len(rows) == 3 and {r.licence for r in rows} == {"Apache-2.0"}
    assert scan_licences(files(spark, [])).count() == 0


def wrapped(words, mark, width=70):
    lines, line = [], mark
    for w in words.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = mark
        line += " " + w
    return "\n".join([*lines, line])


def test_wrapped_headers_and_whole_texts(spark):
    """Each whole template, wrapped and commented, above code; and as a licence file under a name that says nothing."""
    code = "\n\nimport os\n\ndef main():\n    return os.getcwd()\n" + "value = compute(value)\n" * 200
    texts = [(name, words) for name, words in TEXTS if len(words) > 100]
    rows = [(i, f"h{i}/x.py", wrapped(words, "#") + code) for i, (_, words) in enumerate(texts)]
    rows += [(100 + i, f"t{i}/about.txt", f"Copyright (c) 2020 Jane Doe\n\n{wrapped(words, '')}\n") for i, (_, words) in enumerate(texts)]
    rows += [(200 + i, f"t{i}/sub/deep/code.c", "int main;") for i in range(len(texts))]
    got = scan(spark, rows)
    by = {k[0]: r for k, r in got.items()}
    assert [by[i].own_licence for i in range(len(texts))] == [n for n, _ in texts] and not any(by[i].is_licence_file for i in range(len(texts)))
    assert [by[100 + i].own_licence for i in range(len(texts))] == [n for n, _ in texts] and all(by[100 + i].is_licence_file for i in range(len(texts)))
    assert [(by[200 + i].licence, by[200 + i].inherited_from) for i in range(len(texts))] == [(n, f"t{i}") for i, (n, _) in enumerate(texts)]


def test_spdx_tags(spark):
    tags = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "ISC": "ISC", "BSD-3-Clause": "BSD-3-Clause"}
    got = scan(spark, [(i, f"d{i}/x.c", f"/* SPDX-License-Identifier: {t} */\nint x;\n" * 1 + "int y;\n" * 40) for i, t in enumerate(tags)])
    assert [got[i, f"d{i}/x.c"].own_licence for i in range(len(tags))] == list(tags.values())


def test_source_files_cover_nothing_and_titles_are_known(spark):
    """A source file that is nearly all header keeps its licence to itself; the opening of a long licence text is enough."""
    header = wrapped(dict(t for t in TEXTS if t[0] == "GPL-3.0" and len(t[1]) > 100)["GPL-3.0"], "#")
    gnu = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n" + "Terms that go on.\n" * 400
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + "Definitions that go on.\n" * 400
    rows = [
        (1, "a/small.py", header + "\n\nimport os\nx = 1\ny = 2\nprint(x)\n"), (2, "a/vendored.py", "z = 1"), (3, "a/sub/deep.py", "z = 2"),
        (4, "b/COPYING", gnu), (5, "b/x.py", "z = 3"), (6, "c/LICENSE", apache), (7, "c/x.py", "z = 4"),
    ]
    got = {k[0]: (r.own_licence, r.is_licence_file, r.licence, r.inherited_from) for k, r in scan(spark, rows).items()}
    assert got[1] == ("GPL-3.0", False, "GPL-3.0", None) and got[2] == got[3] == (None, False, None, None)
    assert got[4] == ("GPL-3.0", True, "GPL-3.0", None) and got[5] == (None, False, "GPL-3.0", "b")
    assert got[6] == ("Apache-2.0", True, "Apache-2.0", None) and got[7] == (None, False, "Apache-2.0", "c")


def test_spdx_expressions(spark):
    tags = {"(MIT OR  Apache-2.0)": "MIT OR Apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only WITH Classpath-exception-2.0",
            "MIT AND (ISC OR BSD-3-Clause)": "MIT AND (ISC OR BSD-3-Clause)", "MIT": "MIT"}
    got = scan(spark, [(i, f"d{i}/x.c", f"// SPDX-License-Identifier: {t}\nint x;\n" + "int y;\n" * 40) for i, t in enumerate(tags)])
    assert [got[i, f"d{i}/x.c"].own_licence for i in range(len(tags))] == list(tags.values())
