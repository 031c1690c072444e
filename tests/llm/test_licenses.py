import re
import textwrap

from inkweave.llm import licenses as lic
from tests.oracle import assert_same


def units(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").selectExpr("*", "1 as digest", "2 as id", "3 as unit", "4 as form")
    return sorted((r["id"], r["unit"], r["license_id"]) for r in lic.license_units(df, lic.known_digests(spark), **more).collect())


def test_variants_of_whole_texts(spark):
    bsd = lic.BSD_HEAD + lic.BSD_TAIL
    texts = [
        "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, 60) for p in lic.MIT.split("\n\n")),
        lic.MIT.upper().replace("SUBLICENSE", "SUB-LICENCE"), "/* Copyright 1999 X */\n" + textwrap.fill(bsd, 50), "© Me\n" + bsd.replace('"AS IS"', "``as is''"),
        lic.MIT.replace("free of charge", "for a fee"), lic.MIT + " And more.", "MIT License\n\nCopyright by someone\n\n" + lic.MIT, "", None, "x" * 100_000, "Released under the MIT Licence",
    ]
    got = {a: c for a, b, c in units(spark, texts, lines=False)}
    assert got == {0: "MIT", 1: "MIT", 2: "BSD-2-Clause", 3: "BSD-2-Clause", 4: None, 5: None, 6: "MIT", 7: None, 8: None, 9: None, 10: "MIT"}


def test_full_texts_under_copyright_lines(spark):
    full = dict(reversed(lic.full_texts()))
    assert len(full) >= 15 and all(len(t) > 700 for t in full.values())
    texts = [f"Copyright Jane Doe 2020\n\n{lic.MIT}", f"Copyright: 2020 X\n{lic.MIT}"]
    texts += [f"// Copyright (C) 2001 A\n" + " ".join(t.replace(" license", " licence").split()) for t in (full["Zlib"], full["Unlicense"])]
    texts += [dict(lic.full_texts())[k].upper() for k in ("Apache-2.0", "GPL-3.0", "LGPL-2.1")] + [full[k].replace("\n", "\r\n  ") for k in ("MPL-2.0", "GFDL-1.3", "CC0-1.0")]
    texts += [full["GPL-3.0"] + "\nmore terms", "conversion 2 conversion v2", "CONVERSION 2; conversion version 2", "per cent per cent", "percent percent"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r["id"]: r for r in lic.license_units(df, lic.known_digests(spark), lines=False).collect()}
    assert [rows[i]["license_id"] for i in range(11)] == ["MIT", "MIT", "Zlib", "Unlicense", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "GFDL-1.3", "CC0-1.0", None]
    assert rows[11]["digest"] == rows[12]["digest"] and rows[13]["digest"] == rows[14]["digest"]


def test_known_lines_have_the_hint():
    short = [t for _, t in lic.KNOWN if "\n" not in t]
    assert len(short) > 10 and all(re.search(lic.LINE_HINT, t.lower()) for t in short)


def test_lines_and_repeats(spark):
    text = "Some words.\n  * Licensed under CC BY-NC 4.0!\nlicensed under cc-by-nc 4.0 too\nReleased under the MIT Licence.\n"
    assert units(spark, [text, text]) == [(i, u, x) for i in (0, 1) for u, x in ((0, None), (2, "CC-BY-NC-4.0"), (4, "MIT"))]
    df = spark.createDataFrame([], "doc_id int, text string")
    assert lic.license_units(df, lic.known_digests(spark)).count() == 0
    assert lic.license_units(df, lic.known_digests(spark, [("a", "x")]).limit(0)).count() == 0


def test_same_as_sql(spark, sf):
    assert assert_same(lic.op5_license_digest(spark, sf), sf, lic.SQL) > 200
