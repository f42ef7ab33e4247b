import os
import textwrap

import pytest

from ledgerlens.llm import license_scan
from ledgerlens.llm.oracle import OP5

from ..oracle_check import assert_same

SCHEMA = "doc_id long, text string, digest string"


def test_variants_of_a_text_have_one_digest(spark):
    mit = license_scan.LICENSES["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.upper().replace(",", " ,")), (3, mit.replace("copyright holders", "copyright owners").replace("sublicense", "sub-licence")),
        (4, mit + "\nAnd more."), (5, "Some words.\n  licensed under the APACHE licence, version 2.0\nMore words."), (6, None), (7, ""), (8, "…"), (2, mit),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = [(r["doc_id"], r["license"], r["notices"]) for r in license_scan.scan_licenses(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, "MIT", None), (2, "MIT", None), (2, "MIT", None), (3, "MIT", None), (4, None, None), (5, None, "Apache-2.0"), (6, None, None), (7, None, None), (8, None, None)], key=str)


def test_equals_its_oracle(spark):
    texts = ["Licensed under the Apache License, Version 2.0.\nRELEASED under the MIT Licence", "© me\nall rights reserved\nLabour centre organisation", "É x\n\n(c) y\nCopyright", "plain", license_scan.LICENSES["ISC"], "MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + license_scan.LICENSES["MIT"], "copyright notice and more\nCopyright 2019 me\nend"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    assert_same(license_scan.scan_licenses(docs), OP5, None, {"documents": docs.toPandas()})


def test_every_known_text_is_found_and_an_empty_table_is_empty(spark):
    known = license_scan.known_texts()
    docs = spark.createDataFrame([(k, t, "") for k, (t, _) in enumerate(known)], SCHEMA)
    assert {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs).collect()} == {k: n for k, (_, n) in enumerate(known)}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def found(spark, given, **options):
    docs = spark.createDataFrame([(k, t, "") for k, t in enumerate(given)], SCHEMA)
    return [r["license"] for r in license_scan.scan_licenses(docs, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize("width", [40, 54, 60, 66, 72, 80, 100])
def test_licence_files_as_they_are_usually_laid_out(spark, width):
    titles = {"MIT": "MIT License", "ISC": "ISC License:", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "The 3-Clause BSD License", "0BSD": "BSD Zero Clause License (0BSD)", "Zlib": "zlib License", "Unlicense": "The Unlicense"}
    texts = ["\n\n".join([title, "Copyright (c) 2011-2024 Some One <a@b.c>\nAll rights reserved.", *["\n".join(textwrap.wrap(x, width)) for x in license_scan.LICENSES[name].split("\n")]]) + "\n" for name, title in titles.items()]
    assert found(spark, texts) == list(titles)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_long_licences_by_their_digests(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = []
    for name in files:
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as file:
            texts.append(file.read())
    assert found(spark, texts) == list(files.values())


def test_a_catalogue_of_the_callers(spark):
    more = spark.createDataFrame([("My Own Terms\nUse it well.", "Own-1.0"), ("", "Empty"), (None, "Null")], "text string, license string")
    assert found(spark, ["my own terms, use it well", "", None, license_scan.LICENSES["MIT"]], texts=more) == ["Own-1.0", None, None, "MIT"]
    with pytest.raises(ValueError):
        found(spark, ["x"], texts=spark.range(license_scan.CATALOGUE_ROWS + 1).selectExpr("concat('text ', id) as text", "'x' as license"))


def test_a_callers_notice_of_one_line_and_a_very_long_text(spark):
    more = spark.createDataFrame([("Distributed under MPL 2.0.", "MPL-2.0")], "text string, license string")
    docs = spark.createDataFrame([(1, "Some text\n  distributed under MPL 2.0\nend", ""), (2, "line of words\n" * 200_000 + "SPDX-License-Identifier: MIT", ""), (None, "x", "")], SCHEMA)
    assert [r["notices"] for r in license_scan.scan_licenses(docs, more).orderBy("doc_id").collect()] == [None, "MPL-2.0", "MIT"]
