import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from rowmill.llm import licences

MIT = licences.MIT


def scan(spark, texts, schema="doc_id int, text string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)
    return {r.doc_id: r.license for r in licences.scan_licenses(df, licences.known_digests(spark)).collect()}


@pytest.mark.parametrize("text", [
    MIT, MIT.upper(), MIT.replace("\n\n", "\r\n"), "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + MIT, "MIT License\n\nCopyright © 1999-2001 A, B & C\n" + MIT,
    MIT.replace("sublicense", "sublicence"), MIT.replace(",", " , ").replace('"', "“"), "  " + MIT + "\n\n",
])
def test_the_same_license_in_other_spellings(spark, text):
    assert scan(spark, [text]) == {0: "MIT"}


def test_other_texts_are_not_licenses(spark, odd_texts):
    texts = [*odd_texts, MIT + " and more", MIT.replace("without restriction", "with restriction"), MIT[:-20]]
    assert set(scan(spark, texts).values()) == {None} and len(scan(spark, texts)) == len(texts)


def test_repeats_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, MIT, "x"), (1, MIT, "x"), (None, licences.ZLIB, "y")], "doc_id int, text string, license string")
    out = licences.scan_licenses(df, licences.known_digests(spark))
    assert out.columns == ["doc_id", "text", "digest", "license"]
    assert sorted(r.license for r in out.collect()) == ["MIT", "MIT", "Zlib"]
    assert licences.scan_licenses(df.limit(0), licences.known_digests(spark)).count() == 0


def test_known_digests_are_unambiguous(spark):
    known = licences.known_digests(spark)
    assert known.select("digest").distinct().count() == known.count()


HOLDERS = ("Copyright (c) 2020 A. B. Smith", "Copyright © 1999-2001 A, B & C, Inc. All rights reserved.", "(C) 2007 Somebody", "Copyright 2015-present the authors.")


def test_rewrapped_and_one_line_versions_of_each_known_text(spark):
    texts, want = [], []
    for name, known in licences.KNOWN.items():
        for text in known:
            parts = [" ".join(p.split()) for p in text.split("\n")]
            for width in range(20, 100, 3):
                texts.append("\n".join(textwrap.fill(p, width, break_long_words=False) for p in parts))
            for holder in HOLDERS:
                body = " ".join(text.split())
                texts += [f"{holder} {body}", f"{holder}\n{body}", f"# {holder}\n\n{text}"]
            texts.append(" ".join(text.split()))
            want += [name] * (len(texts) - len(want))
    for title in ("MIT License", "The MIT License (MIT)"):
        texts += [f"{title} {h} {' '.join(MIT.split())}" for h in HOLDERS]
        texts += [f"{title}\n\nCopyright Joe Bloggs\n\n{MIT}"]
    want += ["MIT"] * (len(texts) - len(want))
    got = scan(spark, texts)
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != want[i]] == []


def test_body_lines_are_no_holder_lines(spark):
    texts = ["copyright notice and this\npermission notice", "(c) you must retain all notices\nof the source", "a\nall rights reserved by law"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(licences.canonical(F.col("text")).alias("c"))
    assert [r.c for r in df.collect()] == [re.sub("[^a-z]+", " ", t).strip() for t in texts]


def found(spark, texts, schema="doc_id int, text string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)
    rows = licences.find_licenses(df, licences.known_digests(spark)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    return {r.doc_id: r.licenses for r in rows}


def test_licenses_inside_documents(spark, odd_texts):
    wrapped = "\n\n".join(textwrap.fill(p, 70) for p in MIT.replace("NONINFRINGEMENT", "NON INFRINGEMENT").split("\n\n"))
    cases = [
        ("Some prose.\nReleased under the MIT Licence.\nMore prose.", ["MIT"]),
        (f"About\n\n{wrapped}\n\nThe end", ["MIT"]),
        (f"About\r\nMIT License\r\nCopyright (c) 2020 A\r\n{MIT}".replace("\n\n", "\r\n\r\n"), ["MIT"]),
        (f"About\n\nMIT License\nCopyright (c) 2020 A\n\n{MIT}\n\nLicensed under CC BY-NC 4.0.\n", ["CC-BY-NC-4.0", "MIT"]),
        ("Zlib\n\n" + licences.ZLIB.replace("\n2.", "\n\n2.").replace("\n3.", "\n\n3.") + "\n\nend", ["Zlib"]),
        ("This work is licensed under the GNU General\nPublic License, version 3.\n\nprose", ["GPL-3.0"]),
        ("He said it was released under the MIT License. Or not.", []),
        (MIT.replace("without restriction", "with restriction") + "\n\nprose", []),
        (MIT, ["MIT"]), (licences.ISC, ["ISC"]),
        ("Tool\n\nBSD 3-Clause License\n\nCopyright (c) 2021, A. Person\nAll rights reserved.\n\n" + licences.KNOWN["BSD-3-Clause"][1] + "\n\nmore", ["BSD-3-Clause"]),
        ("x\n\n" + licences.KNOWN["BSD-2-Clause"][0].replace("\n\n", "\n") + "\n\ny", ["BSD-2-Clause"]),
        (f"readme\n\n{licences.UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>\n\nend", ["Unlicense"]),
    ]
    got = found(spark, [t for t, _ in cases] + odd_texts)
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert all(got[i] == [] for i in range(len(cases), len(got)))


def test_units_are_canonical_texts(spark, odd_texts):
    texts = [t for name in licences.KNOWN for t in licences.KNOWN[name]] + odd_texts
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    unit = licences._units(F.col("text"), 2)
    assert all(r.c == "" or r.c in r.u for r in df.select(licences.canonical(F.col("text")).alias("c"), unit.alias("u")).collect())


def test_notices_of_the_test_table_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain = lambda s: " ".join(re.findall("[a-z0-9]+", s.lower()))
    notices = {plain(t): name for name, known in licences.KNOWN.items() for t in known if len(t) < 100}
    want = {r.doc_id: sorted({notices[plain(x)] for x in (r.text or "").split("\n") if plain(x) in notices}) for r in docs.collect()}
    got = {r.doc_id: r.licenses for r in licences.find_licenses(docs, licences.known_digests(spark)).collect()}
    assert any(want.values()) and got == want


def test_found_licenses_of_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, MIT, "x"), (1, MIT, "x"), (None, None, "y")], "doc_id int, text string, licenses string")
    out = licences.find_licenses(df, licences.known_digests(spark))
    assert out.columns == ["doc_id", "text", "licenses"] and sorted(r.licenses for r in out.collect()) == [[], ["MIT"], ["MIT"]]
    assert licences.find_licenses(df.limit(0), licences.known_digests(spark)).count() == 0


def long_texts():
    """Two versions of a license of nine blocks, the second with an appendix, and another one that begins alike."""
    terms = "\n\n".join(["THE LONG LICENCE\n Version 2", *[f"{i}. Term number {i}, which is\nwritten over two lines." for i in range(1, 9)]])
    return [("Long", terms), ("Long", terms + "\n\nHow to apply it\n\nWrite it down."), ("Other", terms.replace("Term number 8", "The last term"))]


def test_long_licenses_inside_documents(spark):
    long = [tuple(r) for r in licences.long_entries(spark.createDataFrame(long_texts(), "license string, text string")).collect()]
    assert [(x[0], x[2]) for x in long] == [("Long", 9), ("Long", 11), ("Other", 9)]
    (_, plain), (_, appended), (_, other) = long_texts()
    wrapped = "\n\n".join(textwrap.fill(" ".join(b.split()), 25) for b in plain.upper().split("\n\n"))
    cases = [(plain, ["Long"]), (f"Notes\n\n{plain}\n\nmore", ["Long"]), (f"a\n\n{wrapped}\n\nb", ["Long"]), (f"a\n\n{appended}\n\nb", ["Long"]),
             (f"{other}\n\n{plain}".replace("\n", "\r\n"), ["Long", "Other"]), (f"The long licence version 2\n\n{other}", ["Other"]),
             (f"a\n\n{plain[:-20]}\n\nb", []), (plain.replace("number 4", "number four"), []), (None, []), ("The long licence\nversion 2", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    known = licences.known_digests(spark, long=long)
    got = {r.doc_id: r.licenses for r in licences.find_licenses(df, known, long=long).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert licences.long_entries(spark.createDataFrame([("x", None), ("x", " ")], "license string, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license texts on this system")
def test_full_texts_of_this_system(spark):
    folder, names = "/usr/share/common-licenses", {x[0]: x[0].removesuffix(".0") if "GPL" in x[0] else x[0] for x in licences.LONG}
    texts = {n: open(os.path.join(folder, f), encoding="utf-8").read() for n, f in names.items() if os.path.exists(os.path.join(folder, f))}
    rows = [(n, f"Notes of a package\n\n{t}\n\nEnd of the file.") for n, t in texts.items()]
    df = spark.createDataFrame(rows, "name string, text string")
    assert rows and all(r["name"] in r.licenses for r in licences.find_licenses(df, licences.known_digests(spark)).collect())
