import random
import zlib

import pytest
from pyspark.sql import functions as F

from rowmill.llm import queries, variants
from rowmill.plans.registry import Tables


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, factor=2):
    forms = {}
    near_counts = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        near_counts[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, near_counts[w], counts.get(forms[w])))
    return rows


def forms_of(spark, counts, **kw):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {tuple(r) for r in variants.spelling_forms(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_against_all_pairs(llm):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(500)}
    counts = {w: int(rng.paretovariate(0.7)) for w in words}
    assert forms_of(llm, counts) == brute(counts)


def test_runs_of_equal_letters_count_once(llm):
    counts = {"aaaaa": 9, "aaaa": 3, "aaaab": 2, "aabaa": 1, "baaaa": 100}
    assert forms_of(llm, counts) == brute(counts)


@pytest.mark.parametrize("size", [variants.LONG - 1, variants.LONG, variants.LONG + 1, 400])
def test_long_words(llm, size):
    rng = random.Random(size)
    base = "".join(rng.choice("abcdefgh") for _ in range(size))
    counts = {base: 50, base[:-1]: 20, base + "x": 7, base[1:]: 5, "z" + base[1:]: 3, base[:size // 2] + "q" + base[size // 2:]: 90, base[::-1]: 2}
    assert forms_of(llm, counts) == brute(counts)


def test_ties_and_chains(llm):
    counts = {"abcde": 1, "abcdf": 2, "abcdg": 2, "abchf": 8, "ibchf": 16, "ibchj": 15}
    got = {r[0]: r for r in forms_of(llm, counts)}
    assert got["abcde"][1] == "abcdf" and got["abcde"][2] == "ibchf" and got["ibchj"][1] is None
    assert forms_of(llm, counts) == brute(counts)


def test_null_empty_and_no_rows(llm):
    df = llm.createDataFrame([(None, 4), ("", 3), ("a", 1)], "word string, n long")
    assert {tuple(r) for r in variants.spelling_forms(df).collect()} == {("", None, "", 3, 1, None), ("a", "", "", 1, 1, 3)}
    assert variants.spelling_forms(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_forms(df, factor=1)


def test_ranges_are_bounded_by_the_alphabet(llm):
    """Words that share all letters but one meet in one range; nothing lists their pairs."""
    counts = llm.range(26).select(F.concat(F.lit("abcd"), F.char(F.col("id") + 97)).alias("word"), (F.col("id") + 1).alias("rank"))
    entries = counts.select(F.inline(variants.rotations(F.col("word")))).groupBy("prefix").count()
    assert entries.agg(F.max("count")).first()[0] == 26
    near_rows = variants.near_words(counts).collect()
    assert len(near_rows) == 26 and {r.n_near for r in near_rows} == {25}
    assert {r["rank"]: r["best"] for r in near_rows} == {**{i: 1 for i in range(2, 27)}, 1: 2}


def test_query_against_python(llm, tmp_path, odd_texts):
    rng = random.Random(2)
    letters = "abcdÀß÷É"
    texts = [*odd_texts, *[" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 7))) for _ in range(200)) for _ in range(20)]]
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x"), (21, texts[21], "x")]
    llm.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    import re

    seen = {}
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                seen[run] = seen.get(run, 0) + 1
    expected = brute({w: n for w, n in seen.items() if n >= 3})
    got = queries.spelling_variants(Tables(llm, str(tmp_path)))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == expected and expected
