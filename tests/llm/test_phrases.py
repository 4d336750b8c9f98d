import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowmill.llm import phrases


def cut(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, window=10):
    out = []
    texts = sorted({("" if i is None else i, tuple(cut(t))) for i, t in items if cut(t)})
    for doc_id, text in docs:
        words, hit, ids = cut(text), set(), set()
        for item_id, terms in texts:
            k = min(len(terms), window)
            windows = {terms[s:s + k] for s in range(len(terms) - k + 1)}
            for s in range(len(words) - k + 1):
                if tuple(words[s:s + k]) in windows:
                    hit.update(range(s, s + k))
                    ids.add(item_id)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute_near(docs, items, span=30):
    counts = {}
    for _, text in docs:
        for w in cut(text):
            counts[w] = counts.get(w, 0) + 1
    out = []
    texts = {("" if i is None else i, tuple(cut(t))) for i, t in items if cut(t)}
    for doc_id, text in docs:
        words, ids = cut(text), set()
        for item_id, terms in texts:
            lead = sorted({t for t in terms if t in counts}, key=lambda t: (counts[t], t))[:3]
            if lead and any(set(lead) <= set(words[s:s + span]) for s in range(len(words))):
                ids.add(item_id)
        out.append((doc_id, len(ids)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"pos": F.lit(1), "term": F.lit("x"), "_k": F.lit(2)})
    b = spark.createDataFrame(items, "item_id string, text string").withColumn("o", F.lit(1))
    return phrases.contamination(d, b, **kw).collect()


def check(spark, docs, items, **kw):
    rows = run(spark, docs, items, **kw)
    assert sorted([tuple(r)[:6] for r in rows], key=str) == brute(docs, items, **kw)
    assert sorted([(r.doc_id, r.n_near) for r in rows], key=str) == brute_near(docs, items)
    return rows


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((5, 60))]) for _ in range(n))
    items = [(f"i{i}", say(rng.choice((1, 2, 9, 10, 11, 25)))) for i in range(25)] + [("dup", "W1, w2!"), ("dup", "w1 w2"), ("dup", "w3 w4 w5"), (None, say(12)), ("gone", "never there at all"), ("none", "..."), ("null", None)]
    docs = [(i, say(rng.randrange(0, 120))) for i in range(60)]
    for i in range(60, 90):
        terms = cut(rng.choice(items)[1])
        s = rng.randrange(0, max(1, len(terms) - 9))
        docs.append((i, " ".join([say(20), " ".join(terms[s:s + rng.choice((9, 10, 14, 40))]).upper(), say(5)])))
    return docs, items


def test_against_all_windows(llm, tables):
    rows = check(llm, *tables)
    assert any(r.n_hit > 10 for r in rows) and len({r.n_items for r in rows}) > 3


def test_other_window(llm, tables):
    check(llm, *tables, window=3)


def test_odd_rows(llm, odd_texts):
    docs = [(None if i == 1 else i // 2, t) for i, t in enumerate(odd_texts)] + [(1, "a b"), (1, "a b"), (None, None), (None, "One two")]
    items = [("s", "one"), ("t", "x x x x x x x x x x x"), ("u", "same line of words here same line of words here same"), ("v", "日本語 の テキスト"), ("w", "é"), ("one two", "ONE two")]
    rows = check(llm, docs, items)
    assert len(rows) == len(docs)


def test_one_word_many_times(llm):
    """A term that fills texts and items gives as many starts as it has postings, times the item's length, and no more."""
    docs = [(i, "the " * (i * 7)) for i in range(12)]
    check(llm, docs, [("a", "the " * 10), ("b", "the " * 31), ("c", "the the of")])


def test_no_rows(llm, tables):
    docs, items = tables
    assert run(llm, [], items) == []
    assert {(r.n_hit, r.n_items, r.n_near, r.contaminated) for r in run(llm, docs, [])} == {(0, 0, 0, False)}


def test_index_reads_the_corpus_once(llm, tables, tmp_path):
    """Starts and words come from the written postings; no later plan reads the texts."""
    docs, items = tables
    d = llm.createDataFrame(docs, "doc_id long, text string")
    terms = phrases.item_terms(llm.createDataFrame(items, "item_id string, text string"))
    index = phrases.build_index(d, terms)
    starts = phrases.phrase_starts(index, phrases._counted(index, terms))
    plan = phrases.phrase_words(index, terms, starts)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "regexp_extract_all" not in plan
    assert phrases.lengths(index).count() == len(docs)
