import random
import zlib

from pyspark.sql import functions as F

from rowmill.llm import queries, toxicity
from rowmill.plans.registry import Tables

BAD = ["vermin", "filth", "rotten"]


def corpus(vocabulary, n=400, seed=1):
    """Texts with and without bad words, a large group of copies among the ordinary ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, "the one passage of all copies " * 3 if i % 4 == 1 else " ".join(words), toxic))
    return out


def test_held_out_rows(llm, vocabulary):
    rows = corpus(vocabulary)
    docs = llm.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id bigint, text string, score double")
    labels = llm.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id bigint, toxic boolean")
    labels = labels.union(llm.createDataFrame([(i, y) for i, _, y in rows if i % 8 == 0], "doc_id bigint, toxic boolean"))
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(rows)
    assert all(out[i].predicted == y == (out[i].score >= toxicity.THRESHOLD) for i, _, y in rows if not (i % 2 or i % 8 == 0))


def test_length_does_not_hide_an_expression(vocabulary):
    model = toxicity.fit([(t, y) for _, t, y in corpus(vocabulary)])
    rng = random.Random(2)
    plain = [rng.choice(vocabulary) for _ in range(2000)]
    assert model.score(" ".join(plain)) < 0.7 <= model.score(" ".join(plain[:900] + BAD * 2 + plain[900:]))
    assert model.score(None) == model.score("") == model.score("?? !!") < 0.7


def test_blocks_of_a_long_text(vocabulary, monkeypatch):
    model = toxicity.fit([(t, y) for _, t, y in corpus(vocabulary)])
    text = " ".join(vocabulary * 5 + BAD)
    whole = model.evidence(text)
    monkeypatch.setattr(toxicity, "_BLOCK", 17)
    assert abs(model.evidence(text) - whole) < 1e-9


def test_copies_count_once(vocabulary):
    """A word that copies of one toxic text repeat weighs less than one that stands in many places."""
    rows = [("copied " + " ".join(vocabulary[:30]), True)] * 200 + [(" ".join(vocabulary[i : i + 20] + ["spread"] + vocabulary[i + 20 : i + 40]), True) for i in range(50)]
    rows += [(" ".join(vocabulary[i : i + 60]), False) for i in range(200)]
    model = toxicity.train(*map(list, zip(*rows)))
    assert model.evidence("spread") > 2 > model.evidence("copied") and model.evidence("unheard") == 0


def test_odd_tables(llm, odd_texts):
    docs = llm.createDataFrame([(i, t) for i, t in enumerate(odd_texts)] + [(None, "x"), (3, "y"), (3, "y")], "doc_id bigint, text string")
    none = llm.createDataFrame([], "doc_id bigint, toxic boolean")
    one = llm.createDataFrame([(4, True), (None, False), (5, None)], "doc_id bigint, toxic boolean")
    both = llm.createDataFrame([(i, i % 2 == 0) for i in range(14)] + [(3, True)], "doc_id bigint, toxic boolean")
    for labels in (none, one, both):
        rows = toxicity.toxicity(docs, labels).collect()
        assert len(rows) == len(odd_texts) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(docs.limit(0), both).count() == 0


def test_sample_is_bounded_and_learns_from_its_rows_only(llm, sf):
    t = Tables(llm, sf)
    labels = t.labels.select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    assert len(toxicity.sample_rows(t.documents, labels, max_rows=4)) <= 8
    held = {r.doc_id: r.h for r in t.documents.select("doc_id", queries.held(1, 3).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in held}


def test_held_out_accuracy_on_labels(llm):
    t = Tables(llm, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.toxic for r in t.labels.collect()}
    rows = [r for r in queries.text_toxicity(t, t.documents.select("doc_id", "text")).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in truth]
    clean = [r for r in rows if truth[r.doc_id] == 0]
    toxic = [r for r in rows if truth[r.doc_id] == 1]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean) and sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
