import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_quality import brute as quality_brute
from test_simhash import brute_print, groups

import corpus_pipeline
from rowmill.llm import simhash, toxicity
from rowmill.llm.queries import tokenizer_path
from rowmill.session import materialize

BAD = ["vermin", "filth", "rotten"]


@pytest.fixture(scope="module")
def corpus(llm, vocabulary, tmp_path_factory):
    """Documents with toxic ones, repetitive ones, copies, near copies, NULLs and repeated rows; labels for some."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 400))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if i % 7 == 3:
            words = words[:12] * 6
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(i + 1000, rows[1][1], "en", "s", 1) for i in range(100)]  # a third or so are copies of one text
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, rows[2][1], "en", "s", 1), rows[4], rows[4]]
    folder = tmp_path_factory.mktemp("sf")
    llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300) if i % 2 or i % 5 == 0] + [(8, None, None)]
    llm.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, str(folder)


def test_stages_agree_with_brute_force(llm, corpus):
    rows, folder = corpus
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, folder)
        outs.append((name, docs.collect(), docs.columns))
    assert [n for n, _, _ in outs] == ["toxicity", "quality_rules", "simhash", "packing"]
    assert all(c == list(corpus_pipeline.COLUMNS) for _, _, c in outs[:3])
    text = lambda part: sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in part))
    clean = [r for r in rows if not (r[0] is not None and r[0] < 300 and r[0] % 5 == 0 and any(w in (r[1] or "").split() for w in BAD))]
    assert text(outs[0][1]) == text(clean)
    good = [r for r in clean if quality_brute(r[1])[6]]
    assert len(good) < len(clean) and text(outs[1][1]) == text(good)
    prints = {r[1]: brute_print(r[1]) for r in good}
    root = groups(set(prints.values()))
    least = {}
    for r in good:
        if r[0] is not None:
            k = root[prints[r[1]]]
            least[k] = min(least.get(k, r[0]), r[0])
    firsts = sorted({r for r in good if r[0] is not None and least[root[prints[r[1]]]] == r[0]})
    kept = firsts + [r for r in good if r[0] is None]
    assert len(firsts) < len(good) - 90 and text(outs[2][1]) == text(kept)
    packed(kept, outs[3][1])


def packed(kept, pieces):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == {r[0] for r in kept}
    for doc, content, *_ in kept:
        ids = np.array([*tokenizer.encode(content or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[doc], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_cells_of_the_corpus_are_not_broadcast(llm, corpus, monkeypatch):
    _, folder = corpus
    plans = {}

    def planned(df, label="stage"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", planned)
    corpus_pipeline.drop_near_duplicates(llm, llm.read.parquet(f"{folder}/documents.parquet"), folder)
    assert "SortMergeJoin" in plans["cells"] and "BroadcastHashJoin" not in plans["cells"]


def test_run_writes_every_stage(llm, corpus):
    _, folder = corpus
    out = corpus_pipeline.run(llm, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_empty_corpus(llm, corpus, tmp_path):
    _, folder = corpus
    for name in ("documents", "labels"):
        llm.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_extra_columns_do_not_disturb(llm, corpus):
    _, folder = corpus
    docs = llm.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS kept", "2L AS component_id", "3 AS predicted")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, folder)
    assert docs.count() > 0


def test_toxicity_bound_is_documented():
    assert toxicity.MAX_ROWS == 4000
