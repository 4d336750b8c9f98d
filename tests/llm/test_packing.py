import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.llm import packing
from rowmill.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return packing.Words(PATH)


def check(rows, documents, window):
    """rows: (document, start, length, sequence, offset). Returns the share of padding."""
    by, windows = defaultdict(list), defaultdict(list)
    for d, start, length, sequence, offset in rows:
        by[d].append((start, length))
        windows[sequence].append((offset, length))
    assert set(by) == set(documents)
    for d, size in documents.items():
        at = 0
        for start, length in sorted(by[d]):
            assert start == at and length > 0
            at += length
        assert at == size
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, sum(documents.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=120), st.sampled_from([8, 64]))
def test_every_id_once_and_little_padding(sizes, window):
    ids = [(i, np.full(n, i, "<u4").tobytes()) for i, n in enumerate(sizes)]
    out = list(packing.pack(iter(ids), 5, window, slack=0))
    rows = [(d, s, len(x) // 4, q, o) for d, s, x, _, q, o in out]
    assert check(rows, {i: n for i, n in enumerate(sizes)}, window) == 0
    assert all(set(np.frombuffer(x, "<u4").tolist()) == {d} and total == sizes[d] for d, _, x, total, _, _ in out)


def test_place_minimises_the_sum_of_squares():
    rng = random.Random(1)
    levels = packing.Levels(32)
    for _ in range(400):
        size = rng.randrange(1, 32)

        def after(level, size=size):
            n = levels.count.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n[:32] ** 2).sum())

        allowed = [x for x in range(0, 33 - size) if x == 0 or levels.count[x]]
        level = levels.place(size)
        assert level in allowed and after(level) == min(map(after, allowed))
        assert level == max(x for x in allowed if after(x) == after(level))
        levels.put(level, size, 0)


def test_ids_are_those_of_the_tokenizer(tokenizer, odd_texts, monkeypatch):
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd_texts]
    assert packing.Words(PATH).encode(odd_texts) == want
    monkeypatch.setattr(packing, "_CACHE", 2)
    words = packing.Words(PATH)
    assert [words.encode([t])[0] for t in odd_texts] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_of_any_text(tokenizer, words, text):
    assert words.encode([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_table(llm, tokenizer, odd_texts):
    rows = [(i, t, 9) for i, t in enumerate(odd_texts)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, offset int").repartition(3)
    out = packing.pack_documents(df, PATH).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(odd_texts)}
    assert check([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in out], {i: len(x) for i, x in ids.items()}, 2048) < 0.01
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in out)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    twice = packing.pack_documents(llm.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string"), PATH).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
