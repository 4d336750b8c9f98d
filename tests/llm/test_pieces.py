import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.llm import pieces
from rowmill.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def best_score(model, text):
    """Plain Viterbi over the whole text."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for n in range(1, min(model.longest, end) + 1):
            s = model.score.get(text[end - n : end], model.floor if n == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[end - n] + s)
    return best[-1]


def score_of(model, ids):
    """Score of a segmentation; characters spelt as bytes count once."""
    total, spelt = 0.0, bytearray()
    for i in ids:
        if i in model.byte_of:
            spelt.append(model.byte_of[i])
        else:
            total += model.score[model.names[i]]
    return total + model.floor * len(spelt.decode())


def test_round_trip_of_odd_texts(model, odd_texts):
    for t in odd_texts:
        assert model.decode(model.encode(t).tolist()) == (t or "")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_comes_back(model, text):
    assert model.decode(model.encode(text).tolist()) == text


def test_as_good_as_the_whole_search(model, vocabulary):
    rng = random.Random(2)
    for n in (1, 3, 20, 200):
        text = " ".join(rng.choice(vocabulary + ["the", "日本", "\n", "international"]) for _ in range(n))
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        streamed = [i for run in model.stream(marked) for i in run]
        assert abs(score_of(model, streamed) - best_score(model, marked)) < 1e-6
        assert model.encode(text).tolist() == streamed


def test_window_is_bounded(model):
    """A text without any space is committed in runs as well."""
    text = "".join(random.Random(1).choice("etaoinsh") for _ in range(5000))
    runs = list(model.stream(text))
    assert len(runs) > 20 and max(map(len, runs)) < 1000


def test_cache_limit_changes_nothing(model, odd_texts, monkeypatch):
    want = [model.encode(t).tolist() for t in odd_texts]
    monkeypatch.setattr(pieces, "_CACHE", 3)
    assert [model.encode(t).tolist() for t in odd_texts] == want


def plain_text(model, ids):
    """Each run of byte pieces spelt on its own, one leading space off."""
    out, run = [], bytearray()
    for i in [*ids, None]:
        if i in model.byte_of:
            run.append(model.byte_of[i])
            continue
        out.append(run.decode("utf-8", "replace"))
        run.clear()
        if i is not None:
            out.append(model.plain[i])
    return "".join(out).removeprefix(" ")


@pytest.mark.parametrize("lanes", [3, 8192])
def test_many_texts_as_one_by_one(odd_texts, vocabulary, monkeypatch, lanes):
    monkeypatch.setattr(pieces, "_LANES", lanes)
    rng = random.Random(lanes)
    parts = [*vocabulary[:40], " ", "  ", "▁", "日本", "\n", "!)", ",", "x" * 70, "\x00", "\u0130", "😀", "\ud7ff"]
    texts = odd_texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    for some in (texts, [t for t in texts if t and "▁" not in t], [None, ""], []):
        for kind in (pa.string(), pa.large_string()):
            alone, together = pieces.Pieces(PATH), pieces.Pieces(PATH)
            lists = together.encode_all(pa.array(["a  b", *some], kind).slice(1))
            assert lists.to_pylist() == [alone.encode(t).tolist() for t in some]
            assert together.decode_all(lists) == [t or "" for t in some]


def test_many_lists_of_any_ids(model):
    """Cut characters, special ids between bytes, NULLs."""
    rng = random.Random(4)
    some = [lambda: rng.randrange(len(model.names)), lambda: rng.choice(model.bytes[128:]), lambda: rng.randrange(3), lambda: None]
    rows = [[rng.choice(some)() for _ in range(rng.randrange(12))] for _ in range(3000)] + [None, [], [None]]
    want = [plain_text(model, [i for i in r or () if i is not None]) for r in rows]
    assert model.decode_all(pa.array(rows, pa.list_(pa.int32()))) == want
    with pytest.raises(IndexError):
        model.decode_all(pa.array([[len(model.names)]]))


def test_ties_and_fractions_as_the_plain_search(vocabulary):
    """Scores with many ties, and scores whose sums are rounded."""
    for scores in (lambda rng: -float(rng.randrange(1, 4)), lambda rng: -rng.random() * 9):
        model, rng = pieces.Pieces(PATH), random.Random(6)
        model.score = {n: scores(rng) for n in model.score}
        model.grade.update(model.score)
        model._number()
        words = list(dict.fromkeys(pieces.SPACE + w + x for w in vocabulary for x in ("", "international", "\u4e00", "...")))
        assert model._search(words) == {w: pieces._packed(model._short(w)) for w in words}


def test_time_of_many_texts(vocabulary):
    """Many texts take less than half the time of one text after another, in new words and in known ones."""
    rng, clock = random.Random(7), time.process_time
    words = list(dict.fromkeys(a + b for a in vocabulary for b in rng.sample(vocabulary, 60)))
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(400)]
    alone, together = pieces.Pieces(PATH), pieces.Pieces(PATH)
    many = pa.array(texts)
    a = clock()
    lists = together.encode_all(many)
    b = clock()
    for t in texts:
        alone.encode(t)
    c = clock()
    assert 2 * (b - a) < c - b
    a = clock()
    together.decode_all(lists)
    b = clock()
    for ids in lists:
        alone.decode([i for i in ids.as_py() or () if i is not None])
    assert 2 * (b - a) < clock() - b


def test_slices_hold_every_row():
    rows = pa.record_batch({"n": pa.array([5, None, 0, 100, 1, 1, 9, 0])})
    for most in (1, 7, 10, 1000):
        assert [x for s in pieces._slices(rows, rows["n"], most) for x in s["n"].to_pylist()] == rows["n"].to_pylist()


def test_tables(llm, odd_texts):
    rows = [(i, t, "old") for i, t in enumerate(odd_texts)] + [(3, odd_texts[3], "old")]
    df = llm.createDataFrame(rows, "doc_id int, text string, ids string")
    coded = pieces.encode_texts(df, PATH)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = pieces.decode_ids(coded, PATH).collect()
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") for r in back)
    assert pieces.encode_texts(df.limit(0), PATH).count() == 0
    odd = llm.createDataFrame([(None,), ([],), ([None, 0, 1],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode_ids(odd, PATH).collect()] == ["", "", ""]
