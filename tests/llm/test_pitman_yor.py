import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowmill.llm import pitman_yor as hpy

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\0end"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def score(llm, rows, parts, schema="doc_id bigint, text string"):
    df = llm.createDataFrame(rows, schema)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return hpy.score_texts(df, out, parts=parts)


def same_counts(rows, got):
    count = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    total, kinds = sum(count.values()), len(count)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        want.append((str(i), held(i), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("parts", [1, 4])
def test_counts_and_base(llm, odd_texts, parts):
    rows = [(i, t, "z") for i, t in enumerate(odd_texts)] + [(3, odd_texts[3], "z"), (None, "a null key", "z")]
    got = score(llm, rows, parts, "doc_id bigint, text string, score string").collect()
    same_counts(rows, got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty_table_and_no_training_rows(llm):
    assert score(llm, [], 3).count() == 0
    out = [i for i in range(60) if held(i)]
    got = score(llm, [(i, "a b") for i in out], 3).collect()
    assert len(got) == len(out) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


def answers_to(texts, train, shards):
    """What the shards answer one chunk of texts, without Spark."""
    parts = list(hpy.Chunk(texts, shards).parts(0, np.array(train)))
    tables = [pa.Table.from_pylist([dict(zip(hpy._PART.names, p))], hpy._PART) for p in parts]
    out, risen = [], []
    for t in tables:
        shard = hpy.Shard(t)
        shard.sample()
        risen += [dict(zip(("shard", "words", "tables"), r)) for r in shard.to_words(shards)]
        out += list(shard.to_chunks())
    for t in tables:
        shard = hpy.Shard(t)
        mine = [r for r in risen if r["shard"] == shard.number]
        out += list(shard.parent(pa.Table.from_pylist(mine, hpy._arrow(hpy._TABLE_SQL)), 1))
    return [dict(zip(hpy._arrow(hpy._ANSWER_SQL).names, r)) for r in out]


def test_predictive_probabilities_add_up():
    """After each context the known words, the end and one unknown word have probability one in all."""
    rng = random.Random(1)
    names = [f"w{i}" for i in range(25)]
    train = [" ".join(rng.choices(names, [1 / (k + 1) for k in range(25)], k=rng.randrange(3, 30))) for _ in range(200)]
    asked = [f"{c} {w}" for c in (*names, "unseen") for w in (*names, "never")] + names + ["unseen"]
    texts = train + asked
    answers = answers_to(texts, [True] * len(train) + [False] * len(asked), 3)
    chunk = hpy.Chunk(texts, 3)
    p, _, _, kinds = hpy.probabilities(chunk, answers)
    assert kinds == 26 and (p > 0).all()
    known = {int(hpy.tokens(w)[0]): w for w in (*names, "unseen", "never")}
    total = Counter()
    for c, f, x in zip(chunk.context, chunk.follower, p):
        if known.get(int(chunk.known[f])) != "unseen":
            total[known.get(int(chunk.known[c]))] += x
    assert all(abs(total[c] - 1) < 1e-5 for c in (*names, "unseen"))


def test_better_than_single_words_on_unseen_texts(llm):
    """Words that follow one another: the model learns the order, single-word counts cannot."""
    rng = random.Random(5)
    follow = {w: [f"w{rng.randrange(80)}" for _ in range(3)] for w in (f"w{i}" for i in range(80))}
    rows = []
    for i in range(700):
        w = f"w{rng.randrange(80)}"
        text = []
        for _ in range(40):
            text.append(w)
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text)))
    got = [r for r in score(llm, rows, 3).collect() if r.held_out]
    assert len(got) > 50 and sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_seating_agrees_with_one_customer_at_a_time():
    rng = np.random.Generator(np.random.PCG64(1))
    customers, others, base = np.array([1, 2, 7, 40, 0]), np.array([3.0, 3, 3, 3, 3]), np.array([0.2, 0.2, 0.2, 0.2, 0.2])
    fast = np.mean([hpy.seat(customers, others, base, 0.5, 1.0, rng) for _ in range(4000)], axis=0)
    slow = np.zeros(len(customers))
    for k, n in enumerate(customers):
        for _ in range(4000):
            t = 0
            for i in range(n):
                fresh = (1.0 + 0.5 * (others[k] + t)) * base[k]
                t += i == 0 or rng.random() < fresh / (fresh + i - 0.5 * t)
            slow[k] += t / 4000
    assert np.allclose(fast, slow, rtol=0.05) and fast[0] == 1 and fast[4] == 0


def test_same_result_for_any_order_of_rows(llm, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)]
    key = lambda out: sorted((r.doc_id, r.score) for r in out)
    assert key(score(llm, rows, 3).collect()) == key(score(llm, rows[::-1], 3).collect())


def test_perplexity_of_texts_and_of_all(llm, odd_texts):
    """By hand from the scores; over a corpus it comes from the sums, not from a mean of the texts' perplexities."""
    scored = score(llm, [(i, t) for i, t in enumerate(odd_texts * 3)], 3)
    rows = scored.collect()
    assert all(r.n_tokens >= 1 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in rows)
    got = {r.held_out: r for r in hpy.perplexity(scored).collect()}
    assert set(got) == {r.held_out for r in rows}
    for held, r in got.items():
        own = [x for x in rows if x.held_out == held]
        tokens = sum(x.n_tokens for x in own)
        assert r.n_tokens == tokens
        assert r.perplexity == pytest.approx(10 ** (-sum(x.score for x in own) / tokens))
        assert r.base_perplexity == pytest.approx(10 ** (-sum(x.base_score for x in own) / tokens))
    assert hpy.perplexity(scored.limit(0)).count() == 0


def test_averaged_tables_give_averaged_probabilities():
    """With the parent given, the mean of a word's probabilities over sweeps is the probability from its mean tables."""
    rng = np.random.Generator(np.random.PCG64(2))
    customers, total = np.array([5, 3, 9]), 17.0
    sweeps = [hpy.seat(customers, np.array([2.0, 2, 2]), np.array([0.3, 0.3, 0.3]), hpy.DISCOUNT, hpy.STRENGTH, rng) for _ in range(50)]
    parent = np.array([0.2, 0.5, 0.3])
    p = lambda t: (customers - hpy.DISCOUNT * t + (hpy.STRENGTH + hpy.DISCOUNT * t.sum()) * parent) / (hpy.STRENGTH + total)
    assert np.allclose(np.mean([p(t) for t in sweeps], axis=0), p(np.mean(sweeps, axis=0)))
