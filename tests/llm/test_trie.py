import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rowmill.llm import queries, trie
from rowmill.plans.registry import Tables

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(x) == len(node) + 1 for x in below),
            sum(x not in inner for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = queries.prefix_trie(Tables(spark, str(tmp_path)))
    return sorted([tuple(r) for r in out.select(*COLUMNS).collect()], key=str)


def talk(seed, convs, texts, turns):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, turns)):
            rows.append((c, rng.choice((t, t, None)), rng.choice(("user", "assistant", None)), rng.choice(texts)))
    return rows


@pytest.fixture
def contracted(monkeypatch):
    """Short lists and blocks, so that small tables go through rounds and carried blocks."""
    monkeypatch.setattr(trie, "BLOCK", 2)
    real = trie.prefix_trie
    monkeypatch.setattr(trie, "prefix_trie", lambda rows, convs: real(rows, convs, walk=40))


def test_against_sequences(llm, tmp_path, contracted):
    rows = talk(1, [*range(95, 125), 200, 203, 260, -7, -100, -130, 5], ["a", "bb", "", None, "日本"], 9)
    rows += [(None, 1, "user", "lost"), *rows[:10]]
    assert run(llm, tmp_path, rows) == brute(rows)


def test_defaults_and_hot_groups(llm, tmp_path):
    """One conversation with a third of all rows, and one text that most conversations consist of."""
    rows = [(300, i, "user", f"t{i % 7}") for i in range(300)] + [(c, 0, "user", "same") for c in range(400, 460)] + talk(2, range(300, 320), ["x", "y"], 6)
    assert run(llm, tmp_path, rows) == brute(rows)


def test_long_text_and_no_turns_left(llm, tmp_path):
    rows = [(c, 1, None, "long " * 20_000) for c in range(1, 8)]
    assert run(llm, tmp_path, rows) == brute(rows)


def test_no_rows(llm, tmp_path):
    assert run(llm, tmp_path, []) == [] == run(llm, tmp_path, [(None, 1, "user", "x")])


def test_list_ranking(llm):
    """A shuffled list of 500 arcs in rounds down to three."""
    n = 500
    names = list(range(n))
    random.Random(9).shuffle(names)
    arcs = [(names[i], -names[i], i % 2, *((names[i + 1], -names[i + 1], (i + 1) % 2) if i + 1 < n else (None, None, None)), i == 0, 1, i % 3, i) for i in range(n)]
    df = llm.createDataFrame(arcs, "a long, b long, x int, sa long, sb long, sx int, head boolean, steps long, leaves long, saved long")
    got = {r.a: (r.steps, r.leaves, r.saved) for r in trie.rank_list(df, walk=3).collect()}
    assert got == {names[i]: (i, sum(j % 3 for j in range(i)), sum(range(i))) for i in range(n)}
    assert trie.rank_list(df.limit(0)).collect() == []


def test_digest_over_batches(llm):
    ends = llm.range(50_000).select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.col("id").alias("conv_id"))
    ends = ends.union(llm.createDataFrame([(1, 3, 9), (0, 0, -4)], "a long, b long, conv_id long"))
    got = {(r.a, r.b): r.ends_sha256 for r in trie.end_digests(ends).collect()}
    assert got[(1, 2)] == hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest()
    assert got[(1, 3)] == hashlib.sha256(b"9").hexdigest() and got[(0, 0)] == hashlib.sha256(b"-4").hexdigest()
