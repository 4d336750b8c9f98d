import random
import re

import numpy as np
import xxhash

from rowmill.llm import simhash
from rowmill.llm.components import components
from rowmill.session import materialize

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest member of each value's component, by comparing all pairs."""
    values = sorted(prints)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints_of_odd_texts(odd_texts):
    short = [t for t in odd_texts if t is None or len(t) < 5000]
    assert [simhash.fingerprint(t) for t in short] == [brute_print(t) for t in short]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_long_text_in_blocks(monkeypatch, odd_texts):
    text = odd_texts[14][:20_000]
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_near_duplicates_agree_with_all_pairs(llm, vocabulary, odd_texts):
    rng = random.Random(4)
    texts = [*odd_texts[:14], *(" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(20))]
    for t in texts[-5:]:
        words = t.split()
        for k in range(8):
            changed = words[:]
            changed[k * 7] = "changed"
            texts.append(" ".join(changed))
    rows = [(i, t, "zz") for i, t in enumerate(texts)] + [(3, texts[3], "zz"), (None, texts[20], "zz")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, _fp string")
    got = simhash.near_duplicates(df).collect()
    prints = [(i, brute_print(t)) for i, t, _ in rows]
    root = groups({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((-1 if i is None else i, f"{p:016x}", least[root[p]]) for i, p in prints)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_document_tables_are_not_broadcast(llm, monkeypatch):
    plans = {}

    def planned(df, label="stage"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", planned)
    out = simhash.near_duplicates(llm.createDataFrame([(1, "a b"), (2, "a b"), (None, None)], "doc_id bigint, text string"))
    # Files of three rows are far below the limit of a broadcast.
    assert "SortMergeJoin" in plans["cells"] and "BroadcastHashJoin" not in plans["cells"]
    last = next(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert "SortMergeJoin" in last
    assert sorted((r.doc_id or 0, r.component_id) for r in out.collect()) == [(0, None), (1, 1), (2, 1)]


def test_links_connect_all_near_fingerprints(llm):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    # A third of all values crowd around one; the rest come in small groups and alone.
    values = {centre}
    while len(values) < 150:
        values.add(rng.choice(sorted(values)) ^ 1 << rng.randrange(64))
    for _ in range(100):
        a = rng.getrandbits(64)
        values |= {a, a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), a ^ (1 << 63), rng.getrandbits(64)}
    df = llm.createDataFrame([(signed(v),) for v in values], "_fp bigint")
    want = groups(values)
    for crowd in (0, simhash.CROWD, 10_000):
        pairs = simhash.links(df, crowd)
        rows = pairs.collect()
        assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in rows)
        found = {r.node: r.root for r in components(pairs).collect()}
        sets = {}
        for v in values:
            sets.setdefault(found.get(signed(v), signed(v)), set()).add(v)
        mine = {frozenset(s) for s in sets.values()}
        other = {}
        for v, r in want.items():
            other.setdefault(r, set()).add(v)
        assert mine == {frozenset(s) for s in other.values()}


def test_manhattan_distance_is_a_lower_bound(llm):
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 200)
    df = llm.createDataFrame([(int(x),) for x in a], "_fp bigint")
    points = [r[0] for r in df.select(simhash.grid_point(df["_fp"])).collect()]
    for x, p in zip(a, points):
        bits = int(x) & (1 << 64) - 1
        assert [(p >> 4 * i & 15) - 1 for i in range(16)] == [bin(bits >> 4 * i & 15).count("1") for i in range(16)]


def test_empty_table(llm):
    assert simhash.near_duplicates(llm.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_a_long_path_a_star_and_loops(llm):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1200)] + [(5, 5), (1, 2), (2, 1)]
    got = {r.node: r.root for r in components(llm.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(1000, 1200)}, 1: 1, 2: 1}
