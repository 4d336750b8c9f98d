import itertools
import math

import numpy as np
import pytest

from rowmill.llm import lattice

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, cosine=0.9):
    """Links between ids, by id."""
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {i: set() for i, _ in rows if i is not None}
    for a, b in itertools.combinations(sorted(ok), 2):
        x, y = ok[a], ok[b]
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
            out[a].add(b)
            out[b].add(a)
    return out


def reach(links, a):
    seen, todo = {a}, [a]
    while todo:
        for b in links[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return min(seen)


def agree(df, rows, recall=1.0):
    links = brute(rows)
    got = {r.vec_id: r for r in df.collect() if r.vec_id is not None}
    assert set(got) == set(links)
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert sum(r.n_links for r in got.values()) >= recall * sum(map(len, links.values()))
    if recall == 1.0:
        assert all(got[i].component_id == reach(links, i) and got[i].kept == (got[i].component_id == i) for i in links)


def test_odd_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]),
            (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e38, 1e38]), (13, [1e-38, 1e-38]), (14, [1.0, 0.5])]
    agree(lattice.near_vectors(llm.createDataFrame(rows, SCHEMA)), rows)


def test_null_keys_repeats_extra_columns(llm):
    rows = [(1, [1.0, 2.0], 5), (1, [1.0, 2.0], 6), (None, [1.0, 2.0], 7), (2, [1.0, 2.0], 8)]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect())
    assert got == [(-1, 0, None, False), (1, 1, 1, True), (2, 1, 1, False)]


def test_empty_table(llm):
    assert lattice.near_vectors(llm.createDataFrame([], SCHEMA)).count() == 0


def test_third_of_all_rows_in_one_group(llm):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.05 * rng.normal(size=16) if i % 3 == 0 else rng.normal(size=16)).astype(np.float32).tolist()) for i in range(240)]
    agree(lattice.near_vectors(llm.createDataFrame(rows, SCHEMA)), rows)


def test_recall_at_the_border(llm):
    """Pairs whose cosines lie between 0.9 and 0.93, the hardest ones."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        g = rng.normal(size=64)
        g -= (g @ a) * a
        g /= np.linalg.norm(g)
        c = rng.uniform(0.9005, 0.93)
        rows += [(2 * i, a.astype(np.float32).tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * g).astype(np.float32).tolist())]
    agree(lattice.near_vectors(llm.createDataFrame(rows, SCHEMA)), rows, recall=0.9)


def border_pairs(n, low, high):
    rng = np.random.default_rng(4)
    a, g = rng.normal(size=(2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g -= (g * a).sum(axis=1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    c = rng.uniform(low, high, size=(n, 1))
    return a, c * a + np.sqrt(1 - c * c) * g


def test_registered_setting_meets_the_border_and_few_others():
    """Of pairs with a cosine of 0.900 to 0.905 at least 0.9 share a cell; of random pairs at most 0.01 %."""
    a, b = (lattice.cells(x)[0] for x in border_pairs(2000, 0.9, 0.905))
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.9
    chance = sum((np.isin(a[i + 1 :, :, 0], a[i]).any(axis=1) | (a[i + 1 :] == a[i, :, :1]).any(axis=(1, 2))).sum() for i in range(500))
    assert chance / (500 * 1749.5) <= 1e-4


def test_decode_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    best = lattice.decode(x)
    assert (np.rint(2 * best) == 2 * best).all() and (best.sum(axis=1) % 2 == 0).all()
    near = ((x[:, None, :] - (best[:, None, :] + lattice.STEPS)) ** 2).sum(axis=2)
    assert (((x - best) ** 2).sum(axis=1)[:, None] <= near + 1e-9).all()
    assert len(lattice.STEPS) == 240 and np.allclose((lattice.STEPS**2).sum(axis=1), 2)


@pytest.mark.parametrize("blocks", [1, 2])
def test_more_blocks(llm, blocks):
    rows = [(i, [float(i // 2), 1.0, 0.0, float(i % 2) / 100]) for i in range(10)]
    links = brute(rows)
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(llm.createDataFrame(rows, SCHEMA), blocks=blocks, scale=0.4, tables=10).collect()}
    assert all(got[i] <= len(links[i]) for i in got) and sum(got.values()) >= 0.9 * sum(map(len, links.values()))
