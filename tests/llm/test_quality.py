import random
import re
from collections import Counter

from rowmill.llm import quality, words

import numpy as np


def brute(text, limits=quality.NGRAM_LIMITS, line_limit=quality.LINE_LIMIT):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    total = sum(map(len, found))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        inside = re.findall(r"[^\x20\x09-\x0D]+", line)
        if inside:
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, inside))
            seen.add(line)

    def covered(n, first):
        grams = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]
        count, earlier = Counter(grams), set()
        hits = [i for i, g in enumerate(grams) if (count[g] > 1 if first else g in earlier or earlier.add(g))]
        return {j for i in hits for j in range(i, i + n)}

    repeat = len(covered(5, True))
    failed = len(found) < 10 or 100 * repeat > 20 * len(found)
    fine = all(not total or sum(len(found[j]) for j in covered(n, False)) / total <= limit for n, limit in limits.items())
    kept = not failed and fine and (dup_chars / total if total else 0) <= line_limit
    return len(found), total, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, kept


def texts(vocabulary):
    rng = random.Random(8)
    out = []
    for share in (0, 0.1, 0.12, 0.15, 0.2, 0.5):
        for size in (12, 60, 300):
            part = [rng.choice(vocabulary) for _ in range(max(7, int(size * share / 2)))]
            body = [rng.choice(vocabulary) for _ in range(size)]
            out.append(" ".join(body[: size // 3] + part + body[size // 3 :] + (part if share else [])))
    passage = [rng.choice(vocabulary) for _ in range(10)]
    body = [[rng.choice(vocabulary) for _ in range(43)] for _ in range(4)]
    out.append(" ".join(w for part in body for w in passage + part))  # four times: within the base, not within the limits
    lines = [" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(20)]
    return [*out, "\n".join(lines + lines[:3]), "\n".join(lines + lines[:12]), "\n".join(lines), "\n".join(["a b c"] * 3 + lines)]


def test_agrees_with_counting(odd_texts, vocabulary):
    for t in [*odd_texts, *texts(vocabulary)]:
        got = quality.measure(t)
        assert (*got[:6], got[8]) == brute(t)


def test_both_verdicts_occur_beside_the_base(vocabulary):
    rows = [brute(t) for t in texts(vocabulary)]
    assert {(r[5], r[6]) for r in rows} == {(True, False), (False, False), (False, True)}


def test_table(llm, odd_texts):
    rows = [(i, t, "old") for i, t in enumerate(odd_texts)] + [(None, odd_texts[6], None)] * 2
    df = llm.createDataFrame(rows, "doc_id int, text string, kept string")
    out = quality.quality_rules(df)
    assert out.columns == ["doc_id", "text", *quality.COLUMNS.fieldNames()]
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.kept) for r in out.collect()), key=str)
    assert got == sorted(((i is None, i, brute(t)[0], brute(t)[6]) for i, t, _ in rows), key=str)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_hashes_of_equal_words_only(vocabulary):
    data = np.frombuffer(" ".join([*vocabulary, "Aa", "aA", "aa", "AA", "ä"]).encode(), np.uint8)
    start, end = words.bounds(data)
    raw = [data[i:j].tobytes() for i, j in zip(start, end)]
    for fold in (False, True):
        h = words.hashes(data, start, end, fold)
        same = {}
        for r, x in zip(raw, h.tolist()):
            assert same.setdefault(x, r.lower() if fold else r) == (r.lower() if fold else r)
        assert len(same) == len({r.lower() if fold else r for r in raw})
