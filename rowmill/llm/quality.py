"""Quality rules by repetition coverage: rolling hashes over words, characters inside repeats.

Every text is read whole, in an Arrow batch of its own partition; there is no shuffle. A text needs
memory of a few times its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowmill.llm import words as W

# The largest share of a text's word characters that may lie in n-grams seen earlier in it, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# The same for characters of lines that repeat an earlier line.
LINE_LIMIT = 0.20
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
COLUMNS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("ngram_coverage", T.DoubleType()), T.StructField("line_coverage", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def measure(text: str | None, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    """The values of ``COLUMNS`` for one text; NULL and empty texts have no words.

    ``ngram_coverage`` is the largest excess over its limit of any n-gram length: above 0 the text fails. The first
    occurrence of a repeated passage is no repetition here; ``n_repeat_words`` counts it.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    start, end = W.bounds(data)
    n = len(start)
    # Code points before each byte: continuation bytes do not count.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    total = int(chars.sum())
    symbols = int(_SYMBOL[data].sum())
    seen: set[str] = set()
    dup_lines, dup_chars = 0, 0
    if n and b"\n" in raw:
        line_start = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        line_end = np.concatenate([line_start[1:] - 1, [len(data)]])
        before = np.concatenate([[0], np.cumsum(chars)])
        first = np.searchsorted(start, line_start)
        last = np.searchsorted(start, line_end)
        for a, b, i, j in zip(line_start.tolist(), line_end.tolist(), first.tolist(), last.tolist()):
            if j > i:
                line = raw[a:b]
                if line in seen:
                    dup_lines += 1
                    dup_chars += int(before[j] - before[i])
                else:
                    seen.add(line)
    words = W.hashes(data, start, end)
    repeat_words, excess = 0, -1.0
    for size in sorted({5, *limits}):
        grams = W.ngrams(words, size)
        again = W.seen_before(grams)
        if size == 5:
            repeat_words = int(W.covered(W.repeated(grams), size, n).sum())
        if size in limits and total:
            excess = max(excess, float(chars[W.covered(again, size, n)].sum()) / total - limits[size])
        if not again.any():  # no longer n-gram can repeat either
            if total:
                excess = max([excess, *(-v for k, v in limits.items() if k > size)])
            break
    lines = dup_chars / total if total else 0.0
    failed = n < 10 or 100 * repeat_words > 20 * n
    return n, total, symbols, dup_lines, repeat_words, failed, excess, lines, not failed and excess <= 0 and lines <= line_limit


def quality_rules(df: DataFrame, text: str = "text", limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """All columns of ``df`` and, after them, those of ``COLUMNS`` (columns of the same names are replaced).

    Every row is judged by its own text, as often as it comes; NULL and empty texts fail the base. No rows, no result.
    """
    names = [c for c in df.columns if c not in COLUMNS.fieldNames()]
    source = df.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*source.schema.fields, *COLUMNS.fields])
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), limits, line_limit) for t in batch.column(names.index(text))]
            values = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*names, *COLUMNS.fieldNames()])

    return source.mapInArrow(run, schema)
