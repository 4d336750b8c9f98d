"""Sum-of-squares packing of tokenised documents into windows, inside each input partition.

A document's last piece goes to the fill level that minimises the sum over levels of squared counts of partly filled
windows. Partitions pack on their own: no shuffle, no shared state, and each one has the few open windows of its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 2048
END_ID = 1
# Windows still open at the end of a partition with more than this many free places are merged and cut again.
SLACK = 20
_CACHE = 1_000_000  # distinct words whose ids a Python worker keeps; beyond that it starts afresh
_TEXTS = 2_000  # texts encoded together
_KEEP = 24  # characters; longer words are not worth keeping
# ASCII punctuation: a run of it behind a word is one unit of the tokenizer.
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_WORKER: dict = {}


def _listed(array: pa.Array) -> list:
    """Values as a list, by way of numpy, which makes them many at a time."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Ids of texts as little-endian bytes, word by word.

    The tokenizer never joins characters over a space or line break, so a text's ids are those of its words in order.
    Words of Latin letters, in any case and with punctuation behind, share the ids of the lower-case word;
    those are looked up many at a time by the same model without its normaliser, which would not change them. All other
    words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        # Ids that end a word.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.tails: dict[str, bytes] = {"": b""}
        # Of lower-case words of Latin letters, and of all other words.
        self.ids: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of any words, by the whole tokenizer."""
        out = {}
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            owner = np.array(found.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
            raw = np.array(found.ids, "<u4").tobytes()
            out.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(part, cuts, cuts[1:]))
        return out

    def _learn_plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of Latin letters: each ends in the one id that ends a word."""
        out = {}
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            raw = ids.tobytes()
            out.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(part, cuts, cuts[1:]))
        return out

    def _distinct(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words. Case, punctuation behind and kind are told for all words at once; Python sees each
        lower-case word once, and the few others."""
        ids = self.ids
        bodies = pc.utf8_rtrim(words, characters=_MARKS)
        lows = pc.utf8_lower(bodies)
        shared = pc.utf8_is_alpha(bodies).to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(shared & ~pc.string_is_ascii(bodies).to_numpy(zero_copy_only=False))
        at = pa.array(wide)
        shared[wide] = [max(w) < "\u0250" and low.isalpha() for w, low in zip(_listed(bodies.take(at)), _listed(lows.take(at)))]
        coded = lows.filter(pa.array(shared)).dictionary_encode()
        low_words = _listed(coded.dictionary)
        ids.update(self._learn_plain([w for w in low_words if w not in ids]))
        low_ids = [ids[w] for w in low_words]
        out: list[bytes] = [b""] * len(words)
        places = np.flatnonzero(shared)
        for i, c in zip(places.tolist(), _listed(coded.indices)):
            out[i] = low_ids[c]
        size = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False)
        body_size = size(bodies)
        marked = np.flatnonzero(shared & (size(words) > body_size))
        if len(marked):
            tails = [w[n:] for w, n in zip(_listed(words.take(pa.array(marked))), body_size[marked].tolist())]
            new = [t for t in dict.fromkeys(tails) if t not in self.tails]
            if len(self.tails) + len(new) > _CACHE:
                self.tails, new = {"": b""}, list(dict.fromkeys(tails))
            self.tails.update(self._learn(new))
            for i, t in zip(marked.tolist(), tails):
                out[i] += self.tails[t]
        rest = np.flatnonzero(~shared)
        others = _listed(words.take(pa.array(rest)))
        known = {w: x for w in others if (x := self.others.get(w)) is not None}
        known.update(self._learn([w for w in others if w not in known]))
        for i, w in zip(rest.tolist(), others):
            out[i] = known[w]
        if len(self.others) < _CACHE:
            self.others.update((w, x) for w, x in known.items() if len(w) <= _KEEP)
        else:
            self.others = {}
        if len(ids) > _CACHE:
            ids.clear()
        for w in low_words:
            if len(w) > _KEEP:
                ids.pop(w, None)
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; NULL and empty texts have none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        ids = self._distinct(coded.dictionary)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(ids), "<u4")
        codes = coded.indices.to_numpy()
        sizes = size[codes]
        behind = np.concatenate([[0], np.cumsum(sizes)])
        # Place in the pool of every id of every word, in order.
        take = np.arange(behind[-1]) + np.repeat(first[codes] - behind[:-1], sizes)
        flat = pool[take]
        cuts = behind[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]


class Levels:
    """Open windows by fill level; ``place`` returns the level that a piece goes on top of."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)

    def place(self, size: int) -> int:
        """The level that minimises the sum of squared counts; ties go to the fullest. Level 0 is a new window."""
        n, room = self.count, self.window - size
        after = 2 * n[size : self.window + 1] + 1  # one more window at level + size
        after[room] = 0  # a full window is no longer open
        change = after
        change[1:] -= 2 * n[1 : room + 1] - 1  # one window less at the level itself
        change[1:][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def put(self, level: int, size: int, sequence: int) -> int:
        """Move a window up by ``size`` and return it; ``sequence`` is used when a new one is opened."""
        if level:
            self.count[level] -= 1
            sequence = self.open[level].pop()
        if level + size < self.window:
            self.count[level + size] += 1
            self.open[level + size].append(sequence)
        return sequence


def power_parts(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack(documents: Iterator[tuple[int, bytes]], first_sequence: int, window: int = WINDOW, slack: int = SLACK) -> Iterator[tuple]:
    """Pieces ``(document, start, ids, doc_tokens, sequence, offset)`` of ``(document, ids)``.

    Documents longer than a window are cut into full windows and a rest; only rests are placed by level. Windows that
    stay open are kept in memory until the end; those with more than ``slack`` free places are then chained and cut into
    full windows, and the remainder into windows whose lengths are powers of two, which need no padding.
    """
    levels, held, sequence = Levels(window), {}, first_sequence
    for document, ids in documents:
        total = len(ids) // 4
        full = total - total % window
        for at in range(0, full, window):
            yield document, at, ids[4 * at : 4 * (at + window)], total, sequence, 0
            sequence += 1
        size = total - full
        if not size:
            continue
        level = levels.place(size)
        taken = levels.put(level, size, sequence)
        sequence += taken == sequence
        pieces = held.setdefault(taken, [])
        pieces.append((document, full, ids[4 * full :], total, taken, level))
        if level + size == window:
            yield from held.pop(taken)
    chained = []
    for pieces in held.values():
        last = pieces[-1]
        if window - last[5] - len(last[2]) // 4 <= slack:
            yield from pieces
        else:
            chained += pieces
    left = sum(len(p[2]) // 4 for p in chained)
    targets = [window] * (left // window) + power_parts(left % window)
    room, offset, target = 0, 0, iter(targets)
    sequence -= 1
    for document, start, ids, total, _, _ in chained:
        while ids:
            if not room:
                room, offset = next(target), 0
                sequence += 1
            take = min(room, len(ids) // 4)
            yield document, start, ids[: 4 * take], total, sequence, offset
            start, ids, room, offset = start + take, ids[4 * take :], room - take, offset + take


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: ``key`` and the columns of ``PIECES``.

    Ids are the tokenizer's, then ``END_ID``; a NULL or empty text is that one id. Repeated rows are packed as often as
    they come. Sequence numbers hold the partition above 40 bits. The input's partitions should be at least tens of MB,
    as scans make them; each is packed in one task, in the order of its rows.
    """
    schema = T.StructType([df.schema[key], *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORKER.get(tokenizer) or _WORKER.setdefault(tokenizer, Words(tokenizer))
        end = END_ID.to_bytes(4, "little")

        def documents():
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                for at in range(0, len(batch), _TEXTS):
                    ids = words.encode(texts[at : at + _TEXTS])
                    yield from zip(keys[at : at + _TEXTS].to_pylist(), (x + end for x in ids))

        part = TaskContext.get().partitionId()
        rows = []
        for document, start, ids, total, sequence, offset in pack(documents(), part << 40, window):
            rows.append((document, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
            if len(rows) == 20_000:
                yield _batch(rows, key, kind)
                rows = []
        if rows:
            yield _batch(rows, key, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[key].dataType)
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def _batch(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]]
    return pa.RecordBatch.from_arrays(arrays, names=[key, *PIECES.fieldNames()])
