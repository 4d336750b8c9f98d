"""SentencePiece encoding and decoding by a streaming Viterbi search over the piece scores of a public model.

The best path to each position looks back over at most the longest piece. As soon as all paths that can still win pass
through one boundary, the ids up to it are committed and everything before it is forgotten, so memory depends on the
longest piece and not on the text. The segmentation is the one with the largest sum of scores.

Tables are read many texts at a time: distinct words are looked up once, and the words a worker has not met yet are searched
side by side, position by position, in numpy.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
_UNKNOWN = 10.0  # below the lowest score, per character that is spelt as bytes
_LOOK = 64  # characters between two looks for a common boundary
_CACHE = 500_000  # segments whose ids a Python worker keeps; beyond that it starts afresh
_KEEP = 32  # characters; longer segments are not worth keeping
_LANES = 4096  # segments searched side by side
_BYTES = 1_000_000  # of texts encoded together
_IDS = 250_000  # decoded together
_LISTS = pa.list_(pa.int32())
# ASCII punctuation.
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_WORKER: dict = {}


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Pieces:
    """Pieces and scores of a model file; encoding adds the leading space mark that the model expects."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.bytes[value] = i
                self.byte_of[i] = value
        self.ids = {n: i for i, n in enumerate(self.names) if not special[i] and i not in self.byte_of}
        self.score = {n: model.get_score(i) for n, i in self.ids.items()}
        # What each id stands for in a decoded text: a string, nothing for special ids, or the number of a byte.
        self.plain: list[str | int] = [self.byte_of.get(i, "" if special[i] else n.replace(SPACE, " ")) for i, n in enumerate(self.names)]
        self.is_byte = np.array([i in self.byte_of for i in range(size)])
        self.longest = max(map(len, self.ids))
        usable = [s for s in self.score.values() if s > -1e8]
        self.floor = min(usable) - _UNKNOWN
        # Score of each piece, None for what is only the ending of some piece.
        self.grade: dict[str, float | None] = {n[k:]: None for n in self.ids for k in range(len(n))}
        self.grade.update(self.score)
        # A mark inside a piece would join words; without such pieces the place before a word's marks is a sure boundary.
        self.joins_words = any(SPACE in n.lstrip(SPACE) for n in self.ids)
        # So is the place behind a letter before another sign, where no piece goes on from one to the other.
        self.joins_signs = any(x.isalpha() and not y.isalpha() for n in self.ids for x, y in zip(n, n[1:]))
        self.cache: dict[str, bytes] = {}
        self._number()
        # What each id stands for as bytes.
        self.raw = pa.array([bytes([x]) if isinstance(x, int) else x.encode() for x in self.plain], pa.large_binary())
        self.is_empty = np.array([x == "" for x in self.plain])

    def _number(self) -> None:
        """The endings in ``grade`` as numbers; those of one letter come first, as the letters' own numbers. 0 is none."""
        endings = sorted(self.grade, key=len)
        number = {"": 0} | {x: i for i, x in enumerate(endings, 1)}
        letters = [x for x in endings if len(x) == 1]
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        # Of each ending its score, if it is a piece, and its id, else -1; a letter that is no piece has the lowest score.
        self.value = np.full(len(number), -np.inf)
        self.value[0] = self.floor
        self.value[1:] = [self.floor if s is None and len(x) == 1 else -np.inf if s is None else s for x, s in ((x, self.grade[x]) for x in endings)]
        self.piece = np.array([-1, *(self.ids.get(x, -1) for x in endings)], np.int32)
        # An ending with one more letter before it, in order of both.
        step = np.array([number[x[1:]] * self.letters + number[x[0]] for x in endings[len(letters) :]], np.int64)
        order = np.argsort(step)
        self.step = np.append(step[order], np.iinfo(np.int64).max)
        self.longer = np.append(order + len(letters) + 1, 0)
        self.goes_on = np.zeros(len(number), bool)
        self.goes_on[step // self.letters] = True

    def _extend(self, text: str, best: list[float], back: list[int]) -> None:
        """Search on to the end of ``text``: by position the best sum of scores and the length of the last piece.

        Of equal sums the one with the shorter last piece counts.
        """
        score, grade, longest, floor = self.score.get, self.grade.get, self.longest, self.floor
        for end in range(len(best), len(text) + 1):
            top, length = best[-1] + score(text[end - 1], floor), 1
            for n in range(2, min(longest, end) + 1):
                s = grade(text[end - n : end], False)
                if s is False:
                    break
                if s is not None and best[end - n] + s > top:
                    top, length = best[end - n] + s, n
            best.append(top)
            back.append(length)

    def stream(self, characters: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of characters, in committed runs."""
        best, back, text = [0.0], [0], ""
        characters = iter(characters)
        while block := "".join(islice(characters, _LOOK)):
            text += block
            self._extend(text, best, back)
            shared = self._common(back, len(text)) if len(block) == _LOOK else 0
            if shared:
                yield self._path(text, back, shared)
                text, best, back = text[shared:], [b - best[shared] for b in best[shared:]], [0, *back[shared + 1 :]]
        if text:
            yield self._path(text, back, len(text))

    def _short(self, text: str) -> list[int]:
        """As ``stream`` for a text that ends before the first look."""
        best, back = [0.0], [0]
        self._extend(text, best, back)
        return self._path(text, back, len(text))

    def _common(self, back: list[int], end: int) -> int:
        """The last boundary on every path that can still win: those of the last ``longest`` positions."""
        alive = set(range(max(0, end - self.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - back[last])
        return alive.pop()

    def _path(self, text: str, back: list[int], end: int) -> list[int]:
        out: list[int] = []
        ids = self.ids.get
        while end > 0:
            start = end - back[end]
            found = ids(text[start:end])
            if found is None:
                out += reversed(self.spell(text[start:end]))
            else:
                out.append(found)
            end = start
        out.reverse()
        return out

    def spell(self, text: str) -> list[int]:
        """Byte pieces of a text."""
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; NULL and empty texts have none. A space mark that the text itself holds is spelt as bytes."""
        out: list[bytes] = []
        if text:
            for i, part in enumerate(text.split(SPACE)):
                if i:
                    out.append(_packed(self.spell(SPACE)))
                out += self._encode_part(part, SPACE if i == 0 else "")
        return np.frombuffer(b"".join(out), np.int32)

    def _encode_part(self, text: str, marks: str) -> list[bytes]:
        if self.joins_words:
            return [_packed(run) for run in self.stream(marks + text.replace(" ", SPACE))]
        if len(self.cache) > _CACHE:
            self.cache.clear()
        out: list[bytes] = []
        # Every word with the marks before it lies between two boundaries that all paths share.
        get = self.cache.get
        for word in text.split(" "):
            if word:
                part = marks + word
                ids = get(part)
                out.append(self._learn(part) if ids is None else ids)
                marks = SPACE
            else:
                marks += SPACE
        if len(marks) > 1:
            out.append(self._learn(marks[1:]))
        return out

    def _learn(self, part: str) -> bytes:
        """Ids of a word with its marks, kept if it is short; signs behind the last letter are looked up apart."""
        body, tail = self._cut(part)
        if not tail:
            ids = _packed(self._short(part) if len(part) < _LOOK else [i for run in self.stream(part) for i in run])
        else:
            ids = (self.cache.get(body) or self._learn(body)) + (self.cache.get(tail) or self._learn(tail))
        if len(part) <= _KEEP:
            self.cache[part] = ids
        return ids

    def _cut(self, part: str) -> tuple[str, str]:
        """A word and the signs behind its last letter."""
        body = part if self.joins_signs else part.rstrip(_SIGNS)
        return (body, part[len(body) :]) if body[-1:].isalpha() else (part, "")

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """``encode`` of each text, as lists."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Texts that hold a mark themselves, and all texts where marks are no boundaries, go one by one.
        alone = pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False) | self.joins_words
        if alone.any():
            others = self.encode_all(pc.if_else(pa.array(alone), "", texts)) if not alone.all() else None
            size = np.zeros(len(texts), np.int64) if others is None else pc.list_value_length(others).to_numpy().astype(np.int64)
            rows = {i: self.encode(texts[i].as_py()) for i in np.flatnonzero(alone).tolist()}
            known = np.zeros(0, np.int32) if others is None else others.flatten().to_numpy()
            ends = np.cumsum(size).tolist()
            flat, done = [], 0
            for i, ids in rows.items():
                flat += [known[done : ends[i]], ids]
                done = ends[i]
                size[i] = len(ids)
            return _lists(np.concatenate([[0], np.cumsum(size)]), np.concatenate([*flat, known[done:]]))
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        parts = [SPACE + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        nothing = pc.index(coded.dictionary, "").as_py()
        places, gapped = self._gaps(words, codes == nothing, bounds) if nothing >= 0 else ([], [])
        more = {p: len(parts) + i for i, p in enumerate(dict.fromkeys(gapped))}
        codes[places] = [more[p] for p in gapped]
        ids = self._look_up([*parts, *more])
        if nothing >= 0:
            ids[nothing] = b""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        pool = np.frombuffer(b"".join(ids), np.int32)
        first = np.cumsum(size) - size
        sizes = size[codes]
        behind = np.concatenate([[0], np.cumsum(sizes)])
        # Place in the pool of every id of every word, in order.
        take = np.arange(behind[-1]) + np.repeat(first[codes] - behind[:-1], sizes)
        return _lists(behind[bounds], pool[take])

    def _gaps(self, words: pa.Array, empty: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[str]]:
        """Places of words with several marks before them, or of marks at the end of a text, and these words with their marks."""
        start = np.zeros(len(words) + 1, bool)
        start[bounds] = True
        gaps = np.flatnonzero(empty)
        head = np.flatnonzero(start[gaps] | ~empty[gaps - 1])
        first, size = gaps[head], np.diff(np.append(head, len(gaps)))
        behind = first + size
        ends = start[behind]
        filled = ~ends | (size > 1) | ~start[first]  # all but those of empty texts
        inner = np.flatnonzero(~ends)
        found = words.take(pa.array(behind[inner])).to_numpy(zero_copy_only=False).tolist()
        last = np.flatnonzero(ends & filled)
        places = behind[inner].tolist() + first[last].tolist()
        return places, [SPACE * (n + 1) + w for n, w in zip(size[inner].tolist(), found)] + [SPACE * n for n in size[last].tolist()]

    def _look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct words with their marks; new ones are kept if they are short."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        cache = self.cache
        out = list(map(cache.get, parts))
        new = [i for i, ids in enumerate(out) if ids is None]
        cuts = [self._cut(parts[i]) for i in new]
        found = self._search([x for x in dict.fromkeys(x for cut in cuts for x in cut) if x and x not in cache])
        for i, (body, tail) in zip(new, cuts):
            ids = found.get(body) or cache[body]
            if tail:
                ids += found.get(tail) or cache[tail]
                found[parts[i]] = ids
            out[i] = ids
        cache.update((x, ids) for x, ids in found.items() if len(x) <= _KEEP)
        return out

    def _search(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of words; those that end before the first look are searched side by side."""
        out = {p: _packed([i for run in self.stream(p) for i in run]) for p in parts if len(p) >= _LOOK}
        short = sorted((p for p in parts if len(p) < _LOOK), key=len, reverse=True)
        for at in range(0, len(short), _LANES):
            lanes = short[at : at + _LANES]
            out.update(zip(lanes, self._side_by_side(lanes)))
        return out

    def _side_by_side(self, lanes: list[str]) -> list[bytes]:
        """As ``_short`` for each of many texts, the longest first. Sums are added and compared in the same order."""
        size = np.array([len(p) for p in lanes])
        most, n, ring = int(size[0]), len(lanes), self.longest + 1
        code = np.zeros((most + 1, n), np.int32)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        code[place + 1, np.repeat(np.arange(n), size)] = np.frombuffer("".join(lanes).encode("utf-32-le", "surrogatepass"), np.int32)
        letter = self.letter[code]
        active = n - np.searchsorted(size[::-1], np.arange(most + 1))
        # By position the best sum, for as far as the longest piece looks back, and length and id of the last piece.
        best = np.zeros((ring, n))
        back, last = np.ones((most + 1, n), np.int8), np.empty((most + 1, n), np.int32)
        for end in range(1, most + 1):
            k = int(active[end])
            node = letter[end, :k]
            top = best[(end - 1) % ring, :k] + self.value[node]
            piece = self.piece[node]
            last[end, :k] = np.where(piece < 0, -1 - code[end, :k], piece)
            rows = np.flatnonzero(self.goes_on[node])
            node = node[rows]
            for length in range(2, min(self.longest, end) + 1):
                step = node * self.letters + letter[end - length + 1, rows]
                at = np.searchsorted(self.step, step)
                some = self.step[at] == step
                rows, node = rows[some], self.longer[at[some]]
                if not len(rows):
                    break
                sums = best[(end - length) % ring, rows] + self.value[node]
                better = sums > top[rows]
                chosen = rows[better]
                top[chosen] = sums[better]
                back[end, chosen] = length
                last[end, chosen] = self.piece[node[better]]
                on = self.goes_on[node]
                rows, node = rows[on], node[on]
            best[end % ring, :k] = top
        # From the ends of all lanes back to their starts.
        steps, at, left, count = [], size.copy(), np.arange(n), np.zeros(n, np.int64)
        while len(left):
            here = at[left]
            steps.append((left, last[here, left]))
            count[left] += 1
            at[left] = here - back[here, left]
            left = left[at[left] > 0]
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]), np.int32)
        for i, (left, ids) in enumerate(steps):
            flat[ends[left] - 1 - i] = ids
        raw, cuts = flat.tobytes(), (4 * np.concatenate([[0], ends])).tolist()
        out = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        # Characters without a piece stand there as -1 less their code.
        for lane in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")).tolist():
            ids = flat[cuts[lane] // 4 : cuts[lane + 1] // 4].tolist()
            out[lane] = _packed([x for i in ids for x in ([i] if i >= 0 else self.spell(chr(-1 - i)))])
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: marks become spaces, byte pieces the characters they spell, one leading space goes."""
        parts = [self.plain[i] for i in ids]
        spelt = np.flatnonzero(self.is_byte[np.asarray(ids, np.int64)])
        if not len(spelt):
            return "".join(parts).removeprefix(" ")
        breaks = np.flatnonzero(np.diff(spelt) != 1)
        begins, ends = spelt[[0, *(breaks + 1)]].tolist(), spelt[[*breaks, -1]].tolist()
        out, done = [], 0
        for a, b in zip(begins, ends):
            out += parts[done:a]
            out.append(bytes(parts[a : b + 1]).decode("utf-8", "replace"))
            done = b + 1
        return "".join(out + parts[done:]).removeprefix(" ")

    def decode_all(self, lists: pa.Array) -> list[str]:
        """``decode`` of each list; NULL lists and NULL ids in them give nothing."""
        lists = lists.cast(_LISTS)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        found = lists.flatten()
        if found.null_count:
            bounds = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])[bounds]
            found = found.drop_null()
        ids = found.to_numpy().copy()
        ids[ids < 0] += len(self.names)
        taken = self.raw.take(pa.array(ids))
        cuts = np.frombuffer(taken.buffers()[1], np.int64)[bounds].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        out = [str(data[i:j], "utf-8", "replace").removeprefix(" ") for i, j in zip(cuts, cuts[1:])]
        # A special id parts the byte pieces around it.
        parted = np.concatenate([[0], np.cumsum(self.is_empty[ids])])[bounds]
        for i in np.flatnonzero(np.diff(parted)).tolist():
            out[i] = self.decode(ids[bounds[i] : bounds[i + 1]].tolist())
        return out


def _lists(bounds: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose sizes add up to about ``most``, or one larger row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy().astype(np.int64))
    cuts = (np.flatnonzero(np.diff(ends // most)) + 1).tolist()
    for i, j in zip([0, *cuts], [*cuts, len(batch)]):
        yield batch.slice(i, j - i)


def _worker(path: str) -> Pieces:
    return _WORKER.get(path) or _WORKER.setdefault(path, Pieces(path))


def encode_texts(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of each whole text; a column of that name is replaced."""
    names = [c for c in df.columns if c != ids]
    source = df.select(*[f"`{c}`" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(model)
        for big in batches:
            for batch in _slices(big, pc.binary_length(big.column(names.index(text)).cast(pa.large_string())), _BYTES):
                found = pieces.encode_all(batch.column(names.index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, ids])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_ids(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of each list of ids; NULL lists and NULL ids in them give nothing."""
    names = [c for c in df.columns if c != text]
    source = df.select(*[f"`{c}`" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(model)
        for big in batches:
            for batch in _slices(big, pc.list_value_length(big.column(names.index(ids)).cast(_LISTS)), _IDS):
                found = pa.array(pieces.decode_all(batch.column(names.index(ids))), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, text])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(text, T.StringType())]))
