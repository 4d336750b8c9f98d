"""Language-model scoring with a hierarchical Pitman-Yor bigram model.

Every word is a context with a restaurant of its own; all of them send their tables as customers to one parent, whose
base is uniform over the known words and one unknown word. Seating is sampled by Gibbs sweeps of the Chinese-restaurant
process. Below one parent distribution the predictive probability of a word is linear in the tables of its context, so
averaging tables over the sweeps after burn-in averages those probabilities; the parent's own are averaged the same way.
The perplexity of a text is 10 ** (-score / n_tokens), that of many texts comes from the sums of both (``perplexity``).

Work is dealt out twice, by *chunks* of documents and by *shards* of contexts and words, both by hash:

1. a chunk counts its words and word pairs and sends each shard its part (one row of packed arrays per chunk and shard);
2. a shard adds up the counts of its contexts, samples the seating of their restaurants, and sends every word's tables to
   the shard of that word;
3. a shard adds up its words' counts and tables, samples the parent's seating, and answers the chunks that asked;
4. a chunk reads its documents again and adds up the log probabilities of each.

Nothing passes through the driver. A chunk or a shard needs memory for its own share only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm import words as W

DISCOUNT = 0.8  # of context restaurants
STRENGTH = 1.0
PARENT_DISCOUNT = 0.7
PARENT_STRENGTH = 1.0
BURN_IN = 2
SWEEPS = 4  # kept after burn-in
SEED = 11

_END = np.uint64(0x0E4D5B1D3A7C9F21)  # the word that ends a text
_START = np.uint64(0x57A27B9C1D3E5F61)  # the context of a text's first word
_SHORT = 6  # bytes of a hash that name a follower
_PART = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("followers", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary()),
])
_PART_SQL = "shard int, chunk int, words binary, counts binary, followers binary, pairs binary, pair_counts binary"
_TABLE_SQL = "shard int, words binary, tables binary"
_ANSWER_SQL = "chunk int, shard int, kind int, a binary, b binary, tokens bigint, kinds bigint, customers double, tables double"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z folded, and of the end. NULL and empty texts have the end only."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([W.hashes(data, *W.bounds(data), fold=True), [_END]])


def short(hashes: np.ndarray) -> np.ndarray:
    """The part of a hash that names a follower, as bytes."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SHORT]


def _whole(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // _SHORT, 8), np.uint8)
    out[:, :_SHORT] = raw.reshape(-1, _SHORT)
    return out.view("<u8")[:, 0]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By bits that a follower's name holds too, so that both ends agree."""
    return ((hashes >> np.uint64(8)) & np.uint64(0xFFFFFFFF)) % np.uint64(shards)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them), with 32-bit places."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(values), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ranked[fresh], at


class Chunk:
    """Words and pairs of a chunk of documents in one fixed order: by shard, then hash; pairs by context, then word."""

    def __init__(self, texts: list[str | None], shards: int):
        each = [tokens(t) for t in texts]
        self.size = np.array([len(x) for x in each], np.int64)
        first = np.cumsum(self.size) - self.size
        each.append(np.array([_START]))
        known, at = _numbered(np.concatenate(each))
        del each
        place = shard_of(known, shards)
        order = np.lexsort((known, place))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.known, place = known[order], place[order]
        start, self.word = rank[at[-1]], rank[at[:-1]]
        del at
        context = np.concatenate([[start], self.word[:-1]])
        context[first] = start
        pair, self.pair = _numbered(context.astype(np.int64) * len(known) + self.word)
        self.context, self.follower = (pair // len(known)).astype(np.int32), (pair % len(known)).astype(np.int32)
        # Where each shard's words begin, and where the pairs of each word as a context do.
        self.cuts = np.searchsorted(place, np.arange(shards + 1))
        self.pair_cuts = np.searchsorted(self.context, np.arange(len(known) + 1))

    def parts(self, number: int, train: np.ndarray) -> Iterator[tuple]:
        """What each shard gets: words, their counts in training texts, followers of each, and pair counts."""
        used = np.repeat(train, self.size)
        counts = np.bincount(self.word[used], minlength=len(self.known)).astype("<u4")
        pair_counts = np.bincount(self.pair[used], minlength=len(self.context)).astype("<u4")
        followers = np.diff(self.pair_cuts).astype("<u4")
        names = short(self.known)[self.follower]
        for s in range(len(self.cuts) - 1):
            i, j = self.cuts[s], self.cuts[s + 1]
            if i < j:
                a, b = self.pair_cuts[i], self.pair_cuts[j]
                yield s, number, self.known[i:j].tobytes(), counts[i:j].tobytes(), followers[i:j].tobytes(), names[a:b].tobytes(), pair_counts[a:b].tobytes()


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after seating its customers anew, one after the other.

    ``others``: tables of the other dishes in the same restaurant; ``base``: the parent's probability of the dish. The
    first customer opens a table. Each further one opens another with probability (strength + discount * all tables) *
    base against (seated - discount * tables of the dish). Once many are seated, those of a block that is a 32nd of
    them are drawn together, from the odds at its beginning.
    """
    order = np.argsort(-customers, kind="stable")
    left = customers[order]
    tables = np.minimum(left, 1).astype(np.float64)
    others, base = others[order], base[order]
    seated = 1
    while len(left) and left[0] > seated:
        n = int(np.searchsorted(-left, -seated, side="left"))  # dishes with more customers than that
        block = max(1, seated // 32)
        t = tables[:n]
        fresh = (strength + discount * (others[:n] + t)) * base[:n]
        odds = fresh / (fresh + np.maximum(seated - discount * t, 1e-12))
        take = np.minimum(block, left[:n] - seated)
        tables[:n] += rng.random(n) < odds if block == 1 else rng.binomial(take, np.clip(odds, 0, 1))
        seated += block
    out = np.empty_like(tables)
    out[order] = tables
    return out


def sample_contexts(context: np.ndarray, word: np.ndarray, count: np.ndarray, contexts: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean tables of each pair, mean tables of each context) for pairs of a context and a word with their counts.

    The parent's probabilities are those of this shard's own tables, sampled along.
    """
    rng = np.random.Generator(np.random.PCG64([SEED, seed]))
    met = np.flatnonzero(count)
    c, w, n = context[met], word[met], count[met].astype(np.int64)
    tables = np.ones(len(met))
    mean = np.zeros(len(met))
    for sweep in range(BURN_IN + SWEEPS):
        total = np.bincount(c, tables, contexts)
        parent = np.bincount(w, tables, words)
        dishes = (parent > 0).sum()
        rest = (PARENT_STRENGTH + PARENT_DISCOUNT * dishes) / (words + 1)
        p = (np.maximum(parent - PARENT_DISCOUNT, 0) + rest) / (PARENT_STRENGTH + parent.sum())
        more = n > 1
        tables[more] = seat(n[more], total[c[more]] - tables[more], p[w[more]], DISCOUNT, STRENGTH, rng)
        if sweep >= BURN_IN:
            mean += tables / SWEEPS
    out = np.zeros(len(count))
    out[met] = mean
    return out, np.bincount(c, mean, contexts)


def _arrays(rows: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


class Shard:
    """Contexts of one shard, added up over chunks."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        self.number = rows[0]["shard"]
        self.chunks = [r["chunk"] for r in rows]
        self.sizes = [len(r["words"]) // 8 for r in rows]
        self.pair_sizes = [len(r["pair_counts"]) // 4 for r in rows]
        known, at = _numbered(_arrays([r["words"] for r in rows], "<u8"))
        self.words, self.at = known, at
        self.counts = np.bincount(at, _arrays([r["counts"] for r in rows], "<u4"), len(known))
        followers = _arrays([r["followers"] for r in rows], "<u4")
        names = _whole(_arrays([r["pairs"] for r in rows], np.uint8))
        self.names, follower = _numbered(names)
        del names
        width = max(len(self.names), 1)
        pair, self.pair_at = _numbered(np.repeat(at, followers).astype(np.int64) * width + follower)
        del follower
        self.context, self.follower = (pair // width).astype(np.int32), (pair % width).astype(np.int32)
        self.pair_counts = np.bincount(self.pair_at, _arrays([r["pair_counts"] for r in rows], "<u4"), len(pair))

    def sample(self) -> None:
        self.tables, self.context_tables = sample_contexts(self.context, self.follower, self.pair_counts, len(self.words), len(self.names), self.number)
        self.customers = np.bincount(self.context, self.pair_counts, len(self.words))

    def to_words(self, shards: int) -> Iterator[tuple]:
        """Each follower's tables, for the shard of that word."""
        total = np.bincount(self.follower, self.tables, len(self.names))
        place = shard_of(self.names, shards)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(shards + 1))
        for s in range(shards):
            part = order[cuts[s] : cuts[s + 1]]
            part = part[total[part] > 0]
            if len(part):
                yield s, short(self.names[part]).tobytes(), total[part].astype("<f4").tobytes()

    def to_chunks(self) -> Iterator[tuple]:
        """For each chunk, in its own order: discounted customers of its pairs; customers and tables of its contexts."""
        kept = (self.pair_counts - DISCOUNT * self.tables).astype("<f4")
        stats = np.stack([self.customers, self.context_tables], axis=1).astype("<f4")
        i = a = 0
        for chunk, n, m in zip(self.chunks, self.sizes, self.pair_sizes):
            yield chunk, self.number, 0, kept[self.pair_at[a : a + m]].tobytes(), stats[self.at[i : i + n]].tobytes(), 0, 0, 0.0, 0.0
            i, a = i + n, a + m

    def parent(self, tables: pa.Table, chunks: int) -> Iterator[tuple]:
        """Counts, customers and tables of the words in the parent restaurant, for the chunks that asked.

        Chunks that did not ask get the shard's totals only.
        """
        mine = short(self.words)
        named = _whole(np.ascontiguousarray(mine).reshape(-1))
        order = np.argsort(named, kind="stable")
        customers = np.zeros(len(self.words))
        if tables.num_rows:
            sent = _whole(_arrays(tables.column("words").to_pylist(), np.uint8))
            amount = _arrays(tables.column("tables").to_pylist(), "<f4")
            i = np.searchsorted(named[order], sent)
            i[i == len(order)] = 0
            hit = named[order][i] == sent
            customers = np.bincount(order[i[hit]], amount[hit], len(self.words))
        whole = np.rint(customers).astype(np.int64)
        whole[(customers > 0) & (whole == 0)] = 1
        rng = np.random.Generator(np.random.PCG64([SEED, self.number, 1]))
        open_tables = np.minimum(whole, 1).astype(float)
        mean = np.zeros(len(whole))
        known = max((self.counts > 0).sum(), 1)
        for sweep in range(BURN_IN + SWEEPS):
            open_tables = seat(whole, open_tables.sum() - open_tables, np.full(len(whole), 1.0 / (known + 1)), PARENT_DISCOUNT, PARENT_STRENGTH, rng)
            if sweep >= BURN_IN:
                mean += open_tables / SWEEPS
        kept = np.where(whole > 0, np.maximum(whole - PARENT_DISCOUNT * mean, 0), 0).astype("<f8")
        counts = self.counts.astype("<i8")
        totals = int(counts.sum()), int((counts > 0).sum()), float(whole.sum()), float(mean.sum())
        i, asked = 0, set(self.chunks)
        for chunk, n in zip(self.chunks, self.sizes):
            at = self.at[i : i + n]
            yield chunk, self.number, 1, counts[at].tobytes(), kept[at].tobytes(), *totals
            i += n
        for chunk in range(chunks):
            if chunk not in asked:
                yield chunk, self.number, 1, b"", b"", *totals


def probabilities(chunk: Chunk, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(P(word | context) of each pair, count of each word, all tokens, all words) from what the shards answered."""
    counts, kept = np.zeros(len(chunk.known), np.int64), np.zeros(len(chunk.known))
    seated, pair = np.zeros((len(chunk.known), 2)), np.zeros(len(chunk.context))
    total = kinds = 0
    customers = tables = 0.0
    for r in answers:
        i, j = chunk.cuts[r["shard"]], chunk.cuts[r["shard"] + 1]
        if r["kind"] == 0:
            a, b = chunk.pair_cuts[i], chunk.pair_cuts[j]
            pair[a:b] = np.frombuffer(r["a"], "<f4")
            seated[i:j] = np.frombuffer(r["b"], "<f4").reshape(-1, 2)
        else:
            total, kinds = total + r["tokens"], kinds + r["kinds"]
            customers, tables = customers + r["customers"], tables + r["tables"]
            if r["a"]:
                counts[i:j] = np.frombuffer(r["a"], "<i8")
                kept[i:j] = np.frombuffer(r["b"], "<f8")
    parent = (kept + (PARENT_STRENGTH + PARENT_DISCOUNT * tables) / (kinds + 1)) / (PARENT_STRENGTH + customers)
    at = chunk.context
    p = (pair + (STRENGTH + DISCOUNT * seated[at, 1]) * parent[chunk.follower]) / (STRENGTH + seated[at, 0])
    return p, counts, total, kinds


def _score_chunk(texts: list[str | None], shards: int, answers: list[dict]) -> tuple:
    """(n_tokens, n_known, train tokens, base score, score) of each text of a chunk."""
    chunk = Chunk(texts, shards)
    p, counts, total, kinds = probabilities(chunk, answers)
    first = np.cumsum(chunk.size) - chunk.size
    base = np.log10((counts + 1) / (total + kinds + 1))[chunk.word]
    known = np.add.reduceat((counts > 0)[chunk.word].astype(np.int64), first)
    return chunk.size, known, np.full(len(first), total), np.add.reduceat(base, first), np.add.reduceat(np.log10(p)[chunk.pair], first)


def score_texts(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for every row of ``df``.

    Learns from the rows that are not held out (NULL counts as not held out). ``base_score`` is add-one smoothing over
    single words. ``parts``: chunks and shards, the session's number of shuffle partitions unless given: choose it so
    that a part of the input fits a task. Repeated rows are scored each, and learnt from as often as they come. An empty
    table gives no rows; without training rows every word is unknown and has the parent's base probability.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(
        F.pmod(F.xxhash64(key, text), F.lit(parts)).cast("int").alias("chunk"), F.col(key).alias("key"),
        F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"),
    ).repartition(parts, "chunk")

    def count(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text").to_pylist(), parts)
        train = ~np.array(table.column("held").to_pylist(), bool)
        return pa.Table.from_pylist([dict(zip(_PART.names, r)) for r in chunk.parts(table.column("chunk")[0].as_py(), train)], _PART)

    sent = docs.groupBy("chunk").applyInArrow(count, _PART_SQL).repartition(parts, "shard")

    def up(table: pa.Table) -> pa.Table:
        shard = Shard(table)
        shard.sample()
        return pa.Table.from_pylist([dict(zip(("shard", "words", "tables"), r)) for r in shard.to_words(parts)], _arrow(_TABLE_SQL))

    def back(table: pa.Table) -> pa.Table:
        shard = Shard(table)
        shard.sample()
        return pa.Table.from_pylist([dict(zip(answer.names, r)) for r in shard.to_chunks()], answer)

    def parent(own: pa.Table, tables: pa.Table) -> pa.Table:
        rows = Shard(own).parent(tables, parts) if own.num_rows else ()
        return pa.Table.from_pylist([dict(zip(answer.names, r)) for r in rows], answer)

    answer = _arrow(_ANSWER_SQL)
    risen = sent.groupBy("shard").applyInArrow(up, _TABLE_SQL)
    from_contexts = sent.groupBy("shard").applyInArrow(back, _ANSWER_SQL)
    from_words = sent.groupBy("shard").cogroup(risen.groupBy("shard")).applyInArrow(parent, _ANSWER_SQL)
    answers = from_contexts.union(from_words).repartition(parts, "chunk")
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _empty(own, key, names)
        values = _score_chunk(own.column("text").to_pylist(), parts, found.to_pylist())
        columns = [own.column("key"), own.column("held"), *[pa.array(v) for v in values]]
        return pa.Table.from_arrays(columns, names=[key, *names])

    scored = docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
    # A text has its end at least, so that n_tokens is never 0.
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, n_tokens, perplexity, base_perplexity`` over all texts of ``score_texts``, learnt from and held out.

    A class without texts has no row.
    """
    per_token = lambda score: F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity")
    )


def _empty(own: pa.Table, key: str, names: list[str]) -> pa.Table:
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.Table.from_arrays([own.column("key"), *[pa.array([], k) for k in kinds]], names=[key, *names])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])
