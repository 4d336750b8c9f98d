"""Spelling variants by permuterm rotations.

A word of L code points is closed by a terminator and rotated; a rotation without its last code point is the word without
one letter, seen from that gap on. Two words that differ in one replaced letter have such a *skip* in common, and a word
that lacks a letter of another one has its own whole rotation equal to a skip of the longer word. So both edits are
prefix ranges of the sorted rotations, and near words meet by equality. A range holds one word per letter that can stand
in the gap, and at most one word without it: its size is bounded by the alphabet, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.ordered import with_position
from rowmill.session import materialize

# The letters of a run, and the terminator, which is none of them.
LETTERS = r"[A-Za-zÀ-ÿ]+"
MARK = "$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of more code points than this are compared by the 128-bit digests of their rotations: L rotations of L code points
# would take L * L bytes. Only the form of the key differs; every word is compared.
LONG = 64
# What a word is to a range: whole rotation, gap at the first letter of a run of equal ones, gap at a later one.
_WHOLE, _SKIP, _AGAIN = 0, 1, 2


def letter_runs(text: Column) -> Column:
    """The maximal runs of letters, A-Z lower-cased, in order. NULL for a NULL text."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))


def without_letter(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at``, counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at.cast("int")), F.substr(word, at.cast("int") + 2))


def count_words(words: DataFrame, word: str = "word", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of the words with enough code points and occurrences. NULL is no word; counted before the shuffle."""
    long = words.select(F.col(word).alias("word")).where(F.char_length("word") >= least_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rotations(word: Column) -> Column:
    """``array<struct<prefix, kind>>``: all L skips and all L + 1 whole rotations of a word.

    Deleting any letter of a run of equal letters gives the same word, so that only the first gap of a run may meet a
    whole rotation; a replaced letter meets in any gap.
    """
    size = F.char_length(word)
    head = lambda j: F.substr(word, F.lit(1), j)
    key = lambda tail, j: F.concat(tail, F.lit(MARK), head(j))
    short = lambda k: F.when(size > LONG, F.md5(k.cast("binary"))).otherwise(k)
    fresh = lambda j: (j == 0) | (F.substr(word, j, F.lit(1)) != F.substr(word, j + 1, F.lit(1)))
    kind = lambda j: F.when(fresh(j), F.lit(_SKIP)).otherwise(F.lit(_AGAIN))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.struct(short(key(F.substr(word, j + 2), j)).alias("prefix"), kind(j).alias("kind")))
    # A word of LONG code points can lack a letter of one that is keyed by digests, so it brings both forms.
    plain = F.transform(F.sequence(F.lit(0), size), lambda j: F.struct(short(key(F.substr(word, j + 1), j)).alias("prefix"), F.lit(_WHOLE).alias("kind")))
    digests = F.transform(F.sequence(F.lit(0), size), lambda j: F.struct(F.md5(key(F.substr(word, j + 1), j).cast("binary")).alias("prefix"), F.lit(_WHOLE).alias("kind")))
    return F.when(size < 1, plain).when(size == LONG, F.concat(skips, plain, digests)).otherwise(F.concat(skips, plain))


def near_words(ranked: DataFrame) -> DataFrame:
    """``rank, n_near, best`` of every word that has near words, from ``word, rank``: how many there are, and the least
    rank among them. Pairs are never listed: a range gives each of its words a count and a best rank.
    """
    turned = ranked.select("rank", F.inline(rotations(F.col("word"))))
    # One number per entry, so that sorting entries sorts ranks.
    ranges = turned.groupBy("prefix").agg(F.sort_array(F.collect_list(F.col("rank") * 4 + F.col("kind"))).alias("_in")).where(F.size("_in") > 1)
    of = lambda e: F.shiftright(e, 2)
    is_a = lambda e, kind: e.bitwiseAND(F.lit(3)) == kind

    def meets(e: Column, x: Column) -> Column:
        both = ~is_a(e, _WHOLE) & ~is_a(x, _WHOLE)
        return (e != x) & (both | (is_a(e, _WHOLE) & is_a(x, _SKIP)) | (is_a(e, _SKIP) & is_a(x, _WHOLE)))

    found = F.transform("_in", lambda e: F.struct(of(e).alias("rank"), F.filter("_in", lambda x: meets(e, x)).alias("_near")))
    each = ranges.select(F.inline(found)).where(F.size("_near") > 0)
    return each.groupBy("rank").agg(F.sum(F.size("_near")).alias("n_near"), F.min(of(F.get("_near", F.lit(0)))).alias("best"))


def follow(links: DataFrame, rounds: int = 64) -> DataFrame:
    """``rank, root`` from ``rank, up``: the last of each chain, by doubling. Chains must end; n links take log n rounds."""
    reached = materialize(links.select("rank", F.col("up").alias("root")), "roots")
    for _ in range(rounds):
        further = reached.select(F.col("rank").alias("_at"), F.col("root").alias("_on"))
        joined = reached.join(further, F.col("root") == F.col("_at"), "left")
        step = materialize(joined.select("rank", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        reached = step.select("rank", "root")
        if step.where("_moved").isEmpty():
            return reached
    raise RuntimeError(f"a chain did not end in {rounds} rounds")


def spelling_forms(counts: DataFrame, factor: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` from distinct words and their counts ``word, n``.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of the largest
    n (ties: the smallest in code-point order) if that is at least ``factor`` times the word's; the root is the end of the
    chain of forms, the word itself if it has none. A NULL word is left out, an empty one is near to every word of one letter, an
    empty table gives an empty one. ``factor`` above 1 makes counts grow along a chain, so chains have at most log(n) links.
    """
    if factor <= 1:
        raise ValueError("counts must grow along a chain: factor > 1")
    # Rank 1 is the most frequent word, so that the best of some words is the one of the least rank.
    named = counts.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n"))
    ranked = with_position(named, [("n", "desc"), "word"], "rank", tie=[])
    near = near_words(ranked)
    joined = ranked.join(near, "rank", "left")
    other = lambda name: ranked.select(F.col("rank").alias(f"_{name}_rank"), F.col("word").alias(f"_{name}"), F.col("n").alias(f"_{name}_n"))
    better = joined.join(other("best"), F.col("best") == F.col("_best_rank"), "left")
    holds = F.col("_best_n") >= F.col("n") * factor
    formed = materialize(better.select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("best")).alias("up"), F.when(holds, F.col("_best")).alias("form"), F.when(holds, F.col("_best_n")).alias("form_n"),
    ), "forms")
    ends = follow(formed.where(F.col("up").isNotNull()))
    rooted = formed.join(ends.withColumnRenamed("root", "_end"), "rank", "left").join(other("root"), F.col("_end") == F.col("_root_rank"), "left")
    return rooted.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
