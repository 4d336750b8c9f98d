"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. It is known by the XOR of two 64-bit hashes of (depth, role, text) over its
turns, so the nodes of a conversation are a running total that can be taken in blocks. The tour enters and leaves every
node once. Its arcs form a linked list, which ``rank_list`` ranks by contraction: in each round arcs that drew 0 and whose
successor drew 1 join their predecessor, until few are left; then places are handed back round by round. What is summed
along the list are the steps, leaves and savings of the arcs, so the sums inside a subtree are those between its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.ordered import neighbour, ordered_slices, running_total
from rowmill.session import materialize

# Turns of one conversation that are summed in one group; longer ones go over several.
BLOCK = 1024
# Lists of at most this many arcs are walked in one task.
WALK = 4096
# Rounds of giving places back that go into one plan.
DEEP = 6
ARC = ["a", "b", "x"]
SUMS = ["steps", "leaves", "saved"]


def numbered_turns(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``conv_id, p, chars, _y1, _y2``: the turns of each conversation numbered from 1, with hashes of role and text.

    By turn, NULL first, then role and text; NULL role and text are empty; rows without a conversation id belong to no
    conversation and are left out, repeated rows are repeated turns. A long conversation is numbered over sorted slices.
    """
    empty = F.lit("")
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    hashed = rows.withColumns({"_y1": F.xxhash64("role", "text"), "_y2": F.xxhash64("text", F.lit(0), "role"), "chars": F.char_length("text").cast("long")})
    sliced = ordered_slices(hashed, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], tie=[])
    return running_total(sliced.select("conv_id", "chars", "_y1", "_y2", "_slice", "_pos"), ["conv_id"], F.lit(1), "p").drop("_slice", "_pos")


def prefix_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, chars, a, b, pa, pb`` from ``conv_id, depth, chars, _y1, _y2``: the node that each turn leads to and the
    node before it. Runs over blocks of turns; one row per block is carried on.
    """
    marked = rows.withColumns({
        "_block": F.floor(F.col("depth") / BLOCK), "_x1": F.xxhash64(F.lit(1), "depth", "_y1", "_y2"), "_x2": F.xxhash64(F.lit(2), "depth", "_y2", "_y1")
    })
    inside = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("conv_id", "_block").agg(F.bit_xor("_x1").alias("_c1"), F.bit_xor("_x2").alias("_c2"))
    carried = blocks.select("conv_id", "_block", F.bit_xor("_c1").over(before).alias("_c1"), F.bit_xor("_c2").over(before).alias("_c2")).where("_c1 IS NOT NULL")
    local = marked.withColumns({"_l1": F.bit_xor("_x1").over(inside), "_l2": F.bit_xor("_x2").over(inside)})
    total = lambda n: F.col(f"_l{n}").bitwiseXOR(F.coalesce(f"_c{n}", F.lit(0).cast("long")))
    joined = local.join(carried, ["conv_id", "_block"], "left").withColumns({"a": total(1), "b": total(2)})
    return joined.select("conv_id", "depth", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("_x1")).alias("pa"), F.col("b").bitwiseXOR(F.col("_x2")).alias("pb"))


def trie_nodes(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``a, b, depth, pa, pb, conv_id, n_convs, chars`` per node, written once; the root is ``a = b = depth = 0``."""
    inner = prefixes.groupBy("a", "b", "depth").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 0)
    top = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), none.alias("pa"), none.alias("pb"), "conv_id", "n_convs", zero.alias("chars"))
    return materialize(inner.unionByName(top), "nodes")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """The arcs ``a, b, x`` (x = 0 enters the node, 1 leaves it) with their successor ``sa, sb, sx``, ``head`` for the first one,
    and what each adds: a step, a leaf, saved tokens.

    Children follow each other in the order of their hashes, taken over sorted slices, so a node may have any number.
    """
    child = F.struct("a", "b")
    sliced = ordered_slices(nodes.select("a", "b", "pa", "pb"), ["pa", "pb", "a", "b"], tie=[])
    linked = neighbour(sliced, ["pa", "pb"], child, "_next", forward=True).select("a", "b", F.col("_next").alias("next"))
    under = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.min(child).alias("first"), F.count("*").alias("n_children"))
    whole = nodes.join(linked, ["a", "b"]).join(under, ["a", "b"], "left")
    whole = whole.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "_root": F.col("depth") == 0})
    zero, one = F.lit(0), F.lit(1)
    to = lambda node, x: F.struct(node["a"].alias("sa"), node["b"].alias("sb"), x.alias("sx"))
    own, parent = F.struct("a", "b"), F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))
    enter = F.when(F.col("first").isNotNull(), to(F.col("first"), zero)).otherwise(to(own, one))
    # The root has no sibling and no parent: its last arc has no successor.
    leave = F.when(F.col("_root"), F.lit(None)).when(F.col("next").isNotNull(), to(F.col("next"), zero)).otherwise(to(parent, one))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    arc = lambda x, after, head, leaf, kept: F.struct(x.alias("x"), after.alias("s"), head.alias("head"), F.lit(1).cast("long").alias("steps"), leaf.cast("long").alias("leaves"), kept.alias("saved"))
    both = F.array(arc(zero, enter, F.col("_root"), F.col("n_children") == 0, saved), arc(one, leave, F.lit(False), F.lit(False), F.lit(0).cast("long")))
    return whole.select("a", "b", F.explode(both).alias("_arc")).select("a", "b", "_arc.x", "_arc.s.sa", "_arc.s.sb", "_arc.s.sx", "_arc.head", *[f"_arc.{s}" for s in SUMS])


def _coin(a: str, b: str, x: str, turn: int) -> Column:
    """A fair draw per arc and round; 1 past the end of the list."""
    draw = F.xxhash64(F.lit(turn), a, b, x).bitwiseAND(F.lit(1))
    return F.when(F.col(a).isNull(), F.lit(1)).otherwise(draw)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums before each arc of one short list, from its head on."""
    at = {(r.a, r.b, r.x): r for rows in batches for r in rows.itertuples(index=False)}
    out, total = [], [0, 0, 0]
    r = next((r for r in at.values() if r.head), None)
    while r is not None:
        out.append((r.a, r.b, r.x, *total))
        total = [total[0] + r.steps, total[1] + r.leaves, total[2] + r.saved]
        r = at.get((r.sa, r.sb, r.sx))
    yield pd.DataFrame(out, columns=[*ARC, *SUMS]).astype({**dict.fromkeys(["a", "b", *SUMS], "int64"), "x": "int32"})


def rank_list(arcs: DataFrame, walk: int = WALK) -> DataFrame:
    """``a, b, x, steps, leaves, saved``: the sums of everything before each arc of a linked list with one ``head``.

    An arc leaves the list in a round if it draws 0 and its successor draws 1, so no two neighbours leave together; the
    arc before it takes over its successor and its sums. A quarter of the list leaves per round; rounds end at ``walk`` arcs,
    which one task follows. Each round is one join on equal arcs, written once; all rounds together handle four times the list.
    """
    now, logs = materialize(arcs, "arcs"), []
    while now.count() > walk:
        turn = len(logs)
        after = now.select(*[F.col(c).alias(f"v_{c}") for c in (*ARC, "sa", "sb", "sx", *SUMS)])
        joined = now.join(after, (F.col("sa") == F.col("v_a")) & (F.col("sb") == F.col("v_b")) & (F.col("sx") == F.col("v_x")), "left")
        leaves = lambda p: (_coin(f"{p}a", f"{p}b", f"{p}x", turn) == 0) & (_coin(f"{p}sa", f"{p}sb", f"{p}sx", turn) == 1)  # noqa: B023, E731
        joined = joined.where(F.col("head") | ~leaves("")).withColumn("_gone", F.col("v_a").isNotNull() & leaves("v_"))
        succ = [F.when(F.col("_gone"), F.col(f"v_{c}")).otherwise(F.col(c)).alias(f"n_{c}") for c in ("sa", "sb", "sx")]
        logs.append(materialize(joined.select(*ARC, "head", *SUMS, "_gone", "v_a", "v_b", "v_x", *[F.col(f"v_{c}") for c in SUMS], *succ), "round"))
        more = lambda c: (F.col(c) + F.when(F.col("_gone"), F.col(f"v_{c}")).otherwise(F.lit(0))).alias(c)
        now = logs[-1].select(*ARC, "head", *[more(c) for c in SUMS], *[F.col(f"n_{c}").alias(c) for c in ("sa", "sb", "sx")])
    # pandas would turn numbers with NULLs among them into inexact doubles.
    known = [F.coalesce(c, F.lit(-1).cast(kind)).alias(c) for c, kind in (("sa", "long"), ("sb", "long"), ("sx", "int"))]
    ranks = now.select(*ARC, *known, "head", *SUMS).repartition(1).mapInPandas(_walk, "a bigint, b bigint, x int, steps bigint, leaves bigint, saved bigint")
    for i, log in enumerate(reversed(logs)):
        place = ranks.select(*ARC, *[F.col(c).alias(f"r_{c}") for c in SUMS])
        joined = log.join(place, ARC)
        own = F.struct(*ARC, *[F.col(f"r_{c}").alias(c) for c in SUMS])
        other = F.struct(*[F.col(f"v_{c}").alias(c) for c in ARC], *[(F.col(f"r_{c}") + F.col(c)).alias(c) for c in SUMS])
        ranks = joined.select(F.inline(F.when(F.col("_gone"), F.array(own, other)).otherwise(F.array(own))))
        if i % DEEP == DEEP - 1:
            ranks = materialize(ranks, "ranks")
    return ranks


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the ids of each node, in the order they come; keeps one digest, whatever the size of a group."""
    key, digest = None, None
    for batch in batches:
        out = []
        for (a, b), ids in batch.groupby(["a", "b"], sort=False)["conv_id"]:
            text = ",".join(map(str, ids.tolist()))
            if (a, b) == key:
                digest.update(f",{text}".encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = (a, b), hashlib.sha256(text.encode())
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: digest of the ids of the conversations that end at a node, ascending, joined with commas.

    A digest reads its ids one after the other, so those of one node stream through one task, sorted by Spark.
    """
    dealt = ends.select("a", "b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    return dealt.mapInPandas(_digest, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame, conversations: DataFrame, walk: int = WALK) -> DataFrame:
    """One row per node of the trie of conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``rows``: ``conv_id, depth, chars, _y1, _y2`` with depths 1, 2, ... per conversation; ``conversations``: every ``conv_id`` once, also
    those without rows, which end at the root. ``conv_id`` of a node is its smallest member; saved tokens are (members - 1)
    times the code points of the last text, over the subtree. No conversation gives no node.
    """
    prefixes = materialize(prefix_rows(rows), "prefixes")
    nodes = trie_nodes(prefixes, conversations)
    tour = euler_tour(nodes)
    ranks = rank_list(tour, walk)
    # Sums grow along the tour, so the larger of a node's two places is the one where it is left.
    inside = ranks.groupBy("a", "b").agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("leaves", "saved")])
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("_end"))
    zero = F.lit(0).cast("long")
    ends = conversations.join(last, "conv_id", "left").select("conv_id", F.coalesce("_end.a", zero).alias("a"), F.coalesce("_end.b", zero).alias("b"))
    counts = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(parents, ["pa", "pb"], "left").join(counts, ["a", "b"], "left").join(inside, ["a", "b"]).join(end_digests(ends), ["a", "b"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
