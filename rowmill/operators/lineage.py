"""Table lineage and job graphs as DataFrames.

``components(job, component, kind, table_name, query)`` describes jobs; ``edges(src, dst)`` a graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.ordered import recomputed
from rowmill.operators.reshape import explode_rows
from rowmill.session import StoredBy, StoredTable, materialize

# Words that are never a table, and encoded white space in stored SQL.
NOT_TABLES = ("dual", "select", "where", "and", "or")
WHITE_SPACE = r"(?:\s|&#10;|&#9;|\\n|\\t)+"
TABLE_REFERENCE = rf"(?i)(?:FROM|JOIN){WHITE_SPACE}([a-zA-Z_][\w.]*)"


def table_name(raw: Column) -> Column:
    """Canonical table name: no quotes, last dotted part, lower case."""
    bare = F.trim(F.regexp_replace(raw, "[\"'`]", ""))
    return F.lower(F.trim(F.element_at(F.split(bare, r"\."), -1)))


def tables_in_sql(sql: Column) -> Column:
    """Distinct table names after FROM and JOIN in a query text, which may hold encoded line ends."""
    clean = F.replace(F.replace(sql, F.lit("`"), F.lit("")), F.lit("&#13;"), F.lit(""))
    found = F.regexp_extract_all(clean, F.lit(TABLE_REFERENCE), 1)
    names = F.transform(found, lambda n: F.lower(F.substring_index(n, ".", -1)))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*NOT_TABLES)))


def extract_tables(df: DataFrame, column: str, name: str = "table_name") -> DataFrame:
    """One row per table a query text names."""
    return explode_rows(df, tables_in_sql(F.col(column)), name)


# Rows that a task groups or joins at once, at most on average.
TASK_ROWS = 250_000


def _parts(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: no fewer than the session's, and more for large tables, so that a task's memory does not grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / TASK_ROWS))


def job_reads_writes(components: DataFrame) -> DataFrame:
    """Distinct ``(job, access, table_name)``; sources and SQL statements read, sinks write.

    Components are counted when this is called, and dealt out once, by job: a query text is parsed where its job lies, and what
    a job names is made distinct there.
    """
    reads = F.col("kind").isin("DATA_SOURCE", "SQL_EXEC")
    access = F.when(reads, "read").otherwise("write").alias("access")
    used = components.where(reads | (F.col("kind") == "DATA_SINK")).select(
        "job", access, table_name(F.col("table_name")).alias("table_name"), F.when(reads, F.col("query")).alias("query"))
    used = used.where((F.col("table_name") != "") | F.col("query").isNotNull())
    dealt = used.repartition(_parts(components.sparkSession, used.count()), "job")
    own = F.when(F.col("table_name") != "", F.array("table_name"))
    names = F.concat(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(tables_in_sql(F.col("query")), F.array().cast("array<string>")))
    return explode_rows(dealt.select("job", "access", names.alias("_names")), F.col("_names"), "table_name").select("job", "access", "table_name").distinct()


def data_edges(access: DataFrame) -> DataFrame:
    """``(writer, reader, table_name)`` where one job writes what another reads.

    ``access`` is stored and its rows per table are counted when this is called. Writers and readers of a table with very many
    are dealt into blocks; each block of writers meets each block of readers.
    """
    spark = access.sparkSession
    both = materialize(access.where(F.col("table_name").isNotNull()).select("job", "access", "table_name"), "access")
    counts = both.groupBy("table_name").agg(F.count_if(F.col("access") == "write").alias("w"), F.count_if(F.col("access") == "read").alias("r"))
    large = counts.where(F.greatest("w", "r") > TASK_ROWS).select(
        F.col("table_name").alias("_large"), *[F.greatest(F.ceil(F.col(c) / TASK_ROWS), F.lit(1)).cast("int").alias(f"_{c}") for c in ("w", "r")])
    # At most one row per TASK_ROWS rows.
    blocks = both.join(F.broadcast(materialize(large, "large")), F.col("table_name") == F.col("_large"), "left")
    blocks = blocks.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_w", "_r")})

    def side(kind: str, name: str, own: str, other: str) -> DataFrame:
        rows = blocks.where(F.col("access") == kind).select(
            F.col("job").alias(name), "table_name", F.pmod(F.xxhash64("job"), F.col(own)).cast("int").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block"))
        return rows.repartition(parts, "table_name", "_w_block", "_r_block")

    parts = _parts(spark, both.count())
    joined = side("write", "writer", "_w", "_r").join(side("read", "reader", "_r", "_w"), ["table_name", "_w_block", "_r_block"])
    return joined.where(F.col("writer") != F.col("reader")).select("writer", "reader", "table_name")


def table_links(access: DataFrame) -> DataFrame:
    """``(table_name, n_writers, n_readers, n_edges)``: the edges of ``data_edges`` kept factored, one row per table with any.

    Distinct jobs per table are counted, not paired: 10,000 writers and 10,000 readers are 20,000 rows. Counts are
    combined before the shuffle, so a table that a third of all jobs use is no hot key.
    """
    uses = access.select("job", "table_name", (F.col("access") == "write").cast("int").alias("w"), (F.col("access") == "read").cast("int").alias("r"))
    per_job = uses.groupBy("table_name", "job").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    sums = per_job.groupBy("table_name").agg(F.sum("w").alias("n_writers"), F.sum("r").alias("n_readers"), F.sum(F.col("w") * F.col("r")).alias("_both"))
    edges = F.col("n_writers") * F.col("n_readers") - F.col("_both")
    return sums.select("table_name", "n_writers", "n_readers", edges.alias("n_edges")).where(F.col("n_edges") > 0)


def round_writers(frontier: DataFrame, reads: StoredTable, writes: StoredTable) -> DataFrame:
    """Jobs that write a table which a job of the frontier reads; ``reads`` and ``writes`` are stored by job and by table."""
    tables = reads.matched(frontier).select("table_name").distinct()
    return writes.matched(tables).select("job").distinct()


def needed_jobs(access: DataFrame, roots: DataFrame, column: str = "job") -> DataFrame:
    """Jobs that ``roots`` depend on through tables, transitively, and the roots themselves.

    Each round goes from new jobs to the tables they read to the jobs that write them, so no writer-reader pair is built.
    Reads are stored once in buckets by job, writes by table, jobs already found by job: a round shuffles its frontier only
    and reads the stored sides where they lie. The loop stops when a round finds nothing new. All of this runs
    when it is called.
    """
    spark = access.sparkSession
    with StoredBy(spark) as store:
        both = materialize(access.select("access", "job", "table_name"), "access")
        reads = store.write(both.where("access = 'read'").select("job", "table_name"), "job", "reads")
        writes = store.write(both.where("access = 'write'").select("table_name", "job"), "table_name", "writes")
        name, number = f"rowmill_needed_{uuid.uuid4().hex}", 0
        new = roots.select(F.col(column).alias("job")).distinct()
        while True:
            seen = store.append(new.withColumn("round", F.lit(number)), name, ["job"])
            frontier = seen.where(F.col("round") == number).select("job")
            if frontier.isEmpty():
                return spark.read.schema("job " + dict(new.dtypes)["job"]).parquet(*_folders(seen))
            new = round_writers(frontier, reads, writes).join(seen.select("job"), "job", "left_anti")
            number += 1


def _folders(table: DataFrame) -> list[str]:
    """The folders that the files of a table lie in."""
    return sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()})


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


_MAX_PARTS = 16


def _with(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """Parts of the rounds so far; many of them are written together, so that deep graphs keep small plans."""
    parts = [*parts, new]
    return [materialize(_union(parts), "rounds")] if len(parts) > _MAX_PARTS else parts


def classify_jobs(access: DataFrame, jobs: DataFrame | None, connected: DataFrame) -> DataFrame:
    """``(job, status)``: ``connected``, ``data_dependent`` or ``dead``; of the jobs in ``access`` when ``jobs`` is None."""
    access = materialize(access.select("access", "job", "table_name"), "access")
    jobs = access if jobs is None else jobs
    needed = needed_jobs(access, connected).select(F.col("job").alias("_needed"))
    roots = connected.select(F.col("job").alias("_root")).distinct()
    flagged = (
        jobs.select("job").distinct()
        .join(roots, F.col("job") == F.col("_root"), "left")
        .join(needed, F.col("job") == F.col("_needed"), "left")
    )
    status = (
        F.when(F.col("_root").isNotNull(), "connected").when(F.col("_needed").isNotNull(), "data_dependent").otherwise("dead")
    )
    return flagged.select("job", status.alias("status"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, in_degree, out_degree, role)``; role is root, leaf, orphan or inner.

    Each edge end is one row of a grouped union, combined before the shuffle.
    """
    links = edges.select("src", "dst").distinct()
    ends = (
        links.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
        .unionAll(links.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        .unionAll(nodes.select(F.col(nodes.columns[0]).alias("node"), F.lit(0).alias("i"), F.lit(0).alias("o")))
    )
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    role = (
        F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "orphan")
        .when(F.col("in_degree") == 0, "root")
        .when(F.col("out_degree") == 0, "leaf")
        .otherwise("inner")
    )
    return out.withColumn("role", role)


def _chains(single: DataFrame) -> DataFrame:
    """``node, anchor, dist`` for nodes with one predecessor, ``node, up``: the nearest node before it that has none or several,
    and how far away it is. Nodes on or behind a cycle of such nodes are left out.

    By doubling: a path of n nodes takes log n rounds.
    """
    chain = materialize(single.select("node", F.col("up").alias("anchor"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")), "chains")
    total = chain.count()
    while True:
        before = chain.select(F.col("node").alias("_n"), F.col("anchor").alias("_a"), F.col("dist").alias("_d"), F.col("done").alias("_done"))
        joined = chain.join(before, ~F.col("done") & (F.col("anchor") == F.col("_n")), "left")
        chain = materialize(joined.select(
            "node", F.coalesce("_a", "anchor").alias("anchor"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"),
            (F.col("done") | F.col("_n").isNull() | F.col("_done")).alias("done"),
        ), "chains")
        # Whoever has passed as many nodes as there are goes round in a circle.
        if chain.where(~F.col("done") & (F.col("dist") <= total)).isEmpty():
            return chain.where("done").select("node", "anchor", "dist")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)``: longest distance from a root; NULL on or behind a cycle.

    A node with one predecessor lies one level below it, so lines and trees are measured by doubling and only nodes with several
    predecessors are peeled. These have a counter of the predecessors known so far: a round takes the nodes whose counter is
    full, follows their edges, which are stored once in buckets by source, and adds to the counters they reach. So a round
    handles its own nodes, their edges and counters that are not yet full. Runs when it is called.
    """
    spark = edges.sparkSession
    links = materialize(edges.select("src", "dst").distinct(), "links")
    named = nodes.select(F.col(nodes.columns[0]).alias("node"))
    ends = named.select("node", F.lit(0).alias("i"), F.lit(None).cast(links.schema["src"].dataType).alias("up"))
    ends = ends.unionAll(links.select("src", F.lit(0), F.lit(None))).unionAll(links.select("dst", F.lit(1), "src"))
    degree = materialize(ends.groupBy("node").agg(F.sum("i").alias("deg"), F.min("up").alias("up")), "degrees")
    chains = materialize(_chains(degree.where("deg = 1").select("node", "up")), "chains")
    several = links.join(degree.where("deg > 1").select(F.col("node").alias("dst"), "deg"), "dst")
    # An edge behind an unmeasured line has no anchor: it is lost here, and its target's counter never fills. Other nodes than
    # those on lines are their own anchors and need no lookup. Edges from one node to another, directly and behind lines, are
    # not put together here: the counters do that.
    lines = degree.where("deg = 1").join(chains, "node", "left").select(
        F.col("node").alias("src"), F.lit(True).alias("_line"), F.col("anchor").alias("_anchor"), F.col("dist").alias("_dist"))
    placed = several.join(lines, "src", "left").where(F.col("_line").isNull() | F.col("_anchor").isNotNull()).select(
        F.coalesce("_anchor", "src").alias("node"), "dst", "deg", F.lit(1).cast("long").alias("n"), (F.coalesce("_dist", F.lit(0)) + 1).cast("long").alias("w"))
    with StoredBy(spark) as store:
        stored = store.write(materialize(placed, "weighted"), "node", "links")
        ready = degree.where("deg = 0").select("node", F.lit(0).cast("long").alias("level"))
        done, waiting = [ready], None
        while True:
            reached = stored.matched(ready).select(F.col("dst").alias("node"), "n", (F.col("level") + F.col("w")).alias("level"), "deg")
            counted = reached if waiting is None else reached.unionAll(waiting)
            state = materialize(counted.groupBy("node", "deg").agg(F.sum("n").alias("n"), F.max("level").alias("level")), "counters")
            ready, waiting = state.where("n = deg").select("node", "level"), state.where("n < deg").select("node", "n", "level", "deg")
            if ready.isEmpty():
                break
            done = _with(done, ready)
    known = materialize(_union(done), "levels")
    below = chains.join(known.withColumnRenamed("node", "anchor"), "anchor").select("node", (F.col("level") + F.col("dist")).alias("level"))
    found = known.unionAll(below).select(F.col("node").alias("_n"), F.col("level").cast("int").alias("level"))
    return degree.join(found, F.col("node") == F.col("_n"), "left").select("node", "level")


def cycles(edges: DataFrame) -> DataFrame:
    """``node``: those on a cycle, or on a path from one cycle to another.

    What ``levels`` cannot reach from the roots is peeled from the leaves as well; nodes merely behind a cycle go.
    """
    stuck = levels(edges.select(F.col("src").alias("node")).limit(0), edges).where(F.col("level").isNull()).select("node")
    stuck = materialize(stuck, "stuck")
    inside = edges.select("src", "dst").distinct().join(stuck.select(F.col("node").alias("src")), "src", "left_semi")
    inside = materialize(inside.join(stuck.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "inside")
    back = levels(stuck, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return back.where(F.col("level").isNull()).select("node")


def max_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``max_depth``: the number of edges on the longest path from a root, NULL without any acyclic node.

    The largest of ``levels``, one row per node. Where a node can be reached by a short and a long path the long one
    counts; a breadth-first search from each root would take the short one, at one row per pair of root and node.
    """
    return levels(nodes, edges).agg(F.max("level").cast("bigint").alias("max_depth"))


def classify(
    df: DataFrame, column: str, exact: DataFrame, suffixes: DataFrame, fallback: str, name: str = "behavior"
) -> DataFrame:
    """Class of a name: exact entry, else the longest matching suffix, else ``fallback``.

    ``exact(name, class)`` and ``suffixes(suffix, class)``; the smallest class counts where a name or suffix has
    several. Names are classified once each; their endings up to the longest suffix join by equality.
    """
    # One class per name and per suffix: the smallest, where a table lists several.
    exact = exact.groupBy(F.col("name").alias("_name")).agg(F.min("class").alias("_exact"))
    endings = suffixes.groupBy(F.col("suffix").alias("_tail")).agg(F.min("class").alias("_class"))
    names = df.select(F.col(column).alias("_name")).where(F.col(column).isNotNull()).distinct()
    longest = suffixes.agg(F.coalesce(F.max(F.char_length("suffix")), F.lit(0)).alias("n")).scalar()
    sized = names.withColumn("_sizes", F.sequence(F.lit(0), F.least(F.char_length("_name"), longest)))
    tails = sized.select("_name", F.explode("_sizes").alias("_n")).select("_name", F.right(F.col("_name"), F.col("_n")).alias("_tail"))
    by_suffix = tails.join(endings, "_tail").groupBy("_name").agg(F.max_by("_class", F.char_length("_tail")).alias("_by_suffix"))
    classes = (
        names.join(exact, "_name", "left")
        .join(by_suffix, "_name", "left")
        .select("_name", F.coalesce("_exact", "_by_suffix", F.lit(fallback)).alias(name))
    )
    classes = recomputed(classes, ["_name"])
    return df.join(classes, F.col(column).eqNullSafe(F.col("_name")), "left").drop("_name").withColumn(
        name, F.coalesce(name, F.lit(fallback))
    )


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


# Classes outside the confidence measure, and those that need a person.
NOT_COUNTED = ("IGNORE", "OBSERVABILITY")
NOT_DETERMINISTIC = ("CUSTOM_CODE", "AI_REQUIRED")
MIN_CONFIDENCE = 0.5


def confidence(components: DataFrame) -> DataFrame:
    """Share of components per job that are handled by rule, in percent (100 when none count).

    Input columns: ``job``, ``behavior`` and ``confidence``.
    """
    counted = ~F.col("behavior").isin(*NOT_COUNTED)
    sure = counted & ~F.col("behavior").isin(*NOT_DETERMINISTIC) & (F.col("confidence") >= MIN_CONFIDENCE)
    out = components.groupBy("job").agg(F.count_if(counted).alias("total"), F.count_if(sure).alias("deterministic"))
    pct = F.when(F.col("total") > 0, F.col("deterministic") / F.col("total") * 100).otherwise(100.0)
    return out.withColumn("deterministic_pct", pct)


def expression_coverage(expressions: DataFrame, review_strategy: str = "LLM_REQUIRED") -> DataFrame:
    """Share of expressions per job that need no review; input ``job`` and ``strategy``."""
    review = F.count_if(F.col("strategy") == review_strategy)
    return expressions.groupBy("job").agg((1.0 - review / F.count("*")).alias("confidence"))


def dominant(df: DataFrame, keys: Sequence[str], column: str, order: str, name: str = "dominant") -> DataFrame:
    """Most frequent value per key; the one seen first in ``order`` wins a tie."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    # The larger count wins, then the earlier first appearance: min over (-count, first).
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct((-F.col("_n")).alias("n"), "_first")).alias(name))


def source_catalogue(sources: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per source: the last one in ``order``."""
    latest = sources.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.struct(*sources.columns), F.struct(*order)).alias("_row")
    )
    return latest.select("_row.*")

