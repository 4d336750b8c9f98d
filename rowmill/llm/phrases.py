"""Phrases of a test set in a corpus by a positional inverted index, in DataFrame functions only.

The index holds a posting ``(document, term, position)`` for every corpus token that is a term of the test items. Phrases
are looked up from their rarest terms: postings are moved by the term's place in the item, so that lists of one occurrence
agree in the place where the item would start, and are intersected by equality, the rarest list first. What is left are few
starts, for which all terms of the item are looked up in the index. Nothing is collected; the corpus is read once.

Documents are known by two 64-bit hashes of id and text, so ids may be NULL or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.session import materialize

# The characters of a word; A-Z are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["_k", "_l"]
# No word is empty, so the empty term carries the number of words of a document.
_LENGTH = ""
# Lists of this many terms of a window are intersected before all of its item's terms are compared.
LISTS = 2


def words(text: Column) -> Column:
    """The words of a text in order; NULL for a NULL text."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return named.withColumns({"_k": F.xxhash64("doc_id", "_text"), "_l": F.xxhash64("_text", "doc_id", F.lit(1))})


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, _item, o, term, size``: the terms of every item with words, written once.

    Repeated rows count once; items of one id and several texts are several ``_item`` of that id. A NULL id is an empty one.
    """
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words(F.col(text)).alias("_words"))
    named = named.where(F.size("_words") > 0).withColumn("_item", F.xxhash64("item_id", "_words")).dropDuplicates(["item_id", "_item"])
    return materialize(named.select("item_id", "_item", F.size("_words").alias("size"), F.posexplode("_words").alias("o", "term")), "items")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``doc_id, _k, _l, term, pos`` of the tokens that are in ``terms.term``, written once without a shuffle of
    the corpus where the terms are small, and one posting of the empty term per document with its number of words as ``pos``.
    """
    listed = F.coalesce(words(F.col("_text")), F.array().cast("array<string>"))
    tokens = _keyed(docs, doc_id, text).select("doc_id", *KEY, F.posexplode(F.concat(listed, F.array(F.lit(_LENGTH)))).alias("pos", "term"))
    wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(_LENGTH).alias("term"))).distinct()
    # The written list of terms has a known size, by which Spark decides whether to send it to all tasks.
    return materialize(tokens.join(materialize(wanted, "terms"), "term").select("doc_id", *KEY, "term", "pos"), "postings")


def lengths(index: DataFrame) -> DataFrame:
    """``doc_id, _k, _l, n_words`` per document of the index, repeated rows included."""
    return index.where(F.col("term") == _LENGTH).select("doc_id", *KEY, F.col("pos").cast("long").alias("n_words"))


def _counted(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The item terms with ``n``, how often the corpus has them."""
    counts = index.where(F.col("term") != _LENGTH).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _anchors(counted: DataFrame, window: int, lists: int) -> DataFrame:
    """``_item, _anchor, r, o, term``: places of the ``lists`` rarest terms of every window, the rarest first.

    Windows with a term that the corpus lacks are left out. Windows of one item with the same places are one anchor.
    """
    gathered = counted.groupBy("_item", "size").agg(F.sort_array(F.collect_list(F.struct("o", "n", "term"))).alias("_terms"))
    width = F.least(F.col("size"), F.lit(window))

    def rarest(s: Column) -> Column:
        inside = F.transform(F.slice("_terms", s + 1, width), lambda t: F.struct(t["n"].alias("n"), t["o"].alias("o"), t["term"].alias("term")))
        return F.slice(F.array_sort(inside), 1, lists)

    starts = F.transform(F.sequence(F.lit(0), F.col("size") - width), rarest)
    each = gathered.select("_item", F.explode(F.array_distinct(starts)).alias("_rarest")).where(F.col("_rarest")[0]["n"] > 0)
    named = each.withColumn("_anchor", F.xxhash64(F.transform("_rarest", lambda t: t["o"])))
    return named.select("_item", "_anchor", F.posexplode("_rarest").alias("r", "_t")).select("_item", "_anchor", "r", F.col("_t.o").alias("o"), F.col("_t.term").alias("term"))


def phrase_starts(index: DataFrame, counted: DataFrame, window: int = 10, lists: int = LISTS) -> DataFrame:
    """``_k, _l, _item, start``: where an item may lie in a document, by the rarest terms of its windows. May be negative
    when only a later part of the item is there."""
    anchors = materialize(_anchors(counted, window, lists), "anchors")
    most = anchors.groupBy("_item", "_anchor").agg((F.max("r") + 1).alias("_of"))
    on = [*KEY, "_item", "_anchor", "start"]
    found = None
    for r in range(lists):
        moved = index.join(anchors.where(F.col("r") == r), "term").select(*KEY, "_item", "_anchor", (F.col("pos") - F.col("o")).alias("start"))
        if found is None:
            found = moved
            continue
        # Anchors of short items have fewer terms and pass the later lists as they are.
        sized = found.join(most, ["_item", "_anchor"])
        found = sized.where(F.col("_of") > r).drop("_of").join(moved, on, "left_semi").unionByName(sized.where(F.col("_of") <= r).drop("_of"))
    return materialize(found.select(*KEY, "_item", "start").distinct(), "starts")


def phrase_words(index: DataFrame, terms: DataFrame, starts: DataFrame, window: int = 10) -> DataFrame:
    """``_k, _l, item_id, pos``: every document word in an occurrence of a window of an item, once per item."""
    some = materialize(starts.select(*KEY).distinct(), "suspects")
    near = index.join(some, KEY, "left_semi").select(*KEY, "term", "pos")
    due = starts.join(terms, "_item").select(*KEY, "item_id", "_item", "size", "start", "o", "term", (F.col("start") + F.col("o")).alias("pos"))
    same = due.join(near, [*KEY, "term", "pos"])
    lined = same.groupBy(*KEY, "item_id", "_item", "size", "start").agg(F.sort_array(F.collect_set("o")).alias("_o"))
    width = F.least(F.col("size"), F.lit(window))
    last = F.size("_o") - width
    # Places are distinct and sorted: a window is whole where width - 1 places on the place is larger by just that much.
    whole = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.get("_o", i + width - 1) - F.get("_o", i) == width - 1))
    held = F.array_distinct(F.flatten(F.transform(whole, lambda i: F.slice("_o", i + 1, width))))
    return lined.select(*KEY, "item_id", "start", F.explode(held).alias("o")).select(*KEY, "item_id", (F.col("start") + F.col("o")).alias("pos")).distinct()


def proximity_matches(index: DataFrame, counted: DataFrame, span: int = 30) -> DataFrame:
    """``_k, _l, item_id``: documents in which the three rarest terms of an item stand within ``span`` words, in any order.

    Rarest by occurrences in the corpus, then by term; terms the corpus lacks do not count, items with fewer terms match by
    those they have. Positions meet in cells of ``span`` words and the cell before and after, so no list is crossed whole.
    """
    ranked = Window.partitionBy("_item").orderBy("n", "term")
    lead = counted.where(F.col("n") > 0).select("item_id", "_item", "term", "n").distinct().withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= 3)
    lead = materialize(lead.select("item_id", "_item", "term", "r", F.count("*").over(Window.partitionBy("_item")).alias("_of")), "rarest")
    cell = lambda c: F.floor(F.col(c) / span).cast("int")
    on = [*KEY, "_item", "_cell"]

    def listed(r: int, around: bool) -> DataFrame:
        one = index.join(lead.where(F.col("r") == r), "term").select(*KEY, "item_id", "_item", "_of", "pos")
        cells = F.explode(F.array(cell("pos") - 1, cell("pos"), cell("pos") + 1)) if around else cell("pos")
        return one.withColumn("_cell", cells)

    found = listed(1, False).withColumns({"_low": F.col("pos"), "_high": F.col("pos")}).drop("pos")
    for r in (2, 3):
        more = listed(r, True).select(*on, F.col("pos").alias("_at")).distinct()
        wide = found.where(F.col("_of") >= r).join(more, on).withColumns({"_low": F.least("_low", "_at"), "_high": F.greatest("_high", "_at")})
        # Of all ways to the same first position and low end only the nearest high end can still matter.
        close = wide.where(F.col("_high") - F.col("_low") < span).groupBy(*on, "item_id", "_of", "_low").agg(F.min("_high").alias("_high"))
        found = close.unionByName(found.where(F.col("_of") < r))
    return found.select(*KEY, "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` of every document row.

    A window is ``window`` consecutive words of an item, or all of a shorter item. ``n_hit`` counts the document's words in
    occurrences of windows, ``n_items`` the item ids with one, ``items_sha256`` digests those ids, sorted and joined with
    commas. ``n_near`` counts the ids by ``proximity_matches``. NULL and empty texts have no words; repeated rows each give
    their row; a table without items, or without documents, gives rows without hits, or no rows.
    """
    terms = item_terms(items, item_id, item_text)
    index = build_index(docs, terms, doc_id, text)
    counted = materialize(_counted(index, terms), "counted")
    hits = materialize(phrase_words(index, terms, phrase_starts(index, counted, window), window), "hits")
    per_word = hits.groupBy(*KEY, "pos").agg(F.lit(1).alias("_one")).groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    per_item = hits.groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("_ids"))
    near = proximity_matches(index, counted).groupBy(*KEY).agg(F.count("*").alias("n_near"))
    out = lengths(index).join(per_word, KEY, "left").join(per_item, KEY, "left").join(near, KEY, "left")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", number(F.col("n_hit")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (number(F.col("n_hit")) > 0).alias("contaminated"), number(F.col("n_near")).alias("n_near"),
    )
