"""The text operators over their whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rowmill.llm import chat, lattice, licences, packing, phrases, pieces, pitman_yor, quality, simhash, toxicity, trie, urls, variants
from rowmill.llm.registry import query
from rowmill.session import materialize

# Host rules of the URL filter.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# A conversation whose texts are made of control strings.
PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def tokenizer_path(name: str) -> str:
    """A public vocabulary file of the ``public_tokenizers`` package, or of the folder ROWMILL_TOKENIZERS."""
    folder = os.environ.get("ROWMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def held(remainder: int, of: int):
    """Whether crc32(doc_id as text) leaves this remainder; a NULL id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))


def text_toxicity(t, docs):
    """Score ``docs`` by the labels that are not held out."""
    labels = t.labels.where(~held(1, 3)).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    return toxicity.toxicity(docs, labels)


OP1_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'),
    '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS safe
  FROM src
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || role || '<|text|>' || safe || '<|end|>')) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""


@query("op1_chat_formatting", OP1_SQL)
def chat_formatting(t):
    rows = chat.turns_from_rows(t.conversations)
    # The extra conversation comes as a record of another layout and finds its mapping by its fingerprint.
    _, turns = chat.turns_from_records(F.lit(PROBE))
    probe = t.spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), turns.alias("turns"))
    out = chat.format_turns(rows.unionByName(probe)).select("conv_id", "formatted", "loss_spans")
    back = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    lines = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.withColumns({"_turns": back, "_loss": loss}).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op4_url_filter")
def url_filter(t):
    # Labels carry the quality of the page with the same number.
    labels = t.labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    out = urls.filter_urls(t.pages, labels, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "confidence")


@query("op5_simhash")
def simhash_duplicates(t):
    return simhash.near_duplicates(t.documents)


@query("op7_packing")
def packing_windows(t):
    return packing.pack_documents(t.documents, tokenizer_path("word_bpe_49k.json"))


@query("op8_quality_rules")
def quality_rules(t):
    return quality.quality_rules(t.documents.select("doc_id", "text")).drop("text")


@query("op10_toxicity")
def toxicity_scores(t):
    out = text_toxicity(t, t.documents.select("doc_id", "text"))
    return out.select("doc_id", held(1, 3).alias("held_out"), "score", "predicted")


@query("op2_lattice_duplicates")
def lattice_duplicates(t):
    return lattice.near_vectors(t.embeddings)


@query("op3_license_digests")
def license_digests(t):
    found = licences.find_licenses(t.documents.select("doc_id", "text"), licences.known_digests(t.spark))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


@query("op6_sentencepiece")
def sentencepiece_round_trip(t):
    path = tokenizer_path("piece_bpe_32k.model")
    coded = pieces.encode_texts(t.documents.select("doc_id", "text"), path)
    back = pieces.decode_ids(coded, path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


@query("op9_pitman_yor")
def pitman_yor_scores(t):
    return pitman_yor.score_texts(t.documents.select("doc_id", "text"), held(2, 7))


# CRC-32 in SQL: a table of 256 entries, then one step per byte of a text given in hex digits.
CRC_TABLE = """crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text, where the column ``t`` of the table ``crc`` is in reach."""
    digits = f"hex(encode({text}))"
    byte = f"list_transform(range(1, length({digits}) + 1, 2), lambda k: CAST('0x' || substr({digits}, k, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP13_SQL = r"""
WITH RECURSIVE {crc},
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL
), marked AS (SELECT run, k, {h} AS h FROM runs, crc),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM marked)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cuts AS (
  SELECT word, n, j, substr(word, 1, j - 1) || substr(word, j + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (cut, j) WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.cut
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS m, min_by(other, (-other_n, other)) AS other FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root, form AS up FROM formed
  UNION ALL SELECT c.word, c.up, f.form FROM chain c JOIN formed f ON f.word = c.up
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.up IS NULL
"""


@query("op13_spelling_variants", OP13_SQL.replace("{crc}", CRC_TABLE).replace("{h}", crc32_sql("doc_id || ':' || run")))
def spelling_variants(t):
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = t.documents.select(named.alias("_id"), F.explode(variants.letter_runs(F.col("text"))).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    # One letter is taken out of every 97th run, so that there are misspellings to find.
    word = F.when(h % 97 == 0, variants.without_letter(F.col("_run"), h % F.char_length("_run"))).otherwise(F.col("_run"))
    return variants.spelling_forms(variants.count_words(runs.select(word.alias("word"))))


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, CAST(least(len(w), 10) AS BIGINT) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM sized)),
gram AS (SELECT d, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT d, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, (SELECT DISTINCT k FROM sized))),
occ AS (SELECT d, item_id, s, k FROM gram JOIN win USING (k, g)),
hit AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(s, s + k)) AS p FROM occ) GROUP BY d),
ids AS (SELECT d, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT d, item_id FROM occ) GROUP BY d),
tok AS (SELECT d, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM doc),
freq AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
lead AS (
  SELECT i, item_id, term, row_number() OVER (PARTITION BY i ORDER BY n, term) AS r, count(*) OVER (PARTITION BY i) AS c
  FROM (SELECT DISTINCT i, item_id, t AS term FROM (SELECT row_number() OVER () AS i, item_id, unnest(w) AS t FROM (SELECT item_id, w FROM sized)) JOIN freq ON t = term)
  JOIN freq USING (term)
), post AS (SELECT d, i, item_id, r, c, p FROM tok JOIN lead USING (term) WHERE r <= 3),
near AS (
  SELECT a.d, a.item_id FROM post a WHERE a.c = 1
  UNION SELECT a.d, a.item_id FROM post a JOIN post b ON a.d = b.d AND a.i = b.i AND a.r = 1 AND b.r = 2 AND abs(a.p - b.p) < 30 WHERE a.c = 2
  UNION SELECT a.d, a.item_id FROM post a JOIN post b ON a.d = b.d AND a.i = b.i AND a.r = 1 AND b.r = 2 AND abs(a.p - b.p) < 30
    JOIN post c ON a.d = c.d AND a.i = c.i AND c.r = 3 AND greatest(a.p, b.p, c.p) - least(a.p, b.p, c.p) < 30
), nears AS (SELECT d, count(*) AS n_near FROM near GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc LEFT JOIN hit USING (d) LEFT JOIN ids USING (d) LEFT JOIN nears USING (d)
"""


@query("op12_decontamination", OP12_SQL)
def decontamination(t):
    return phrases.contamination(t.documents, t.benchmark)


OP11_SQL = r"""
WITH {crc},
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {'r': role, 't': text} AS v
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), conv AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {h} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
whole AS (
  SELECT conv_id, list(v ORDER BY part, p) AS v FROM (
    SELECT c.conv_id, 0 AS part, o.p, o.v FROM conv c JOIN own o ON o.conv_id = c.base AND o.p <= c.h
    UNION ALL SELECT c.conv_id, 1, o.p, o.v FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.p > c.h)
  GROUP BY conv_id
), full_ AS (SELECT conv_id, coalesce(v, []) AS v FROM conv LEFT JOIN whole USING (conv_id)),
pre AS (SELECT conv_id, v, len(v) AS size, unnest(range(0, len(v) + 1)) AS depth FROM full_),
keyed AS (SELECT conv_id, depth, size, md5(CAST(v[1:depth] AS VARCHAR)) AS k, md5(CAST(v[1:depth - 1] AS VARCHAR)) AS pk, coalesce(length(v[depth].t), 0) AS chars FROM pre),
node AS (
  SELECT k, depth, min(conv_id) AS conv_id, any_value(pk) AS pk, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256
  FROM keyed GROUP BY k, depth
), kids AS (SELECT pk AS k, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT a.k, a.depth, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM node n JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids c ON c.k = n.k AND c.depth = n.depth GROUP BY a.k, a.depth
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n LEFT JOIN node p ON n.depth > 0 AND p.k = n.pk AND p.depth = n.depth - 1 LEFT JOIN kids c ON c.k = n.k AND c.depth = n.depth
JOIN sums s ON s.k = n.k AND s.depth = n.depth
"""


@query("op11_prefix_trie", OP11_SQL.replace("{crc}", CRC_TABLE).replace("{h}", crc32_sql("CAST(conv_id AS VARCHAR)")))
def prefix_trie(t):
    own = materialize(trie.numbered_turns(t.conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    lengths = own.groupBy("conv_id").agg(F.max("p").alias("_n"))
    shared = own.where((F.col("conv_id") % 100 == 0) & (F.col("p") <= 5)).withColumnRenamed("conv_id", "base")
    first = shared.groupBy("base").agg(F.max("p").alias("_first"))
    convs = lengths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h}).join(first, "base", "left")
    convs = materialize(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("_first", F.lit(0))).alias("_head")), "conversations")
    heads = convs.join(shared, "base").where(F.col("p") <= F.col("h"))
    rest = own.join(convs, "conv_id").where(F.col("p") > F.col("h")).withColumn("p", F.col("p") - F.col("h") + F.col("_head"))
    parts = [x.select("conv_id", F.col("p").cast("long").alias("depth"), "chars", "_y1", "_y2") for x in (heads, rest)]
    return trie.prefix_trie(parts[0].union(parts[1]), convs.select("conv_id"))
