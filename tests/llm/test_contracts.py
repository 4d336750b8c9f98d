"""The registered queries on the test tables: names, types, one row where one is due, and plans without products."""

import zlib

import pytest

from rowmill.llm import load

QUERIES, SQL = load()
COLUMNS = {
    "op1_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op2_lattice_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_license_digests": "doc_id bigint, n_licenses bigint, licenses string",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_sentencepiece": "doc_id bigint, n_ids bigint, round_trip boolean",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_pitman_yor": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint",
    "op13_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_rows_and_plan(llm, sf, name):
    df = QUERIES[name](llm, sf)
    kinds = dict(df.dtypes)
    for part in COLUMNS[name].split(", "):
        column, kind = part.split(" ")
        assert kinds[column] == kind
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
    table = {"op1": "conversations", "op2": "embeddings", "op4": "pages"}.get(name.split("_")[0], "documents")
    source = llm.read.parquet(f"{sf}/{table}.parquet")
    rows = df.collect()
    if name == "op1_chat_formatting":
        assert len(rows) == source.select("conv_id").distinct().count() + 1
    elif name not in ("op7_packing", "op11_prefix_trie", "op13_spelling_variants"):
        assert len(rows) == source.count()
    if name == "op6_sentencepiece":
        assert all(r.round_trip for r in rows)
    if name in ("op9_pitman_yor", "op10_toxicity"):
        of, remainder = (7, 2) if name == "op9_pitman_yor" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == remainder) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(llm, sf, name):
    import oracle

    assert oracle.compare(llm, oracle.connect(sf), sf, QUERIES[name], SQL[name]) == []
