import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmill.llm import chat, load

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def formatted(spark, rows, schema=SCHEMA):
    return chat.format_turns(chat.turns_from_rows(spark.createDataFrame(rows, schema)))


def test_round_trip_of_odd_texts(spark, odd_texts):
    rows = [(i, j, role, t) for i, t in enumerate(odd_texts) for j, role in enumerate(["user", "assistant", None, "a<|text|>b\n"])]
    out = formatted(spark, rows).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    found = {r.conv_id: r for r in out.collect()}
    assert len(found) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        assert [(x.role, x.text) for x in found[i].t] == [(r or "", t or "") for r in ["user", "assistant", None, "a<|text|>b\n"]]
        assert found[i].loss == (t or "")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<|>\\/s[INST]endtur\n é", max_size=30), min_size=1, max_size=20))
def test_control_strings_do_not_survive_in_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in chat.CONTROL) for r in rows)


def test_ties_nulls_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", "b", 7), (1, 0, "user", "a", 8), (1, 0, "user", "a", 9), (1, None, "system", "first", 1), (None, 0, "assistant", None, 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int")
    out = {r.conv_id: r.turns for r in chat.turns_from_rows(df).collect()}
    assert [(t.role, t.text) for t in out[1]] == [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in out[None]] == [("assistant", "")]


def test_empty_table(spark):
    assert formatted(spark, []).count() == 0


def test_table_without_a_known_layout(spark):
    with pytest.raises(ValueError):
        chat.turns_from_rows(spark.createDataFrame([(1, "x")], "conv_id int, body string"))


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 4}, "messages", [("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "system_conversations", [("system", "s"), ("user", "q")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction_input", [("user", "do"), ("user", "this"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "source": {"prompt": 1}}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"nothing": "known"}, None, None),
    ([1, 2], None, None),
    ("text", None, None),
]


def test_fingerprints_select_mappings(spark):
    df = spark.createDataFrame([(json.dumps(r),) for r, _, _ in RECORDS] + [("{not json",), (None,), ("",)], "record string")
    name, turns = chat.turns_from_records(F.col("record"))
    rows = {r.record: r for r in df.select("record", name.alias("name"), turns.alias("turns")).collect()}
    for record, layout, want in RECORDS:
        got = rows[json.dumps(record)]
        assert got.name == layout
        assert (got.turns and [(t.role, t.text) for t in got.turns]) == want
    assert all(rows[k].name is None and rows[k].turns is None for k in ("{not json", None, ""))


def test_query_has_no_python_and_agrees_with_sql(spark, sf):
    queries, sql = load()
    df = queries["op1_chat_formatting"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(sql["op1_chat_formatting"])
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
    probe = df.where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert probe.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and probe.loss_chars == len(text) and probe.n_turns == 2


EXTRA_KNOWN = [
    ({"instruction": "do", "input": "this", "output": "done", "text": "all"}, "instruction_input", [("user", "do"), ("user", "this"), ("assistant", "done")]),
    ({"prompt": "q", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "instruction": "do", "output": "done"}, "system_instruction", [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "response": "done"}, "instruction_input_response", [("user", "do"), ("user", "this"), ("assistant", "done")]),
    ({"system": "s", "question": "q", "answer": "a", "role": "x", "turn": 1}, "system_question", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"system": "s", "turns": [{"role": "user", "text": "q"}], "text": "t"}, "system_turns", [("system", "s"), ("user", "q")]),
    ({"role": "user", "text": "q", "turn": 1}, None, None),
]


def test_extra_names_that_other_layouts_know(spark):
    df = spark.createDataFrame([(json.dumps(r),) for r, _, _ in EXTRA_KNOWN], "record string")
    name, turns = chat.turns_from_records(F.col("record"))
    rows = {r.record: r for r in df.select("record", name.alias("name"), turns.alias("turns")).collect()}
    for record, layout, want in EXTRA_KNOWN:
        got = rows[json.dumps(record)]
        assert (got.name, got.turns and [(t.role, t.text) for t in got.turns]) == (layout, want)


@pytest.mark.parametrize("extra", ["system", "prompt", "input", "output", "response"])
def test_tables_with_names_that_other_layouts_know(spark, extra):
    df = spark.createDataFrame([(1, 1, "gpt", "a", "x"), (1, 0, "human", "q", "x")], f"{SCHEMA}, {extra} string")
    out = chat.turns_from_rows(df).collect()
    assert [(t.role, t.text) for t in out[0].turns] == [("human", "q"), ("gpt", "a")]


def test_table_layout_is_the_most_specific(spark):
    items = "messages array<struct<role: string, content: string>>"
    layout = lambda schema: chat.table_layout(spark.createDataFrame([], schema)).name
    assert layout(f"prompt string, {items}") == "messages"
    assert layout(f"system string, text string, {items}") == "system_messages"
    assert layout(f"{SCHEMA}, system string, prompt string") == "turn_rows"


def test_roles_of_rows_stay_as_they_are(llm, tmp_path):
    """Role names that records map, in any case, against the SQL of the query."""
    import oracle

    rows = [(i, 0, role, "ask") for i, role in enumerate(["human", "GPT", "Assistant", "gpt", "assistant", "bot", "", None])]
    rows += [(i, 1, "assistant", "say") for i in range(4)] + [(9, None, "model", None), (9, 2, "assistant", "")]
    llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    queries, sql = load()
    assert oracle.compare(llm, con, str(tmp_path), queries["op1_chat_formatting"], sql["op1_chat_formatting"]) == []
