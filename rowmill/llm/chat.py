"""Chat formatting by schema fingerprint, in DataFrame functions only.

A record's nested field paths are hashed; the hash selects a declarative mapping into canonical turns
``array<struct<role, text>>``. The mapping with the most paths is taken of those whose paths are all there (ties: the
first of ``LAYOUTS``), so extra fields do no harm, whether another mapping knows them or not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role: string, text: string>>"
# Role names that other layouts use, and the canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# Strings with a meaning for some chat template. ``<|`` opens every marker of our own.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN_MARK, TEXT_MARK, END_MARK = "<|turn|>", "<|text|>", "<|end|>"


@dataclass(frozen=True)
class Layout:
    """``fields``: (role, field name) in turn order. ``items``: the array field, its role and text fields."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    paths: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        found = [f for _, f in self.fields]
        if self.items:
            found += [f"{self.items[0]}[].{f}" for f in self.items[1:]]
        object.__setattr__(self, "paths", tuple(sorted(found)))


LAYOUTS = (
    Layout("messages", items=("messages", "role", "content")),
    Layout("messages_text", items=("messages", "role", "text")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("turns", items=("turns", "role", "text")),
    Layout("system_messages", fields=(("system", "system"),), items=("messages", "role", "content")),
    Layout("system_messages_text", fields=(("system", "system"),), items=("messages", "role", "text")),
    Layout("system_conversations", fields=(("system", "system"),), items=("conversations", "from", "value")),
    Layout("system_turns", fields=(("system", "system"),), items=("turns", "role", "text")),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction_response", fields=(("user", "instruction"), ("assistant", "response"))),
    Layout("instruction_input_response", fields=(("user", "instruction"), ("user", "input"), ("assistant", "response"))),
    Layout("system_instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("system_instruction_input", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_instruction_response", fields=(("system", "system"), ("user", "instruction"), ("assistant", "response"))),
    Layout("system_instruction_input_response", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "response"))),
    Layout("completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("system_question", fields=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Layout("turn_rows", fields=(("", "role"), ("", "text"), ("", "turn"))),
)
_TOP = sorted({f for x in LAYOUTS for _, f in x.fields})
_ITEMS = sorted({x.items[0] for x in LAYOUTS if x.items})


def path_hash(paths: Column) -> Column:
    """Hash of a sorted array of field paths."""
    return F.xxhash64(F.concat_ws("\n", paths))


def _ranked(layouts: tuple[Layout, ...]) -> list[Layout]:
    """The most specific first; layouts with as many paths stay in their order."""
    return sorted(layouts, key=lambda x: -len(x.paths))


def _by_turn(layout: Layout) -> bool:
    """Rows by turn are one turn per record; they are grouped, not mapped."""
    return any(role == "" for role, _ in layout.fields)


def _below(name: str, fields: Column) -> Column:
    return F.transform(fields, lambda f: F.concat(F.lit(f"{name}[]."), f))


def record_fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Fingerprint of the most specific layout whose paths a VARIANT record has, nested ones below arrays included.

    NULL if it has all paths of none.
    """
    keys = lambda v: F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")), F.array().cast("array<string>"))
    found = keys(record)
    for name in _ITEMS:
        elements = F.coalesce(F.try_variant_get(record, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        inner = F.array_distinct(F.flatten(F.transform(elements, keys)))
        found = F.concat(found, _below(name, inner))

    def first(paths: Column) -> Column:
        marks = []
        for x in _ranked(layouts):
            own = path_hash(F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in x.paths]))))
            marks.append(F.when(own == layout_fingerprint(x), own))
        return F.coalesce(*marks)

    # A lambda over one item, so that the paths are listed once.
    return F.get(F.transform(F.array(found), first), F.lit(0))


def layout_fingerprint(layout: Layout) -> Column:
    return path_hash(F.array(*[F.lit(p) for p in layout.paths]))


def _canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    pairs = [F.lit(x) for kv in ROLES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(role)), role)


def _mapped(record: Column, layout: Layout) -> Column:
    turns = []
    for role, name in layout.fields:
        text = F.try_variant_get(record, f"$.{name}", "string")
        turns.append(F.when(text.isNotNull(), F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))))
    if layout.items:
        name, role, text = layout.items
        items = F.try_variant_get(record, f"$.{name}", f"array<struct<`{role}`: string, `{text}`: string>>")
        turns.append(F.transform(items, lambda x: F.struct(_canonical_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))))
    empty = F.array().cast(TURN)
    return F.concat(*[F.coalesce(t.cast(TURN), empty) for t in turns])


def turns_from_records(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(layout name, turns) of a JSON text. Text that is no JSON or has no known layout gives NULL for both."""
    parsed = F.try_parse_json(record)
    layouts = tuple(x for x in layouts if not _by_turn(x))
    mark = record_fingerprint(parsed, layouts)
    name = turns = None
    for x in layouts:
        hit = parsed.isNotNull() & (mark == layout_fingerprint(x))
        name = F.when(hit, x.name) if name is None else name.when(hit, x.name)
        turns = F.when(hit, _mapped(parsed, x)) if turns is None else turns.when(hit, _mapped(parsed, x))
    return name, turns


def table_layout(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The most specific layout whose paths are all among those of the table's columns. The schema is known on the
    driver, so the paths themselves are compared."""
    paths = []
    for f in df.schema.fields:
        paths.append(f.name)
        inner = getattr(f.dataType, "elementType", None)
        paths += [f"{f.name}[].{g.name}" for g in getattr(inner, "fields", [])]
    return next((x for x in _ranked(layouts) if set(x.paths) <= set(paths)), None)


def turns_from_rows(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation from one row per turn: ``conversation, turns``.

    Rows go by turn, then role and text; NULL turns come first, NULL role and text count as empty. Roles stay as they
    are: such rows are canonical already, only records of other layouts have their role names mapped. A conversation is one
    value of the result, so its rows meet in one task; the table as a whole does not.
    """
    if table_layout(df, tuple(x for x in LAYOUTS if _by_turn(x))) is None:
        raise ValueError(f"no layout of rows by turn: {df.columns}")
    empty = F.lit("")
    row = F.struct(F.col("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    gathered = df.groupBy(F.col(conversation)).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    turn = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    return gathered.select(conversation, F.transform("_rows", turn).alias("turns"))


def escape(text: Column) -> Column:
    """Double backslashes, then one after the first character of every control string. ``unescape`` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (start and length in code points of each assistant text in it)."""
    safe = F.transform(turns, lambda x: F.struct((x["role"] == "assistant").alias("loss"), escape(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    head = lambda x: F.concat(F.lit(TURN_MARK), x["role"], F.lit(TEXT_MARK))
    staged = df.withColumn("_safe", safe)
    formatted = F.array_join(F.transform("_safe", lambda x: F.concat(head(x), x["text"], F.lit(END_MARK))), "")
    sized = F.transform("_safe", lambda x: F.struct(x["loss"].alias("loss"), F.char_length(head(x)).cast("long").alias("head"), F.char_length(x["text"]).cast("long").alias("text")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))
    span = lambda a, x: F.struct((a["at"] + x["head"]).alias("start"), x["text"].alias("length"))
    spans = F.aggregate(
        sized, zero,
        lambda a, x: F.struct(
            (a["at"] + x["head"] + x["text"] + F.lit(len(END_MARK))).alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(span(a, x)))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return staged.withColumns({"formatted": formatted, "loss_spans": spans}).drop("_safe")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.split(formatted, r"<\|turn\|>")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda x: F.substr(x, F.char_length(F.substring_index(x, TEXT_MARK, 1)) + F.lit(len(TEXT_MARK) + 1))
    text = lambda x: F.substring_index(body(x), END_MARK, 1)
    return F.transform(rest, lambda x: F.struct(unescape(F.substring_index(x, TEXT_MARK, 1)).alias("role"), unescape(text(x)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Everything under the loss mask, unescaped, in order."""
    piece = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, piece), "")
