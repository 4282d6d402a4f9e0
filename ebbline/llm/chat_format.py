r"""Chat formatting in DataFrame expressions only: any layout -> canonical turns -> one template with a loss mask.

Layouts are told apart by a fingerprint: the md5 of their sorted nested field paths. A table's fingerprint comes from its
schema, a JSON record's from the schema of its variant. The fingerprint selects a declarative mapping (LAYOUTS).

Template, per turn: ``<|im_start|>role\ntext<|im_end|>\n``. A control string inside a text gets one more backslash after
its first character (``</s>`` -> ``<\/s>``, ``<\/s>`` -> ``<\\/s>``), so no text can open or close a turn, and taking one
backslash away again restores every text. In roles a backslash becomes ``\b`` and a newline ``\n`` as well.

The loss mask has a run per turn: so many code points before the learned text, its own, and those after it. Whatever is
done to a conversation is done turn by turn, so its cost grows with its length and not with the square of it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: The control strings of common chat templates, split after their first character.
CONTROL_REST = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|</?SYS>>|/?INST\]"
ESCAPE = rf"([<\[])(\\*)({CONTROL_REST})"
UNESCAPE = rf"([<\[])(\\*)\\({CONTROL_REST})"

_TURNS = "array<struct<role:string,text:string>>"
#: Declarative mappings by name. rows: one turn a row. array: a list of turns at a path, with the names of its role and
#: text fields. fields: one turn from each (role, paths); the paths' texts that are there are joined by newlines.
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"paths": ["conv_id", "role", "text", "turn"], "rows": {"conversation": "conv_id", "order": "turn", "role": "role", "text": "text"}},
    "messages": {"paths": ["messages[].content", "messages[].role"], "array": ("messages", "role", "content")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "array": ("conversations", "from", "value")},
    "prompt_completion": {"paths": ["completion", "prompt"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction_output": {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input_output": {"paths": ["input", "instruction", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "question_answer": {"paths": ["answer", "question"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
}
#: Other names of roles, in records; the roles of turn rows stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Sorted nested paths of the leaves; a list's element is marked by []."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    return field_paths(schema.elementType, at + "[]") if isinstance(schema, T.ArrayType) else [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


_BY_PRINT = {fingerprint(x["paths"]): name for name, x in LAYOUTS.items()}


def table_layout(schema: T.StructType) -> str:
    """The layout with the schema's fingerprint, or else the one that uses most of its paths; ValueError if none fits."""
    paths = field_paths(schema)
    if name := _BY_PRINT.get(fingerprint(paths)):
        return name
    fits = [(len(x["paths"]), name) for name, x in LAYOUTS.items() if set(x["paths"]) <= set(paths)]
    if not fits:
        raise ValueError(f"no layout fits the fields {paths}")
    return max(fits)[1]


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(names[role], role, F.lit(""))


def _from_fields(fields: list, get) -> Column:
    turns = []
    for role, paths in fields:
        text = F.concat_ws("\n", *[F.when(get(p) != "", get(p)) for p in paths])
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != "")).cast(_TURNS)


def _from_array(turns: Column, role: str, text: str) -> Column:
    return F.transform(F.coalesce(turns, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), lambda t: F.struct(_role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))).cast(_TURNS)


def canonical_turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns array<struct<role,text>>) from a table in any layout of LAYOUTS, chosen by its schema's fingerprint.

    Turn rows are ordered by their turn number, equal numbers by role and text, nulls first; their roles are kept as
    they are, while records' roles get their canonical names (ROLES). Null roles and texts are empty texts, also inside
    arrays; a null turn inside an array is an empty text of an empty role, a null array has no turns. Further columns are ignored. Collecting a conversation's rows is what the result asks for: a formatted
    conversation is one text.
    """
    name = table_layout(records.drop(id_col).schema if "conv_id" not in records.columns or id_col != "conv_id" else records.schema)
    layout = LAYOUTS[name]
    if "rows" in layout:
        c = layout["rows"]
        row = F.struct(F.col(c["order"]).alias("at"), F.coalesce(F.col(c["role"]), F.lit("")).alias("role"), F.coalesce(F.col(c["text"]), F.lit("")).alias("text"))
        kept = records.groupBy(F.col(c["conversation"]).alias(id_col)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
        return kept.select(id_col, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if "array" in layout:
        path, role, text = layout["array"]
        return records.select(id_col, _from_array(F.col(path), role, text).alias("turns"))
    return records.select(id_col, _from_fields(layout["fields"], lambda p: F.coalesce(F.col(p), F.lit(""))).alias("turns"))


def canonical_json_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, layout, turns) from JSON records of mixed layouts, each told by its own fingerprint.

    The schema of the record's variant, without its types, is hashed and looked up. Records that no fingerprint
    matches, null and malformed ones have a null layout and no turns.
    """
    value = F.try_parse_json(json_col)
    shape = F.regexp_replace(F.regexp_replace(F.expr("schema_of_variant(__value)"), r": (VOID|STRING|BOOLEAN|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))", ": _"), " ", "")
    names = {hashlib.md5(_variant_shape(x["paths"]).encode()).hexdigest(): n for n, x in LAYOUTS.items() if "rows" not in x}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    turns = F.lit(None).cast(_TURNS)
    for name, x in LAYOUTS.items():
        if "array" in x:
            path, role, text = x["array"]
            made = _from_array(F.expr(f"try_variant_get(__value, '$.{path}', 'array<struct<`{role}`:string,`{text}`:string>>')"), role, text)
        elif "fields" in x:
            made = _from_fields(x["fields"], lambda p: F.coalesce(F.expr(f"try_variant_get(__value, '$.{p}', 'string')"), F.lit("")))
        else:
            continue
        turns = F.when(F.col("layout") == name, made).otherwise(turns)
    rows = records.select(id_col, value.alias("__value")).withColumn("layout", lookup[F.md5(shape)])
    return rows.select(id_col, "layout", F.coalesce(turns, F.array().cast(_TURNS)).alias("turns"))


def _variant_shape(paths: list[str]) -> str:
    """What schema_of_variant says of such paths, types and spaces aside."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})
    show = lambda t: "OBJECT<" + ",".join(f"{k.removesuffix('[]')}:" + (f"ARRAY<{show(v)}>" if k.endswith("[]") else "_") for k, v in sorted(t.items())) + ">"
    return show(tree)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


#: Turns that offsets are summed up over at once.
_BLOCK = 256


def _offsets(sizes: Column) -> Column:
    """The sum of all numbers before each one: inside blocks of _BLOCK, then over the blocks."""
    none = F.array().cast("array<bigint>")

    def before(numbers: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("all"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        return F.aggregate(numbers, start, step, lambda a: a["all"])

    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"), F.lit(0))), lambda i: F.slice(sizes, i * _BLOCK + 1, F.lit(_BLOCK)))
    starts = before(F.transform(blocks, total))
    return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.transform(before(block), lambda x: x + at)))


def format_chat(turns: DataFrame, id_col: str = "conv_id", learned: str = "assistant") -> DataFrame:
    """(id_col, formatted, loss_runs, loss_spans): the conversation in the template and its loss mask, in code points.

    loss_runs array<struct<before:long,learned:long,after:long>> has a run for each turn, which together cover the text.
    loss_spans array<struct<start:long,end:long>> has the range of each text of role `learned`, without its markers, in
    order. No turns: an empty text, no runs and no spans.
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned).alias("learn")))
    rows = turns.select(id_col, parts.alias("__parts"))
    tail = F.lit(END + "\n")

    def run(p: Column) -> Column:
        head, body, rest = F.length(p["head"]).cast("long"), F.length(p["body"]).cast("long"), F.lit(len(END) + 1).cast("long")
        return F.struct(F.when(p["learn"], head).otherwise(head + body + rest).alias("before"), F.when(p["learn"], body).otherwise(0).alias("learned"), F.when(p["learn"], rest).otherwise(0).alias("after"))

    whole = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], tail)), "")
    rows = rows.select(id_col, "__parts", whole.alias("formatted"), F.transform("__parts", run).alias("loss_runs"))
    starts = _offsets(F.transform("loss_runs", lambda r: r["before"] + r["learned"] + r["after"]))
    spans = F.zip_with("loss_runs", starts, lambda r, at: F.struct((at + r["before"]).alias("start"), (at + r["before"] + r["learned"]).alias("end"), (r["after"] > 0).alias("learn")))
    spans = F.transform(F.filter(spans, lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(id_col, "formatted", "loss_runs", spans.alias("loss_spans"))


def _pieces(formatted: Column) -> Column:
    """The turns' parts of a formatted conversation, without their ends."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    inner = F.transform(_pieces(formatted), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(inner, lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))


def loss_text(formatted: Column, runs: Column) -> Column:
    """All text under the loss mask (loss_runs), unescaped, nothing between."""
    return F.array_join(F.zip_with(_pieces(formatted), runs, lambda p, r: unescape(F.substr(p, (r["before"] + 1).cast("int"), r["learned"].cast("int")))), "")
