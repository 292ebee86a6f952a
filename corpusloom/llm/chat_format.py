"""Chat formatting by schema fingerprints. Native: DataFrame functions alone.

Records arrive in several layouts: one row per turn, message arrays under several names, instruction or prompt columns,
or JSON text. The sorted nested field paths of a layout are hashed; the fingerprint selects a declarative mapping to
canonical turns (role, text). A table has one fingerprint, from its schema; JSON rows have one each, from their keys.

The template puts each turn between marks and escapes control strings inside texts with a backslash code, so that a
mark in the output is always the template's own and every text can be read back.

Defined results: null text and null role count as empty; rows of one turn number are ordered by role, then text; an
empty table gives no rows; columns that no mapping names are ignored. A conversation is one output string, so its turns
meet in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of the template.
OPEN, CLOSE = "<|turn|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Roles by the names that layouts give them; any other name stays as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


# ---- fingerprints


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted nested field paths; an array adds [] to its path."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _messages(array: str, role: str, text: str) -> Column:
    return F.transform(F.col(array), lambda m: F.struct(m[role].cast("string").alias("role"), m[text].cast("string").alias("text")))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _pair(prompt: str, answer: str) -> Column:
    return F.array(_turn("user", F.col(prompt)), _turn("assistant", F.col(answer)))


def _instruction(with_input: bool, with_system: bool = False) -> Column:
    ask = F.col("instruction")
    if with_input:
        ask = F.when(F.coalesce(F.col("input"), F.lit("")) != "", F.concat_ws("\n\n", "instruction", "input")).otherwise(F.col("instruction"))
    turns = F.array(_turn("user", ask), _turn("assistant", F.col("output")))
    return F.concat(F.array(_turn("system", F.col("system"))), turns) if with_system else turns




def _mappings() -> dict[str, tuple[list[str], Column]]:
    made = [
        (["messages[].content", "messages[].role"], _messages("messages", "role", "content")),
        (["messages[].role", "messages[].text"], _messages("messages", "role", "text")),
        (["conversations[].from", "conversations[].value"], _messages("conversations", "from", "value")),
        (["turns[].role", "turns[].text"], _messages("turns", "role", "text")),
        (["instruction", "output"], _instruction(False)),
        (["input", "instruction", "output"], _instruction(True)),
        (["input", "instruction", "output", "system"], _instruction(True, True)),
        (["completion", "prompt"], _pair("prompt", "completion")),
        (["prompt", "response"], _pair("prompt", "response")),
        (["answer", "question"], _pair("question", "answer")),
    ]
    return {fingerprint(paths): (paths, turns) for paths, turns in made}


#: The layout of one row per turn.
TURN_ROWS = ["conv_id", "role", "text", "turn"]


def canonical_role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(named, role), role, F.lit(""))


def _layout(df: DataFrame, key: str, layouts: dict[str, tuple[list[str], object]]) -> str:
    """The fingerprint of df's fields; of fields that some layout names, if df has others too."""
    paths = [p for p in field_paths(df.schema)]
    own = [p for p in paths if p != key or "conv_id" == key]
    if (exact := fingerprint(own)) in layouts:
        return exact
    fits = [(len(need), f) for f, (need, _) in layouts.items() if set(need) <= set(paths)]
    if not fits:
        raise ValueError(f"no mapping for the fields {paths}")
    return max(fits)[1]


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a table in any registered layout; rows of turns are put together by key and turn."""
    layouts = _mappings()
    layouts[fingerprint(TURN_ROWS)] = (TURN_ROWS, None)
    chosen = layouts[_layout(df, key, layouts)][1]
    if chosen is None:
        one = F.struct(F.col("turn"), canonical_role(F.col("role")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return df.select(key, F.transform(chosen, lambda t: F.struct(canonical_role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))


def json_fingerprint(record: Column) -> Column:
    """A JSON record's fingerprint: its keys, and those of the first element of each message array."""
    keys = F.json_object_keys(record)
    nested = lambda name: F.transform(F.json_object_keys(F.get_json_object(record, f"$.{name}[0]")), lambda k: F.concat(F.lit(f"{name}[]."), k))
    paths = F.flatten(F.transform(keys, lambda k: F.when(k == "messages", nested("messages")).when(k == "conversations", nested("conversations")).when(k == "turns", nested("turns")).otherwise(F.array(k))))
    return F.substring(F.sha2(F.array_join(F.array_sort(paths), "\n"), 256), 1, 16)


def canonical_json(df: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """(key, fingerprint, turns) of JSON records, each by its own fingerprint; turns are null where none fits."""
    schema = "messages array<struct<role:string,content:string,text:string>>, conversations array<struct<from:string,value:string>>, turns array<struct<role:string,text:string>>, instruction string, input string, output string, system string, prompt string, completion string, response string, question string, answer string"
    read = df.select(key, json_fingerprint(F.col(record)).alias("fingerprint"), F.from_json(record, schema).alias("r")).select(key, "fingerprint", "r.*")
    turns = F.lit(None).cast(TURNS)
    for f, (_, mapping) in _mappings().items():
        turns = F.when(F.col("fingerprint") == f, mapping).otherwise(turns)
    canon = F.transform(turns, lambda t: F.struct(canonical_role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return read.select(key, "fingerprint", canon.alias("turns"))


# ---- the template


def escape(text: Column) -> Column:
    r"""Backslash -> \s; the first character of a control string: < -> \l, [ -> \b. unescape() takes it back."""
    coded = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.regexp_replace(F.regexp_replace(coded, r"<(?=\||/?s>|</?SYS>>)", r"\\l"), r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    """Every backslash in an escaped text begins a code; \\s goes last, so none is made before that."""
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turns(df: DataFrame, key: str = "conv_id", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    r"""(key, formatted, loss_mask, loss_spans) of (key, turns).

    formatted has <|turn|>role\ntext<|end|>\n per turn. loss_mask has a boolean per turn; loss_spans has the code points
    [start, end) of the trained texts in formatted.
    """
    from corpusloom.llm.common import running_starts

    parts = df.select(
        key,
        F.transform("turns", lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*trained).alias("loss"))).alias("p"),
    )
    piece = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))
    starts = parts.withColumn("at", running_starts(F.transform("p", lambda t: F.length(piece(t)).cast("long"))))
    spans = F.zip_with("p", "at", lambda t, a: F.struct(t["loss"].alias("loss"), (a + len(OPEN) + F.length(t["role"]) + 1).alias("start"), F.length(t["text"]).alias("n")))
    return starts.select(
        key,
        F.array_join(F.transform("p", piece), "").alias("formatted"),
        F.transform("p", lambda t: t["loss"]).alias("loss_mask"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end"))).alias("loss_spans"),
    )


def read_back(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, loss_text) from formatted strings and loss masks alone."""
    own = F.filter(F.split("formatted", r"<\|turn\|>"), lambda s: s != "")  # each piece ends with the closing mark
    cut = F.transform(own, lambda s: F.struct(F.substring_index(s, "\n", 1).alias("role"), s.alias("s")))
    body = F.transform(cut, lambda c: F.struct(unescape(c["role"]).alias("role"), unescape(c["s"].substr(F.length(c["role"]) + 2, F.length(c["s"]) - F.length(c["role"]) - 2 - len(CLOSE))).alias("text")))
    read = df.select(key, "formatted", "loss_mask", "loss_spans", body.alias("turns"))
    under = F.filter(F.zip_with("turns", "loss_mask", lambda t, m: F.when(m, t["text"])), lambda x: x.isNotNull())
    return read.withColumn("loss_text", F.array_join(under, ""))
