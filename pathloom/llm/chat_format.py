"""Chat formatting with DataFrame functions only.

A frame's nested field paths (``messages[].role:string``) are hashed; the
fingerprint selects a declarative mapping that turns the layout - prompt and
response, instruction with input and output, lists of messages, rows by turn -
into canonical turns (conv_id, turn, role, text). For JSON records of mixed
layouts the same fingerprint is computed per row. Turns are then written with a
template whose control strings cannot occur inside texts, since texts are
escaped reversibly, and come with the loss mask as spans of code points.

Defined results: null text and null role are empty; rows of one conversation
are ordered by turn (null first), then role and text, so repeated rows stay,
in a fixed order; rows of a null conv_id form one conversation; an empty table
gives an empty result; columns outside the known layouts are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template. Escapes leave no "<" or ">" in texts, so the marks are unambiguous.
OPEN, CLOSE, END = "<turn:", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
LOSS_ROLE = "assistant"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with kinds; lists add ``[]``, kinds are string, number or other."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'string' if isinstance(kind, T.StringType) else 'number' if isinstance(kind, T.NumericType) else 'other'}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turns(*pairs: tuple[str, Column]) -> Column:
    """Turns of (role, text) pairs, without those whose text is null."""
    return F.filter(F.array(*(F.struct(F.lit(r).alias("role"), t.cast("string").alias("text")) for r, t in pairs)), lambda x: x["text"].isNotNull())


def _listed(column: str, role: str, text: str) -> Column:
    # from/value layouts call the two sides human and gpt
    names = F.create_map(*(F.lit(x) for x in ("human", "user", "gpt", "assistant")))
    return F.transform(F.col(column), lambda x: F.struct(F.coalesce(names[x[role]], x[role]).alias("role"), x[text].alias("text")))


def _instruction() -> Column:
    asked = F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(F.concat("instruction", F.lit("\n\n"), "input"))
    return _turns(("user", asked), ("assistant", F.col("output")))


#: Layout -> (field paths besides the id, turns of one record).
LAYOUTS: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "prompt": (["prompt:string", "response:string"], lambda: _turns(("user", F.col("prompt")), ("assistant", F.col("response")))),
    "system_prompt": (["prompt:string", "response:string", "system:string"], lambda: _turns(("system", F.col("system")), ("user", F.col("prompt")), ("assistant", F.col("response")))),
    "instruction": (["input:string", "instruction:string", "output:string"], _instruction),
    "bare_instruction": (["instruction:string", "output:string"], lambda: _turns(("user", F.col("instruction")), ("assistant", F.col("output")))),
    "messages": (["messages[].content:string", "messages[].role:string"], lambda: _listed("messages", "role", "content")),
    "from_value": (["conversations[].from:string", "conversations[].value:string"], lambda: _listed("conversations", "from", "value")),
}
ROWS_BY_TURN = ["role:string", "text:string", "turn:number"]
KNOWN_JSON = {p for paths, _ in LAYOUTS.values() for p in paths}
KNOWN = KNOWN_JSON | set(ROWS_BY_TURN)
MAPPINGS = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()} | {fingerprint(ROWS_BY_TURN): "rows_by_turn"}


def canonical(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a frame whose layout is known by its fingerprint."""
    paths = [p for p in field_paths(records.schema) if p in KNOWN]
    name = MAPPINGS.get(fingerprint(paths))
    if name is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    if name == "rows_by_turn":
        return records.select(F.col(id_column).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    return _exploded(records.select(F.col(id_column).alias("conv_id"), LAYOUTS[name][1]().alias("turns")))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("turns").alias("turn", "x")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("x.role").alias("role"), F.col("x.text").alias("text"))


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of one JSON record: its nested field paths to the depth that layouts have, hashed. Only lists
    of objects have nested paths; a string that looks like a list stays a string."""
    fields = F.map_entries(F.from_json(record, "map<string,string>"))
    tops = sorted({p.split(":")[0].split("[")[0] for p in KNOWN_JSON})
    as_lists = F.from_json(record, ", ".join(f"{k} array<string>" for k in tops))
    lists = F.array_compact(F.array(*(F.when(as_lists[k].isNotNull(), k) for k in tops)))

    def paths(e: Column) -> Column:
        key = F.lower(e["key"])
        objects = F.array_compact(F.from_json(e["value"], "array<map<string,string>>"))
        inner = F.coalesce(F.flatten(F.transform(objects, lambda m: F.map_keys(m))), F.array().cast("array<string>"))
        return F.when(F.array_contains(lists, e["key"]), F.transform(inner, lambda k: F.concat(key, F.lit("[]."), F.lower(k), F.lit(":string")))).otherwise(F.array(F.concat(key, F.lit(":string"))))

    known = F.array(*map(F.lit, sorted(KNOWN_JSON)))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.array_intersect(F.flatten(F.transform(fields, paths)), known))), "\n"), 256)


#: The union of the record layouts, for parsing.
RECORD = "prompt string, response string, system string, instruction string, input string, output string, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>"


def _json_turns(records: DataFrame, json_column: str, id_column: str) -> DataFrame:
    """conv_id, record, fp and turns (null for an unknown layout) of each JSON record."""
    record = F.col(json_column)
    d = records.select(F.col(id_column).alias("conv_id"), record.alias("record"), json_fingerprint(record).alias("fp"), F.from_json(record, RECORD).alias("r")).select("conv_id", "record", "fp", "r.*")
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for name, (paths, of) in LAYOUTS.items():
        turns = F.when(F.col("fp") == fingerprint(paths), of()).otherwise(turns)
    return d.select("conv_id", "record", "fp", turns.alias("turns"))


def canonical_json(records: DataFrame, json_column: str, id_column: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON records of mixed layouts; ``unmapped_json`` has the records that give no turns."""
    return _exploded(_json_turns(records, json_column, id_column).select("conv_id", "turns"))


def unmapped_json(records: DataFrame, json_column: str, id_column: str = "conv_id") -> DataFrame:
    """The records of which ``canonical_json`` gives no turns: conv_id, record, fingerprint, and whether the layout
    is known (then there is no turn in it). Each record is either there or here."""
    known = F.coalesce(F.col("fp").isin([fingerprint(paths) for paths, _ in LAYOUTS.values()]), F.lit(False))
    return _json_turns(records, json_column, id_column).where("coalesce(size(turns), 0) < 1").select("conv_id", "record", F.col("fp").alias("fingerprint"), known.alias("known_layout"))


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (begin and end code points in it)."""
    none = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    rows = rows.withColumns({"head": F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)), "body": escape(F.col("text"))})
    rows = rows.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(order), "begin": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    start = F.coalesce("begin", F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("begin"), (start + F.length("body")).alias("end")))
    pieces = F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))))
    return rows.groupBy("conv_id").agg(pieces.alias("p")).select(
        "conv_id",
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.col("p.piece"), "").alias("formatted"),
        F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    begin = F.lit(len(OPEN) + 1)

    def turn(p: Column) -> Column:
        close = F.instr(p, CLOSE)
        return F.struct(unescape(F.substr(p, begin, close - begin)).alias("role"), unescape(F.substr(p, close + 1)).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the output text."""
    nl = F.lit("\n")
    d = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
