"""Chat formatting in DataFrame operations only.

Layouts: the nested field paths of a row that are filled are sorted and hashed; the hash selects a declarative mapping,
which turns the row into canonical turns (order, role, text).  Rows of several layouts may share one table.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  In roles and texts a backslash is doubled, and a
backslash goes inside every control string after its first character (so the control string no longer occurs); newlines
in a role get one before them.  To unescape, drop each backslash and keep the character after it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, STOP = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Control strings of common chat templates, by first character and rest.
_ANGLE = r"<(?=/?s>|\|(?:im_start|im_end|im_sep|system|user|assistant|endoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id|end|pad)\|>|</?SYS>>|/?SYS>>|start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>)"
_SQUARE = r"\[(?=/?INST\]|/?SYSTEM_PROMPT\])"
#: speakers' names in the wild and their canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Flat:
    """Turns from single fields: (role, fields joined by a blank line)."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> set[str]:
        return {f for _, fields in self.turns for f in fields}


@dataclass(frozen=True)
class Listed:
    """Turns from an array of structs."""

    array: str
    role: str
    text: str
    roles: dict = field(default_factory=lambda: ROLES)

    def paths(self) -> set[str]:
        return {f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"}


@dataclass(frozen=True)
class Single:
    """One turn from a row: its role and text fields."""

    role: str
    text: str

    def paths(self) -> set[str]:
        return {self.role, self.text}


_CORE = {
    "prompt_response": Flat((("user", ("prompt",)), ("assistant", ("response",)))),
    "prompt_completion": Flat((("user", ("prompt",)), ("assistant", ("completion",)))),
    "system_prompt_response": Flat((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    "question_answer": Flat((("user", ("question",)), ("assistant", ("answer",)))),
    "instruction_output": Flat((("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input_output": Flat((("user", ("instruction", "input")), ("assistant", ("output",)))),
    "messages": Listed("messages", "role", "content"),
    "conversations": Listed("conversations", "from", "value"),
}
LAYOUTS = dict(_CORE)
#: Tables of turns: apart from LAYOUTS, since a role or text column beside another layout must not hide that one.
TURN_ROWS = {"turn": Single("role", "text")}


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves: struct fields by dots, array elements by []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def row_fingerprint(df: DataFrame, layouts: dict = LAYOUTS) -> Column:
    """Hash of the known paths that the row fills; an array counts if it is not null."""
    known = set().union(*(m.paths() for m in layouts.values()))
    here = [p for p in sorted(field_paths(df.schema)) if p in known]
    return F.sha2(F.concat_ws("\n", *(F.when(F.col(f"`{p.partition('[')[0]}`").isNotNull(), F.lit(p)) for p in here)), 256)


def _flat(m: Flat) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields)).alias("text")) for r, fields in m.turns))


def _listed(m: Listed) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in m.roles.items()))
    said = lambda x: F.coalesce(x[m.role].cast("string"), F.lit(""))
    return F.transform(f"{m.array}", lambda x: F.struct(F.coalesce(names[said(x)], said(x)).alias("role"), F.coalesce(x[m.text].cast("string"), F.lit("")).alias("text")))


def _single(m: Single) -> Column:
    return F.array(F.struct(*(F.col(f"`{c}`").cast("string").alias(n) for c, n in ((m.role, "role"), (m.text, "text")))))


def unmatched(df: DataFrame, layouts: dict = LAYOUTS) -> DataFrame:
    """The rows of ``df`` that ``turns`` has no layout for."""
    have = set(field_paths(df.schema))
    known = [fingerprint(m.paths()) for m in layouts.values() if m.paths() <= have]
    return df.where(~row_fingerprint(df, layouts).isin(known))


def turns(df: DataFrame, key: str, layouts: dict = LAYOUTS) -> DataFrame:
    """(key, ord, role, text) from a table of one or more layouts.

    A row whose filled paths match no layout has no turns (``unmatched`` returns it), and neither has one with an empty array; null elements of an
    array and null fields in them are empty strings.  Other columns are ignored.
    """
    have = set(field_paths(df.schema))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    seen, made = row_fingerprint(df, layouts), empty
    for m in layouts.values():
        if not m.paths() <= have:
            continue
        got = _flat(m) if isinstance(m, Flat) else _single(m) if isinstance(m, Single) else _listed(m)
        made = F.when(seen == fingerprint(m.paths()), got).otherwise(made)
    return df.select(F.col(key), F.posexplode(made).alias("ord", "_t")).select(key, F.col("ord").cast("long"), "_t.role", "_t.text")


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(c, _ANGLE, r"<\\"), _SQUARE, r"[\\")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(escape(c), "\n", "\\\\\n")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(rows: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted, loss): one row a conversation; loss has the byte ranges (start, length) of the trained texts.

    Rows are the turns.  Null roles and texts are empty; a null order comes first, equal ones are in the order of role
    and text; repeated rows are turns of their own; a null key is a conversation.  No rows: no conversations.
    """
    plain = rows.select(
        F.col(key).alias("_key"), F.col(order).alias("_ord"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )
    made = plain.withColumn("_body", escape(F.col("_text"))).withColumn("_head", F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n")))
    size = F.octet_length("_head") + F.octet_length("_body") + F.lit(len(STOP) + 1)
    run = Window.partitionBy("_key").orderBy("_ord", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("_at", F.coalesce(F.sum(size.cast("long")).over(run), F.lit(0)))
    turn = F.struct("_at", F.concat("_head", "_body", F.lit(STOP + "\n")).alias("piece"), (F.col("_at") + F.octet_length("_head")).alias("start"), F.octet_length("_body").cast("long").alias("length"), (F.col("_role") == TRAINED).alias("trained"))
    every = placed.groupBy("_key").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    return every.select(
        F.col("_key").alias(key),
        F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` (with formatted, loss) with ``turns`` (array of role, text) and ``loss_text``, both unescaped."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    # possessive: a role of any length takes no stack
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    raw = F.col("formatted").cast("binary")
    return formatted.select(
        "*",
        F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), "").alias("loss_text"),
    )
