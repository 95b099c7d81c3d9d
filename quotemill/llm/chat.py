"""Chat formatting, in DataFrame expressions only.

The nested field paths of a record are hashed to a schema fingerprint, which selects a declarative mapping of its layout to
canonical turns. Only paths that a layout needs count. Typed tables have one fingerprint, from their schema; JSON records have
one each, from the parsed value. Turns become one text by a ChatML-like template with reversible escapes and a loss mask over assistant texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"
TURNS = f"array<{TURN}>"


# --- schema fingerprints -------------------------------------------------------------------------------------------------

def field_paths(schema: DataType, prefix: str = "") -> list[str]:
    """Sorted nested field paths; [] marks the elements of an array."""
    if isinstance(schema, ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}".lstrip(".")))
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: paths are the fields it needs; turns(get) is an array of struct(role, text), get(path, type)
    reads a field."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str, str], Column]], Column]

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    """Names of one role in several layouts become one."""
    out = F.coalesce(role, F.lit(""))
    for old, new in _ROLES.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _messages(field: str, role: str, text: str) -> Callable:
    def turns(get: Callable[[str, str], Column]) -> Column:
        return F.transform(get(field, f"array<struct<{role}:string,{text}:string>>"), lambda m: _turn(_role(m[role]), m[text]))

    return turns


def _pair(user: str, assistant: str, system: str | None = None) -> Callable:
    def turns(get: Callable[[str, str], Column]) -> Column:
        rest = F.array(_turn("user", get(user, "string")), _turn("assistant", get(assistant, "string")))
        return F.concat(F.array(_turn("system", get(system, "string"))), rest) if system else rest

    return turns


def _instruction(get: Callable[[str, str], Column]) -> Column:
    given = F.coalesce(get("input", "string"), F.lit(""))
    asked = F.concat(F.coalesce(get("instruction", "string"), F.lit("")), F.when(given == "", "").otherwise(F.concat(F.lit("\n\n"), given)))
    return F.array(_turn("user", asked), _turn("assistant", get("output", "string")))


#: Known layouts. Of those whose fields a record has the first counts: lists of turns, then the layouts of more fields. What
#: else a record has doesn't matter.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), _messages("messages", "role", "content")),
    Mapping("texts", ("messages[].role", "messages[].text"), _messages("messages", "role", "text")),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "input", "output"), _instruction),
    Mapping("system_prompt", ("system", "prompt", "response"), _pair("prompt", "response", "system")),
    Mapping("bare_instruction", ("instruction", "output"), _pair("instruction", "output")),
    Mapping("prompt", ("prompt", "completion"), _pair("prompt", "completion")),
    Mapping("response", ("prompt", "response"), _pair("prompt", "response")),
    Mapping("question", ("question", "answer"), _pair("question", "answer")),
)
#: Fingerprint of a layout's field paths -> its mapping.
BY_FINGERPRINT = {m.fingerprint: m for m in MAPPINGS}
#: One row per turn: before all others.
FLAT = ("turn", "role", "text")


def layout_fingerprint(paths: list[str]) -> str | None:
    """Fingerprint of the paths of the first layout that these paths hold; None if they hold none."""
    have = set(paths)
    return next((fingerprint(list(p)) for p in (FLAT, *(m.paths for m in MAPPINGS)) if have.issuperset(p)), None)


def _present(path: str) -> Column:
    """Does the parsed record _v have the path, in any element of a list?"""
    if "[]." not in path:
        return F.try_variant_get("_v", f"$.{path}", "variant").isNotNull()
    field, inner = path.split("[].")
    return F.coalesce(F.exists(F.try_variant_get("_v", f"$.{field}", "array<variant>"), lambda x: F.try_variant_get(x, f"$.{inner}", "variant").isNotNull()), F.lit(False))


def json_fingerprint() -> Column:
    """layout_fingerprint of each parsed record _v."""
    out = F.lit(None).cast("string")
    for m in reversed(MAPPINGS):
        every = _present(m.paths[0])
        for p in m.paths[1:]:
            every = every & _present(p)
        out = F.when(every, F.lit(m.fingerprint)).otherwise(out)
    return out


def turns_from_json(records: DataFrame, key: str, json: str) -> DataFrame:
    """records(key, json) -> (key, turn, role, text). Fields that no layout names don't matter. A record of an unknown layout, an
    empty list of turns, or no JSON gives one row of nulls besides the key: the rejects, to be filtered or counted."""
    mapped = records.select(F.col(key), F.try_parse_json(F.col(json)).alias("_v")).withColumn("_fp", json_fingerprint())

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{path}", kind)

    turns = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        turns = F.when(F.col("_fp") == m.fingerprint, m.turns(get)).otherwise(turns)
    return mapped.select(key, F.posexplode_outer(turns).alias("turn", "_t")).select(key, F.col("turn").cast("long").alias("turn"), F.col("_t.role").alias("role"), F.col("_t.text").alias("text"))


def turns_from_table(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """A typed table -> (key, turn, role, text), by the fingerprint of the first layout that its field paths besides the key hold;
    other columns don't matter, whatever their names. An unknown layout is an error that lists the paths."""
    paths = field_paths(StructType([f for f in df.schema.fields if f.name != key]))
    found = layout_fingerprint(paths)
    if found == fingerprint(list(FLAT)):
        return df.select(F.col(key), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    if found is None:
        raise ValueError(f"no mapping for the field paths {paths}")
    read = lambda path, kind: F.col(path) if kind.startswith("array") else F.col(path).cast(kind)
    exploded = df.select(F.col(key), F.posexplode(BY_FINGERPRINT[found].turns(read)).alias("turn", "_t"))
    return exploded.select(key, F.col("turn").cast("long").alias("turn"), F.col("_t.role").alias("role"), F.col("_t.text").alias("text"))


# --- template ------------------------------------------------------------------------------------------------------------

def escape(text: Column) -> Column:
    r"""<| in a text gets a backslash between, and one more where there are some: <|, <\|, <\\| become <\|, <\\|, <\\\|."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """turns(key, turn, role, text) -> one row per key: key, formatted, loss_mask.

    formatted is, for each turn in order, START role newline text END newline, with roles and texts escaped. loss_mask is an
    array of struct(start, end) in code points of formatted, end exclusive: the escaped assistant texts. Null roles and texts
    count as empty; turns of equal number (or null, which come first) stand in the order of role, then text; repeated rows
    are repeated turns; a row of a null key belongs to no other: it is a conversation of its own. A conversation is one row, as
    long as its turns: it's the unit of training, and no group is made beyond it. An empty table gives an empty result.
    """
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    slim = turns.select(F.col(key), alone.alias("_alone"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    body = slim.withColumn("_head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("_text", escape(F.col("text")))
    body = body.withColumn("_piece", F.concat("_head", "_text", F.lit(END + "\n")))
    order = Window.partitionBy(key, "_alone").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = body.select(
        key, "_alone", F.row_number().over(order).alias("_i"),
        F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end"),
        (F.col("role") == "assistant").alias("_loss"), F.length("_text").alias("_n"), "_piece",
    )
    # the text ends before END and its newline
    end = F.col("_end") - (len(END) + 1)
    span = F.struct("_i", "_piece", F.when(F.col("_loss"), F.struct((end - F.col("_n")).alias("start"), end.alias("end"))).alias("span"))
    grouped = placed.groupBy(key, "_alone").agg(F.array_sort(F.collect_list(span)).alias("_turns"))
    formatted = F.array_join(F.transform("_turns", lambda t: t["_piece"]), "")
    mask = F.transform(F.filter("_turns", lambda t: t["span"].isNotNull()), lambda t: t["span"])
    return grouped.select(key, formatted.alias("formatted"), mask.alias("loss_mask"))


def parse_chats(formatted: DataFrame, text: str = "formatted") -> DataFrame:
    """formatted with turns: array of struct(role, text), read back from the text alone."""
    pieces = F.filter(F.split(F.col(text), r"<\|im_end\|>\n"), lambda p: p != "")
    head = len(START)
    return formatted.withColumn("_pieces", F.transform(pieces, lambda p: F.substr(p, F.lit(head + 1)))).withColumn(
        "turns", F.transform("_pieces", lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.position(F.lit("\n"), p) + 1)).alias("text")))
    ).drop("_pieces")
