"""Chat formatting by schema fingerprints.

The nested field paths of a record, hashed, pick a declarative mapping that turns its layout into
canonical turns (role, text). The turns are then written in one template that marks them and
escapes control strings inside texts, and can be read back exactly. DataFrame expressions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of common chat templates, none of which stays whole in a text.
CONTROL = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
OPEN, MIDDLE, CLOSE, ESCAPE = "<|im_start|>", "<|im_sep|>\n", "<|im_end|>\n", "\\"
#: Names that layouts give to the same role.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns.

    ``paths``: all its field paths, arrays marked by ``[]``. ``turns``: (array path, role field,
    text field) for layouts with a list of turns. ``parts``: (role, fields) for layouts with a field
    for each part; the fields of a part are joined by an empty line, and an empty part is left out.
    ``rows``: (order field, role field, text field) for tables with a row for each turn.
    """

    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint_paths(self.paths)


def fingerprint_paths(paths: tuple[str, ...] | list[str]) -> str:
    """SHA-256 of the sorted field paths, one to a line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: The layouts known from the start; ``to_turns`` takes others beside them.
LAYOUTS = (
    Layout(("messages", "messages[]", "messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout(("conversations", "conversations[]", "conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout(("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(("input", "instruction", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout(("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(("instruction", "output", "system"), parts=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)
#: Layouts of tables, in which ``conv_id`` stands beside a layout's fields.
TABLE_LAYOUTS = (*LAYOUTS, Layout(("role", "text", "turn"), rows=("turn", "role", "text")), Layout(("content", "position", "role"), rows=("position", "role", "content")))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a schema, nested ones included."""
    if isinstance(kind, T.ArrayType):
        return [f"{at}[]", *schema_paths(kind.elementType, f"{at}[]")]
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in (f"{at}.{f.name}".lstrip("."), *schema_paths(f.dataType, f"{at}.{f.name}".lstrip(".")))]
    return []


def _variant_shape(layout: Layout) -> str:
    """What a layout's paths look like as a record's schema with the types of its values struck out."""

    def shape(at: str) -> str:
        if f"{at}[]" in layout.paths:
            return f"ARRAY<{shape(f'{at}[]')}>"
        head = f"{at}." if at else ""
        own = sorted({p[len(head) :] for p in layout.paths if p.startswith(head) and p != at} - {""})
        own = [p for p in own if "." not in p and "[" not in p]
        return f"OBJECT<{', '.join(f'{p}: {shape(head + p)}' for p in own)}>" if own else "_"

    return shape("")


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of a JSON record's nested field paths, from its own schema; null if not JSON."""
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|FLOAT|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "_")
    return F.sha2(shape, 256)


def _clean_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), role, F.lit(""))


def _json_turns(layout: Layout, record: Column) -> Column:
    value = F.try_parse_json(record)
    if layout.turns:
        path, role, text = layout.turns
        kind = f"array<struct<`{role}`:string,`{text}`:string>>"
        return F.transform(
            F.try_variant_get(value, f"$.{path}", kind),
            lambda m: F.struct(_clean_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")),
        )
    parts = [
        F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.try_variant_get(value, f"$.{f}", "string") for f in fields]), lambda x: x != ""), "\n\n").alias("text"))
        for role, fields in layout.parts
    ]
    return F.filter(F.array(*parts), lambda t: t["text"] != "")


def to_turns(df: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts: (id, fingerprint, turns).

    Each record's own nested field paths pick its mapping. Records of an unknown layout, null ones
    and text that is no JSON keep their row with null turns, so nothing is lost unseen; a null value
    inside a known layout is an empty text. Scalar types do not matter, field order neither.
    """
    mark = F.col("fingerprint")
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        ours = hashlib.sha256(_variant_shape(layout).encode()).hexdigest()
        turns = F.when(mark == ours, _json_turns(layout, F.col("record")).cast(TURNS)).otherwise(turns)
    return (
        df.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
        .withColumn("fingerprint", record_fingerprint(F.col("record")))
        .select(F.col("id").alias(id_col), "fingerprint", turns.alias("turns"))
    )


def table_turns(df: DataFrame, layouts: tuple[Layout, ...] = TABLE_LAYOUTS) -> DataFrame:
    """Canonical turns (conv_id, turns) of a whole table, its mapping picked by its schema's paths.

    A table has ``conv_id`` beside the fields of a layout, one row per turn or per conversation.
    Rows of turns go by the layout's order field, nulls first; equal ones by role, then text; their
    roles stay as they are. Null roles and texts are empty strings. A null conv_id is a conversation like others. Columns that no
    path of a layout begins with are not part of the fingerprint, so further ones are ignored as long
    as just one layout fits what is left; an empty table gives no rows. Raises ValueError where no
    mapping has the table's fingerprint, or more than one might be meant.

    A conversation becomes one value, as its format asks, so it is gathered in one task; each turn
    is reduced to role and text before.
    """
    layout = _layout_of(df, layouts)
    if layout.rows:
        order, role, text = layout.rows
        turn = F.struct(F.col(order), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        rows = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
        return rows.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    if layout.turns:
        path, role, text = layout.turns
        turns = F.transform(path, lambda m: F.struct(_clean_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    else:
        parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*fields), lambda x: x != ""), "\n\n").alias("text")) for role, fields in layout.parts]
        turns = F.filter(F.array(*parts), lambda t: t["text"] != "")
    return df.select("conv_id", turns.alias("turns"))


def _layout_of(df: DataFrame, layouts: tuple[Layout, ...]) -> Layout:
    """The one layout with the fingerprint of the table's paths, all of them or those of its columns."""
    fields = {f.name: schema_paths(T.StructType([f])) for f in df.schema.fields if f.name != "conv_id"}
    whole = fingerprint_paths([p for own in fields.values() for p in own])
    found = [x for x in layouts if x.fingerprint == whole]
    if not found:
        heads = {x: {p.split(".")[0].removesuffix("[]") for p in x.paths} for x in layouts}
        found = [x for x in layouts if x.fingerprint == fingerprint_paths([p for name in heads[x] & set(fields) for p in fields[name]])]
        # a layout whose fields another one has too is the narrower reading of the same table
        found = [x for x in found if not any(heads[x] < heads[y] for y in found)]
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} mappings for the paths {sorted(p for own in fields.values() for p in own)}")
    return found[0]


def escape(text: Column) -> Column:
    """Break up control strings: a backslash after their first character; backslashes double."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undo ``escape``: drop the backslash before any character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Write canonical turns in the template: (conv_id, formatted, loss_mask).

    ``loss_mask`` has for each turn how many code points of it to skip and how many to train on;
    what is trained on are the texts of the ``trained`` role. A conversation without turns gives an
    empty string.
    """
    written = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == trained).alias("train"),
        ),
    )
    return turns.select("conv_id", written.alias("written")).select(
        "conv_id",
        F.array_join(F.transform("written", lambda w: F.concat(w["head"], w["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(
            "written",
            lambda w: F.struct(F.length(w["head"]).alias("skip"), F.when(w["train"], F.length(w["body"])).otherwise(0).alias("keep")),
        ).alias("loss_mask"),
    )


def read_chat(chats: DataFrame) -> DataFrame:
    """Read formatted chats back: (conv_id, formatted, turns, loss_texts).

    ``loss_texts``: the text under the loss mask, unescaped, turn by turn.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    turn = lambda p: F.struct(
        unescape(F.substring_index(body(p), MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text"),
    )
    return chats.withColumn("pieces", pieces).select(
        "conv_id", "formatted",
        F.transform("pieces", turn).alias("turns"),
        F.filter(
            F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["keep"] > 0, unescape(F.substr(p, m["skip"] + 1, m["keep"])))),
            lambda x: x.isNotNull(),
        ).alias("loss_texts"),
    )
