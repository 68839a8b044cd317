"""Chat formatting. Records in heterogeneous prompt, instruction and message layouts become canonical turns, and turns
become one marked-up string with a loss mask.

The layout of a record is found by its schema fingerprint: the sorted nested field paths of the record (types left out),
hashed. A fingerprint selects a declarative mapping, an ordinary column expression from the record to
``array<struct<role, text>>``. Everything is built of Spark's own functions.

Defined results: a null text or role is the empty string; a null record, or one whose fingerprint has no mapping, has
``layout`` null and no turns (`canonical_turns` keeps the row). Rows of one conversation are taken by turn, nulls first;
rows with equal turns by role, then text; repeated rows stay. Other columns, whatever their names, are kept by
`canonical_turns`, but for ``layout`` and ``turns``, which are replaced, and ignored by the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

START, END = "### ", "</turn>\n"
#: Control strings and their escapes, undone in the opposite order. "\\" first: no escape holds a control string.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
TURNS = "array<struct<role:string,text:string>>"
#: Role names of the layouts that do not use the canonical ones (fixed values).
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


@dataclass(frozen=True)
class Layout:
    """``example``: DDL of the record, from which its field paths are taken; ``turns``: SQL over variant ``r``."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _text(path: str) -> str:
    return f"coalesce(try_variant_get(r, '{path}', 'string'), '')"


def _turn(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', {_text(path)})"


def _messages(path: str, role: str, text: str) -> str:
    names = "".join(f" when '{a}' then '{b}'" for a, b in ROLE_NAMES.items())
    return (
        f"transform(cast(variant_get(r, '{path}', 'array<struct<{role}:string,{text}:string>>') as array<struct<{role}:string,{text}:string>>),"
        f" m -> named_struct('role', coalesce(case m.{role}{names} else m.{role} end, ''), 'text', coalesce(m.{text}, '')))"
    )


def _row(role: str, text: str) -> str:
    return f"array(named_struct('role', {_text(role)}, 'text', {_text(text)}))"


#: The mappings. A new layout is one more line.
LAYOUTS = (
    Layout("turn", ("role", "text"), _row("$.role", "$.text")),
    Layout("message", ("content", "role"), _row("$.role", "$.content")),
    Layout("prompt_completion", ("completion", "prompt"), f"array({_turn('user', '$.prompt')}, {_turn('assistant', '$.completion')})"),
    Layout("prompt_response", ("prompt", "response"), f"array({_turn('user', '$.prompt')}, {_turn('assistant', '$.response')})"),
    Layout("instruction", ("instruction", "output"), f"array({_turn('user', '$.instruction')}, {_turn('assistant', '$.output')})"),
    Layout(
        "instruction_input",
        ("input", "instruction", "output"),
        "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', nullif(" + _text("$.instruction") + ", ''), nullif(" + _text("$.input") + ", ''))),"
        f" {_turn('assistant', '$.output')})",
    ),
    Layout("system_prompt_response", ("prompt", "response", "system"), f"array({_turn('system', '$.system')}, {_turn('user', '$.prompt')}, {_turn('assistant', '$.response')})"),
    Layout("messages", ("messages[].content", "messages[].role"), _messages("$.messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _messages("$.conversations", "from", "value")),
    Layout("turns", ("turns[].role", "turns[].text"), _messages("$.turns", "role", "text")),
)


def _shape(paths: tuple[str, ...]) -> str:
    """The type that ``schema_of_variant`` gives for these paths once scalar types are left out."""
    top: dict[str, list[str]] = {}
    for p in sorted(paths):
        head, _, rest = p.partition("[].")
        top.setdefault(head, [])
        if rest:
            top[head].append(rest)
    fields = (f"{k}: ARRAY<OBJECT<{', '.join(f'{x}: _' for x in v)}>>" if v else f"{k}: _" for k, v in top.items())
    return f"OBJECT<{', '.join(fields)}>"


def fingerprint(record: Column) -> Column:
    """SHA-256 of the record's nested field paths; equal for records whose values differ only in scalar type."""
    shape = F.regexp_replace(F.schema_of_variant(record), r": (?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|BINARY|UUID|DATE|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))", ": _")
    return F.sha2(shape, 256)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    import hashlib

    return hashlib.sha256(_shape(paths).encode()).hexdigest()


def canonical_turns(df: DataFrame, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` to ``df``. ``record``: a variant column, as of ``parse_json`` or ``to_variant_object``."""
    kept = [c for c in df.columns if c.lower() not in ("layout", "turns")]
    found = df.select(F.struct(*map(quoted, kept)).alias("row"), record.alias("r")).withColumn("print", fingerprint(F.col("r")))
    layout = turns = None
    for x in layouts:
        here = F.col("print") == fingerprint_of(x.paths)
        value = F.expr(x.turns).cast(TURNS)
        layout = F.when(here, x.name) if layout is None else layout.when(here, x.name)
        turns = F.when(here, value) if turns is None else turns.when(here, value)
    made = found.select("row", layout.alias("layout"), F.coalesce(turns, F.expr(f"cast(array() as {TURNS})")).alias("turns"))
    return made.select(*(F.col("row").getField(c).alias(c) for c in kept), "layout", "turns")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", turns_col: str = "turns") -> DataFrame:
    """One row per conversation: ``id_col``, ``formatted``, ``loss_mask``.

    ``formatted`` is every turn as ``### role: text</turn>\\n``, escaped. ``loss_mask`` has for each turn the start
    (from the turn's own first code point) and length in code points of the part that counts in the loss: the whole
    text of an assistant's turn, nothing of others. A conversation is one string by nature, so its rows meet in one
    task; they are gathered map-side first and its hash can't be made of parts.
    """
    head = F.concat(F.lit(START), F.replace(escape(F.col("t.role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    text = escape(F.col("t.text"))
    parts = turns.select(F.col(id_col), F.col(order_col).alias("__o"), F.posexplode(turns_col).alias("__k", "t")).select(
        id_col,
        F.struct(
            F.col("__o"), F.col("__k"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), F.concat(head, text, F.lit(END)).alias("segment"),
            F.length(head).alias("start"), F.when(F.col("t.role") == "assistant", F.length(text)).otherwise(0).alias("length"),
        ).alias("p"),
    )
    gathered = parts.groupBy(id_col).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return gathered.select(
        id_col,
        F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string, read back: ``array<struct<role, text>>``."""
    pieces = F.split(formatted, END)
    role = lambda s: unescape(F.replace(F.substring_index(F.substr(s, F.lit(len(START) + 1)), ": ", 1), F.lit("\\c"), F.lit(":")))
    text = lambda s: unescape(F.substr(s, F.instr(s, ": ") + 2))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda s: F.struct(role(s).alias("role"), text(s).alias("text")))


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, in order, unescaped, nothing between."""
    pieces = F.split(formatted, END)
    under = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), loss_mask, lambda s, m: unescape(F.substr(s, m["start"] + 1, m["length"])))
    return F.array_join(under, "")
