"""Chat formatting: records of any known layout become turns, and turns become marked, reversible text.

A record's nested field paths (names only, sorted, array items as []) are hashed to a fingerprint, and the fingerprint
selects a declarative mapping: where the turns are, or which fields make which turn. New layouts are new entries of
`LAYOUTS`, not code. Records come as a table whose columns are the fields, or as one JSON text per row, where each row
may have a layout of its own. Turns stay rows: one long conversation is never gathered into a value.

Template: ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. Inside roles and texts a backslash is
doubled and ``<|`` gets a backslash in between, in roles a line end gets one before it, so no text can spell a marker
and every text can be read back. The loss mask is a span per turn: the text of assistant turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.llm.common import need

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """Either ``turns``, the path of an array of objects with ``role`` and ``text`` in it, or ``fields``: (role, paths)
    in order of the turns, the non-empty values of the paths joined by blank lines. ``row``: the record is one turn."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: bool = False
    roles: tuple[tuple[str, str], ...] = ()


# Known layouts. ``roles`` renames the roles of a layout to user, assistant and system.
LAYOUTS = (
    Layout("turn_rows", ("role", "text"), role="role", text="text", row=True),
    Layout("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", ("instruction", "output", "system"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("question_answer", ("data.answer", "data.question"), fields=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, prefix + "[]")
    return [prefix]


def json_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON object, one per line, by the rows' own content; null if it is none.

    The schema of a variant names fields in order; paths are read from it level by level, to a depth of three.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    plain = F.regexp_replace(schema, r"ARRAY<(?!OBJECT)[^<>]*>", "LEAF[]")
    plain = F.regexp_replace(plain, r": (?!OBJECT|ARRAY|LEAF)[A-Z_]+(\([0-9, ]*\))?", ": LEAF")
    return F.when(schema.startswith("OBJECT<"), plain)


def json_fingerprint(layout: Layout) -> str:
    """What `json_paths` gives for a layout."""
    tree: dict = {}
    for path in layout.paths:
        node = tree
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = None

    def text(node: dict) -> str:
        parts = []
        for name in sorted(node, key=lambda n: n.removesuffix("[]")):
            below = node[name]
            inner = "LEAF" if below is None else text(below)
            parts.append(f"{name.removesuffix('[]')}: " + (f"ARRAY<{inner}>" if name.endswith("[]") and below is not None else inner))
        return f"OBJECT<{', '.join(parts)}>"

    return text(tree)


TURNS = "array<struct<role string, text string>>"


def _field_turns(layout: Layout, value) -> Column:
    made = []
    for role, paths in layout.fields:
        parts = F.filter(F.array(*(value(p) for p in paths)), lambda x: x.isNotNull() & (x != ""))
        made.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    # A turn that is only context, such as an empty system prompt, is no turn.
    return F.filter(F.array(*made), lambda t: (t["role"] != "system") | (t["text"] != ""))


def _renamed(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles:
        role = F.when(role == old, new).otherwise(role)
    return role


def _item_turn(layout: Layout) -> Callable[[Column], Column]:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return lambda x: F.struct(_renamed(text(x[layout.role]), layout).alias("role"), text(x[layout.text]).alias("text"))


def from_json(records: DataFrame, key: str, record: str) -> DataFrame:
    """(conv_id, layout, turn, role, text) from one JSON text per row.

    A record that is null, no JSON object or of unknown layout gives one row with a null layout and no turn, so that
    nothing vanishes silently. Null and missing texts are empty; extra rows of a key stay apart only by their order.
    """
    need(records, key, record)
    plain = json_paths(F.col(record))
    print_of = F.substring(F.sha2(plain, 256), 1, 16)
    chosen, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        match = print_of == hashlib.sha256(json_fingerprint(layout).encode()).hexdigest()[:16]
        if layout.turns:
            items = F.from_json(F.get_json_object(record, f"$.{layout.turns}"), f"array<struct<`{layout.role}` string, `{layout.text}` string>>")
            made = F.transform(items, _item_turn(layout))
        elif layout.row:
            made = F.array(F.struct(F.coalesce(F.get_json_object(record, f"$.{layout.role}"), F.lit("")).alias("role"), F.coalesce(F.get_json_object(record, f"$.{layout.text}"), F.lit("")).alias("text")))
        else:
            made = _field_turns(layout, lambda p: F.get_json_object(record, f"$.{p}"))
        chosen, turns = F.when(match, layout.name).otherwise(chosen), F.when(match, made).otherwise(turns)
    found = records.select(F.col(key).alias("conv_id"), chosen.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return found.select("conv_id", "layout", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")


def from_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(conv_id, layout, turn, role, text) from a table with a column per field; its own schema is the fingerprint.

    ``order`` numbers the rows of a key, for layouts with a row per turn. Null roles and texts are empty.
    """
    need(rows, key)
    fields = [f for f in rows.schema.fields if f.name not in (key, order)]
    own = fingerprint(paths_of(T.StructType(fields)))
    layout = next((x for x in LAYOUTS if fingerprint(x.paths) == own), None)
    if layout is None:
        raise ValueError(f"No layout with the fields {', '.join(sorted(paths_of(T.StructType(fields))))}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if layout.row:
        need(rows, order)
        return rows.select(F.col(key).alias("conv_id"), F.lit(layout.name).alias("layout"), F.col(order).cast("bigint").alias("turn"), _renamed(text(F.col(layout.role)), layout).alias("role"), text(F.col(layout.text)).alias("text"))
    if layout.turns:
        turns = F.transform(layout.turns, _item_turn(layout))
    else:
        turns = _field_turns(layout, lambda p: F.col(p).cast("string"))
    found = rows.select(F.col(key).alias("conv_id"), F.lit(layout.name).alias("layout"), F.posexplode(turns).alias("turn", "t"))
    return found.select("conv_id", "layout", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")


def rejected(turns: DataFrame) -> DataFrame:
    """conv_id of the records that `from_json` found no layout for, once per record."""
    need(turns, "conv_id", "layout")
    return turns.filter(F.col("layout").isNull()).select("conv_id")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, segment, loss_start, loss_end) of turns (conv_id, turn, role, text).

    A conversation's text is its segments in the order of turn, role and text (repeated turns are kept, a null number
    comes first). The loss span counts code points within the segment and is null unless the role is assistant. Records of
    unknown layout (a ``layout`` column that is null) make no turn; `rejected` has them.
    """
    need(turns, "conv_id", "turn", "role", "text")
    if "layout" in turns.columns:
        turns = turns.filter(F.col("layout").isNotNull())
    role = F.replace(_escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    body = _escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    learned = F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(learned, F.length(head)).alias("loss_start"),
        F.when(learned, F.length(head) + F.length(body)).alias("loss_end"),
    )


def parsed(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, read_role, read_text, learned, chars): what the segments say, by the template alone.

    ``learned`` is the unescaped text under the loss span, null where there is none.
    """
    inner = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    shape = r"(?s)\A<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)<\|im_end\|>\n\z"
    learned = F.expr("substring(segment, loss_start + 1, loss_end - loss_start)")
    return segments.select(
        "conv_id", "turn", inner(F.regexp_extract("segment", shape, 1)).alias("read_role"), inner(F.regexp_extract("segment", shape, 2)).alias("read_text"),
        inner(learned).alias("learned"), F.length("segment").cast("bigint").alias("chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Per conversation the digests of what was read back; rows stream in order, so a conversation may have any length."""
    kind = read.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, None, []
        types: pa.Schema | None = None

        def close() -> None:
            done.append({"conv_id": key, "n_turns": held[0], "turns_sha256": held[1].hexdigest(), "loss_chars": held[2], "loss_sha256": held[3].hexdigest(), "formatted_chars": held[4]})

        for batch in batches:
            types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names[1:])])
            for conv, role, text, learned, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "read_role", "read_text", "learned", "chars")), strict=True):
                if held is None or conv != key:
                    if held is not None:
                        close()
                    key, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if learned is not None:
                    held[2] += len(learned)
                    held[3].update(learned.encode("utf-8", "surrogatepass"))
                held[4] += chars
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
                done = []
        if held is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, types)

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "read_role", "read_text")
    return ordered.select("conv_id", "read_role", "read_text", "learned", "chars").mapInArrow(run, schema)
