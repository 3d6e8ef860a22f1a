"""Scalars over text edits, cursors, marks, JSON values and undo records; and the simulators' generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The palettes that users' colours come from, in order.
CURSOR_COLORS = ("#E91E63", "#9C27B0", "#3F51B5", "#2196F3", "#00BCD4", "#009688", "#4CAF50", "#8BC34A", "#CDDC39", "#FF9800", "#FF5722", "#795548")
USER_COLORS = ("#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#98D8C8", "#F7DC6F", "#E74C3C", "#3498DB", "#2ECC71", "#9B59B6", "#1ABC9C", "#F39C12", "#E91E63", "#00BCD4")
BIGGEST = 9223372036854775807


def saturating_add(a: Column, b: Column) -> Column:
    """a + b of non-negative numbers, held at the greatest BIGINT."""
    return F.coalesce(F.try_add(a, b), F.lit(BIGGEST))


def clamp_long(x: Column) -> Column:
    """A wide decimal as BIGINT, held at its ends."""
    return F.greatest(F.least(x, F.lit(BIGGEST).cast("decimal(38,0)")), F.lit(-BIGGEST - 1).cast("decimal(38,0)")).cast("long")


def selection_range(anchor: Column, position: Column) -> tuple[Column, Column]:
    """(start, end), null without a selection."""
    has = has_selection(anchor, position)
    return F.when(has, F.least(anchor, position)), F.when(has, F.greatest(anchor, position))


def has_selection(anchor: Column, position: Column) -> Column:
    return anchor.isNotNull() & (anchor != position)


def selection_length(anchor: Column, position: Column) -> Column:
    return F.when(has_selection(anchor, position), F.abs(position - anchor)).otherwise(0)


def ordered_selection(start: Column, end: Column) -> Column:
    """A selection with its cursor at the later end."""
    return F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), F.greatest(start, end).alias("cursor"))


def color_for_user(user: Column, palette: tuple[str, ...] = CURSOR_COLORS) -> Column:
    """Palette entry by the sum of the name's UTF-8 bytes."""
    digits = F.hex(F.encode(user, "utf-8"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"), F.lit(0).cast("long")))
    return F.element_at(F.array(*map(F.lit, palette)), (total % len(palette) + 1).cast("int"))


def picked_color(key: Column, palette: tuple[str, ...] = USER_COLORS) -> Column:
    """A palette entry that looks random but repeats for equal keys."""
    return F.element_at(F.array(*map(F.lit, palette)), (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % len(palette) + 1).cast("int"))


def replica_name(ts_ms: Column, key: Column) -> Column:
    """"<ms>-<hex>", the hex from a hash of key, so that it repeats."""
    return F.concat(ts_ms.cast("string"), F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))


def mark_open_tag(kind: Column, a1: Column, a2: Column) -> Column:
    """Fixed tags per kind; a1 and a2 are url, author and content, colour, or name and value."""
    return (
        F.when(kind == "Bold", "<strong>")
        .when(kind == "Italic", "<em>")
        .when(kind == "Underline", "<u>")
        .when(kind == "Strikethrough", "<s>")
        .when(kind == "Code", "<code>")
        .when(kind == "Link", F.concat(F.lit('<a href="'), a1, F.lit('">')))
        .when(kind == "Comment", F.concat(F.lit('<span data-comment-author="'), a1, F.lit('" data-comment="'), a2, F.lit('">')))
        .when(kind == "Highlight", F.concat(F.lit('<mark style="background-color:'), a1, F.lit('">')))
        .otherwise(F.concat(F.lit("<span data-"), F.coalesce(a1, F.lit("")), F.lit('="'), F.coalesce(a2, F.lit("")), F.lit('">')))
    )


def mark_close_tag(kind: Column) -> Column:
    return (
        F.when(kind == "Bold", "</strong>")
        .when(kind == "Italic", "</em>")
        .when(kind == "Underline", "</u>")
        .when(kind == "Strikethrough", "</s>")
        .when(kind == "Code", "</code>")
        .when(kind == "Link", "</a>")
        .when(kind == "Highlight", "</mark>")
        .otherwise("</span>")
    )


def marks_conflict(kind: Column, other: Column) -> Column:
    """Marks of one kind exclude each other, of those kinds that a character has once."""
    return (kind == other) & kind.isin("Bold", "Italic", "Underline", "Strikethrough", "Code", "Link")


def as_kind(value: Column, kind: str) -> Column:
    """Typed extraction from a tagged JSON value (kind, b, i, f, s, ref): null if it is of another kind."""
    field = {"Bool": "b", "Int": "i", "Float": "f", "String": "s", "Object": "ref", "Array": "ref"}[kind]
    return F.when(value["kind"] == kind, value[field])


def is_null_value(value: Column) -> Column:
    return value["kind"] == "Null"


def inverse_text(op_kind: Column, position: Column, deleted: Column, inserted: Column) -> Column:
    """insert <-> delete; replace swaps what went and what came."""
    kind = F.when(op_kind == "insert", "delete").when(op_kind == "delete", "insert").otherwise(op_kind)
    return F.struct(kind.alias("op_kind"), position.alias("position"), inserted.alias("deleted"), deleted.alias("inserted"))


def inverse_format(op_kind: Column, mark_id: Column, mark: Column) -> Column:
    """add_mark <-> remove_mark; the mark itself travels along, so a removal can be undone."""
    return F.struct(F.when(op_kind == "add_mark", "remove_mark").when(op_kind == "remove_mark", "add_mark").otherwise(op_kind).alias("op_kind"), mark_id.alias("mark_id"), mark.alias("mark"))


def inverse_json(op_kind: Column, path: Column, index: Column, old: Column, new: Column) -> Column:
    """set -> set back (or delete if there was nothing), delete -> set, array_insert <-> array_remove."""
    kind = F.when((op_kind == "set") & old.isNull(), "delete").when(op_kind == "set", "set").when(op_kind == "delete", "set").when(op_kind == "array_insert", "array_remove").when(op_kind == "array_remove", "array_insert").otherwise(op_kind)
    return F.struct(kind.alias("op_kind"), path.alias("path"), index.alias("index"), new.alias("old"), old.alias("new"))


def lcg_next(state: Column) -> Column:
    """Next state of the simulators' linear congruential generator, modulo 2^31 (its output needs no higher bits)."""
    return (state % F.lit(2147483648) * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)


def lcg_uniform(state: Column) -> Column:
    """Number in [0, 1) of a state."""
    return F.shiftright(state, 16).bitwiseAND(F.lit(0x7FFF)) / F.lit(32768.0)


def lcg_stream(seed: int, n: int) -> list[float]:
    """The first n numbers of the generator: seeds of a simulated link on the driver, n being small."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 64)
        out.append(((x >> 16) & 0x7FFF) / 32768)
    return out
