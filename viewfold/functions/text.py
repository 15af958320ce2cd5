"""Names, templates, colours and addresses as column expressions."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


# fixed values: the characters a file name may keep, and the four patterns of identifiers
FILENAME_CHARS = r"-_.()!@#$& A-Za-z0-9"
WORD_START, WORD_BREAK, NOT_IDENTIFIER, LEADING_DIGIT = r"([^\n])([A-Z][a-z]+)", r"([a-z0-9])([A-Z])", r"[^0-9a-zA-Z_]", r"^([0-9])"


def clean_filename(c: Column) -> Column:
    """Each run of other characters than FILENAME_CHARS as one _."""
    return F.regexp_replace(c, f"[^{FILENAME_CHARS}]+", "_")


def snake_case(c: Column) -> Column:
    """camelCase as lower case with _ between words: before a capital that lower-case letters
    follow, and between a lower-case letter or digit and a capital. Each character that can't stand
    in an identifier becomes a _, so several may stand in a row; a leading digit gets one too."""
    for pattern in (WORD_START, WORD_BREAK):
        c = F.regexp_replace(c, pattern, "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(c), NOT_IDENTIFIER, "_"), LEADING_DIGIT, "_$1")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique in order: a name that is taken tries _1, _2, … until one is free.

    Only names that are equal but for such endings can meet. Where all of these are the same name
    its repeats are numbered by a window; others are gone through in order, a family at a time."""
    rows = df.withColumn("__root", F.regexp_replace(name, r"(_[0-9]+)+$", ""))
    family = W.partitionBy("__root")
    rows = rows.withColumn("__mixed", F.min(name).over(family) != F.max(name).over(family))
    n = F.row_number().over(W.partitionBy("__root").orderBy(order)) - 1
    plain = rows.where(~F.coalesce("__mixed", F.lit(False))).withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))

    def walk(t):
        import pyarrow as pa

        t = t.sort_by(order)
        taken: set[str] = set()
        tried: dict[str, int] = {}
        out = []
        for x in t.column(name).to_pylist():
            got = x
            while got in taken:
                tried[x] = tried.get(x, 0) + 1
                got = f"{x}_{tried[x]}"
            taken.add(got)
            out.append(got)
        return t.set_column(t.schema.get_field_index(name), name, pa.array(out, pa.string()))

    mixed = rows.where("__mixed").groupBy("__root").applyInArrow(walk, rows.schema)
    return plain.unionByName(mixed).drop("__root", "__mixed")


def clip_name(prefix: Column, start: Column) -> Column:
    """Prefix, a _ unless the prefix is a folder that ends in /, and the start frame in eight
    places, of which a minus takes one."""
    return F.concat(prefix, F.when(F.endswith(prefix, F.lit("/")), F.lit("")).otherwise(F.lit("_")), F.format_string("%08d", start))


def clip_json(clip: dict[str, Column], results: Column) -> Column:
    """The JSON text that goes with a clip: ``properties`` (timestamp, start_frame, triggered_by,
    duration, pre_trigger_delay, target_fps as given) and ``results``, the frames' results."""
    known = ("timestamp", "start_frame", "triggered_by", "duration", "pre_trigger_delay", "target_fps")
    if set(clip) - set(known):
        raise ValueError(f"unknown properties {sorted(set(clip) - set(known))}")
    return F.to_json(F.struct(F.struct(*(clip[k].alias(k) for k in known if k in clip)).alias("properties"), results.alias("results")))


_FIELD = re.compile(r"\$\{\{\s*([^${}]*?)\s*\}\}|\$\{\s*([^${}]*?)\s*\}")


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


_OPERATORS = {
    ast.Add: lambda a, b: F.try_add(a, b),
    ast.Sub: lambda a, b: F.try_subtract(a, b),
    ast.Mult: lambda a, b: F.try_multiply(a, b),
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: _floor_divide,
    ast.Mod: lambda a, b: F.try_subtract(a, F.try_multiply(_floor_divide(a, b), b)),
}


def _column(node: ast.AST, fields: dict[str, Column]) -> Column:
    """A parsed expression as a column; LookupError for names and forms that are not known."""
    if isinstance(node, ast.Name) and node.id in fields:
        return fields[node.id]
    if isinstance(node, ast.Attribute):
        return _column(node.value, fields).getField(node.attr)
    if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant):
        k, inner = node.slice.value, _column(node.value, fields)
        return inner.getField(k) if isinstance(k, str) else F.get(inner, F.lit(k))
    if isinstance(node, ast.Constant) and type(node.value) in (int, float, str):
        return F.lit(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_column(node.operand, fields)
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        return _OPERATORS[type(node.op)](_column(node.left, fields), _column(node.right, fields))
    raise LookupError(ast.dump(node))


def template(text: str, fields: dict[str, Column]) -> Column:
    """``${…}`` and ``${{…}}`` replaced by what they say of the columns ``fields``: names, parts of
    structs and maps by .name or ["name"], elements of arrays by [number], numbers, text, and
    + - * / // % with parentheses over them. What can't be understood or computed stays as
    written, innermost braces count, and a null name reads None. The text is parsed into an
    expression of columns; nothing in it is evaluated as code."""
    parts: list[Column] = []
    at = 0
    for m in _FIELD.finditer(text):
        parts.append(F.lit(text[at : m.start()]))
        at = m.end()
        try:
            tree = ast.parse(m[1] or m[2] or "", mode="eval").body
            c = _column(tree, fields).cast("string")
        except (LookupError, SyntaxError, ValueError):
            parts.append(F.lit(m[0]))
            continue
        parts.append(F.coalesce(c, F.lit(m[0] if isinstance(tree, (ast.BinOp, ast.UnaryOp)) else "None")))
    return F.concat(*parts, F.lit(text[at:]))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def text_colour(r: Column, g: Column, b: Column) -> Column:
    """Black on light colours, else white."""
    return F.when(luminance(r, g, b) > 180, F.array(*[F.lit(0)] * 3)).otherwise(F.array(*[F.lit(255)] * 3))


def complement(r: Column, g: Column, b: Column) -> Column:
    return F.array(*(F.lit(255) - c for c in (r, g, b)))


def swap_channels(rgb: Column) -> Column:
    return F.reverse(rgb)


def object_url(endpoint: Column, bucket: Column, name: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(endpoint, "/+$", ""), bucket, name)


def split_model_url(url: Column) -> Column:
    """(zoo_url, model_name): cut at the last slash."""
    return F.struct(F.regexp_extract(url, r"^(.*)/[^/]*$", 1).alias("zoo_url"), F.regexp_extract(url, r"([^/]*)$", 1).alias("model_name"))


def media_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "bmp", "gif", "webp"), "image").when(ext.isin("mp4", "avi", "mov", "mkv", "webm"), "video").when(ext.isin("wav", "mp3", "flac"), "audio")
