"""Canonical JSON and the hashes over it.

Keys in code-point order at every level, no white space, absent instead of null, integers only, and
control characters as lower-case escapes. Rows with a schema are written by Spark's own JSON writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(column: Column, kind: T.DataType) -> Column:
    """The column with the fields of its structs sorted by name."""
    if isinstance(kind, T.StructType):
        fields = [ordered(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: ordered(x, kind.elementType))
    return column


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    text = F.to_json(F.struct(*[ordered(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(columns)]))
    return lower_escapes(text)


def lower_escapes(text: Column) -> Column:
    r"""\u001F to \u001f: only the hex of true escapes, those after an even number of backslashes."""
    fixed = text
    for digit in "ABCDEF":
        for high in "01":
            fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{high}{digit}", rf"$1\\u00{high}{digit.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), fixed).otherwise(text)


def sha256_ref(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def entry_hash(df: DataFrame, without: str = "entry_hash") -> Column:
    """sha256 reference of a ledger row without its own hash."""
    return sha256_ref(canonical_json(df, [c for c in df.columns if c != without]))


def key_id(public_key_hex: Column) -> Column:
    return F.when(public_key_hex.rlike("^[0-9a-f]{64}$"), F.sha2(F.unhex(public_key_hex), 256))


def unknown_keys(raw: Column, known: list[str]) -> Column:
    """Keys of a JSON object that a closed schema doesn't have."""
    return F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
