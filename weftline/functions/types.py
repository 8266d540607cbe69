"""Type tokens of specifications to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from weftline.lang.syntax import Field

#: Tokens by the Spark type that stands for them.
_PLAIN = {
    **dict.fromkeys(("INT", "INTEGER", "INT32"), T.IntegerType()), **dict.fromkeys(("BIGINT", "LONG", "INT64"), T.LongType()),
    **dict.fromkeys(("NUMBER", "CURRENCY", "PERCENT", "DECIMAL", "NUMERIC"), T.DecimalType(38, 18)), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    **dict.fromkeys(("BOOLEAN", "BOOL"), T.BooleanType()), "DATE": T.DateType(), "TIMESTAMPTZ": T.TimestampType(), "BINARY": T.BinaryType(),
    **dict.fromkeys(("TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"), T.TimestampNTZType()),
}
#: Tokens that stand for strings.
_STRINGS = {"STRING", "VARCHAR", "CHAR", "TEXT", "UUID", "ID", "PICKLIST", "JSON", "EMAIL", "PHONE", "URL", "ENUM", "TIME", "ISO-4217", "ISO-3166-a2"}


def spark_type(token: str | None) -> tuple[T.DataType, bool]:
    """The Spark type of a token, and whether the token is known; unknown ones are strings."""
    if token is None:
        return T.StringType(), False
    name, _, rest = token.partition("(")
    sizes = [int(x) for x in re.findall(r"\d+", rest)]
    if name.upper() in ("DECIMAL", "NUMBER", "NUMERIC") and sizes:
        return T.DecimalType(sizes[0], sizes[1] if len(sizes) > 1 else 0), True
    if name.upper() in _PLAIN:
        return _PLAIN[name.upper()], True
    return T.StringType(), name in _STRINGS or name.upper() in _STRINGS


def field_type(field: Field) -> T.DataType:
    """The type of a field: a record is a struct, a list an array."""
    kind = struct_type(field.children) if field.is_record else spark_type(field.type)[0]
    return T.ArrayType(kind) if field.is_list else kind


def struct_type(fields: list[Field]) -> T.StructType:
    """The struct of fields; type tokens and tags go to the fields' metadata."""
    return T.StructType([
        T.StructField(f.name, field_type(f), not any(m.key in ("required", "pk") for m in f.meta), {"type": f.type or "", "tags": [m.key for m in f.meta]}) for f in fields
    ])
