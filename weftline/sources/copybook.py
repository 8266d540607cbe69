"""Mainframe records: EBCDIC text, zoned and packed decimals, binary numbers and groups that occur as often as a field says, all as column expressions over a binary column.

A field's place is its ``offset`` (from 1), or what follows the field before it; its size its ``length``, or what its ``pic`` takes. ``encoding`` (of the field, else of the schema) is comp-3 for packed
decimals, comp for binary numbers, and ebcdic or ascii for text and zoned digits. ``redefines`` gives the same bytes another meaning. A list has ``occurs`` (its greatest number) and ``depends_on``, the
field that holds its number; its elements follow each other. What is no number of its kind is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.types import field_type
from weftline.lang.names import Workspace
from weftline.lang.syntax import Field, Meta

_BYTES = bytes(range(256))
#: Each byte as the character of its number, and as the one that it is in EBCDIC (code page 37).
_LATIN, _EBCDIC = _BYTES.decode("latin-1"), _BYTES.decode("cp037")
#: The last digit of a signed zoned number, 0 to 9, if it is positive and if it is negative.
_PLUS, _MINUS = "{ABCDEFGHI", "}JKLMNOPQR"


def from_ebcdic(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), _LATIN[1:], _EBCDIC[1:])


def to_ebcdic(text: Column) -> Column:
    """What the code page lacks comes out as another character's byte: check before."""
    return F.encode(F.translate(text, _EBCDIC[1:], _LATIN[1:]), "ISO-8859-1")


def _number(sign: Column, digits: Column, scale: int) -> Column:
    """Digits with an implied point as a decimal; null if the sign or a digit is none."""
    if scale:
        digits = F.concat(F.substring(digits, F.lit(1), F.length(digits) - scale), F.lit("."), F.right(digits, F.lit(scale)))
    return F.concat(sign, digits).try_cast(f"decimal(38,{scale})")


def unpacked(data: Column, scale: int = 0) -> Column:
    """A packed decimal: two digits a byte, the last half byte its sign (D and B: negative)."""
    halves = F.hex(data)
    sign = F.translate(F.right(halves, F.lit(1)), "0123456789ABCDEF", "xxxxxxxxxx+-+-++")
    return _number(sign, F.substring(halves, F.lit(1), F.length(halves) - 1), scale)


def packed(value: Column, digits: int, scale: int = 0) -> Column:
    """A number as a packed decimal of so many digits, of which scale are behind the point; null where it does not fit."""
    size = digits // 2 + 1
    whole = F.round(value.cast("decimal(38,10)") * F.lit(10**scale)).cast("decimal(38,0)")
    text = F.lpad(F.abs(whole).cast("string"), 2 * size - 1, "0")
    fits = F.length(F.abs(whole).cast("string")) <= digits
    return F.when(fits, F.unhex(F.concat(text, F.when(whole < 0, "D").otherwise("C"))))


def zoned(text: Column, scale: int = 0) -> Column:
    """Digits, the last of which may carry the sign."""
    digits = "0123456789"
    last = F.right(text, F.lit(1))
    sign = F.translate(last, f"{_PLUS}{digits}{_MINUS} ", "+" * 20 + "-" * 10 + "x")
    body = F.substring(text, F.lit(1), F.length(text) - 1)
    return _number(sign, F.concat(body, F.translate(last, _PLUS + _MINUS, digits * 2)), scale)


def binary(data: Column, size: int, scale: int = 0) -> Column:
    """A binary number of size bytes, the highest first, negative ones by two's complement."""
    raw = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    whole = F.when(raw >= F.lit(1 << (8 * size - 1)).cast("decimal(20,0)"), raw - F.lit(1 << (8 * size)).cast("decimal(20,0)")).otherwise(raw)
    return whole * F.lit(f"1e-{scale}").cast(f"decimal({max(scale, 1) + 1},{scale})")


def _value(meta: list[Meta], key: str) -> str | None:
    return next((m.value for m in meta if m.key == key and m.value is not None), None)


def picture(pic: str) -> tuple[str, int, int]:
    """(X or 9, places, of which behind the point) of a picture such as X(20) or S9(7)V99."""
    plain = re.sub(r"([X9A])\((\d+)\)", lambda m: m.group(1) * int(m.group(2)), pic.strip().upper().lstrip("S"))
    if not re.fullmatch(r"[XA]+|9*V?9*", plain) or not plain.replace("V", ""):
        raise ValueError(f"picture {pic!r} is not known")
    head, _, tail = plain.partition("V")
    return ("9" if "9" in plain else "X"), len(head) + len(tail), len(tail)


def _encoding(field: Field, outer: str) -> str:
    return (_value(field.meta, "encoding") or outer).lower()


def size(field: Field, encoding: str) -> int:
    """The bytes that a field takes, one element of it if it is a list."""
    if field.children:
        return sum(size(c, encoding) * _times(c) for c in field.children if _value(c.meta, "redefines") is None)
    told, pic = _value(field.meta, "length"), _value(field.meta, "pic")
    if told is not None:
        return int(told)
    if pic is None:
        raise ValueError(f"{field.name} has neither length nor pic")
    _, places, _ = picture(pic)
    kind = _encoding(field, encoding)
    return places // 2 + 1 if kind == "comp-3" else (2 if places < 5 else 4 if places < 10 else 8) if kind == "comp" else places


def _times(field: Field) -> int:
    return int(_value(field.meta, "occurs") or 1) if field.is_list else 1


def _cell(record: Column, field: Field, at: Column, encoding: str) -> Column:
    kind, width = _encoding(field, encoding), size(field, encoding)
    data = F.substring(record, at, F.lit(width))
    form, _, scale = picture(_value(field.meta, "pic") or f"X({width})")
    text = F.decode(data, "ISO-8859-1") if kind == "ascii" else from_ebcdic(data)
    got = unpacked(data, scale) if kind == "comp-3" else binary(data, width, scale) if kind == "comp" else zoned(text, scale) if form == "9" else F.rtrim(text)
    return got.try_cast(field_type(field))


def columns(record: Column, fields: list[Field], encoding: str = "ebcdic", start: Column | int = 1) -> list[Column]:
    """A column for each field of a record that begins at byte start; records are structs, lists arrays."""
    out: list[Column] = []
    here = F.lit(start) if isinstance(start, int) else start
    places: dict[str, Column] = {}
    made: dict[str, Column] = {}
    for f in fields:
        told, again = _value(f.meta, "offset"), _value(f.meta, "redefines")
        at = F.lit(int(told)) if told is not None else places[again] if again in places else here
        places[f.name] = at
        width, most = size(f, encoding), _times(f)

        def element(place: Column, f: Field = f) -> Column:
            return F.struct(*columns(record, f.children, _encoding(f, encoding), place)) if f.children else _cell(record, f, place, encoding)

        if f.is_list:
            counted = _value(f.meta, "depends_on")
            number = F.least(F.coalesce(made[counted].cast("int"), F.lit(0)), F.lit(most)) if counted else F.lit(most)
            steps = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))
            column = F.transform(steps, lambda i: element(at + i * width))  # noqa: B023  it is called here
        else:
            column = element(at)
        made[f.name] = column
        out.append(column.alias(f.name))
        if again is None:
            here = at + F.lit(width * most)
    return out


def read(spark: SparkSession, workspace: Workspace, schema: str, path: str) -> DataFrame:
    """The records of a file, or of a folder of files, that stand one after another, as the schema declares them. Files are read in parts of whole records."""
    block, fields = workspace.schemas[schema], workspace.fields[schema]
    encoding = block.value("encoding") or "ebcdic"
    ends = [0]
    for f in fields:
        told = _value(f.meta, "offset")
        if _value(f.meta, "redefines") is None:
            ends.append((int(told) - 1 if told else ends[-1]) + size(f, encoding) * _times(f))
    records = spark.sparkContext.binaryRecords(path, int(block.value("record_length") or max(ends)))
    rows = spark.createDataFrame(records.map(lambda r: (bytearray(r),)), "value binary")
    return rows.select(*columns(F.col("value"), fields, encoding))
