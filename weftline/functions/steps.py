"""The steps of a pipe chain as column expressions.

A chain carries a value and whether it is valid. Steps that check or convert clear the flag where a value that is not null does not pass; ``*_if_invalid`` steps read it.
Conversions give null instead of failing. Steps that act on the whole row (drop, warn) are collected for the compiler.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.lang.syntax import Step, unquote


@dataclass(frozen=True)
class Value:
    """A chain's state: drops and warnings are conditions under which the row goes, or is reported."""

    column: Column
    valid: Column
    drops: tuple[Column, ...] = ()
    warnings: tuple[tuple[str, Column], ...] = ()
    split_by: str | None = None
    aggregated: bool = False


@dataclass
class Context:
    """What steps need besides their value: parameters of the run, named transforms, how prose is bound, and whether rows are grouped."""

    now: Column = field(default_factory=F.current_timestamp)
    zone: str = "UTC"
    order: Column | None = None
    transforms: dict[str, list[Step]] = field(default_factory=dict)
    bindings: dict[str, Callable[[Column], Column] | str] = field(default_factory=dict)
    grouped: bool = False
    unresolved: list[str] = field(default_factory=list)


Arguments = list[str]
StepFunction = Callable[[Value, Arguments, Context], Value]
STEPS: dict[str, StepFunction] = {}
AGGREGATES = {"count", "sum", "min", "max", "first", "last", "distinct", "avg", "average", "any", "count_distinct"}


def step(*names: str) -> Callable[[StepFunction], StepFunction]:
    def add(f: StepFunction) -> StepFunction:
        STEPS.update(dict.fromkeys(names, f))
        return f

    return add


def _plain(name: str, f: Callable[..., Column]) -> None:
    """A step that only changes the value."""
    STEPS[name] = lambda v, a, c: replace(v, column=f(v.column, *a))


def _number(text: str) -> Column:
    return F.lit(float(text) if "." in text else int(text))


_plain("trim", F.trim)
_plain("lowercase", F.lower)
_plain("uppercase", F.upper)
_plain("title_case", F.initcap)
_plain("prepend", lambda x, s: F.concat(F.lit(s), x))
_plain("append", lambda x, s: F.concat(x, F.lit(s)))
_plain("truncate", lambda x, n: F.left(x, F.lit(int(n))))
_plain("max_length", lambda x, n: F.left(x, F.lit(int(n))))
_plain("pad_left", lambda x, n, c=" ": F.lpad(x, int(n), c))
_plain("pad_right", lambda x, n, c=" ": F.rpad(x, int(n), c))
_plain("replace", lambda x, a, b="": F.replace(x, F.lit(a), F.lit(b)))
_plain("escape_html", lambda x: _escaped(x))
_plain("null_if_empty", lambda x: F.nullif(x, F.lit("")))
_plain("coalesce", lambda x, v: F.coalesce(x, _literal(v)))
_plain("to_string", lambda x: x.cast("string"))
_plain("truncate_to_date", lambda x: x.cast("date"))
_plain("to_iso8601", lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
_plain("md5", lambda x: F.md5(x.cast("string")))
_plain("dv_hash_key", lambda x: F.sha2(F.upper(F.trim(x.cast("string"))), 256))
_plain("concat", lambda x, *more: F.concat(x, *(F.lit(m) for m in more)))
_plain("size", lambda x: F.size(x))
_plain("to_json", lambda x: F.to_json(x))


def _escaped(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def _literal(text: str) -> Column:
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return _number(text)
    return {"true": F.lit(True), "false": F.lit(False), "null": F.lit(None)}.get(text, F.lit(text))


def _converted(v: Value, new: Column) -> Value:
    return replace(v, column=new, valid=v.valid & (v.column.isNull() | new.isNotNull()))


@step("round")
def _round(v: Value, a: Arguments, c: Context) -> Value:
    return replace(v, column=F.round(v.column, int(a[0]) if a else 0))


@step("to_number", "to_decimal")
def _to_decimal(v: Value, a: Arguments, c: Context) -> Value:
    size = ", ".join(a) if a else "38, 18"
    return _converted(v, v.column.try_cast(f"decimal({size})"))


@step("to_boolean")
def _to_boolean(v: Value, a: Arguments, c: Context) -> Value:
    return _converted(v, v.column.try_cast("boolean"))


@step("to_integer", "to_int")
def _to_integer(v: Value, a: Arguments, c: Context) -> Value:
    return _converted(v, v.column.try_cast("bigint"))


@step("to_date")
def _to_date(v: Value, a: Arguments, c: Context) -> Value:
    return _converted(v, v.column.try_cast("date") if not a else F.try_to_timestamp(v.column, F.lit(date_pattern(a[0]))).cast("date"))


@step("parse")
def _parse(v: Value, a: Arguments, c: Context) -> Value:
    return _converted(v, F.try_to_timestamp(v.column.cast("string"), F.lit(date_pattern(" ".join(a)))))


def date_pattern(text: str) -> str:
    """A date format as specifications write it, in Spark's letters: YYYY and DD are years and days of the month."""
    return text.replace("YYYY", "yyyy").replace("YY", "yy").replace("DD", "dd")


@step("to_utc")
def _to_utc(v: Value, a: Arguments, c: Context) -> Value:
    return replace(v, column=F.to_utc_timestamp(v.column, a[0] if a else c.zone))


@step("assume_utc")
def _assume_utc(v: Value, a: Arguments, c: Context) -> Value:
    return v


@step("now_utc", "now")
def _now(v: Value, a: Arguments, c: Context) -> Value:
    return replace(v, column=c.now)


@step("split")
def _split(v: Value, a: Arguments, c: Context) -> Value:
    return replace(v, column=F.split(v.column, re.escape(a[0])), split_by=a[0])


@step("first", "last")
def _ends(v: Value, a: Arguments, c: Context) -> Value:
    raise NotImplementedError  # resolved by name in apply()


@step("validate_email")
def _validate_email(v: Value, a: Arguments, c: Context) -> Value:
    good = v.column.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    return replace(v, valid=v.valid & (v.column.isNull() | good))


@step("null_if_invalid")
def _null_if_invalid(v: Value, a: Arguments, c: Context) -> Value:
    return replace(v, column=F.when(v.valid, v.column), valid=F.lit(True))


def _bad(v: Value, name: str) -> Column:
    return v.column.isNull() if name.endswith("null") else ~v.valid


for _name in ("drop_if_invalid", "drop_if_null"):
    STEPS[_name] = lambda v, a, c, n=_name: replace(v, drops=(*v.drops, _bad(v, n)))
for _name in ("warn_if_invalid", "warn_if_null"):
    STEPS[_name] = lambda v, a, c, n=_name: replace(v, warnings=(*v.warnings, (n, _bad(v, n))))
for _name in ("error_if_invalid", "error_if_null"):
    STEPS[_name] = lambda v, a, c, n=_name: replace(v, column=F.when(_bad(v, n), F.raise_error(F.lit(n))).otherwise(v.column))


@step("hash")
def _hash(v: Value, a: Arguments, c: Context) -> Value:
    algorithm = (a[0] if a else "sha256").lower().replace("-", "")
    text = v.column.cast("string")
    return replace(v, column={"md5": F.md5(text), "sha1": F.sha1(text)}.get(algorithm, F.sha2(text, int(algorithm[3:] or 256) if algorithm.startswith("sha") else 256)))


@step("encrypt")
def _encrypt(v: Value, a: Arguments, c: Context) -> Value:
    key = c.bindings.get(a[-1] if a else "key")
    if not isinstance(key, str):
        raise ValueError(f"no key bound for {a[-1] if a else 'encrypt'}")
    return replace(v, column=F.base64(F.aes_encrypt(v.column.cast("string"), F.lit(key), F.lit("GCM"))))


@step("uuid_v5")
def _uuid_v5(v: Value, a: Arguments, c: Context) -> Value:
    """The name-based UUID of version 5: SHA-1 of namespace and name, with version and variant bits set."""
    space = a[0].replace("-", "")
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), v.column.cast("string").cast("binary")))
    part = lambda i, n: F.substring(digest, i, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return replace(v, column=F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)))


@step("uuid_v4")
def _uuid_v4(v: Value, a: Arguments, c: Context) -> Value:
    return replace(v, column=F.expr("uuid()"))


def _aggregate(name: str, v: Value, c: Context) -> Value:
    """first and last follow the context's order; without one, the least and greatest value stand for them, so that results are reproducible."""
    x, order = v.column, c.order
    made = {
        "count": lambda: F.count(x), "sum": lambda: F.sum(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "avg": lambda: F.avg(x), "average": lambda: F.avg(x),
        "any": lambda: F.bool_or(x), "count_distinct": lambda: F.count_distinct(x), "distinct": lambda: F.sort_array(F.collect_set(x)),
        "first": lambda: F.min_by(x, order) if order is not None else F.min(x), "last": lambda: F.max_by(x, order) if order is not None else F.max(x),
    }[name]()
    return replace(v, column=made, aggregated=True)


def value_map(x: Column, entries: list[tuple[str, str, str | None]]) -> Column:
    """A CASE over keys: equality, comparison, null and default; the first that matches counts. Without a default, what matches nothing is null."""
    out, default = None, None
    for compare, key, value in entries:
        value = F.lit(None) if value is None else _literal(value) if value in ("true", "false") else F.lit(value)
        if key == "\0default":
            default = value
            continue
        if key == "\0null":
            test = x.isNull()
        elif compare:
            number = _literal(key)
            test = {"<": x < number, "<=": x <= number, ">": x > number, ">=": x >= number, "==": x == number, "!=": x != number}[compare]
        else:
            test = x.cast("string") == F.lit(key)
        out = F.when(test, value) if out is None else out.when(test, value)
    if out is None:
        return default if default is not None else F.lit(None)
    return out if default is None else out.otherwise(default)


def arguments(atoms: list[tuple[str, str]]) -> Arguments:
    """What follows a step's name, with or without parentheses and commas; dashes and dots join their neighbours."""
    out: Arguments = []
    joined: bool | None = False  # True: the next atom goes on; None: the last token was an atom
    for kind, text in atoms:
        if kind == "mark" and text in "(),":
            joined = False
        elif kind == "mark" and text in ".-":
            if out and (text == "." or joined is None):
                out[-1] += text
            else:
                out.append(text)
            joined = True
        elif joined:
            out[-1] += text
            joined = None
        else:
            out.append(unquote(text))
            joined = None
    return out


def apply(value: Value, chain: list[Step], context: Context, seen: tuple[str, ...] = ()) -> Value | None:
    """The value after a chain; None if a step is prose without a binding, which is then in context.unresolved."""
    for one in chain:
        if one.kind == "map":
            value = replace(value, column=value_map(value.column, one.entries))
            continue
        if one.kind == "spread":
            if one.text in seen or one.text not in context.transforms:
                context.unresolved.append(f"...{one.text}")
                return None
            got = apply(value, context.transforms[one.text], context, (*seen, one.text))
            if got is None:
                return None
            value = got
            continue
        kind, name = one.atoms[0] if one.atoms else ("", "")
        args = arguments(one.atoms[1:])
        bound = context.bindings.get(one.text) or context.bindings.get(unquote(one.text))
        if bound is not None:
            value = replace(value, column=bound(value.column) if callable(bound) else F.expr(bound))
        elif kind == "mark" and name in "*/+-" and len(args) == 1:
            number = _number(args[0])
            value = replace(value, column={"*": value.column * number, "/": value.column / number, "+": value.column + number, "-": value.column - number}[name])
        elif kind == "name" and context.grouped and name in AGGREGATES and value.split_by is None and not value.aggregated:
            value = _aggregate(name, value, context)
        elif kind == "name" and name in ("first", "last") and not context.grouped or kind == "name" and name in ("first", "last") and value.split_by is not None:
            value = replace(value, column=F.element_at(value.column, 1 if name == "first" else -1), split_by=None)
        elif kind == "name" and name in STEPS:
            value = STEPS[name](value, args, context)
        elif len(one.atoms) == 1 and (kind == "number" or name in ("true", "false", "null")):
            value = replace(value, column=_literal(name))
        elif len(one.atoms) == 1 and kind == "string" and len(chain) == 1 and context.bindings.get("constants") and "@" not in name:
            value = replace(value, column=F.lit(unquote(name)))
        else:
            context.unresolved.append(one.text)
            return None
    return value
