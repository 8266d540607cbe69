"""Data sources and sinks that specifications declare: a schema's ``format`` and its fields' selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.types import field_type, struct_type
from weftline.lang.names import Workspace
from weftline.lang.syntax import Field, Meta
from weftline.sources import copybook


def _value(meta: list[Meta], key: str) -> str | None:
    return next((m.value for m in meta if m.key == key and m.value is not None), None)


def read(spark: SparkSession, workspace: Workspace, schema: str, path: str, row_tag: str = "row") -> DataFrame:
    """The rows at path in the format that the schema declares (parquet where it declares none), with its fields as columns.

    Nothing is inferred: JSON, CSV and XML are read by the declared types. Fields of fixed-length records need offset (from 0) and length.
    """
    block = workspace.schemas[schema]
    form = (block.value("format") or "parquet").lower()
    fields = workspace.fields[schema]
    if form == "parquet":
        return spark.read.parquet(path)
    if form in ("json", "csv", "orc"):
        return spark.read.schema(struct_type(fields)).format(form).option("header", "true").load(path)
    if form == "xml":
        return spark.read.schema(struct_type(fields)).format("xml").option("rowTag", row_tag).load(path)
    if form == "copybook":
        return copybook.read(spark, workspace, schema, path)
    if form == "fixed-length":
        return spark.read.text(path).select(*fixed_length(F.col("value"), fields))
    if form in ("avro", "protobuf"):
        return spark.read.format(form).load(path)  # needs Spark's add-on package
    raise ValueError(f"no reader for format {form!r}")


def fixed_length(line: Column, fields: list[Field]) -> list[Column]:
    """A column for each field that has offset and length, trimmed and of its declared type; what doesn't convert is null.

    A field with ``scale n`` holds digits with an implied decimal point.
    """
    out = []
    for f in fields:
        at, length, scale = (_value(f.meta, k) for k in ("offset", "length", "scale"))
        if at is None or length is None:
            continue
        text = F.trim(F.substring(line, int(at) + 1, int(length)))
        if scale:
            text = text.try_cast("decimal(38,0)") / F.lit(10 ** int(scale))
        out.append(text.try_cast(field_type(f)).alias(f.name))
    return out


def selected(document: Column, fields: list[Field]) -> list[Column]:
    """A column for each field that an ``xpath`` or ``jsonpath`` selects from a document column; lists are arrays."""
    out = []
    for f in fields:
        xpath, json = _value(f.meta, "xpath"), _value(f.meta, "jsonpath")
        if xpath:
            got = F.xpath(document, F.lit(xpath)) if f.is_list else F.xpath_string(document, F.lit(xpath))
        elif json:
            got = F.from_json(F.get_json_object(document, json), "array<string>") if f.is_list else F.get_json_object(document, json)
        else:
            continue
        out.append(got.try_cast(field_type(f)).alias(f.name))
    return out


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for files or services."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def column_lineage(fedges: DataFrame) -> DataFrame:
    """dataset, facet: a column-lineage facet in JSON for each target schema: its fields, the input fields of each, and how they are made."""
    part = lambda c, i: F.regexp_extract(c, r"^([^.]*)\.(.*)$", i)
    how = F.when(F.col("classification") == "none", "IDENTITY").otherwise("TRANSFORMED")
    inputs = fedges.groupBy(part("dst", 1).alias("dataset"), part("dst", 2).alias("field")).agg(F.array_sort(F.collect_set(F.struct(part("src", 1).alias("name"), part("src", 2).alias("field"), how.alias("transformationType")))).alias("inputFields"))
    made = inputs.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("inputFields"))))).alias("fields"))
    return made.select("dataset", F.to_json(F.struct("fields")).alias("facet"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
