"""The set of files that a specification consists of: an entry file and what it imports."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Mapping

from pyspark.sql import SparkSession

from weftline.lang.syntax import Module, parse


def load(entry: str, texts: Mapping[str, str] | None = None, follow_imports: bool = True) -> list[Module]:
    """The modules of entry and its imports, sorted by file. texts: the files' contents by path, instead of the local file system.

    A directory is an error. A missing import is a row in the importing module's errors, and is skipped. Files are read once, so import cycles end.
    """
    if texts is None and os.path.isdir(entry):
        raise IsADirectoryError(entry)
    waiting, found = [entry], {}
    while waiting:
        path = waiting.pop()
        if path in found:
            continue
        found[path] = module = parse(texts[path] if texts is not None else _read(path), path)
        for _, where, row in module.imports if follow_imports else ():
            other = posixpath.normpath(posixpath.join(posixpath.dirname(path), where))
            if other in texts if texts is not None else os.path.isfile(other):
                waiting.append(other)
            else:
                module.errors.append((row, 0, f"missing import {where}"))
    return [found[k] for k in sorted(found)]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_with_spark(spark: SparkSession, paths: list[str]) -> list[Module]:
    """The modules of files in any store that Spark reads; imports are not followed. Specifications are small, so their texts come to the driver."""
    rows = spark.read.text(paths, wholetext=True).selectExpr("input_file_name() AS file", "value").collect()
    return [parse(r["value"], r["file"]) for r in sorted(rows, key=lambda r: r["file"])]
