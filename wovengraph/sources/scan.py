"""Source trees as DataFrames: listing, reading, hashing and parsing of files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wovengraph.functions.text import content_hash, detect_language, parse_eligible, size_class
from wovengraph.operators import mutations
from wovengraph.sources.parse import parse_file
from wovengraph.sources.parse.model import Analysis


def _rows(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


#: The columns of a parsed file beside its path and `failed`: their type, and their rows in an analysis.
_FOUND: dict[str, tuple[pa.DataType, Callable[[Analysis], list[tuple]]]] = {
    "symbols": (
        _rows(ordinal=pa.int32(), id=pa.string(), name=pa.string(), kind=pa.string(), start_line=pa.int64(), start_col=pa.int64(), end_line=pa.int64(), signature=pa.string()),
        lambda a: [(k, s.id, s.name, s.kind, s.start_line, s.start_col, s.end_line, s.signature) for k, s in enumerate(a.symbols)],
    ),
    "contains": (_rows(src=pa.string(), dst=pa.string()), lambda a: a.contains),
    "imports": (_rows(path=pa.string(), line=pa.int64()), lambda a: a.imports),
    "calls": (_rows(owner=pa.string(), name=pa.string(), line=pa.int64(), is_method=pa.bool_()), lambda a: a.calls),
}


def _pattern(body: str) -> str:
    """A rule's glob as a regular expression over relative paths: `*` and `?` stay within a name,
    `**` between slashes crosses folders, and a rule without an inner slash fits at any depth."""
    out = "" if "/" in body.rstrip("/") else "(?:.*/)?"
    body = body.strip("/")
    k = 0
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k) and (k == 0 or body[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if body[k:] == "**" and k and body[k - 1] == "/":
            out, k = out + ".+", k + 2
            continue
        close = body.find("]", k + 2)
        if c == "[" and close > 0:
            inside = body[k + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            negated = inside[0] in "!^"
            out, k = out + ("(?!/)[^" + inside[1:] if negated else "(?!/)[" + inside) + "]", close + 1
            continue
        if c == "\\" and k + 1 < len(body):
            k += 1
            c = re.escape(body[k])
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        out, k = out + c, k + 1
    return out


def ignore_rules(text: str) -> list[tuple[re.Pattern[str], bool, bool]]:
    """(pattern, folders only, takes back) of each rule of an ignore file; comments, blank lines
    and rules that can't be read are left out."""
    found = []
    for line in text.splitlines():
        rule = re.sub(r"(?<!\\) +$", "", line)
        if not rule.strip() or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        body = rule[back:]
        try:
            found.append((re.compile(_pattern(body), re.DOTALL), body.endswith("/"), back))
        except re.error:
            continue
    return found


def _verdict(path: str, folder: bool, files: list[tuple[str, list]]) -> bool | None:
    """What the last fitting rule of the deepest file says of a path; None where none fits."""
    for base, rules in reversed(files):
        inner = path[len(base) + 1 if base else 0 :]
        for pattern, folders, back in reversed(rules):
            if (folder or not folders) and pattern.fullmatch(inner):
                return not back
    return None


def list_tree(root: str, database: str = "") -> tuple[list[str], list[str]]:
    """(relative paths, errors) of a local tree: hidden names, what .gitignore and .ignore rule
    out, and the database with its companions are left out; errors don't stop the walk.  Of rules
    that fit, .ignore goes before .gitignore, then the deeper file, then the later line."""
    found, errors = [], []
    todo: list[tuple[str, dict[str, list[tuple[str, list]]]]] = [("", {".ignore": [], ".gitignore": []})]
    while todo:
        folder, rules = todo.pop()
        here = os.path.join(root, folder)
        for name in rules:
            try:
                with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                    rules = rules | {name: [*rules[name], (folder, ignore_rules(f.read()))]}
            except FileNotFoundError:
                pass
            except OSError as e:
                errors.append(str(e))
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError as e:
            errors.append(str(e))
            continue
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            full = os.path.join(root, path)
            if entry.name.startswith(".") or database and (full == database or full.startswith(f"{database}.")):
                continue
            is_folder = entry.is_dir(follow_symlinks=False)
            gone = _verdict(path, is_folder, rules[".ignore"])
            if _verdict(path, is_folder, rules[".gitignore"]) if gone is None else gone:
                continue
            if is_folder:
                todo.append((path, rules))
            elif entry.is_file():
                if os.access(full, os.R_OK):
                    found.append(path)
                else:
                    errors.append(f"can't read {path}")
    return sorted(found), errors


def without_database(paths: DataFrame, database: str) -> DataFrame:
    """Rows whose path is neither the database nor one of its companions."""
    return paths.where((F.col("path") != database) & ~F.col("path").startswith(f"{database}."))


def read_tree(spark: SparkSession, root: str, database: str = "") -> tuple[DataFrame, list[str]]:
    """(path, content, size) of a tree in any store that Spark reads.

    A tree on a mounted disk is listed with its ignore rules; then executors read the files.
    Other stores are read whole by Spark, without names that begin with a dot or an underscore
    (Spark lists none of these) and without ignore rules."""
    base = root.removeprefix("file://").rstrip("/")
    if "://" in base or not os.path.isdir(base):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        relative = F.regexp_replace("path", rf"^.*?{_quoted(root.rstrip('/').split('://')[-1])}/", "")
        return rows.select(relative.alias("path"), "content", F.col("length").alias("size")).where(~F.col("path").rlike(r"(^|/)\.")), []
    names, errors = list_tree(base, database)
    return read_files(spark, base, names), errors


def read_files(spark: SparkSession, base: str, names: list[str], batch: int = 64 << 20) -> DataFrame:
    """(path, content, size) of files below a folder that executors reach under the same name.
    Names are taken literally, whatever signs they hold; files that are gone by now are left out.
    A frame ends at `batch` bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, held = [], 0
            for name in frame["path"]:
                try:
                    with open(os.path.join(base, name), "rb") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                out.append((name, content, len(content)))
                held += len(content)
                if held >= batch:
                    yield pd.DataFrame(out, columns=["path", "content", "size"])
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["path", "content", "size"])

    paths = spark.createDataFrame(pd.DataFrame({"path": pd.Series(names, dtype="object")}), "path string")
    slices = max(1, min(len(names) // 64, 4096))
    return paths.repartition(slices, "path").mapInPandas(run, "path string, content binary, size bigint")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def file_rows(found: DataFrame) -> DataFrame:
    """(path, language, file_size, hash, content) of files read."""
    return found.select("path", detect_language(F.col("path")).alias("language"), F.col("size").alias("file_size"), content_hash(F.col("content")).alias("hash"), "content")


def _listed(kind: pa.DataType, rows: list[list[tuple]]) -> pa.Array:
    """A column of lists of structs, built field by field."""
    inner = kind.value_type
    columns = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * inner.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, inner, strict=True)], fields=list(inner))
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), values, type=kind)


def _parser(columns: tuple[str, ...], schema: pa.Schema, most: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of files to their analyses; a batch ends at `most` bytes of text."""

    def made(found: list[tuple[Analysis, bool]]) -> pa.RecordBatch:
        lists = [_listed(_FOUND[c][0], [_FOUND[c][1](a) for a, _ in found]) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([a.path for a, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_()), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, content = path.as_py(), bytes(content.as_py())
                try:
                    found.append((parse_file(path, content.decode("utf-8")), False))
                except UnicodeDecodeError:
                    found.append((Analysis(path), True))
                held += len(content)
                if held >= most:
                    yield made(found)
                    found, held = [], 0
            if found:
                yield made(found)

    return run


def parse_files(files: DataFrame, *columns: str) -> DataFrame:
    """An analysis for each parseable file within the size limit, with the columns named (else all of
    symbols, contains, imports and calls); `failed` marks files that aren't UTF-8.

    Files go to Python in Arrow batches, a file a row.  Parsing costs far more than moving a text, so the files
    are dealt over all cores by their paths, however few partitions they come in."""
    columns = columns or tuple(_FOUND)
    spark = files.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    schema = pa.schema([("path", pa.string()), ("failed", pa.bool_()), *((c, _FOUND[c][0]) for c in columns)])
    wanted = files.where(parse_eligible(F.col("path")) & (size_class(F.col("file_size")) == "parse"))
    return wanted.select("path", "content").repartition(slices, "path").mapInArrow(_parser(columns, schema), from_arrow_schema(schema))


def declared(parsed: DataFrame) -> DataFrame:
    """(id, kind, parent, ...) of each symbol of parsed files with `symbols` and `contains`: these hold one pair a
    symbol in the same order, so nothing is joined."""
    both = F.explode(F.arrays_zip("symbols", "contains")).alias("x")
    return parsed.select("path", both).select("path", "x.symbols.*", F.col("x.contains.src").alias("parent"))


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the indexed one."""
    return mutations.changed(files, indexed).select(*files.columns)
