"""Text, path and identifier functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest file that is parsed; larger ones keep a File row only.
MAX_PARSED_BYTES = 5 * 1024 * 1024

LANGUAGES = {
    "rs": "Rust", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go",
    "py": "Python", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "java": "Java",
    "kt": "Kotlin", "kts": "Kotlin", "rb": "Ruby", "php": "PHP", "swift": "Swift",
}
PARSED = tuple(LANGUAGES)

ENTRY_NAMES = ("main", "init", "__init__", "setup", "teardown", "setUp", "tearDown", "test")
ENTRY_PREFIXES, ENTRY_SUFFIXES = ("test_", "Test"), ("_test",)


def extension(path: Column) -> Column:
    """The last path part's extension; empty without one (a leading dot doesn't begin one)."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def detect_language(path: Column) -> Column:
    """Language by extension, or Unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("Unknown"))


def parse_eligible(path: Column) -> Column:
    return extension(path).isin(*PARSED)


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(content, 256)


def size_class(size: Column) -> Column:
    """parse, or skip for files over the limit."""
    return F.when(size > MAX_PARSED_BYTES, "skip").otherwise("parse")


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end adds no empty line; '' has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive, joined by line feeds; '' for an empty or
    inverted range or one that begins past the end."""
    rows = lines(text)
    good = (start > 0) & (end > 0) & (start <= end) & (start <= F.size(rows))
    piece = F.array_join(F.slice(rows, F.greatest(start, F.lit(1)).cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int")), "\n")
    return F.when(good, piece).otherwise("")


def symbol_file(symbol_id: Column) -> Column:
    """The file of a symbol id: all before the first `::`."""
    return F.split_part(symbol_id, F.lit("::"), F.lit(1))


def call_name_valid(name: Column, extra: str = "") -> Column:
    """Letters, numbers and underscores only, at least one; `extra` adds characters."""
    return name.rlike(rf"^[\p{{L}}\p{{N}}_{extra}]+\z")


def entry_point(name: Column) -> Column:
    """Names that are called from outside the program's text."""
    found = name.isin(*ENTRY_NAMES)
    for p in ENTRY_PREFIXES:
        found = found | name.startswith(p)
    for s in ENTRY_SUFFIXES:
        found = found | name.endswith(s)
    return found


def is_zero_vector(vector: Column) -> Column:
    return F.forall(vector, lambda x: x == 0)


def needs_embedding(vector: Column) -> Column:
    """Not embedded yet: null, or all zeros."""
    return vector.isNull() | is_zero_vector(vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector and where a number is missing or not finite."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    size = norms[0] * norms[1]
    return F.when((size > 0) & ~F.isnan(dot / size), dot / size)


def normal_path(path: Column) -> Column:
    """A relative path without `.` parts, `..` taken back one part (and dropped at the root)."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(kept, "/")


def parent_path(path: Column) -> Column:
    """All before the last slash; '' for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def replace_extension(path: Column, new: str) -> Column:
    """The last part's extension replaced, or added where there is none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit(f".{new}"))
