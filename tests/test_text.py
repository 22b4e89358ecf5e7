"""Line, path and identifier functions; chunks."""

import hashlib

from pyspark.sql import functions as F

from wovengraph.functions import text as fn
from wovengraph.functions.imports import expand_use, expand_use_paths
from wovengraph.operators import chunks


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) else 'int'}" for i, v in enumerate(values))).select(column.alias("x")).first().x


def test_lines_and_slices(spark):
    for text in ("", "\n", "a", "a\n", "a\r\nb\n\n", "a\nb\r", "\n\na"):
        parts = text.split("\n")
        want = [p.removesuffix("\r") if i < len(parts) - 1 else p for i, p in enumerate(parts)]
        if text.endswith("\n") or not text:
            want = want[:-1]
        assert one(spark, fn.lines(F.col("c0")), text) == want, text
    letters = "abcde"
    ranges = spark.createDataFrame([("\n".join(letters), s, e) for s in range(8) for e in range(9)], "t string, s int, e int")
    for r in ranges.select("s", "e", fn.source_slice(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect():
        inside = [c for k, c in enumerate(letters, 1) if r.s <= k <= r.e] if r.s > 0 else []
        assert r.x == "\n".join(inside), (r.s, r.e)


def test_paths(spark):
    for path, want in {"a/b.rs": "Rust", "x.hpp": "C++", "x.h": "C", "Makefile": "Unknown", ".rs": "Unknown", "a/.py": "Unknown", "a.b.kts": "Kotlin"}.items():
        assert one(spark, fn.detect_language(F.col("c0")), path) == want
    for path, want in {"a/./b/../c": "a/c", "../x": "x", "./": "", "a//b": "a/b"}.items():
        assert one(spark, fn.normal_path(F.col("c0")), path) == want
    for path, want in {"a/foo.service": "a/foo.ts", "a/foo": "a/foo.ts", "a.b/foo": "a.b/foo.ts"}.items():
        assert one(spark, fn.replace_extension(F.col("c0"), "ts"), path) == want
    assert one(spark, fn.content_hash(F.col("c0")), "abc") == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, fn.size_class(F.col("c0")), 5 * 1024 * 1024) == "parse" and one(spark, fn.size_class(F.col("c0")), 5 * 1024 * 1024 + 1) == "skip"


def test_names(spark):
    for name, want in {"run_1": True, "größe": True, "": False, "a-b": False, "a\n": False, "a::b": False}.items():
        assert one(spark, fn.call_name_valid(F.col("c0")), name) == want
    for name, want in {"main": True, "test_x": True, "x_test": True, "TestX": True, "mainly": False, "setup": True, "setups": False}.items():
        assert one(spark, fn.entry_point(F.col("c0")), name) == want


def test_use_paths(spark):
    assert expand_use("crate::{a::{b, c}, d}") == ["crate::a::b", "crate::a::c", "crate::d"]
    assert expand_use("a::b as c") == ["a::b"] and expand_use("a::{self, B as C}") == ["a::self", "a::B"] and expand_use("a::{b") == ["a::{b"]
    got = spark.createDataFrame([("x::{y, z}",), (None,)], "p string").select(expand_use_paths("p").alias("e")).collect()
    assert [r.e for r in got] == [["x::y", "x::z"], None]


def test_chunks(spark):
    def slow(n, most, over):
        step, out, k = max(1, most - over), [], 0
        while n:
            out.append((k + 1, min(k + most, n)))
            if k + most >= n:
                break
            k += step
        return out

    for n in (0, 1, 4, 10, 30, 31, 55, 56, 120):
        for most, over in ((30, 5), (4, 1), (3, 7)):
            source = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, n + 1)))], "path string, text string")
            got = chunks.sliding_chunks(source, max_lines=most, overlap=over).orderBy("ordinal").collect()
            assert [(r.start_line, r.end_line) for r in got] == slow(n, most, over)
            assert all(r.text == "\n".join(f"l{i}" for i in range(r.start_line, r.end_line + 1)) for r in got)
            if n == 10 and most == 4:
                assert [r.id for r in chunks.chunk_ids(chunks.sliding_chunks(source, max_lines=4, overlap=1)).collect()][0] == "f::chunk::0"
