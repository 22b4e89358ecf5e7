"""The registered queries: each applies one operator to tables derived from the driver's
schema, next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.functions import text as fn
from wovengraph.functions.imports import expand_use_paths
from wovengraph.operators import chunks, edges, graph, lookup, mutations, resolve, vectors
from wovengraph.operators.store import Store
from wovengraph.operators.vector_index import VectorIndex
from wovengraph.plans import indexing
from wovengraph.plans.mapping import PROGRAMS, Mapped, sql
from wovengraph.sources import scan
from wovengraph.streaming import events as watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Mapped], DataFrame]], Callable[[Mapped], DataFrame]]:
    def add(f: Callable[[Mapped], DataFrame]) -> Callable[[Mapped], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Mapped(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _id(m: Mapped, part: int) -> str:
    """The symbol of one part."""
    row = m.symbols.where(F.col("id").endswith(f"::{part}")).select("id").first()
    return row.id if row else ""


_TARGET = "(SELECT id FROM symbols WHERE ends_with(id, '::{}'))"
_GROUP = "CASE WHEN ends_with(path, '.weird') THEN 'Unknown' WHEN ends_with(path, '.rs') THEN 'Rust' WHEN ends_with(path, '.py') THEN 'Python' ELSE 'TypeScript' END"

# Scans and scalar functions


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(m):
    return m.table("documents").select("doc_id", fn.content_hash(F.col("text")).alias("hash"))


@query("detect_language", sql("files") + f" SELECT path, {_GROUP} AS language FROM files")
def _(m):
    return m.files.select("path", fn.detect_language(F.col("path")).alias("language"))


@query("load_hashes", sql("files") + " SELECT path, hash FROM files")
def _(m):
    return m.files.select("path", "hash")


@query("unchanged_skip", sql("files") + " SELECT path, hash FROM files WHERE file_size % 3 = 0")
def _(m):
    old = m.files.select("path", F.when(F.col("file_size") % 3 == 0, "other").otherwise(F.col("hash")).alias("hash"))
    return mutations.changed(m.files.select("path", "hash"), old)


@query("size_guard", sql("files") + " SELECT path, CASE WHEN file_size * 4000 > 5242880 THEN 'skip' ELSE 'parse' END AS action FROM files")
def _(m):
    return m.files.select("path", fn.size_class(F.col("file_size") * 4000).alias("action"))


@query("parse_eligible", sql("files") + " SELECT path FROM files WHERE NOT ends_with(path, '.weird')")
def _(m):
    return m.files.where(fn.parse_eligible(F.col("path"))).select("path")


@query("scan_files", sql("files") + " SELECT path, file_size FROM files")
def _(m):
    return m.files.select("path", "file_size")


@query("scan_symbols", sql("symbols") + " SELECT id, name, kind, start_line FROM symbols")
def _(m):
    return m.symbols.select("id", "name", "kind", "start_line")


@query("scan_chunks", sql("vectors") + " SELECT id, text FROM vectors")
def _(m):
    return m.vectors.select("id", "text")


@query("scan_calls", sql("calls") + " SELECT src, dst, call_site_line FROM calls")
def _(m):
    return m.calls


_LINES = "CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) END"


@query("source_slice", f"SELECT doc_id, CASE WHEN doc_id % 4 > len(l) OR doc_id % 4 = 0 THEN '' ELSE array_to_string(l[doc_id % 4:doc_id % 4 + 2], chr(10)) END AS slice FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def _(m):
    start = F.col("doc_id") % 4
    return m.table("documents").select("doc_id", fn.source_slice(F.col("text"), start, start + 2).alias("slice"))


@query("symbol_file", sql("symbols") + " SELECT id, split_part(id, '::', 1) AS file FROM symbols")
def _(m):
    return m.symbols.select("id", fn.symbol_file(F.col("id")).alias("file"))


@query("call_name_valid", "SELECT p_partkey, regexp_full_match(w, '[\\p{L}\\p{N}_]+') AS plain, regexp_full_match(w, '[\\p{L}\\p{N}_$:]+') AS wide FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_type || '::' || p_size WHEN 3 THEN '' ELSE p_name END AS w FROM part)")
def _(m):
    size = F.col("p_size") % 5
    w = F.when(size == 0, F.col("p_brand")).when(size == 1, F.col("p_type")).when(size == 2, F.concat("p_type", F.lit("::"), F.col("p_size").cast("string"))).when(size == 3, "").otherwise(F.col("p_name"))
    return m.table("part").select("p_partkey", fn.call_name_valid(w).alias("plain"), fn.call_name_valid(w, "$:").alias("wide"))


@query("expand_import", "SELECT p_partkey, unnest(['crate::' || lower(p_type) || '::a', 'crate::' || lower(p_type) || '::b::' || p_size, 'crate::z']) AS path FROM part")
def _(m):
    text = F.concat(F.lit("crate::{"), F.lower("p_type"), F.lit("::{a, b::{"), F.col("p_size").cast("string"), F.lit("}}, z as y}"))
    return m.table("part").select("p_partkey", F.explode(expand_use_paths(text)).alias("path"))


# Edges and joins


@query("callers", sql("symbols", "calls") + f" SELECT s.id, s.name, s.kind, s.signature, c.call_site_line FROM calls c JOIN symbols s ON s.id = c.src WHERE c.dst = {_TARGET.format(10)}")
def _(m):
    return edges.callers(m.calls, m.symbols, _id(m, 10))


@query("callees", sql("symbols", "calls") + f" SELECT s.id, s.name, s.kind, s.signature FROM calls c JOIN symbols s ON s.id = c.dst WHERE c.src = {_TARGET.format(10)}")
def _(m):
    return edges.callees(m.calls, m.symbols, _id(m, 10))


@query("imports", sql("imports") + " SELECT dst AS path FROM imports WHERE src = 'NATION_3'")
def _(m):
    return edges.imported_files(m.imports, "NATION_3")


@query("imported_by", sql("imports") + " SELECT src AS path FROM imports WHERE dst = 'NATION_3'")
def _(m):
    return edges.importing_files(m.imports, "NATION_3")


_DEPS = sql("imports") + " SELECT 'imports' AS direction, dst AS path FROM imports WHERE src = 'NATION_4' UNION ALL SELECT 'imported_by', src FROM imports WHERE dst = 'NATION_4'"


@query("deps_union", _DEPS)
def _(m):
    return edges.dependencies(m.imports, "NATION_4")


@query("dependencies", _DEPS)
def _(m):
    files = m.table("nation").select(F.col("n_name").alias("path"))
    return edges.dependencies(m.imports, lookup.one_file(files, "NATION_4")["path"])


@query("contained_symbols", sql("places") + " SELECT id, name, kind, start_line FROM places WHERE starts_with(id, 'ASIA::')")
def _(m):
    return graph.contained_symbols(m.contains, m.places, "ASIA")


@query("containment", sql("places") + " SELECT src_kind, src, dst FROM contains")
def _(m):
    files = m.table("region").select(F.col("r_name").alias("path"))
    return edges.containment(m.places, files)


@query("in_list", sql("symbols") + " SELECT id, name FROM symbols WHERE id IN (SELECT id FROM symbols WHERE start_line % 10 = 4)")
def _(m):
    return edges.in_list(m.symbols.select("id", "name"), m.symbols.where("start_line % 10 = 4").select("id"))


@query("impact_drop_dangling", sql("symbols", "calls") + " SELECT src, dst, call_site_line FROM calls WHERE src IN (SELECT id FROM symbols WHERE kind <> 'Struct')")
def _(m):
    return edges.without_dangling(m.calls, m.symbols.where("kind <> 'Struct'"))


@query("call_owner_join", sql("modules", "asked") + " SELECT m.id, coalesce(a.n, 0) AS n_calls, a.first_line FROM modules m LEFT JOIN (SELECT src, count(*) AS n, min(line) AS first_line FROM asked GROUP BY src) a ON a.src = m.id")
def _(m):
    rows = m.modules
    owned = resolve.raw_calls(rows).withColumnRenamed("src", "owner")
    found = edges.calls_by_owner(rows.drop("raw_calls"), owned)
    return found.select("id", F.size("raw_calls").cast("bigint").alias("n_calls"), F.when(F.size("raw_calls") > 0, F.col("raw_calls")[0]["line"]).alias("first_line"))


@query("calls_json", sql("modules", "asked") + """ SELECT m.id, coalesce(a.j, '[]') AS raw_calls FROM modules m LEFT JOIN (SELECT src, '[' || string_agg('{"name":"' || name || '","line":' || line || ',"is_method":' || is_method || '}', ',' ORDER BY line, name, is_method) || ']' AS j FROM asked GROUP BY src) a ON a.src = m.id""")
def _(m):
    rows = m.modules
    found = edges.calls_by_owner(rows.drop("raw_calls"), resolve.raw_calls(rows).withColumnRenamed("src", "owner"))
    return found.select("id", F.to_json("raw_calls").alias("raw_calls"))


# What the parsers must find in the programs of `mapping.PROGRAMS`, written out by hand.
_DECLARED = """WITH parts AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS z, ['py', 'rs', 'ts'][p_partkey % 3 + 1] AS ext FROM part),
 shapes(ext, id, above, kind, start_line, end_line, signature) AS (VALUES
  ('py', '::C{k}', '', 'Class', 1, 4, 'class C{k}:'), ('py', '::C{k}::m{z}', '::C{k}', 'Method', 3, 4, 'def m{z}(self, x=h{k}()):'),
  ('py', '::f{k}', '', 'Function', 6, 9, 'def f{k}():'), ('py', '::f{k}::inner', '::f{k}', 'Function', 8, 9, 'def inner():'),
  ('rs', '::C{k}', '', 'Struct', 1, 1, 'pub struct C{k} { a: u8 }'), ('rs', '::impl C{k}', '', 'Implementation', 3, 7, 'impl C{k} {'),
  ('rs', '::impl C{k}::m{z}', '::impl C{k}', 'Function', 4, 6, 'pub fn m{z}(&self) -> u8 {'),
  ('rs', '::f{k}', '', 'Function', 9, 12, 'fn f{k}() {'), ('rs', '::f{k}::inner', '::f{k}', 'Function', 11, 11, 'fn inner() { deep{k}(); }'),
  ('ts', '::C{k}', '', 'Class', 1, 5, 'class C{k} {'), ('ts', '::C{k}::m{z}', '::C{k}', 'Method', 2, 4, 'm{z}(x = h{k}()) {'),
  ('ts', '::f{k}', '', 'Function', 7, 10, 'function f{k}() {'), ('ts', '::f{k}::inner', '::f{k}', 'Function', 9, 9, 'function inner() { deep{k}(); }')),
 calls(ext, owner, name, line, is_method) AS (VALUES
  ('py', NULL, 'h{k}', 3, false), ('py', '::C{k}::m{z}', 'g{z}', 4, true), ('py', NULL, 'n{k}', 4, false), ('py', '::f{k}', 'k{z}', 7, false), ('py', '::f{k}::inner', 'deep{k}', 9, false),
  ('rs', '::impl C{k}::m{z}', 'g{z}', 5, true), ('rs', '::f{k}', 'k{z}', 10, false), ('rs', '::f{k}::inner', 'deep{k}', 11, false),
  ('ts', NULL, 'h{k}', 2, false), ('ts', '::C{k}::m{z}', 'g{z}', 3, true), ('ts', NULL, 'n{k}', 3, false), ('ts', '::f{k}', 'k{z}', 8, false), ('ts', '::f{k}::inner', 'deep{k}', 9, false))"""


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{k}}', k), '{{z}}', z)"


def _placed(column: str) -> str:
    return f"'p' || k || '.' || ext || {_filled(column)}"


def _parsed(m: Mapped, what: str) -> DataFrame:
    return scan.parse_files(m.programs, what).select("path", F.explode(what).alias("x")).select("path", "x.*")


@query("signature", _DECLARED + f" SELECT {_placed('id')} AS id, start_line, end_line, {_filled('signature')} AS signature FROM parts JOIN shapes USING (ext)")
def _(m):
    return _parsed(m, "symbols").select("id", "start_line", "end_line", "signature")


@query("parent_kind_lookup", _DECLARED + f" SELECT {_placed('id')} AS id, {_placed('above')} AS parent, kind FROM parts JOIN shapes USING (ext)")
def _(m):
    return scan.declared(scan.parse_files(m.programs, "symbols", "contains")).select("id", "kind", "parent")


@query("call_owner", _DECLARED + f" SELECT {_placed('owner')} AS owner, {_filled('name')} AS name, line, is_method FROM parts JOIN calls USING (ext)")
def _(m):
    return _parsed(m, "calls").select("owner", "name", "line", "is_method")


# Resolution

_REL = sql("scripts", "paths") + """,
 bases AS (SELECT DISTINCT path AS src, CASE WHEN p_size % 2 = 0 THEN regexp_replace(path, '/[^/]*$', '') || '/' || a
   ELSE CASE WHEN p_size % 5 > 2 THEN regexp_replace(path, '/[^/]*/[^/]*$', '') ELSE regexp_replace(path, '/[^/]*/[^/]*$', '') END || '/' || t || '/' || a || '.js' END AS base FROM scripts),
 tries AS (SELECT src, base, r, CASE WHEN r < 4 THEN regexp_replace(base, '\\.js$', '') || ['.ts', '.tsx', '.js', '.jsx'][r + 1] ELSE base || ['/index.ts', '/index.js'][r - 3] END AS dst FROM bases, range(6) x(r)),
 rel AS (SELECT DISTINCT src, arg_min(dst, r) OVER (PARTITION BY src, base) AS dst FROM tries JOIN paths ON paths.path = tries.dst)"""


@query("resolve_imports_relative", _REL + " SELECT src, dst FROM rel")
def _(m):
    return resolve.relative_imports(m.trees)


_RS = """,
 ask AS (SELECT DISTINCT path AS src, CASE head WHEN 'super' THEN coalesce(nullif(regexp_replace(path, '/[^/]*/[^/]*$', ''), path), '') WHEN 'self' THEN regexp_replace(path, '/[^/]*$', '') ELSE 'src' END AS beg,
   CASE WHEN head = 'super' AND length(path) - length(replace(path, '/', '')) > 2 THEN regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') END AS up, head, segs FROM rusts),
 ask2 AS (SELECT src, coalesce(up, beg) AS beg, segs FROM ask),
 steps AS (SELECT src, beg, segs, d, beg || '/' || array_to_string(segs[1:d], '/') AS stem FROM ask2, (VALUES (1), (2), (3)) v(d)),
 hit AS (SELECT src, beg, segs, d, CASE WHEN stem || '.rs' IN (SELECT path FROM paths) THEN stem || '.rs' WHEN stem || '/mod.rs' IN (SELECT path FROM paths) THEN stem || '/mod.rs' END AS dst FROM steps),
 whole AS (SELECT *, min(CASE WHEN dst IS NULL THEN d ELSE 9 END) OVER (PARTITION BY src, beg, segs) AS miss FROM hit),
 rust AS (SELECT DISTINCT src, arg_max(dst, d) OVER (PARTITION BY src, beg, segs) AS dst FROM whole WHERE d < miss)"""


@query("resolve_imports_rust", sql("rusts", "paths") + _RS + " SELECT src, dst FROM rust")
def _(m):
    return resolve.rust_imports(m.trees)


_BEST = """,
 t1 AS (SELECT a.*, m.id AS dst, 1 AS tier FROM asked a JOIN modules m ON m.id = regexp_replace(a.src, '::[^:]*$', '') || '::' || a.name WHERE a.is_method AND len(string_split(a.src, '::')) >= 3),
 t2 AS (SELECT a.*, min(m.id) AS dst, 2 AS tier FROM asked a JOIN modules m ON m.name = a.name AND split_part(m.id, '::', 1) = split_part(a.src, '::', 1) GROUP BY ALL),
 t3 AS (SELECT src, name, line, is_method, arg_min(dst, f) AS dst, 3 AS tier FROM (SELECT a.*, i.dst AS f, min(m.id) AS dst FROM asked a JOIN brand_imports i ON i.src = split_part(a.src, '::', 1) JOIN modules m ON m.name = a.name AND split_part(m.id, '::', 1) = i.dst GROUP BY ALL) GROUP BY ALL),
 any_called AS (SELECT name, bool_or(kind <> 'Struct') AS y FROM modules GROUP BY name),
 t4 AS (SELECT a.*, m.id AS dst, 4 AS tier FROM asked a JOIN modules m USING (name) JOIN any_called USING (name) WHERE m.kind <> 'Struct' OR NOT y),
 every AS (SELECT src, name, line, is_method, dst, tier FROM t1 UNION ALL SELECT src, name, line, is_method, dst, tier FROM t2 UNION ALL SELECT src, name, line, is_method, dst, tier FROM t3 UNION ALL SELECT src, name, line, is_method, dst, tier FROM t4),
 won AS (SELECT * FROM every QUALIFY tier = min(tier) OVER (PARTITION BY src, name, line, is_method))"""
_RESOLVE = sql("modules", "asked", "brand_imports") + _BEST


def _tier(name: str, number: int, find: Callable[[DataFrame, Mapped], DataFrame]) -> None:
    @query(name, _RESOLVE + f" SELECT src, name, line, is_method, dst FROM t{number}")
    def _(m):
        return find(resolve.raw_calls(m.modules), m)


_tier("resolve_calls_method", 1, lambda a, m: resolve.tier_method(a, m.modules))
_tier("resolve_calls_file", 2, lambda a, m: resolve.tier_file(a, m.modules))
_tier("first_match", 2, lambda a, m: resolve.tier_file(a, m.modules))
_tier("resolve_calls_import", 3, lambda a, m: resolve.tier_import(a, m.modules, m.brand_imports))
_tier("resolve_calls_global", 4, lambda a, m: resolve.tier_global(a, m.modules))


@query("resolve_calls", _RESOLVE + " SELECT src, dst, line AS call_site_line, min(tier) AS tier FROM won GROUP BY src, dst, line")
def _(m):
    return resolve.resolve_calls(m.modules, m.brand_imports)


@query("relink", _RESOLVE + " SELECT 'calls' AS edges, count(DISTINCT (src, dst, line)) AS n FROM won UNION ALL SELECT 'imports', count(*) FROM brand_imports")
def _(m):
    calls = resolve.resolve_calls(m.modules, m.brand_imports).agg(F.count("*").alias("n")).select(F.lit("calls").alias("edges"), "n")
    return calls.unionByName(m.brand_imports.distinct().agg(F.count("*").alias("n")).select(F.lit("imports").alias("edges"), "n"))


# Candidates and filters


@query("symbol_exact", sql("symbols") + " SELECT id, name FROM symbols WHERE name = 'red widget'")
def _(m):
    return lookup.symbol_candidates(m.symbols, "red widget").select("id", "name")


@query("symbol_fuzzy", sql("symbols") + " SELECT id, name FROM symbols WHERE contains(lower(id), 'and#2.rs::1')")
def _(m):
    return lookup.symbol_candidates(m.symbols, "AND#2.rs::1", True).select("id", "name")


@query("file_candidates", sql("files") + " SELECT path FROM files WHERE contains(lower(path), 'rc1/1')")
def _(m):
    return lookup.file_candidates(m.files, "RC1/1", True).select("path")


@query("resolve_one", sql("symbols") + f" SELECT id, name, kind FROM symbols WHERE id = {_TARGET.format(7)}")
def _(m):
    row = lookup.one_symbol(m.symbols, _id(m, 7))
    return m.spark.createDataFrame([(row["id"], row["name"], row["kind"])], "id string, name string, kind string")


@query("kind_filter", sql("symbols") + " SELECT id, kind FROM symbols WHERE kind = 'Method'")
def _(m):
    return lookup.of_kind(m.symbols, "Method").select("id", "kind")


@query("pagerank_notnull", sql("scores") + " SELECT id, round(pagerank, 9) AS pagerank FROM scores WHERE pagerank IS NOT NULL")
def _(m):
    return m.scores.where("pagerank is not null").select("id", F.round("pagerank", 9).alias("pagerank"))


_NAMED = "SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'test_' || p_type WHEN 2 THEN p_type || '_test' WHEN 3 THEN 'Test' || p_type WHEN 4 THEN 'setUp' WHEN 5 THEN 'setups' ELSE p_name END AS name FROM part"


@query("entry_point", f"SELECT p_partkey, name IN ('main', 'init', '__init__', 'setup', 'teardown', 'setUp', 'tearDown', 'test') OR starts_with(name, 'test_') OR starts_with(name, 'Test') OR ends_with(name, '_test') AS entry FROM ({_NAMED})")
def _(m):
    k = F.col("p_size") % 9
    name = F.when(k == 0, "main").when(k == 1, F.concat(F.lit("test_"), "p_type")).when(k == 2, F.concat("p_type", F.lit("_test"))).when(k == 3, F.concat(F.lit("Test"), "p_type")).when(k == 4, "setUp").when(k == 5, "setups").otherwise(F.col("p_name"))
    return m.table("part").select("p_partkey", fn.entry_point(name).alias("entry"))


@query("suggest", sql("symbols") + " SELECT DISTINCT id FROM symbols WHERE contains(lower(id), '#1.rs') OR contains(lower(name), '#1.rs') ORDER BY id LIMIT 5")
def _(m):
    return lookup.suggestions(m.symbols, "#1.RS")


@query("suggest_topk", sql("symbols") + " SELECT DISTINCT id FROM symbols WHERE contains(lower(id), 'brand') OR contains(lower(name), 'brand') ORDER BY id LIMIT 3")
def _(m):
    return lookup.suggestions(m.symbols, "brand", 3)


@query("needs_embedding", sql("vectors") + " SELECT id FROM vectors WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x <> 0)) = 0")
def _(m):
    return m.vectors.where(fn.needs_embedding(F.col("embedding"))).select("id")


@query("chunk_null_exists", sql("vectors") + " SELECT count(*) > 0 AS missing FROM vectors WHERE embedding IS NULL")
def _(m):
    return m.vectors.where("embedding is null").limit(1).agg((F.count("*") > 0).alias("missing"))


# Aggregates


@query("count_nodes", sql("files", "symbols", "vectors") + " SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'chunks', count(*) FROM vectors UNION ALL SELECT 'embedded', count(embedding) FROM vectors")
def _(m):
    each = [(k, t.agg(F.count("*").alias("n"))) for k, t in (("files", m.files), ("symbols", m.symbols), ("chunks", m.vectors), ("embedded", m.vectors.where("embedding is not null")))]
    rows = [t.select(F.lit(k).alias("what"), "n") for k, t in each]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("distinct_edges", sql("calls") + " SELECT DISTINCT src, dst FROM calls")
def _(m):
    return edges.distinct_edges(m.calls)


@query("incoming_adjacency", sql("calls") + " SELECT dst, array_to_string(list_sort(list_distinct(list(src))), ',') AS callers FROM calls GROUP BY dst")
def _(m):
    return edges.incoming(m.calls).select("dst", F.array_join("callers", ",").alias("callers"))


@query("out_degree", sql("calls") + " SELECT src, count(DISTINCT dst) AS out_degree FROM calls GROUP BY src")
def _(m):
    return edges.out_degree(m.calls)


# Over the calls turned round: every symbol calls something, but not every one is something's last call.
@query("dangling_mass", sql("last_calls", "scores") + " SELECT round(sum(pagerank), 6) AS dangling_mass FROM scores WHERE id NOT IN (SELECT dst FROM last_calls)")
def _(m):
    return graph.dangling_mass(m.scores, m.last_calls.select(F.col("dst").alias("src"))).select(F.round("dangling_mass", 6).alias("dangling_mass"))


@query("l1_delta", sql("scores") + " SELECT round(sum(abs(pagerank * 1.25 - pagerank)), 6) AS l1_delta FROM scores")
def _(m):
    return graph.l1_delta(m.scores, m.scores.withColumn("pagerank", F.col("pagerank") * 1.25)).select(F.round("l1_delta", 6).alias("l1_delta"))


@query("score_stats", sql("scores") + " SELECT round(min(pagerank), 9) AS min_score, round(max(pagerank), 9) AS max_score, round(sum(pagerank), 6) AS sum_score FROM scores")
def _(m):
    return graph.score_stats(m.scores).select(*(F.round(c, p).alias(c) for c, p in (("min_score", 9), ("max_score", 9), ("sum_score", 6))))


_DEAD = " FROM with_uncalled s LEFT JOIN scores USING (id) WHERE kind <> 'Struct' AND name <> 'main' AND NOT starts_with(name, 'test_') AND id NOT IN (SELECT dst FROM calls)"
_RANKED = "SELECT row_number() OVER (ORDER BY pagerank DESC, id) AS rank, id, name, kind, split_part(id, '::', 1) AS file, round(pagerank, 9) AS pagerank FROM symbols JOIN scores USING (id) WHERE pagerank IS NOT NULL"


@query("dead_code", sql("with_uncalled", "calls", "scores") + " SELECT id, name, kind, split_part(id, '::', 1) AS file, start_line, round(coalesce(pagerank, 0), 9) AS pagerank" + _DEAD)
def _(m):
    return lookup.dead_code(m.with_uncalled, m.calls, m.scores, None).withColumn("pagerank", F.round("pagerank", 9))


@query("dead_code_sort", sql("with_uncalled", "calls", "scores") + " SELECT id, round(coalesce(pagerank, 0), 9) AS pagerank" + _DEAD + " ORDER BY coalesce(pagerank, 0), id LIMIT 50")
def _(m):
    return lookup.dead_code(m.with_uncalled, m.calls, m.scores, 50).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("dead_code_report", sql("with_uncalled", "calls", "scores") + f" SELECT count(*) AS count, 'main, init, __init__, setup, teardown, setUp, tearDown, test, test_*, Test*, *_test' AS excluded FROM (SELECT id {_DEAD} LIMIT 100)")
def _(m):
    return lookup.dead_code_report(lookup.dead_code(m.with_uncalled, m.calls, m.scores, 100))


_SOURCES = ", ".join(f"('{ext}', '{text}')" for ext, text in PROGRAMS.items())


@query("index_stats", _DECLARED + f", sources(ext, text) AS (VALUES {_SOURCES}) SELECT count(*) FILTER (ext <> 'py') AS written, CAST(sum(strlen({_filled('text')})) FILTER (ext <> 'py') AS BIGINT) AS bytes, count(*) FILTER (ext = 'py') AS unchanged FROM parts JOIN sources USING (ext)")
def _(m):
    rows = scan.file_rows(m.programs.withColumnRenamed("file_size", "size"))
    known = rows.where("path like '%.py'")
    with graph.work_folder(m.spark) as folder:
        store = Store(m.spark, folder)
        store.initialize("parts")
        report, _ = indexing.apply_files(store, scan.changed_files(rows, known), known.select("path").limit(0))
    return m.spark.createDataFrame([(report.written, report.bytes, rows.count() - report.written)], "written bigint, bytes bigint, unchanged bigint")


# Ranking


@query("rank", sql("symbols", "scores") + f" {_RANKED} ORDER BY rank LIMIT 10")
def _(m):
    return lookup.rank(m.symbols, m.scores, 10).withColumn("pagerank", F.round("pagerank", 9))


@query("rank_number", sql("symbols", "scores") + f" {_RANKED} AND kind = 'Method' ORDER BY rank LIMIT 25")
def _(m):
    return lookup.rank(m.symbols, m.scores, 25, "Method").withColumn("pagerank", F.round("pagerank", 9))


_IMPACT = sql("symbols", "calls", "last_calls", "scores") + f""",
 back(id, depth) AS (SELECT {_TARGET.format(10)}, 0 UNION SELECT c.src, b.depth + 1 FROM back b JOIN {{0}} c ON c.dst = b.id WHERE b.depth < {{1}}),
 reached AS (SELECT id, min(depth) AS depth FROM back WHERE id <> {_TARGET.format(10)} GROUP BY id)"""


# The whole graph is reached within a few steps, the chains of last calls within some hundred; more steps find nothing.
@query("impact", _IMPACT.format("calls", 12) + " SELECT id, depth FROM reached")
def _(m):
    return graph.impact(m.calls, m.symbols, _id(m, 10))


_CHAINS = sql("symbols", "last_calls", "scores") + """,
 most AS (SELECT dst AS top FROM last_calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
 back(id, depth) AS (SELECT top, 0 FROM most UNION SELECT c.src, b.depth + 1 FROM back b JOIN last_calls c ON c.dst = b.id WHERE b.depth < 400),
 reached AS (SELECT id, min(depth) AS depth FROM back WHERE id NOT IN (SELECT top FROM most) GROUP BY id)"""


def _most_called(m: Mapped) -> str:
    row = m.last_calls.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return row.dst if row else ""


@query("impact_chains", _CHAINS + " SELECT id, depth FROM reached")
def _(m):
    return graph.impact(m.last_calls, m.symbols, _most_called(m))


@query("impact_sort", _CHAINS + " SELECT row_number() OVER (ORDER BY pagerank DESC NULLS LAST, id) AS rank, id, depth, round(pagerank, 9) AS pagerank FROM reached LEFT JOIN scores USING (id)")
def _(m):
    rows = lookup.impact_report(m.last_calls, m.symbols, m.scores, _most_called(m), None)
    return rows.select("rank", "id", "depth", F.round("pagerank", 9).alias("pagerank"))


_STEPS = 10
_PAGERANK = (
    sql("symbols", "calls")
    + """,
 e AS (SELECT DISTINCT src, dst FROM calls), d AS (SELECT src, count(*) AS k FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM symbols),
 r0 AS (SELECT id, 1.0::DOUBLE / n AS s FROM symbols, n)"""
    + "".join(
        f""",
 g{i} AS (SELECT coalesce(sum(s), 0) AS g FROM r{i - 1} WHERE id NOT IN (SELECT src FROM d)),
 f{i} AS (SELECT e.dst AS id, sum(r.s / d.k) AS s FROM e JOIN d ON d.src = e.src JOIN r{i - 1} r ON r.id = e.src WHERE e.src <> e.dst GROUP BY e.dst),
 r{i} AS (SELECT s.id, 0.15 / n + 0.85 * (coalesce(f.s, 0) + g / n) AS s FROM symbols s LEFT JOIN f{i} f ON f.id = s.id, g{i}, n)"""
        for i in range(1, _STEPS + 1)
    )
)


@query("pagerank", _PAGERANK + f" SELECT id, round(s, 9) AS pagerank FROM r{_STEPS}")
def _(m):
    return graph.pagerank(m.symbols, m.calls, epsilon=0, max_iterations=_STEPS).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("pagerank_converged")
def _(m):
    """With production parameters: as many rounds as it takes, which SQL can't say."""
    return graph.pagerank(m.symbols, m.calls)


@query("pagerank_write", _PAGERANK + f" SELECT id, name, round(s, 9) AS pagerank FROM symbols JOIN r{_STEPS} USING (id)")
def _(m):
    scores = graph.pagerank(m.symbols, m.calls, epsilon=0, max_iterations=_STEPS)
    return m.symbols.join(scores, "id", "left").select("id", "name", F.round("pagerank", 9).alias("pagerank"))


@query("contains_closure", sql("contains") + " SELECT src AS ancestor, dst AS descendant, 1 AS depth FROM contains UNION ALL SELECT a.src, b.dst, 2 FROM contains a JOIN contains b ON b.src = a.dst")
def _(m):
    return graph.containment_closure(m.contains)


# Chunks

_WIN = f"SELECT source || '/' || doc_id AS path, {_LINES} AS l FROM documents"


@query("chunk_sliding", f"SELECT path, i AS ordinal, (i * 25 + 1)::BIGINT AS start_line, least(i * 25 + 30, len(l))::BIGINT AS end_line, array_to_string(l[i * 25 + 1:i * 25 + 30], chr(10)) AS text FROM (SELECT path, l, unnest(range(0, 1 + greatest(0, ceil((len(l) - 30) / 25.0))::INT))::INT AS i FROM ({_WIN}) WHERE len(l) > 0)")
def _(m):
    docs = m.table("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return chunks.sliding_chunks(docs)


@query("chunk_by_symbol", f"SELECT path, s AS ordinal, s + 1 AS start_line, CASE WHEN s + 1 > len(l) THEN '' ELSE array_to_string(l[s + 1:s + 2], chr(10)) END AS text FROM ({_WIN}), (VALUES (0::BIGINT), (2), (5)) v(s)")
def _(m):
    docs = m.table("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    at = docs.select("path", F.explode(F.array(*(F.lit(s).cast("bigint") for s in (0, 2, 5)))).alias("ordinal"))
    declared = at.select("path", "ordinal", F.concat("path", F.lit("::s")).alias("id"), (F.col("ordinal") + 1).alias("start_line"), (F.col("ordinal") + 2).alias("end_line"))
    return chunks.symbol_chunks(docs, declared).select("path", "ordinal", "start_line", "text")


# Vectors

_SCORED = ", q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), scored AS (SELECT id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM vectors, q WHERE embedding IS NOT NULL)"


def _query_vector(m: Mapped) -> list[float]:
    return m.table("embeddings").where("vec_id = 0").first().embedding


def _near(name: str, k: int, threshold: float | None) -> None:
    limit = f" WHERE score >= {threshold}" if threshold is not None else ""

    @query(name, sql("vectors") + _SCORED + f" SELECT id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT {k}){limit}")
    def _(m):
        return vectors.nearest(m.vectors, _query_vector(m), k, threshold).select("id", F.round("score", 6).alias("score"))


_near("knn", 20, None)


@query("vector_index", sql("vectors") + _SCORED + " SELECT id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 50)")
def _(m):
    with graph.work_folder(m.spark) as folder:
        found = VectorIndex.build(m.vectors, folder).search(_query_vector(m), 50).select("id", F.round("score", 6).alias("score"))
        return graph.checkpoint(found)  # the index goes when the folder does


_near("knn_topk", 10, 0.3)
_near("score_threshold", 5, 0.33)
_ENRICH = sql("vectors", "documented_by", "symbols") + _SCORED + """,
 hits AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 40)
 SELECT h.id, round(h.score, 6) AS score, coalesce(f.src, '') AS file, coalesce(s.name, '') AS symbol, coalesce(v.start_line, 0) AS line, coalesce(v.text, '') AS text
 FROM hits h LEFT JOIN vectors v ON v.id = h.id LEFT JOIN documented_by f ON f.src_kind = 'File' AND f.chunk_id = h.id
 LEFT JOIN documented_by o ON o.src_kind = 'Symbol' AND o.chunk_id = h.id LEFT JOIN symbols s ON s.id = o.src"""


def _enriched(name: str) -> None:
    @query(name, _ENRICH)
    def _(m):
        hits = vectors.nearest(m.vectors, _query_vector(m), 40)
        return vectors.enriched(hits, m.vectors, m.documented_by, m.symbols).withColumn("score", F.round("score", 6))


_enriched("similar_enrich")
_enriched("search_vector_enrich")


@query("not_embedded", sql("vectors") + " SELECT count(embedding) = 0 AS not_embedded FROM vectors WHERE start_line % 11 = 3")
def _(m):
    some = m.vectors.where("start_line % 11 = 3")
    return some.where(~fn.needs_embedding(F.col("embedding"))).agg((F.count("*") == 0).alias("not_embedded"))


@query("embed", sql("vectors") + " SELECT id, CASE WHEN embedding IS NULL THEN 384 ELSE 64 END AS dimensions, embedding IS NULL AS fresh FROM vectors")
def _(m):
    old = m.vectors.select("id", F.col("embedding").isNull().alias("fresh"))
    return vectors.embed(m.vectors).join(old, "id").select("id", F.size("embedding").alias("dimensions"), "fresh")


@query("embedding_write", sql("vectors") + " SELECT count(*) AS chunks, count(*) AS embedded FROM vectors")
def _(m):
    done = vectors.embed(m.vectors)
    return done.agg(F.count("*").alias("chunks"), F.count_if(~fn.needs_embedding(F.col("embedding"))).alias("embedded"))


# Writes


@query("file_upsert", sql("files") + " SELECT path, CASE WHEN file_size % 4 = 0 THEN 'new' ELSE hash END AS hash FROM files UNION ALL SELECT 'added.rs', 'new'")
def _(m):
    base = m.files.select("path", "hash")
    delta = base.join(m.files.where("file_size % 4 = 0").select("path"), "path", "left_semi").select("path", F.lit("new").alias("hash"))
    return mutations.upsert(base, delta.unionByName(m.spark.range(1).select(F.lit("added.rs").alias("path"), F.lit("new").alias("hash"))), "path")


@query("symbol_upsert", sql("mpart") + " SELECT id, arg_max(p_name || p_partkey, p_partkey) AS name, max(p_partkey) AS ordinal FROM mpart GROUP BY id")
def _(m):
    even = F.col("p_size") % 2 == 0
    ids = F.when(even, F.concat("p_brand", F.lit(".rs::"), "p_type", F.lit("::"), "p_name")).otherwise(F.concat("p_brand", F.lit(".rs::"), "p_name"))
    rows = m.table("part").select(ids.alias("id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("ordinal"))
    base = rows.where("ordinal % 2 = 0").groupBy("id").agg(F.lit("old").alias("name"))
    done = mutations.symbol_upsert(base, rows)
    return done.join(rows.groupBy("id").agg(F.max("ordinal").alias("ordinal")), "id")


@query("delete_symbols", sql("symbols", "calls") + " SELECT 'symbols' AS what, count(*) AS n FROM symbols WHERE NOT starts_with(id, 'Brand#2.rs::') UNION ALL SELECT 'calls', count(*) FROM calls WHERE NOT starts_with(src, 'Brand#2.rs::') AND NOT starts_with(dst, 'Brand#2.rs::')")
def _(m):
    paths = m.spark.range(1).select(F.lit("Brand#2.rs").alias("path"))
    left = mutations.delete_symbols({"symbols": m.symbols, "calls": m.calls}, paths)
    each = [left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k in ("symbols", "calls")]
    return each[0].unionByName(each[1])


@query("remove_file", sql("vectors", "documented_by") + " SELECT 'chunks' AS what, count(*) AS n FROM vectors WHERE NOT starts_with(id, 'f7.py::') UNION ALL SELECT 'documented_by', count(*) FROM documented_by WHERE NOT starts_with(chunk_id, 'f7.py::')")
def _(m):
    paths = m.spark.range(1).select(F.lit("f7.py").alias("path"))
    left = mutations.remove_files({"chunks": m.vectors, "documented_by": m.documented_by}, paths)
    each = [left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k in ("chunks", "documented_by")]
    return each[0].unionByName(each[1])


@query("stale_delete", sql("files") + " SELECT path FROM files WHERE file_size % 5 = 0")
def _(m):
    return mutations.stale(m.files, m.files.where("file_size % 5 <> 0"))


@query("containment_write", sql("places") + " SELECT DISTINCT src_kind, src, dst FROM contains WHERE src_kind = 'Symbol' OR src <> 'ASIA'")
def _(m):
    files = m.table("region").where("r_name <> 'ASIA'").select(F.col("r_name").alias("path"))
    return mutations.with_endpoints(m.contains.unionAll(m.contains), files, m.places)


@query("chunk_replace", sql("vectors", "documented_by") + " SELECT 'chunks' AS what, count(*) AS n, count(embedding) AS embedded FROM vectors WHERE NOT starts_with(id, 'f3.py::') UNION ALL SELECT 'fresh', 2, 0 UNION ALL SELECT 'edges', count(*) + 3, 0 FROM documented_by WHERE NOT starts_with(chunk_id, 'f3.py::')")
def _(m):
    one = _id(m, 7)
    fresh = m.spark.createDataFrame([("f3.py", "f3.py::chunk::0", one, "a", "Python", 1), ("f3.py", "f3.py::chunk::1", "nowhere::x", "b", "Python", 9)], "path string, id string, symbol string, text string, language string, start_line bigint")
    rows, links = mutations.replace_chunks(m.vectors, m.documented_by, fresh, m.symbols)
    new = F.col("id").startswith("f3.py::")
    parts = [rows.where(w).agg(F.count("*").alias("n"), F.count("embedding").alias("embedded")).select(F.lit(k).alias("what"), "n", "embedded") for k, w in (("chunks", ~new), ("fresh", new))]
    return parts[0].unionByName(parts[1]).unionByName(links.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n", F.lit(0).cast("bigint").alias("embedded")))


@query("context", sql("symbols", "calls") + f" SELECT 'callers' AS part, s.id FROM calls c JOIN symbols s ON s.id = c.src WHERE c.dst = {_TARGET.format(10)} UNION ALL SELECT 'callees', s.id FROM calls c JOIN symbols s ON s.id = c.dst WHERE c.src = {_TARGET.format(10)}")
def _(m):
    found = lookup.context({"symbols": m.symbols, "calls": m.calls}, symbol=_id(m, 10))
    return found["callers"].select(F.lit("callers").alias("part"), "id").unionByName(found["callees"].select(F.lit("callees").alias("part"), "id"))


# Watch events, replayed as a batch

_SEEN = "kind <> 'access' AND starts_with(path, '/') AND NOT starts_with(split_part(path, '/', -1), 'graph.db') AND (ends_with(path, '.rs') OR ends_with(path, '.py') OR ends_with(path, '.kt'))"


@query("watch_filter", sql("events_") + f" SELECT event_id, path, kind FROM events_ WHERE {_SEEN}")
def _(m):
    return watch.watched(m.events, "graph.db").select("event_id", "path", "kind")


@query("watch_dedup", sql("events_") + f" SELECT DISTINCT path FROM events_ WHERE {_SEEN}")
def _(m):
    return watch.pending(watch.watched(m.events, "graph.db"))


@query("debounce", sql("events_") + f", e AS (SELECT path, ts, CASE WHEN ts > lag(ts) OVER (ORDER BY ts) + INTERVAL 60 SECOND THEN 1 ELSE 0 END AS b FROM events_ WHERE {_SEEN}), s AS (SELECT path, ts, sum(b) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT path) AS paths, count(*) AS events FROM s GROUP BY g")
def _(m):
    return watch.batches(watch.watched(m.events, "graph.db"), "60 seconds").select("first_ts", "last_ts", "paths", "events")


@query("batch_apply", sql("events_") + f", last AS (SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM events_ WHERE {_SEEN} GROUP BY path) SELECT path, CASE WHEN kind = 'remove' THEN 'remove' ELSE 'upsert' END AS action FROM last")
def _(m):
    return watch.actions(watch.watched(m.events, "graph.db"))
