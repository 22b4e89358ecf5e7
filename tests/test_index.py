"""Indexing a tree end to end: first run, changes, removal, watching, and the front-ends."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from wovengraph import cli, render, repl, server
from wovengraph.api import Graph
from wovengraph.operators import lookup, vectors
from wovengraph.operators.store import Store, StoreError
from wovengraph.plans.cypher import CypherError
from wovengraph.sources import registry, scan
from wovengraph.streaming.watch import poll, watch

FILES = {
    "src/main.rs": "use crate::parser;\n\nfn main() {\n    parse();\n    helper();\n}\n\nfn helper() {}\n",
    "src/parser.rs": "pub fn parse() -> u8 {\n    1\n}\n",
    "web/app.ts": "import { x } from './lib';\nexport function app() { x(); }\n",
    "web/lib.ts": "export function x() {}\n",
    "notes.txt": "one\ntwo\n",
    "big.py": "x = 1\n" * 1_000_000,
    "bad.py": None,
    ".hidden/a.rs": "fn no() {}",
    "skip/gen.rs": "fn gen() {}",
    ".gitignore": "skip/\n*.log\n",
    "a.log": "x",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"\xff\xfe(" if text is None else text.encode())
    return root


@pytest.fixture(scope="module")
def graph(spark, tree, tmp_path_factory):
    g = Graph(spark, str(tmp_path_factory.mktemp("store")))
    report = g.index(str(tree))
    assert (report.written, report.unchanged, report.removed) == (6, 0, 0)
    assert report.failed == ["bad.py"]
    return g


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_what_is_stored(graph):
    t = graph.store.tables()
    assert rows(t["files"].select("path", "language")) == [("big.py", "Python"), ("notes.txt", "Unknown"), ("src/main.rs", "Rust"), ("src/parser.rs", "Rust"), ("web/app.ts", "TypeScript"), ("web/lib.ts", "TypeScript")]
    assert rows(t["symbols"].select("id", "start_line", "end_line")) == [("src/main.rs::helper", 8, 8), ("src/main.rs::main", 3, 6), ("src/parser.rs::parse", 1, 3), ("web/app.ts::app", 2, 2), ("web/lib.ts::x", 1, 1)]
    assert rows(t["imports"]) == [("src/main.rs", "src/parser.rs"), ("web/app.ts", "web/lib.ts")]
    assert rows(t["calls"]) == [("src/main.rs::main", "src/main.rs::helper", 5), ("src/main.rs::main", "src/parser.rs::parse", 4), ("web/app.ts::app", "web/lib.ts::x", 2)]
    assert rows(t["contains"].where("src = 'src/main.rs'").select("src_kind", "dst")) == [("File", "src/main.rs::helper"), ("File", "src/main.rs::main")]
    assert rows(t["chunks"].where("id like 'notes%' or id like 'src/main%'").select("id", "text", "start_line")) == [("src/main.rs::chunk::0", "fn main() {\n    parse();\n    helper();\n}", 3), ("src/main.rs::chunk::1", "fn helper() {}", 8)]
    assert rows(t["documented_by"].where("chunk_id = 'src/main.rs::chunk::1'").select("src_kind", "src")) == [("File", "src/main.rs"), ("Symbol", "src/main.rs::helper")]
    assert t["scores"].agg(F.sum("pagerank")).first()[0] == pytest.approx(1, abs=1e-4)


def test_questions(graph):
    assert graph.call_graph("parse", "callers")[1][0]["call_site_line"] == 4
    assert [r["id"] for r in graph.call_graph("src/main.rs::main", "callees", exact=True)[1]] == ["src/main.rs::helper", "src/parser.rs::parse"]
    assert graph.dependencies("parser")[1] == [{"direction": "imported_by", "path": "src/main.rs"}]
    found = graph.context(symbol="helper")
    assert found["source"] == "fn helper() {}" and [r["id"] for r in found["callers"]] == ["src/main.rs::main"]
    assert [r["id"] for r in graph.context(file="src/main.rs")["symbols"]] == ["src/main.rs::helper", "src/main.rs::main"]
    assert graph.impact("PARSE")[2][0]["id"] == "src/main.rs::main"
    assert [r["id"] for r in graph.dead_code()["rows"]] == ["web/app.ts::app"]
    assert graph.counts() == {"files": 6, "symbols": 5, "chunks": graph.counts()["chunks"], "embedded": 0}
    with pytest.raises(lookup.NotFound):
        graph.call_graph("nothing", "callers")


def test_cypher(graph):
    def ask(text, **p):
        return [tuple(r) for r in graph.cypher(text, p).collect()]

    assert ask("MATCH (a:Symbol)-[c:CALLS]->(b:Symbol {name: 'parse'}) RETURN a.id AS id, c.call_site_line") == [("src/main.rs::main", 4)]
    assert ask("MATCH (b)<-[:CALLS]-(a) WHERE a.name = $n RETURN b.name ORDER BY b.name", n="main") == [("helper",), ("parse",)]
    assert ask("MATCH (f:File)-[:CONTAINS*1..]->(s) RETURN f.path, count(s) AS n ORDER BY n DESC, f.path LIMIT 2") == [("src/main.rs", 2), ("src/parser.rs", 1)]
    assert ask("MATCH (s:Symbol) WHERE s.name IN ['x', 'app'] AND NOT s.name STARTS WITH 'a' RETURN s.id") == [("web/lib.ts::x",)]
    assert ask("MATCH (s:Symbol) WHERE s.pagerank IS NOT NULL RETURN count(*)") == [(5,)]
    assert ask("MATCH (s:Symbol) OPTIONAL MATCH (s)-[:CALLS]->(t:Symbol) RETURN s.name, t.name ORDER BY s.name, t.name") == [("app", "x"), ("helper", None), ("main", "helper"), ("main", "parse"), ("parse", None), ("x", None)]
    assert ask("MATCH (c:Chunk) OPTIONAL MATCH (s:Symbol)-[:DOCUMENTED_BY]->(c) WHERE s.kind = 'Function' RETURN DISTINCT s.name AS n ORDER BY n SKIP 1 LIMIT 1") == [("helper",)]
    assert ask("MATCH (a:File), (b:File) WHERE a.path < b.path AND a.language = b.language RETURN count(*) AS n") == [(2,)]
    assert ask("UNWIND [3, 1] AS k RETURN k ORDER BY k") == [(1,), (3,)]
    for bad in ("CREATE (a:File)", "MATCH (a:File) SET a.x = 1 RETURN a", "MATCH (a:Nope) RETURN a", "MATCH (a) RETURN a", "MATCH (a:File) RETURN a.nope", "MATCH (a:File)", "MATCH (a:File) RETURN b", "%%", "MATCH (a:File {path: $p}) RETURN a"):
        with pytest.raises(CypherError):
            graph.cypher(bad)


def test_search(graph):
    with pytest.raises(vectors.NotEmbedded):
        graph.similar("fn helper")
    missing = graph.counts()["chunks"]
    assert graph.embed() == missing and graph.embed() == 0 and not graph.store.dirty("vector")
    best = graph.similar("fn helper() {}", 3, 0.5)
    assert best[0]["symbol"] == "helper" and best[0]["score"] == pytest.approx(1, abs=1e-6) and best[0]["line"] == 8
    assert graph.similar("zzz unrelated", 3, 0.9) == []
    # The same through an index, which goes when chunks are written.
    asked = ["fn helper() {}", "zzz unrelated", ""]
    scanned = [graph.similar(q, 4, 0.0) for q in asked]
    assert graph.store.vector_index() is None and graph.embed(index=True) == 0
    at = graph.store.vector_index()
    assert at and [graph.similar(q, 4, 0.0) for q in asked] == scanned and graph.embed(index=True) == 0 and graph.store.vector_index() == at
    graph.store.commit({"chunks": graph.store.read("chunks")})
    assert graph.store.vector_index() is None
    assert vectors.embedder_named("wovengraph.operators.vectors:hashed_features") is vectors.hashed_features
    for bad in ("wovengraph.operators.vectors:none", "no.such:f", ""):
        with pytest.raises(ValueError):
            vectors.embedder_named(bad)


def test_front_ends(graph, tree, monkeypatch, tmp_path):
    monkeypatch.setenv("HOME", str(tmp_path))
    said = []
    for argv in (["callers", "parse"], ["rank", "--format", "json"], ["deps", "src/main.rs", "--exact", "--format", "markdown"], ["impact", "parse"], ["context", "--symbol", "helper"], ["query", "MATCH (s:Symbol {name: 'x'}) RETURN s.id"], ["dead-code", "--format", "json"]):
        assert cli.run(cli.parser().parse_args(argv), graph, said.append) == 0
    assert "src/main.rs::main" in said[0] and json.loads(said[1])["symbols"][0]["rank"] == 1 and "| imports | src/parser.rs |" in said[2]
    assert "# Function `src/main.rs::helper`" in said[4] and "web/lib.ts::x" in said[5] and json.loads(said[6])["count"] == 1
    with pytest.raises(ValueError):
        cli.run(cli.parser().parse_args(["impact", "parse", "--format", "table"]), graph, said.append)
    lines = []
    for line in (".help", ".callers parse", ".deps src/main.rs", ".context src/main.rs", ".nope", "MATCH (f:File) RETURN count(f) AS n", "boom", ""):
        assert repl.command(graph, line, lines.append)
    assert not repl.command(graph, ".quit", lines.append)
    assert "src/main.rs::main" in lines[1] and "no command" in lines[4] and "6" in lines[5] and lines[6].startswith("error")


def test_server(graph, tree, monkeypatch, tmp_path, spark):
    monkeypatch.setenv("HOME", str(tmp_path))
    known = registry.Registry()
    known.register(registry.Entry("demo", str(tree), graph.store.folder, registry.now(), "abc"))
    known.save()
    s = server.Server(spark)
    ask = lambda method, **p: s.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "wovengraph"
    names = [t["name"] for t in ask("tools/list")["result"]["tools"]]
    assert names == sorted(names) and len(names) == 9

    def tool(name, **a):
        r = ask("tools/call", name=f"graph_{name}", arguments={"repo": "demo"} | a)["result"]
        return r.get("isError", False), r["content"][0]["text"]

    assert json.loads(tool("callers", symbol="parse")[1])["callers"][0]["id"] == "src/main.rs::main"
    assert json.loads(tool("cypher", query="MATCH (f:File) RETURN count(f) AS n")[1]) == [{"n": "6"}]
    assert json.loads(tool("impact", symbol="parse")[1])["matches"] == 1
    for name, args in (("callers", {}), ("callers", {"symbol": 3}), ("cypher", {"query": "CREATE (a:File)"}), ("nope", {}), ("deps", {"file": "no", "repo": "none"})):
        assert tool(name, **args)[0]
    assert json.loads(ask("resources/read", uri="graph://repos")["result"]["contents"][0]["text"])[0]["name"] == "demo"
    assert json.loads(ask("resources/read", uri="graph://repo/demo/status")["result"]["contents"][0]["text"])["symbols"] == 5
    assert "error" in ask("resources/read", uri="graph://no") and "error" in ask("what") and s.handle({"method": "notifications/initialized"}) is None
    assert "demo" in server.status()


def test_changes_are_followed(graph, tree, spark, tmp_path):
    store = graph.store
    (tree / "src/parser.rs").write_text("pub fn parse() -> u8 {\n    extra()\n}\nfn extra() -> u8 { 2 }\n")
    (tree / "bad.py").write_text("def good(): pass\n")
    os.remove(tree / "web/app.ts")
    report = graph.index(str(tree))
    assert (report.written, report.removed, report.failed) == (2, 1, [])
    t = store.tables()
    assert ("src/parser.rs::parse", "src/parser.rs::extra", 2) in rows(t["calls"])
    assert not t["symbols"].where("id like 'web/app%'").count() and not t["chunks"].where("id like 'web/app%'").count()
    assert graph.index(str(tree)).written == 0

    def touch(_):
        (tree / "web/lib.ts").write_text("export function y() {}\n")
        (tree / "bad.py").unlink(missing_ok=True)

    assert poll(store, str(tree), store.folder, rounds=1, wait=touch) == 1
    assert rows(store.read("symbols").where("id like 'web/%' or id like 'bad%'").select("id")) == [("web/lib.ts::y",)]
    # The same through a stream of events.
    (tree / "web/new.ts").write_text("function z() {}\n")
    (tmp_path / "ev").mkdir()
    schema = "event_id bigint, ts timestamp, path string, kind string"
    spark.createDataFrame([(1, f"{tree}/web/new.ts", "create"), (2, f"{tree}/notes.txt", "modify"), (3, f"{tree}/src/main.rs", "access")], "event_id bigint, path string, kind string").withColumn("ts", F.current_timestamp()).select("event_id", "ts", "path", "kind").write.mode("append").json(str(tmp_path / "ev"))
    for _ in range(2):  # the second finds nothing new
        watch(store, str(tree), spark.readStream.schema(schema).json(str(tmp_path / "ev")), "graph.db", str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert rows(store.read("symbols").where("id like 'web/new%'").select("id")) == [("web/new.ts::z",)]


def test_store_and_listing(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        store.root()
    store.initialize("/one")
    store.initialize("/one")
    with pytest.raises(StoreError):
        store.initialize("/two")
    before = store.manifest()
    with pytest.raises(Exception):
        store.commit({"files": spark.range(1)})
    assert store.manifest() == before and store.read("files").count() == 0
    store.initialize("/two", rebuild=True)
    assert store.root() == "/two"
    names, errors = scan.list_tree(str(tree), str(tree / "notes.txt"))
    assert "skip/gen.rs" not in names and "notes.txt" not in names and "a.log" not in names and not errors
    paths = spark.createDataFrame([("g.db",), ("g.db.wal",), ("g.dbx",)], "path string")
    assert rows(scan.without_database(paths, "g.db")) == [("g.dbx",)]


def test_two_writers(spark, tmp_path):
    """The second of two writers from one state changes nothing and is told so."""
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.initialize("/r")
    files = spark.createDataFrame([("a.py", "Python", 1, "h", [])], one.read("files").schema)
    one.begin()
    two.begin()
    one.commit({"files": files})
    with pytest.raises(StoreError, match="another writer"):
        two.commit({"files": files.limit(0)})
    assert two.read("files").count() == 1
    state = two.manifest()
    with pytest.raises(StoreError, match="another writer"):  # both past the check, as when they rename at once
        two._put(state)
    assert two.manifest() == state and len(list((tmp_path / "s" / "manifests").glob("*.json"))) == 2
    two.begin()
    two.commit({"files": files.limit(0)})
    assert one.read("files").count() == 0


RULES = {
    ".gitignore": "# none\n*.tmp\n!keep.tmp\n/top.py\nout/\ndocs/*.md\nsrc/**/gen.py\n**/cache\nlogs/**\nq?.py\n[xy]1.py\n[!a-z]z.py\n\\#odd.py\ntrail.py   \nsp\\ \n",
    "deep/.gitignore": "!back.tmp\nonly.py\n",
    "deep/.ignore": "!top.py\n*.late\n",
}
GONE = "a.tmp deep/a.tmp top.py out/a.py deep/out/a.py docs/a.md src/gen.py src/a/gen.py src/a/b/gen.py deep/cache cache/a.py logs/a logs/b/c qa.py deep/qb.py x1.py 0z.py #odd.py trail.py deep/only.py deep/in/only.py deep/a.late"
KEPT = "keep.tmp deep/keep.tmp deep/top.py docs/in/a.md gen.py q.py qab.py z1.py bz.py deep/back.tmp only.py a.late __init__.py [x]{y}*.py src/out sp"


def test_ignore_rules(spark, tmp_path):
    for name, text in RULES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    gone, kept = [*GONE.split(" "), "sp "], KEPT.split(" ")
    for name in gone + kept:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names, errors = scan.list_tree(str(tmp_path))
    assert (names, errors) == (sorted(kept), [])
    found, _ = scan.read_tree(spark, str(tmp_path))
    assert rows(found) == sorted((n, bytearray(n.encode()), len(n)) for n in kept)
    assert scan.read_files(spark, str(tmp_path), ["no.py"]).count() == 0 and scan.read_files(spark, str(tmp_path), kept, batch=1).count() == len(kept)


def test_registry(tmp_path):
    path = tmp_path / "r" / "registry.json"
    known = registry.Registry.load(path)
    known.register(registry.Entry("a", "/a", "/a/g", "t"))
    known.register(registry.Entry("a", "/a", "/a/h", "t2"))
    for bad in (registry.Entry("a", "/b", "", ""), registry.Entry("z", "/a", "", "")):
        with pytest.raises(registry.RegistryError):
            known.register(bad)
    known.register(registry.Entry("z", "/a", "/a/i", "t3"), force=True)
    known.save(path)
    again = registry.Registry.load(path)
    assert [(e.name, e.db_path) for e in again.entries] == [("a", "/a/i")] and again.by_path("/a").name == "a" and again.by_name("q") is None
    assert not registry.is_stale(registry.Entry("a", "/nowhere", "", "", "abc"))


def test_tables_of_text():
    assert render.table(["a", "bé"], [["x", "long"]]) == "+---+------+\n| a | bé  |\n+---+------+\n| x | long |\n+---+------+"
    assert render.cell(None, 4) == "—" and render.cell(0.123456, 4) == "0.1235" and render.cell("a\nb") == "a\\nb"
    assert render.rows("markdown", "T", "k", {"a": None}, [], "t").endswith("None.")
    with pytest.raises(ValueError):
        render.parse_format("xml")
    assert io.StringIO(render.rows("json", "T", "k", {"a": None}, [{"a": 1}])).read().startswith("{")


def sources(spark, n=40):
    """Files in one partition, as a small table of many programs comes."""
    files = [(f"f{k}.rs", bytearray(f"fn a{k}() {{\n    b();\n}}\nimpl A{k} {{}}\nimpl A{k} {{}}\n".encode()), 40) for k in range(n)]
    return spark.createDataFrame([*files, ("bad.py", bytearray(b"\xff"), 1)], "path string, content binary, file_size long").coalesce(1)


def test_parsing_is_dealt_over_all_cores(spark):
    parsed = scan.parse_files(sources(spark))
    assert parsed.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert parsed.withColumn("at", F.spark_partition_id()).select("at").distinct().count() > 4
    assert rows(parsed.where("failed").select("path", F.size("symbols"), F.size("calls"))) == [("bad.py", 0, 0)]
    assert rows(parsed.select(F.explode("calls").alias("c")).select("c.*").where("owner like 'f3.%'")) == [("f3.rs::a3", "b", 2, False)]


def test_changed_files_are_parsed_on_all_cores(spark):
    found = scan.file_rows(sources(spark).withColumnRenamed("file_size", "size"))
    fresh = scan.changed_files(found, found.where("path like 'f1%'"))
    parsed = scan.parse_files(fresh, "symbols")
    assert parsed.withColumn("at", F.spark_partition_id()).select("at").distinct().count() > 4
    assert parsed.count() == 30
