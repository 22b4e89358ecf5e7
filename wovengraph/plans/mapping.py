"""Graph tables derived from the driver's star schema, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSION = {"en": "rs", "de": "py", "fr": "ts", "es": "weird"}


#: Programs for the parsers; {k} and {z} stand for a part's key and size.
PROGRAMS = {
    "py": """class C{k}:
    @property
    def m{z}(self, x=h{k}()):
        return self.g{z}(lambda: n{k}())

def f{k}():
    k{z}()
    def inner():
        deep{k}()
""",
    "rs": """pub struct C{k} { a: u8 }

impl C{k} {
    pub fn m{z}(&self) -> u8 {
        self.g{z}()
    }
}

fn f{k}() {
    k{z}();
    fn inner() { deep{k}(); }
}
""",
    "ts": """export class C{k} {
  m{z}(x = h{k}()) {
    return this.g{z}(() => n{k}());
  }
}

function f{k}() {
  k{z}();
  function inner() { deep{k}(); }
}
""",
}


class Mapped:
    """Lazily derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.folder = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def symbols(self) -> DataFrame:
        kind = F.when(F.col("p_size") % 3 == 0, "Function").when(F.col("p_size") % 3 == 1, "Method").otherwise("Struct")
        part_id = F.concat("p_brand", F.lit(".rs::"), F.col("p_partkey").cast("string"))
        return self.table("part").select(
            part_id.alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").cast("bigint").alias("start_line"),
            (F.col("p_size") + 10).cast("bigint").alias("end_line"), F.col("p_type").alias("signature"),
        )

    @property
    def scores(self) -> DataFrame:
        part_id = F.concat("p_brand", F.lit(".rs::"), F.col("p_partkey").cast("string"))
        return self.table("part").select(part_id.alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") / 1000).alias("pagerank"))

    @property
    def followed(self) -> DataFrame:
        """(l_orderkey, l_linenumber, l_partkey, callee): each line with the parts of its order's next line.  Both
        sides are dealt by the join's keys before they are made distinct, so each moves once."""
        at = ["l_orderkey", "l_linenumber"]
        lines = self.table("lineitem")
        few = lines.select(*at, "l_partkey").repartition(*at).distinct()
        after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee")).repartition(*at).distinct()
        return few.join(after, at)

    @property
    def calls(self) -> DataFrame:
        pairs = self.followed.select("l_partkey", "callee", "l_linenumber").distinct()
        ids = self.table("part").select("p_partkey", F.concat("p_brand", F.lit(".rs::"), F.col("p_partkey").cast("string")).alias("id"))
        a, b = ids.select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("src")), ids.select(F.col("p_partkey").alias("callee"), F.col("id").alias("dst"))
        return pairs.join(a, "l_partkey").join(b, "callee").select("src", "dst", F.col("l_linenumber").cast("bigint").alias("call_site_line"))

    @property
    def last_calls(self) -> DataFrame:
        """Of each part only its last call, so that chains of callers get long."""
        last = self.followed.groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "callee")).alias("at"))
        ids = self.table("part").select("p_partkey", F.concat("p_brand", F.lit(".rs::"), F.col("p_partkey").cast("string")).alias("id"))
        a, b = ids.select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("src")), ids.select(F.col("p_partkey").alias("callee"), F.col("id").alias("dst"))
        return last.select("l_partkey", "at.callee").join(a, "l_partkey").join(b, "callee").select("src", "dst")

    @property
    def with_uncalled(self) -> DataFrame:
        """The symbols, and one a supplier, which nothing calls; some of these are entry points."""
        key = F.col("s_nationkey") % 5
        name = F.when(key == 0, "main").when(key == 1, F.concat(F.lit("test_"), "s_name")).otherwise(F.col("s_name"))
        more = self.table("supplier").select(
            F.concat(F.lit("Supplier.rs::"), F.col("s_suppkey").cast("string")).alias("id"), name.alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "Struct").when(F.col("s_suppkey") % 3 == 1, "Function").otherwise("Method").alias("kind"),
            F.col("s_suppkey").cast("bigint").alias("start_line"), (F.col("s_suppkey") + 5).cast("bigint").alias("end_line"), F.col("s_name").alias("signature"),
        )
        return self.symbols.unionByName(more)

    @property
    def contains(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        nid = F.concat_ws("::", "r_name", "n_name")
        top = nation.select(F.lit("File").alias("src_kind"), F.col("r_name").alias("src"), nid.alias("dst"))
        low = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("Symbol").alias("src_kind"), nid.alias("src"), F.concat_ws("::", nid, F.col("c_custkey").cast("string")).alias("dst"))
        return top.unionByName(low)

    @property
    def places(self) -> DataFrame:
        """The symbols that `contains` holds."""
        return self.contains.select(F.col("dst").alias("id"), F.element_at(F.split("dst", "::"), -1).alias("name"), F.when(F.col("src_kind") == "File", "Class").otherwise("Method").alias("kind"), F.length("dst").cast("bigint").alias("start_line"))

    @property
    def imports(self) -> DataFrame:
        n = self.table("nation")
        rows = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        pairs = rows.select("s_nationkey", "c_nationkey").distinct()
        a = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src"))
        b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
        return pairs.join(F.broadcast(a), "s_nationkey").join(F.broadcast(b), "c_nationkey").select("src", "dst")  # 25 nations

    @property
    def files(self) -> DataFrame:
        ext = F.create_map(*(F.lit(x) for kv in EXTENSION.items() for x in kv))[F.col("lang")]
        return self.table("documents").select(
            F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "lang",
            F.col("n_chars").alias("file_size"), F.sha2("text", 256).alias("hash"), "text",
        )

    @property
    def programs(self) -> DataFrame:
        """A source file for each part, in one of three languages by its key."""
        part = self.table("part").withColumn("k", F.col("p_partkey").cast("string")).withColumn("z", F.col("p_size").cast("string"))
        text = F.create_map(*(F.lit(x) for kv in PROGRAMS.items() for x in kv))
        ext = F.element_at(F.array(*(F.lit(e) for e in PROGRAMS)), (F.col("p_partkey") % len(PROGRAMS) + 1).cast("int"))
        content = F.replace(F.replace(text[ext], F.lit("{k}"), F.col("k")), F.lit("{z}"), F.col("z"))
        return part.select(F.concat(F.lit("p"), "k", F.lit("."), ext).alias("path"), content.cast("binary").alias("content"), F.octet_length(content).cast("bigint").alias("file_size"))

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.format_string("f%d.py::chunk::%d", F.col("vec_id") % 50, "vec_id").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.lit("Python").alias("language"), F.col("vec_id").alias("start_line"), F.when(F.col("vec_id") % 11 != 3, F.col("embedding")).alias("embedding"))

    @property
    def documented_by(self) -> DataFrame:
        v = self.table("embeddings")
        cid = F.format_string("f%d.py::chunk::%d", F.col("vec_id") % 50, "vec_id").alias("chunk_id")
        files = v.where("vec_id % 13 <> 5").select(F.lit("File").alias("src_kind"), F.format_string("f%d.py", F.col("vec_id") % 50).alias("src"), cid)
        owners = v.where("vec_id % 3 = 0").select("vec_id", cid)
        parts = self.table("part").select(F.col("p_partkey").alias("vec_id"), F.concat("p_brand", F.lit(".rs::"), F.col("p_partkey").cast("string")).alias("src"))
        return files.unionByName(owners.join(parts, "vec_id").select(F.lit("Symbol").alias("src_kind"), "src", "chunk_id"))

    @property
    def modules(self) -> DataFrame:
        """Symbols with three-part ids and calls by name, for the call resolver."""
        kind = F.when(F.col("p_size") % 3 == 0, "Function").when(F.col("p_size") % 3 == 1, "Method").otherwise("Struct")
        deep = F.concat("p_brand", F.lit(".rs::"), "p_type", F.lit("::"), "p_name")
        flat = F.concat("p_brand", F.lit(".rs::"), "p_name")
        part = self.table("part").withColumn("id", F.when(F.col("p_size") % 2 == 0, deep).otherwise(flat))
        names = part.select("p_partkey", "id")
        called = self.followed.join(names, F.col("l_partkey") == F.col("p_partkey")).select("id", "callee", "l_linenumber")
        called = called.join(part.select(F.col("p_partkey").alias("callee"), "p_name"), "callee")
        lists = called.groupBy("id").agg(F.to_json(F.sort_array(F.collect_set(F.struct(F.col("p_name").alias("name"), F.col("l_linenumber").cast("bigint").alias("line"), (F.col("l_linenumber") % 2 == 0).alias("is_method"))))).alias("raw_calls"))
        rows = part.groupBy("id").agg(F.min("p_name").alias("name"), F.min(kind).alias("kind"))
        return rows.join(lists, "id", "left").select("id", "name", "kind", F.coalesce("raw_calls", F.lit("not json")).alias("raw_calls"))

    @property
    def brand_imports(self) -> DataFrame:
        p = self.table("part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("n")).distinct()
        pairs = p.select((F.col("n") + 1).alias("m"), "n").join(p.select(F.col("n").alias("m")), "m")
        more = p.select((F.col("n") + 3).alias("m"), "n").join(p.select(F.col("n").alias("m")), "m")
        return pairs.unionByName(more).select(F.format_string("Brand#%d.rs", "n").alias("src"), F.format_string("Brand#%d.rs", "m").alias("dst"))

    @property
    def trees(self) -> DataFrame:
        """Script and Rust files with imports, for the import resolvers."""
        p = self.table("part").select("p_partkey", "p_size", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
        end = F.when(F.col("p_size") % 5 == 0, ".ts").when(F.col("p_size") % 5 == 1, ".tsx").when(F.col("p_size") % 5 == 2, ".js").when(F.col("p_size") % 5 == 3, "/index.ts").otherwise("/index.js")
        script = p.where("p_size % 3 = 0").select(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "a", end).alias("path"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("./"), "a")).otherwise(F.concat(F.lit("./../"), F.lower("p_type"), F.lit("/"), "a", F.lit(".js"))).alias("import"))
        inner = p.where("p_size % 3 = 1").select(F.concat(F.lit("src/"), "a", F.lit("/"), "b", F.when(F.col("p_size") % 2 == 0, ".rs").otherwise("/mod.rs")).alias("path"), F.concat(F.when(F.col("p_size") % 4 == 0, "super::").when(F.col("p_size") % 4 == 1, "crate::").when(F.col("p_size") % 4 == 2, "").otherwise("self::"), F.lower("p_type"), F.lit("::"), "a", F.lit("::Item")).alias("import"))
        outer = p.where("p_size % 7 = 2").select(F.concat(F.lit("src/"), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, ".rs").otherwise("/mod.rs")).alias("path"), F.concat(F.lit("crate::"), "a", F.lit("::"), "b", F.lit("::"), "a").alias("import"))
        rows = script.unionByName(inner).unionByName(outer)
        return rows.groupBy("path").agg(F.to_json(F.sort_array(F.collect_set(F.struct(F.col("import").alias("path"), F.lit(1).cast("bigint").alias("line"))))).alias("raw_imports"))

    @property
    def events(self) -> DataFrame:
        ext = F.element_at(F.array(*(F.lit(x) for x in ("rs", "py", "txt", "kt", ""))), (F.col("user_id") % 5 + 1).cast("int"))
        path = F.concat(F.when(F.col("user_id") % 9 == 4, "rel/").otherwise("/w/"), F.when(F.col("user_id") % 17 == 6, "graph.db").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit("."), ext)
        return self.table("events").select("event_id", "ts", path.alias("path"), F.when(F.col("event_type") == "error", "access").when(F.col("event_type") == "signup", "remove").otherwise("modify").alias("kind"))


_ID = "p_brand || '.rs::' || p_partkey"
_KIND = "CASE p_size % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Method' ELSE 'Struct' END"
SQL: dict[str, str] = {
    "symbols": f"SELECT {_ID} AS id, p_name AS name, {_KIND} AS kind, p_size::BIGINT AS start_line, (p_size + 10)::BIGINT AS end_line, p_type AS signature FROM part",
    "scores": f"SELECT {_ID} AS id, CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 1000 END AS pagerank FROM part",
    "few": "SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_linenumber AS n FROM lineitem",
    "calls": "SELECT DISTINCT x.p_brand || '.rs::' || x.p_partkey AS src, y.p_brand || '.rs::' || y.p_partkey AS dst, a.n::BIGINT AS call_site_line FROM few a JOIN few b ON a.o = b.o AND b.n = a.n + 1 JOIN part x ON x.p_partkey = a.p JOIN part y ON y.p_partkey = b.p",
    "last_calls": "SELECT x.p_brand || '.rs::' || x.p_partkey AS src, y.p_brand || '.rs::' || y.p_partkey AS dst FROM (SELECT a.p, b.p AS q, row_number() OVER (PARTITION BY a.p ORDER BY a.o DESC, a.n DESC, b.p DESC) AS r FROM few a JOIN few b ON a.o = b.o AND b.n = a.n + 1) JOIN part x ON x.p_partkey = p JOIN part y ON y.p_partkey = q WHERE r = 1",
    "with_uncalled": "SELECT * FROM symbols UNION ALL SELECT 'Supplier.rs::' || s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'test_' || s_name ELSE s_name END, CASE s_suppkey % 3 WHEN 0 THEN 'Struct' WHEN 1 THEN 'Function' ELSE 'Method' END, s_suppkey::BIGINT, (s_suppkey + 5)::BIGINT, s_name FROM supplier",
    "contains": "SELECT 'File' AS src_kind, r_name AS src, r_name || '::' || n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'Symbol', r_name || '::' || n_name, r_name || '::' || n_name || '::' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "places": "SELECT dst AS id, string_split(dst, '::')[-1] AS name, CASE src_kind WHEN 'File' THEN 'Class' ELSE 'Method' END AS kind, length(dst)::BIGINT AS start_line FROM contains",
    "imports": "SELECT DISTINCT a.n_name AS src, b.n_name AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey",
    "files": "SELECT source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'rs' WHEN 'de' THEN 'py' WHEN 'fr' THEN 'ts' ELSE 'weird' END AS path, lang, n_chars AS file_size, sha256(text) AS hash, text FROM documents",
    "vectors": "SELECT 'f' || (vec_id % 50) || '.py::chunk::' || vec_id AS id, 'label ' || label AS text, 'Python' AS language, vec_id AS start_line, CASE WHEN vec_id % 11 <> 3 THEN embedding END AS embedding FROM embeddings",
    "documented_by": f"SELECT 'File' AS src_kind, 'f' || (vec_id % 50) || '.py' AS src, 'f' || (vec_id % 50) || '.py::chunk::' || vec_id AS chunk_id FROM embeddings WHERE vec_id % 13 <> 5 UNION ALL SELECT 'Symbol', {_ID}, 'f' || (vec_id % 50) || '.py::chunk::' || vec_id FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 3 = 0",
    "mpart": f"SELECT p_partkey, p_name, {_KIND} AS kind, CASE WHEN p_size % 2 = 0 THEN p_brand || '.rs::' || p_type || '::' || p_name ELSE p_brand || '.rs::' || p_name END AS id FROM part",
    "modules": "SELECT id, min(p_name) AS name, min(kind) AS kind FROM mpart GROUP BY id",
    "asked": "SELECT DISTINCT x.id AS src, y.p_name AS name, a.n::BIGINT AS line, a.n % 2 = 0 AS is_method FROM few a JOIN few b ON a.o = b.o AND b.n = a.n + 1 JOIN mpart x ON x.p_partkey = a.p JOIN mpart y ON y.p_partkey = b.p",
    "brands": "SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part",
    "brand_imports": "SELECT 'Brand#' || a.n || '.rs' AS src, 'Brand#' || b.n || '.rs' AS dst FROM brands a JOIN brands b ON b.n = a.n + 1 OR b.n = a.n + 3",
    "pieces": "SELECT p_size, lower(p_type) AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part",
    "scripts": "SELECT 'src/' || t || '/' || a || CASE p_size % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '/index.ts' ELSE '/index.js' END AS path, t, a, p_size FROM pieces WHERE p_size % 3 = 0",
    "rusts": "SELECT 'src/' || a || '/' || b || CASE WHEN p_size % 2 = 0 THEN '.rs' ELSE '/mod.rs' END AS path, CASE p_size % 4 WHEN 0 THEN 'super' WHEN 1 THEN 'crate' WHEN 2 THEN '' ELSE 'self' END AS head, a, b, p_size, [t, a, 'Item'] AS segs FROM pieces WHERE p_size % 3 = 1 UNION ALL SELECT 'src/' || t || CASE WHEN p_size % 2 = 0 THEN '.rs' ELSE '/mod.rs' END, 'crate', a, b, p_size, [a, b, a] FROM pieces WHERE p_size % 7 = 2",
    "paths": "SELECT DISTINCT path FROM scripts UNION SELECT path FROM rusts",
    "events_": "SELECT event_id, ts, CASE WHEN user_id % 9 = 4 THEN 'rel/' ELSE '/w/' END || CASE WHEN user_id % 17 = 6 THEN 'graph.db' ELSE 'u' || user_id END || '.' || ['rs', 'py', 'txt', 'kt', ''][(user_id % 5 + 1)::INT] AS path, CASE event_type WHEN 'error' THEN 'access' WHEN 'signup' THEN 'remove' ELSE 'modify' END AS kind FROM events",
}


def sql(*needed: str) -> str:
    """A WITH clause of the tables needed and those before them."""
    uses = {"calls": ("few",), "places": ("contains",), "modules": ("mpart",), "asked": ("few", "mpart"), "last_calls": ("few",), "with_uncalled": ("symbols",), "brand_imports": ("brands",), "scripts": ("pieces",), "rusts": ("pieces",), "paths": ("scripts", "rusts")}
    found: list[str] = []

    def add(name: str) -> None:
        for other in uses.get(name, ()):
            add(other)
        if name not in found:
            found.append(name)

    for name in needed:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in found)
