"""Import and call resolution as prioritised joins.

Every candidate of an import or call gets a rank, candidates join with what exists, and the
best rank wins; ties follow a declared order (by id), so results don't depend on scan order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.functions.text import extension, normal_path, parent_path, replace_extension, symbol_file

RAW_IMPORTS = "array<struct<path:string,line:bigint>>"
RAW_CALLS = "array<struct<name:string,line:bigint,is_method:boolean>>"


def decoded(column: str, frame: DataFrame, kind: str) -> Column:
    """A nested column as it is, or from JSON text; text that isn't a JSON array gives null."""
    if frame.schema[column].dataType.typeName() != "string":
        return F.col(column)
    return F.when(F.ltrim(F.col(column)).startswith("["), F.from_json(F.col(column), kind))


def raw_imports(files: DataFrame) -> DataFrame:
    """(src, import) for every import of every file."""
    return files.select(F.col("path").alias("src"), F.explode(decoded("raw_imports", files, RAW_IMPORTS)).alias("i")).select("src", F.col("i.path").alias("import")).distinct()


def relative_imports(files: DataFrame) -> DataFrame:
    """(src, dst): imports that begin with a dot.  The joined path is tried with its extension
    replaced by ts, tsx, js and jsx, then as a folder with index.ts or index.js."""
    wanted = raw_imports(files).where(F.col("import").startswith("."))
    base = normal_path(F.concat_ws("/", parent_path(F.col("src")), F.col("import")))
    tries = [replace_extension(F.col("base"), e) for e in ("ts", "tsx", "js", "jsx")] + [F.concat("base", F.lit(f"/index.{e}")) for e in ("ts", "js")]
    asked = wanted.withColumn("base", base).select("src", "import", F.posexplode(F.array(*tries)).alias("rank", "dst"))
    hits = asked.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return hits.groupBy("src", "import").agg(F.min_by("dst", "rank").alias("dst")).select("src", "dst").distinct()


def rust_imports(files: DataFrame) -> DataFrame:
    """(src, dst): use paths of .rs files.  `crate` and bare paths begin in src, `self` in the
    file's folder, each `super` one folder up; segments are followed while each is a file or a
    folder with mod.rs, and the deepest hit wins."""
    parts = F.split("import", "::")
    head = parts[0]
    rows = raw_imports(files).where((extension(F.col("src")) == "rs") & ~F.col("import").startswith("."))
    rows = rows.withColumn("ups", F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.forall(F.slice(parts, 1, k), lambda p: p == "super")), lambda yes: yes)))
    own = F.split(parent_path(F.col("src")), "/")
    depth = F.when(parent_path(F.col("src")) == "", 0).otherwise(F.size(own))
    up = F.array_join(F.slice(own, 1, F.greatest(depth - F.col("ups"), F.lit(0))), "/")
    begin = F.when(F.col("ups") > 0, up).when(head == "self", parent_path(F.col("src"))).otherwise("src")
    skip = F.when(F.col("ups") > 0, F.col("ups")).when(head.isin("crate", "self"), 1).otherwise(0)
    rest = F.when(F.size(parts) > skip, F.slice(parts, skip + 1, F.size(parts))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("src", "import", begin.alias("begin"), rest.alias("rest")).where(F.size("rest") > 0)
    asked = rows.select("src", "import", "begin", F.explode(F.transform(F.sequence(F.lit(1), F.size("rest")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("rest", 1, k), "/").alias("tail")))).alias("t"))
    stem = F.when(F.col("begin") == "", F.col("t.tail")).otherwise(F.concat("begin", F.lit("/"), F.col("t.tail")))
    asked = asked.select("src", "import", F.col("t.depth").alias("depth"), F.posexplode(F.array(F.concat(stem, F.lit(".rs")), F.concat(stem, F.lit("/mod.rs")))).alias("rank", "dst"))
    hits = asked.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    best = hits.groupBy("src", "import", "depth").agg(F.min_by("dst", "rank").alias("dst"))
    # Depths count from 1, so a depth has no miss before it if as many depths were hit up to it.
    order = Window.partitionBy("src", "import").orderBy("depth")
    whole = best.withColumn("nth", F.row_number().over(order)).where("nth = depth")
    return whole.groupBy("src", "import").agg(F.max_by("dst", "depth").alias("dst")).select("src", "dst").distinct()


def resolve_imports(files: DataFrame) -> DataFrame:
    """Both kinds, each edge once."""
    return relative_imports(files).unionByName(rust_imports(files)).distinct()


def raw_calls(symbols: DataFrame) -> DataFrame:
    """(src, name, line, is_method) for every call of every symbol; bad text has none."""
    rows = symbols.select(F.col("id").alias("src"), F.explode(decoded("raw_calls", symbols, RAW_CALLS)).alias("c"))
    return rows.select("src", F.col("c.name").alias("name"), F.col("c.line").alias("line"), F.col("c.is_method").alias("is_method")).distinct()


_CALL = ("src", "name", "line", "is_method")


def tier_method(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tier 1: a method call from an id of three segments or more to its sibling of that name."""
    sibling = F.concat(F.regexp_replace("src", r"::(?:(?!::).)*\z", ""), F.lit("::"), F.col("name"))
    wanted = asked.where(F.col("is_method") & (F.size(F.split("src", "::")) >= 3)).withColumn("dst", sibling)
    return wanted.join(symbols.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*_CALL, "dst")


def tier_file(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tier 2: the first symbol of that name, by id, in the caller's file."""
    here = symbols.groupBy(symbol_file(F.col("id")).alias("file"), "name").agg(F.min("id").alias("dst"))
    return asked.withColumn("file", symbol_file(F.col("src"))).join(here, ["file", "name"]).select(*_CALL, "dst")


def tier_import(asked: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Tier 3: the first symbol of that name in the first imported file that has one."""
    there = symbols.groupBy(symbol_file(F.col("id")).alias("imported"), "name").agg(F.min("id").alias("dst"))
    links = imports.select(F.col("src").alias("file"), F.col("dst").alias("imported")).distinct()
    # First per file and name, then to the calls: the calls aren't multiplied by the imports.
    best = links.join(there, "imported").groupBy("file", "name").agg(F.min_by("dst", "imported").alias("dst"))
    return asked.withColumn("file", symbol_file(F.col("src"))).join(best, ["file", "name"]).select(*_CALL, "dst")


def tier_global(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tier 4: all functions and methods of that name, or else all symbols of it."""
    return asked.join(_pool(symbols), "name").select(*_CALL, "dst")


def resolve_calls(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, call_site_line, tier): each call by the first tier that finds something.

    Tiers 1 to 3 find one symbol at most for a sibling's id or a (file, name), so each is one
    left join with a table of those, computed once; only calls that none of them resolves
    look for their name anywhere (the rest carry keys that nothing has, spread evenly)."""
    file = symbol_file(F.col("id"))
    method = F.col("is_method") & (F.size(F.split("src", "::")) >= 3)
    sibling = F.concat(F.regexp_replace("src", r"::(?:(?!::).)*\z", ""), F.lit("::"), F.col("name"))
    asked = raw_calls(symbols).withColumn("file", symbol_file(F.col("src"))).withColumn("sibling", F.when(method, sibling).otherwise(_nobody()))
    ids = symbols.select(F.col("id").alias("sibling"), F.col("id").alias("dst1")).distinct()
    first = symbols.groupBy(file.alias("file"), "name").agg(F.min("id").alias("dst2"))
    links = imports.select(F.col("src").alias("file"), F.col("dst").alias("imported")).distinct()
    there = links.join(first.withColumnsRenamed({"file": "imported", "dst2": "dst3"}), "imported").groupBy("file", "name").agg(F.min_by("dst3", "imported").alias("dst3"))
    tiers = asked.join(ids, "sibling", "left").join(first, ["file", "name"], "left").join(there, ["file", "name"], "left")
    one = F.coalesce("dst1", "dst2", "dst3")
    tier = F.when(F.col("dst1").isNotNull(), 1).when(F.col("dst2").isNotNull(), 2).when(F.col("dst3").isNotNull(), 3).otherwise(4)
    told = tiers.select("src", "line", one.alias("one"), tier.alias("tier"), F.when(one.isNull(), F.col("name")).otherwise(_nobody()).alias("name"))
    found = told.join(_pool(symbols).withColumnRenamed("dst", "any"), "name", "left").withColumn("dst", F.coalesce("one", "any"))
    return found.where("dst is not null").groupBy("src", "dst", F.col("line").alias("call_site_line")).agg(F.min("tier").alias("tier"))


def _nobody() -> Column:
    """A key that no symbol has, one of many, so that rows without a key don't meet in one task."""
    return F.concat(F.lit("\0"), F.pmod(F.xxhash64("src", "name", "line"), F.lit(100_000)).cast("string"))


def _pool(symbols: DataFrame) -> DataFrame:
    """(name, dst): of each name all functions and methods, or else all symbols."""
    called = F.col("kind").isin("Function", "Method")
    some = symbols.groupBy("name").agg(F.max(called).alias("any_called"))
    return symbols.join(some, "name").where(called | ~F.col("any_called")).select("name", F.col("id").alias("dst")).distinct()
