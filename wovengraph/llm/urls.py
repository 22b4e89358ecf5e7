"""URL filtering with rules and a cascade of Bloom filters, in DataFrame functions only.

The keys are hosts and their parent domains.  Level 0 of the cascade encodes the listed keys;
level 1 the unlisted keys of the corpus that level 0 takes for listed; level 2 the listed keys
that level 1 takes for its own; and so on until no key of either side is mistaken.  The first
level that doesn't hold a key tells whether it is listed, exactly, for every key of the corpus
the cascade was built over, and no join is needed.  Level 0 is so tight that about as many
unlisted keys pass as are listed, so the size follows the list and the logarithm of the corpus.

The levels travel as array literals of a bounded size: a list of more than LIMIT keys is dealt
into parts by hash, each with a cascade of its own over the whole corpus, and a host is listed
if one of them says so, in a pass over the rows for each part.

Rows: a null url, or one without `://`, has the empty host and path and no key.  Repeated urls
are judged each.  Urls of any length are read whole; of a host only as many labels as the
longest listed key has can matter.  An empty table gives an empty result; an empty list blocks
nothing; only the named columns are read."""

from __future__ import annotations

import json
import math
import string
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.llm.common import checkpoint

#: Listed keys that one cascade is built for, at most (some 40 bits each).
LIMIT = 1_000_000


@dataclass(frozen=True)
class Rule:
    """`verdict` for the host and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def host_and_path(url: str) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url column."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(F.col(url), parts, k), F.lit("")) for k in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def domains(host: Column, labels: int) -> Column:
    """The host and its parent domains of `labels` labels at most; none for the empty host."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    every = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


@dataclass(frozen=True)
class Level:
    """A Bloom filter of `bits` bits with `probes` probes; `words` as text, comma-separated."""

    number: int
    bits: int
    probes: int
    words: str

    def places(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(key, F.lit(2 * self.number + k)), F.lit(self.bits)) for k in (0, 1))
        return [F.pmod(a + b * k, F.lit(self.bits)) for k in range(self.probes)]

    def holds(self, key: Column) -> Column:
        table = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to a literal once
        found = F.lit(True)
        for at in self.places(key):
            found = found & (F.getbit(table[(F.shiftright(at, 6)).cast("int")], (at % 64).cast("int")) == 1)
        return found

    @staticmethod
    def over(keys: DataFrame, number: int, share: float) -> Level:
        """A filter of the keys in column `key` that takes about `share` of other keys for its own."""
        n = max(1, keys.count())
        probes = max(1, round(math.log2(1 / share)))
        bits = max(64, 64 * math.ceil(n * probes / math.log(2) / 64))
        empty = Level(number, bits, probes, "")
        places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
        table = ["0"] * (bits // 64)
        for row in words.collect():  # bits / 64 rows at most
            table[row.word] = str(row.set)
        return Level(number, bits, probes, ",".join(table))


def cascade(listed: DataFrame, corpus: DataFrame) -> list[Level]:
    """The levels for distinct `listed` keys over the keys of the corpus, both in column `key`."""
    n = listed.count()
    if not n:
        return []
    universe = corpus.agg(F.approx_count_distinct("key").alias("n")).collect()[0].n
    levels = [Level.over(listed, 0, min(0.25, n / max(universe, 1)))]
    mistaken = corpus.where(levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti")
    # From here on both sides are about as small as the list.
    ours, theirs = listed, checkpoint(mistaken)
    while theirs.count():
        levels.append(Level.over(theirs, len(levels), 0.25))
        ours, theirs = theirs, checkpoint(ours.where(levels[-1].holds(F.col("key"))))
    return levels


def key_table(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """Distinct keys, of any characters, in column `key`."""
    told = json.dumps(sorted(set(keys)), ensure_ascii=False)
    return spark.range(1).select(F.explode(F.from_json(F.lit(told), "array<string>")).alias("key"))


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key is listed: whether the first level without it has an odd number."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[k].holds(key), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def judge(pages: DataFrame, rules: Iterable[Rule], listed: Iterable[str] | DataFrame, page_id: str = "page_id", url: str = "url", limit: int = LIMIT) -> DataFrame:
    """A row for each page: page_id, host, path, rule (the longest that fits, or null), verdict
    (the rule's; else block where the host or a parent domain is listed, allow elsewhere).

    `listed` are domains, or a table with them in column `key`."""
    spark = pages.sparkSession
    host, path = host_and_path(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    table = listed if isinstance(listed, DataFrame) else key_table(spark, listed)
    table = checkpoint(table.where("key <> ''").select("key").distinct())
    n, labels = table.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("key", r"\.", -1))), F.lit(1))).collect()[0]
    host, path = F.col("host"), F.col("path")
    # Longest first, so the first that fits wins.
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    rule = F.coalesce(*(F.when(r.fits(host, path), F.lit(r.text)) for r in ordered), F.lit(None).cast("string"))
    said = F.coalesce(*(F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in ordered), F.lit(None).cast("string"))
    corpus = rows.select(F.explode(domains(host, labels)).alias("key"))
    marked, parts = rows.withColumn("blocked", F.lit(False)), max(1, -(-n // limit))
    for k in range(parts):
        part = table.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        if levels := cascade(part, corpus):
            marked = marked.withColumn("blocked", F.col("blocked") | F.exists(domains(host, labels), partial(member, levels)))
        if k + 1 < parts:
            marked = checkpoint(marked)
    return marked.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(said, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
