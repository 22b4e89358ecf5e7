"""URL filters against plain Python, and the cascade's exactness over its universe."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wovengraph.llm import urls
from wovengraph.llm.queries import URL_LIST, URL_RULES

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])


def slow(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    labels = host.split(".")
    bad = any(".".join(labels[k:]) in listed for k in range(len(labels))) if host else False
    return host, path, rule and rule.text, rule.verdict if rule else ("block" if bad else "allow")


def pages():
    rng = random.Random(3)
    found = [None, "", "no scheme", "://", "http://", "http://COM/en/1", "http://com?x", "http://org/es/", "http://a.ORG/es/x#y", "http://xcom/en/1", "http://example.com/en/7", "http://é.EXAMPLE.com/en/71?q", "http://example.com/en/8", "http://b.example.net/de/8/9", "http://b.example.net/de/7", "a://b://c.com/en/", "http://bad.test", "http://x.BAD.test/é?", "http://notbad.test/", "http://.bad.test./", "http://bad.test..", "http://" + "a." * 3000 + "bad.test/", "\nhttp://bad.test\n/x\n"]
    found += [f"https://{rng.choice(['', 'www.', 'm.'])}h{rng.randrange(3000)}.{rng.choice(['bad.test', 'fine.test', 'com', 'net'])}/{rng.choice(['en', 'de'])}/{rng.randrange(99)}" for _ in range(4000)]
    return [(i, u, "clash") for i, u in enumerate(found)] + [(7, found[7], "clash"), (None, "http://x.bad.test/", "c")]


def test_matches_plain_python_in_one_part_and_in_many(spark):
    rng = random.Random(4)
    listed = {"bad.test", *(f"h{rng.randrange(3000)}.fine.test" for _ in range(300)), *(f"h{i}.absent.test" for i in range(50))}
    rows = pages()
    want = sorted(((p, *slow(u, listed)) for p, u, _ in rows), key=str)
    frame = spark.createDataFrame(rows, PAGES)
    for limit in (urls.LIMIT, 90):
        got = urls.judge(frame, URL_RULES, listed, limit=limit)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_the_cascade_is_exact_over_its_universe(spark):
    listed = urls.key_table(spark, (f"k{i}" for i in range(500)))
    corpus = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = urls.cascade(listed, corpus)
    assert len(levels) > 2
    wrong = corpus.where(urls.member(levels, F.col("key")) != (F.substring("key", 2, 9).cast("int") < 500))
    assert wrong.count() == 0


def test_hosts_with_line_feeds_and_other_odd_characters(spark):
    odd = ["\n", '"', "\\", ",", "\t", "é", "'", "\u2028"]
    hosts = [f"h{i}{odd[i % len(odd)]}x{i}.test" for i in range(20_000)]
    listed = {h for h in hosts[::50]} | {f"l{i}.other" for i in range(300)}
    frame = spark.createDataFrame([(i, f"http://{h}/p", "") for i, h in enumerate(hosts)], PAGES)
    got = {r.page_id: (r.host, r.verdict) for r in urls.judge(frame, [], listed).collect()}
    assert got == {i: (h, "block" if h in listed else "allow") for i, h in enumerate(hosts)}


def test_the_list_may_be_a_table(spark):
    frame = spark.createDataFrame(pages()[:30], PAGES)
    table = spark.createDataFrame([("bad.test",), ("bad.test",), ("",), (None,)], "key string")
    assert sorted(map(str, urls.judge(frame, URL_RULES, table).collect())) == sorted(map(str, urls.judge(frame, URL_RULES, ["bad.test"]).collect()))


def test_no_python_in_the_plan(spark):
    plan = urls.judge(spark.createDataFrame(pages()[:9], PAGES), URL_RULES, ["bad.test"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|SortMergeJoin|BroadcastHashJoin", plan)


def test_empty_table_and_list(spark):
    empty = spark.createDataFrame([], PAGES)
    assert urls.judge(empty, URL_RULES, ["bad.test"]).count() == 0
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://bad.test", "")], PAGES), [], []).collect()} == {"allow"}


def test_every_junk_name_of_the_pages_is_listed(spark):
    hosts = ["free-bets.example.com", "m.ads-track.example.com", "www.spam-farm.example.org", "m.adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com"]
    frame = spark.createDataFrame([(i, f"https://{h}/x/1", "") for i, h in enumerate([*hosts, "fine.example.com"])], PAGES)
    assert [r.verdict for r in urls.judge(frame, URL_RULES, URL_LIST).orderBy("page_id").collect()] == ["block"] * len(hosts) + ["allow"]
