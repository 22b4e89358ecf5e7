"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from wovengraph.plans import catalog
from wovengraph.plans.mapping import Mapped

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    got = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(frame.columns) == sorted(columns)
    assert plain(frame.collect(), frame.columns) == plain(got.fetchall(), columns)


def test_converged_pagerank_against_plain_python(spark):
    m = Mapped(spark, FOLDER)
    ids = [r.id for r in m.symbols.select("id").collect()]
    out = {i: set() for i in ids}
    for r in m.calls.select("src", "dst").collect():
        out[r.src].add(r.dst)
    score = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(100):
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * sum(score[i] for i in ids if not out[i]) / len(ids))
        for i in ids:
            for j in out[i] - {i}:
                new[j] += 0.85 * score[i] / len(out[i])
        change = sum(abs(new[i] - score[i]) for i in ids)
        score = new
        if change < 1e-6:
            break
    got = {r.id: r.pagerank for r in catalog.QUERIES["pagerank_converged"](spark, FOLDER).collect()}
    assert got.keys() == score.keys() and max(abs(got[i] - score[i]) for i in ids) < 1e-9
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"pagerank_converged"}


def test_sessions_go_on_over_buckets(spark):
    import random

    from wovengraph.streaming import events as watch

    rng = random.Random(2)
    times = [rng.choice([0, 100, 10_000]) + rng.random() * rng.choice([1, 60, 900]) for _ in range(400)] + [5000.0, 5002.0, 5004.000001] + [20_000 + 1.5 * k for k in range(300)]
    rows = [(f"/p{rng.randrange(5)}", t) for t in times]
    frame = spark.createDataFrame(rows, "path string, t double").selectExpr("path", "timestamp_micros(cast(t * 1000000 as bigint)) as ts")
    got = sorted((r.events, r.paths, r.seconds) for r in watch.batches(frame, "2 seconds").selectExpr("events", "paths", "round(unix_micros(last_ts) / 1e6 - unix_micros(first_ts) / 1e6, 3) as seconds").collect())
    want, run = [], []
    for t, path in sorted((int(t * 1_000_000), p) for p, t in rows):
        if run and t > run[-1][0] + 2_000_000:
            want.append(run)
            run = []
        run.append((t, path))
    want.append(run)
    assert got == sorted((len(r), len({p for _, p in r}), round(r[-1][0] / 1e6 - r[0][0] / 1e6, 3)) for r in want)
    assert max(seconds for *_, seconds in got) > 2 * watch.BUCKET


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_symbols_and_their_parents_come_from_one_parse(spark):
    plan = catalog.QUERIES["parent_kind_lookup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_parsing_makes_only_the_lists_asked_for(spark):
    assert catalog.scan.parse_files(Mapped(spark, FOLDER).programs, "symbols").columns == ["path", "failed", "symbols"]


def test_lines_move_once_a_side_to_meet_the_next(spark):
    plan = Mapped(spark, FOLDER).calls._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # the two sides, and the pairs to be made distinct
