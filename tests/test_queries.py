"""Every query with SQL against DuckDB, and dataflow, cycles and masks against small plain versions."""

import datetime
import decimal
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrylens.functions import text
from quarrylens.operators import dataflow, graph, search
from quarrylens.plans import catalog


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert ours == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_entry_and_registers(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def reachable(pairs, start, without=None):
    seen, todo = set(), [start] if start != without else []
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in pairs if a == n and b != without]
    return seen


@pytest.fixture(scope="module")
def flows():
    """Random flow graphs of ten blocks; a few jump back."""
    rng = random.Random(11)
    return {m: sorted({(k, k + 1) for k in range(9)} | {(rng.randrange(10), rng.randrange(10)) for _ in range(rng.randrange(6))}) for m in range(40)}


@pytest.fixture(scope="module")
def edges(spark, flows):
    return spark.createDataFrame([(m, a, b) for m, p in flows.items() for a, b in p], "method long, src long, dst long")


def test_dominators_frontiers_and_loops(flows, edges):
    def strict(p):
        return {n: {d for d in reachable(p, 0) if d != n and n not in reachable(p, 0, without=d)} for n in reachable(p, 0)}

    idom, front, loops = {}, set(), set()
    for m, p in flows.items():
        dom = strict(p)
        for n, ds in dom.items():
            idom[m, n] = next((d for d in ds if dom[d] == ds - {d}), None)
            front |= {(m, n, y) for x, y in p if x in dom and y in dom and (n == x or n in dom[x]) and n not in dom[y]}
        loops |= {(m, h, t) for t, h in p if t in dom and (h == t or h in dom[t])}
    assert {(r["method"], r["block"]): r["idom"] for r in dataflow.dominators(edges).collect()} == idom
    assert {tuple(r) for r in dataflow.frontiers(edges).collect()} == front
    rows = dataflow.loops(edges).collect()
    assert {(r["method"], r["head"], r["tail"]) for r in rows} == loops
    assert all(r["block"] in reachable(flows[r["method"]], 0) for r in rows)


def test_liveness_and_reaching_definitions(spark, flows, edges):
    rng = random.Random(12)
    facts = {m: [(b, rng.randrange(3), rng.choice(["use", "def"])) for b in range(10)] for m in flows}
    frame = spark.createDataFrame([(m, *f) for m, own in facts.items() for f in own], "method long, block long, slot long, kind string")
    live, reach = set(), set()
    for m, p in flows.items():
        use, define = ({(b, s) for b, s, k in facts[m] if k == kind} for kind in ("use", "def"))
        for slot in range(3):
            ins = set()
            for _ in range(12):
                ins = {n for n in range(10) if (n, slot) in use or ((n, slot) not in define and any(a == n and b in ins for a, b in p))}
            live |= {(m, n, slot) for n in ins}
            for d in (b for b, s in define if s == slot):
                at = set()
                for _ in range(12):
                    at = {b for a, b in p if a == d or (a in at and (a, slot) not in define)}
                reach |= {(m, n, slot, d) for n in at}
    assert {tuple(r) for r in dataflow.liveness(edges, frame).where("live_in").select("method", "block", "slot").collect()} == live
    assert {tuple(r) for r in dataflow.reaching(edges, frame).collect()} == reach


def test_dataflow_on_one_method_that_spans_batches_and_on_none(spark):
    n = 25_000
    chain = spark.range(n).select(F.lit(1).cast("long").alias("method"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    other = spark.createDataFrame([(0, 0, 1), (2, 0, 1), (None, 0, 1)], "method long, src long, dst long")
    out = dataflow.dominators(chain.unionByName(other)).groupBy("method").count().collect()
    assert {(r["method"], r["count"]) for r in out} == {(0, 2), (1, n + 1), (2, 2)}
    assert dataflow.dominators(other.where("false")).count() == 0


def test_grams_of_short_and_wide_texts(spark):
    rows = spark.createDataFrame([("",), ("ab",), ("abc",), ("ABCabc",), ("\U0001f600ä€x",), (None,)], "t string")
    for r in rows.select("t", text.gram_bits(F.col("t")).alias("g")).collect():
        if r["t"] is not None:
            w = [ord(c) for c in r["t"].lower()]
            assert sorted(r["g"]) == sorted({(a * 63001 + b * 251 + c) & 8191 for a, b, c in zip(w, w[1:], w[2:], strict=False)})


def test_search_masks_scopes_and_errors(spark):
    docs = spark.createDataFrame([(1, "greet(); // commentOnly\nabc/**/def\nabc    def"), (2, None), (3, "")], "doc_id long, text string")
    hits = lambda q, **k: [(r["doc_id"], r["line_no"]) for r in search.search(docs, q, **k).collect()]
    assert hits("commentonly") == [(1, 1)] and hits("commentOnly", comments=False) == [] and hits("greet", code=False) == []
    assert hits("abc    def", comments=False, grams=search.gram_index(docs)) == [(1, 2), (1, 3)]
    assert hits("") == [] and search.truncated(search.search(docs, "abc", limit=2), 2)
    with pytest.raises(Exception, match="unterminated"):
        hits("[", regex=True)


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7)], "src_id long, dst_id long")
    got = {}
    for r in graph.strong_components(e).collect():
        got.setdefault(r[1], set()).add(r[0])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5]]


def test_strong_components_of_the_whole_table(spark, sf_dir, con):
    edges = con.execute("SELECT DISTINCT l_partkey, next FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next FROM lineitem) WHERE next IS NOT NULL").fetchall()
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            for n in step.get(todo.pop(), []):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    back = {}
    for a, b in edges:
        back.setdefault(b, []).append(a)
    want, left = {}, set(out) | set(back)
    while left:
        n = min(left)
        group = reach(n, out) & reach(n, back)
        left -= group
        want |= {k: n for k in group} if len(group) > 1 else {}
    assert {r[0]: r[1] for r in catalog.QUERIES["strong_components"](spark, sf_dir).collect()} == want


def test_components_of_the_whole_table(spark, sf_dir, con):
    sql = "SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next FROM lineitem"
    edges = con.execute(f"SELECT DISTINCT * FROM ({sql}) WHERE next IS NOT NULL").fetchall()
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {tuple(r) for r in catalog.QUERIES["components"](spark, sf_dir).collect()} == {(n, root(n)) for n in up}


def test_setops_except_takes_away_the_parts_of_discounted_lines(spark, tmp_path):
    """On the standard tables every part has such a line; here two have none."""
    spark.range(1, 6).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0.06), (2, 0.05), (3, 0.1), (3, 0.0), (5, 0.07)], "l_partkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 3).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(r[0] for r in catalog.QUERIES["setops_except"](spark, str(tmp_path)).collect()) == [2, 4]
