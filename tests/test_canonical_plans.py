"""How often references are read, dealt out and joined, and what colours hand on."""

import re

import pytest

from quarrylens.operators import graph, references, xrefs
from quarrylens.plans import canonical, catalog
from quarrylens.plans.base import Tables


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_joined_once(spark, sf_dir):
    rows = canonical.refs(Tables(spark, sf_dir))
    assert plan_of(rows).count("Join ") == 1 and plan_of(rows).count("Relation") == 2
    moved = spark.createDataFrame([("La;->m()V", "Lb;->m()V")], "id string, canonical string")
    assert plan_of(xrefs.reference_index(rows, moved)).count("Join ") == 2


def test_names_of_one_end_and_first_rows(spark):
    symbols = spark.createDataFrame([("b", "m()V"), ("b", "n()V")], "owner string, suffix string")
    up = spark.createDataFrame([("a", "b", 1)], "child string, parent string, ordinal int")
    refs = spark.createDataFrame([("a", "La;->n()V", "La;->m()V"), ("a", "La;->n()V", None), ("a", None, "La;->q()V")], "class string, from string, target string")
    name = lambda **k: {tuple(r) for r in xrefs.canonical_names(refs, symbols, up, **k).collect()}
    assert name(ends=("target",)) == {("La;->m()V", "Lb;->m()V")}
    assert name() == {("La;->m()V", "Lb;->m()V"), ("La;->n()V", "Lb;->n()V")}
    rows = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 1, "z"), (2, None, "w"), (2, 0, "v")], "k int, o int, v string")
    assert sorted(map(tuple, references.first_of_each(rows, ["k"], ["o"]).collect())) == [(1, 1, "y"), (2, None, "w")]


def test_compact_decode_deals_callers_out_once(spark, sf_dir):
    """One exchange by caller after the join: not one for the distinct rows and another for the lists."""
    plan = catalog.QUERIES["compact_decode"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*(?:class|p_brand|from)", plan)) == 1, plan


def test_spread_sends_changes_alone(spark, monkeypatch):
    """A long way and a cycle: rows handed on are those of nodes whose colour has changed, and no round compares whole tables."""
    monkeypatch.setattr(type(spark.range(1)), "exceptAll", lambda *a: pytest.fail("whole tables are compared"))
    edges = [(k, k + 1) for k in range(6)] + [(6, 3), (20, 21)]
    got = graph.spread(spark.createDataFrame(edges, "src_id long, dst_id long"), spark.createDataFrame([(k, k) for k in (*range(7), 20, 21)], "n long, c long"))
    assert dict(map(tuple, got.collect())) == {**dict.fromkeys(range(7), 0), 20: 20, 21: 20}
