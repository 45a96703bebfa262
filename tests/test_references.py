"""Reference operators against plain versions on small rows."""

import itertools
import random

from quarrylens.operators import graph, references


def plain_outer(name, known):
    while "$" in name and name.rsplit("$", 1)[0] in known:
        name = name.rsplit("$", 1)[0]
    return name


def test_outer_class_of_any_depth(spark):
    rng = random.Random(3)
    names = {"A" + "".join(f"${rng.choice('xy1')}" for _ in range(k)) for k in range(6) for _ in range(8)} | {"$a", "B$", "C$$d", "C", "C$"}
    deep = ["D" + "$i" * k for k in range(40)]
    rows = [*sorted(names)[::2], *deep, "A", "A"]
    got = references.outer_class(spark.createDataFrame([(n,) for n in rows], "name string")).collect()
    assert sorted(map(tuple, got)) == sorted((n, plain_outer(n, set(rows))) for n in rows)


def test_names_containing_keys_of_all_lengths(spark):
    names = ["", None, "abcabc", "xabx", "héllo", "b"]
    keys = ["", None, "a", "ab", "abc", "b", "él", "abcabcd"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    found = references.names_containing(rows, "name", spark.createDataFrame([(k,) for k in keys], "key string"), "key")
    assert found.columns == ["i", "name", "key"]
    want = sorted((i, n, k) for (i, n), k in itertools.product(enumerate(names), keys) if n and k and k in n)
    assert sorted(map(tuple, found.collect())) == want
    assert references.names_containing(rows, "name", spark.createDataFrame([], "key string"), "key").count() == 0


def test_alias_version_tells_tables_apart(spark):
    def version(rows):
        return references.alias_version(spark.createDataFrame(rows, "id string, alias string, reason string")).first()[0]

    one = [(f"L{k};", f"Class_{k}", None) for k in range(300)]
    assert version(one) == version(one[::-1])
    others = [one[:-1], [*one, ("x", "y", "z")], [*one[:-1], ("L299;", "Class_29", "9")], [*one[:-1], ("L299;C", "lass_299", None)], []]
    assert len({version(x) for x in [one, *others]}) == 6


def test_classify_api_takes_the_first_rule(spark):
    nodes = spark.createDataFrame([("A", "f", 9), ("A", "g", 9), (None, "f", 9)], "class_name string, method_name string, api_type int")
    rules = spark.createDataFrame([(2, "A", "f", 5), (1, "A", "f", 4), (3, "B", "f", 6)], "position int, class_name string, method_name string, api_type int")
    got = {(r["class_name"], r["method_name"]): r["api_type"] for r in references.classify_api(nodes, rules).collect()}
    assert got == {("A", "f"): 4, ("A", "g"): 0, (None, "f"): 0}


def test_one_id_space_over_inputs(spark):
    node = "node_id long, owner string, name string, type int"
    first = spark.createDataFrame([(7, "B", "f", 1), (8, "A", "f", 0), (9, None, "g", 0)], node)
    second = spark.createDataFrame([(7, "A", "f", 5), (8, "C", "f", 6), (10, None, "g", 9)], node)
    edge = "src_id long, dst_id long, count int"
    inputs = [(first, spark.createDataFrame([(7, 8, 2), (7, 9, 1), (7, 99, 1)], edge)), (second, spark.createDataFrame([(7, 8, 3), (8, 10, 4), (8, 10, 4)], edge))]
    nodes, edges = graph.one_id_space(inputs, ["owner", "name"])
    assert nodes.columns == ["node_id", "owner", "name", "type"]
    assert sorted(map(tuple, nodes.collect())) == [(0, None, "g", 0), (1, "A", "f", 0), (2, "B", "f", 1), (3, "C", "f", 6)]
    assert sorted(map(tuple, edges.collect())) == [(1, 3, 3), (2, 0, 1), (2, 1, 2), (3, 0, 4), (3, 0, 4)]
    nodes, edges = graph.one_id_space([(n.limit(0), e) for n, e in inputs], ["owner", "name"])
    assert (nodes.count(), edges.count()) == (0, 0)
