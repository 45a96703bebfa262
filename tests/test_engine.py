"""The engine's entry and the column functions behind it, against plain Python."""

import random

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from quarrylens.engine import Engine, NotAllowed, report
from quarrylens.functions import names, text


@pytest.fixture(scope="module")
def engine(spark):
    symbols = [
        ("Lcom/a/B;", "B", "com/a/B", "class", 1, ""),
        ("Lcom/a/Bar;", "Bar", "com/a/Bar", "class", 1, ""),
        ("Lcom/a/B;->run()V", "run", "com/a/B", "method", 0x101, "()V"),
        ("Lcom/a/B;->rerun()V", "rerun", "com/a/B", "method", 1, "()V"),
        ("Lcom/a/B;->x:I", "x", "com/a/B", "field", 2, "I"),
    ]
    return Engine(spark, {"symbols": spark.createDataFrame(symbols, "id string, name string, owner string, kind string, flags int, descriptor string"), "edges": spark.createDataFrame([(1, 2), (2, 3), (4, 1)], "src_id long, dst_id long")})


def test_query_reads_and_nothing_else(engine):
    assert engine.query("SELECT count(*) AS n FROM symbols -- all\n;").first()["n"] == 5
    assert engine.query("WITH x AS (SELECT src_id FROM edges) SELECT max(src_id) AS m FROM x").first()["m"] == 4
    for bad in ("DROP VIEW symbols", "CREATE TABLE t AS SELECT 1", "INSERT INTO symbols SELECT * FROM symbols", "SELECT 1; SELECT 2", "SET a=b"):
        with pytest.raises((ParseException, AnalysisException)):
            engine.query(bad).collect()
    with pytest.raises(ValueError):
        engine.query("  ")


def test_tools_and_strict_arguments(engine):
    assert [r["name"] for r in engine.rendered("get_all_classes")] == ["B", "Bar"]
    assert [r["name"] for r in engine.rendered("get_methods_of_class", class_name="com.a.B")] == ["rerun", "run"]
    assert [r["name"] for r in engine.rendered("get_fields_of_class", class_name="Lcom/a/B;")] == ["x"]
    assert [r["name"] for r in engine.rendered("search_method_by_name", name="run")] == ["run", "rerun"]
    assert [r["name"] for r in engine.rendered("search_classes_by_keyword", keyword="ar", count=5)] == ["Bar"]
    assert [r["id"] for r in engine.rendered("native_method_find", name="run")] == ["Lcom/a/B;->run()V"]
    assert {(r["src_id"], r["dst_id"]) for r in engine.rendered("get_call_graph", id=1)} == {(1, 2), (4, 1)}
    assert engine.rendered("cg_query", sql="SELECT 1 AS one") == [{"one": 1}]
    for tool, given, error in (("nothing", {}, ValueError), ("cg_query", {}, ValueError), ("cg_query", {"sql": "SELECT 1", "x": 1}, ValueError), ("get_all_classes", {"count": "5"}, TypeError), ("get_all_classes", {"count": True}, TypeError)):
        with pytest.raises(error):
            engine.call(tool, **given)


def test_report(spark):
    got = report("T", {"Parts": spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int").orderBy("n")}, rows=1)
    assert got == "# T\n\n## Parts\n\n| name | n |\n| --- | --- |\n| a\\|b | 1 |\n\nMore rows are left out here.\n"


def java_hash(t):
    h = 0
    data = t.encode("utf-16-be")
    for k in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[k : k + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def int32(x):
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def folded(op, a, b):
    if op in "/%":
        if not b:
            return None
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return int32(q if op == "/" else a - q * b)
    plain = {"+": a + b, "-": a - b, "*": a * b, "&": a & b, "|": a | b, "^": a ^ b, "<<": a << (b & 31), ">>": a >> (b & 31), ">>>": (a & 0xFFFFFFFF) >> (b & 31)}
    return int32(plain[op])


def leb(x, signed):
    out = []
    while True:
        low = x & 127
        x >>= 7
        if (x == 0 and not (signed and low & 64)) or (signed and x == -1 and low & 64):
            return bytes([*out, low])
        out.append(low | 128)


def test_column_functions(spark):
    texts = ["", "a", "\U0001f600 x", "\u00e9" * 40, "class", "x1", "1x", "$_", "\u00e4b", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.java_hash(F.col("t")).alias("h"), names.valid_identifier(F.col("t")).alias("v")).collect()
    assert [r["h"] for r in rows] == [java_hash(t) for t in texts]
    assert [r["t"] for r in rows if r["v"]] == ["a", "\u00e9" * 40, "x1", "$_", "\u00e4b"]
    rng = random.Random(1)
    edge = [0, 1, -1, 7, -7, 2**31 - 1, -(2**31), 31, 32, 33]
    pairs = [(a, b) for a in edge for b in edge] + [(rng.randint(-(2**31), 2**31 - 1), rng.randint(-(2**31), 2**31 - 1)) for _ in range(60)]
    ops = ["+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>"]
    out = spark.createDataFrame(pairs, "a long, b long").select("a", "b", *[names.fold_int(op, F.col("a"), F.col("b")).alias(f"o{k}") for k, op in enumerate(ops)]).collect()
    for r in out:
        for k, op in enumerate(ops):
            assert r[f"o{k}"] == folded(op, r["a"], r["b"]), (op, r["a"], r["b"])
    numbers = [0, 1, 63, 64, 127, 128, 300, 2**31 - 1]
    got = spark.createDataFrame([(bytearray(leb(x, False) + b"\xff\x01"), bytearray(leb(-x, True) + b"\x00")) for x in numbers], "u binary, s binary").select(names.leb128(F.col("u")).alias("u"), names.leb128(F.col("s"), True).alias("s")).collect()
    assert [(r["u"], r["s"]) for r in got] == [(x, -x) for x in numbers]
    assert spark.createDataFrame([(bytearray(b"\x80\x80"),), (bytearray(b""),)], "u binary").select(names.leb128(F.col("u")).alias("u")).collect() == [(None,), (None,)]
    codes = [[ord(c) ^ 42 for c in "hello world"], [200, 1], []]
    got = spark.createDataFrame([(c,) for c in codes], "c array<int>").select(names.xor_decode(F.col("c"), [1, 42, 43]).alias("x")).collect()
    assert got[0]["x"]["key"] == 42 and got[0]["x"]["text"] == "hello world" and got[1]["x"] is None and got[2]["x"] is None


def test_queries_stay_inside_the_relations(spark, tmp_path):
    part = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    spark.createDataFrame([(9,)], "k int").createOrReplaceTempView("hidden")
    spark.createDataFrame([(7, "mine")], "k int, v string").createOrReplaceTempView("part")
    secret = tmp_path / "secret.txt"
    secret.write_text("no")
    engine = Engine(spark, {"part": part, "other": part})
    good = {
        "SELECT count(*) AS n FROM part": 2,
        "select max(k) from PART;": 2,
        "WITH a AS (SELECT * FROM part), b AS (SELECT * FROM a JOIN other USING (k)) SELECT count(*) FROM b WHERE k IN (SELECT k FROM part)": 2,
        "SELECT count(*) FROM (SELECT explode(array(1, 2, 3)) AS x)": 3,
        "SELECT count(*) FROM part LATERAL VIEW explode(array(k, k)) t AS x": 4,
        "SELECT count(*) FROM range(5)": 5,
        "SELECT sum(k) OVER (PARTITION BY v ORDER BY k) FROM part WHERE k = 2": 2,
        "SELECT k FROM part UNION SELECT k FROM other EXCEPT SELECT 2": 1,
        "SELECT count(*) FROM (VALUES (1), (2)) t(x)": 2,
        "SELECT max(k) FROM part TABLESAMPLE (100 PERCENT) HAVING count(*) > 1": 2,
    }
    for sql, want in good.items():
        assert engine.query(sql).first()[0] == want, sql
    refused = [
        f"SELECT * FROM text.`{secret}`",
        f"SELECT * FROM part WHERE v IN (SELECT value FROM text.`{secret}`)",
        f"SELECT (SELECT max(value) FROM text.`{secret}`)",
        "SELECT * FROM hidden",
        "WITH a AS (SELECT * FROM hidden) SELECT * FROM a",
        "WITH hidden AS (SELECT 1 AS k) SELECT * FROM hidden",
        "SELECT * FROM default.part",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM part ORDER BY reflect('java.lang.System', 'exit', 1)",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM part",
        "SELECT input_file_name() FROM part",
        "SELECT current_user()",
        "SELECT * FROM read_files('/etc')",
        "SELECT * FROM IDENTIFIER('hidden')",
        "DROP VIEW hidden",
        "CREATE TEMP VIEW z AS SELECT 1",
        "INSERT INTO part VALUES (3, 'c')",
        "SET spark.sql.shuffle.partitions=3",
        "SHOW TABLES",
        "EXPLAIN SELECT 1",
        "CACHE TABLE part",
    ]
    for sql in refused:
        with pytest.raises(NotAllowed):
            engine.query(sql)
            raise AssertionError(sql)
    for sql in ["", " ; ", "SELECT 1 x) UNION ALL (SELECT 2", "SELECT 1; SELECT 2", "no query"]:
        with pytest.raises((ValueError, ParseException)):
            engine.query(sql)
    assert spark.table("part").first()["v"] == "mine" and spark.table("hidden").first()["k"] == 9
    assert not spark.catalog.tableExists("other")
    for n in ("part", "hidden"):
        spark.catalog.dropTempView(n)


def test_csv_bytes_repairs_modified_utf8(spark):
    cases = {b'plain "x"\n\t': 'plain "x"  ', b"a\xc0\x80b": "a b", "é日本\U0001f600".encode(): "é日本\U0001f600", b"\xed\xa0\xbd\xed\xb8\x80!": "\U0001f600!", b"\xed\xa0\xbdx": "???x", b"\xff\xfea": "??a", b"\xe2\x82": "??", b"\xc1\x81": "??", b"\xf5\x80\x80\x80": "????", b"": "", b"\xf4\x8f\xbf\xbf": "\U0010ffff"}
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(cases)], "k int, b binary")
    assert [r["t"] for r in df.orderBy("k").select(text.csv_bytes(F.col("b")).alias("t")).collect()] == list(cases.values())


def test_checked_class_names(spark):
    names_of = {"a/B": True, "a": True, "": False, "/a": False, "a//b": False, "a/../b": False, "a/.": False, "a\\b": False, "c:a": False, "a\x01": False, "a/..b": True}
    df = spark.createDataFrame([(n,) for n in names_of], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", names.safe_class_name(F.col("n")).alias("s")).collect()} == names_of
    assert df.where(names.safe_class_name(F.col("n"))).select(names.checked_class_name(F.col("n"))).count() == 3
    with pytest.raises(Exception, match="unsafe class name: a/../b"):
        df.where("n = 'a/../b'").select(names.checked_class_name(F.col("n"))).collect()


def test_report_is_rendered(spark):
    from quarrylens import report as analysis

    one = spark.createDataFrame([("liba.so", "f|g"), ("liba.so", "<h>")], "so_name string, name string")
    nodes, strings = spark.createDataFrame([(0,), (1,), (1,)], "node_type int"), spark.createDataFrame([("http://a", True), ("b", False)], "str string, is_url boolean")
    mark, page = analysis.rendered(analysis.sections(nodes, one, one, one, one, one, strings), "Report & more", ["android.permission.INTERNET"])
    assert "| Java methods | 3 |" in mark and "| liba.so | f\\|g |" in mark and "| http://a |  |" in mark and "INTERNET" in mark
    assert "<h1>Report &amp; more</h1>" in page and "&lt;h&gt;" in page and "<td>b" not in page
