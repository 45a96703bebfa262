"""Search over scopes under one limit, the gram index, and the index cache."""

import random

import pytest

from quarrylens.operators import gram_index, scopes, search
from quarrylens.operators.gram_index import GramIndex
from quarrylens.sources.index_cache import IndexCache


def texts_on_disk(spark, tmp_path, rows, name="texts", schema="doc_id long, text string"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def hits(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def cache(spark, tmp_path):
    return IndexCache(spark, str(tmp_path / "indexes"))


def test_index_drops_no_hit(spark, tmp_path, cache):
    dice = random.Random(3)
    words = ["alpha", "Beta", "ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ", "İstanbul", "straße", "STRASSE", "x\ny", "q/**/r", "日本語の文", "\U0001f600\U0001f601z", ""]
    rows = [(k, " ".join(dice.choice(words) for _ in range(dice.randrange(12)))) for k in range(200)] + [(200, None), (201, ""), (201, "alpha again"), (None, "alpha of nobody"), (202, "lorem ipsum " * 20_000)]
    docs = texts_on_disk(spark, tmp_path, rows)
    index = GramIndex.of(docs, cache=cache, part_chars=500)
    for q in ["alpha", "BETA", "οδοσ", "ΟΔΟΣ", "δυσσ", "istanbul", "straße", "日本語", "\U0001f600\U0001f601", "ab", "a", "no such text", "m lorem"]:
        for case in (False, True):
            assert hits(index.search(q, case=case, limit=None)) == hits(search.search(docs, q, case=case, limit=None)), (q, case)
    assert hits(index.search("q    r", comments=False, limit=None)) == hits(search.search(docs, "q    r", comments=False, limit=None)) != []
    assert hits(index.search("alp[h]a", regex=True, limit=None)) == hits(search.search(docs, "alp[h]a", regex=True, limit=None)) != []
    assert index.search("", limit=None).count() == 0
    seen = index.counters("alpha")
    assert sum(seen.values()) == len(rows) and seen["missing"] == 1


def test_limited_search_leaves_later_parts_unread(spark, tmp_path, cache):
    docs = texts_on_disk(spark, tmp_path, [(k, f"common words and number {k}\nrare{k // 90}") for k in range(400)])
    index = GramIndex.of(docs, cache=cache, part_chars=400)
    everything = len(index.unions.collect())
    got = index.search("common", limit=5)
    assert [r["doc_id"] for r in got.collect()] == [0, 1, 2, 3, 4]
    assert len(index.parts_read) == 1 < everything
    assert hits(index.search("common", limit=250)) == hits(search.search(docs, "common", limit=250)) and len(index.parts_read) < everything
    index.search("rare4", limit=None)
    assert 0 < len(index.parts_read) < everything / 4 and index.texts_read < 100
    assert hits(index.only(spark.createDataFrame([(7,), (9,)], "k long")).search("common", limit=None)) == hits(search.search(docs.where("doc_id in (7, 9)"), "common", limit=None))


def test_a_query_reads_only_the_longs_it_needs(spark, tmp_path, cache):
    index = GramIndex.of(texts_on_disk(spark, tmp_path, [(1, "some text here")]), cache=cache)
    masks = gram_index.needed(spark, "here")
    plan = index.grams.where(gram_index.may_match(masks)).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert schema.count("g") - schema.count("bigint") <= len(masks) + 2 and len(masks) <= 2


def test_cache_hits_misses_and_publishes_once(spark, tmp_path, cache):
    docs, built = texts_on_disk(spark, tmp_path, [(1, "one"), (2, "two")]), []

    def write(path):
        built.append(path)
        docs.write.parquet(f"{path}/rows")

    for _ in range(2):
        assert cache.get_or_build([docs], {"a": 1}, write)["rows"].count() == 2
    assert len(built) == 1  # the second call has read no source
    cache.get_or_build([docs], {"a": 2}, write)
    more = texts_on_disk(spark, tmp_path, [(3, "three")])
    cache.get_or_build([more], {"a": 1}, write)
    assert len(built) == 3 and cache.entries().count() == 3

    key, epoch = cache.fingerprint([more], {"a": 4}), cache.epoch()
    assert cache.store(key, epoch, write) and not cache.store(key, epoch, write)  # two writers leave one entry

    def racing(path):
        write(path)
        cache.advance_epoch()

    late = cache.fingerprint([more], {"a": 5})
    assert not cache.store(late, cache.epoch(), racing) and cache.lookup(late) is None
    with pytest.raises(ZeroDivisionError):
        cache.store(late, cache.epoch(), lambda path: 1 / 0)
    assert sorted(s.getPath().getName() for s in cache.files.listStatus(cache._path()) if "stage" in s.getPath().getName()) == []
    sizes = {r["key"]: r["size"] for r in cache.entries().collect()}
    gone = cache.evict(max(sizes.values()))
    assert 0 < len(gone) < len(sizes) and cache.entries().count() == len(sizes) - len(gone)
    before = len(built)
    cache.get_or_build([more], {"a": 4}, write, rebuild=True)
    assert len(built) == before + 1


def test_scopes_after_a_full_limit_are_not_opened(spark):
    rows = spark.createDataFrame([("a/A", "x", "k", 0, 1, 1, 0, f"hit {k}") for k in range(5)], scopes.HIT)
    opened = []

    def scope(name):
        return scopes.Scope(name, lambda left: opened.append((name, left)) or rows)

    found = scopes.search_scopes(spark, [scope("one"), scope("two"), scope("three")], scopes.Query("hit"), 7, [scope("second")])
    assert opened == [("one", 7), ("two", 2)] and found.truncated and found.hits.count() == 7
    assert found.searched == {"one": 5, "two": 2}
    opened.clear()
    found = scopes.search_scopes(spark, [scope("one")], scopes.Query("hit"), 5, [scope("second")])
    assert found.truncated and opened == [("one", 5)]  # reached exactly
    opened.clear()
    found = scopes.search_scopes(spark, [scope("one")], scopes.Query("hit"), 8, [scope("second")])
    assert opened == [("one", 8), ("second", 3)] and found.hits.count() == 8
    opened.clear()
    assert scopes.search_scopes(spark, [scope("one")], scopes.Query(""), 5).hits.count() == 0 and not opened
    with pytest.raises(ValueError):
        scopes.search_scopes(spark, [scope("one")], scopes.Query("[", regex=True), 5)
    assert not opened


def test_inner_classes_are_searched_in_their_owner_once(spark, tmp_path, cache):
    classes = spark.createDataFrame([("p/A",), ("p/A$B",), ("p/A$B$C",), ("p/D$E",), ("Root",)], "name string")
    rows = [("p/A", "needle one\nnone"), ("p/A$B", "needle of an inner class"), ("p/D$E", "needle: its owner is unknown"), ("Root", "needle"), ("q/Z", "needle of no class")]
    sources = spark.createDataFrame(rows, "name string, text string")
    own = lambda q, **k: [r["owner"] for r in scopes.search_scopes(spark, [scopes.source_scope(classes, sources, q, **k)], q, 100).hits.collect()]
    assert own(scopes.Query("needle")) == ["Root", "p/A", "p/D$E"]
    assert own(scopes.Query("needle"), inner=True) == ["Root", "p/A", "p/A$B", "p/D$E"]
    assert own(scopes.Query("needle", package="<default>")) == ["Root"]
    assert own(scopes.Query("needle", package="p.")) == ["p/A", "p/D$E"]
    index = GramIndex.of(texts_on_disk(spark, tmp_path, rows, schema="name string, text string"), "name", "text", cache)
    q = scopes.Query("needle")
    assert [r["owner"] for r in scopes.search_scopes(spark, [scopes.source_scope(classes, index, q)], q, 2).hits.collect()] == ["Root", "p/A"]


def test_names_annotations_and_resources(spark):
    symbols = spark.createDataFrame([("La/Green;", "Green", "a/Green", "class", ""), ("La/Green;->run()V", "run", "a/Green", "method", "()V"), ("La/Green;->leaf:I", "leaf", "a/Green", "field", ":I")], "id string, name string, owner string, kind string, descriptor string")
    aliases = spark.createDataFrame([("La/Green;->run()V", "greenRun")], "id string, alias string")
    found = lambda scope, q: [(r["kind"], r["node"], r["column"], r["text"]) for r in scopes.search_scopes(spark, [scope], q, 100).hits.collect()]
    q = scopes.Query("green")
    assert found(scopes.symbol_scope(symbols, aliases, q, {"class", "method", "field"}), q) == [("class", "a.Green", 3, "a.Green"), ("method", "a.Green.greenRun()V", 1, "greenRun()V")]
    assert found(scopes.symbol_scope(symbols, aliases, q, {"field"}), q) == []
    notes = spark.createDataFrame([("a/A", "m", "@Override // from a.B"), ("a/A", "n", None)], "owner string, id string, text string")
    for text, code, comments, n in [("override", True, False, 1), ("override", False, True, 0), ("from", True, False, 0), ("from", False, True, 1), ("Override // from", True, True, 1)]:
        q = scopes.Query(text)
        assert len(found(scopes.annotation_scope(notes, q, code, comments), q)) == n, (text, code, comments)
    entries = spark.createDataFrame([("res/green.png", "green inside"), ("a.XML", "x green\ngreen"), ("green", "green")], "name string, text string")
    q = scopes.Query("green", package="no.such")
    assert [x[1:3] for x in found(scopes.resource_scope(entries, q), q)] == [("a.XML", 3), ("a.XML", 1), ("green", 1), ("res/green.png", 5)]


def test_filter_and_counters(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "others")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.filter_rows(docs, "WORDS").collect()] == [1]
    assert tuple(search.counters(docs, search.gram_index(docs), "words").first()) == (1, 1, 1)
