"""Renames, undo and projects against a plain replay."""

import json
import random

import pytest

from quarrylens.operators import renames

SYMBOLS = "id string, name string"
ROWS = [
    ("La/A;", "A"), ("La/B;", "B"), ("Lb/A;", "A"), ("LTop;", "Top"),
    ("La/A;->f:I", "f"), ("La/A;->g:I", "g"), ("La/A;->f()V", "f"), ("La/A;->h()V", "h"), ("La/A;-><init>()V", "<init>"), ("La/B;->f:I", "f"),
]


def plain_scope(i):
    if "@local:" in i:
        return i.split("@local:")[0]
    if "->" in i:
        return i.split("->")[0], "(" in i.split("->")[1]
    return ("package", i[1:-1].rpartition("/")[0])


def plain_replay(rows, entries):
    """The first refused id of a replay in order of id, or the aliases."""
    names, aliases = dict(rows), {}
    for i in entries:
        if "@local:" in i and i.split("@local:")[0] in dict(rows):
            names[i] = i.rsplit(":", 1)[1]
    for i, new in sorted(entries.items()):
        if i not in names or new in ("int", "1x", "") or names[i].startswith("<"):
            return i
        if any(o != i and plain_scope(o) == plain_scope(i) and aliases.get(o, n) == new for o, n in names.items()):
            return i
        if new != names[i]:
            aliases[i] = new
    return aliases


def test_replay_equals_a_plain_one(spark):
    rng = random.Random(5)
    symbols = spark.createDataFrame(ROWS, SYMBOLS)
    ids = [i for i, _ in ROWS if "<" not in i] + ["La/A;->h()V@local:1:x", "La/A;->h()V@local:2:y"]
    cases = [{i: rng.choice(["A", "B", "f", "g", "h", "x", "y", f"n{rng.randrange(40)}", f"m{rng.randrange(40)}"]) for i in rng.sample(ids, rng.randrange(1, 5))} for _ in range(6)]
    cases += [{"La/A;": "B", "La/B;": "A"}, {"La/A;": "C", "La/B;": "A"}, {"La/A;": "A"}, {"La/A;": "int"}, {"La/A;-><init>()V": "x"}, {"Lno;": "x"}, {"Lno;->m()V@local:1:x": "z"}]
    kinds = set()
    for entries in cases:
        rows = spark.createDataFrame([(i, a, None) for i, a in entries.items()], renames.ALIASES)
        want = plain_replay(ROWS, entries)
        kinds.add(type(want))
        if isinstance(want, dict):
            assert {r["id"]: r["alias"] for r in renames.adopt(symbols, rows).collect()} == want, entries
        else:
            with pytest.raises(ValueError, match="^" + want.replace("(", r"\(").replace(")", r"\)") + ":"):
                renames.adopt(symbols, rows)
    assert kinds == {str, dict}


def test_replay_of_awkward_entries(spark):
    symbols = spark.createDataFrame(ROWS, SYMBOLS)
    rows = spark.createDataFrame([("La/A;", None), ("La/B;", "x"), ("La/B;", "y"), (None, "z")], "id string, alias string")
    got = {r["id"]: r["error"] for r in renames.replay(symbols, rows).collect()}
    assert got == {"La/A;": "no identifier", "La/B;": "repeated symbol", None: "unknown symbol"}
    assert renames.replay(symbols, rows.limit(0)).count() == 0


def test_single_renames_and_undo(spark, monkeypatch):
    monkeypatch.setattr(renames, "UNDO", 2)
    monkeypatch.setattr(renames, "KEPT", 2)
    history = renames.Renames(spark.createDataFrame(ROWS, SYMBOLS))
    now = lambda: {r["id"]: r["alias"] for r in history.aliases().collect()}
    assert not history.undo()
    for symbol, alias in [("La/A;", "B"), ("La/A;->f:I", "g"), ("La/A;-><init>()V", "x"), ("Lno;", "x"), ("La/A;", "class")]:
        with pytest.raises(ValueError):
            history.rename(symbol, alias)
    history.rename("La/A;->f:I", "h")  # methods have names of their own
    history.rename("La/A;", "C")
    history.rename("La/B;", "A")
    with pytest.raises(ValueError):
        history.rename("La/A;", "A")
    history.rename("La/A;->h()V@local:1:x", "y")
    assert now() == {"La/A;->f:I": "h", "La/A;": "C", "La/B;": "A", "La/A;->h()V@local:1:x": "y"}
    assert history.undo() and history.undo() and not history.undo()
    assert now() == {"La/A;->f:I": "h", "La/A;": "C"}
    history.rename("La/A;", "A")
    assert now() == {"La/A;->f:I": "h"}
    assert history.undo() and now() == {"La/A;->f:I": "h", "La/A;": "C"}


def test_projects(spark, tmp_path):
    symbols = spark.createDataFrame(ROWS, SYMBOLS)
    (tmp_path / "a.bin").write_bytes(b"12")
    inputs = [str(tmp_path / "a.bin")]
    aliases = spark.createDataFrame([("La/A;", "C", "user rename"), ("LTop;", "Bottom", None)], renames.ALIASES)
    renames.save_project(str(tmp_path / "p"), aliases, inputs)
    got = sorted(map(tuple, renames.load_project(str(tmp_path / "p"), symbols, inputs).collect()))
    assert got == [("LTop;", "Bottom", renames.IMPORTED), ("La/A;", "C", "user rename")]
    with pytest.raises(ValueError, match="LTop;: unknown"):
        renames.load_project(str(tmp_path / "p"), symbols.where("id <> 'LTop;'"), inputs)
    (tmp_path / "a.bin").write_bytes(b"123")
    with pytest.raises(ValueError, match="inputs"):
        renames.load_project(str(tmp_path / "p"), symbols, inputs)


def test_project_documents(spark, tmp_path):
    doc = tmp_path / "p.json"
    doc.write_text(json.dumps({"version": 1, "aliases": {"La/A;": "C", "LTop;": "T"}, "renameReasons": {"La/A;": "why"}}, indent=1))
    assert sorted(map(tuple, renames.document_entries(spark, str(doc)).collect())) == [("LTop;", "T", renames.IMPORTED), ("La/A;", "C", "why")]
    doc.write_text("{}")
    with pytest.raises(ValueError):
        renames.document_entries(spark, str(doc))
