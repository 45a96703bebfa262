"""Masks, unflattening, folding, call sites and canonical references against plain versions."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text as texts
from quarrylens.operators import callsites, dataflow, folding, graph, lookups, method_arrays, references, unflatten, xrefs
from quarrylens.plans import catalog, programs


def mask_lines(text: str, code: bool, comments: bool) -> str:
    """text with the characters of the unwanted scope blanked, line by line: // and /* */ comments, quoted strings."""
    if code and comments:
        return text
    out, block = [], False
    for line in text.split("\n"):
        kept, quote, n = list(line), "", 0
        while n < len(line):
            two = line[n : n + 2]
            if block:
                width = 2 if two == "*/" else 1
                block = two != "*/"
                if not comments:
                    kept[n : n + width] = " " * width
                n += width
            elif quote:
                width = 2 if line[n] == "\\" and n + 1 < len(line) else 1
                quote = "" if line[n] == quote else quote
                if not code:
                    kept[n : n + width] = " " * width
                n += width
            elif two == "//":
                if not comments:
                    kept[n:] = " " * (len(line) - n)
                break
            elif two == "/*":
                block = True
                if not comments:
                    kept[n] = " "
                n += 1
            else:
                quote = line[n] if line[n] in "\"'" else ""
                if not code:
                    kept[n] = " "
                n += 1
        out.append("".join(kept))
    return "\n".join(out)



def mask_text(text: str, smali: bool) -> str:
    """Comments, strings and characters blanked over a whole text."""
    out, n = list(text), 0
    while n < len(text):
        start = n
        if text[n] == "#" if smali else text.startswith("//", n):
            while n < len(text) and text[n] != "\n":
                n += 1
        elif not smali and text.startswith("/*", n):
            end = text.find("*/", n + 2)
            n = len(text) if end < 0 else end + 2
        elif text[n] in "\"'":
            quote, n = text[n], n + 1
            while n < len(text):
                if text[n] == "\\":
                    n = min(len(text), n + 2)
                    continue
                n += 1
                if text[n - 1] == quote:
                    break
        else:
            n += 1
            continue
        out[start:n] = ["\n" if c == "\n" else " " for c in text[start:n]]
    return "".join(out)


def test_masks_of_random_texts(spark):
    dice = random.Random(11)
    parts = ["//", "/*", "*/", "/*/", '"', "'", "\\", "\n", "a", " ", "#", "*", "/", "é", "\U0001f600", "{", "}", "x y"]
    cases = ["".join(dice.choice(parts) for _ in range(dice.randrange(25))) for _ in range(3000)] + ["", '"' + "\\n" * 50_000 + '"//x', "/*" + "a\n" * 50_000, "'" * 3001, "/" * 20_001]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    got = df.select("id", texts.masked(F.col("t"), True, False).alias("code"), texts.masked(F.col("t"), False, True).alias("comments"), texts.masked(F.col("t"), False, False).alias("none"), texts.code_mask(F.col("t")).alias("java"), texts.code_mask(F.col("t"), True).alias("smali"))
    for r in got.collect():
        t = cases[r["id"]]
        assert (r["code"], r["comments"], r["none"]) == tuple(mask_lines(t, c, m) for c, m in ((True, False), (False, True), (False, False))), repr(t[:80])
        assert (r["java"], r["smali"]) == (mask_text(t, False), mask_text(t, True)), repr(t[:80])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_braced(spark):
    cases = [("void f() { a; { b } } rest", 0, "void f() { a; { b } }"), ("f() { s = \"}\"; /* } */ } x", 0, "f() { s = \"}\"; /* } */ }"), ("a { b", 0, None), ("} {", 0, None), ("x {1} y {2}", 5, " y {2}"), ("no braces", 0, None)]
    df = spark.createDataFrame([(k, t, a) for k, (t, a, _) in enumerate(cases)], "k int, t string, a int")
    assert [r["b"] for r in df.select("k", texts.braced(F.col("t"), F.col("a")).alias("b")).orderBy("k").collect()] == [c[2] for c in cases]


def test_printable(spark):
    got = spark.createDataFrame([("a\u200bb\tc\U000e0001é",)], "t string").select(texts.printable(F.col("t"))).first()[0]
    assert got == "a[U+200B]b[U+0009]c[U+E0001]é"


# --- unflattening


def take(arms, value):
    tests = {"eq": lambda o: value == o, "ne": lambda o: value != o, "lt": lambda o: value < o, "ge": lambda o: value >= o, "gt": lambda o: value > o, "le": lambda o: value <= o, "else": lambda o: True}
    return next((target for _, op, operand, target in sorted(arms, key=lambda a: a[0]) if tests[op](operand)), None)


def plain_unflatten(edges, effects, arms, entry):
    """One method: edges {(src, dst)}, effects {(block, slot): value}, arms {block: (slot, [(rank, op, operand, target)])}."""
    moved, edges, arms = set(), set(edges), dict(arms)
    while True:
        states, slots = set(), {s for s, _ in arms.values()}
        todo = [(s, entry, None) for s in slots]
        while todo:
            state = todo.pop()
            if state in states:
                continue
            states.add(state)
            slot, block, value = state
            value = effects.get((block, slot), value) if (block, slot) in effects else value
            if block in arms and arms[block][0] == slot and value is not None:
                nexts = [x for x in [take(arms[block][1], value)] if x is not None]
            else:
                nexts = [d for s, d in edges if s == block] + [a[3] for a in arms.get(block, (0, []))[1]]
            todo += [(slot, n, value) for n in nexts]
        new, fresh = set(), set()
        for src, dst in edges:
            to = dst
            if dst in arms:
                slot = arms[dst][0]
                ends = {effects[src, slot] if (src, slot) in effects else v for s, b, v in states if (s, b) == (slot, src)}
                targets = {take(arms[dst][1], v) if v is not None else None for v in ends}
                if len(targets) == 1 and None not in targets and targets != {dst}:
                    to = targets.pop()
                    fresh.add((src, to))
            new.add((src, to))
        for block, (slot, rows) in list(arms.items()):
            targets = {take(rows, v) if v is not None else None for s, b, v in states if (s, b) == (slot, block)}
            if len(targets) == 1 and None not in targets:
                new.add((block, targets.pop()))
                del arms[block]
        moved, edges = moved | fresh, new
        if not fresh:
            break
    left = {(s, d, "redirected" if (s, d) in moved else "jump") for s, d in edges} | {(b, a[3], "arm") for b, (_, rows) in arms.items() for a in rows}
    live, todo = set(), [entry]
    while todo:
        if (b := todo.pop()) not in live:
            live.add(b)
            todo += [d for s, d, _ in left if s == b]
    return {x for x in left if x[0] in live}


def test_unflattening_of_random_methods(spark):
    dice, methods = random.Random(2), {}
    for m in range(40):
        blocks, hubs = list(range(2, 3 + m % 12)), [100, 101] if m % 3 else [100]
        arms = {h: (h % 2 if m % 4 == 0 else 0, [(k, dice.choice(["eq", "eq", "lt", "ne", "ge"]), dice.randrange(6), dice.choice(blocks + (hubs if m % 5 == 0 else []))) for k in range(4)] + [(9, "else", None, 1)]) for h in hubs}
        edges = {(0, dice.choice(hubs))} | {(b, dice.choice(hubs + blocks)) for b in blocks} | {(b, dice.choice(hubs)) for b in blocks if dice.random() < 0.3}
        effects = {(b, s): dice.choice([0, 1, 2, 3, 4, 5, None]) for b in [0, *blocks] for s in (0, 1) if dice.random() < 0.7}
        methods[m] = (edges, effects, arms)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = table([(m, s, d) for m, (e, _, _) in methods.items() for s, d in e], "method long, src long, dst long")
    effects = table([(m, b, s, v) for m, (_, e, _) in methods.items() for (b, s), v in e.items()], "method long, block long, slot int, value long")
    arms = table([(m, b, slot, *row) for m, (_, _, a) in methods.items() for b, (slot, rows) in a.items() for row in rows], "method long, block long, slot int, rank int, op string, operand long, target long")
    entries = table([(m, 0) for m in methods], "method long, block long")
    got: dict = {m: set() for m in methods}
    for r in unflatten.unflattened(edges, effects, arms, entries).collect():
        got[r["method"]].add((r["src"], r["dst"], r["kind"]))
    for m, (e, f, a) in methods.items():
        assert got[m] == plain_unflatten(e, f, a, 0), m
    assert any(k == "redirected" for s in got.values() for *_, k in s)


def test_a_round_of_unflattening_joins_each_hop_once(spark, monkeypatch):
    plans, write = [], unflatten.materialise

    def spied(df, tag):
        if tag == "states":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(unflatten, "materialise", spied)
    edges = spark.createDataFrame([(1, 0, 100), (1, 2, 100)], "method long, src long, dst long")
    effects = spark.createDataFrame([(1, 0, 0, 5)], "method long, block long, slot int, value long")
    arms = spark.createDataFrame([(1, 100, 0, 0, "eq", 5, 2), (1, 100, 0, 9, "else", None, 1)], "method long, block long, slot int, rank int, op string, operand long, target long")
    got = unflatten.unflattened(edges, effects, arms, spark.createDataFrame([(1, 0)], "method long, block long"))
    assert {(r["src"], r["dst"], r["kind"]) for r in got.collect()} == {(0, 2, "redirected"), (2, 2, "redirected")}
    # Each hop looks at what led to it; the found states are taken away from each hop's.
    assert max(p.count("Join ") for p in plans) <= unflatten.HOPS * (unflatten.HOPS + 1) // 2 + unflatten.HOPS


def random_methods(dice, n):
    methods = {}
    for m in range(n):
        blocks, hubs = list(range(2, 3 + m % 12)), [100, 101] if m % 3 else [100]
        arms = {h: (h % 2 if m % 4 == 0 else 0, [(k, dice.choice(["eq", "eq", "lt", "ne", "ge", "gt", "le"]), dice.choice([None, *range(6)]), dice.choice(blocks + (hubs if m % 5 == 0 else []))) for k in range(4)] + ([(9, "else", None, 1)] if m % 7 else [])) for h in hubs}
        edges = {(0, dice.choice(hubs))} | {(b, dice.choice(hubs + blocks)) for b in blocks} | {(b, dice.choice(hubs)) for b in blocks if dice.random() < 0.3}
        effects = {(b, s): dice.choice([0, 1, 2, 3, 4, 5, None]) for b in [0, *blocks] for s in (0, 1, 2) if dice.random() < 0.7}
        methods[m] = (edges, effects, {} if m % 11 == 10 else arms)
    return methods


def method_tables(spark, methods):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = table([(m, s, d) for m, (e, _, _) in methods.items() for s, d in e], "method long, src long, dst long")
    effects = table([(m, b, s, v) for m, (_, e, _) in methods.items() for (b, s), v in e.items()], "method long, block long, slot int, value long")
    arms = table([(m, b, slot, *row) for m, (_, _, a) in methods.items() for b, (slot, rows) in a.items() for row in rows], "method long, block long, slot int, rank int, op string, operand long, target long")
    return edges, effects, arms, table([(m, 0) for m in methods], "method long, block long")


def without_operand(monkeypatch):
    """Plain arms without an operand hold for nothing but else."""
    monkeypatch.setitem(globals(), "take", lambda arms, value, f=take: f([a for a in arms if a[1] == "else" or a[2] is not None], value))


def test_unflattening_of_whole_methods_in_tasks(spark, monkeypatch):
    """Small methods in tasks, as the plain version; large ones are handed on whole to the joins (tested above). Names instead of numbers too."""
    without_operand(monkeypatch)
    methods = random_methods(random.Random(8), 60)
    want = {(m, *x) for m, (e, f, a) in methods.items() for x in plain_unflatten(e, f, a, 0)}
    tables, handed = method_tables(spark, methods), []

    def joins(edges, effects, arms, entries, passes):
        handed.append({r[0] for r in entries.collect()})
        assert [x.where(~F.col("method").isin(*handed[-1])).count() for x in (edges, effects, arms)] == [0, 0, 0]
        assert edges.count() == sum(len(methods[m][0]) for m in handed[-1])
        return edges.select("method", "src", "dst", F.lit("large").alias("kind"))

    monkeypatch.setattr(unflatten, "unflattened", joins)
    rows = [tuple(r) for r in unflatten.unflattened_methods(*tables).collect()]
    assert sorted(rows) == sorted(want) and any(k == "redirected" for *_, k in rows) and not handed
    monkeypatch.setattr(unflatten, "STATES", 300)
    rows = [tuple(r) for r in unflatten.unflattened_methods(*tables).collect()]
    assert 0 < len(handed[0]) < 60 and {r for r in rows if r[3] != "large"} == {r for r in want if r[0] not in handed[0]}
    monkeypatch.setattr(unflatten, "STATES", 1 << 26)
    named = [x.select(*[F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) if c in ("method", "src", "dst", "block", "target") else F.col(c) for c in x.columns]) for x in tables]
    assert {tuple(r) for r in unflatten.unflattened_methods(*named).collect()} == {(f"n{m}", f"n{s}", f"n{d}", k) for m, s, d, k in want}


def test_methods_stay_whole_over_batches(monkeypatch):
    """Batches end within methods, and parts of a task's rows have more possible states than fit at once."""
    without_operand(monkeypatch)
    monkeypatch.setattr(method_arrays, "CHUNK", 100)
    methods = random_methods(random.Random(8), 60)
    rows = []
    for m, (edges, effects, arms) in methods.items():
        rows += [(m, 0, s, d, None, None, None, None) for s, d in edges] + [(m, 1, b, None, s, None, None, v) for (b, s), v in effects.items()] + [(m, 3, 0, None, None, None, None, None)]
        rows += [(m, 2, b, t, slot, rank, method_arrays.OPS.index(op), v) for b, (slot, own) in arms.items() for rank, op, v, t in own]
    schema = pa.schema([("method", pa.int64()), ("part", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("slot", pa.int32()), ("rank", pa.int32()), ("op", pa.int8()), ("value", pa.int64())])
    batches = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema).to_batches(max_chunksize=7)
    for states in (1 << 26, 500):
        out = [(r["method"], r["src"], r["dst"], method_arrays.KINDS[r["kind"]]) for b in method_arrays.stream(iter(batches), states, 64) for r in b.to_pylist()]
        assert sorted(out) == sorted((m, *x) for m, (e, f, a) in methods.items() for x in plain_unflatten(e, f, a, 0))
    with pytest.raises(RuntimeError):
        list(method_arrays.stream(iter(batches), 1 << 26, 1))


def test_unflatten_deals_methods_out_once(spark, sf_dir, monkeypatch):
    """The registered query writes its lines and the list of large methods; no table a step, no join."""
    written = []
    for module in (programs, unflatten):
        monkeypatch.setattr(module, "materialise", lambda df, tag, write=module.materialise: written.append(tag) or write(df, tag))
    rows = catalog.QUERIES["unflatten"](spark, sf_dir)
    assert written == ["lines", "large"] and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


# --- folding


def test_folding_of_deep_expressions_and_errors(spark):
    x = [("s", "string", "hello", None), ("t", "string", "l", None), ("u", "string", "", None), ("n", "string", "né", None), ("one", "int", None, 1), ("three", "int", None, 3), ("nine", "int", None, 9), ("c", "char", None, 108), ("d", "char", None, 76), ("zero", "char", None, 0), ("z", "string", "z" * 40_000, None), ("nul", "string", None, None)]
    ops = {"a": ("concat", "s", "t"), "b": ("concat", "a", "a"), "e": ("substring", "b", "one", "three"), "f": ("replace", "b", "c", "d"), "g": ("replace", "b", "t", "s"), "h": ("chars", "c", "d", "c"), "i": ("concat", "f", "h"), "j": ("substring", "i", "three"), "k": ("substring", "s", "three", "one"), "l": ("substring", "s", "nine"), "m": ("replace", "s", "u", "t"), "o": ("concat", "s", "n"), "p": ("concat", "z", "z"), "q": ("chars", "c", "zero"), "r": ("concat", "p", "s"), "v": ("concat", "missing", "s"), "w": ("concat", "z", "s"), "y": ("replace", "w", "c", "d"), "aa": ("substring", "y", "one"), "ab": ("concat", "s", "one"), "ac": ("concat", "s", "nul"), "loop": ("concat", "loop", "s")}
    exprs = spark.createDataFrame([*x, *((k, v[0], None, None) for k, v in ops.items())], "id string, op string, text string, number long")
    args = spark.createDataFrame([(k, n, a) for k, v in ops.items() for n, a in enumerate(v[1:])], "id string, place int, operand string")
    got = {r["id"]: (r["text"], r["error"]) for r in folding.folded(exprs, args).collect() if r["id"] in ops}
    b = "hellol" * 2
    text = {"a": "hellol", "b": b, "e": b[1:3], "f": b.replace("l", "L"), "g": b.replace("l", "hello"), "h": "lLl", "i": b.replace("l", "L") + "lLl", "j": (b.replace("l", "L") + "lLl")[3:], "w": "z" * 40_000 + "hello"}
    bad = {"k": "operands do not fit", "l": "operands do not fit", "m": "operands do not fit", "p": "longer than 65536", "q": "operands do not fit", "ab": "operands do not fit", "y": "budget of 100000 spent"}
    assert got == {k: (v, None) for k, v in text.items()} | {k: (None, e) for k, e in bad.items()}
    assert folding.folded(exprs.where("false"), args.where("false")).count() == 0


def test_folding_broadcasts_no_texts_by_the_size_of_their_files(spark, monkeypatch):
    """Doubled texts take little room in files and much in memory; the driver must not gather them."""
    plans, write = [], folding.materialise

    def spied(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(folding, "materialise", spied)
    monkeypatch.setattr(folding, "FEW_ROWS", 0, raising=False)
    n = 12
    exprs = spark.createDataFrame([(0, "string", "ab", None)] + [(k, "concat", None, None) for k in range(1, n)], "id long, op string, text string, number long")
    args = spark.createDataFrame([(k, p, k - 1) for k in range(1, n) for p in (0, 1)], "id long, place int, operand long")
    got = {r["id"]: r["text"] for r in folding.folded(exprs, args).collect()}
    assert got == {k: "ab" * 2**k for k in range(n)}
    assert not [p for p in plans if "Broadcast" in p]


# --- call sites, references


def test_call_sites(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    values = t([(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 13), (2, 1, 10), (3, 0, 13), (3, 1, None), (5, 0, 12)], "site long, place int, handle long")
    handles = t([(10, 5, 100), (11, 4, 101), (12, 8, 101), (13, 0, 100), (14, 5, 999)], "handle long, kind int, method long")
    methods, sites = t([(100,), (101,)], "method long"), t([(1,), (2,), (3,), (4,), (5,), (5,)], "site long")
    found = callsites.resolve_call_sites(sites, values, handles, methods, t([(101,)], "method long"))
    assert sorted(map(tuple, found.collect())) == [(1, "101", "lambda"), (2, "100", "handle"), (3, "invoke-custom@3", "placeholder"), (4, "invoke-custom@4", "placeholder"), (5, "101", "lambda")]
    edges = callsites.call_edges(t([("f", 1), ("f", 5), ("g", 4)], "caller string, site long"), found)
    assert sorted(map(tuple, edges.collect())) == [("f", "101"), ("g", "invoke-custom@4")]


def test_canonical_references(spark):
    up = spark.createDataFrame([("p/D", "p/C", 1), ("p/C", "p/B", 1), ("p/C", "p/I", 2), ("p/B", "p/A", 1), ("p/I", "p/A", 1)], "child string, parent string, ordinal int")
    symbols = spark.createDataFrame([("p/A", "m()V"), ("p/I", "k()V"), ("p/B", "k()V"), ("p/D", "own()V"), ("p/D", "x:I"), ("p/A", "<init>()V")], "owner string, suffix string")
    rows = [
        ("p/D", "Lp/D;->own()V", "Lp/D;->m()V", 4, "bytecode"),
        ("p/D", "Lp/D;->own()V", "Lp/C;->m()V", 4, "bytecode"),  # the same declaration at the same offset
        ("p/D", "Lp/D;->own()V", "Lp/A;->m()V", 8, "bytecode"),
        ("p/D", "Lp/D;->own()V", "Lp/D;->k()V", 9, "bytecode"),  # two ancestors at one distance: the first declared
        ("p/D", "Lp/D;->own()V", "Lp/D;-><init>()V", 10, "bytecode"),  # constructors are not inherited
        ("p/D", "Lp/D;->own()V", "Lp/A;", 11, "bytecode"),
        ("p/D", "Lp/D;->own()V", "Lq/Z;->m()V", 12, ""),
        ("p/D", "Lp/D;->own()V", "Lp/D;->x:I", 13, "annotation"),
        ("p/D", "Lp/D;->m()V", "Lp/D;->x:I", 1, "bytecode"),  # a caller under an inherited name
        ("p/D", "Lp/D;->own()V", "Lp/D;->m@local:1", 2, "bytecode"),
        ("p/D", "Lp/D;->own()V", "", 3, "bytecode"),
    ]
    refs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "class string, from string, target string, offset int, kind string, place int")
    moved = xrefs.canonical_names(refs, symbols, up)
    assert {r["id"]: r["canonical"] for r in moved.collect()} == {"Lp/D;->m()V": "Lp/A;->m()V", "Lp/C;->m()V": "Lp/A;->m()V", "Lp/D;->k()V": "Lp/B;->k()V"}
    index = xrefs.reference_index(refs, moved)
    by: dict = {}
    for r in xrefs.xrefs(index).collect():
        by.setdefault(r["about"], set()).add((r["target"], r["offset"]))
    assert by["Lp/A;->m()V"] == {("Lp/D;->m()V", 4), ("Lp/A;->m()V", 8)}
    assert by["Lp/A;"] == {("Lp/D;->m()V", 4), ("Lp/A;->m()V", 8), ("Lp/A;", 11)}
    assert by["Lp/B;->k()V"] == {("Lp/D;->k()V", 9)} and by["Lp/D;-><init>()V"] == {("Lp/D;-><init>()V", 10)}
    asked = xrefs.xrefs(index, spark.createDataFrame([("Lp/C;->m()V",)], "id string"), moved)
    assert {(r["id"], r["about"], r["offset"]) for r in asked.collect()} == {("Lp/C;->m()V", "Lp/A;->m()V", 4), ("Lp/C;->m()V", "Lp/A;->m()V", 8)}
    called = xrefs.callees_by_member(refs, spark.createDataFrame([("Lp/D;->own()V",), ("Lp/D;->m()V",), ("Lp/D;",)], "id string"), moved)
    assert {tuple(r) for r in called.collect()} == {("Lp/D;->own()V", "Lp/A;->m()V", 4), ("Lp/D;->own()V", "Lp/A;->m()V", 8), ("Lp/D;->own()V", "Lp/B;->k()V", 9), ("Lp/D;->own()V", "Lp/D;-><init>()V", 10), ("Lp/D;->own()V", "Lq/Z;->m()V", 12), ("Lp/D;->own()V", "Lp/D;->m@local:1", 2), ("Lp/D;->m()V", "Lp/D;->x:I", 1)}


def test_callees_under_other_names_and_few_exchanges(spark, monkeypatch):
    up = spark.createDataFrame([("p/D", "p/C", 1), ("p/C", "p/A", 1), ("p/A", "p/Z", 1)], "child string, parent string, ordinal int")
    symbols = spark.createDataFrame([("p/A", "m()V"), ("p/Z", "k()V")], "owner string, suffix string")
    rows = [
        ("p/D", "Lp/D;->m()V", "Lp/D;->k()V", 1, "bytecode"),
        ("p/D", "Lp/A;->m()V", "Lp/C;->k()V", 1, "bytecode"),  # the same caller under its ancestor's name, the same callee and offset
        ("p/D", "Lp/A;->m()V", "Lp/C;->k()V", 2, "bytecode"),
        ("p/A", "Lp/A;->m()V", "Lp/C;->m()V", 3, "bytecode"),
        ("p/C", "Lp/C;->q()V", "Lp/C;->k()V", 4, "bytecode"),
        ("p/C", "Lp/C;->q()V", "Lp/A;->k()V", 4, "bytecode"),
    ]
    refs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "class string, from string, target string, offset int, kind string, place int")
    wrote, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: wrote.append(tag) or write(df, tag))
    moved = xrefs.canonical_names(refs, symbols, up)
    # A level of the closure is written once.
    assert wrote.count("closure") == 1
    ask = lambda rows, *ids: xrefs.callees_by_member(rows, spark.createDataFrame([(x,) for x in ids], "id string"), moved)
    got = ask(refs, "Lp/D;->m()V", "Lp/D;xx->m()V", "Lp/A;->m()V", "Lp/C;->q()V", "Lp/D;")
    k = "Lp/Z;->k()V"
    assert sorted(map(tuple, got.collect())) == [("Lp/A;->m()V", "Lp/A;->m()V", 3), ("Lp/C;->q()V", k, 4), ("Lp/D;->m()V", k, 1), ("Lp/D;->m()V", k, 2)]
    own = ask(refs.where("class = 'p/C'"), "Lp/C;->q()V")
    assert [tuple(r) for r in own.collect()] == [("Lp/C;->q()V", k, 4)]
    # Callers of their own class: one exchange of the references besides that of the lookup, one of the ids.
    assert own._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2


# --- dataflow over small methods


def test_blocks_dominated_closure_intervals_and_phis(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    code = t([("m", 0, True, False), ("m", 1, False, True), ("m", 2, False, False), ("m", 3, True, True), ("m", 4, False, False), ("n", 0, True, True)], "method string, pc int, is_leader boolean, ends_block boolean")
    spans = dataflow.blocks_of(code)
    assert sorted(map(tuple, spans.collect())) == [("m", 0, 0, 1), ("m", 1, 2, 2), ("m", 2, 3, 3), ("m", 3, 4, 4), ("n", 0, 0, 0)]

    idoms = t([(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 3), (2, 0, None)], "method long, block long, idom long")
    below = {(b, d) for _, b, d in map(tuple, dataflow.dominated(idoms).collect())}
    assert below == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (3, 4)}

    live = t([("m", 0, 7), ("m", 2, 7), ("m", 1, 8), ("n", 0, 7)], "method string, block long, slot long")
    assert sorted(map(tuple, dataflow.intervals(live, spans).collect())) == [("m", 7, 0, 3), ("m", 8, 2, 2), ("n", 7, 0, 0)]

    # A diamond with a loop back: both arms define slot 1, which the join uses; slot 2 is dead there.
    edges = t([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 0), (1, 3, 4)], "method long, src long, dst long")
    facts = t([(1, 1, 1, "def"), (1, 2, 1, "def"), (1, 3, 1, "use"), (1, 1, 2, "def")], "method long, block long, slot long, kind string")
    found = dataflow.phis(dataflow.frontiers(edges), dataflow.liveness(edges, facts), facts)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 1)]


def test_strong_components_behind_a_chain(spark):
    chain = [(k, k + 1) for k in range(12)] + [(12, 13), (13, 14), (14, 12), (14, 20), (30, 31), (31, 30)]
    edges = spark.createDataFrame(chain, "src_id long, dst_id long")
    assert {tuple(r) for r in graph.strong_components(edges).collect()} == {(12, 12), (13, 12), (14, 12), (30, 30), (31, 30)}
    with pytest.raises(RuntimeError, match="did not settle"):
        graph.strong_components(edges, rounds=3)


def test_smallest_owner_and_running_totals(spark):
    hits = spark.createDataFrame([(5, 10, "a"), (5, 4, "b"), (6, 4, "b")], "pc int, width int, owner string")
    assert sorted(map(tuple, lookups.smallest_owner(hits, ["pc"], ["width", "owner"], "owner").collect())) == [(5, "b"), (6, "b")]
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = graph.running_total(rows, ["id"], "v", "total").orderBy("id").collect()
    assert [r["total"] for r in got] == list(itertools.accumulate(k % 7 for k in range(1000)))


def test_counts_of_aliases_stay_free_of_taken_numbers(spark):
    ids = [f"Lp/C{k};" for k in range(6)] + [f"Lp/C;->f{k}:I" for k in range(5)]
    rows = [(i, "a") for i in ids] + [("Lx;", "Class_2"), ("Ly;", "Class_3"), ("Lz;", "Class_7"), ("Lq;", "field_1"), ("Lr;", "method_1"), ("Ls;", "Class_02")]
    got = references.deobfuscate(spark.createDataFrame(rows, "id string, name string"), spark.createDataFrame([], "id string, alias string"))
    alias = {r["id"]: r["alias"] for r in got.collect()}
    assert [alias[i] for i in ids] == ["Class_1", "Class_4", "Class_5", "Class_6", "Class_8", "Class_9", "field_2", "field_3", "field_4", "field_5", "field_6"]


def test_phis_go_through_the_methods_once(spark):
    """Frontiers and liveness are worked out once, however many rounds the places take."""
    rows = [(1, b, 0, True, True) for b in range(6)]
    live = spark.createDataFrame(rows, "method long, block long, slot long, live_in boolean, live_out boolean").coalesce(1)
    front = spark.createDataFrame([(1, b, b + 1) for b in range(5)], "method long, block long, frontier long").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    counting = [df.mapInPandas(counted, df.schema) for df in (front, live)]
    found = dataflow.phis(*counting, spark.createDataFrame([(1, 0, 0, "def")], "method long, block long, slot long, kind string"))
    assert sorted(r["block"] for r in found.collect()) == [1, 2, 3, 4, 5]
    assert seen.value == len(rows) + 5
