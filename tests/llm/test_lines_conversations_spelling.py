"""Operators 11 to 13 against plain versions over whole tables, and on rows with every awkward case."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import conversations, line_dedup, spelling
from quarrylens.llm.common import materialise
from test_operators import LONG, run

SPACE = " \t\n\x0b\x0c\r"
EXTRA = {"line": "c", "word": "c", "pos": 1, "n": 2, "key": "k", "h1": 3, "slice": 4, "mark": 5, "rank": 6}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def with_extra(df):
    """Columns whose names clash with those the operators make."""
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


# --- operator 11


def brute_lines(rows, least=20, docs=3):
    """rows: (doc_id, text); for each (n_lines, n_dropped, kept text). A null id is one document before all others."""
    rank = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[lower(line.strip(SPACE))].add(rank(i))
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(lower(x.strip(SPACE)), rank(i)) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_of(docs):
    rows = line_dedup.with_bitmaps(docs, materialise(line_dedup.bitmaps(docs), "bitmaps"))
    rows = rows.select("doc_id", F.size(line_dedup.split_lines(F.col("text"))), "n_dropped", F.sha2(line_dedup.kept_text(F.col("text"), F.col("words")), 256))
    return sorted(map(tuple, rows.collect()), key=repr)


def test_op11_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = run(spark, "op11", sf_dir)
    assert got["n_dropped"].sum() > 0
    assert sorted(got.itertuples(index=False, name=None), key=repr) == brute_lines(list(zip(docs["doc_id"], docs["text"], strict=True)))


def test_op11_awkward_rows(spark):
    a, b, c = "a line that many documents hold", "exactly twenty chars", "nineteen characters"
    many = "\n".join([a, "own", *[f"line number {k} of the long one" for k in range(500)], b] * 2)
    rows = [(1, None), (2, ""), (3, "\n"), (4, f"{a}\n{b}\n{c}"), (4, f"{a}\n{b}\n{c}"), (4, f"other text\n{a}"), (5, f" {a.upper()}\r\n\t{b}\n{c}\n"), (6, many), (None, f"{a}\n{c}\nx"), (None, b), (7, LONG), (8, f"x\n{a}\ny\n{a}"), (9, "ÉCOLE DES BEAUX-ARTS DE PARIS"), (10, "éCOLE DES BEAUX-ARTS DE PARIS"), (11, "ÉCOLE des beaux-arts de paris"), (12, "école des Beaux-Arts de Paris")]
    rows += [(20 + k, f"{a}\n{c}\nown {k}") for k in range(300)]  # one line in most documents
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    assert lines_of(docs) == brute_lines(rows)
    assert lines_of(docs.where("false")) == []
    other = [("b", a), ("a", a), ("c", a), (None, a)]
    assert lines_of(spark.createDataFrame(other, "doc_id string, text string")) == sorted([(i, 1, int(i != "c"), hashlib.sha256(a.encode() if i == "c" else b"").hexdigest()) for i, _ in other], key=repr)


def test_op11_bitmaps_hold_only_words_with_gaps(spark):
    line = "the line that goes from here"
    rows = [(1, "\n".join(["x"] * 130 + [line])), (2, line), (3, line)]
    got = line_dedup.bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first()
    assert got["n_dropped"] == 1 and [(k["word"], k["bits"]) for k in got["keep"]] == [(2, ~(1 << 2))]


# --- operator 12


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        roll, role, text = crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if roll == 0:
            continue
        text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
        out += [(conv, turn, "user" if roll == 4 else role, text)] * (2 if roll == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits of one conversation's rows, in order: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)."""
    turns = [t for _, t, _, _ in rows if t is not None]
    seen, fault = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    grammar = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after: dict = {}
    for i in range(len(rows), -1, -1):  # from the end, so that whole audits are compared
        now = {}
        for k in range(3, -1, -1):
            for g in range(4):
                options = [(0, "", ())] if i == len(rows) and g in (0, 3) else []
                if k < 3:
                    for r, name in (("u", "user"), ("a", "assistant")):
                        to = grammar[g].get(r)
                        if to is not None and now.get((to, k + 1)):
                            c, w, o = now[to, k + 1]
                            options.append((c + 3, "I" + w, ((name, ""), *o)))
                if i < len(rows):
                    role, text = rows[i][2:]
                    moves = [("D", None, 4, None)]
                    if fault[i] not in ("blank", "duplicate"):
                        extra = 3 * (fault[i] == "truncated")
                        moves += [("K", role[:1], extra, role), ("R", "u", 3 + extra, "user"), ("R", "a", 3 + extra, "assistant")]
                    for label, r, price, name in moves:
                        to = g if r is None else grammar[g].get(r)
                        if to is not None and after.get((to, 0)):
                            c, w, o = after[to, 0]
                            options.append((c + price, label + w, ((name, text), *o) if name else o))
                now[g, k] = min(options, key=lambda x: x[:2]) if options else None
        after = now
    cost, audit, out = after[0, 0]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def brute_conversations(rows):
    groups = {conv: [] for conv, *_ in rows}
    for r in brute_damage(rows):
        groups[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    return sorted(((c, *brute_repair(sorted(g, key=order))) for c, g in groups.items()), key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def op12(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, conversations.op12_conversations(spark, str(tmp_path)).select(COLUMNS).collect()), key=repr)


def test_op12_whole_table(spark, sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    got = run(spark, "op12", sf_dir)[COLUMNS]
    assert got["cost"].sum() > 0
    assert sorted(got.itertuples(index=False, name=None), key=repr) == brute_conversations(list(rows.itertuples(index=False, name=None)))


def test_op12_awkward_and_long_conversations(spark, tmp_path, monkeypatch):
    dice = random.Random(5)
    say = lambda: dice.choice(["Yes.", "No", "", " \t", "Why?", "Well!", "Hm. ", None, "é.", "x\ny."])
    rows = [(1, None, "user", "a."), (1, None, "assistant", "b."), (1, 5, None, None), (2, 3, "tool", "x."), (2, 3, "", "y."), (2, 3, "User", "z."), (None, 0, "user", "q?"), (None, 1, "assistant", "r."), (3, 0, "user", LONG), (3, 1, "assistant", LONG + ".")]
    rows += [(4, 0, "user", "same."), (4, 0, "user", "same."), (4, 1, "assistant", "same.")]
    rows += [(10 + c, t, dice.choice(["user", "assistant", "system", "user", "assistant", "tool"]), say()) for c in range(150) for t in range(dice.randrange(1, 7))]
    rows += [(500, t, dice.choice(["user", "assistant"]), f"turn {t}" + dice.choice([".", ""])) for t in range(700)]  # one conversation with most rows
    expected = brute_conversations(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in (EXTRA | {"part": 1, "audit": "x", "cost": 2}).items()})
    assert op12(spark, df, tmp_path) == expected
    monkeypatch.setattr(conversations, "BLOCK", 4)
    monkeypatch.setattr(conversations, "FAN", 2)
    assert op12(spark, df, tmp_path) == expected
    assert op12(spark, df.where("false"), tmp_path) == []


def test_op12_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (2, 0, "system", "Rules."), (2, 1, "assistant", "Yes."), (3, 0, "user", " ")]
    turns = materialise(conversations.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "turns")
    plans = materialise(conversations.plan(conversations.faults(turns)), "plans")
    got = conversations.repair(turns, plans).orderBy("conv_id", "place").collect()
    by = {c: "".join(r["role"][0] for r in got if r["conv_id"] == c) for c in (1, 2, 3)}
    assert all(re.fullmatch("(s?(ua)+)?", v) for v in by.values()) and by[3] == "" and by[2] == "sua"
    assert [tuple(r)[1:] for r in got if r["conv_id"] == 2] == [(0, "K", "system", "Rules."), (1, "I", "user", ""), (2, "K", "assistant", "Yes.")]


# --- operator 13


def brute_spelling(rows, plant=True, least=6, often=5):
    n = Counter()
    for i, t in rows:
        for word in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = crc32(f"{'' if i is None else i}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if plant and h % 199 == 0 else word] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    groups, near = defaultdict(list), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            groups[i, w[:i], w[i + 1 :]].append(w)
            if (d := w[:i] + w[i + 1 :]) in n:
                near[w].add(d), near[d].add(w)
    for g in groups.values():
        for w in g:
            near[w] |= set(g) - {w}
    form = {w: v for w in n if near[w] and n[v := min(near[w], key=lambda x: (-n[x], x))] >= 5 * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=repr)


COLUMNS_13 = ["word", "form", "root", "n", "n_near", "form_n"]


def test_op13_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = spelling.op13_spelling(spark, sf_dir).select(COLUMNS_13).collect()
    assert any(r["form"] for r in got)
    assert sorted(map(tuple, got), key=repr) == brute_spelling(list(zip(docs["doc_id"], docs["text"], strict=True)))


def test_op13_awkward_rows_and_chains(spark):
    times = {"letters": 125 * 6, "lettters": 130, "letteers": 20, "leters": 20, "lettrs": 147, "lettrsx": 24, "lettrrs": 25, "aaaaaaa": 40, "aaaaaaaa": 8, "aaaaaa": 7, "Éclairs": 50, "éclairs": 9, "abcdef×": 5, "abcdefg": 25, "short": 99, "abcdeg": 25, "abcdefh": 5}
    rows = [(k, f"{w}. {w.upper() if w.isascii() else w},{w}" if m >= 3 else w) for w, m in times.items() for k in range(m // 3)]
    rows += [(1, w) for w, m in times.items() for _ in range(m % 3)]
    big = "".join(chr(97 + k * k % 26) for k in range(900))  # a run of 900 letters and one with a letter replaced
    rows += [(None, None), (2, ""), (3, "12 34"), (4, LONG), (None, "letters letters")] + [(9, big)] * 25 + [(9, big[:450] + "é" + big[451:])] * 5 + [(9, big[:-1])] * 5
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = lambda d: sorted(map(tuple, spelling.variants(materialise(spelling.vocabulary(spelling.runs(d)), "vocabulary")).select(COLUMNS_13).collect()), key=repr)
    expected = brute_spelling(rows, plant=False)
    assert max(len(w) for w, *_ in expected) == 900 and any(r[1] and r[2] != r[1] for r in expected)
    assert plain(docs) == expected
    planted = spelling.variants(materialise(spelling.vocabulary(spelling.misspelt(spelling.runs(docs))), "vocabulary"))
    assert sorted(map(tuple, planted.select(COLUMNS_13).collect()), key=repr) == brute_spelling(rows)
    assert plain(docs.where("false")) == []


@pytest.mark.parametrize("text,words", [("Zürich×Basel", ["zürich×basel"]), ("don't_worry4ever", []), ("ABCDEF abcdefÉ", ["abcdef", "abcdefÉ"])])
def test_op13_runs(spark, text, words):
    got = [r["word"] for r in spelling.runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got == words
