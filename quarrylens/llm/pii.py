"""Personal data and secrets on DataFrame functions alone: base patterns, high-recall candidates, boosted trees, calibrated thresholds.

Base spans (kinds email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns that pass their checks;
they always count. Loose generators propose further, overlapping spans, also of the kind secret (long tokens with a digit). Each proposal
has a handful of discrete format and context features. Its label comes from what the features don't show and the base patterns can't see: a mail address
whose last part is a known top-level domain once (at), [dot] and spaces are written out, an address whose four parts are in range, a checksum over the digits however
they are grouped, a telephone number named as one or with a leading plus, a secret to which a name such as token or password is set. Counting the
proposals of all documents by their features gives a table of bounded size (LEVELS), on which boosted two-level trees are fitted. Every
kind has its own threshold: the lowest score from which PRECISION of the proposals are labelled 1, counted on a fifth of the texts that the
trees have not seen (on all where that fifth has less than FEW of the label). Trees and thresholds go back into the query as an
expression; proposals that reach theirs, touch no base span (a secret may) and lose to no better overlapping proposal are added.

Positions come from the text between matches (split) and the matches themselves, both in code points.

Defined cases: null text is empty and has no span; repeated rows are scanned one by one; a document without any match keeps its row;
other columns are kept, under whatever names, but for base_spans and pii_spans, which with_spans sets anew.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.llm.common import table

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
# The base patterns, written so that a scan is linear: possessive repeats, and starts only where a run of the first
# class starts or the last match ended. They match what the plain patterns match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
# High-recall generators and the kind each proposes.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?(?:@|\(at\)|\[at\])\s?[a-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[a-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\s?[.]\s?[0-9]{1,3}+){3}+",
    "card": r"[0-9]{2,8}+(?:[\x20./_-]{0,2}[0-9]{2,8}+)++",
    "phone": r"(?:\+|00|\()?[0-9]{1,4}+(?:[\x20().\-/]{1,3}[0-9]{2,5}+){2,}+",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
}
#: Feature names with their numbers of levels; their product bounds the table the trees are fitted on.
LEVELS = {"kind": 5, "digits": 8, "sep": 6, "left": 5, "right": 5, "cue": 2, "groups": 5, "letters": 4, "form": 3}
ROUNDS, RATE, PRECISION, FEW = 30, 0.3, 0.95, 20
# Top-level domains that make a written-out mail address one.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|co|eu|de|fr|es|it|pt|nl|be|at|ch|uk|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|ru|pl|cz|se|no|fi|dk"
CUE = r"(?i)(?:mail|contact|tel|phone|call|fax|mobil|card|visa|iban|host|server|addr)[^\n]{0,12}\z"
SET_TO = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|private[_-]?key|auth|credentials?)[\"']?\s*(?:=|:|=>|:=)\s*[\"']?\z"
#: What names a telephone number; it labels numbers without a plus, and is no feature of them.
CALLED = r"(?i)(?:tel|phone|call|fax|mobil)[^\n]{0,12}\z"
Tree = tuple  # (feature, level, (feature, level, yes, no), (feature, level, yes, no))


def once(value: Column, body) -> Column:
    """body(value) with value worked out once: inside a lambda Spark evaluates an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), body), 0)


def starts_of(gaps: Column, matches: Column) -> Column:
    """Start of each match: array<int>. Sums go by blocks of 64 so that long lists stay cheap."""
    n = F.size(matches)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def places(step: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda b: total(F.slice(step, b * 64 + 1, 64)))
        at = lambda i, block: total(F.slice(block, F.lit(1), F.floor(i / 64).cast("int"))) + total(F.slice(step, F.floor(i / 64).cast("int") * 64 + 1, i % 64)) + F.length(F.get(gaps, i))
        return once(blocks, lambda block: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, block)))

    step = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(once(step, places))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z")
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return once(digits_of(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def with_matches(docs: DataFrame, patterns: dict[str, str], tag: str) -> DataFrame:
    """docs with __<tag>_<kind>: array<struct<start, end, m>> of all matches of each pattern in __t."""
    quick = {"email": F.col("__t").rlike("@|[(\\[][aA][tT][)\\]]"), "secret": F.col("__t").rlike("[A-Za-z0-9+/_-]{16}")}
    some = F.col("__t").rlike("[0-9][^a-zA-Z]{0,3}[0-9]")
    empty = F.array().cast("array<string>")
    for kind, p in patterns.items():
        look = quick.get(kind, some)
        docs = docs.withColumn(f"__{tag}m", F.when(look, F.regexp_extract_all("__t", F.lit(p), F.lit(0))).otherwise(empty))
        docs = docs.withColumn(f"__{tag}g", F.when(F.size(f"__{tag}m") > 0, F.split("__t", p, -1)).otherwise(empty))
        docs = docs.withColumn(f"__{tag}s", starts_of(F.col(f"__{tag}g"), F.col(f"__{tag}m")))
        span = F.transform(F.col(f"__{tag}s"), lambda s, i: F.struct(s.cast("long").alias("start"), (s + F.length(F.get(F.col(f"__{tag}m"), i))).cast("long").alias("end"), F.get(F.col(f"__{tag}m"), i).alias("m")))  # noqa: B023
        docs = docs.withColumn(f"__{tag}_{kind}", span).drop(f"__{tag}m", f"__{tag}g", f"__{tag}s")
    return docs


def with_base(docs: DataFrame) -> DataFrame:
    """docs with __t and __base_<kind>, the valid base spans of each kind."""
    docs = with_matches(docs.withColumn("__t", F.coalesce("text", F.lit(""))), BASE, "base")
    return docs.withColumns({f"__base_{k}": F.filter(F.col(f"__base_{k}"), lambda s: valid(k, s["m"])) for k in KINDS})  # noqa: B023


def before_of(c: Column, text: Column) -> Column:
    """Up to 24 characters before a span."""
    return F.substring(text, F.greatest(F.lit(1), c["start"].cast("int") - 23), F.least(c["start"].cast("int"), F.lit(24)))


def features(kind: str, c: Column, text: Column) -> dict[str, Column]:
    m = c["m"]
    left, right = F.when(c["start"] > 0, F.substring(text, c["start"].cast("int"), F.lit(1))).otherwise(""), F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))

    def side(char: Column) -> Column:
        return once(char, lambda x: F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike("[0-9]"), 2).when(x.rlike(r"\p{L}"), 3).otherwise(4))

    return {  # what stands before a secret or a telephone number labels it, so it is no feature of one
        "kind": F.lit(ALL.index(kind)),
        "digits": once(F.length(digits_of(m)), lambda n: F.when(n < 4, 0).when(n < 7, 1).when(n < 9, 2).when(n < 11, 3).when(n < 13, 4).when(n < 16, 5).when(n < 20, 6).otherwise(7)),
        "sep": F.when(~m.rlike(r"[^0-9]"), 0).when(m.startswith("+"), 1).when(m.contains("("), 2).when(m.contains("-"), 3).when(m.contains("."), 4).otherwise(5),
        "left": F.lit(0) if kind == "secret" else side(left),
        "right": F.lit(0) if kind == "secret" else side(right),
        "cue": F.lit(0) if kind in ("secret", "phone") else F.when(before_of(c, text).rlike(CUE), 1).otherwise(0),
        "groups": F.least(F.size(F.split(m, "[^0-9A-Za-z]+")), F.lit(LEVELS["groups"])) - 1,
        "letters": F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), 1).when(m.rlike("[a-z]") & m.rlike("[A-Z]"), 2).otherwise(3),
        "form": F.when(m.rlike(r"[(\[](?i:at|dot)[)\]]"), 2).when(m.rlike(r"\s"), 1).otherwise(0),
    }


def shown_true(kind: str, c: Column, text: Column) -> Column:
    """Whether a proposal is what its generator says, by evidence that is no feature of it."""
    m = c["m"]
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(m), r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", "."), r"\s", "")
        return plain.rlike(rf"\A[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{DOMAINS})\z")
    if kind == "ip":
        return valid("ip", F.regexp_replace(m, r"\s", ""))
    if kind == "card":
        return valid("card", m)
    if kind == "phone":
        return valid("phone", m) & (m.startswith("+") | before_of(c, text).rlike(CALLED))
    return before_of(c, text).rlike(SET_TO)


def with_proposals(docs: DataFrame) -> DataFrame:
    """with_base's columns and __props: array<struct<start, end, m, f, known>> of every generator."""
    docs = with_matches(docs, LOOSE, "loose")
    every = [F.transform(F.col(f"__loose_{k}"), lambda c: F.struct(c["start"], c["end"], F.struct(*[v.cast("int").alias(n) for n, v in features(k, c, F.col("__t")).items()]).alias("f"), shown_true(k, c, F.col("__t")).alias("known"))) for k in ALL]  # noqa: B023
    return docs.withColumn("__props", F.concat(*every)).drop(*[f"__loose_{k}" for k in ALL])


def boost(cells: list[tuple[tuple[int, ...], int, int]]) -> list[Tree]:
    """Boosted two-level trees on (feature levels, proposals, labelled 1)."""
    if not sum(c[2] for c in cells):
        return []
    names, score, trees = range(len(LEVELS)), [0.0] * len(cells), []

    def split(rows: list[int], res: list[float], hes: list[float]) -> tuple[float, int, int, float, float]:
        g, h = sum(res[i] for i in rows), sum(hes[i] for i in rows)
        best = (0.0, 0, -1, g / (h + 1), g / (h + 1))
        for f in names:
            sums: dict[int, list[float]] = {}
            for i in rows:
                s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
                s[0] += res[i]
                s[1] += hes[i]
            for level in sorted(sums):
                a, b = sums[level]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, f, level, a / (b + 1), (g - a) / (h - b + 1))
        return best

    for _ in range(ROUNDS):
        p = [1 / (1 + exp(-max(-30, min(30, s)))) for s in score]
        res, hes = [k - n * q for (_, n, k), q in zip(cells, p, strict=True)], [n * q * (1 - q) for (_, n, _), q in zip(cells, p, strict=True)]
        top = split(list(range(len(cells))), res, hes)
        yes = [i for i in range(len(cells)) if cells[i][0][top[1]] == top[2]]
        no = [i for i in range(len(cells)) if cells[i][0][top[1]] != top[2]]
        leaves = [split(x, res, hes)[1:] if x else (0, -1, 0.0, 0.0) for x in (yes, no)]
        tree = (top[1], top[2], *[(f, level, RATE * a, RATE * b) for f, level, a, b in leaves])
        trees.append(tree)
        score = [s + value(tree, c[0]) for s, c in zip(score, cells, strict=True)]
    return trees


def threshold(trees: list[Tree], cells: list[tuple[tuple[int, ...], int, int]]) -> float:
    """The lowest score from which PRECISION of the proposals are labelled 1 (inf: there is none)."""
    found, seen, right = float("inf"), 0, 0
    by_score: dict[float, list[int]] = {}
    for levels, n, k in cells:
        total = by_score.setdefault(round(sum(value(t, levels) for t in trees), 9), [0, 0])
        total[0] += n
        total[1] += k
    for s, (n, k) in sorted(by_score.items(), reverse=True):
        seen, right = seen + n, right + k
        if right < PRECISION * seen:
            break
        found = s
    return max(found - 1e-9, log(PRECISION / (1 - PRECISION)) / 2)


def value(tree: Tree, levels: tuple[int, ...]) -> float:
    f, level, yes, no = tree
    f2, level2, a, b = yes if levels[f] == level else no
    return a if levels[f2] == level2 else b


def score_of(trees: list[Tree], f: Column) -> Column:
    names = list(LEVELS)
    leaf = lambda x: F.when(f[names[x[0]]] == x[1], x[2]).otherwise(x[3])
    each = [F.when(f[names[t[0]]] == t[1], leaf(t[2])).otherwise(leaf(t[3])) for t in trees]
    return reduce(Column.__add__, each, F.lit(0.0))


Model = tuple  # (trees, thresholds by kind)


def fit(docs: DataFrame) -> Model:
    """Count the proposals of all rows by their features, boost on the counts of four fifths of the texts, set the thresholds on the others."""
    # explode() would put a filter on the proposals below itself, which works them all out once more.
    rows = docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"))
    rows = with_proposals(with_base(rows)).select("held", F.explode_outer("__props").alias("p")).where("p is not null")
    rows = rows.groupBy("held", *[F.col(f"p.f.{n}").alias(n) for n in LEVELS]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p.known").cast("long")).alias("k"))
    cells = sorted((r["held"], tuple(r[n] for n in LEVELS), r["n"], r["k"]) for r in rows.collect())  # as many as the features have values
    trees, limits = boost([c[1:] for c in cells if not c[0]]), []
    for kind in range(len(ALL)):
        mine = [c for c in cells if c[1][0] == kind]
        unseen = [c for c in mine if c[0]]
        limits.append(threshold(trees, [c[1:] for c in (unseen if sum(c[3] for c in unseen) >= FEW else mine)]))
    return trees, limits


def with_spans(docs: DataFrame, model: Model) -> DataFrame:
    """docs with base_spans and pii_spans: array<struct<kind (its number), start, end>>, by kind and start."""
    trees, limits = model
    kept = [c for c in docs.columns if c not in ("base_spans", "pii_spans")]
    out = with_base(docs.select(F.struct(*kept).alias("__row"), "text"))  # one column, so that no name clashes
    span = lambda k, s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.concat(*[F.transform(F.col(f"__base_{n}"), lambda s: span(k, s)) for k, n in enumerate(KINDS)])  # noqa: B023
    if not trees:
        return out.withColumn("base_spans", base).withColumn("pii_spans", F.col("base_spans")).select("__row.*", "base_spans", "pii_spans")
    out = with_proposals(out)
    scored = F.transform("__props", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.round(score_of(trees, c["f"]), 9).alias("score"), c["f"]["kind"].alias("kind")))
    limit = lambda c: F.element_at(F.array(*[F.lit(x) for x in limits]), c["kind"] + 1)
    touches = lambda c: (c["kind"] < len(KINDS)) & reduce(Column.__or__, [F.exists(F.col(f"__base_{k}"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) for k in KINDS])
    out = out.withColumn("__props", F.array_sort(F.filter(scored, lambda c: (c["score"] >= limit(c)) & ~touches(c))))
    rank = lambda x: F.struct(x["score"], -x["start"], x["end"], -x["kind"])
    beaten = lambda c: F.exists("__props", lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (rank(o) > rank(c)))
    added = F.transform(F.filter("__props", lambda c: ~beaten(c)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    out = out.withColumn("base_spans", base).withColumn("__added", added)
    return out.withColumn("pii_spans", F.array_sort(F.concat("base_spans", "__added"))).select("__row.*", "base_spans", "pii_spans")


def names_of(spans: str) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in ALL]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span of text replaced by [KIND] and n_chars (if there) set anew; texts without spans stay.

    Of overlapping spans those give their mark that begin where no earlier one reaches, of equal starts the longest; nothing of any span comes out.
    """
    columns = docs.columns
    rows = with_spans(docs.select(F.struct(*columns).alias("__all"), "text"), model or fit(docs))
    rows = rows.withColumn("__by", F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind")))))
    rows = rows.withColumn("__ends", F.transform("__by", lambda s: -s["until"]))
    # The furthest end among the spans before one, by blocks of 64 so that long lists stay cheap.
    top = lambda a: F.coalesce(F.array_max(a), F.lit(0).cast("long"))
    rows = rows.withColumn("__tops", F.transform(F.sequence(F.lit(0), F.floor(F.size("__ends") / 64).cast("int")), lambda b: top(F.slice("__ends", b * 64 + 1, 64))))
    reach = lambda i: F.greatest(top(F.slice("__tops", F.lit(1), F.floor(i / 64).cast("int"))), top(F.slice("__ends", F.floor(i / 64).cast("int") * 64 + 1, i % 64)))
    rows = rows.withColumn("__reach", F.transform("__by", lambda s, i: reach(i)))
    label = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in ALL]), s["kind"] + 1)
    part = lambda a, b: F.when(b > a, F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    pieces = F.transform("__by", lambda s, i: F.when(s["start"] >= F.get("__reach", i), F.concat(part(F.get("__reach", i), s["start"]), label(s))).otherwise(""))
    tail = F.substring(F.col("text"), (F.array_max("__ends") + 1).cast("int"), F.length("text"))
    hit = F.size("__by") > 0
    rows = rows.withColumn("__new", F.when(hit, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text")))
    new = {"text": F.col("__new"), "n_chars": F.when(hit, F.length("__new").cast("long")).otherwise(F.col("__all.n_chars")) if "n_chars" in columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("__all")[c].alias(c) for c in columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_spans(docs, fit(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(names_of("base_spans"), 256).alias("base_sha256"), names_of("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
