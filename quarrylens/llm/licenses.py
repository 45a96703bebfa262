"""Licence scan: TF-IDF cosine of licence lines to templates, then inheritance from the nearest ancestor directory.

Lines that hold a licence cue are tokenised and compared with each template's TF-IDF vector (idf over the templates) as sparse vectors, words counted
once a line; the best cosine of at least MIN_COSINE is the file's own licence. Before that, the whole text of a file named like a licence, and the leading
comment block (or first paragraph) of any other, is compared as one with the full licence texts and standard headers in license_texts; a
cosine of at least BODY_COSINE goes before the lines. 'Proprietary' counts only where no other template matches. Only a file named like a licence
speaks for its directory, whatever other files say of themselves. Documents have numbers for names: there a licence file is a text that is a
licence's full text and next to nothing else (its words are compared one by one with those of the nearest full text). A file without a licence of
its own takes that of the nearest ancestor directory that has one, by joins on directory paths.

Defined cases: null or empty text has no licence of its own; a null path inherits nothing; of two equal cosines the first template
in order counts; lines of any length are compared whole; of several licence files in a directory the best cosine, then the first template; repeated rows count one by one. A document without a source stands in no
directory, one without a lang directly in its source's.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.llm.common import materialise, small_or_plain, table

# Usual licence statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution 4.0 International CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under Creative Commons Attribution ShareAlike CC BY-SA 4.0",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential",
}
CUE = r"(?i)licen[sc]|copyright|public domain|creative commons|rights reserved|\bcc[ -](?:by|0)|SPDX"
FILE_NAME = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:\.[a-z]+)?$"
MIN_COSINE = 0.6
BODY_CUE = r"(?i)licen[sc]|permi|redistribut|warrant|public domain|copyright"
BODY_COSINE = 0.75
# A full text: this share of the licence's words stands in it, and this share of its words in the licence; lines of holders left out.
FULL_SHARE, ONLY_SHARE = 0.85, 0.95
HOLDER = r"(?im)^[^\w\n]*(?:copyright\s*(?:\(c\)|©|[0-9]{4}|[<\[{])|(?:\(c\)|©)\s*[0-9]{4}|all rights reserved[^\w\n]*$).*$"
#: Directories up to this many may be broadcast with their paths and licences.
BROADCAST_DIRECTORIES = 200_000
COMMENT = r"\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\"|'''|REM\b|$)"
TOKEN = r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


class Templates:
    """Unit TF-IDF vectors of texts by licence, and the cosine of other texts to them."""

    def __init__(self, named: list[tuple[str, str]]):
        counts = [Counter(tokens(text)) for _, text in named]
        df, n = Counter(t for c in counts for t in c), len(named)
        self.names, self.rare = [name for name, _ in named], log(1 + n) + 1
        self.idf = {t: log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
        raw = [{t: k * self.idf[t] for t, k in c.items()} for c in counts]
        self.vectors = [{t: w / sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for v in raw]

    def best(self, words: list[str]) -> tuple[float, int, str] | None:
        """(cosine, minus the template's number, licence) of the nearest template; None for no words. Linear in the words."""
        counts = Counter(words)
        weights = {t: n * self.idf.get(t, self.rare) for t, n in counts.items()}
        norm = sqrt(sum(x * x for x in weights.values()))
        shared = [(t, w) for t, w in weights.items() if t in self.idf]
        return max(((sum(w * v[t] for t, w in shared if t in v) / norm, -k, n) for k, (n, v) in enumerate(zip(self.names, self.vectors, strict=True))), default=None) if norm else None


def statements() -> Templates:
    return Templates(list(TEMPLATES.items()))


def body_files() -> list[Path]:
    return sorted((Path(__file__).parent / "license_texts").glob("*.txt"))


def bodies() -> Templates:
    """The full texts and standard headers, in order of file name."""
    return Templates([(p.name.removesuffix(".txt").removesuffix(".header"), p.read_text()) for p in body_files()])


def without_holders(text: str) -> Counter:
    return Counter(tokens(re.sub(HOLDER, "", text)))


def full_texts() -> list[Counter | None]:
    """For each of bodies the words of a full text; None for a header."""
    return [None if p.name.endswith(".header.txt") else without_holders(p.read_text()) for p in body_files()]


def is_full_text(text: str, whole: Templates, full: list[Counter | None]) -> bool:
    """Whether a text is a licence's full text and next to nothing else."""
    found = whole.best(tokens(text)) if re.search(BODY_CUE, text) else None
    wanted = full[-found[1]] if found and found[0] >= BODY_COSINE else None
    if wanted is None:
        return False
    words = without_holders(text)
    common = (words & wanted).total()
    return common >= FULL_SHARE * wanted.total() and common >= ONLY_SHARE * words.total()


def header(text: str) -> str:
    """The leading comment block of a text; its first paragraph if it does not begin with a comment."""
    lines = text.lstrip().split("\n")
    comment = lines[0] != "" and re.match(COMMENT, lines[0])
    inside, out = False, []
    for x in lines:
        if comment:
            opens, closes = x.rfind("/*"), x.rfind("*/")
            if not inside and not re.match(COMMENT, x):
                break
            inside = opens > closes or (inside and closes < 0)
        elif not x.strip():
            break
        out.append(x)
    return "\n".join(out)


def own_license(text: str, named: bool, lines: Templates, whole: Templates) -> tuple[float, int, str] | None:
    """(cosine, order, licence) that a text states for itself; named: whether it is a licence file."""
    if re.search(BODY_CUE, text):
        found = whole.best(tokens(text if named else header(text)))
        if found and found[0] >= BODY_COSINE:
            return found
    said = [lines.best(tokens(x)) for x in text.split("\n") if re.search(CUE, x)]
    said = [x for x in said if x and x[0] >= MIN_COSINE]
    return max([x for x in said if x[2] != "Proprietary"] or said, default=None)


def own_licenses(files: DataFrame, by_text: bool = False) -> DataFrame:
    """files with __own: struct<cosine, order, license> or null, and __speaks: whether it is a licence file that has one.

    Licence files are those named so, with by_text also those that are a full text. Texts without any cue never leave the JVM.
    """
    lines, whole, full, own, is_full = statements(), bodies(), full_texts(), own_license, is_full_text

    @F.pandas_udf("cosine double, order int, license string, file boolean")
    def run(texts: pd.Series, named: pd.Series) -> pd.DataFrame:
        out = []
        for t, n in zip(texts, named, strict=True):
            file = bool(n) or (by_text and t is not None and is_full(t, whole, full))
            out.append((*((None if t is None else own(t, file, lines, whole)) or (None, None, None)), file))
        return pd.DataFrame(out, columns=["cosine", "order", "license", "file"]).astype({"cosine": "Float64", "order": "Int32", "file": "bool"})

    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME), F.lit(False))
    found = run(F.when(F.col("text").rlike(f"{CUE}|{BODY_CUE}"), F.col("text")), named)
    has = F.col("__found.cosine").isNotNull()
    own_part, file = F.struct("__found.cosine", "__found.order", "__found.license"), F.col("__found.file") if by_text else named
    return files.withColumn("__found", found).withColumn("__own", F.when(has, own_part)).withColumn("__speaks", has & file).drop("__found")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(d: Column) -> Column:
    """array<string>: the directory itself and all above it; the root is the empty string."""
    parts = F.filter(F.split(d, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame) -> DataFrame:
    """files (path, text, any others) with license, cosine, origin (own, inherited, none) and licensed_at (directory)."""
    kept = [c for c in files.columns if c not in ("license", "cosine", "origin", "licensed_at")]
    return inherit(own_licenses(files.select(kept)).withColumn("__dir", directory(F.col("path"))))


def inherit(rows: DataFrame) -> DataFrame:
    """rows of own_licenses with __dir (null: in no directory): license, cosine, origin and licensed_at instead of the columns with __."""
    kept = [c for c in rows.columns if c not in ("__own", "__speaks", "__dir")]
    speaks = rows.where(F.col("__speaks") & F.col("__dir").isNotNull())
    at = F.array_join(F.filter(F.split("__dir", "/"), lambda p: p != ""), "/").alias("at")
    best = speaks.select(at, "__own.*").groupBy("at").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", "order")).alias("w"))
    best = materialise(best.select("at", "w.license", "w.cosine"), "licensed")
    steps = rows.select("__dir").where("__dir is not null").distinct().select("__dir", F.posexplode(ancestors(F.col("__dir"))).alias("depth", "at"))
    near = steps.join(small_or_plain(best, BROADCAST_DIRECTORIES), "at").groupBy("__dir").agg(F.max_by(F.struct("at", "license", "cosine"), "depth").alias("up"))
    near = materialise(near.select(F.col("__dir").alias("__of"), "up"), "inherited")
    out = rows.join(small_or_plain(near, BROADCAST_DIRECTORIES), F.col("__dir") == F.col("__of"), "left")
    own = F.col("__own").isNotNull()
    return out.select(
        *kept,
        F.when(own, F.col("__own.license")).otherwise(F.col("up.license")).alias("license"),
        F.round(F.when(own, F.col("__own.cosine")).otherwise(F.col("up.cosine")), 9).alias("cosine"),
        F.when(own, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("up.at")).alias("licensed_at"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's licence; documents stand at source/lang/doc_id, and one that is a licence's full text speaks for source/lang."""
    docs = table(spark, sf_dir, "documents")
    at = F.when(F.col("source") != "", F.concat_ws("/", "source", "lang"))
    docs = docs.select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text", at.alias("__dir"))
    rows = materialise(own_licenses(docs, by_text=True).drop("text"), "own")
    return inherit(rows).select("doc_id", "path", "license", "cosine", "origin", "licensed_at")
