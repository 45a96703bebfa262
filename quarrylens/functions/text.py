"""Lines, masks and grams of source text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

GRAM_BITS = 8192


def lines(text: Column) -> Column:
    """Lines between new lines; a trailing empty line is dropped and empty text has none."""
    parts = F.split(text, "\n", -1)
    return F.when(text.endswith("\n") | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def gram_bits(text: Column) -> Column:
    """Distinct hashes, below GRAM_BITS, of the three-character windows of lower-cased text."""
    folded = F.lower(text)
    codes = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), code_point)

    def windows(own: Column) -> Column:
        shifted = F.arrays_zip(own.alias("a"), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))).alias("b"), F.slice(own, 3, F.greatest(F.size(own) - 2, F.lit(0))).alias("c"))
        full = F.filter(shifted, lambda z: z["c"].isNotNull())
        return F.array_distinct(F.transform(full, lambda z: (z["a"] * (251 * 251) + z["b"] * 251 + z["c"]).bitwiseAND(F.lit(GRAM_BITS - 1))))

    # The outer transform binds the codes once; inside the lambda of a window they would be worked out again for each.
    return F.get(F.transform(F.array(codes), windows), 0)


def code_point(c: Column) -> Column:
    return F.when(F.octet_length(c) == 1, F.ascii(c).cast("long")).otherwise(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))


def query_grams(query: str) -> list[int]:
    """The grams a match of a literal query must have; grams with white space are left out, for masks may have put it there."""
    q = query.lower()
    return sorted({(ord(a) * 251 * 251 + ord(b) * 251 + ord(c)) & (GRAM_BITS - 1) for a, b, c in zip(q, q[1:], q[2:], strict=False) if not (a.isspace() or b.isspace() or c.isspace())})


def quoted(quote: str, inside: str, rest: str) -> str:
    """A string up to the first quote that an even number of back slashes precedes, else the rest. No group repeats, so long strings need no deep stack."""
    return rf"{quote}(?:{inside}*?(?<!\\)(?:\\\\)*+{quote}|{rest})"


#: Comments, strings and what is between them, by line (strings end with their line, block comments run on) and over a whole text.
LINE_TOKENS = "|".join([r"//[^\n]*", r"/(?=\*)[\s\S]*?(?:\*/|\z)", quoted('"', r"[^\n]", r"[^\n]*"), quoted("'", r"[^\n]", r"[^\n]*"), "[^/\"']+", "/"])
TEXT_TOKENS = "|".join([r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\z)", quoted('"', r"[\s\S]", r"[\s\S]*"), quoted("'", r"[\s\S]", r"[\s\S]*"), "[^/\"']+", "/"])
SMALI_TOKENS = "|".join([r"#[^\n]*", quoted('"', r"[\s\S]", r"[\s\S]*"), quoted("'", r"[\s\S]", r"[\s\S]*"), "[^#\"']+"])


def blanked(text: Column, tokens: str, blank: Callable[[Column], Column]) -> Column:
    """Text with some of its tokens as spaces; new lines stay, and so do all offsets."""
    cut = F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    return F.array_join(F.transform(cut, lambda t: F.when(blank(t), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")


def masked(text: Column, code: bool = True, comments: bool = True) -> Column:
    """Text with the unwanted scope as spaces, line by line: // and /* */ comments on one side, code with its strings on the other."""
    if code and comments:
        return text
    comment = lambda t: t.startswith("//") | t.startswith("/*")
    return blanked(text, LINE_TOKENS, lambda t: F.lit(True) if not (code or comments) else ~comment(t) if comments else comment(t))


def code_mask(text: Column, smali: bool = False) -> Column:
    """Text with comments, strings and characters as spaces, over the whole text: a string may run over lines. Smali has # comments only."""
    marks = ["#", '"', "'"] if smali else ["//", "/*", '"', "'"]
    return blanked(text, SMALI_TOKENS if smali else TEXT_TOKENS, lambda t: reduce(Column.__or__, [t.startswith(m) for m in marks]))


def braced(text: Column, start: Column) -> Column:
    """Text from a position (from 0) to the brace that closes the first one after it; null if none does. Braces in comments and strings do not count."""
    cut = F.regexp_extract_all(F.substring(code_mask(text), start + 1, F.length(text)), F.lit("[^{}]+|[{}]"), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("over"))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        more = F.struct((s["at"] + F.length(token)).alias("at"), depth.alias("depth"), ((token == "}") & (depth <= 0)).alias("over"))
        return F.when(s["over"], s).otherwise(more)

    found = F.aggregate(cut, begin, step)
    # The fold is worked out once by binding it in a lambda.
    body = lambda s: F.when(s["over"] & (s["depth"] == 0), F.substring(text, start + 1, s["at"]))
    return F.get(F.transform(F.array(found), body), 0)


def printable(text: Column) -> Column:
    """Control and format characters shown as [U+xxxx]."""
    one = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"[\p{Cc}\p{Cf}]"), F.concat(F.lit("[U+"), F.lpad(F.hex(code_point(c)), F.greatest(F.lit(4), F.length(F.hex(code_point(c)))), F.lit("0")), F.lit("]"))).otherwise(c))
    return F.array_join(one, "")


def clean_csv_text(text: Column) -> Column:
    """Control characters as spaces, as the CSV exchange wants them."""
    return F.regexp_replace(text, r"[\x00-\x1f]", " ")


#: Bytes of a class file's text, one character a byte: plain runs, an encoded NUL, sequences of two to four bytes, a pair of surrogates, anything else.
BYTE_TOKENS = "|".join([
    r"[\x20-\x7F]+", r"[\x00-\x1F]", r"\xC0\x80", r"[\xC2-\xDF][\x80-\xBF]", r"\xED[\xA0-\xAF][\x80-\xBF]\xED[\xB0-\xBF][\x80-\xBF]", r"\xE0[\xA0-\xBF][\x80-\xBF]",
    r"\xED[\x80-\x9F][\x80-\xBF]", r"[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}", r"\xF0[\x90-\xBF][\x80-\xBF]{2}", r"[\xF1-\xF3][\x80-\xBF]{3}", r"\xF4[\x80-\x8F][\x80-\xBF]{2}", r"[\s\S]",
])


def csv_bytes(data: Column) -> Column:
    """Bytes of modified UTF-8 as text for the CSV exchange: control characters and encoded NULs as spaces, pairs of surrogates as the
    character they stand for, what is no UTF-8 as question marks."""
    byte = lambda t, k: F.ascii(F.substring(t, k, 1)).cast("long")  # noqa: E731  a code point below 256

    def pair(t: Column) -> Column:
        low = lambda k, bits: byte(t, k).bitwiseAND(F.lit((1 << bits) - 1))
        code = F.lit(0x10000).cast("long") + ((low(2, 4) * 64 + low(3, 6)) * 1024) + low(5, 4) * 64 + low(6, 6)
        part = lambda by, bits: F.shiftright(code, by).bitwiseAND(F.lit((1 << bits) - 1))
        whole = (part(18, 3) + 0xF0) * (1 << 24) + (part(12, 6) + 0x80) * (1 << 16) + (part(6, 6) + 0x80) * (1 << 8) + part(0, 6) + 0x80
        return F.decode(F.unhex(F.hex(whole)), "UTF-8")

    def shown(t: Column) -> Column:
        plain = t.rlike(r"\A[\x20-\x7F]+\z")
        blank = t.rlike(r"\A(?:[\x00-\x1F]|\xC0\x80)\z")
        return F.when(plain, t).when(blank, " ").when(F.length(t) == 1, "?").when(F.length(t) == 6, pair(t)).otherwise(F.decode(F.encode(t, "ISO-8859-1"), "UTF-8"))

    cut = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(BYTE_TOKENS), F.lit(0))
    return F.array_join(F.transform(cut, shown), "")
