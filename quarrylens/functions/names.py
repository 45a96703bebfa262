"""Identities, descriptors and names of program symbols, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Access flag bits and primitive descriptor letters.
ACC_PRIVATE, ACC_STATIC, ACC_NATIVE, ACC_INTERFACE, ACC_ABSTRACT, ACC_ANNOTATION, ACC_ENUM = 0x2, 0x8, 0x100, 0x200, 0x400, 0x2000, 0x4000
PRIMITIVES = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "V": "void"}
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int "
    "interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)


def normalise_class(c: Column) -> Column:
    """Lcom/x/Y; or com.x.Y -> com/x/Y."""
    return F.translate(F.regexp_replace(c, "^L(.*);$", "$1"), ".", "/")


def class_of(member_id: Column) -> Column:
    """The class between the leading L and the first semicolon."""
    return F.regexp_extract(member_id, "^L([^;]*);", 1)


def package_of(class_name: Column) -> Column:
    """Text before the last slash; empty for the root."""
    return F.regexp_extract(class_name, "^(.*)/[^/]*$", 1)


def in_package(class_name: Column, package: str) -> Column:
    """Classes under a package prefix; <default> means no package."""
    if package == "<default>":
        return ~class_name.contains("/")
    prefix = package.replace(".", "/").rstrip("/")
    return class_name.startswith(prefix + "/") if prefix else F.lit(True)


def excluded(class_name: Column, packages: str) -> Column:
    """Whether a class is one of, or below one of, the packages in a list split by semicolons."""
    names = [p.strip().replace(".", "/").rstrip("/") for p in packages.split(";") if p.strip()]
    return reduce(Column.__or__, [(class_name == p) | class_name.startswith(p + "/") for p in names], F.lit(False))


def safe_class_name(class_name: Column) -> Column:
    """No empty, dot or parent parts, no absolute path, and no back slash, colon or control character."""
    return ~class_name.rlike(r"(\A|/)(\.{0,2})(/|\z)|[\\:\x00-\x1F]") & (F.length(class_name) > 0)


def checked_class_name(class_name: Column) -> Column:
    """The name itself; a row with an unsafe one fails the query."""
    return F.when(F.coalesce(safe_class_name(class_name), F.lit(False)), class_name).otherwise(F.raise_error(F.concat(F.lit("unsafe class name: "), F.coalesce(class_name, F.lit("null")))))


def valid_identifier(name: Column) -> Column:
    """A letter, underscore or dollar sign, then also digits; no reserved word."""
    return name.rlike(r"\A[\p{L}_$][\p{L}\p{N}_$]*\z") & ~name.isin(*sorted(RESERVED))


def prefix_or_part(name: Column, text: str) -> Column:
    """2 where a name begins with the text, 1 where it holds it elsewhere, else 0."""
    return F.when(name.startswith(text), 2).when(name.contains(text), 1).otherwise(0)


def method_id(class_desc: Column, name: Column, descriptor: Column) -> Column:
    return F.concat(class_desc, F.lit("->"), name, descriptor)


def field_id(class_desc: Column, name: Column, type_desc: Column) -> Column:
    return F.concat(class_desc, F.lit("->"), name, F.lit(":"), type_desc)


def proto(params: Column, result: Column) -> Column:
    """Array of parameter descriptors and a result descriptor -> (params)result."""
    return F.concat(F.lit("("), F.array_join(params, ""), F.lit(")"), result)


def descriptor_classes(descriptor: Column) -> Column:
    """Class names that a descriptor or signature mentions."""
    return F.regexp_extract_all(descriptor, F.lit("L([^;<]*)(?:[;<])"), F.lit(1))


def descriptor_types(descriptor: Column) -> Column:
    """Readable parameter types of a method descriptor, in order."""
    inside = F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1)
    parts = F.regexp_extract_all(inside, F.lit(r"\[*(?:L[^;]+;|[ZBCSIJFDV])"), F.lit(0))

    def readable(p: Column) -> Column:
        base = F.regexp_replace(p, r"^\[+", "")
        word = reduce(lambda acc, kv: acc.when(base == kv[0], kv[1]), list(PRIMITIVES.items())[1:], F.when(base == "Z", "boolean"))
        word = word.otherwise(F.translate(F.regexp_replace(base, "^L(.*);$", "$1"), "/", "."))
        return F.concat(word, F.repeat(F.lit("[]"), F.length(p) - F.length(base)))

    return F.transform(parts, readable)


def jni_prefix(name: Column) -> Column:
    """Java_ and the package part of a dotted or slashed method path with underscores; no mangling of underscores."""
    flat = F.translate(name, "/", ".")
    head = F.regexp_extract(flat, r"^(.*)\.[^.]*$", 1)
    return F.concat(F.lit("Java_"), F.when(head == "", F.lit("")).otherwise(F.concat(F.translate(head, ".", "_"), F.lit("_"))))


def hex_address(address: Column) -> Column:
    return F.lower(F.hex(address))


def address(text: Column) -> Column:
    """A decimal or 0x-prefixed address as long; null if it is neither."""
    return F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("long")).otherwise(text.try_cast("long"))


def class_kind(flags: Column) -> Column:
    """annotation, enum, interface, abstract or class: the first that applies."""
    has = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    return F.when(has(ACC_ANNOTATION), "annotation").when(has(ACC_ENUM), "enum").when(has(ACC_INTERFACE), "interface").when(has(ACC_ABSTRACT), "abstract").otherwise("class")


def suspicious_name(name: Column) -> Column:
    """Whether a name is too short, too long, reserved, not an ASCII identifier or made of look-alikes only."""
    return (F.length(name) <= 1) | (F.length(name) > 64) | name.isin(*sorted(RESERVED)) | ~name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z") | name.rlike(r"^[O0oIl1|]{3,}\z")


def rename_reason(name: Column) -> Column:
    return (
        F.when(name.isin(*sorted(RESERVED)), "reserved word").when(F.length(name) <= 1, "short name").when(F.length(name) > 64, "long name")
        .when(name.rlike(r"^[O0oIl1|]{3,}\z"), "ambiguous characters").otherwise("invalid or non-ASCII identifier")
    )


def path_stem(text: Column) -> Column:
    """Hex of the UTF-8 bytes, a slash after every 64 digits but the last."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-8"))), "(.{64})", "$1/"), "/$", "")


def java_hash(text: Column) -> Column:
    """String.hashCode: h * 31 + c over UTF-16 units in 32 bits, signed."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.conv(c, 16, 10).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, unsigned."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def wrap32(value: Column) -> Column:
    """A long as the signed 32-bit value its low bits give."""
    return F.shiftright(F.shiftleft(value, 32), 32)


def fold_int(op: str, a: Column, b: Column) -> Column:
    """A 32-bit operation on two ints held as longs, as the JVM does it; null where division by zero leaves it unfolded."""
    by = b.bitwiseAND(F.lit(31)).cast("int")
    low = a.bitwiseAND(F.lit(0xFFFFFFFF))
    sign = F.when((a < 0) != (b < 0), -1).otherwise(1)
    quotient = F.when(b != 0, sign * F.floor(F.abs(a) / F.when(b != 0, F.abs(b))))  # towards zero; exact, as both have 32 bits
    ops = {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: quotient, "%": lambda: a - quotient * b, "&": lambda: a.bitwiseAND(b), "|": lambda: a.bitwiseOR(b),
        "^": lambda: a.bitwiseXOR(b), "<<": lambda: _by_amount(a, by, F.shiftleft), ">>": lambda: _by_amount(a, by, F.shiftright), ">>>": lambda: _by_amount(low, by, F.shiftright),
    }
    return wrap32(ops[op]().cast("long"))


def _by_amount(value: Column, by: Column, shift) -> Column:
    """shift(value, by) for a column of amounts from 0 to 31."""
    return F.element_at(F.array(*[shift(value, k) for k in range(32)]), by + 1)


def leb128(data: Column, signed: bool = False) -> Column:
    """The number that the first bytes of a binary hold in LEB128 (up to five bytes); null if it does not end there."""
    units = F.transform(F.regexp_extract_all(F.hex(F.substring(data, 1, 5)), F.lit("(..)"), F.lit(1)), lambda c: F.conv(c, 16, 10).cast("long"))
    last = F.array_position(F.transform(units, lambda u: u < 128), True).cast("int")
    used = F.slice(units, F.lit(1), F.greatest(last, F.lit(1)))
    value = F.aggregate(F.reverse(used), F.lit(0).cast("long"), lambda acc, u: acc * 128 + u.bitwiseAND(F.lit(127)))
    if signed:
        value = F.when(F.element_at(used, -1).bitwiseAND(F.lit(64)) > 0, value - F.pow(F.lit(128.0), F.size(used)).cast("long")).otherwise(value)
    return F.when(last > 0, value)


def xor_decode(codes: Column, keys: list[int]) -> Column:
    """struct<quality, key, text>: an array of byte values decoded with the key that gives the largest share of letters, digits and blanks
    (the first in order on a tie); null where no key gives printable text alone."""
    def tried(k: int, key: int) -> Column:
        plain = F.transform(codes, lambda c: c.bitwiseXOR(F.lit(key)))
        text = F.array_join(F.transform(plain, lambda c: F.char(c)), "")
        usual = F.length(F.regexp_replace(text, "[^A-Za-z0-9 ]", "")) / F.length(text)
        return F.when((F.size(codes) > 0) & F.forall(plain, lambda c: c.between(32, 126)), F.struct(usual.alias("quality"), F.lit(-k).alias("order"), F.lit(key).alias("key"), text.alias("text")))

    best = F.array_max(F.array_compact(F.array(*[tried(k, key) for k, key in enumerate(keys)])))
    return F.when(best.isNotNull(), F.struct(best["quality"].alias("quality"), best["key"].alias("key"), best["text"].alias("text")))


def hex_rows(data: Column, width: int = 16) -> Column:
    """array<struct<off, hex, text>>: a binary in rows of width bytes, with dots for what is not printable."""
    starts = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    part = lambda o: F.substring(data, o + 1, F.lit(width))
    return F.transform(starts, lambda o: F.struct(o.alias("off"), F.hex(part(o)).alias("hex"), F.regexp_replace(F.decode(part(o), "ISO-8859-1"), r"[^\x20-\x7E]", ".").alias("text")))


def encoded(data: Column, encoding: str = "base64") -> Column:
    """A binary as base64, hex or text; what is no UTF-8 in a text is shown as the replacement character."""
    if encoding == "base64":
        return F.base64(data)
    if encoding == "hex":
        return F.lower(F.hex(data))
    if encoding == "text":
        return F.make_valid_utf8(data.cast("string"))
    raise ValueError(f"unknown encoding {encoding}")
