"""Program files and archives: kinds by magic numbers, entries, split archives, manifest facts."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_ENTRIES, MAX_DEPTH = 200_000, 4


def binary_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, content) of files, with kind; files without bytes give no row."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", "content").withColumn("kind", file_kind(F.col("path"), F.col("content")))


def file_kind(path: Column, content: Column) -> Column:
    """class, dex, elf, pe, apk, jar, zip or unknown, from the first bytes and the extension."""
    magic = F.hex(F.substring(content, 1, 4))
    low = F.lower(path)
    zipped = F.when(low.rlike(r"\.(apk|apks|xapk|apkm)$"), "apk").when(low.rlike(r"\.(jar|war)$"), "jar").otherwise("zip")
    return F.when(magic == "CAFEBABE", "class").when(magic == "6465780A", "dex").when(magic == "7F454C46", "elf").when(magic.startswith("4D5A"), "pe").when(magic == "504B0304", zipped).otherwise("unknown")


def entries(files: DataFrame, nested: bool = True) -> DataFrame:
    """(source_path, name, size, content, error): entries of zip archives, nested archives as outer!inner.

    A broken archive gives one row with its error and does not stop the others; an archive nested deeper than MAX_DEPTH is listed
    with an error and not opened.
    """

    def walk(prefix: str, blob: bytes, depth: int):
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            for k, info in enumerate(z.infolist()):
                if k >= MAX_ENTRIES:
                    raise ValueError("too many entries")
                if info.is_dir():
                    continue
                data = z.read(info)
                inner = nested and data[:4] == b"PK\x03\x04"
                yield prefix + info.filename, len(data), data, "nested too deep" if inner and depth >= MAX_DEPTH else None
                if inner and depth < MAX_DEPTH:
                    yield from walk(f"{prefix}{info.filename}!", data, depth + 1)

    def run(frames):
        for pdf in frames:
            for path, blob in zip(pdf["path"], pdf["content"], strict=True):
                rows, error = [], None
                try:
                    for entry in walk("", bytes(blob), 0):
                        rows.append((path, *entry))
                        if len(rows) >= 256:
                            yield pd.DataFrame(rows, columns=["source_path", "name", "size", "content", "error"])
                            rows = []
                except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as e:
                    error = str(e)
                if error:
                    rows.append((path, None, None, None, error))
                if rows:
                    yield pd.DataFrame(rows, columns=["source_path", "name", "size", "content", "error"])

    return files.where(F.hex(F.substring("content", 1, 4)) == "504B0304").select("path", "content").mapInPandas(run, "source_path string, name string, size long, content binary, error string")


def merge_splits(rows: DataFrame) -> DataFrame:
    """(name, size, source_path, source_entry, split): entries of a base and its splits under one name space.

    The base comes first, then splits by name. A second resource table or code file moves under split-data/<split>/, other
    names keep their first entry. rows: (split, is_base, name, size, source_path).
    """
    w = Window.partitionBy("name").orderBy(F.desc("is_base"), "split")
    rows = rows.withColumn("n", F.row_number().over(w))
    moved = F.col("name").rlike(r"(^|/)resources\.arsc$|\.dex$")
    name = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(F.lit("split-data/"), F.col("split"), F.lit("/"), F.col("name")))
    return rows.where((F.col("n") == 1) | moved).select(name.alias("name"), "size", "source_path", F.col("name").alias("source_entry"), "split")


def elf_sections(files: DataFrame) -> DataFrame:
    """(path, index, name, type, flags, address, offset, size): the section table of ELF files, bounds-checked.

    Tables of over 8192 sections, entries of over 4096 bytes or names of over 4 MiB count as broken and give no rows.
    """

    def read(b: bytes) -> list[tuple]:
        if len(b) < 52 or b[:4] != b"\x7fELF" or b[4] not in (1, 2) or b[5] not in (1, 2):
            return []
        e, wide = "<" if b[5] == 1 else ">", b[4] == 2
        if wide and len(b) < 64:
            return []
        (shoff,) = struct.unpack_from(e + ("Q" if wide else "I"), b, 40 if wide else 32)
        size, count, names = struct.unpack_from(e + "HHH", b, 58 if wide else 46)
        form = e + ("IIQQQQ" if wide else "IIIIII")
        if not 0 < count <= 8192 or not struct.calcsize(form) <= size <= 4096 or shoff + size * count > len(b) or names >= count:
            return []
        rows = [struct.unpack_from(form, b, shoff + k * size) for k in range(count)]
        at, n = rows[names][4], rows[names][5]
        if n > 4 << 20 or at + n > len(b):
            return []
        table = b[at : at + n]
        text = lambda k: table[k : table.find(b"\0", k) if table.find(b"\0", k) >= 0 else n].decode("utf-8", "replace") if k < n else ""
        return [(i, text(r[0]), r[1], r[2], r[3], r[4], r[5]) for i, r in enumerate(rows)]

    def run(frames):
        for pdf in frames:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in read(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "index", "name", "type", "flags", "address", "offset", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, index int, name string, type long, flags long, address long, offset long, size long")


def permissions(manifest: Column) -> Column:
    """Names in the uses-permission elements of a manifest's text, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(manifest, F.lit(r'<uses-permission[^>]*?android:name="([^"]*)"'), F.lit(1)))


def launchers(manifests: DataFrame) -> DataFrame:
    """(path, activity, ordinal): launcher activities of manifest texts (path, xml).

    An activity or alias counts if it and the application are enabled and one of its filters has MAIN and LAUNCHER or the leanback
    launcher; an alias gives its target; relative names take the package. Malformed text gives no rows.
    """
    import xml.etree.ElementTree as et

    ns = "{http://schemas.android.com/apk/res/android}"

    def found(text: str) -> list[str]:
        try:
            root = et.fromstring(text)
        except et.ParseError:
            return []
        package, out = root.get("package", ""), []
        on = lambda x: x.get(f"{ns}enabled", "true") != "false"
        for app in root.findall("application"):
            for a in [x for x in app if x.tag in ("activity", "activity-alias") and on(x) and on(app)]:
                for f in a.findall("intent-filter"):
                    acts, cats = ({x.get(f"{ns}name", "") for x in f.findall(k)} for k in ("action", "category"))
                    if "android.intent.action.MAIN" in acts and cats & {"android.intent.category.LAUNCHER", "android.intent.category.LEANBACK_LAUNCHER"}:
                        name = a.get(f"{ns}targetActivity" if a.tag == "activity-alias" else f"{ns}name", "")
                        full = package + name if name.startswith(".") else name if "." in name else f"{package}.{name}"
                        if name and full not in out:
                            out.append(full)
        return out

    def run(frames):
        for pdf in frames:
            rows = [(p, a, k) for p, x in zip(pdf["path"], pdf["xml"], strict=True) if x for k, a in enumerate(found(x))]
            yield pd.DataFrame(rows, columns=["path", "activity", "ordinal"])

    return manifests.select("path", "xml").mapInPandas(run, "path string, activity string, ordinal int")


def export_paths(names: DataFrame) -> DataFrame:
    """(name, path): paths that do not collide where case is ignored; later names get a hash of the name."""
    from quarrylens.functions.names import fnv1a

    w = Window.partitionBy(F.lower("name")).orderBy("name")
    rows = names.withColumn("n", F.row_number().over(w))
    return rows.select("name", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), F.lpad(F.lower(F.hex(fnv1a(F.col("name")))), 8, "0"))).alias("path"))
