"""Readers and writers on small files: archives, sections, manifests, delimited text and JSON Lines."""

import io
import json
import struct
import zipfile

import pytest

from quarrylens.sources import archives, tables


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def elf(little=True, wide=True, count=3):
    """A file of three sections: none, .text and .shstrtab."""
    e, names = "<" if little else ">", b"\0.text\0.shstrtab\0"
    head = 64 if wide else 52
    table = head + len(names)
    form = e + ("IIQQQQIIQQ" if wide else "IIIIIIIIII")
    rows = [(0,) * 10, (1, 1, 6, 0x1000, head, 4, 0, 0, 0, 0), (7, 3, 0, 0, head, len(names), 0, 0, 0, 0)]
    start = b"\x7fELF" + bytes([2 if wide else 1, 1 if little else 2]) + bytes(10)
    start += struct.pack(e + "HHI" + ("QQQ" if wide else "III"), 3, 62, 1, 0, 0, table) + struct.pack(e + "I", 0)
    start += struct.pack(e + "HHHHHH", head, 0, 0, struct.calcsize(form), count, 2)
    assert len(start) == head
    return start + names + b"".join(struct.pack(form, *r) for r in rows)


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_kinds_by_magic_and_name(spark, tmp_path):
    jar = zipped({"a": b"x"})
    blobs = {"A.class": b"\xca\xfe\xba\xbe..", "c.dex": b"dex\n035\0", "l.so": elf(), "w.exe": b"MZ\0\0", "a.APK": jar, "b.jar": jar, "c.zip": jar, "d.txt": b"hi", "e": b"x"}
    for name, data in blobs.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["length"]) for r in archives.binary_files(spark, str(tmp_path)).collect()}
    kinds = dict(zip(blobs, ["class", "dex", "elf", "pe", "apk", "jar", "zip", "unknown", "unknown"], strict=True))
    assert got == {n: (kinds[n], len(b)) for n, b in blobs.items()}


def test_entries_of_nested_broken_and_too_deep_archives(spark):
    deep = zipped({"leaf": b"1"})
    for _ in range(archives.MAX_DEPTH + 1):
        deep = zipped({"in.zip": deep})
    rows = files(spark, [("a.jar", zipped({"x.txt": b"hello", "d/": b"", "lib.jar": zipped({"y": b"yy"})})), ("bad.zip", b"PK\x03\x04 broken"), ("deep.zip", deep), ("t.txt", b"text")])
    got = archives.entries(rows).collect()
    of = lambda p: [(r["name"], bytes(r["content"]) if r["name"] and "zip" not in r["name"] and "jar" not in r["name"][-3:] else None) for r in got if r["source_path"] == p]
    assert of("a.jar") == [("x.txt", b"hello"), ("lib.jar", None), ("lib.jar!y", b"yy")]
    assert [(r["name"], bool(r["error"])) for r in got if r["source_path"] == "bad.zip"] == [(None, True)]
    errors = [r["error"] for r in got if r["source_path"] == "deep.zip"]
    assert errors == [None] * archives.MAX_DEPTH + ["nested too deep"] and not of("t.txt")
    assert "lib.jar!y" not in {r["name"] for r in archives.entries(rows, nested=False).collect()}


@pytest.mark.parametrize("little", [True, False])
@pytest.mark.parametrize("wide", [True, False])
def test_sections_of_both_orders_and_widths(spark, little, wide):
    whole = elf(little, wide)
    rows = archives.elf_sections(files(spark, [("a", whole), ("cut", whole[:-1]), ("many", elf(little, wide, 9000)), ("short", whole[:20]), ("text", b"hi")])).collect()
    assert [(r["path"], r["index"], r["name"], r["flags"], r["address"], r["size"]) for r in rows] == [("a", 0, "", 0, 0, 0), ("a", 1, ".text", 6, 0x1000, 4), ("a", 2, ".shstrtab", 0, 0, 17)]


def test_permissions_and_launchers(spark):
    start = '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="p.q">'
    main = '<intent-filter><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></intent-filter>'
    xml = f"""{start}<uses-permission android:name="A"/><uses-permission android:name="B"/><uses-permission android:name="A"/><application>
        <activity android:name=".One">{main}</activity><activity android:name="Two">{main}</activity><activity android:name="z.Off" android:enabled="false">{main}</activity>
        <activity-alias android:name="x.Al" android:targetActivity="z.Goal">{main}</activity-alias><activity android:name="z.None"/></application></manifest>"""
    off = f'{start}<application android:enabled="false"><activity android:name=".One">{main}</activity></application></manifest>'
    rows = spark.createDataFrame([("a", xml), ("off", off), ("bad", "<manifest"), ("null", None)], "path string, xml string")
    assert [tuple(r) for r in archives.launchers(rows).collect()] == [("a", "p.q.One", 0), ("a", "p.q.Two", 1), ("a", "z.Goal", 2)]
    assert rows.where("path = 'a'").select(archives.permissions(rows["xml"])).first()[0] == ["A", "B"]


def test_export_paths_differ_without_case(spark):
    rows = archives.export_paths(spark.createDataFrame([("a/B",), ("a/b",), ("A/b",), ("c",)], "name string")).collect()
    assert len({r["path"].lower() for r in rows}) == 4
    assert {r["name"]: r["path"] for r in rows}["c"] == "c"


def test_call_graph_folder(spark, tmp_path):
    (tmp_path / "call_graph_node.csv").write_text('id,method,type,class_name,method_name,method_desc,api_type\n1,"a, ""b""",,,,,\n2,c,3,C,c,()V,4\nbad,row,1,,,,1\n')
    (tmp_path / "call_graph_edge.csv").write_text("src_id,dst_id\n1,2\n1,2\n2,1\n")
    (tmp_path / "string_node.csv").write_text("id,value,type\n7,x,1\n")
    (tmp_path / "string_edge.csv").write_text("src_id,dst_id\n7,1\n7,1\n")
    got = tables.call_graph(spark, str(tmp_path))
    assert sorted(map(tuple, got["java_cg_nodes"].select("node_id", "method_raw", "node_type", "api_type").collect())) == [(1, 'a, "b"', 0, 0), (2, "c", 3, 4)]
    assert got["java_cg_edges"].count() == 2 and got["string_edges"].count() == 1


def test_class_index_round_trip_in_order_and_bad_lines(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"c{k:03}", k % 5) for k in range(300, 0, -1)], "at int, name string, flags int")
    tables.write_class_index(rows, str(tmp_path / "out"), "at")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert [json.loads(x)["name"] for p in parts for x in p.read_text().splitlines()] == [f"c{k:03}" for k in range(1, 301)]
    got = tables.class_index(spark, str(tmp_path / "out"), names_only=True)
    assert got.columns == ["name", "flags", "kind", "inner"] and got.count() == 300
    assert tables.class_index(spark, str(tmp_path / "out")).where("name = 'c007'").first()["flags"] == 2
    (tmp_path / "bad.jsonl").write_text('{"name": "a"}\n\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.class_index(spark, str(tmp_path / "bad.jsonl")).collect()


def test_csv_writer_quotes_everything(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, 'say "x",\ny')], "k int, t string").coalesce(1), str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert text == '"k","t"\n"1","say ""x"", y"\n'
