"""Schemas of the exchanged relations."""

from pyspark.sql import types as T

STRING_FLAGS = ("is_class_desc", "is_internal_class_desc", "is_source_file", "is_field_name", "is_method_name", "is_url", "is_enc_dec", "is_uuid", "is_pem_key", "is_so_name", "is_ipv4", "is_return_desc")


def struct(spec: str) -> T.StructType:
    """A StructType of 'name:type, ...'."""
    return T._parse_datatype_string(spec.replace(":", " "))


CALL_GRAPH_NODE = "id long, method string, type int, class_name string, method_name string, method_desc string, api_type long"
CALL_GRAPH_EDGE = "src_id long, dst_id long"
STRING_NODE = "id long, pc long, str string, " + ", ".join(f"{f} boolean" for f in STRING_FLAGS)
STRING_EDGE = "src_id long, dst_id long"
NATIVE_EXPORTS = "address string, name string, descriptor string"
NATIVE_ENTRIES = "pc string, name string, start_pc string, end_pc string, node_off long, node_end long, edge_off long, edge_end long"
NATIVE_FUNC_XREF = "caller_addr string, callee_addr string"
NATIVE_IMPORTS = "address string, name string"
NATIVE_PC_XREFS = "ref_pc string, func_pc string, inst_pc string"
MEMBER = "struct<id: string, name: string, descriptor: string, flags: int>"
CLASS_INDEX = (
    "name string, flags int, kind string, instruction_units long, inner boolean, origin string, input string, "
    f"methods array<{MEMBER}>, fields array<{MEMBER}>, refs string, ref_targets array<string>"
)
REFS_LEGACY = "array<struct<from: string, target: string, offset: int, kind: string>>"
REFS_COMPACT = "map<string, array<array<string>>>"
SEARCH_HIT = "doc_id long, line_no int, column int, length int, line_occurrence int, text string"
ARCHIVE_ENTRY = "name string, size long, source_path string, source_entry string, split string"
