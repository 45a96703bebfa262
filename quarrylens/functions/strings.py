"""Classification of string literals, as Column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# URL schemes, algorithm names and prefixes, and PEM markers that count.
URL_SCHEMES = ("http", "https", "ftp", "ftps", "rtsp", "mms", "ws", "wss", "content", "file", "socket")
ALGORITHMS = (
    "AES", "DES", "DESede", "3DES", "Blowfish", "Twofish", "RC2", "RC4", "RC5", "RC6", "ChaCha20", "SM4", "RSA", "DSA", "EC", "ECDSA", "ECDH",
    "Ed25519", "X25519", "SM2", "MD2", "MD4", "MD5", "SHA1", "SHA-1", "SHA224", "SHA-224", "SHA256", "SHA-256", "SHA384", "SHA-384", "SHA512",
    "SHA-512", "SHA3-224", "SHA3-256", "SHA3-384", "SHA3-512", "SM3", "HmacMD5", "HmacSHA1", "HmacSHA224", "HmacSHA256", "HmacSHA384", "HmacSHA512", "HmacSM3",
)
ALGORITHM_PREFIXES = ("AES/", "DES/", "DESede/", "RSA/", "EC/", "SM2/", "SM4/", "ChaCha20/")
PEM_MARKERS = ("BEGIN PUBLIC KEY", "BEGIN PRIVATE KEY", "BEGIN RSA PUBLIC KEY", "BEGIN RSA PRIVATE KEY", "BEGIN EC PRIVATE KEY", "BEGIN ENCRYPTED PRIVATE KEY", "BEGIN CERTIFICATE", "BEGIN CERTIFICATE REQUEST", "BEGIN OPENSSH PRIVATE KEY")
# Origins of a literal's name marks, as bits.
CLASS_DESC, SOURCE_FILE, FIELD_NAME, FIELD_TYPE, METHOD_NAME, RETURN_DESC, PARAM_DESC = 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80

URL = r"^(https?|ftps?|rtsp|mms|wss?|content|file|socket)://"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
OCTET = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4 = rf"^({OCTET}\.){{3}}{OCTET}\z"
SO_NAME = r"(^|/)[A-Za-z0-9_+.\-]+\.so\z"


def is_url(s: Column) -> Column:
    return s.rlike(URL)


def is_enc_dec(s: Column) -> Column:
    return s.isin(*ALGORITHMS) | reduce(Column.__or__, [s.startswith(p) for p in ALGORITHM_PREFIXES])


def is_uuid(s: Column) -> Column:
    return s.rlike(UUID)


def is_der_base64(s: Column) -> Column:
    return (F.octet_length(s) >= 128) & s.rlike("^MII[B-F]")


def is_pem_key(s: Column) -> Column:
    return reduce(Column.__or__, [s.contains(m) for m in PEM_MARKERS]) | is_der_base64(s)


def is_so_name(s: Column) -> Column:
    return s.rlike(SO_NAME)


def is_ipv4(s: Column) -> Column:
    return s.rlike(IPV4)


def is_internal_class_desc(s: Column) -> Column:
    return s.contains("$")


def flags(s: Column, marks: Column | None = None) -> dict[str, Column]:
    """The twelve flags of a literal. marks: bits of the names it occurs as; content flags are tested only where it is 0."""
    bits = F.lit(0) if marks is None else marks
    has = lambda b: bits.bitwiseAND(F.lit(b)) != 0
    gated = lambda c: F.when(bits == 0, c).otherwise(F.lit(False))
    return {
        "is_class_desc": has(CLASS_DESC), "is_internal_class_desc": is_internal_class_desc(s), "is_field_name": has(FIELD_NAME), "is_method_name": has(METHOD_NAME),
        "is_return_desc": has(RETURN_DESC), "is_param_desc": has(PARAM_DESC), "is_url": gated(is_url(s)), "is_enc_dec": gated(is_enc_dec(s)),
        "is_uuid": gated(is_uuid(s)), "is_pem_key": gated(is_pem_key(s)), "is_so_name": gated(is_so_name(s)), "is_ipv4": gated(is_ipv4(s)),
    }
