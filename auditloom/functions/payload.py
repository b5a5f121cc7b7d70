"""Bytes and identities: payloads in text, archive trailers, look-alike hosts, salted identities. Plain Python under Arrow UDFs."""

import base64
import binascii
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType, StringType

#: The first bytes of executable formats.
MAGIC = ((b"\x7fELF", "elf"), (b"#!", "script"), (b"MZ", "pe"), (b"\xcf\xfa\xed\xfe", "macho"), (b"\xfe\xed\xfa\xcf", "macho"), (b"\xca\xfe\xba\xbe", "macho"))
_BASE64 = re.compile(r"[A-Za-z0-9+/]{24,}={0,2}")
_HEX = re.compile(r"(?:[0-9A-Fa-f]{2}){16,}|(?:\\x[0-9A-Fa-f]{2}){8,}")
_FETCH = re.compile(rb"\b(?:curl|wget)\b")
_TO_SHELL = re.compile(rb"\|\s*(?:ba)?sh\b")


def _fetch_to_shell(data: bytes) -> bool:
    """Is a fetch piped into a shell, in one line. Each byte is looked at once or twice, however long the data."""
    done = 0
    for m in _TO_SHELL.finditer(data):
        if _FETCH.search(data, max(done, data.rfind(b"\n", done, m.start()) + 1), m.start()):
            return True
        done = m.start()
    return False


def payload_name(data: bytes) -> str | None:
    """The kind of executable that the bytes are, `shell` for text that pipes a fetch into a shell, None for neither."""
    for first, name in MAGIC:
        if data.startswith(first):
            return name
    return "shell" if _fetch_to_shell(data) else None


def encoded_payload(text: str) -> str | None:
    """`encoding:kind` of the first run of hexadecimal or base64 text that decodes to a payload.

    >>> encoded_payload("x=" + base64.b64encode(b"\\x7fELF" + bytes(20)).decode()), encoded_payload("aa" * 40)
    ('base64:elf', None)
    """
    for run in _HEX.findall(text):
        if name := payload_name(bytes.fromhex(run.replace("\\x", ""))):
            return "hex:" + name
    for run in _BASE64.findall(text):
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if name := payload_name(data):
            return "base64:" + name
    return None


def uuencoded_payload(lines: list[str]) -> tuple[int, str] | None:
    """Where the first uuencoded block that decodes to a payload begins, and `uuencode:kind`.

    >>> uuencoded_payload(["x", "begin 644 a", binascii.b2a_uu(b"#!/bin/sh").decode().strip(), "`", "end"]), uuencoded_payload(["begin 644 a", "no"])
    ((1, 'uuencode:script'), None)
    """
    start, data = None, b""
    for i, line in enumerate([*lines, "end"]):
        own = line.strip()
        if start is None:
            start, data = (i, []) if re.match(r"begin(?:-base64)? ", own) else (None, [])
        elif own.startswith("end") or own == "====":
            if name := payload_name(b"".join(data)):
                return start, "uuencode:" + name
            start = None
        else:
            try:
                data.append(base64.b64decode(own) if lines[start].strip().startswith("begin-") else binascii.a2b_uu(own) if own != "`" else b"")
            except (binascii.Error, ValueError):
                start = i if own.startswith("begin ") else None
                data = []
    return None


@pandas_udf(StringType())
def payload_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """encoded_payload() of a column; NULL for NULL."""
    for s in batches:
        yield s.map(lambda t: None if t is None else encoded_payload(t))


def magic_of(head: Column) -> Column:
    """The kind of executable of a BINARY head, in plain expressions; NULL for none."""
    out = F.lit(None).cast("string")
    for first, name in reversed(MAGIC):
        out = F.when(F.substring(head, 1, len(first)) == F.lit(first), name).otherwise(out)
    return out


def is_archive(data: Column) -> Column:
    """Do BINARY data begin as one of the archives that trailing_bytes() knows."""
    starts = lambda at, *magic: F.substring(data, at, len(magic[0])).isin(*(F.lit(m) for m in magic))
    return starts(1, b"\x1f\x8b") | starts(1, b"PK\x03\x04", b"PK\x05\x06") | starts(258, b"ustar")


def trailing_bytes(data: bytes) -> int | None:
    """Bytes behind the declared end of a gzip, zip or tar archive; None for anything else or a broken one.

    >>> import gzip; trailing_bytes(gzip.compress(b"x") + b"evil"), trailing_bytes(gzip.compress(b"x")), trailing_bytes(b"text")
    (4, 0, None)
    """
    if data[:2] == b"\x1f\x8b":
        at = 0
        try:
            while data[at : at + 2] == b"\x1f\x8b":
                d = zlib.decompressobj(31)
                while not d.eof and at < len(data):  # a piece at a time: only the end matters
                    piece = data[at : at + 65536]
                    at += len(piece)
                    while piece and not d.eof:
                        d.decompress(piece, 1 << 20)
                        piece = d.unconsumed_tail
                while not d.eof and d.decompress(b"", 1 << 20):
                    pass
                if not d.eof:
                    return None
                at -= len(d.unused_data)
        except zlib.error:
            return None
        return len(data[at:].rstrip(b"\0"))
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        at = data.rfind(b"PK\x05\x06")
        if at < 0 or len(data) < at + 22:
            return None
        return len(data) - (at + 22 + struct.unpack("<H", data[at + 20 : at + 22])[0])
    if data[257:262] == b"ustar":
        at = 0
        while at + 512 <= len(data) and data[at : at + 512].strip(b"\0"):
            size = data[at + 124 : at + 136].strip(b" \0") or b"0"
            if not re.fullmatch(rb"[0-7]+", size):
                return None
            at += 512 + (int(size, 8) + 511) // 512 * 512
        return len(data[at:].strip(b"\0"))
    return None


@pandas_udf(LongType())
def archive_trailer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if b is None else trailing_bytes(bytes(b)) for b in s], dtype="Int64")


def scripts_of(text: str) -> set[str]:
    """The scripts of the letters of a text, by the first word of their names."""
    return {unicodedata.name(c, "UNKNOWN").split(" ")[0] for c in text if c.isalpha()}


def looks_mixed(host: str) -> bool:
    """Does a label mix scripts that look alike, or is a whole non-ASCII label made of letters that pass for Latin ones.

    >>> looks_mixed("example.org"), looks_mixed("ex\\u0430mple.org"), looks_mixed("xn--exmple-4nf.org"), looks_mixed("пример.example")
    (False, True, True, False)
    """
    for label in host.lower().split("."):
        if label.startswith("xn--"):
            try:
                label = label[4:].encode().decode("punycode")
            except (UnicodeError, ValueError):
                return True
        own = scripts_of(label)
        if len(own) > 1 and own & {"LATIN"} and own & {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE"}:
            return True
        if own == {"CYRILLIC"} and set(label) <= set("аеорсухіјѕԁһ-0123456789"):
            return True
    return False


@pandas_udf(BooleanType())
def homograph(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if h is None else False if h.isascii() and "xn--" not in h.lower() else looks_mixed(h) for h in s], dtype="boolean")


#: Letters that pass for a Latin one.
CONFUSABLES = str.maketrans({"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ο": "o", "α": "a", "ν": "v", "ı": "i", "ｌ": "l"})


def identity(name: str) -> str:
    """A name as it is told apart: compatible forms, nothing invisible, look-alikes folded, trimmed, lower case.

    >>> identity(" Al\\u200bice\\u0430 ")
    'alicea'
    """
    text = unicodedata.normalize("NFKC", name)
    return "".join(c for c in text if unicodedata.category(c) != "Cf").translate(CONFUSABLES).strip().lower()


@pandas_udf(StringType())
def identity_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda n: None if n is None else identity(n))


def salted_hash(key: Column, salt: str) -> Column:
    """The salted SHA-256 of an identity."""
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), key), 256)


def has_fatal_codepoints(text: Column) -> Column:
    """Bidirectional overrides, invisible operators and tags, or a zero-width character between ASCII characters."""
    return text.rlike(r"[\u202A-\u202E\u2060-\u2064\u2066-\u2069]|\uDB40[\uDC00-\uDC7F]|(?<![^\x00-\x7F])[\u200B-\u200F\uFEFF](?![^\x00-\x7F])")


def without_ansi(text: Column) -> Column:
    """Without terminal control sequences."""
    return F.regexp_replace(text, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])", "")


def terminal_safe(text: Column) -> Column:
    """Text that can't steer a terminal: no control sequences, other control characters as a blank."""
    return F.regexp_replace(without_ansi(text), r"[\x00-\x08\x0B-\x1F\x7F-\x9F\u202A-\u202E\u2066-\u2069]", " ")
