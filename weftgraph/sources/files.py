"""Files as documents: text with an encoding cascade, DOCX, PPTX, guards and staging."""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import sanitise

# fixed values: suffixes, encodings in their order, first bytes of formats
SUFFIXES = (".md", ".txt", ".pdf", ".docx", ".pptx", ".doc", ".ppt")
ENCODINGS = ("utf-8", "utf-8-sig", "big5", "gbk", "cp950")
MAGIC = {".pdf": "25504446", ".docx": "504B0304", ".pptx": "504B0304", ".doc": "D0CF11E0", ".ppt": "D0CF11E0"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def decode(data: bytes) -> str:
    """Text by the first encoding that fits, else UTF-8 with replacements."""
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def read_docx(data: bytes) -> str:
    """Paragraphs outside tables, then table rows with ` | ` between cells."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    body = root.find(f"{_W}body")
    lines = [text(p) for p in body.findall(f"{_W}p") if text(p).strip()]
    for row in body.iter(f"{_W}tr"):
        cells = [text(c).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


def read_pptx(data: bytes) -> str:
    """The text of each slide under a page header."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    pages = []
    for i, n in enumerate(names, 1):
        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ET.fromstring(z.read(n)).iter(f"{_A}p")]
        lines = [x for x in lines if x.strip()]
        if lines:
            pages.append(f"[第 {i} 頁]\n" + "\n".join(lines))
    return "\n\n".join(pages)


_STREAM = re.compile(rb"<<(.{0,2000}?)>>\s*stream\r?\n", re.S)
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


def _streams(data: bytes):
    """Content of the streams of a PDF, inflated where they say so; images and broken ones are left out."""
    for m in _STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if b"/Image" in m[1] or b"/FontFile" in m[1]:
            continue
        if b"/FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        yield raw


def _pdf_string(token: bytes) -> str:
    """The text of one string of a content stream: (...) with escapes, or <hex>; two-byte strings with a mark are UTF-16."""
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][0] < 56 else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1][0], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


_TEXT = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>|\[|\]|T[dDmJj*]|ET|'|\"|-?\d+\.?\d*", re.S)


def read_pdf(data: bytes) -> str:
    """The text that a PDF's content streams show, line by line, for fonts whose codes are characters.

    Strings shown by Tj, TJ, ' and \" are joined; a move to another line ends
    one, and a wide gap in TJ is a blank. Encrypted files, fonts with codes of
    their own and scanned pages give little or nothing: the caller reports them.
    """
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF")
    lines, line = [], []
    for stream in _streams(data):
        if not re.search(rb"\bBT\b", stream):
            continue
        held: list[str] = []
        for token in _TEXT.findall(stream):
            if token[:1] in b"(<":
                held.append(_pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    lines.append("".join(line))
                    line = []
                line += held
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                lines.append("".join(line))
                line, held = [], []
            elif held and token[:1] == b"-" and float(token) < -200:
                held.append(" ")
    lines.append("".join(line))
    return "\n".join(x.strip() for x in lines if x.strip())


def parse(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file; formats without a parser here are errors, not guesses."""
    suffix = os.path.splitext(path)[1].lower()
    try:
        if suffix in (".md", ".txt"):
            text = decode(data)
        elif suffix == ".docx":
            text = read_docx(data)
        elif suffix == ".pptx":
            text = read_pptx(data)
        elif suffix == ".pdf":
            text = read_pdf(data)
            if len(text.strip()) < 50 and not re.search(rb"\bBT\b", b"".join(_streams(data))):
                return None, "no text in the PDF: scanned pages need OCR"
        elif suffix in SUFFIXES:
            return None, f"no parser for {suffix} here"
        else:
            return None, f"unknown suffix {suffix}"
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:200]
    return (text, None) if text.strip() else (None, "blank text")


def parsed(files: DataFrame) -> DataFrame:
    """binaryFile rows (batch or stream) as (file_path, file_type, text, error)."""

    def run(batches):
        for b in batches:
            got = [parse(p, c) for p, c in zip(b["path"], b["content"], strict=True)]
            yield b[["path"]].assign(text=[g[0] for g in got], error=[g[1] for g in got])

    out = files.select("path", "content").mapInPandas(run, "path string, text string, error string")
    return out.select(F.col("path").alias("file_path"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("file_type"), sanitise(F.col("text")).alias("text"), "error")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder; split on `error` for what failed."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def upload_ok(content: Column, suffix: Column, most: int = 50 << 20) -> Column:
    """Size within the cap and first bytes as the suffix asks for."""
    head = F.hex(F.substring(content, 1, 4))
    want = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])
    return (F.length(content) <= most) & F.coalesce(head == F.try_element_at(want, suffix), F.lit(True))


def safe_name(name: Column) -> Column:
    """A plain file name: no separators, not . or .., not empty."""
    return F.coalesce(name.rlike(r"^[^/\\\x00]+$") & ~name.isin(".", ".."), F.lit(False))


def staging(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, chars) of the text files of a folder, by name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.char_length(F.decode("content", "UTF-8")).alias("chars")).orderBy("name")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Skills of a registry file; an unreadable or absent one is empty."""
    schema = "kb_id string, instance_id string, name string, is_local boolean, db_name string, last_sync string, top_concepts array<struct<name:string,score:double>>"
    try:
        raw = spark.read.schema(f"skills array<struct<{', '.join(c.replace(' ', ':', 1) for c in re.split(r', (?![^<]*>)', schema))}>>").option("multiLine", True).json(path)
        out = raw.select(F.explode("skills").alias("s")).select("s.*")
        out.isEmpty()
        return out
    except Exception:
        return spark.createDataFrame([], schema)


def write_json(path: str, value) -> None:
    """A small store as JSON, replaced as a whole."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
    os.replace(temporary, path)
