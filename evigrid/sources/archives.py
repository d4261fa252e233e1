"""Archives and XML from others: members with a status each, and documents that declare nothing.

Files come in as rows (path, content), as Spark's binary reader gives them from any store; an archive is read in its task,
member by member, and a limit stops it before the member is whole.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MEMBERS = "path string, member string, place int, size long, status string, sha256 string, content binary"


@dataclass(frozen=True)
class Limits:
    """Fixed values, but for ratio (unpacked bytes for each packed one, for members over a megabyte) and depth."""

    files: int = 1000
    total: int = 50 << 20
    single: int = 20 << 20
    ratio: int = 1000
    depth: int = 32


def members_of(data: bytes, limits: Limits) -> Iterator[tuple[str | None, int, int, str, bytes | None]]:
    """(name, place, size, status, content) of each member, in the archive's order. After too_many_files, or the member that
    passes the total, nothing is read on."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = archive.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError, EOFError):
        yield None, 0, 0, "bad_archive", None
        return
    if len(infos) > limits.files:
        yield None, 0, len(infos), "too_many_files", None
        return
    total, seen = 0, set()
    for k, info in enumerate(infos):
        name = info.filename.replace("\\", "/")
        parts = name.split("/")
        again = name.lower() in seen
        seen.add(name.lower())
        if ".." in parts or name.startswith("/") or ":" in name or posixpath.normpath(name).startswith(".."):
            yield name, k, 0, "traversal", None
        elif again:
            yield name, k, 0, "duplicate_name", None
        elif (info.external_attr >> 16) & 0o170000 == 0o120000:
            yield name, k, 0, "symlink", None
        elif len(parts) > limits.depth:
            yield name, k, 0, "too_deep", None
        elif info.is_dir():
            yield name, k, 0, "directory", None
        else:
            status, size, content = _read(archive, info, limits, limits.total - total)
            total += size
            yield name, k, size, status, content
            if status == "total_too_large":
                return


def _read(archive: zipfile.ZipFile, info: zipfile.ZipInfo, limits: Limits, left: int) -> tuple[str, int, bytes | None]:
    """(status, bytes read, content if ok)."""
    got, size = [], 0
    try:
        with archive.open(info) as source:
            while chunk := source.read(1 << 16):
                got.append(chunk)
                size += len(chunk)
                if size > limits.single:
                    return "too_large", size, None
                if size > left:
                    return "total_too_large", size, None
                if size > 1 << 20 and size > limits.ratio * max(1, info.compress_size):
                    return "bomb", size, None
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError):
        return "unreadable", 0, None
    return "ok", size, b"".join(got)


#: Rows, and bytes of their last column, that go out together.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20


def in_batches(rows: Iterator[tuple], kinds: Sequence[pa.DataType], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows as batches, one begun anew once it holds BATCH_ROWS rows or BATCH_BYTES bytes of binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def archive_members(files: DataFrame, limits: Limits | None = None, *, content: bool = True) -> DataFrame:
    """path, member, place, size, status, sha256, content of each member of the archives in files (path, content). Content
    and hash are there for members with status ok only. An archive is fit for use if all its members are ok or directory
    (`fit_archives`). content=False: without that column, which Spark cannot prune behind a Python step."""
    own = limits or Limits()
    schema = MEMBERS if content else MEMBERS.removesuffix(", content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                    for name, place, size, status, body in members_of(data.as_py() or b"", own):
                        row = (path.as_py(), name, place, size, status, hashlib.sha256(body).hexdigest() if body is not None else None)
                        yield (*row, body) if content else row

        yield from in_batches(rows(), kinds[: len(names)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def fit_archives(members: DataFrame) -> DataFrame:
    """path, fit: are all members of an archive fine?"""
    return members.groupBy("path").agg(F.bool_and(F.col("status").isin("ok", "directory")).alias("fit"))


class _NoDoctype(ElementTree.TreeBuilder):
    def doctype(self, name: str, pubid: str | None, system: str | None) -> None:
        raise ValueError("doctype")


#: How a document without a declaration begins in wide encodings.
_WIDE = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"<\x00\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\x00\x00\x00<", "utf-32-be"), (b"\xfe\xff", "utf-16-be"), (b"\x00<\x00?", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"<\x00?\x00", "utf-16-le"))


def encoding_of(data: bytes) -> str:
    for head, name in _WIDE:
        if data.startswith(head):
            return name
    if b"\x00" in data[:4]:
        return "utf-16"
    told = re.search(rb"""<\?xml[^>]+encoding=['"]([^'"]+)['"]""", data[:200])
    try:
        return codecs.lookup(told[1].decode("ascii", "ignore").strip()).name if told else "utf-8"
    except LookupError:
        return "utf-8"


def xml_verdict(data: bytes | None) -> str | None:
    """ok; doctype or entity for a document that declares one in any encoding; else malformed."""
    if data is None:
        return None
    text = data.decode(encoding_of(data), "replace").lower()
    for word in ("doctype", "entity"):
        if "<!" + word in text:
            return word
    parser = ElementTree.XMLParser(target=_NoDoctype())
    try:
        parser.feed(data)
        parser.close()
    except ValueError as e:
        return "doctype" if str(e) == "doctype" else "malformed"
    except (ElementTree.ParseError, LookupError):
        return "malformed"
    return "ok"


@F.pandas_udf(StringType())
def xml_status(content: pd.Series) -> pd.Series:
    """The verdict on binary content; only what is ok should go on to Spark's own from_xml."""
    return content.map(lambda x: xml_verdict(None if x is None else bytes(x)))
