"""E-books as a source: one row for each content document of each book."""

from __future__ import annotations

import io
import logging
import posixpath
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import or_
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput
from ..functions.markup import decode, parse_document
from ..operators.chapters import parse_selection
from ..operators.checkpoint import numbered

# Names of the container format.
CONTAINER, ENCRYPTION = "META-INF/container.xml", "META-INF/encryption.xml"
MEDIA_TYPES = frozenset({"application/xhtml+xml", "text/html"})
SUFFIXES = (".xhtml", ".html", ".htm")
SCHEMA = "file string, book_title string, author string, language string, index int, href string, title string, chars bigint, html string, error string"
log = logging.getLogger(__name__)


def _xml(data: bytes, what: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise BadInput(f"{what} is not well-formed XML ({e}), so this is not a readable EPUB") from e


def _named(root: ElementTree.Element) -> Iterator[tuple[str, ElementTree.Element]]:
    """Elements with their names, whatever their name spaces."""
    return ((e.tag.rpartition("}")[2].lower(), e) for e in root.iter() if isinstance(e.tag, str))


def package_path(container: bytes) -> str:
    for name, e in _named(_xml(container, CONTAINER)):
        if name == "rootfile" and e.get("full-path"):
            return posixpath.normpath(unquote(e.get("full-path")))
    raise BadInput(f"{CONTAINER} names no rootfile, so this is not a readable EPUB")


def member_path(folder: str, href: str) -> str:
    """Place in the archive of a reference relative to a folder."""
    return posixpath.normpath(posixpath.join(folder, unquote(href.partition("#")[0])))


def is_content(href: str, media_type: str, properties: list[str]) -> bool:
    return "nav" not in properties and (media_type in MEDIA_TYPES if media_type else href.lower().endswith(SUFFIXES))


def read_package(xml: bytes, path: str) -> tuple[dict[str, str | None], list[str]]:
    """Metadata and the places of the content documents in reading order; the place in that list is the index."""
    folder = posixpath.dirname(path)
    said: dict[str, str | None] = {"title": None, "creator": None, "language": None}
    manifest, order = {}, []
    for name, e in _named(_xml(xml, f"package document {path}")):
        if name == "item" and e.get("id") and e.get("href"):
            manifest[e.get("id")] = (member_path(folder, e.get("href")), (e.get("media-type") or "").strip().lower(), (e.get("properties") or "").split())
        elif name == "itemref" and e.get("idref"):
            order.append(e.get("idref"))
        elif name in said:
            said[name] = said[name] or " ".join("".join(e.itertext()).split()) or None
    for ref in order:
        if ref not in manifest:
            log.warning("the spine names %r, which the manifest lacks", ref)
    spine = [manifest[ref][0] for ref in order if ref in manifest and is_content(*manifest[ref])]
    if not spine:
        raise BadInput("the EPUB spine has no XHTML content documents")
    return said, spine


def read_book(data: bytes, name: str, wanted: list[tuple[int, int]] | None = None) -> tuple[dict, list[tuple[int, str, str, int, str]]]:
    """Metadata and (index, href, title, chars, html) of a book; only wanted documents are read at all."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise BadInput(f"{name} is not a valid EPUB (not a ZIP archive)") from e
    with archive:
        members = set(archive.namelist())
        if ENCRYPTION in members:
            raise BadInput(f"{name} is DRM-protected ({ENCRYPTION} is present); only books without DRM can be read")
        if CONTAINER not in members:
            raise BadInput(f"{name} has no {CONTAINER}, so it is not a valid EPUB")
        package = package_path(archive.read(CONTAINER))
        if package not in members:
            raise BadInput(f"{name}: package document {package} is missing from the archive")
        said, spine = read_package(archive.read(package), package)
        rows = []
        for index, href in enumerate(spine):
            if wanted is not None and not any(a <= index <= b for a, b in wanted):
                continue
            if href not in members:
                log.warning("%s lacks %s of its spine", name, href)
                continue
            html = decode(archive.read(href))
            title, texts = parse_document(html)
            rows.append((index, href, title or posixpath.basename(href), sum(map(len, texts)), html))
    return said, rows


_FIELDS = pa.schema([("file", pa.string()), ("book_title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("index", pa.int32()), ("href", pa.string()), ("title", pa.string()), ("chars", pa.int64()), ("html", pa.string()), ("error", pa.string())])


def read_books(files: DataFrame, selection: str | None = None, on_error: str = "fail") -> DataFrame:
    """Content documents of the books in files (path, content).

    on_error: 'fail', or 'row' for a row with the message in error where a book can't be read.
    """
    wanted = parse_selection(selection) if selection else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    said, found = read_book(row["content"], row["path"], wanted)
                except ValueError as e:
                    if on_error == "fail":
                        raise
                    yield pa.RecordBatch.from_pylist([{"file": row["path"], "error": str(e)}], _FIELDS)
                    continue
                names = ("index", "href", "title", "chars", "html")
                same = {"file": row["path"], "book_title": said["title"], "author": said["creator"], "language": said["language"]}
                yield pa.RecordBatch.from_pylist([same | dict(zip(names, f)) for f in found], _FIELDS)

    return files.select("path", "content").mapInArrow(read, SCHEMA)


def scan(spark: SparkSession, path: str | list[str], selection: str | None = None, on_error: str = "fail") -> DataFrame:
    """read_books() of the files at a path or glob, one task for some books at a time."""
    return read_books(spark.read.format("binaryFile").load(path), selection, on_error)


def resolved(folder: Column, href: Column) -> Column:
    """member_path() of columns."""

    @F.arrow_udf("string")
    def run(folders: pa.Array, hrefs: pa.Array) -> pa.Array:
        return pa.array([None if f is None or h is None else member_path(f, h) for f, h in zip(folders.to_pylist(), hrefs.to_pylist())], pa.string())

    return run(folder, href)


def content_document(href: Column, media_type: Column, properties: Column) -> Column:
    """is_content() of columns, natively; properties as written, parted by white space."""
    nav = F.array_contains(F.split(F.trim(F.coalesce(properties, F.lit(""))), r"\s+"), "nav")
    kind = F.lower(F.trim(F.coalesce(media_type, F.lit(""))))
    suffix = reduce(or_, (F.lower(href).endswith(x) for x in SUFFIXES))
    return ~nav & F.when(kind != "", kind.isin(*sorted(MEDIA_TYPES))).otherwise(suffix)


def spine(itemrefs: DataFrame, manifest: DataFrame, group: list[str], order: list[str], ref: str = "idref", item: str = "id") -> DataFrame:
    """Manifest items in reading order with index, their place among the content documents.

    itemrefs (group, order, ref), manifest (group, item, href, media_type, properties); references that the manifest lacks leave.
    """
    items = manifest.where(content_document(F.col("href"), F.col("media_type"), F.col("properties"))).withColumnRenamed(item, ref)
    return numbered(itemrefs.join(items, [*group, ref]), group, order)


def format_chapters(rows: list[tuple[int, str, str, int, str]]) -> str:
    return "\n".join(f"  --chapters {i}: {title} ({chars:,} chars, {href})" for i, href, title, chars, _ in rows) or "  no readable chapters found"


def is_epub(path) -> object:
    """Whether a path column names an e-book, by its suffix in any case."""
    return F.lower(path).endswith(".epub")
