"""Reading books: plain text and EPUB files, many at a time."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import title_case
from lectern.operators import chapters as ch

FORMATS = ("epub", "txt")


def decoded(content: Column) -> Column:
    """Text of bytes: no UTF-8 byte order mark; UTF-8, else Latin-1."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.decode(bare, "ISO-8859-1"))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, book_id (sha256 of the content), format of the files at a path or glob."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.withColumns({"book_id": F.sha2("content", 256), "format": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})


def check_path(spark: SparkSession, path: str) -> None:
    """FileNotFoundError where nothing is there, ValueError for another format or an empty path."""
    if not path:
        raise ValueError("no input path")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        raise FileNotFoundError(path)
    ext = posixpath.splitext(path)[1].lower().lstrip(".")
    if ext and ext not in FORMATS:
        raise ValueError(f"unsupported format .{ext}; supported: {', '.join(FORMATS)}")


def text_books(found: DataFrame) -> DataFrame:
    """Books of .txt files: title from the file name, text decoded."""
    title = title_case(F.replace(F.replace(stem(F.col("path")), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))
    own = found.filter("format = 'txt'")
    return own.select("book_id", F.col("path").alias("source_path"), "format", title.alias("title"), F.lit("Unknown").alias("author"), F.lit("").alias("language"), decoded(F.col("content")).alias("text"))


_EPUB = "book_id string, title string, author string, language string, cover_id string, error string, items array<struct<pos:int,item_id:string,name:string,media_type:string,properties:string,content:binary,spine:int>>, toc array<struct<pos:int,href:string,title:string>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _first(root: ET.Element, name: str) -> str:
    return next(((e.text or "").strip() for e in root.iter() if _local(e.tag) == name and (e.text or "").strip()), "")


def _contents(archive: zipfile.ZipFile, base: str, items: list[dict]) -> list[tuple[str, str]]:
    """(href, title) of the navigation: an EPUB 3 document, else an NCX."""
    nav = next((i for i in items if "nav" in i["properties"].split()), None)
    if nav:
        root = ET.fromstring(nav["content"])
        tocs = [e for e in root.iter() if _local(e.tag) == "nav" and any(_local(k) == "type" and v == "toc" for k, v in e.attrib.items())]

        def walk(node):
            out = []
            for li in (e for e in node if _local(e.tag) == "li"):
                head = next((e for e in li if _local(e.tag) in ("a", "span")), None)
                entry = ((head.get("href") or "", " ".join("".join(head.itertext()).split())) if head is not None else ("", ""))
                inner = next((e for e in li if _local(e.tag) == "ol"), None)
                out.append((entry, walk(inner)) if inner is not None else entry)
            return out

        top = next((e for t in tocs for e in t if _local(e.tag) == "ol"), None)
        return ch.flatten_toc(walk(top)) if top is not None else []
    ncx = next((i for i in items if i["media_type"] == "application/x-dtbncx+xml"), None)
    if not ncx:
        return []

    def points(node):
        out = []
        for p in (e for e in node if _local(e.tag) == "navPoint"):
            label = next((" ".join("".join(e.itertext()).split()) for e in p if _local(e.tag) == "navLabel"), "")
            src = next((e.get("src") or "" for e in p if _local(e.tag) == "content"), "")
            inner = points(p)
            out.append(((src, label), inner) if inner else (src, label))
        return out

    root = ET.fromstring(ncx["content"])
    top = next((e for e in root.iter() if _local(e.tag) == "navMap"), None)
    return ch.flatten_toc(points(top)) if top is not None else []


def read_epub(book_id: str, content: bytes, fallback: str) -> dict:
    """Metadata, manifest in order and contents of one EPUB."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        container = ET.fromstring(archive.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        root, base = ET.fromstring(archive.read(opf)), posixpath.dirname(opf)
        meta = {e.get("name"): e.get("content") for e in root.iter() if _local(e.tag) == "meta" and e.get("name")}
        order = {e.get("idref"): i for i, e in enumerate(x for x in root.iter() if _local(x.tag) == "itemref")}
        items, names = [], set(archive.namelist())
        for pos, e in enumerate(x for x in root.iter() if _local(x.tag) == "item"):
            name = e.get("href") or ""
            at = posixpath.normpath(posixpath.join(base, name))
            items.append({"pos": pos, "item_id": e.get("id") or "", "name": name, "media_type": e.get("media-type") or "", "properties": e.get("properties") or "", "content": archive.read(at) if at in names else b"", "spine": order.get(e.get("id"))})
        toc = _contents(archive, base, items)
    return {"book_id": book_id, "title": _first(root, "title") or fallback, "author": _first(root, "creator") or "Unknown", "language": _first(root, "language"), "cover_id": meta.get("cover"), "error": None, "items": items, "toc": [{"pos": i, "href": h, "title": t} for i, (h, t) in enumerate(toc)]}


def epub_books(found: DataFrame, strict: bool = True) -> DataFrame:
    """One row per .epub file.  A file that cannot be read raises ValueError,
    or has its message in ``error`` where strict is off."""

    def run(frames):
        for pdf in frames:
            rows = []
            for book_id, content, name in zip(pdf["book_id"], pdf["content"], pdf["name"], strict=True):
                try:
                    rows.append(read_epub(book_id, content, name))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, OSError) as e:
                    if strict:
                        raise ValueError(f"cannot read EPUB {name}: {e}") from e
                    rows.append({"book_id": book_id, "title": name, "author": "Unknown", "language": "", "cover_id": None, "error": str(e), "items": [], "toc": []})
            yield pd.DataFrame(rows, columns=["book_id", "title", "author", "language", "cover_id", "error", "items", "toc"])

    own = found.filter("format = 'epub'").select("book_id", "content", stem(F.col("path")).alias("name"))
    return own.mapInPandas(run, _EPUB)


def epub_chapters(books: DataFrame) -> DataFrame:
    """Chapters of epub_books(): by contents where there are any, else by spine."""
    items = books.select("book_id", (F.size("toc") > 0).alias("has_toc"), F.inline("items"))
    pages = items.filter("media_type = 'application/xhtml+xml' or name rlike '[.]x?html?$'").filter("not array_contains(split(properties, ' '), 'nav')")
    pages = pages.withColumn("html", decoded(F.col("content")))
    told = ch.toc_chapters(books.select("book_id", F.inline("toc")), pages.filter("has_toc").select("book_id", "pos", "name", ch.html_text("html")["text"].alias("text")))
    rest = ch.spine_chapters(pages.filter("not has_toc and spine is not null").select("book_id", F.col("spine").alias("pos"), "html"))
    return told.unionByName(rest)


def epub_covers(books: DataFrame) -> DataFrame:
    """book_id, name, cover_ext, cover (bytes) of epub_books() that have one."""
    items = books.select("book_id", F.inline("items"))
    chosen = ch.covers(items.drop("content"), books.select("book_id", "cover_id"))
    return chosen.join(items.select("book_id", "name", F.col("content").alias("cover")), ["book_id", "name"])


def read_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, chapters) of all .txt and .epub files at a path."""
    check_path(spark, path)
    found = files(spark, path)
    plain, packed = text_books(found), epub_books(found)
    columns = ["book_id", "title", "author", "language"]
    books = plain.select(*columns).unionByName(packed.select(*columns))
    return books, ch.text_chapters(plain).unionByName(epub_chapters(packed))


def covers(spark: SparkSession, path: str) -> DataFrame:
    """book_id, name, cover_ext, cover (bytes) of the packed books at a path."""
    return epub_covers(epub_books(files(spark, path)))
