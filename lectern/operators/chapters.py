"""Books to chapters: headings in plain text, tables of contents, spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.html import html_text
from lectern.functions.text import SPACE, capitalize, strip, title_case

# Heading patterns of a stripped line, in the order of trial.
ROMAN = "M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
_SUFFIX = rf"(?:[{SPACE}]*[:.\-–—][{SPACE}]*(.+))?"
NUMBERED = rf"(?i)^chapter[{SPACE}]+(\d+){_SUFFIX}$"
ROMAN_CHAPTER = rf"(?i)^chapter[{SPACE}]+({ROMAN}){_SUFFIX}$"
PART = rf"(?iU)^part[{SPACE}]+(\w+)$"
ROMAN_ALONE = rf"(?i)^({ROMAN})\.?$"
CAPITALS = rf"^[A-Z][A-Z{SPACE}\d\-:''\"]{{0,48}}[A-Z\d]$"


def heading_title(line: Column, previous_blank: Column) -> Column:
    """Title of a stripped line that is a heading, else null."""
    line = F.when(line != "", line)

    def chapter(pattern: str) -> Column:
        suffix = F.regexp_extract(line, pattern, 2)
        return F.concat(F.lit("Chapter "), F.regexp_extract(line, pattern, 1), F.when(suffix == "", "").otherwise(F.concat(F.lit(": "), strip(suffix))))

    return (
        F.when(F.rlike(line, F.lit(NUMBERED)), chapter(NUMBERED))
        .when(F.rlike(line, F.lit(ROMAN_CHAPTER)), chapter(ROMAN_CHAPTER))
        .when(F.rlike(line, F.lit(PART)), F.concat(F.lit("Part "), capitalize(F.regexp_extract(line, PART, 1))))
        .when(F.rlike(line, F.lit(ROMAN_ALONE)), F.regexp_replace(line, r"\.+$", ""))
        .when(F.rlike(line, F.lit(CAPITALS)) & previous_blank & (F.length(line) < 50), title_case(line))
    )


def tidy_body(text: Column) -> Column:
    """LF line ends, at most one blank line, no white space at line ends."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, f"[{SPACE}]+$", "")), "\n"))


def text_chapters(books: DataFrame) -> DataFrame:
    """books (book_id, title, text) -> chapters (book_id, chapter_index, title, text).

    Lines between headings are a chapter; what stands before the first is the
    prologue; headings without a body vanish; a book without headings is one
    chapter with the book's title.  One shuffle, by book.
    """
    lines = books.select("book_id", F.col("title").alias("book_title"), F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")).alias("line_no", "line"))
    order = Window.partitionBy("book_id").orderBy("line_no")
    bare = strip(F.col("line"))
    lines = lines.withColumns({"bare": bare, "previous": F.lag(bare, 1, "").over(order)})
    lines = lines.withColumn("heading", heading_title(F.col("bare"), F.col("previous") == ""))
    lines = lines.withColumns({"part": F.count("heading").over(order), "any": F.count("heading").over(Window.partitionBy("book_id"))})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("heading").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = lines.groupBy("book_id", "part").agg(F.max("heading").alias("heading"), F.max("book_title").alias("book_title"), F.max("any").alias("any"), tidy_body(strip(body)).alias("text"))
    title = F.when(F.col("any") == 0, F.col("book_title")).when(F.col("part") == 0, "Prologue").otherwise(F.col("heading"))
    kept = parts.filter((F.col("text") != "") | (F.col("any") == 0))
    index = F.row_number().over(Window.partitionBy("book_id").orderBy("part")) - 1
    return kept.select("book_id", index.cast("int").alias("chapter_index"), title.alias("title"), "text")


def default_title(title: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Chapter "), index + 1))


def flatten_toc(toc: list, out: list | None = None) -> list[tuple[str, str]]:
    """Nested contents -> (href without fragment, title), depth first.  An
    entry is (href, title) or (entry, children)."""
    out = [] if out is None else out
    for entry in toc:
        head, children = entry if isinstance(entry[1], list) else (entry, [])
        out.append((head[0].split("#", 1)[0], head[1]))
        flatten_toc(children, out)
    return out


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key."""
    return df.withColumn("lectern_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("lectern_rn = 1").drop("lectern_rn")


def toc_chapters(toc: DataFrame, items: DataFrame) -> DataFrame:
    """Chapters of books by their contents.

    toc (book_id, pos, href, title); items (book_id, pos, name, text): the
    documents.  An entry means the document of its name, or of its last path
    component; the first entry of a document wins; blank documents drop out;
    documents without an entry follow as "Chapter n".
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    docs = items.select("book_id", F.col("pos").alias("item_pos"), "name", "text")
    by_name = docs.select("book_id", F.col("name").alias("key"), "name", "item_pos", F.lit(0).alias("rank"))
    by_base = docs.select("book_id", base(F.col("name")).alias("key"), "name", "item_pos", F.lit(1).alias("rank"))
    entries = toc.filter("href <> ''").select("book_id", "pos", "href", "title", F.explode(F.array_distinct(F.array(F.col("href"), base(F.col("href"))))).alias("key"))
    hit = entries.join(by_name.union(by_base), ["book_id", "key"])
    hit = _first(hit, ["book_id", "pos"], [F.col("key") != F.col("href"), "rank", "item_pos"])
    hit = _first(hit, ["book_id", "name"], ["pos"])
    told = hit.join(docs.select("book_id", "name", "text"), ["book_id", "name"]).select("book_id", F.lit(0).alias("late"), "pos", "title", "text")
    rest = docs.join(hit.select("book_id", "name"), ["book_id", "name"], "left_anti").select("book_id", F.lit(1).alias("late"), F.col("item_pos").alias("pos"), F.lit("").alias("title"), "text")
    both = told.unionByName(rest).filter(strip(F.col("text")) != "")
    index = (F.row_number().over(Window.partitionBy("book_id").orderBy("late", "pos")) - 1).cast("int")
    both = both.withColumn("chapter_index", index)
    return both.select("book_id", "chapter_index", default_title(F.col("title"), F.col("chapter_index")).alias("title"), "text")


def spine_chapters(items: DataFrame) -> DataFrame:
    """items (book_id, pos, html) -> chapters titled by their first heading."""
    read = items.select("book_id", "pos", html_text("html").alias("page"))
    kept = read.filter(strip(F.col("page.text")) != "")
    index = (F.row_number().over(Window.partitionBy("book_id").orderBy("pos")) - 1).cast("int")
    kept = kept.withColumn("chapter_index", index)
    return kept.select("book_id", "chapter_index", default_title(F.col("page.heading"), F.col("chapter_index")).alias("title"), F.col("page.text").alias("text"))


# Media types of covers and their extensions.
COVER_TYPES = (("image/jpeg", "jpg"), ("image/png", "png"), ("image/gif", "gif"), ("image/webp", "webp"))


def covers(items: DataFrame, meta: DataFrame) -> DataFrame:
    """items (book_id, pos, item_id, name, media_type, properties), meta
    (book_id, cover_id) -> book_id, name, cover_ext of each book's cover: the
    declared one, that of the metadata, one named so, the first image."""
    ext = F.create_map(*[F.lit(x) for pair in COVER_TYPES for x in pair])
    images = items.join(meta, "book_id", "left").withColumn("cover_ext", F.try_element_at(ext, F.col("media_type"))).filter("cover_ext is not null")
    rank = F.when(F.contains("properties", F.lit("cover-image")), 0).when(F.col("item_id") == F.col("cover_id"), 1).when(F.contains(F.lower("name"), F.lit("cover")), 2).otherwise(3)
    return _first(images.withColumn("rank", rank), ["book_id"], ["rank", "pos"]).select("book_id", "name", "cover_ext")
