"""Rules over page-layout tables: words, lines, cells, slide elements and shapes, images, OCR lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.columns import in_order, joined
from kbspark.operators import table_texts

#: Patterns of policy headings and of document numbers in a path.
NUMERALS = "[一二三四五六七八九十]+"
DOCUMENT_NUMBERS = r"[^\s]+[〔［\[](\p{Nd}{4})[〕］\]]\s*\p{Nd}+\s*号|〔[２0][０0][２0][０-９0-9]〕[０-９0-9]+号"
FOOTER = r"^—\s*\d+\s*—$"


def ocr_text(lines: DataFrame, least_score: float = 0.6, long: int = 30) -> DataFrame:
    """(file, page, text): lines over the score that are short or hold CJK characters, each behind a line feed."""
    kept = lines.where((F.col("score") > least_score) & ((F.char_length("text") <= long) | F.col("text").rlike("[一-鿿]")))
    return kept.groupBy("file", "page").agg(joined(in_order("seq", F.concat(F.lit("\n"), F.col("text"))), "").alias("text"))


def ocr_candidates(images: DataFrame, least: float = 0.4) -> DataFrame:
    """Images that take at least this share of the page both ways."""
    return images.where((F.col("width") / F.col("page_width") >= least) & (F.col("height") / F.col("page_height") >= least))


def crop_lines(lines: DataFrame, low: float = 0.05, high: float = 0.95, footers: bool = False) -> DataFrame:
    """Lines between the margins; footers: page-number lines go as well."""
    kept = lines.where(F.col("top").between(F.lit(low) * F.col("page_height"), F.lit(high) * F.col("page_height")))
    return kept.where(~F.col("text").rlike(FOOTER)) if footers else kept


def classify_documents(pages: DataFrame) -> DataFrame:
    """(file, class) from (file, page, text): handbook, policy, table or plain, in this order."""
    first, second = (F.coalesce(F.max(F.when(F.col("page") == n, F.col("text"))), F.lit("")) for n in (1, 2))
    # later pages count as files, without their text; a missing name is that of no PDF
    files = pages.select("file", "page", F.when(F.col("page") <= 2, F.col("text")).alias("text")).groupBy("file").agg(first.alias("p1"), second.alias("p2"))
    pdf = F.coalesce(F.lower("file").endswith(".pdf"), F.lit(False))
    kind = (
        F.when(~pdf, "plain").when(F.contains("p1", F.lit("产品版本号")) & F.contains("p1", F.lit("发布日期")), "handbook")
        .when((F.col("p1") != "") & F.col("file").rlike(DOCUMENT_NUMBERS), "policy").when(F.contains(F.concat("p1", "p2"), F.lit("明细表")), "table").otherwise("plain")
    )
    return files.select("file", kind.alias("class"))


def tag_headings(lines: DataFrame, kind: str = "handbook") -> DataFrame:
    """Lines with Markdown heading marks in front, by size and numbering."""
    text, size = F.col("text"), F.col("font_size")
    if kind == "handbook":
        mark = (
            F.when(size >= 30, "# ").when((size >= 15) & text.rlike(r"^\d+\.\d+\s+\S"), "## ").when((size >= 15) & text.rlike(r"^\d+\.\d+\.\d+\s+\S"), "### ")
            .when(size >= 15, "#### ").when(size >= 10, "##### ").otherwise("")
        )
    else:
        mark = F.when((size >= 30) | text.rlike(f"^{NUMERALS}、+"), "# ").when(text.rlike(f"^[（(]{NUMERALS}[）)]"), "## ").otherwise("")
    return lines.withColumn("text", F.concat(mark, text))


def knowledge_paths(lines: DataFrame, levels: int = 5) -> DataFrame:
    """(file, section, h1.., knowledge_path, text) of Markdown lines (file, line_no, text): body text between headings.

    A heading counts until one of its level or a shallower one comes; a heading without body gives
    no row; neighbouring sections with the same path are one.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    level = F.char_length(F.regexp_extract("text", rf"^(#{{1,{levels}}}) ", 1))
    marked = lines.withColumns({"lvl": level, "title": F.regexp_replace("text", r"^#+\s+", "")})
    last = [F.max(F.when(F.col("lvl") == k, F.struct("line_no", "title"))).over(order) for k in range(1, levels + 1)]
    marked = marked.withColumns({f"p{k + 1}": x for k, x in enumerate(last)}).where((F.col("lvl") == 0) & (F.trim("text") != ""))
    heads = []
    for k in range(1, levels + 1):
        before = [F.col(f"p{j}.line_no") for j in range(1, k)]
        over = F.greatest(F.lit(-1), F.lit(-1), *before)
        heads.append(F.when(F.col(f"p{k}.line_no") > over, F.col(f"p{k}.title")).alias(f"h{k}"))
    body = marked.select("file", "line_no", "text", *heads)
    path = F.concat_ws("-", *[f"h{k}" for k in range(1, levels + 1)])
    body = body.withColumn("knowledge_path", path)
    fresh = F.coalesce((F.lag("knowledge_path").over(order) != F.col("knowledge_path")).cast("int"), F.lit(1))
    grouped = body.withColumn("fresh", fresh).withColumn("section", F.sum("fresh").over(order))
    return grouped.groupBy("file", "section", *[f"h{k}" for k in range(1, levels + 1)], "knowledge_path").agg(joined(in_order("line_no", "text"), "\n").alias("text"))


def assemble_slides(elements: DataFrame, longer_than: int = 80, last_at_least: int = 160) -> DataFrame:
    """(file, slide, text) of elements (file, elem_no, category, text, text_as_html); page breaks part slides."""
    order = Window.partitionBy("file").orderBy("elem_no")
    numbered = elements.withColumn("slide", F.sum(F.when(F.col("category") == "PageBreak", 1).otherwise(0)).over(order)).where("category <> 'PageBreak'")
    first = F.row_number().over(Window.partitionBy("file", "slide").orderBy("elem_no")) == 1
    content = F.when(first & (F.col("category") == "Title"), F.concat(F.lit("Title: "), F.col("text"))).when(F.col("category") == "Table", F.col("text_as_html")).otherwise(F.concat("category", F.lit(": "), "text"))
    slides = numbered.withColumn("content", content).groupBy("file", "slide").agg(joined(in_order("elem_no", "content"), "\n").alias("text")).where(F.char_length("text") > longer_than)
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("slide"))) == 1
    return slides.withColumn("last", last).where(~F.col("last") | (F.char_length(F.trim("text")) >= last_at_least)).drop("last")


def table_rows_to_text(cells: DataFrame) -> DataFrame:
    """(file, row_id, text) of cells (file, table_no, row_no, col_no, text), row 0 being the header.

    `header: cell` for the cells after the first column; a row with an empty first cell goes on with
    the row before, also across tables: its last cell is added. Cells without a file or a place count for nothing.
    Cells are shuffled once, packed by blocks of rows; the texts are written as they are read in order.
    """
    placed = cells.where("file IS NOT NULL AND table_no IS NOT NULL AND row_no >= 0 AND col_no IS NOT NULL")
    runs = placed.select("file", "table_no", "row_no", "col_no", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(table_texts.pack, table_texts.PACKED)
    return runs.repartition("file").sortWithinPartitions("file", "table_no", "block").mapInArrow(table_texts.read, table_texts.TEXTS)


def markdown_table(cells: DataFrame) -> DataFrame:
    """(file, table_no, markdown): header row, rule, data rows; line feeds in cells become <br>."""
    cell = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "<br>")
    rows = cells.groupBy("file", "table_no", "row_no").agg(F.concat(F.lit("| "), joined(in_order("col_no", cell), " | "), F.lit(" |")).alias("row"), F.count("*").cast("int").alias("width"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    line = F.when(F.col("row_no") == 0, F.concat("row", F.lit("\n"), rule)).otherwise(F.col("row"))
    return rows.groupBy("file", "table_no").agg(joined(in_order("row_no", line), "\n").alias("markdown"))


def page_columns(pages: DataFrame, words: DataFrame, share: float = 0.4, margin: float = 0.2) -> DataFrame:
    """(file, page, columns): 2 if over `share` of the words have their centre right of the middle plus a margin; pages without words have 1."""
    right = (F.col("x0") + F.col("x1")) / 2 > F.col("page_width") / 2 + margin * F.col("page_width")
    seen = words.groupBy("file", "page").agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("r"))
    return pages.select("file", "page").distinct().join(seen, ["file", "page"], "left").select("file", "page", F.when(F.col("r") > share, 2).otherwise(1).alias("columns"))


def _lines(words: Column, tolerance: float) -> Column:
    """Words in order of their lines: those whose top is within the tolerance of the line's first word are a line, ordered by x0.

    words: array of (top, word_no, x0, text), sorted; the fold's state is the line's first top and the words so far.
    """
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,x0:double,word_no:bigint,text:string>>").alias("seen"))

    def step(a: Column, w: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(w["top"] - a["anchor"]) > tolerance)
        line = F.when(new, a["line"] + 1).otherwise(a["line"])
        word = F.struct(line.alias("line"), w["x0"].alias("x0"), w["word_no"].alias("word_no"), w["text"].alias("text"))
        return F.struct(F.when(new, w["top"]).otherwise(a["anchor"]).alias("anchor"), line.alias("line"), F.concat(a["seen"], F.array(word)).alias("seen"))

    return F.array_sort(F.aggregate(words, start, step)["seen"])


def _written(seen: str) -> Column:
    parts = F.transform(seen, lambda w, i: F.concat(F.when(i == 0, "").when(F.get(seen, i - 1)["line"] == w["line"], " ").otherwise("\n"), w["text"]))
    return F.array_join(parts, "")


def reflow_columns(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(file, page, text) of two-column pages: the left side's lines, a blank line, the right side's. A page is one row while it is put in order; a missing text is empty."""
    word = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("top", "double"), ("word_no", "long"), ("x0", "double"))], F.coalesce("text", F.lit("")).alias("text"))
    middle = F.col("page_width") / 2
    sides = words.groupBy("file", "page").agg(*[F.array_sort(F.collect_list(F.when(own, word))).alias(side) for side, own in (("left", F.col("x0") < middle), ("right", F.col("x0") >= middle))])
    # a column for each step, as a fold inside a lambda would run again for every word
    lined = sides.select("file", "page", *[_lines(F.col(side), tolerance).alias(side) for side in ("left", "right")])
    text = F.concat(_written("left"), F.when(F.size("left") > 0, "\n").otherwise(""), F.when(F.size("right") > 0, "\n").otherwise(""), _written("right"))
    return lined.select("file", F.col("page").cast("int").alias("page"), text.alias("text"))


def slide_order(shapes: DataFrame, emu_per_inch: int = 914_400) -> DataFrame:
    """Shapes on the slide with their place: by rounded top, then rounded left; off-slide shapes go. Halves round to even."""
    on = shapes.where(~((F.col("top") != 0) & (F.col("left") != 0) & ((F.col("top") < 0) | (F.col("left") < 0))))
    order = Window.partitionBy("file", "slide").orderBy(F.bround(F.col("top") / emu_per_inch), F.bround(F.col("left") / emu_per_inch), "shape_no")
    return on.withColumn("place", F.row_number().over(order))


def pages_to_documents(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(file, total_pages, text): pages in order."""
    return pages.groupBy("file").agg(F.count("*").alias("total_pages"), joined(in_order("page", "text"), separator).alias("text"))
