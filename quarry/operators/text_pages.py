"""Documents to pages, and page-level cleanup.

A document is one row; paging happens inside that row with array functions
(split -> strip -> drop blanks -> chunk), so turning a corpus into pages is a
single map stage with no shuffle.  ``page_no`` starts at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WS, chunk_array, each, spaced_words, strip_ws, stripped_lines

PAGE_SCHEMA = "doc_id long, page_no int, n_pages int, page string"


def page_array(text: Column, lines_per_page: int = 8, keep_newlines: bool = False) -> Column:
    """Stripped non-blank lines, every ``lines_per_page`` joined into one page."""
    return pages_of(stripped_lines(text), lines_per_page, keep_newlines)


def pages_of(lines: Column, lines_per_page: int = 8, keep_newlines: bool = False) -> Column:
    sep = "\n" if keep_newlines else " "
    return F.transform(chunk_array(lines, lines_per_page), lambda ch: F.array_join(ch, sep))


def doc_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document body as the reader returns it: stripped lines joined by newlines."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.array_join(stripped_lines(F.col(text_col)), "\n").alias("content"))


def scan_text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lines_per_page: int = 8, keep_newlines: bool = False) -> DataFrame:
    """(doc_id, page_no, n_pages, page) for every page of every document."""
    pages = page_array(F.col(text_col), lines_per_page, keep_newlines)
    rows = docs.select(F.col(id_col).alias("doc_id"), pages.alias("_p")).withColumn("n_pages", F.size("_p"))
    return (each(rows, "_p", "_i", "page").select("doc_id", (F.col("_i") + 1).alias("page_no"), "n_pages", "page"))


def conversation_pages(conv: DataFrame) -> DataFrame:
    """A conversation is a document and each turn one page."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id")
    return conv.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"),
        F.count(F.lit(1)).over(w).cast("int").alias("n_pages"), F.col("text").alias("page"))


def page_chunk_words(cleaned: DataFrame, words_per_page: int = 100, text_col: str = "cleaned_text") -> DataFrame:
    """Pages for documents that have none: consecutive chunks of 100 words."""
    chunks = F.transform(chunk_array(spaced_words(F.col(text_col)), words_per_page), lambda ch: F.array_join(ch, " "))
    rows = cleaned.select("doc_id", chunks.alias("_p")).withColumn("n_pages", F.size("_p"))
    return (each(rows, "_p", "_i", "page").select("doc_id", (F.col("_i") + 1).alias("page_no"), "n_pages", "page"))


def first_line(page: Column, width: int) -> Column:
    return F.substring(strip_ws(F.try_element_at(F.split(strip_ws(page), "\n"), F.lit(1))), 1, width)


def repeated_header(pages: DataFrame, width: int = 60, min_pages: int = 3) -> DataFrame:
    """Most common first line (cut to ``width``) per document, if it heads more
    than ``min_pages - 1`` pages.  Ties go to the line seen first."""
    from quarry.operators.topk import top_k
    fl = pages.select("doc_id", "page_no", first_line(F.col("page"), width).alias("header"))
    c = fl.groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("n"), F.min("page_no").alias("first_page"))
    t = top_k(c, "doc_id", [F.desc("n"), F.asc("first_page")], 1)
    return t.where(F.col("n") >= min_pages).select("doc_id", "header", F.col("n").alias("pages_with_header"))


# Page-number lines: "1", "- 2 -", "Page 3".
PAGE_NUMBER_LINE = r"^[\-\x{2013}" + WS + r"]*\p{Nd}+[\-\x{2013}" + WS + r"]*$"
PAGE_WORD_LINE = r"^[Pp]age[" + WS + r"]*\p{Nd}+$"


def page_clean(pages: DataFrame, header_width: int = 60) -> DataFrame:
    """Clean lines of each page: blank, repeated-header and page-number lines
    dropped; pages left empty are skipped.  Adds ``lines`` and ``clean_text``."""
    hdr = repeated_header(pages, header_width)
    j = pages.join(hdr.select("doc_id", "header"), "doc_id", "left")
    lines = F.array_remove(F.transform(F.split(F.col("page"), "\n"), strip_ws), "")
    keep = F.filter(lines, lambda l: ~(
        (F.col("header").isNotNull() & (F.col("header") != "") & F.substring(l, 1, 80).contains(F.col("header")))
        | l.rlike(PAGE_NUMBER_LINE) | l.rlike(PAGE_WORD_LINE)))
    # pages without a line go as rows of an array: a filter would be pushed down and clean each page a second time
    found = j.select("doc_id", "page_no", "n_pages", "page", F.filter(F.array(keep), lambda l: F.size(l) > 0).alias("_l"))
    return each(found, "_l", "_i", "lines").drop("_i").withColumn("clean_text", F.array_join("lines", " "))
