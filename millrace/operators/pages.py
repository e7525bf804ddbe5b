"""Pages of a PDF: its text layer cut at page markers, merged with recognized text in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import bound
from ..functions.text import trim

#: Fixed value.
MARKER = r"<!--\s*Page\s+(\d+)\s*-->"


def sections(markdown: Column) -> Column:
    """Array of (page, text) between markers, in order; text before the first marker is in none."""
    base = F.coalesce(markdown, F.lit(""))
    numbers = F.regexp_extract_all(base, F.lit(MARKER), F.lit(1))
    texts = F.slice(F.split(base, MARKER), 2, F.size(F.split(base, MARKER)))
    return F.zip_with(numbers, texts, lambda n, t: F.struct(F.try_to_number(n, F.lit("9999999999")).cast("int").alias("page"), t.alias("text")))


def page_sections(docs: DataFrame, id_col: str, markdown_col: str) -> DataFrame:
    """(id, page, text), one row for each page; of markers that repeat the last one counts."""
    exploded = docs.select(id_col, F.posexplode(sections(F.col(markdown_col))).alias("pos", "s"))
    last = exploded.where(F.col("s.page").isNotNull()).groupBy(id_col, F.col("s.page").alias("page")).agg(F.max_by("s.text", "pos").alias("text"))
    return last.select(id_col, "page", "text")


def merge(markdown: Column, page_count: Column, ocr: Column) -> Column:
    """Markdown of a document from its text layer and a map of recognized text by page.

    With markers every page gets one, then its section and its recognized text, where there are any. Without
    markers the text stands on page 1, and markers begin with page 2. Nothing for a page count of 0."""
    base = F.coalesce(markdown, F.lit(""))
    found = F.coalesce(ocr, F.create_map().cast("map<int,string>"))

    def whole(x: Column) -> Column:
        def page(p: Column) -> Column:
            # the sections stand in reverse, so that of markers that repeat the last one is met first
            at = F.array_position(x["numbers"], p).cast("int")
            section = F.coalesce(trim(F.get(x["texts"], at - 1)), F.lit(""))
            text = F.coalesce(trim(F.try_element_at(x["ocr"], p)), F.lit(""))
            bare = F.array(trim(x["base"]), F.when(text != "", F.concat(F.lit("\n\n<!-- OCR page "), p.cast("string"), F.lit(" -->\n\n"), text)))
            full = F.array(F.concat(F.lit("<!-- Page "), p.cast("string"), F.lit(" -->")), F.when(section != "", section), F.when(text != "", F.concat(F.lit("\n\n<!-- OCR -->\n\n"), text)))
            return F.array_compact(F.when(~x["marked"] & (p == 1), bare).otherwise(full))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), page_count.cast("int")), page)), "\n\n")

    def cut(x: Column) -> Column:
        return F.struct(x["base"].alias("base"), x["marked"].alias("marked"), F.transform(x["parts"], lambda s: s["page"]).alias("numbers"), F.transform(x["parts"], lambda s: s["text"]).alias("texts"), x["ocr"].alias("ocr"))

    once = F.struct(base.alias("base"), base.rlike(MARKER).alias("marked"), F.reverse(sections(base)).alias("parts"), found.alias("ocr"))
    return F.when(page_count > 0, bound(bound(once, cut), whole)).otherwise("")


def merge_pages(docs: DataFrame, ocr: DataFrame, id_col: str = "id", markdown_col: str = "markdown", count_col: str = "page_count", order_col: str | None = None) -> DataFrame:
    """``docs`` with ``merged``: recognized pages (id, page, text) come in by one shuffle on the document. Of texts for one
    page the last by ``order_col`` counts, else the largest; a text without a page is in none."""
    one = F.max_by("text", order_col) if order_col else F.max("text")
    single = ocr.where(F.col("page").isNotNull()).groupBy(id_col, F.col("page").cast("int").alias("page")).agg(one.alias("text"))
    grouped = single.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("_ocr"))
    return docs.join(grouped, id_col, "left").withColumn("merged", merge(F.col(markdown_col), F.coalesce(count_col, F.lit(0)), F.col("_ocr"))).drop("_ocr")
