"""Papers to sections: metadata filters, line predicates, and section segmentation by windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import collapse_breaks, strip

# Section names that stand alone as headers.
NAMED = (
    "Abstract", "Introduction", "Background", "Related Work", "Preliminaries", "Methodology", "Method", "Methods", "Approach", "Model", "Architecture", "Experiments", "Experimental Setup", "Setup",
    "Results", "Evaluation", "Analysis", "Discussion", "Limitations", "Conclusion", "Conclusions", "Future Work", "References", "Bibliography", "Acknowledgments", "Acknowledgements", "Appendix",
)
# Beginnings of the titles that end a paper.
ENDS = ("references", "bibliography", "acknowledgments", "acknowledgements")
# Patterns of headers and of page furniture.
NUMBERED = r"(?U)^(\d+(?:\.\d+)*\.?)\s+([A-Z][\w\s\-:&,/']{1,80})$"
ROMAN = r"(?U)^([IVX]+\.?)\s+([A-Z][\w\s\-:&,/']{1,80})$"
ARTIFACTS = (r"(?U)^\s*\d+\s*$", r"(?iU)^\s*Page\s+\d+(\s+of\s+\d+)?\s*$", r"(?iU)^\s*arXiv:\d+\.\d+v?\d*", r"(?iU)^\s*Preprint\.?\s*$", r"(?iU)^\s*Under review.*$")


def query_string(categories: Column) -> Column:
    return F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR ")


def paper_id(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def in_date_range(ts: Column, since: str, until: str | None = None) -> Column:
    """Both ends inclusive, the upper one at midnight of its day. Dates are ``yyyy-mm-dd``; others raise ValueError."""
    days = [dt.datetime.strptime(d, "%Y-%m-%d") for d in (since, until or dt.date.today().isoformat())]
    return ts.between(*[F.lit(d).cast("timestamp") for d in days])


def new_papers(incoming: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not known yet, each id once."""
    return incoming.join(known.select(id_col).distinct(), id_col, "left_anti").dropDuplicates([id_col])


def with_pdf(papers: DataFrame, files: DataFrame, path_col: str = "pdf_path") -> tuple[DataFrame, DataFrame]:
    """Papers whose file is listed, and those whose file is missing."""
    listed = files.select(F.col("path").alias(path_col)).distinct()
    return papers.join(listed, path_col, "left_semi"), papers.join(listed, path_col, "left_anti")


def is_artifact(line: Column) -> Column:
    found = line.rlike(ARTIFACTS[0])
    for pattern in ARTIFACTS[1:]:
        found = found | line.rlike(pattern)
    return found


def header_title(line: Column) -> Column:
    """The canonical title of a header line, or null: numbered, roman, or one of the known names."""
    s = strip(line)
    number, title = F.regexp_extract(s, NUMBERED, 1), F.regexp_extract(s, NUMBERED, 2)
    roman, after = F.regexp_extract(s, ROMAN, 1), F.regexp_extract(s, ROMAN, 2)
    named = F.regexp_extract(s, rf"(?iU)^({'|'.join(NAMED)})\s*:?$", 1)
    return (
        F.when((F.length(s) == 0) | (F.length(s) > 100), F.lit(None).cast("string"))
        .when(number != "", F.concat(number, F.lit(" "), strip(title)))
        .when(roman != "", F.concat(roman, F.lit(" "), strip(after)))
        .when(named != "", F.initcap(named))
    )


def is_end(title: Column) -> Column:
    bare = F.lower(F.regexp_replace(title, r"(?U)^[\dIVX.\s]+", ""))
    found = bare.startswith(ENDS[0])
    for name in ENDS[1:]:
        found = found | bare.startswith(name)
    return found


def page_lines(pages: DataFrame, paper_col: str = "paper_id", page_col: str = "page_num", text_col: str = "text") -> DataFrame:
    return pages.select(F.col(paper_col).alias("paper_id"), F.col(page_col).alias("page_num"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def sections(pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """``paper_id, section_index, section_title, text, page_start, page_end, char_count`` from page texts.

    Page furniture goes; a header opens a section; an end section stops its paper. What stands
    before the first header is the Preamble, from page 0. Sections under ``min_chars`` go, and the
    others are numbered from 0. One shuffle by paper serves all windows and the final grouping.
    """
    marked = page_lines(pages).where(~is_artifact(F.col("line"))).withColumn("title", header_title(F.col("line")))
    marked = marked.withColumn("ends", F.col("title").isNotNull() & is_end(F.col("title")))
    order = W.partitionBy("paper_id").orderBy("page_num", "line_no").rowsBetween(W.unboundedPreceding, 0)
    placed = marked.withColumn("stopped", F.max(F.col("ends").cast("int")).over(order)).withColumn("no", F.sum(F.col("title").isNotNull().cast("int")).over(order)).where("stopped = 0")
    body = F.when(F.col("title").isNull(), F.struct("page_num", "line_no", "line"))
    filled = F.when(F.col("title").isNull() & F.col("line").rlike(r"(?U)\S"), F.col("page_num"))
    grouped = placed.groupBy("paper_id", "no").agg(
        F.max("title").alias("title"), F.min(F.when(F.col("title").isNotNull(), F.col("page_num"))).alias("opened"), F.max(filled).alias("last_page"), F.sort_array(F.collect_list(body)).alias("lines")
    )
    text = collapse_breaks(strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")))
    made = grouped.select("paper_id", "no", F.coalesce("title", F.lit("Preamble")).alias("section_title"), text.alias("text"), F.coalesce("opened", F.lit(0)).alias("page_start"), F.coalesce("last_page", "opened", F.lit(0)).alias("page_end"))
    kept = made.where(F.length("text") >= min_chars)
    index = F.row_number().over(W.partitionBy("paper_id").orderBy("no")) - 1
    return kept.select("paper_id", index.alias("section_index"), "section_title", "text", "page_start", "page_end", F.length("text").alias("char_count"))


def parse_stats(papers: DataFrame, found: DataFrame) -> DataFrame:
    """``papers_parsed, papers_failed, total_sections``; a paper without sections has failed."""
    n = found.groupBy("paper_id").agg(F.count("*").alias("n"))
    each = papers.select("paper_id").distinct().join(n, "paper_id", "left")
    return each.agg(F.count_if(F.col("n") > 0).alias("papers_parsed"), F.count_if(F.col("n").isNull()).alias("papers_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_sections"))
