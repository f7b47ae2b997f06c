"""Scans: JSON Lines tolerant or strict, evaluation sets, page texts, tables that must exist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "id string, title string, authors array<string>, abstract string, categories array<string>, primary_category string, published string, updated string, pdf_url string, pdf_path string"
SECTIONS = "paper_id string, section_index int, section_title string, text string, page_start int, page_end int, char_count int"
CHUNKS = "chunk_id string, paper_id string, section_index int, section_title string, chunk_index int, text string, char_count int, token_count int, strategy string"
EVAL_ITEMS = "id string, question string, gold_answer string, type string, source_paper_id string, source_chunk_ids array<string>, notes string"
# The kinds of evaluation items.
ITEM_TYPES = ("single_hop", "multi_hop", "no_answer")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Papers, and the lines that were skipped: malformed ones and those without an id."""
    read = spark.read.schema(f"{METADATA}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("id").isNull() | F.col("_bad").isNotNull()
    return read.where(~bad).drop("_bad"), read.where(bad)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Items; notes default to "", an unknown type or a missing field fails the job."""
    read = strict_json(spark, path, EVAL_ITEMS)
    required = ["id", "question", "gold_answer", "type", "source_paper_id", "source_chunk_ids"]
    whole = F.forall(F.array(*[F.col(c).isNotNull() for c in required]), lambda x: x)
    ok = F.assert_true(whole & F.col("type").isin(*ITEM_TYPES), F.concat(F.lit("bad evaluation item: "), F.coalesce("id", F.lit("without id"))))
    return read.where(ok.isNull()).withColumn("notes", F.coalesce("notes", F.lit("")))


def page_texts(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``paper_id, page_num, text`` from binary files; ``extract`` turns one file into its pages, and a file it fails on has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    pages = extract(content)
                except Exception:  # an unreadable file has no pages
                    pages = []
                rows += [(name.rsplit("/", 1)[-1].rsplit(".", 1)[0], i + 1, t) for i, t in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["paper_id", "page_num", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "paper_id string, page_num int, text string")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table that must exist."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}: index first")
    return spark.read.parquet(path)
