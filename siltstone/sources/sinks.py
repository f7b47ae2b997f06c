"""Sinks: tables by strategy, the vector table, run files and the ablation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.tables import exists

# Fixed value: the beginning of the table of runs.
HEADER = "# Retrieval ablation\n\n| Config | Strategy | k | Recall@k | MRR@k | nDCG@k | n_eval | timestamp |\n|---|---|---|---|---|---|---|---|\n"


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder per strategy; only the strategies written now are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> int:
    """A full rebuild; returns the number of rows, and writes no table for none."""
    n = vectors.count()
    if n:
        vectors.write.mode("overwrite").parquet(path)
    return n


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of an earlier run, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_name(config: str, strategy: str, k: int, timestamp: str) -> str:
    return f"{config}_{strategy}_k{k}_{timestamp.replace(':', '-').replace('.', '-')}"


def write_run(per_query: DataFrame, aggregate: DataFrame, folder: str, config: str, strategy: str, k: int, timestamp: str) -> str:
    """``<name>.jsonl`` and ``<name>.json`` below the folder; returns the name."""
    name = run_name(config, strategy, k, timestamp)
    per_query.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
    aggregate.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.json")
    return name


def write_answers_run(kind: str, rows: DataFrame, aggregate: DataFrame, folder: str, config: str, timestamp: str) -> str:
    """A run of a kind (generation, ragas) over answers: ``<kind>_<config>_<timestamp>.jsonl`` and ``.json``; returns the name."""
    name = f"{kind}_{config}_{timestamp.replace(':', '-').replace('.', '-')}"
    rows.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
    aggregate.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.json")
    return name


def append_text(spark: SparkSession, path: str, text: str, header: str = HEADER) -> None:
    """Append a row to a small text file in any store, with the header if the file is new."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = header
    if exists(spark, path):
        stream = fs.open(p)
        old = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
    out = fs.create(p, True)
    out.write(bytearray((old + text + "\n").encode()))
    out.close()
