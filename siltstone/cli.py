"""Command line: one command per step, tables in between.

    python -m siltstone.cli parse --pages pages.parquet --out sections
    python -m siltstone.cli chunk --sections sections --out chunks --strategy recursive
    python -m siltstone.cli index --chunks chunks --out index
    python -m siltstone.cli search --index index --chunks chunks --text "a question" --config rerank
    python -m siltstone.cli eval-retrieval --index index --chunks chunks --items items.jsonl --out runs --config hybrid
    python -m siltstone.cli query --index index --chunks chunks --text "a question" --config multi-query --model package.module:function
    python -m siltstone.cli generate-evals --chunks chunks --out items.jsonl --model package.module:function
    python -m siltstone.cli eval-generation --index index --chunks chunks --items items.jsonl --out runs --model package.module:function
    python -m siltstone.cli eval-ragas --index index --chunks chunks --items items.jsonl --out runs --model package.module:function

A model is a function from a prompt to a reply; it is named, imported where it runs, and may raise.
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import load_settings
from siltstone.functions.text import preview
from siltstone.functions.vectors import hash_bag
from siltstone.operators import ann, calls, chunking, evals, grounding, ingest, metrics, sparse, subwords
from siltstone.plans import retrieval
from siltstone.sources import sinks, tables
from siltstone.sources.scratch import stored



def _model(args: argparse.Namespace, temperature: float = 0.0, most_tokens: int = 600) -> calls.Caller | None:
    """The model ``package.module:function`` of ``--model`` with the settings' tries and waits; none for an empty name.

    Where the function takes keywords ``temperature`` and ``max_tokens``, it is given them. ``--replies`` is the
    folder that keeps replies from one run to the next.
    """
    if not args.model:
        return None
    module, _, function = args.model.partition(":")
    s = load_settings()

    def call(prompt: str, **params: object) -> str | None:
        model = getattr(importlib.import_module(module), function)
        try:
            taken = inspect.signature(model).parameters
        except ValueError:  # of some built-in functions nothing is known
            taken = {}
        return model(prompt, **{k: v for k, v in params.items() if k in taken})

    params = {"temperature": temperature, "max_tokens": most_tokens}
    return calls.Caller(call, args.model, params, args.replies or None, s.call_tasks, s.calls_at_once, s.call_tries, s.call_wait)


def _corpus(spark: SparkSession, args: argparse.Namespace) -> retrieval.Corpus:
    """The stored index; vectors are searched by cells where it has them, unless ``--exact`` is told."""
    cells = ann.load(spark, f"{args.index}/ann") if args.exact == "no" and tables.exists(spark, f"{args.index}/ann/members") else None
    return retrieval.Corpus(tables.table(spark, args.chunks), sparse.load(spark, f"{args.index}/bm25"), tables.table(spark, f"{args.index}/vectors"), ann=cells)


def fetch(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """New papers of the date range from a metadata file; at most max_results of the latest, as the cap comes before the filter."""
    s = load_settings()
    papers, skipped = tables.metadata(spark, args.metadata)
    wanted = papers.where(F.arrays_overlap("categories", F.array(*map(F.lit, s.categories)))).orderBy(F.col("published").desc(), "id").limit(s.max_results)
    wanted = wanted.where(ingest.in_date_range(F.to_timestamp("published"), args.since or s.since, args.until or s.until or None))
    if tables.exists(spark, args.out):
        wanted = ingest.new_papers(wanted, spark.read.schema(tables.METADATA).json(args.out))
    wanted.write.mode("append").json(args.out)
    return skipped.agg(F.count("*").alias("skipped"))


def parse(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pages = tables.table(spark, args.pages)
    ingest.sections(pages, load_settings().min_section_chars).write.mode("overwrite").parquet(args.out)
    return ingest.parse_stats(pages, spark.read.parquet(args.out))


def chunk(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    s, sections = load_settings(), tables.table(spark, args.sections)
    vocabulary = args.vocabulary or s.vocabulary
    tokenizer = subwords.BytePairs(spark, vocabulary, subwords.PATTERNS[s.token_pattern]) if vocabulary else None
    sinks.write_chunks(chunking.chunk_sections(sections, args.strategy, s.chunk_size, s.chunk_overlap, hash_bag, s.breakpoint_percentile, tokenizer), args.out)
    return chunking.chunk_stats(sections, spark.read.parquet(args.out).where(F.col("strategy") == args.strategy))


def index(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    chunks = tables.table(spark, args.chunks)
    sparse.save(sparse.build(chunks), f"{args.out}/bm25")
    n = sinks.write_vectors(hash_bag(chunks, ["chunk_id"]), f"{args.out}/vectors")
    sinks.remove(spark, f"{args.out}/ann")
    if n >= load_settings().ann_min_rows:
        ann.build(tables.table(spark, f"{args.out}/vectors"), f"{args.out}/ann")
    return spark.createDataFrame([(n,)], "chunks long")


def search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    s, corpus, question = load_settings(), _corpus(spark, args), spark.createDataFrame([("q", args.text)], "query_id string, text string")
    hits = retrieval.search(args.config, corpus, question, args.k, _model(args, 0.3, 400), s.n_rewrites, args.fan_out or s.fan_out, args.rrf_k or s.rrf_k).select("chunk_id", "rank")
    return hits.join(corpus.chunks, "chunk_id").select("rank", "chunk_id", preview(F.col("text")).alias("preview")).orderBy("rank")


def eval_retrieval(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    s, corpus = load_settings(), _corpus(spark, args)
    k = s.top_k
    items = tables.eval_items(spark, args.items)
    asked = items.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    wanted = items.select(F.col("id").alias("query_id"), "type", F.col("source_chunk_ids").alias("gold"))
    hits = stored(retrieval.search(args.config, corpus, asked, k, _model(args, 0.3, 400), s.n_rewrites, args.fan_out or s.fan_out, args.rrf_k or s.rrf_k).select("query_id", "chunk_id", "rank"))
    run = metrics.evaluate(hits, wanted, k, args.config, args.strategy)
    now = dt.datetime.now(dt.UTC).isoformat()
    sinks.write_run(metrics.per_query(hits, wanted, k), run, args.out, args.config, args.strategy, k, now)
    sinks.append_text(spark, f"{args.out}/ablation.md", run.select(metrics.ablation_row(F.lit(now))).first()[0])
    return run


def _answers(spark: SparkSession, args: argparse.Namespace, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified answers to the questions, and the passages that they were given."""
    s, corpus = load_settings(), _corpus(spark, args)
    found = retrieval.search(args.config, corpus, questions, s.context_k, _model(args, 0.3, 400), s.n_rewrites, s.fan_out, s.rrf_k).select("query_id", "chunk_id", "rank")
    hits = stored(found.join(corpus.chunks.select("chunk_id", "section_title", "text"), "chunk_id"))
    return stored(retrieval.answer(corpus, questions, _model(args), hits, s.context_k, s.fan_out, s.context_chars, s.quote_min_chars)), hits


def query(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """One question, answered from the passages found, with verified quotes."""
    answered, hits = _answers(spark, args, spark.createDataFrame([("q", args.text)], "query_id string, text string"))
    cited = answered.select("answer", "abstained", F.explode_outer("citations").alias("c"))
    return cited.select("answer", "abstained", F.col("c.chunk_id").alias("chunk_id"), F.col("c.supporting_quote").alias("supporting_quote"))


def generate_evals(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    s = load_settings()
    items = stored(evals.generate_eval_set(tables.table(spark, args.chunks), _model(args), args.single_hop, args.no_answer, args.seed, s.min_chunk_tokens, s.min_confidence, s.min_question_chars, s.min_answer_chars))
    sinks.write_json(items.where("reason IS NULL").drop("reason"), args.out)
    return evals.counters(items)


def eval_generation(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Refusal on the items without an answer."""
    items = tables.eval_items(spark, args.items).where("type = 'no_answer'")
    answered, _ = _answers(spark, args, items.select(F.col("id").alias("query_id"), F.col("question").alias("text")))
    now = dt.datetime.now(dt.UTC).isoformat()
    rows = answered.select(F.col("query_id").alias("id"), "question", F.col("abstained").alias("refused"), "answer", F.size("citations").alias("n_citations"), "citations")
    run = stored(grounding.refusal_rates(answered).select(F.lit(args.config).alias("config"), "*", F.lit(now).alias("timestamp")))
    sinks.write_answers_run("generation", rows, run, args.out, args.config, now)
    return run


def eval_ragas(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Faithfulness and relevance of the answers to a seeded sample of the single_hop items, judged by the model."""
    s, items = load_settings(), evals.seeded_sample(tables.eval_items(spark, args.items).where("type = 'single_hop'"), args.n, args.seed, "id")
    if not items.take(1):
        raise ValueError("no item is single_hop")
    answered, hits = _answers(spark, args, items.select(F.col("id").alias("query_id"), F.col("question").alias("text")))
    context = hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), "\n\n").alias("context"))
    judged = answered.join(context, "query_id", "left").select(F.col("query_id").alias("id"), "question", "answer", "abstained", "context")
    scored = stored(evals.judge(judged, _model(args), hash_bag, s.n_reverse))
    now = dt.datetime.now(dt.UTC).isoformat()
    run = stored(evals.run_means(scored).select(F.lit(args.config).alias("config"), "*", F.lit(now).alias("timestamp")))
    sinks.write_answers_run("ragas", scored, run, args.out, args.config, now)
    return run


COMMANDS = {
    "fetch": (fetch, ["metadata", "out"], {"since": "", "until": ""}),
    "parse": (parse, ["pages", "out"], {}),
    "chunk": (chunk, ["sections", "out"], {"strategy": "recursive", "vocabulary": ""}),
    "index": (index, ["chunks", "out"], {}),
    "search": (search, ["index", "chunks", "text"], {"config": "rerank", "k": 10, "model": "", "fan-out": 0, "rrf-k": 0, "exact": "no", "replies": ""}),
    "query": (query, ["index", "chunks", "text", "model"], {"config": "rerank", "exact": "no", "replies": ""}),
    "eval-retrieval": (eval_retrieval, ["index", "chunks", "items", "out"], {"config": "rerank", "strategy": "recursive", "model": "", "fan-out": 0, "rrf-k": 0, "exact": "no", "replies": ""}),
    "generate-evals": (generate_evals, ["chunks", "out", "model"], {"single-hop": 200, "no-answer": 30, "seed": 42, "replies": ""}),
    "eval-generation": (eval_generation, ["index", "chunks", "items", "out", "model"], {"config": "rerank", "exact": "no", "replies": ""}),
    "eval-ragas": (eval_ragas, ["index", "chunks", "items", "out", "model"], {"config": "rerank", "exact": "no", "replies": "", "n": 30, "seed": 42}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="siltstone")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, required, optional) in COMMANDS.items():
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            p.add_argument(f"--{o}", default=default, type=type(default))
    args = parser.parse_args(argv)
    out = COMMANDS[args.command][0](spark or SparkSession.builder.appName("siltstone").getOrCreate(), args)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
