"""Registered queries over the test tables, each with its SQL where SQL can express it.

Documents stand for chunks, benchmark passages for questions; a question's gold chunks are the
documents that contain it word for word, and questions without any are of type no_answer. Models are
replaced by deterministic stand-ins, so that only the shell around them is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import replies, text, vectors
from siltstone.operators import ann, chunking, containment, dense, evals, fusion, grounding, ingest, latent, metrics, pair_scorer, rerank, rewrite, sparse, subwords
from siltstone.plans import retrieval
from siltstone.sources import sinks, tables
from siltstone.sources.scratch import scratch, stored

Query = Callable[[SparkSession, str], DataFrame]
SQL: dict[str, str] = {}
QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section_title"), "text")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _corpus(spark: SparkSession, sf: str) -> retrieval.Corpus:
    return retrieval.Corpus.of(_chunks(spark, sf))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """``query_id, type, gold``: the gold chunks of a question are the documents that hold its passage."""
    q = _questions(spark, sf)
    found = containment.containing(q, _chunks(spark, sf)).groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("gold"))
    gold = F.coalesce("gold", F.array().cast("array<bigint>"))
    return stored(q.select("query_id").join(found, "query_id", "left").select("query_id", F.when(F.size(gold) > 0, "single_hop").otherwise("no_answer").alias("type"), gold.alias("gold")))


# Parts of the SQL shared by several queries.
SPARSE = """
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
dl AS (SELECT doc_id, len(w) AS dl FROM t),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
r AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), tot),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"""


def _scored(questions: str, name: str, k: int) -> str:
    """CTEs that rank documents for the rows (query_id, text) of a table."""
    return f"""
{name}_q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM {questions}) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, doc_id AS chunk_id, round(sum(qn * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN i USING (term) JOIN p USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL) WHERE score > 0) WHERE rank <= {k})"""


def _bag(table: str, key: str, name: str) -> str:
    """CTE with the hash-bag vector of each row."""
    return f"""
{name}_c AS (SELECT {key} AS id, b, count(*) AS c FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 2))::INT % 32 AS b FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM {table})) GROUP BY ALL),
{name} AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM {name}_c)"""


BENCH = "bq AS (SELECT item_id AS query_id, text FROM benchmark)"
GOLD = """
gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ng AS (SELECT item_id AS query_id, count(g.chunk_id) AS n_gold FROM benchmark b LEFT JOIN gold g ON g.query_id = b.item_id GROUP BY ALL)"""


def _dense(k: int, name: str = "dense", table: str = "benchmark", key: str = "item_id") -> str:
    return f"""{_bag('documents', 'doc_id', 'dv')}, {_bag(table, key, 'qv')},
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.id AS query_id, doc_id AS chunk_id, round(coalesce(sum(q.x * d.x), 0), 6) AS score FROM (SELECT DISTINCT id FROM qv) a CROSS JOIN documents
  LEFT JOIN dv d ON d.id = doc_id LEFT JOIN qv q2 ON q2.id = a.id AND q2.b = d.b, LATERAL (SELECT a.id AS id, q2.x AS x) q GROUP BY ALL)) WHERE rank <= {k})"""


def _per_query(hits: str, k: int) -> str:
    """Per-query metrics of a ranked CTE."""
    return f"""SELECT ng.query_id, n_gold, min(h.rank) AS rank_of_first_gold, (CASE WHEN min(h.rank) IS NULL THEN 0 ELSE 1 END)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(h.rank), 0) AS mrr,
  coalesce(sum(1.0::DOUBLE / log2(h.rank + 1)), 0) / (SELECT sum(1.0::DOUBLE / log2(r + 1)) FROM range(1, 1 + least(any_value(n_gold), {k})::INT) x(r)) AS ndcg
  FROM ng LEFT JOIN (SELECT * FROM {hits} SEMI JOIN gold USING (query_id, chunk_id) WHERE rank <= {k}) h USING (query_id) WHERE n_gold > 0 GROUP BY ng.query_id, n_gold"""


# --- terms, index, search ---


@query("SELECT doc_id, len(w) AS n_terms, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)")
def tokenize_terms(spark, sf):
    t = text.terms(F.coalesce("text", F.lit("")))
    return _read(spark, sf, "documents").select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"WITH {SPARSE} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_idf(spark, sf):
    return sparse.idf(sparse.build(_chunks(spark, sf))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SPARSE}, {BENCH}, {_scored('bq', 's', 10)} SELECT query_id, chunk_id, score, rank FROM s")
def bm25_topk(spark, sf):
    return sparse.search(sparse.build(_chunks(spark, sf)), _questions(spark, sf), 10)


@query(f"WITH {SPARSE}, {BENCH}, {_scored('bq', 's', 1 << 40)} SELECT query_id, count(*) AS n_scored, max(score) AS best, round(avg(score), 3) AS mean FROM s GROUP BY query_id")
def bm25_scored(spark, sf):
    """All chunks that share a term with a question, scored without pruning."""
    every = sparse.score(sparse.build(_chunks(spark, sf)), _questions(spark, sf)).where("score > 0")
    return every.groupBy("query_id").agg(F.count("*").alias("n_scored"), F.max("score").alias("best"), F.round(F.avg("score"), 3).alias("mean"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(array_cosine_similarity(q.embedding::DOUBLE[64], v.embedding::DOUBLE[64]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""
)
def dense_knn(spark, sf):
    v = _read(spark, sf, "embeddings")
    return dense.search(v, v.where("vec_id % 20 = 0"), 10, "vec_id", "embedding", "vec_id", "embedding")


@query()
def ann_topk(spark, sf):
    """The index of cells and codes over all vectors, searched for every twentieth."""
    v = _read(spark, sf, "embeddings")
    return ann.search(ann.build(v, scratch(spark), "vec_id", "embedding"), v.where("vec_id % 20 = 0"), 10, query_col="vec_id", query_vec_col="embedding")


@query("""WITH v AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))
SELECT count(*) AS n_indexed, count_if(vec_id % 20 = 0) AS n_asked, true AS recall_reached FROM v""")
def ann_recall(spark, sf):
    """Whether the index holds every vector and finds at least 0.9 of the ten nearest that comparing all of them finds."""
    v = _read(spark, sf, "embeddings").where("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    asked, index = v.where("vec_id % 20 = 0"), ann.build(v, scratch(spark), "vec_id", "embedding")
    near = ann.search(index, asked, 10, query_col="vec_id", query_vec_col="embedding").select("query_id", "chunk_id", F.lit(1).alias("found"))
    exact = dense.search(v, asked, 10, "vec_id", "embedding", "vec_id", "embedding")
    reached = exact.join(near, ["query_id", "chunk_id"], "left").agg((F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"))
    return index.members.agg(F.count("*").alias("n_indexed"), F.count_if(F.col("chunk_id") % 20 == 0).alias("n_asked")).join(reached)


@query(f"WITH {_dense(10)} SELECT query_id, chunk_id, score, rank FROM dense")
def dense_hash_topk(spark, sf):
    v = vectors.hash_bag(_chunks(spark, sf), ["chunk_id"])
    return dense.search(v, vectors.hash_bag(_questions(spark, sf), ["query_id"]), 10)


_LISTS = f"WITH {SPARSE}, {BENCH}, {_scored('bq', 'sparse', 50)}, {_dense(50)}"
_HYBRID = """
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, d.score AS dense_score, s.rank AS sparse_rank, s.score AS sparse_score,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 8) AS rrf_score FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM f)"""
_RERANK = """
c AS (SELECT h.*, b.text AS question, d.text AS text FROM hybrid h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 50),
x AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM c),
z AS (SELECT query_id, chunk_id, rank AS rrf_rank, rrf_score, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, w)) / len(q), 6) END AS rerank_score FROM x),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS rank FROM z)"""


@query(f"{_LISTS} SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf_score FROM (SELECT query_id, chunk_id, rank FROM sparse UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL")
def rrf_fuse(spark, sf):
    c, q = _corpus(spark, sf), _questions(spark, sf)
    keys = ["query_id", "chunk_id", "rank"]
    lists = retrieval.search_sparse(c, q, 50).select(*keys).unionByName(retrieval.search_dense(c, q, 50).select(*keys))
    return fusion.rrf_scores(lists).withColumn("rrf_score", F.round("rrf_score", 8))


@query(f"{_LISTS}, {_HYBRID} SELECT query_id, chunk_id, dense_rank, dense_score, sparse_rank, sparse_score, rrf_score, rank FROM hybrid WHERE rank <= 10")
def hybrid_topk(spark, sf):
    return retrieval.search_hybrid(_corpus(spark, sf), _questions(spark, sf), 10)


@query(f"{_LISTS}, {_HYBRID}, {_RERANK} SELECT query_id, chunk_id, rrf_rank, rrf_score, rerank_score, rank FROM reranked WHERE rank <= 10")
def rerank_topk(spark, sf):
    return retrieval.search_reranked(_corpus(spark, sf), _questions(spark, sf), 10).select("query_id", "chunk_id", "rrf_rank", "rrf_score", "rerank_score", "rank")


def _rewrites(spark, sf):
    """The first half of each question as a stand-in for a model's rewrite."""
    q = _questions(spark, sf)
    half = F.expr("substring(text, 1, cast(round(length(text) / 2) as int))")
    return q.select("query_id", F.col("text").alias("question"), F.array(half, F.concat(F.lit(" "), F.col("text")), F.lit(" ")).alias("rewrites"))


@query("""WITH x AS (SELECT item_id AS query_id, trim(text, ' ' || chr(10)) AS a, trim(left(text, round(length(text) / 2.0)::INT), ' ' || chr(10)) AS b FROM benchmark)
SELECT query_id, CASE WHEN b = '' OR lower(a) = lower(b) THEN [a] ELSE [a, b] END AS queries FROM x""")
def rewrite_union(spark, sf):
    return _rewrites(spark, sf).select("query_id", rewrite.distinct_queries(F.col("question"), F.col("rewrites")).alias("queries"))


@query(f"""WITH {SPARSE}, x AS (SELECT item_id AS query_id, trim(text, ' ' || chr(10)) AS a, trim(left(text, round(length(text) / 2.0)::INT), ' ' || chr(10)) AS b FROM benchmark),
sq AS (SELECT query_id * 2 AS query_id, a AS text FROM x UNION ALL SELECT query_id * 2 + 1, b FROM x WHERE b <> '' AND lower(a) <> lower(b)), {_scored('sq', 's', 10)},
o AS (SELECT query_id // 2 AS query_id, query_id % 2 AS query_no, chunk_id, rank, score FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY query_no, rank) AS n FROM o)
SELECT query_id, chunk_id, query_no::INT AS query_no, score, row_number() OVER (PARTITION BY query_id ORDER BY query_no, rank) AS position FROM f WHERE n = 1""")
def multi_query_candidates(spark, sf):
    sub = rewrite.sub_queries(_rewrites(spark, sf)).select((F.col("query_id") * 2 + F.col("query_no")).alias("query_id"), "text")
    hits = sparse.search(sparse.build(_chunks(spark, sf)), sub, 10)
    flat = hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).cast("int").alias("query_no"), "chunk_id", "rank", "score")
    return fusion.first_seen(flat).select("query_id", "chunk_id", "query_no", "score", "position")


# --- evaluation of retrieval ---


@query(f"WITH {SPARSE}, {BENCH}, {GOLD}, {_scored('bq', 's', 10)} SELECT query_id, n_gold, rank_of_first_gold, recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ({_per_query('s', 10)})")
def ndcg_per_query(spark, sf):
    return metrics.per_query(retrieval.search_sparse(_corpus(spark, sf), _questions(spark, sf), 10), _items(spark, sf), 10)


def _means(config: str, hits: str) -> str:
    return f"""SELECT '{config}' AS config_name, 'documents' AS strategy, 10 AS top_k, count(*) AS n_evaluated, (SELECT count(*) FROM ng WHERE n_gold = 0) AS n_no_answer,
  round(avg(recall), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr_at_k, round(avg(ndcg), 6) AS ndcg_at_k FROM ({_per_query(hits, 10)})"""


@query(f"WITH {SPARSE}, {BENCH}, {GOLD}, {_scored('bq', 's', 10)} {_means('sparse', 's')}")
def retrieval_eval(spark, sf):
    return metrics.evaluate(retrieval.search_sparse(_corpus(spark, sf), _questions(spark, sf), 10), _items(spark, sf), 10, "sparse", "documents")


_ABLATION = f"{_LISTS}, {_HYBRID}, {_RERANK}, {GOLD}, runs AS ({_means('sparse', 'sparse')} UNION ALL {_means('dense', 'dense')} UNION ALL {_means('hybrid', 'hybrid')} UNION ALL {_means('rerank', 'reranked')})"


@query(f"{_ABLATION} SELECT * FROM runs")
def retrieval_ablation(spark, sf):
    c, q, items = _corpus(spark, sf), _questions(spark, sf), _items(spark, sf)
    out = None
    for name, hits in retrieval.compared(c, q, 10).items():
        one = metrics.evaluate(hits, items, 10, name, "documents")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SPARSE}, {BENCH}, {GOLD}, {_scored('bq', 's', 10)}, m AS ({_means('sparse', 's')})
SELECT printf('| %s | %s | %d | %.3f | %.3f | %.3f | %d | %s |', config_name, strategy, top_k, recall_at_k, mrr_at_k, ndcg_at_k, n_evaluated, '2024-05-01T10:20') AS "row" FROM m""")
def ablation_row(spark, sf):
    return retrieval_eval(spark, sf).select(metrics.ablation_row(F.lit("2024-05-01T10:20:30")).alias("row"))


@query("SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passages_contained(spark, sf):
    return containment.containing(_questions(spark, sf), _chunks(spark, sf))


# --- fitted models ---


@query(f"""WITH {SPARSE}, top AS (SELECT term FROM r ORDER BY df DESC, term LIMIT 30000), k AS (SELECT doc_id, count(*) AS n FROM p SEMI JOIN top USING (term) GROUP BY doc_id)
SELECT doc_id, least(128, (SELECT count(*) FROM top))::INTEGER AS dims, (coalesce(n, 0) > 0)::INTEGER::DOUBLE AS length FROM documents LEFT JOIN k USING (doc_id)""")
def latent_vectors(spark, sf):
    """A vector for every document by the embedder fitted to all of them."""
    c = _chunks(spark, sf)
    made = latent.fit(c)(c, ["chunk_id"], "text")
    return made.select(F.col("chunk_id").alias("doc_id"), F.size("vector").alias("dims"), F.round(vectors.norm(F.col("vector")), 6).alias("length"))


@query(f"WITH {GOLD} SELECT count(*) AS n_evaluated, true AS above_hash_bag FROM ng WHERE n_gold > 0")
def latent_recall(spark, sf):
    """Whether the fitted embedder finds more gold documents among the first ten than the hash bag."""
    c, q, items = _chunks(spark, sf), _questions(spark, sf), _items(spark, sf)
    model = latent.fit(c)
    runs = [metrics.evaluate(dense.search(e(c, ["chunk_id"], "text"), e(q, ["query_id"], "text"), 10), items, 10, n) for e, n in ((model, "fitted"), (vectors.hash_bag, "bag"))]
    fitted, bag = (r.select("n_evaluated", F.col("recall_at_k").alias(f"r{i}")) for i, r in enumerate(runs))
    return fitted.join(bag, "n_evaluated").select("n_evaluated", (F.col("r0") > F.col("r1")).alias("above_hash_bag"))


@query(f"WITH {GOLD} SELECT count(*) AS n_held_out, true AS not_below_overlap FROM ng WHERE n_gold > 0 AND query_id % 3 = 1")
def pair_scorer_mrr(spark, sf):
    """A scorer fitted to the candidates of two thirds of the questions, on those of the rest: whether gold documents stand higher than by shared terms.

    Asked are six words in a row of each passage, which many documents share one by one.
    """
    c, items = _corpus(spark, sf), _items(spark, sf)
    q = _questions(spark, sf).select("query_id", F.array_join(F.slice(F.split("text", r"\s+"), 4, 6), " ").alias("text"))
    gold = items.select("query_id", F.explode("gold").alias("chunk_id"), F.lit(1).alias("label"))
    found = retrieval._texts(c, retrieval.search_sparse(c, q, 50).select("query_id", "chunk_id", "rank"), q)
    pairs = stored(found.join(gold, ["query_id", "chunk_id"], "left").withColumn("label", F.coalesce("label", F.lit(0))))
    held = F.col("query_id") % 3 == 1
    model = pair_scorer.fit(pairs.where(~held))
    kept = items.where(held)
    runs = [metrics.evaluate(rerank.rerank(pairs.where(held), 10, s), kept, 10, n).select("n_evaluated", F.col("mrr_at_k").alias(n)) for s, n in ((model.scorer(), "fitted"), (rerank.overlap, "overlap"))]
    return runs[0].join(runs[1], "n_evaluated").select(F.col("n_evaluated").alias("n_held_out"), (F.col("fitted") >= F.col("overlap")).alias("not_below_overlap"))


# --- ingest ---


@query("SELECT DISTINCT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def incremental_new_docs(spark, sf):
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return ingest.new_papers(docs, _read(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL")
def date_range_filter(spark, sf):
    return _read(spark, sf, "events").where(ingest.in_date_range(F.col("ts"), "2024-01-05", "2024-01-20")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH u AS (SELECT page_id, string_split(url, '/') AS s FROM pages) SELECT page_id, s[-1] AS id, 'cat:' || s[4] || ' OR cat:web' AS query FROM u""")
def paper_ids(spark, sf):
    lang = F.get(F.split("url", "/"), 3)
    return _read(spark, sf, "pages").select("page_id", ingest.paper_id(F.col("url")).alias("id"), ingest.query_string(F.array(lang, F.lit("web"))).alias("query"))


#: Known names of headers that end no paper.
_NAMES = [n for n in ingest.NAMED if not n.lower().startswith(ingest.ENDS)]


def _paged(spark, sf):
    """Documents as page texts with headers and page furniture put in by line number, and in each third an end section before the last line."""
    last = F.size(F.split("text", "\n", -1)) - 1
    line = lambda x, i: F.concat_ws(
        "\n",
        F.when(i % 4 == 0, F.concat((i / 4 + 1).cast("int").cast("string"), F.lit(". Results and Setup"))).when(i % 4 == 2, F.lit("  Related Work: ")),
        F.when((i == last) & (F.col("doc_id") % 3 == 0), F.lit("IX. References")),
        F.when(i % 5 == 3, F.upper(F.element_at(F.array(*map(F.lit, _NAMES)), ((F.col("doc_id") + i) % len(_NAMES) + 1).cast("int")))),
        x,
        F.when(i % 3 == 0, F.lit("Page 3 of 9")).when(i % 3 == 1, F.lit("arXiv:2401.00001v2 [cs.LG]")),
    )
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("page_num"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


PAGED = f"""
d0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) - 1 AS last FROM documents),
d1 AS (SELECT doc_id, i, unnest([CASE WHEN i % 4 = 0 THEN (i // 4 + 1)::VARCHAR || '. Results and Setup' WHEN i % 4 = 2 THEN '  Related Work: ' END, CASE WHEN i = last AND doc_id % 3 = 0 THEN 'IX. References' END, CASE WHEN i % 5 = 3 THEN upper([{', '.join(repr(n) for n in _NAMES)}][(doc_id + i) % {len(_NAMES)} + 1]) END, x, CASE WHEN i % 3 = 0 THEN 'Page 3 of 9' WHEN i % 3 = 1 THEN 'arXiv:2401.00001v2 [cs.LG]' END]) AS line, unnest([0, 1, 2, 3, 4]) AS j FROM d0),
lines AS (SELECT doc_id AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS line_no, line FROM d1 WHERE line IS NOT NULL),
clean AS (SELECT * FROM lines WHERE NOT (regexp_full_match(line, '\\s*\\d+\\s*') OR regexp_full_match(line, '(?i)\\s*page\\s+\\d+(\\s+of\\s+\\d+)?\\s*') OR regexp_matches(line, '(?i)^\\s*arxiv:\\d+\\.\\d+v?\\d*') OR regexp_full_match(line, '(?i)\\s*preprint\\.?\\s*') OR regexp_full_match(line, '(?i)\\s*under review.*'))),
titled AS (SELECT *, CASE WHEN trim(line) = '' OR length(trim(line)) > 100 THEN NULL WHEN regexp_full_match(trim(line), '\\d+(\\.\\d+)*\\.?\\s+[A-Z][\\p{{L}}\\p{{N}}_\\s\\-:&,/'']{{1,80}}') THEN regexp_extract(trim(line), '^(\\d+(?:\\.\\d+)*\\.?)', 1) || ' ' || trim(regexp_extract(trim(line), '^\\d+(?:\\.\\d+)*\\.?\\s+(.*)$', 1))
  WHEN regexp_full_match(trim(line), '[IVX]+\\.?\\s+[A-Z][\\p{{L}}\\p{{N}}_\\s\\-:&,/'']{{1,80}}') THEN regexp_extract(trim(line), '^([IVX]+\\.?)', 1) || ' ' || trim(regexp_extract(trim(line), '^[IVX]+\\.?\\s+(.*)$', 1))
  {' '.join(f"WHEN lower(trim(rtrim(trim(line), ':'))) = '{n.lower()}' THEN '{n}'" for n in ingest.NAMED)} END AS title FROM clean),
ended AS (SELECT *, coalesce(regexp_matches(lower(regexp_replace(title, '^[\\dIVX.\\s]+', '')), '^(references|bibliography|acknowledgments|acknowledgements)'), false) AS ends FROM titled),
placed AS (SELECT *, max(ends::INT) OVER w AS stopped, count(title) OVER w AS no FROM ended WINDOW w AS (PARTITION BY paper_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
body AS (SELECT paper_id, no, coalesce(max(title), 'Preamble') AS section_title, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (title IS NULL), ''), chr(10) || ' ') AS text FROM placed WHERE stopped = 0 GROUP BY ALL),
sections AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY no) - 1 AS section_index, section_title, text, length(text) AS char_count FROM body WHERE length(text) >= 50)"""


@query(f"WITH {PAGED} SELECT paper_id, section_index, section_title, text, char_count FROM sections")
def sections_segment(spark, sf):
    return ingest.sections(_paged(spark, sf)).select("paper_id", "section_index", "section_title", "text", "char_count")


@query(f"WITH {PAGED} SELECT title, ends, count(*) AS n FROM ended WHERE title IS NOT NULL GROUP BY ALL")
def headers_detect(spark, sf):
    lines = ingest.page_lines(_paged(spark, sf)).where(~ingest.is_artifact(F.col("line"))).withColumn("title", ingest.header_title(F.col("line")))
    return lines.where("title IS NOT NULL").groupBy("title", ingest.is_end(F.col("title")).alias("ends")).agg(F.count("*").alias("n"))


@query(f"WITH {PAGED} SELECT l.paper_id, count(*) AS n_lines, count(*) - (SELECT count(*) FROM clean c WHERE c.paper_id = l.paper_id) AS n_artifacts FROM lines l GROUP BY l.paper_id")
def artifacts_drop(spark, sf):
    return ingest.page_lines(_paged(spark, sf)).groupBy("paper_id").agg(F.count("*").alias("n_lines"), F.count_if(ingest.is_artifact(F.col("line"))).alias("n_artifacts"))


@query(f"WITH {PAGED} SELECT count(DISTINCT paper_id) AS papers_parsed, (SELECT count(DISTINCT doc_id) FROM documents) - count(DISTINCT paper_id) AS papers_failed, count(*) AS total_sections FROM sections")
def parse_stats(spark, sf):
    pages = _paged(spark, sf)
    return ingest.parse_stats(pages, ingest.sections(pages))


# --- chunking ---


def _sections(spark, sf):
    return _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(0).alias("section_index"), F.col("source").alias("section_title"), "text")


PIECES = r"'[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+'"
FIXED = f"""
x AS (SELECT doc_id, regexp_extract_all(text, {PIECES}) AS t FROM documents WHERE trim(text, chr(10) || ' ') <> ''),
w AS (SELECT doc_id, t, unnest(generate_series(0, greatest(0, ceil((len(t) - 128) / 112.0))::BIGINT)) AS i FROM x),
c AS (SELECT doc_id, i AS chunk_index, array_to_string(t[i * 112 + 1:i * 112 + 128], '') AS text, least(128, len(t) - i * 112) AS token_count FROM w)"""


@query(f"WITH {FIXED} SELECT doc_id || '::0::' || chunk_index AS chunk_id, chunk_index, length(text) AS char_count, token_count, md5(text) AS digest FROM c")
def chunk_fixed(spark, sf):
    return chunking.chunk_sections(_sections(spark, sf), "fixed", 128, 16).select("chunk_id", "chunk_index", "char_count", "token_count", F.md5("text").alias("digest"))


def _byte_pairs(spark):
    import public_tokenizers

    return subwords.BytePairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query()
def chunk_subwords(spark, sf):
    """Recursive chunks by the tokens of a byte-pair vocabulary."""
    made = chunking.chunk_sections(_sections(spark, sf), "recursive", 128, 16, tokenizer=_byte_pairs(spark))
    return made.select("chunk_id", "chunk_index", "char_count", "token_count", F.md5("text").alias("digest"))


@query("SELECT doc_id, length(coalesce(text, ''))::INTEGER AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def subword_fragments(spark, sf):
    """The fragments of recursive splitting by byte pairs, joined again: every text comes back whole."""
    joined = F.array_join(_byte_pairs(spark).fragments(F.coalesce("text", F.lit("")), 64), "")
    return _read(spark, sf, "documents").select("doc_id", joined.alias("text")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    f"""WITH {FIXED}, s AS (SELECT list_sort(list(token_count)) AS l, count(*) AS n, round(avg(token_count), 1) AS mean_tokens, median(token_count)::DOUBLE AS median_tokens FROM c)
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS papers, (SELECT count(*) FROM documents) AS sections, n AS chunks, mean_tokens, median_tokens, l[1 + floor(0.9::DOUBLE * (n - 1))::INT] AS p90_tokens, l[1 + floor(0.99::DOUBLE * (n - 1))::INT] AS p99_tokens FROM s"""
)
def chunk_stats(spark, sf):
    s = _sections(spark, sf)
    return chunking.chunk_stats(s, chunking.chunk_sections(s, "fixed", 128, 16))


def _recursive_sql(size: int, overlap: int, table: str = "documents", cols: str = "doc_id, source") -> str:
    """CTEs that end in ``rc`` (the named columns and ``l``): each text's chunks by recursive splitting, in list expressions."""
    levels, last = [], "fr0"
    for i, sep in enumerate(chunking.SEPARATORS):
        x = _literal(sep)
        parts = f"list_filter(list_transform(string_split(f, {x}), lambda p, j: CASE WHEN j < len(string_split(f, {x})) THEN p || {x} ELSE p END), lambda p: p <> '')"
        levels.append(f"fr{i + 1} AS (SELECT {cols}, text, flatten(list_transform(l, lambda f: CASE WHEN len(regexp_extract_all(f, {PIECES})) <= {size} OR NOT contains(f, {x}) THEN [f] ELSE {parts} END)) AS l FROM {last})")
        last = f"fr{i + 1}"
    tokens = f"regexp_extract_all(f, {PIECES})"
    cut = f"list_transform(generate_series(0, (len({tokens}) - 1) // {size}), lambda w: array_to_string(({tokens})[w * {size} + 1:(w + 1) * {size}], ''))"
    return f"""
fr0 AS (SELECT {cols}, text, [text] AS l FROM {table} WHERE trim(text, ' ' || chr(10)) <> ''), {', '.join(levels)},
fc AS (SELECT {cols}, text, list_filter(flatten(list_transform(l, lambda f: CASE WHEN len({tokens}) <= {size} THEN [f] ELSE {cut} END)), lambda f: f <> '') AS l FROM {last}),
mg AS (SELECT {cols}, text, list_reduce(list_transform(l, lambda f: {{'done': []::VARCHAR[], 't': f, 'n': len({tokens})}}), lambda a, b: CASE WHEN a.n + b.n <= {size} THEN {{'done': a.done, 't': a.t || b.t, 'n': a.n + b.n}} ELSE {{'done': list_append(a.done, a.t), 't': b.t, 'n': b.n}} END) AS m FROM fc),
kp AS (SELECT {cols}, text, list_filter(list_append(m.done, m.t), lambda c: trim(c, ' ' || chr(10)) <> '') AS k FROM mg),
rc AS (SELECT {cols}, CASE WHEN len(regexp_extract_all(text, {PIECES})) <= {size} THEN [text] ELSE list_transform(k, lambda c, i: CASE WHEN i = 1 THEN c ELSE array_to_string(regexp_extract_all(k[i - 1], {PIECES})[greatest(1, len(regexp_extract_all(k[i - 1], {PIECES})) - {overlap} + 1):], '') || c END) END AS l FROM kp)"""


def _literal(s: str) -> str:
    """A string as SQL."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""WITH {_recursive_sql(128, 16)} SELECT doc_id || '::0::' || (i - 1) AS chunk_id, doc_id::VARCHAR AS paper_id, 0 AS section_index, source AS section_title, (i - 1)::INT AS chunk_index, l[i] AS text, length(l[i]) AS char_count, len(regexp_extract_all(l[i], {PIECES})) AS token_count, 'recursive' AS strategy
FROM (SELECT doc_id, source, l, unnest(generate_series(1, len(l))) AS i FROM rc)""")
def chunk_recursive(spark, sf):
    return chunking.chunk_sections(_sections(spark, sf), "recursive", 128, 16)


@query("SELECT doc_id, replace(left(text, 200), chr(10), ' ') AS preview FROM documents")
def chunk_preview(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


# --- grounding ---

CONTEXT = f"""{SPARSE}, {BENCH}, {_scored('bq', 's', 3)},
ctx AS (SELECT s.query_id, s.rank, s.chunk_id, d.source AS section_title, d.text, left(bq.text, 60) AS quote, bq.text AS question FROM s JOIN documents d ON d.doc_id = s.chunk_id JOIN bq USING (query_id))"""
MATCH = "length(trim(quote, ' ' || chr(10))) >= 15 AND contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g')))"


def _contexts(spark, sf):
    hits = sparse.search(sparse.build(_chunks(spark, sf)), _questions(spark, sf), 3)
    return hits.join(_chunks(spark, sf), "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))


def _replies(spark, sf):
    """For each question a reply, in a fence, that cites its passages: each twice, with a quote that is the question's beginning, and an unknown one."""
    q = _questions(spark, sf).select("query_id", F.substring("text", 1, 60).alias("quote"), F.col("text").alias("question"))
    cite = F.struct(F.col("chunk_id"), F.col("quote").alias("supporting_quote"))
    wrong = F.struct(F.col("chunk_id"), F.lit("too short").alias("supporting_quote"))
    each = _contexts(spark, sf).join(q, "query_id").groupBy("query_id", "question", "quote").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", wrong.alias("w"), cite.alias("c")))), lambda x: F.array(x["w"], x["c"], x["c"]))).alias("l"))
    unknown = F.array(F.struct(F.lit("none").alias("chunk_id"), F.col("quote").alias("supporting_quote")))
    body = F.to_json(F.struct(F.substring("question", 1, 40).alias("answer"), (F.col("query_id") % 7 == 0).alias("abstained"), F.concat("l", unknown).alias("citations")))
    return each.select("query_id", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")).alias("raw"))


@query(f"WITH {CONTEXT} SELECT query_id, chunk_id::VARCHAR AS chunk_id, {MATCH} AS verified FROM ctx")
def quote_verify(spark, sf):
    q = _questions(spark, sf).select("query_id", F.substring("text", 1, 60).alias("quote"))
    return _contexts(spark, sf).join(q, "query_id").select("query_id", "chunk_id", grounding.quoted(F.col("quote"), F.col("text")).alias("verified"))


@query(f"WITH {CONTEXT} SELECT query_id, chunk_id::VARCHAR AS chunk_id, ((rank - 1) * 3 + 1)::INT AS pos, trim(quote, ' ' || chr(10)) AS supporting_quote FROM ctx WHERE {MATCH}")
def citation_dedupe(spark, sf):
    parsed = _replies(spark, sf).select("query_id", replies.json_object(F.col("raw")).alias("reply"))
    return grounding.verified(grounding.citations(parsed), _contexts(spark, sf)).select("query_id", "chunk_id", "pos", "supporting_quote")


ANSWERS = f"""{CONTEXT},
good AS (SELECT query_id, count(*) AS n FROM ctx WHERE {MATCH} GROUP BY ALL),
ans AS (SELECT bq.query_id, bq.text AS question, CASE WHEN (SELECT count(*) FROM ctx WHERE ctx.query_id = bq.query_id) = 0 THEN '(no passages were retrieved)' ELSE trim(left(bq.text, 40), ' ' || chr(10)) END AS answer, coalesce(good.n, 0) AS n_citations, coalesce(good.n, 0) = 0 OR bq.query_id % 7 = 0 AS abstained FROM bq LEFT JOIN good USING (query_id))"""


def _answers(spark, sf):
    q = _questions(spark, sf).select("query_id", F.col("text").alias("question"))
    return grounding.answers(q, _contexts(spark, sf), _replies(spark, sf))


@query(f"WITH {ANSWERS} SELECT query_id, answer, n_citations, abstained FROM ans")
def abstention(spark, sf):
    return _answers(spark, sf).select("query_id", "answer", F.size("citations").cast("long").alias("n_citations"), "abstained")


@query(f"WITH {ANSWERS}, {GOLD} SELECT count(*) AS n, round(avg(abstained::INT), 6) AS refusal_accuracy, round(avg((NOT abstained AND n_citations > 0)::INT), 6) AS false_grounding_rate FROM ans JOIN ng USING (query_id) WHERE n_gold = 0")
def refusal_rate(spark, sf):
    none = _items(spark, sf).where("type = 'no_answer'").select("query_id")
    rates = grounding.refusal_rates(_answers(spark, sf).join(none, "query_id"))
    return rates.select("n", F.round("refusal_accuracy", 6).alias("refusal_accuracy"), F.round("false_grounding_rate", 6).alias("false_grounding_rate"))


@query(f"""WITH {CONTEXT} SELECT query_id, string_agg('[' || rank || '] chunk_id: ' || chunk_id || chr(10) || '    section: ' || section_title || chr(10) || '    text: ' || CASE WHEN length(text) > 1500 THEN left(text, 1500) || '...' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS context FROM ctx GROUP BY ALL""")
def context_format(spark, sf):
    hits = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "section_title", "text"))), lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["section_title"].alias("section_title"), h["text"].alias("text")))
    return _contexts(spark, sf).groupBy("query_id").agg(hits.alias("hits")).select("query_id", grounding.context(F.col("hits")).alias("context"))


# --- replies, evaluation sets, judging ---

PAIRS = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _pairs(spark, sf):
    c = _read(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "question", "answer")


@query(f"WITH {PAIRS} SELECT id, trim(answer, ' ' || chr(10)) AS answer, (conv_id % 3 = 0) AS abstained, conv_id % 5 = 0 AS flagged FROM pairs")
def llm_json_object(spark, sf):
    body = F.to_json(F.struct("answer", (F.col("conv_id") % 3 == 0).alias("abstained"), F.when(F.col("conv_id") % 5 == 0, F.lit("false")).otherwise(F.lit("")).alias("flag")))
    parsed = _pairs(spark, sf).select("id", replies.json_object(F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone."))).alias("o"))
    return parsed.select("id", replies.text_field(F.col("o"), "$.answer").alias("answer"), replies.truthy(F.try_variant_get("o", "$.abstained", "variant")).alias("abstained"), replies.truthy(F.try_variant_get("o", "$.flag", "variant")).alias("flagged"))


@query(f"WITH {PAIRS}, x AS (SELECT id, list_filter(string_split(question, ' '), lambda s: trim(s) <> '') AS w FROM pairs) SELECT id, len(w) AS n_strings, array_to_string(w[1:3], '|') AS first_three FROM x")
def llm_json_array(spark, sf):
    body = F.to_json(F.split("question", " "))
    raw = F.concat(F.lit("Rewrites: "), F.regexp_replace(body, r"\]$", ', 1, null, " ", {"a": 2}]'))
    got = _pairs(spark, sf).select("id", replies.strings(raw).alias("s"))
    return got.select("id", F.size("s").alias("n_strings"), F.array_join(F.slice("s", 1, 3), "|").alias("first_three"))


REASON = """CASE WHEN confidence < 0.6 THEN printf('low confidence (%.2f)', confidence) WHEN length(question) < 15 THEN 'question too short' WHEN length(answer) < 20 THEN 'answer too short'
  WHEN NOT ends_with(question, '?') THEN 'question doesn''t end with ''?''' WHEN contains(lower(answer), lower(question)) THEN 'question is a direct quote from chunk' END"""
JUDGED = f"{PAIRS}, judged AS (SELECT id, {REASON} AS reason FROM (SELECT id, CASE WHEN turn % 2 = 0 THEN question ELSE rtrim(question, '.') || '?' END AS question, answer, (conv_id % 10) / 10.0::DOUBLE AS confidence FROM pairs))"


def _judged(spark, sf):
    q = F.when(F.col("turn") % 2 == 0, F.col("question")).otherwise(F.concat(F.regexp_replace("question", r"\.+$", ""), F.lit("?")))
    rows = _pairs(spark, sf).select("id", q.alias("q"), "answer", ((F.col("conv_id") % 10) / 10).alias("confidence"))
    return rows.select("id", evals.reject_reason(F.col("q"), F.col("answer"), F.col("confidence"), F.col("answer")).alias("reason"))


@query(f"WITH {JUDGED} SELECT id, reason FROM judged")
def eval_quality_filter(spark, sf):
    return _judged(spark, sf)


@query(f"""WITH {JUDGED} SELECT count(*) AS generated, count(*) FILTER (reason IS NULL) AS kept, 0::BIGINT AS filtered_parse_failed, count(*) FILTER (starts_with(reason, 'low confidence')) AS filtered_low_confidence,
  count(*) FILTER (reason IS NOT NULL AND NOT starts_with(reason, 'low confidence')) AS filtered_other, 0::BIGINT AS errors FROM judged""")
def eval_counters(spark, sf):
    return evals.counters(_judged(spark, sf))


@query("SELECT doc_id AS chunk_id, md5('42:' || doc_id) AS digest FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def sample_seeded(spark, sf):
    return evals.seeded_sample(_chunks(spark, sf), 50, 42).select("chunk_id", F.md5(F.concat(F.lit("42:"), F.col("chunk_id").cast("string"))).alias("digest"))


FAITH = f"""{PAIRS}, cl AS (SELECT id, question, unnest(list_filter(list_transform(string_split(answer, '. '), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')) AS claim FROM pairs),
fs AS (SELECT p.id, count(c.id) AS n_claims, count(*) FILTER (contains(lower(c.question), lower(c.claim)) OR length(c.claim) % 3 = 0) AS n_supported FROM pairs p LEFT JOIN cl c ON c.id = p.id GROUP BY ALL),
ff AS (SELECT id, n_claims, CASE WHEN n_claims = 0 THEN 0 ELSE n_supported END AS n_supported, round(CASE WHEN n_claims = 0 THEN 1 ELSE n_supported / n_claims END, 6)::DOUBLE AS faithfulness FROM fs)"""


def _faithful(spark, sf):
    """Sentences as claims; a claim counts as supported if the question holds it or its length is a multiple of three."""
    pairs = _pairs(spark, sf)
    listed = evals.claims(pairs.select("id", F.to_json(F.split("answer", r"\. ", -1)).alias("raw")))
    said = listed.join(pairs.select("id", "question"), "id")
    ok = F.contains(F.lower("question"), F.lower("claim")) | (F.length("claim") % 3 == 0)
    verdict = F.concat(F.lit('{"supported": '), ok.cast("string"), F.lit("}"))
    return evals.faithfulness(pairs, said.select("id", evals.supported(verdict).alias("supported")))


@query(f"WITH {FAITH} SELECT * FROM ff")
def faithfulness(spark, sf):
    return _faithful(spark, sf)


RELEVANCE = f"""
qt AS (SELECT id, question AS text FROM pairs), rt AS (SELECT id * 100 + n AS id, text FROM (SELECT id, unnest(string_split(answer, '. ')[1:3]) AS text, generate_subscripts(string_split(answer, '. ')[1:3], 1) AS n FROM pairs)),
{_bag('qt', 'id', 'qb')}, {_bag('rt', 'id', 'rb')},
cs AS (SELECT rt.id, rt.id // 100 AS qid, coalesce(sum(qb.x * rb.x), 0) AS cos FROM rt LEFT JOIN rb ON rb.id = rt.id LEFT JOIN qb ON qb.id = rt.id // 100 AND qb.b = rb.b GROUP BY ALL),
rel AS (SELECT p.id, count(c.id) AS n_questions, round(coalesce(avg(c.cos), 0), 6) AS relevance FROM pairs p LEFT JOIN cs c ON c.qid = p.id GROUP BY ALL)"""


def _relevance(spark, sf):
    pairs = _pairs(spark, sf)
    reverse = pairs.select("id", F.posexplode(F.slice(F.split("answer", r"\. ", -1), 1, 3)).alias("n", "text"))
    return evals.answer_relevance(vectors.hash_bag(pairs.withColumnRenamed("question", "text"), ["id"]), vectors.hash_bag(reverse, ["id", "n"]))


@query(f"WITH {PAIRS}, {RELEVANCE} SELECT * FROM rel")
def answer_relevance(spark, sf):
    return _relevance(spark, sf)


@query(
    f"""WITH {FAITH}, {RELEVANCE}, j AS (SELECT id, relevance, CASE WHEN id % 4 = 0 THEN 1 ELSE faithfulness END AS f, id % 4 = 0 AS abstained FROM ff JOIN rel USING (id))
SELECT count(*) AS n, count(*) FILTER (abstained) AS n_abstained, round(avg(f), 6) AS mean_faithfulness, round(avg(relevance), 6) AS mean_relevance,
  round(coalesce(avg(f) FILTER (NOT abstained), 0), 6) AS answered_faithfulness, round(coalesce(avg(relevance) FILTER (NOT abstained), 0), 6) AS answered_relevance FROM j"""
)
def ragas_means(spark, sf):
    joined = _faithful(spark, sf).join(_relevance(spark, sf), "id").withColumn("abstained", F.col("id") % 4 == 0)
    return evals.run_means(joined)


_SUB = """x AS (SELECT item_id AS query_id, trim(text, ' ' || chr(10)) AS a, trim(left(text, round(length(text) / 2.0)::INT), ' ' || chr(10)) AS b FROM benchmark),
sq AS (SELECT query_id * 2 AS query_id, a AS text FROM x UNION ALL SELECT query_id * 2 + 1, b FROM x WHERE b <> '' AND lower(a) <> lower(b))"""
_HALF = "sq AS (SELECT item_id * 2 AS query_id, trim(left(text, round(length(text) / 2.0)::INT), ' ' || chr(10)) AS text FROM benchmark)"


def _rewritten(sub: str) -> str:
    """Candidates of all sub-queries, each at its first sighting, reranked against the question."""
    return f"""WITH {SPARSE}, {sub}, {_scored('sq', 'sparse', 50)}, {_dense(50, 'dense', 'sq', 'query_id')}, {_HYBRID},
o AS (SELECT query_id // 2 AS query_id, query_id % 2 AS no, chunk_id, rank FROM hybrid WHERE rank <= 50),
sighted AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY no, rank) AS n FROM o),
g AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY no, rank) AS rrf_rank FROM sighted WHERE n = 1),
y AS (SELECT g.*, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS w FROM g JOIN benchmark b ON b.item_id = g.query_id JOIN documents d ON d.doc_id = g.chunk_id),
v AS (SELECT query_id, chunk_id, rrf_rank, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, w)) / len(q), 6) END AS rerank_score FROM y)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS rank FROM v) WHERE rank <= 10"""


@query(_rewritten(_SUB))
def rewritten_topk(spark, sf):
    """Multi-query search: candidates of all sub-queries, reranked against the original."""
    found = retrieval.search_rewritten(_corpus(spark, sf), _questions(spark, sf), _rewrites(spark, sf).select("query_id", "rewrites"), 10)
    return found.select("query_id", "chunk_id", "rrf_rank", "rerank_score", "rank")


def _asked(prompt, mark: str = "Question: "):
    """The part of a prompt after the mark."""
    return F.element_at(F.split(prompt, mark, 2), 2)


def _half(text_):
    return F.substring(text_, F.lit(1), F.round(F.length(text_) / 2).cast("int"))


def _rest(text_):
    return F.substring(text_, F.round(F.length(text_) / 2).cast("int") + 1, F.length(text_))


@query(_rewritten(_SUB))
def multi_query_topk(spark, sf):
    """As ``rewritten_topk``, with a model that replies with the question's first half, in a fence."""
    model = lambda prompt: F.concat(F.lit("```json\n"), F.to_json(F.array(_half(_asked(prompt)), F.lit(" "))), F.lit("\n```"))
    return retrieval.search_by_model(_corpus(spark, sf), _questions(spark, sf), model, "multi_query", 10).select("query_id", "chunk_id", "rrf_rank", "rerank_score", "rank")


@query(_rewritten(_HALF))
def hyde_topk(spark, sf):
    """HyDE search with a model whose passage is the question's first half."""
    model = lambda prompt: F.concat(F.lit("```\n"), _half(_asked(prompt)), F.lit("\n```"))
    return retrieval.search_by_model(_corpus(spark, sf), _questions(spark, sf), model, "hyde", 10).select("query_id", "chunk_id", "rrf_rank", "rerank_score", "rank")


_JUDGED = f"""{PAIRS}, n AS (SELECT id, question, answer, trim(left(answer, round(length(answer) / 2.0)::INT), ' ' || chr(10)) AS c1, trim(substr(answer, round(length(answer) / 2.0)::INT + 1), ' ' || chr(10)) AS c2, substr(answer, round(length(answer) / 2.0)::INT + 1) AS context FROM pairs WHERE trim(answer, ' ' || chr(10)) <> '')"""


def _judge(prompt):
    """A judge that takes an answer's halves for its claims, believes what the context holds, and asks with the whole answer."""
    answer = F.element_at(F.split(prompt, "\nAnswer: ", 2), 2)
    claims = F.to_json(F.array(_half(answer), _rest(answer)))
    context, claim = F.element_at(F.split(F.element_at(F.split(prompt, "\nClaim: ", 2), 1), "Context: ", 2), 2), F.element_at(F.split(prompt, "\nClaim: ", 2), 2)
    verdict = F.concat(F.lit('{"supported": '), F.contains(context, claim).cast("string"), F.lit("}"))
    reverse = F.to_json(F.array(F.element_at(F.split(prompt, "Answer: ", 2), 2)))
    return F.when(prompt.startswith("List the claims"), claims).when(prompt.startswith("Does the context"), verdict).otherwise(reverse)


def _said(spark, sf):
    """Answers whose context is their second half."""
    return _pairs(spark, sf).select("id", "question", "answer", _rest(F.col("answer")).alias("context"), (F.col("conv_id") % 3 == 0).alias("abstained"))


@query(f"""WITH {_JUDGED}, k AS (SELECT id, context, unnest([c1, c2]) AS claim FROM n), u AS (SELECT id, count(*) AS n_claims, count(*) FILTER (contains(context, claim)) AS n_supported FROM k WHERE claim <> '' GROUP BY id)
SELECT pairs.id, coalesce(n_claims, 0) AS n_claims, coalesce(n_supported, 0) AS n_supported, round(coalesce(n_supported / n_claims, 1), 6) AS faithfulness FROM pairs LEFT JOIN u USING (id)""")
def judge_faithfulness(spark, sf):
    return evals.judge_faithfulness(_said(spark, sf), _judge)


@query(f"""WITH {_JUDGED}, rv AS (SELECT id, trim(answer, ' ' || chr(10)) AS text FROM n), qq AS (SELECT id, question AS text FROM pairs), {_bag('qq', 'id', 'qv')}, {_bag('rv', 'id', 'rvv')},
m AS (SELECT r.id, 1 AS n_questions, round(coalesce((SELECT sum(a.x * b.x) FROM qv a JOIN rvv b ON a.id = b.id AND a.b = b.b WHERE a.id = r.id), 0), 6) AS relevance FROM rv r WHERE r.text <> '')
SELECT pairs.id, coalesce(n_questions, 0)::BIGINT AS n_questions, coalesce(relevance, 0) AS relevance FROM pairs LEFT JOIN m USING (id)""")
def judge_relevance(spark, sf):
    return evals.judge_relevance(_said(spark, sf), _judge, vectors.hash_bag, 3)


_RELEVANT = f"""rv AS (SELECT id, trim(answer, ' ' || chr(10)) AS text FROM n), qq AS (SELECT id, question AS text FROM pairs), {_bag('qq', 'id', 'qv')}, {_bag('rv', 'id', 'rvv')},
m AS (SELECT r.id, round(coalesce((SELECT sum(a.x * b.x) FROM qv a JOIN rvv b ON a.id = b.id AND a.b = b.b WHERE a.id = r.id), 0), 6) AS relevance FROM rv r WHERE r.text <> '')"""


@query(f"""WITH {_JUDGED}, k AS (SELECT id, context, unnest([c1, c2]) AS claim FROM n), u AS (SELECT id, count(*) AS n_claims, count(*) FILTER (contains(context, claim)) AS n_supported FROM k WHERE claim <> '' GROUP BY id), {_RELEVANT}
SELECT pairs.id, conv_id % 3 = 0 AS abstained, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE coalesce(n_claims, 0) END AS n_claims, round(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE coalesce(n_supported / n_claims, 1) END, 6) AS faithfulness, coalesce(relevance, 0) AS relevance
FROM pairs LEFT JOIN u USING (id) LEFT JOIN m USING (id)""")
def judge_answers(spark, sf):
    """Both scores; an abstention is faithful unasked, its relevance is judged."""
    return evals.judge(_said(spark, sf), _judge, vectors.hash_bag, 3).select("id", "abstained", "n_claims", "faithfulness", "relevance")


# --- answers, files ---


@query(f"""WITH {SPARSE}, {BENCH}, {_scored('bq', 's', 3)}, f AS (SELECT query_id, chunk_id, regexp_replace(CASE WHEN length(text) > 1500 THEN left(text, 1500) || '...' ELSE text END, '\\n\\n.*$', '', 's') AS t, text FROM s JOIN documents ON doc_id = chunk_id WHERE rank = 1),
g AS (SELECT *, trim(left(t, 60), ' ' || chr(10)) AS quote FROM f), h AS (SELECT *, length(quote) >= 15 AND contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'))) AS good FROM g)
SELECT bq.query_id, CASE WHEN quote IS NULL THEN '(no passages were retrieved)' ELSE 'It is ' || md5(bq.text) END AS answer, NOT coalesce(good, false) AS abstained, coalesce(good, false)::INTEGER AS n_citations, CASE WHEN good THEN chunk_id END AS cited FROM bq LEFT JOIN h USING (query_id)""")
def pipeline_answers(spark, sf):
    """The whole chain from question to verified answer, with a model that quotes the first passage's beginning."""
    c, q = _corpus(spark, sf), _questions(spark, sf)

    def model(prompt):
        body = F.element_at(F.split(prompt, "\nPassages:\n", 2), 2)
        first, question = F.element_at(F.split(body, "\n\n", 2), 1), F.element_at(F.split(prompt, "\n\nQuestion: ", -1), -1)
        quote = F.substring(F.element_at(F.split(first, "    text: ", 2), 2), 1, 60)
        cited = F.array(F.struct(F.regexp_extract(first, r"^\[1\] chunk_id: (\S+)", 1).alias("chunk_id"), quote.alias("supporting_quote")))
        return F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("It is "), F.md5(question)).alias("answer"), F.lit(False).alias("abstained"), cited.alias("citations"))), F.lit("\n```"))

    hits = retrieval.search_sparse(c, q, 3).join(c.chunks, "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    done = retrieval.answer(c, q, model, stored(hits), 3)
    return done.select("query_id", "answer", "abstained", F.size("citations").alias("n_citations"), F.get("citations", 0)["chunk_id"].cast("long").alias("cited"))


@query("SELECT count_if(doc_id % 7 > 1) AS n_read, count_if(doc_id % 7 <= 1) AS n_skipped, count(DISTINCT CASE WHEN doc_id % 7 > 1 THEN source END) AS n_titles FROM documents")
def metadata_scan(spark, sf):
    """Metadata lines of which some are broken and some have no id."""
    path, d = scratch(spark), _read(spark, sf, "documents")
    line = F.when(F.col("doc_id") % 7 == 0, '{"id": "x", ').when(F.col("doc_id") % 7 == 1, F.to_json(F.struct(F.col("source").alias("title")))).otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"))))
    d.select(line.alias("value")).write.text(path)
    good, bad = tables.metadata(spark, path)
    return good.agg(F.count("*").alias("n_read"), F.count_distinct("title").alias("n_titles")).join(bad.agg(F.count("*").alias("n_skipped")))


@query(f"WITH {GOLD}, g AS (SELECT query_id, n_gold, CASE WHEN n_gold > 0 THEN 'single_hop' ELSE 'no_answer' END AS type FROM ng) SELECT type, count(*) AS n, sum(n_gold)::BIGINT AS n_gold, sum(length(text))::BIGINT AS n_chars, count(*) AS n_without_notes FROM g JOIN benchmark ON item_id = query_id GROUP BY type")
def eval_items_scan(spark, sf):
    """Evaluation items written as lines and read by the strict scan."""
    path = scratch(spark)
    items = _items(spark, sf).join(_questions(spark, sf), "query_id")
    sinks.write_json(items.select(F.col("query_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("").alias("gold_answer"), "type", F.lit("n/a").alias("source_paper_id"), F.col("gold").cast("array<string>").alias("source_chunk_ids")), path)
    read = tables.eval_items(spark, path)
    return read.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("source_chunk_ids")).cast("long").alias("n_gold"), F.sum(F.length("question")).cast("long").alias("n_chars"), F.count_if(F.col("notes") == "").alias("n_without_notes"))


@query(f"WITH {SPARSE}, {BENCH}, {_scored('bq', 's', 5)} SELECT query_id, chunk_id, score, rank FROM s")
def index_round_trip(spark, sf):
    """An index written in two batches and loaded again."""
    path, c = scratch(spark), _chunks(spark, sf)
    for number, part in enumerate((F.col("chunk_id") % 2 == 0, F.col("chunk_id") % 2 != 0)):
        sparse.add(c.where(part), path, number)
    return sparse.search(sparse.load(spark, path), _questions(spark, sf), 5)


@query(f"WITH {SPARSE}, {BENCH}, {GOLD}, {_scored('bq', 's', 10)}, q AS ({_per_query('s', 10)}) SELECT 'sparse_documents_k10_2024-05-01T10-20-30-5+00-00' AS name, count(*) AS n, round(avg(mrr), 6) AS mean_mrr, round(max(avg_mrr), 6) AS mrr_at_k FROM q, (SELECT avg(mrr) AS avg_mrr FROM q)")
def run_files(spark, sf):
    """A run written to its files, by their names, and read again."""
    hits, items, folder = retrieval.search_sparse(_corpus(spark, sf), _questions(spark, sf), 10), _items(spark, sf), scratch(spark)
    name = sinks.write_run(metrics.per_query(hits, items, 10), metrics.evaluate(hits, items, 10, "sparse", "documents"), folder, "sparse", "documents", 10, "2024-05-01T10:20:30.5+00:00")
    rows, run = spark.read.json(f"{folder}/{name}.jsonl"), spark.read.json(f"{folder}/{name}.json")
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mean_mrr")).join(run.select("mrr_at_k"))


@query(f"WITH {SPARSE}, {BENCH}, {GOLD}, {_scored('bq', 's', 10)} SELECT query_id, recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ({_per_query('s', 10)})")
def array_metrics(spark, sf):
    """The metrics of arrays of hits: any hit, reciprocal rank, nDCG."""
    hits = retrieval.search_sparse(_corpus(spark, sf), _questions(spark, sf), 10)
    ranked = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("found"))
    each = _items(spark, sf).where("size(gold) > 0").join(ranked, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    r, g = F.col("found"), F.col("gold")
    return each.select("query_id", metrics.recall(r, g, 10).alias("recall"), F.round(metrics.reciprocal_rank(r, g, 10), 6).alias("mrr"), F.round(metrics.ndcg(r, g, 10), 6).alias("ndcg"))


# --- smaller parts ---

_SENTENCES = """sn AS (SELECT doc_id, list_filter(flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: string_split(regexp_replace(trim(p, ' ' || chr(10)), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))), lambda s: trim(s, ' ' || chr(10)) <> '') AS l FROM documents)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM sn")
def sentences_split(spark, sf):
    s = text.sentences(F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"""WITH {_SENTENCES}, e AS (SELECT doc_id * 100000 + i AS key, doc_id, i, l[i + 1] AS text FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1)) AS i FROM sn WHERE len(l) > 2)), {_bag('e', 'key', 'ev')},
dp AS (SELECT e.doc_id, e.i, 1 - coalesce(sum(a.x * b.x), 0) AS dr FROM e LEFT JOIN ev a ON a.id = key LEFT JOIN ev b ON b.id = key - 1 AND a.b = b.b WHERE e.i > 0 GROUP BY ALL),
lm AS (SELECT doc_id, quantile_cont(dr, 0.95) AS lim FROM dp GROUP BY doc_id)
SELECT doc_id, count(*) AS n, round(avg(dr), 6) AS mean_drop, round(any_value(lim), 6) AS percentile_drop FROM dp JOIN lm USING (doc_id) GROUP BY doc_id""")
def semantic_drops(spark, sf):
    """Drops of similarity between neighbouring sentences, and their percentile, where a section has more than two."""
    each = _read(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).where(F.size("s") > 2).select("doc_id", F.posexplode("s").alias("_i", "_t"))
    found = chunking.breaks(vectors.hash_bag(each, ["doc_id", "_i"], "_t"), ["doc_id"]).where("_drop IS NOT NULL")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("_drop"), 6).alias("mean_drop"), F.round(F.percentile("_drop", 0.95), 6).alias("percentile_drop"))


_KINDS = (("single_hop", "sh", 42, 20), ("no_answer", "na", 43, 10))
_MADE = " UNION ALL ".join(f"""SELECT printf('{prefix}-%04d', no) AS id, 'What does ' || md5(text) || ' say?' AS question, 'It says this: ' || md5(text) AS gold_answer, '{kind}' AS type, doc_id::VARCHAR AS chunk_id, printf('confidence=%.2f', conf) AS notes,
  CASE WHEN conf < 0.6 THEN printf('low confidence (%.2f)', conf) END AS reason FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id::VARCHAR) - 1 AS no, (length(text) % 10) / 10.0::DOUBLE AS conf FROM us) WHERE no < {n}""" for kind, prefix, seed, n in _KINDS)


@query(f"WITH us AS (SELECT doc_id, text FROM documents WHERE len(regexp_extract_all(text, {PIECES})) >= 100) {_MADE}")
def eval_set_items(spark, sf):
    """Generated items, of a model that knows a passage by its digest and doubts it by its length."""
    chunks = _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("paper_id"), "text", text.n_pieces(F.col("text")).alias("token_count"))

    def model(prompt):
        passage = F.element_at(F.split(prompt, "\nPassage: ", 2), 2)
        reply = F.struct(F.concat(F.lit("What does "), F.md5(passage), F.lit(" say?")).alias("question"), F.concat(F.lit("It says this: "), F.md5(passage)).alias("gold_answer"), (F.length(passage) % 10 / 10).alias("confidence"))
        return F.concat(F.lit("Here: "), F.to_json(reply))

    made = evals.generate_eval_set(chunks, model, 20, 10, 42)
    return made.select("id", "question", "gold_answer", "type", F.get("source_chunk_ids", 0).alias("chunk_id"), "notes", "reason")


@query("SELECT conv_id * 1000 + turn AS id, trim(text, ' ' || chr(10)) AS passage, '{\"a\": ' || turn || '}' AS first_object FROM conversations")
def replies_read(spark, sf):
    """A passage out of its fence, and the first flat object of a reply that holds more."""
    c = _read(spark, sf, "conversations")
    fenced = F.concat(F.lit(" ```text\n"), F.col("text"), F.lit("\n```\n"))
    said = F.concat(F.lit('{ {"a": '), F.col("turn").cast("string"), F.lit('} {"b": 2} }'))
    read = F.concat(F.lit('{"a": '), F.try_variant_get(replies.first_flat_object(said), "$.a", "string"), F.lit("}"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), replies.passage(fenced).alias("passage"), read.alias("first_object"))


@query(f"WITH {SPARSE}, bq AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN ' ' || chr(10) ELSE text END AS text FROM benchmark), {_scored('bq', 's', 3)} SELECT query_id, chunk_id, score, rank FROM s")
def blank_questions(spark, sf):
    """Questions that are null or blank retrieve nothing."""
    some = F.when(F.col("query_id") % 3 == 1, " \n").when(F.col("query_id") % 3 == 2, F.col("text"))
    return retrieval.search_sparse(_corpus(spark, sf), _questions(spark, sf).select("query_id", some.alias("text")), 3)


@query("SELECT page_id, page_id % 4 <> 3 AS listed FROM pages")
def pdf_listed(spark, sf):
    papers = _read(spark, sf, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("pdf_path"))
    files = papers.where("page_id % 4 <> 3").select(F.col("pdf_path").alias("path"))
    there, missing = ingest.with_pdf(papers, files)
    return there.select("page_id", F.lit(True).alias("listed")).unionByName(missing.select("page_id", F.lit(False).alias("listed")))


@query(f"SELECT item_id, md5(replace(replace({_literal(rewrite.MULTI_QUERY_PROMPT)}, '{{n}}', '3'), '{{question}}', text)) AS digest FROM benchmark")
def prompts_fill(spark, sf):
    return _read(spark, sf, "benchmark").select("item_id", F.md5(rewrite.fill(rewrite.MULTI_QUERY_PROMPT, n=F.lit("3"), question=F.col("text"))).alias("digest"))


_SEMANTIC = f"""{_SENTENCES}, sx AS (SELECT doc_id, source, text, l, len(l) <= 2 OR len(regexp_extract_all(text, {PIECES})) <= 128 AS whole FROM sn JOIN documents USING (doc_id)),
e AS (SELECT doc_id * 100000 + i AS key, doc_id, source, i, l[i + 1] AS text FROM (SELECT doc_id, source, l, unnest(generate_series(0, len(l) - 1)) AS i FROM sx WHERE NOT whole)), {_bag('e', 'key', 'ev')},
dp AS (SELECT e.doc_id, e.i, 1 - coalesce(sum(a.x * b.x), 0) AS dr FROM e LEFT JOIN ev a ON a.id = key LEFT JOIN ev b ON b.id = key - 1 AND a.b = b.b WHERE e.i > 0 GROUP BY ALL),
lm AS (SELECT doc_id, quantile_cont(dr, 0.95) AS lim FROM dp GROUP BY doc_id),
sg AS (SELECT e.doc_id, e.source, e.i, e.text, sum(CASE WHEN dr >= lim THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS UNBOUNDED PRECEDING) AS no FROM e LEFT JOIN dp ON dp.doc_id = e.doc_id AND dp.i = e.i LEFT JOIN lm ON lm.doc_id = e.doc_id),
st AS (SELECT doc_id, source, no, string_agg(text, ' ' ORDER BY i) AS text FROM sg GROUP BY ALL),
{_recursive_sql(128, 16, 'st', 'doc_id, source, no')},
al AS (SELECT doc_id, source, flatten(list(l ORDER BY no)) AS l FROM rc GROUP BY ALL UNION ALL SELECT doc_id, source, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN [] ELSE [text] END FROM sx WHERE whole)"""


@query(f"""WITH {_SEMANTIC} SELECT doc_id || '::0::' || (i - 1) AS chunk_id, doc_id::VARCHAR AS paper_id, 0 AS section_index, source AS section_title, (i - 1)::INT AS chunk_index, l[i] AS text, length(l[i]) AS char_count, len(regexp_extract_all(l[i], {PIECES})) AS token_count, 'semantic' AS strategy
FROM (SELECT doc_id, source, l, unnest(generate_series(1, len(l))) AS i FROM al)""")
def chunk_semantic(spark, sf):
    return chunking.chunk_sections(_sections(spark, sf), "semantic", 128, 16, vectors.hash_bag)
