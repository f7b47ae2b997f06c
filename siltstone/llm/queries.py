"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, embeddings, html, lines, mixing, packing, quality, repair, simhash, spelling, spotsigs, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "virtual_finish")


#: The same queue in SQL; the fixed point of the targets is found by a recursive query.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source
), r AS (
  SELECT 0 AS n, source, source_size, w, false AS stopped, (SELECT sum(source_size) FROM s) / (SELECT sum(w) FROM s) AS level FROM s
  UNION ALL
  SELECT n + 1, source, source_size, w, stopped2,
    (sum(source_size) OVER () - sum(CASE WHEN stopped2 THEN 3 * source_size ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stopped2 THEN 0 ELSE w END) OVER (), 0)
  FROM (SELECT *, stopped OR w * level > 3 * source_size AS stopped2, bool_or(NOT stopped AND w * level > 3 * source_size) OVER () AS more FROM r) WHERE more
), t AS (
  SELECT source, source_size::BIGINT AS source_size, CASE WHEN stopped THEN 3 * source_size ELSE w * level END AS target FROM r WHERE n = (SELECT max(n) FROM r)
), q AS (
  SELECT d.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS st FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, unnest(generate_series(0, least(2, floor((target - st) / source_size)::BIGINT))) AS turn FROM q WHERE size > 0 AND target > 0 AND st <= target
), e AS (
  SELECT *, CASE WHEN st + turn * source_size + size > target THEN ceil(size / 1000.0::DOUBLE)::BIGINT ELSE size END AS pk FROM u
), g AS (
  SELECT *, unnest(generate_series(0, (size - 1) // pk)) AS j FROM e
), h AS (
  SELECT *, least(pk, size - j * pk) AS n, (st + turn * source_size + j * pk + least(pk, size - j * pk))::DOUBLE / target AS vf FROM g
), o AS (
  SELECT *, sum(n) OVER (ORDER BY vf, source IS NOT NULL, source, turn, j, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, (SELECT round(sum(target)) FROM t)::BIGINT AS budget FROM h
), y AS (
  SELECT source, k, doc_id, size, turn, sum(greatest(0, least(n, budget - upto + n))) AS p FROM o GROUP BY ALL
), z AS (
  SELECT source, k, doc_id, size, sum(p)::BIGINT AS taken, sum(CASE WHEN 2 * p >= size THEN 1 ELSE 0 END)::INTEGER AS copies FROM y WHERE p > 0 GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(z.taken, 0)::BIGINT AS taken, coalesce(z.copies, 0)::INTEGER AS copies,
  CASE WHEN target > 0 THEN (st + q.size) / target END AS virtual_finish
FROM q LEFT JOIN z ON q.source IS NOT DISTINCT FROM z.source AND q.k = z.k AND q.doc_id IS NOT DISTINCT FROM z.doc_id
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept")


#: Windows as text, first holder by a plain minimum.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS p, w FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS t FROM x
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY t) AS first FROM g
), r AS (
  SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(generate_series(p, p + 12)) AS q FROM f WHERE first < doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_transform(w, lambda y, i: CASE WHEN list_contains(coalesce(gone, []), i) THEN NULL ELSE y END), lambda y: y IS NOT NULL), lambda y: y), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return done.select("doc_id", "n_lines", "n_removed", kept)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a
), c AS (
  SELECT a, min(c) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op3_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.CUT).cast("int").alias("predicted"), "toxicity_lang")


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; the table (from its rule) is ``t`` of the CTE ``crc``."""
    byte = "lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT".format(text)
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))::BIGINT), {byte})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _crc_table() -> str:
    rows = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        rows.append(str(n))
    return f"crc AS (SELECT [{', '.join(rows)}]::BIGINT[] AS t)"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the template's own marks."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


OP11_SQL = r"""
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
), y AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '[\[<]\\*/?(INST|SYS|ROLE|TEXT|s)[\]>]')) AS n,
    len(role) + len(regexp_extract_all(role, '[\[<]\\*/?(INST|SYS|ROLE|TEXT|s)[\]>]')) AS m FROM x
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 23 + m END)::BIGINT AS formatted_chars
FROM y GROUP BY conv_id
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summaries(repair.repair(repair.damage(_table(spark, sf_dir, "conversations"))))


#: The same program with whole audits, one turn a round; of each state the cheapest, then the least audit.
OP12_SQL = rf"""
WITH RECURSIVE {_crc_table()}, f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations, crc
), g AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0
), d AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM g
), e AS (
  SELECT *, left(role, 1) AS c, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS short,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM d
), n AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
    count_if(short AND NOT again AND NOT blank) AS truncated, count_if(i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id
), m AS (
  SELECT * FROM (VALUES ('_', 0, '', '_'), ('_', 3, 'I', 'u'), ('_', 6, 'II', 'a'), ('s', 0, '', 's'), ('s', 3, 'I', 'u'), ('s', 6, 'II', 'a'), ('u', 0, '', 'u'), ('u', 3, 'I', 'a'), ('u', 6, 'II', 'u'), ('a', 0, '', 'a'), ('a', 3, 'I', 'u'), ('a', 6, 'II', 'a')) x(a, more, said, b)
), p AS (
  SELECT conv_id, 0::BIGINT AS i, '_' AS state, 0::BIGINT AS cost, '' AS audit FROM n
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, e.i, w.state, p.cost + m.more + w.cost AS cost, p.audit || m.said || w.said AS audit
      FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 JOIN m ON m.a = p.state,
      LATERAL (
        SELECT m.b AS state, 4 AS cost, 'D' AS said
        UNION ALL SELECT e.c, CASE WHEN e.short THEN 3 ELSE 0 END, 'K' WHERE NOT e.blank AND NOT e.again AND ((e.c = 's' AND m.b = '_') OR (e.c = 'u' AND m.b <> 'u') OR (e.c = 'a' AND m.b = 'u'))
        UNION ALL SELECT CASE WHEN m.b = 'u' THEN 'a' ELSE 'u' END, CASE WHEN e.short THEN 6 ELSE 3 END, 'R' WHERE NOT e.blank AND NOT e.again
      ) w
    )
  ) WHERE best = 1
), z AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM (
    SELECT p.conv_id, p.cost + m.more AS cost, p.audit || m.said AS audit FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.rows = p.i JOIN m ON m.a = p.state WHERE m.b IN ('a', '_')
  )
), l AS (
  SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM z WHERE best = 1
), q AS (
  SELECT conv_id, j, audit[j] AS said, count_if(audit[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM l
), r AS (
  SELECT q.conv_id, q.j, q.said, CASE WHEN q.said = 'I' THEN '' ELSE e.text END AS text, e.role, row_number() OVER (PARTITION BY q.conv_id ORDER BY q.j) AS k,
    coalesce(bool_or(q.said = 'K' AND e.c = 's') OVER (PARTITION BY q.conv_id), false) AS led
  FROM q LEFT JOIN e ON q.said <> 'I' AND e.conv_id IS NOT DISTINCT FROM q.conv_id AND e.i = q.i WHERE q.said <> 'D'
), s AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN said = 'K' THEN role WHEN (k + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM r GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(z.cost, 0)::BIGINT AS cost, coalesce(z.audit, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.best = 1 AND z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


#: Near words by joins of the vocabulary with itself, roots by following forms.
OP13_SQL = rf"""
WITH RECURSIVE {_crc_table()}, a AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL
), b AS (
  SELECT w, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM a, crc WHERE len(w) >= 6
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, n FROM b) GROUP BY word HAVING sum(n) >= 5 AND len(word) >= 6
), x AS (
  SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v
), k AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM x
), e AS (
  SELECT k.word, j.word AS near, j.n FROM k JOIN k j ON k.i = j.i AND k.p = j.p AND k.s = j.s AND k.word <> j.word
), l AS (
  SELECT DISTINCT k.word, v.word AS shorter, k.n, v.n AS m FROM k JOIN v ON v.word = k.p || k.s
), o AS (
  SELECT * FROM e UNION ALL SELECT word, shorter, m FROM l UNION ALL SELECT shorter, word, n FROM l
), c AS (
  SELECT word, count(*) AS n_near, max(n) AS best, min_by(near, (-n, near)) AS near FROM o GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best >= 5 * v.n THEN near END AS form, CASE WHEN best >= 5 * v.n THEN best END::BIGINT AS form_n FROM v LEFT JOIN c USING (word)
), r AS (
  SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT r.word, f.form, d + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, max_by(r.root, r.d) AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_embedding_near_dedup, op3_spotsigs_fingerprints, op4_pack_sequences, op5_toxicity, op6_quality, op7_mix_sources, op8_substring_dedup, op9_line_dedup, op10_simhash_near_dedup, op11_chat_format, op12_conversation_repair, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op7_mix_sources": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op11_chat_format": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
