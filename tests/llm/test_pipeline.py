"""The stages one after another on a small corpus, held against plain versions."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from siltstone.llm import mixing, toxicity  # noqa: E402
from tests.llm.test_lines import plain as plain_lines  # noqa: E402
from tests.llm.test_simhash import plain_components  # noqa: E402


def test_stages(spark, tmp_path):
    r = random.Random(5)
    words = [f"word{i}" for i in range(400)] + ["the", "and", "of"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = ["\n".join(say(r.randint(20, 60)) for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "src0", len(base[i])) for i in range(10)]
    rows += [(200 + i, f"{say(40)} grubhead {say(20)}", "en", "src1", 9) for i in range(40)]
    rows += [(300, None, None, None, None), (301, "", "en", "src2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(x[0], 1, int(x[0] // 100 == 2)) for x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.schema == spark.read.parquet(f"{tmp_path}/documents.parquet").schema
    ids = lambda name: sorted(x["doc_id"] for x in kept[name].collect())
    assert ids("toxicity") == sorted(x[0] for x in rows if x[0] // 100 != 2)
    texts = sorted((x["doc_id"], x["text"]) for x in kept["toxicity"].collect())
    want = [(d, n) for (d, t), n in zip(texts, plain_lines(texts)) if n == t or (n and n.strip())]
    lined = sorted((x["doc_id"], x["text"]) for x in kept["line_dedup"].collect())
    assert lined == want and not any(100 <= d < 110 for d, _ in lined)
    assert ids("simhash_near_dedup") == sorted(d for d, _, c in plain_components(lined) if d == c)
    copies = {x["doc_id"]: 1 if x["size"] == 0 else x["copies"] for x in mixing.mix(kept["simhash_near_dedup"]).collect()}
    assert ids("mixing") == sorted(d for d, n in copies.items() for _ in range(n))
    packed = kept["packing"].collect()
    assert {x["doc_id"] for x in packed} == set(ids("mixing"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, packed))
    assert corpus_pipeline.ORACLE_SQL is None and toxicity.CUT == 0.7


def test_registered_queries_import():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
