import pytest
from pyspark.sql import functions as F

from siltstone.config import Settings, load_settings
from siltstone.operators import ingest
from siltstone.sources import tables


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_headers(spark):
    good = {"1 Introduction": "1 Introduction", "2.1. Related Work": "2.1. Related Work", "IV. Results": "IV. Results", "ABSTRACT": "Abstract", "  related work: ": "Related Work", "future work": "Future Work", "3 Étude": None, "1.": None, "": None, "lower case": None, "We show results.": None, "x" * 200: None, "2 " + "A" * 100: None}
    assert column(spark, good, ingest.header_title) == list(good.values())


def test_ends_and_artifacts(spark):
    assert column(spark, ["References", "7. References", "VII Bibliography", "Acknowledgements and more", "Results", "A References"], ingest.is_end) == [True, True, True, True, False, False]
    assert column(spark, ["12", " 3 ", "Page 3", "page 4 of 9", "arXiv:2401.00001v2 [cs]", "Preprint.", "Under review as a paper", "Page turner", "12 apples", "arXiv is"], ingest.is_artifact) == [True] * 7 + [False] * 3


def test_sections(spark):
    body = "words of the body that go on for a while to be long enough, at least fifty"
    one = f"Title of it\n{body}\n1\nAbstract\n{body}\n\n\n\n{body}\nPage 1 of 2"
    two = f"{body}\n1. Introduction\ntoo short\n2. Method\n  {body}\nReferences\n{body}\nAppendix\n{body}"
    pages = spark.createDataFrame([("p", 2, two), ("p", 1, one), ("q", 1, "nothing")], "paper_id string, page_num int, text string")
    got = [tuple(r) for r in ingest.sections(pages).orderBy("section_index").collect()]
    t0, t1 = f"Title of it\n{body}", f"{body}\n\n{body}\n{body}"
    assert got == [("p", 0, "Preamble", t0, 0, 1, len(t0)), ("p", 1, "Abstract", t1, 1, 2, len(t1)), ("p", 2, "2. Method", body, 2, 2, len(body))]
    assert ingest.parse_stats(pages, ingest.sections(pages)).first() == (1, 1, 3)


def test_new_papers_and_ids(spark):
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert [r[0] for r in ingest.new_papers(new, spark.createDataFrame([("a",), ("a",)], "id string")).collect()] == ["b"]
    assert column(spark, ["http://x/abs/2401.1v2"], ingest.paper_id) == ["2401.1v2"]
    assert column(spark, [["cs.LG", "cs.CL"], []], ingest.query_string, "array<string>") == ["cat:cs.LG OR cat:cs.CL", ""]


def test_dates(spark):
    ts = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-31 00:00:00",), ("2024-01-31 08:00:00",), ("2023-12-31 23:59:59",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert ts.where(ingest.in_date_range(F.col("t"), "2024-01-01", "2024-01-31")).count() == 2
    with pytest.raises(ValueError):
        ingest.in_date_range(F.col("t"), "01/01/2024")


def test_tolerant_and_strict_scans(spark, tmp_path):
    path = f"{tmp_path}/m.jsonl"
    with open(path, "w") as f:
        f.write('{"id": "a", "title": "A", "categories": ["cs.LG"]}\nnot json\n{"title": "no id"}\n\n{"id": "b"}\n')
    good, bad = tables.metadata(spark, path)
    assert sorted(r["id"] for r in good.collect()) == ["a", "b"] and bad.count() == 2
    with pytest.raises(Exception):
        tables.strict_json(spark, path, tables.METADATA).collect()


def test_evaluation_items(spark, tmp_path):
    def items(line):
        path = f"{tmp_path}/{abs(hash(line))}.jsonl"
        with open(path, "w") as f:
            f.write(line)
        return tables.eval_items(spark, path).collect()

    base = '{"id": "1", "question": "q", "gold_answer": "a", "type": "%s", "source_paper_id": "p", "source_chunk_ids": []}'
    assert items(base % "no_answer")[0]["notes"] == ""
    for line in (base % "other", '{"id": "1", "type": "no_answer"}'):
        with pytest.raises(Exception):
            items(line)


def test_page_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\fpages two")
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    got = tables.page_texts(spark, str(tmp_path), lambda raw: raw.decode().split("\f")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "one"), ("a", 2, "pages two")]
    with pytest.raises(FileNotFoundError, match="index first"):
        tables.table(spark, f"{tmp_path}/none")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("TOP_K=5\n# note\nother=1\nCHUNK_SIZE=99\n")
    s = load_settings({"chunk_size": "77", "CATEGORIES": '["a", "b"]'}, str(tmp_path / ".env"))
    assert (s.top_k, s.chunk_size, s.categories, s.rrf_k) == (5, 77, ("a", "b"), 60)
    assert load_settings({}) == Settings()
