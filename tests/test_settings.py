"""Settings from the environment and a .env file, and that they take effect."""

from siltstone import cli
from siltstone.config import Settings, load_settings


def test_environment_before_file_before_defaults(tmp_path):
    (tmp_path / ".env").write_text("# comment\nRRF_K=7\nfan_out = '9'\nCATEGORIES=[\"a.B\", \"c.D\"]\nunknown=1\nCALL_WAIT=0.5\n")
    got = load_settings({"Rrf_K": "8", "TOP_K": "3"}, f"{tmp_path}/.env")
    assert (got.rrf_k, got.fan_out, got.top_k, got.categories, got.call_wait) == (8, 9, 3, ("a.B", "c.D"), 0.5)
    assert load_settings({}, f"{tmp_path}/none") == Settings()


def test_a_file_in_the_working_folder_is_read(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("chunk_size=99\n")
    monkeypatch.chdir(tmp_path)
    assert load_settings({}).chunk_size == 99


def test_fan_out_and_rrf_k_reach_the_search(spark, tmp_path, monkeypatch):
    rows = [(f"p{i}::0::0", f"p{i}", "s", f"term{i} shared words here", "fixed", 5) for i in range(6)]
    spark.createDataFrame(rows, "chunk_id string, paper_id string, section_title string, text string, strategy string, token_count int").write.parquet(f"{tmp_path}/chunks")
    cli.main(["index", "--chunks", f"{tmp_path}/chunks", "--out", f"{tmp_path}/index"], spark)
    seen = []
    real = cli.retrieval.search
    monkeypatch.setattr(cli.retrieval, "search", lambda *a, **k: seen.append(a[-2:]) or real(*a, **k))
    args = ["search", "--index", f"{tmp_path}/index", "--chunks", f"{tmp_path}/chunks", "--text", "shared term3", "--config", "hybrid", "--k", "2"]
    assert cli.main([*args, "--fan-out", "4", "--rrf-k", "5"], spark).first()["chunk_id"] == "p3::0::0"
    monkeypatch.setenv("FAN_OUT", "3")
    cli.main(args, spark)
    assert seen == [(4, 5), (3, 60)]


def test_vocabulary_of_the_chunk_command(spark, tmp_path, monkeypatch):
    import pytest

    tokenizers = pytest.importorskip("public_tokenizers")
    spark.createDataFrame([("p", 0, "s", "Some words of a section. " * 80)], "paper_id string, section_index int, section_title string, text string").write.parquet(f"{tmp_path}/sections")
    monkeypatch.setenv("TOKEN_PATTERN", "50k")
    monkeypatch.setenv("CHUNK_SIZE", "100")
    made = cli.main(["chunk", "--sections", f"{tmp_path}/sections", "--out", f"{tmp_path}/chunks", "--vocabulary", tokenizers.path("byte_bpe_50k.tiktoken")], spark).first()
    assert made["chunks"] == 5 + 1 and made["p99_tokens"] <= 100 + 64 + 1
