"""Every registered query of the operators against its SQL on small tables of our own."""

import random

import duckdb
import numpy as np
import pytest

from siltstone.plans import queries as plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, path = random.Random(2), str(tmp_path_factory.mktemp("sf"))
    words = [f"w{i}" for i in range(6000)] + ["the", "of", "and", "is"] * 300
    say = lambda n: " ".join(r.choice(words).capitalize() if i % 9 == 0 else r.choice(words) for i in range(n)) + "."
    docs = [(i, "\n".join(say(r.randint(1, 40)) for _ in range(r.randint(1, 30))), "en", f"src{i % 5}", 0) for i in range(60)]
    docs += [(100, docs[3][1], "en", "src0", 0)]
    bench = [(i, docs[i * 3][1][5:140] if i % 2 else say(20)) for i in range(12)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write("benchmark", bench, "item_id long, text string")
    write("labels", [(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    write("embeddings", [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(64)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int")
    write("pages", [(i, f"https://x{i}.example.com/en/{i}?p=1", "<p>x</p>") for i in range(9)], "page_id long, url string, html string")
    turns = [(c, t, "system" if t == 0 and c % 4 == 0 else ("user" if t % 2 else "assistant"), f"{say(r.randint(1, 12))} {say(6)}"[: r.choice([12, 500])]) for c in range(25) for t in range(r.randint(2, 6))]
    write("conversations", turns, "conv_id long, turn long, role string, text string")
    from datetime import datetime, timedelta

    write("events", [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), i % 4, "ab"[i % 2], 0.5, "{}") for i in range(100)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "embeddings", "pages", "conversations", "events"):
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    return path, con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(names), sorted((tuple(repr(plain(v[i].replace(tzinfo=None) if hasattr(v[i], "tzinfo") else v[i])) for i in order) for v in values))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, tables, name):
    path, con = tables
    frame = plans.QUERIES[name](spark, path)
    got = rows(frame.columns, frame.collect())
    cursor = con.execute(plans.SQL[name])
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[1] or name in ("refusal_rate",)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, tables, name):
    assert plans.QUERIES[name](spark, tables[0]).count() > 0
