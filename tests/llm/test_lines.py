import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, lines

SCHEMA = "doc_id long, text string, row string, h1 int"


def grams(line, k=5):
    low = line.lower()
    return {low[i : i + k] for i in range(max(1, len(low) - k + 1))}


def plain(rows, threshold=0.8):
    """Kept text of each row, by comparing all distinct lines."""
    places = {}
    for n, (d, t) in enumerate(rows):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip():
                places.setdefault(line, []).append(((d is None, d or 0), n, i))
    names = list(places)
    sets = [grams(x) for x in names]
    label = list(range(len(names)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    first = {}
    for i, name in enumerate(names):
        first[root(i)] = min(first.get(root(i), ((True, 1 << 62), 0, 0)), min(places[name]))
    keep = {(n, i) for _, n, i in first.values()}
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip() or (n, i) in keep) if t else t for n, (_, t) in enumerate(rows)]


def say(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(n))


def corpus():
    r = random.Random(8)
    base = [say(r, r.randint(1, 60)) for _ in range(60)]
    rows = []
    for d in range(40):
        picked = []
        for _ in range(r.randint(1, 8)):
            w = r.choice(base).split()
            if len(w) > 45 and r.random() < 0.5:
                w[r.randrange(len(w))] = "edited"
            picked.append(" ".join(w))
        rows.append((d, "\n".join(picked + [""] * r.randint(0, 2))))
    rows += [(100 + i, "All rights reserved.\n" + say(r, 12)) for i in range(30)] + [(200, None), (201, ""), (202, "\n\n"), (203, "短い行です"), (204, "短い行です"), (206, "長い行ですが一字だけ違うところがあります。ほかは同じ文字が続いています。"), (207, "長い行ですが一字だけ違うところがあります。ほかは同じ文字が続いてゐます。"), (208, "https://example.com/one"), (209, "https://example.com/two"), (210, "短い"), (205, "x " * 9000), (211, "x " * 700), (212, "ÀÉÎ"), (213, "àéî"), (None, base[0])]
    return rows


def test_kept_lines_are_those_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert {d: r["text"] for d, r in got.items()} == {d: t for (d, _), t in zip(rows, plain(rows))}
    assert got[200]["text"] is None and got[0].asDict()["row"] == "r" and got[200]["n_lines"] == 0


def test_repeated_rows_and_rows_that_only_share_an_id(spark):
    rows = [(1, "one line that is here\nanother line"), (1, "one line that is here\nanother line"), (1, "something else entirely now"), (2, "one line that is here")]
    got = sorted(tuple(r) for r in lines.keep_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, rows[0][1]), (1, rows[0][1]), (1, rows[2][1])])


def test_empty(spark):
    assert lines.keep_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_any_names_of_other_columns(spark):
    names = ["doc_id", "text", "did", "row", "gone", "_row", "doc", "n_lines", "__key"]
    docs = spark.createDataFrame([(1, "a line of text\nand more", *"abcdefg"), (2, "a line of text", *"hijklmn")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = lines.keep_lines(docs).collect()
    assert [tuple(r) for r in got] == [(1, "a line of text\nand more", *"abcdefg")] and got[0].__fields__ == names
    assert {(r["doc_id"], r["n_lines"], r["n_removed"], r["gone"]) for r in lines.dedup_lines(docs).collect()} == {(1, 2, 0, "c"), (2, 1, 1, "j")}


def test_shuffled_joins_and_small_blocks_give_the_same(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "MOST_BROADCAST", -1)
    monkeypatch.setattr(lines, "PART", 7)
    monkeypatch.setattr(lines, "SMALL", 2)
    want = dict(zip([d for d, _ in rows], plain(rows)))
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == want


def test_short_lines_with_a_changed_character_are_linked(spark):
    r = random.Random(6)
    base = [say(r, 11, "abcdefghijkl") for _ in range(200)]
    edit = lambda x: x[: len(x) // 2] + "Z" + x[len(x) // 2 + 1 :]
    pairs = [(x, edit(x)) for x in base]
    pairs = [(x, y) for x, y in pairs if len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y))]
    rows = [(i, x) for i, (x, _) in enumerate(pairs)] + [(1000 + i, y) for i, (_, y) in enumerate(pairs)]
    got = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 150 and sum(got[1000 + i] for i in range(len(pairs))) >= 0.98 * len(pairs) and not sum(got[i] for i in range(len(pairs)))


def test_pairs_in_a_template_of_many_lines_are_found(spark):
    """Lines of one template are alike, but below the threshold; the few true pairs among them are still linked."""
    r = random.Random(4)
    frame = say(r, 24).split()
    rows = []
    for i in range(600):
        w = list(frame)
        for at in (3, 11, 19):
            w[at] = "".join(r.choice("abcdefghijklmnop") for _ in range(9))
        rows.append((i, " ".join(w)))
    twins = r.sample(range(600), 60)
    rows += [(1000 + i, rows[i][1][:-2] + "QZ") for i in twins]
    got = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: (t or "") == "" for (d, _), t in zip(rows, plain(rows))}
    assert sum(want.values()) <= 70
    assert sum(got[1000 + i] for i in twins) >= 59 and sum(got[d] != want[d] for d in got) <= 1


def test_rows_of_few_bands_are_shuffled_at_once(spark, monkeypatch):
    sizes, whole = [], lines.shared
    monkeypatch.setattr(lines, "shared", lambda rows: sizes.append(rows.count()) or whole(rows))
    rows = corpus()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    classes = len({x for _, t in rows for x in (t or "").split("\n") if x.strip()})
    assert sizes == [4 * classes] * 4 and got == dict(zip([d for d, _ in rows], plain(rows)))


@pytest.mark.parametrize("order", [4, 5, 7])
def test_bands_share_one_value_at_most(order):
    found = lines.bands(order)
    assert len(found) == order * order and all(len(set(b)) == order for b in found)
    assert all(len(set(a) & set(b)) <= 1 for i, a in enumerate(found) for b in found[:i])


def test_signatures_leave_out_no_least_value(spark, monkeypatch):
    """Shingles that are not hashed into the signature could not have been least."""
    r = random.Random(1)
    texts = ["a", "abcde", "xxx", *["".join(r.choice("abÄ短😀 ") for _ in range(n)).strip() + "." for n in (62, 66, 70, 133, 500, 900)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, lines.signatures(docs, "text", 5).collect()))
    assert lines.signatures(docs, "text", 5).count() == len(texts)
    monkeypatch.setattr(lines, "FIRST", 1 << 30)
    assert sorted(map(tuple, lines.signatures(docs, "text", 5).collect())) == got


def test_shingles_stand_at_every_place(spark):
    texts = ["a", "abcdef", "Äb短😀e fg"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(lines.shingles(F.col("text"))).collect()]
    assert [len(set(g)) for g in got] == [1, 2, 4] and len({x for g in got for x in g}) == 7


def test_sketches_differ_in_as_many_values(spark):
    r = random.Random(2)
    for values in (16, 25, 49, 63):
        low = lines.sketch_bits(values)
        pairs = [[[r.getrandbits(low) if r.random() < 0.5 else 0 for _ in range(values)] for _ in range(2)] for _ in range(2)]

        def column(v):
            n = sum(x << (low * i) for i, x in enumerate(v))
            return F.lit(n - (1 << 64) if n >> 63 else n)

        got = spark.range(1).select(lines.apart(*[tuple(map(column, p)) for p in pairs], values)).first()[0]
        assert got == sum(x != y for x, y in zip(zip(*pairs[0]), zip(*pairs[1])))


def test_most_of_a_large_group_is_joined_before_all_pairs_are_compared(spark, monkeypatch):
    r = random.Random(8)
    base = [r.getrandbits(62) for _ in range(60)]
    sets = [sorted({*base, *(r.getrandbits(62) for _ in range(3 + i % 5))} - set(r.sample(base, 3))) for i in range(150)]
    rows = [(7, 0, 0, 0, i, r.getrandbits(62), r.getrandbits(62)) for i in range(150)]
    blocks = spark.createDataFrame(rows, "k long, lo int, hi int, part int, h1 long, sk long, s2 long")
    texts = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(sets)], "h1 long, line array<long>, n int")
    made, rest = [], lines.rest_links
    monkeypatch.setattr(lines, "rest_links", lambda *a: made.append((x := rest(*a)).count()) or x)
    got = [sorted(map(tuple, lines.settled(blocks, texts, 16, 16, 0.8, lambda s: s, passes=p, worth=1).select("node", "component").collect())) for p in (0, lines.PASSES)]
    assert got[0] == got[1] and got[0]
    assert made[1] < made[0] / 2


def test_bit_maps_rule_out_no_alike_sets(spark):
    r, rows = random.Random(2), []
    for _ in range(300):
        a = {r.randrange(-(1 << 60), 1 << 60) for _ in range(r.choice([2, 30, 150, 900]))}
        b = {x for x in a if r.random() > r.choice([0, 0.05, 0.1, 0.2, 0.6])} | {r.getrandbits(60) for _ in range(r.randrange(1 + len(a) // 8))}
        rows.append((list(a), list(b), len(a), len(b), len(a & b) >= 0.8 * len(a | b)))
    rows = spark.createDataFrame(rows, "a array<long>, b array<long>, na int, nb int, alike boolean")
    told = rows.select("alike", lines.may_be_alike(lines.marks(F.col("a")), lines.marks(F.col("b")), F.col("na"), F.col("nb"), 0.8).alias("may")).collect()
    assert all(x["may"] for x in told if x["alike"]) and sum(x["alike"] for x in told) > 20
    assert sum(not x["may"] for x in told) > 60


def test_tables_of_finished_steps_go(spark):
    """Of all tables stored on the way only that of the lines to remove stays, which the result reads."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("siltstone-*"))
    rows = corpus()
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(set(folder.glob("siltstone-*")) - before) == 1
    assert {r["doc_id"]: r["text"] for r in done.collect()} == dict(zip([d for d, _ in rows], plain(rows)))


def test_bit_maps_by_an_aggregate_are_the_same(spark):
    r = random.Random(3)
    sets = spark.createDataFrame([(i, n, [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)]) for i, n in enumerate([1, 2, 40, 900])], "h1 long, n int, hashes array<long>")
    assert sorted(map(tuple, lines.marked(sets).collect())) == sorted(map(tuple, sets.select("h1", "n", *lines.marks(F.col("hashes"))).collect()))
