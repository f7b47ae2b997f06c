"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Each source's documents are shuffled by a hash of their id and queued; a document's virtual finish
time is the words its source has queued up to its end, over the source's target. A source whose
target is above its size queues its documents again, up to ``max_repeats`` times. All sources are
served in one order, by virtual finish time, and the queue is cut where the total budget is spent. A
document that would begin before its source has its target but end after it is queued in packets, so
that each source comes within a packet of its target. The running total of the words is summed in
two steps, inside ranges of virtual time and over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import WORD, partitions, small, stored


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` per source.

    Weights repeat over the sources by code point, null last. ``share`` of all words is the budget; a
    target stops at ``max_repeats`` times its source's size and the excess is reshared by weight
    among the others until none is above. The fixed point has a closed form: with sources by rising
    limit / weight, the first k are stopped, where k is the least number that leaves the others
    below their limits. Null sources are one source. Works on one row per source only.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limited = (
        sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_limit", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("_at", F.col("_limit") / F.col("_w"))
    )
    order = W.orderBy("_at", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (
        limited.withColumn("_left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_w").over(after))
        .withColumn("_free", F.col("_at") >= F.col("_level"))
    )
    found = level.withColumn("_fair", F.min(F.when(F.col("_free"), F.struct(F.col("_at"), F.col("_level")))).over(every)["_level"])
    target = F.when(F.col("_fair").isNull() | (F.col("_at") < F.col("_fair")), F.col("_limit")).otherwise(F.col("_w") * F.col("_fair"))
    return found.select("source", "source_size", F.least("_limit", target).alias("target"))


#: Ranges of virtual time in which the running total is summed; each holds about as many words.
RANGES = 4096
#: Most packets of a document at the end of its source's share.
PACKETS = 1000


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, seed: str = "mix", ordered: bool = True
) -> DataFrame:
    """One row per input row, in order of virtual time over all sources (if ``ordered``):
    ``doc_id, source, size, source_size, target, taken, copies, virtual_start, virtual_finish, text_hash``.

    size counts the words of the text (null: 0). taken is the words that the mix takes, repeats
    counted: of all places in the queue of all sources, by virtual finish time, those that lie before
    the budget is spent, so that a document at the end of its source's share is taken in part. copies
    is taken in whole documents, parts rounded; virtual times are those of the first place. Reruns agree,
    as the shuffle is a hash of the id; rows that repeat an id are queued one after the other, by size
    and content. Documents without words take nothing. An empty table gives an empty result; other
    columns are not read.

    The words before a document in its source are summed in two steps: within the buckets of the
    shuffle (a prefix of the hash of id and content), then over the buckets' totals, so that a source
    that holds most rows, and rows without an id, are spread over many tasks. Only one row per source
    and bucket is ever sorted together.
    """
    spark = docs.sparkSession
    content = F.xxhash64(F.col(text_col))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), content.cast("string")))))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_key"), content.alias("text_hash")
    )
    sized = stored(sized).withColumn("_bucket", F.substring("_key", 1, 3))  # texts are read once
    order = ["_key", "doc_id", "size", "text_hash"]
    within = W.partitionBy("source", "_bucket").orderBy(*order)
    queued = sized.withColumn("_in", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("_no", F.row_number().over(within))
    totals = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_total"))
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("_total").alias("source_size")), weights, share, max_repeats)
    targets = stored(targets.select(F.col("source").alias("_t"), F.col("source_size").cast("long").alias("source_size"), "target"))
    budget = F.lit(int(targets.agg(F.round(F.coalesce(F.sum("target"), F.lit(0.0)))).first()[0]))
    placed = queued.join(before, queued.source.eqNullSafe(before._s) & (F.col("_bucket") == F.col("_b"))).join(small(targets), F.col("source").eqNullSafe(F.col("_t")))
    start = F.col("_before") + F.col("_in")
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "text_hash", "_key", "_no", start.alias("_start"))
    # One place for each turn that can begin before the queue of its source is served.
    turns = F.sequence(F.lit(0), F.least(F.lit(max_repeats - 1), F.floor((F.col("target") - F.col("_start")) / F.col("source_size")).cast("int")))
    places = placed.where((F.col("size") > 0) & (F.col("target") > 0) & (F.col("_start") <= F.col("target"))).withColumn("_turn", F.explode(turns))
    first = F.col("_start") + F.col("_turn") * F.col("source_size")
    each = F.when(first + F.col("size") > F.col("target"), F.ceil(F.col("size") / F.lit(float(PACKETS)))).otherwise(F.col("size"))
    packets = places.withColumn("_each", each).withColumn("_packet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("_each")))))
    words = F.least(F.col("_each"), F.col("size") - F.col("_packet") * F.col("_each"))
    places = packets.withColumn("_words", words).withColumn("_finish", (first + F.col("_packet") * F.col("_each") + F.col("_words")) / F.col("target"))
    places = places.withColumn("_range", F.least(F.lit(2 * RANGES), F.floor(F.col("_finish") * RANGES)).cast("int"))
    rank = ["_finish", F.col("source").isNotNull(), "source", "_turn", "_packet", "_key", "doc_id", "text_hash", "_no"]
    line = W.partitionBy("_range").orderBy(*rank).rowsBetween(W.unboundedPreceding, 0)
    lined = places.withColumn("_upto", F.sum("_words").over(line))
    sums = places.groupBy("_range").agg(F.sum("_words").alias("_sum"))
    ahead = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    left = budget - F.col("_ahead") - F.col("_upto") + F.col("_words")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_words"), left))
    # Back to one row per input row: its places stand in one bucket of the shuffle.
    keys = ["source", "_key", "doc_id", "size", "text_hash", "_no"]
    served = lined.join(F.broadcast(ahead), F.col("_range") == F.col("_r")).select(*keys, "_turn", part.alias("_part")).where("_part > 0")
    turn = served.groupBy(*keys, "_turn").agg(F.sum("_part").alias("_part"))
    served = turn.groupBy(*keys).agg(F.sum("_part").alias("_taken"), F.sum((F.col("_part") * 2 >= F.col("size")).cast("int")).alias("_copies"))
    served = stored(served.select(*[F.col(k).alias(f"s{k}") for k in keys], "_taken", "_copies"))
    same = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]
    both = same[0]
    for c in same[1:]:
        both = both & c
    out = placed.join(served, both, "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("_copies", F.lit(0)).cast("int").alias("copies"),
        F.when(F.col("target") > 0, F.col("_start") / F.col("target")).alias("virtual_start"),
        F.when(F.col("target") > 0, (F.col("_start") + F.col("size")) / F.col("target")).alias("virtual_finish"),
        "text_hash",
    )
    return out if not ordered else out.repartitionByRange(partitions(spark), "virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as mixed: each document as often as the mix takes it, whole; those not taken go.

    Documents without words take no part in the weights and stay once. All columns are returned,
    whatever their names. Rows that share id, source and text share their copies: the first of them,
    in no order, are taken.
    """
    plan = mix(docs, id_col, text_col, source_col, ordered=False, **options).groupBy("doc_id", "source", "text_hash").agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("copies"), F.count("*").alias("m"))
    plan = stored(plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "copies", "m"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = rows.select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{source_col}`").alias("source"), F.xxhash64(F.col(f"doc.`{text_col}`")).alias("hash"))
    joined = rows.join(plan.where("copies > 0"), F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("hash") == F.col("_hash")))
    each = joined.where("m = 1").select("doc", "copies")
    if plan.where("m > 1").head(1):  # repeated rows deal their copies out among themselves
        again = joined.where("m > 1").withColumn("no", F.row_number().over(W.partitionBy("id", "source", "hash").orderBy(F.lit(1))) - 1)
        each = each.union(again.select("doc", (F.floor(F.col("copies") / F.col("m")) + (F.col("no") < F.col("copies") % F.col("m")).cast("int")).alias("copies")).where("copies > 0"))
    return each.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
