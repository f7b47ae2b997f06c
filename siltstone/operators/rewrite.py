"""Query rewriting: reading rewrites out of replies, and the queries that follow from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.replies import passage, strings
from siltstone.functions.text import strip
from siltstone.operators.calls import Caller, with_reply

MULTI_QUERY_PROMPT = "Write {n} other ways to ask the question below, each standing alone, as a JSON array of strings and nothing else.\n\nQuestion: {question}"
HYDE_PROMPT = "Write one paragraph, as it could stand in a research paper, that answers the question below. Write the paragraph only.\n\nQuestion: {question}"


def fill(template: str, **values: Column) -> Column:
    """A prompt template with its {names} filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def multi_query(raw: Column, n: int = 3) -> Column:
    """At most n rewrites from a reply; a null or broken reply or n <= 0 gives none."""
    none = F.array().cast("array<string>")
    return none if n <= 0 else F.coalesce(F.slice(strings(raw), 1, n), none)


def hyde(raw: Column) -> Column:
    """The passage as the only rewrite; none for null or blank replies."""
    return F.when(strip(F.coalesce(raw, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.array(passage(raw)))


def rewrites(questions: DataFrame, model: Callable[[Column], Column] | Caller, strategy: str = "multi_query", n: int = 3) -> DataFrame:
    """``query_id, rewrites`` of questions ``query_id, text`` by a model (prompt to reply, null for a failed call).

    Multi-query asks for n other ways to put the question, and for none where n <= 0; HyDE asks for a
    passage that answers it. A failed call or a broken reply gives no rewrites.
    """
    if strategy == "multi_query":
        if n <= 0:
            return questions.select("query_id", F.array().cast("array<string>").alias("rewrites"))
        prompt = fill(MULTI_QUERY_PROMPT, n=F.lit(str(n)), question=F.col("text"))
        read = multi_query(F.col("_raw"), n)
    elif strategy == "hyde":
        prompt, read = fill(HYDE_PROMPT, question=F.col("text")), hyde(F.col("_raw"))
    else:
        raise ValueError("strategy must be multi_query or hyde")
    return with_reply(questions.select("query_id", "text"), prompt, model, "_raw").select("query_id", read.alias("rewrites"))


def distinct_queries(original: Column, rewrites: Column) -> Column:
    """Original and rewrites, stripped, blanks dropped, each once whatever its case, in order."""
    every = F.filter(F.transform(F.concat(F.array(original), rewrites), lambda s: strip(s)), lambda s: s != "")
    return F.aggregate(every, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(s)), acc).otherwise(F.concat(acc, F.array(s))))


def sub_queries(questions: DataFrame, rewrites_col: str = "rewrites", strategy: str = "multi_query") -> DataFrame:
    """``query_id, query_no, text``: what to search for. Multi-query takes original and rewrites, HyDE only the passage (or the original)."""
    if strategy == "multi_query":
        queries = distinct_queries(F.col("question"), F.col(rewrites_col))
    elif strategy == "hyde":
        queries = F.when(F.size(rewrites_col) > 0, F.col(rewrites_col)).otherwise(F.array("question"))
    else:
        raise ValueError("strategy must be multi_query or hyde")
    return questions.select("query_id", F.posexplode(queries).alias("query_no", "text"))
