"""Text, token, vector and hybrid search, and the ranking of a task's context."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomgraph.functions import text


def _pattern(term: str) -> str:
    """A term of a full-text query as a regular expression: its alphanumeric words in a row, the last as a prefix."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in term.lower()).split() if w]
    return r"(^|[^a-z0-9])" + r"[^a-z0-9]+".join(words) if words else ""


def search_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols in which every term of the query is found in one of the text columns; by substring if the query has no term."""
    patterns = [p for p in (_pattern(t.replace('"', "")) for t in query.split()) if p]
    columns = ["name", "qualified_name", "signature", "doc_summary"]
    if not patterns:
        low = query.strip().lower()
        return symbols.where(F.lower("name").contains(low) | F.lower("qualified_name").contains(low))
    hit = F.lit(True)
    for p in patterns:
        one = F.lit(False)
        for c in columns:
            one = one | F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(p)
        hit = hit & one
    return symbols.where(hit)


def token_weights(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, token, weight): how often each token occurs."""
    return df.select(key, F.explode(text.tokens(F.col(column))).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("weight"))


def token_overlap(weights: DataFrame, key: str, query_tokens: list[str]) -> DataFrame:
    """(key, score): sums of the weights of the query's tokens."""
    return weights.where(F.col("token").isin(*query_tokens)).groupBy(key).agg(F.sum("weight").alias("score"))


HIT = ["path", "qualified_name", "score", "why"]


def hits(df: DataFrame) -> DataFrame:
    """The columns that every search gives: (path, qualified_name, score double, why array<string>), best first."""
    why = F.col("why") if isinstance(df.schema["why"].dataType, ArrayType) else F.split("why", ",")
    return df.select("path", "qualified_name", F.col("score").cast("double").alias("score"), why.alias("why")).orderBy(F.desc("score"), "path", "qualified_name")


def query_tokens(query: str) -> list[str]:
    """The distinct tokens of a query, as texts are cut."""
    return sorted(set(re.findall(r"[a-z0-9_./\-]{2,}", query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))))


def semantic(symbols: DataFrame, files: DataFrame, query: str, limit: int) -> DataFrame:
    """Hits by token overlap: the weights of the query's tokens in a symbol's texts, summed by path and qualified name."""
    words = query_tokens(query)
    paths = files.select(F.col("id").alias("file_id"), "path")
    texts = symbols.select("file_id", "qualified_name", F.concat_ws(" ", "name", "qualified_name", "signature", "doc_summary").alias("all"))
    found = texts.select("file_id", "qualified_name", F.explode(text.tokens(F.col("all"))).alias("token")).where(F.col("token").isin(*words))
    summed = found.join(paths, "file_id").groupBy("path", "qualified_name").agg(F.count("*").cast("double").alias("score"))
    return hits(summed.withColumn("why", F.array(F.lit("token_overlap")))).limit(limit)


def hybrid(symbols: DataFrame, files: DataFrame, embeddings: DataFrame, query: str, vector: list[float], limit: int) -> DataFrame:
    """Hits by reciprocal rank fusion of full-text search and cosine with ``vector``, each cut at max(3 * limit, 50); embeddings(id, embedding)."""
    most = max(3 * limit, 50)
    named = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("hit", F.struct("path", "qualified_name"))
    words = ranked(search_symbols(named, query), ["qualified_name", "start_line", "id"], most)
    asked = symbols.sparkSession.createDataFrame([([float(x) for x in vector],)], "embedding array<float>")
    near = vector_search(embeddings, asked, "id", "embedding").join(named.select("id", "path", "qualified_name", "hit"), "id")
    near = ranked(near, [F.desc("score"), "path", "qualified_name", "id"], most)
    return hits(fuse({"text": words, "vector": near}, "hit").select("hit.path", "hit.qualified_name", "score", "why")).limit(limit)


def vector_search(embeddings: DataFrame, query: DataFrame, key: str, column: str, limit: int | None = None) -> DataFrame:
    """(key, score): cosine with the one query vector, above 0, best first. The query is one row, so it is broadcast."""
    q = F.broadcast(query.select(F.col(column).alias("__q")).limit(1))
    scored = embeddings.join(q).select(key, text.cosine(F.col(column), F.col("__q")).alias("score")).where("score > 0")
    return scored if limit is None else scored.orderBy(F.desc("score"), key).limit(limit)


def fuse(lists: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, place): (key, score, why)."""
    every = None
    for name, df in lists.items():
        part = df.select(key, (1.0 / (k + F.col("place"))).alias("part"), F.lit(name).alias("name"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("why"))


def ranked(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with their place; the order is total, so top-k comes before the numbering."""
    return df.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def symbols_for_refs(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, qualified_name, id): of the symbols that a reference names, the first with a stable key by that key, line and id; those without a key come last."""
    named = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    key = F.coalesce("stable_key", F.lit("")) if "stable_key" in symbols.columns else F.lit("")
    best = F.min(F.struct((key == "").alias("none"), key.alias("key"), "start_line", "id")).alias("best")
    return named.join(refs, ["path", "qualified_name"], "left_semi").groupBy("path", "qualified_name").agg(best).select("path", "qualified_name", "best.id")


#: Base and weight of the evidence classes, best class first. Fixed values.
CLASSES = [("direct", 0.60, 0.40), ("caller", 0.35, 0.30), ("callee", 0.30, 0.30), ("test", 0.10, 0.15)]


def normalised(candidates: DataFrame) -> DataFrame:
    """``candidates`` with signals from 0 to 1: over the largest, or, if none is positive, 1 - rank / n in the order of path, qualified name and id."""
    top = candidates.agg(F.max("signal").alias("top")).first()["top"]
    if top is not None and top > 0:
        return candidates.withColumn("signal", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("signal") / F.lit(float(top)))))
    n = candidates.count()  # a context's few hundred; nothing but their order tells them apart
    order = Window.orderBy("path", "qualified_name", "id")
    return candidates.withColumn("signal", F.lit(1.0) - (F.row_number().over(order) - 1) / F.lit(float(max(1, n))))


def rank_context(candidates: DataFrame, max_files: int = 10) -> DataFrame:
    """candidates(class, path, qualified_name, id, signal[, name, stable_key]) -> the ranked context, with score and file_rank, of the first ``max_files`` files.

    Of the same symbol, i.e. path and stable key, or path and names where there is no key, the
    best class and signal stays; a file with several candidates lends each a little.
    """
    base = F.coalesce(*[F.when(F.col("class") == c, F.lit(b)) for c, b, _ in CLASSES])
    weight = F.coalesce(*[F.when(F.col("class") == c, F.lit(w)) for c, _, w in CLASSES])
    place = F.coalesce(*[F.when(F.col("class") == c, F.lit(k)) for k, (c, _, _) in enumerate(CLASSES)])
    key = F.coalesce("stable_key", F.lit("")) if "stable_key" in candidates.columns else F.lit("")
    name = F.coalesce("name", F.lit("")) if "name" in candidates.columns else F.lit("")
    scored = normalised(candidates).withColumn("place", place).withColumn("base_score", F.round(base + weight * F.col("signal"), 6))
    scored = scored.withColumn("same", F.when(key != "", F.struct(key.alias("key"), F.lit("").alias("name"))).otherwise(F.struct(F.col("qualified_name").alias("key"), name.alias("name"))))
    best = scored.groupBy("path", "same").agg(F.min(F.struct((-F.col("base_score")).alias("low"), "place", F.col("id").isNull().alias("no_id"), "id", "class", "qualified_name")).alias("b")).select("path", "b.qualified_name", "b.id", "b.class", "b.place", (-F.col("b.low")).alias("base_score"))
    support = best.groupBy("path").agg(F.count("*").alias("support"))
    final = best.join(support, "path").withColumn("score", F.round(F.col("base_score") + 0.01 * F.least(F.lit(5), F.col("support")), 6))
    lead = final.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("low"), "place", "path", "qualified_name")).alias("lead"))
    kept = lead.orderBy("lead").limit(max_files).withColumn("file_rank", F.row_number().over(Window.orderBy("lead"))).drop("lead")
    return final.join(F.broadcast(kept), "path").select("path", "qualified_name", "id", "class", "score", "file_rank")


def within_budget(rows: DataFrame, order: list, cost: str, budget: int) -> DataFrame:
    """The greedy prefix of an order whose running cost stays within the budget: it stops at the first row that goes over.

    Costs have to be at least 1, which is checked, so at most ``budget`` rows can matter and only those are numbered.
    """
    checked = rows.withColumn(cost, F.when(F.col(cost) >= 1, F.col(cost)).otherwise(F.raise_error(F.lit("costs have to be at least 1")).cast(rows.schema[cost].dataType)))
    first = checked.orderBy(*order).limit(budget + 1)
    return first.withColumn("spent", F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("spent") <= budget)


def relevance(file_rank):
    """What a file at a rank from 1 counts: 1, less 0.05 a place, 0.1 at least."""
    return F.round(F.greatest(F.lit(0.1), 1 - 0.05 * (file_rank - 1)), 2)


def file_relevance(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file_rank, relevance) of files in the order of their first symbol's id: one row per file is numbered."""
    first = symbols.groupBy("file_id").agg(F.min("id").alias("first"))
    ranked_files = first.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("file_rank", F.dense_rank().over(Window.orderBy("first")))
    return ranked_files.select("path", "file_rank", relevance(F.col("file_rank")).alias("relevance"))
