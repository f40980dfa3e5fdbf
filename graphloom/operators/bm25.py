"""BM25 full-text search.

A query's words are phrases of tokens that must all occur, each within one column. Scores use the statistics of all rows
of the table, over all knowledge bases, unless asked for one base's own.

Two forms: ``search`` cuts a table into tokens in one pass, which gives the statistics and the ids of the rows that match;
the best of them are then fetched by id. ``build_index`` makes postings that can be stored by token, and ``search_index``
then reads only the postings of a query's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.sources.shared import cut

#: Fixed values of the score.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _hits(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    wanted = F.array(*[F.lit(t) for t in phrase])
    starts = F.when(F.size(tokens) >= len(phrase), F.sequence(F.lit(1), F.size(tokens) - (len(phrase) - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, len(phrase)) == wanted))


def idf(rows: Column, with_phrase: Column) -> Column:
    raw = F.log((rows - with_phrase + 0.5) / (with_phrase + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def term_score(hits: Column, length: Column, mean_length: Column, weight: Column) -> Column:
    return weight * hits * (K1 + 1) / (hits + K1 * (1 - B + B * length / mean_length))


def search(table: DataFrame, columns: list[str], query: str, kb: str | None = None, limit: int | None = 20, stats_scope: str = "global") -> DataFrame:
    """The table's rows that match, with a score, best first, ties by id; all of them for no limit."""
    phrases = tx.query_phrases(query)
    if not phrases:
        return table.withColumn("score", F.lit(0.0)).limit(0)
    scope = table.filter(F.col("kb_id") == kb) if stats_scope == "kb" and kb is not None else table
    tokens = scope.select("id", "kb_id", *[tx.tokens(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    parts = [F.col(f"_t{i}") for i in range(len(columns))]
    sums = {f"_h{j}": sum((_hits(t, p) for t in parts[1:]), _hits(parts[0], p)) for j, p in enumerate(phrases)}
    length = sum((F.size(t) for t in parts[1:]), F.size(parts[0]))
    counted = tokens.select("id", "kb_id", *[c.alias(h) for h, c in sums.items()], length.alias("_len"))
    watch = Observation()
    counted = counted.observe(watch, F.count("*").alias("n"), F.avg("_len").alias("mean"), *[F.sum((F.col(h) > 0).cast("long")).alias(h) for h in sums])
    found = counted.filter(" and ".join(f"{h} > 0" for h in sums))
    if kb is not None:
        found = found.filter(F.col("kb_id") == kb)
    found = cut(found, "hits")
    totals = watch.get
    if not totals["n"] or not totals["mean"]:
        return table.withColumn("score", F.lit(0.0)).limit(0)
    score = F.lit(0.0)
    for h in sums:
        score = score + term_score(F.col(h), F.col("_len"), F.lit(totals["mean"]), idf(F.lit(float(totals["n"])), F.lit(float(totals[h]))))
    best = found.select("id", "kb_id", F.round(score, 9).alias("score"))
    if limit is not None:
        best = best.orderBy(F.col("score").desc(), "id").limit(limit)
    rows = table.join(best, ["kb_id", "id"]).select(*table.columns, "score")
    return rows if limit is None else rows.orderBy(F.col("score").desc(), "id")


def search_all(entities: DataFrame, relations: DataFrame, episodes: DataFrame, query: str, kb: str, limit: int = 20, stats_scope: str = "global") -> DataFrame:
    """(id, kb_id, type, content, score) over the three kinds: each kind's best, then the best of all."""
    limit = limit if limit > 0 else 20
    kinds = (
        ("entity", entities, ["name", "summary", "type"], F.concat(F.col("name"), F.lit(": "), F.coalesce("summary", F.lit("")))),
        ("relation", relations, ["type", "summary"], F.concat(F.col("type"), F.lit(": "), F.coalesce("summary", F.lit("")))),
        ("episode", episodes, ["content", "source"], F.col("content")),
    )
    rows = None
    for kind, table, columns, content in kinds:
        found = search(table, columns, query, kb, limit, stats_scope).select("id", "kb_id", F.lit(kind).alias("kind"), content.alias("content"), "score")
        rows = found if rows is None else rows.unionByName(found)
    return rows.withColumnRenamed("kind", "type").orderBy(F.col("score").desc(), "type", "id").limit(limit)


def search_feedback(feedback: DataFrame, query: str, kb: str, limit: int = 50) -> DataFrame:
    return search(feedback, ["topic", "content", "correction"], query, kb, limit if limit > 0 else 50)


def build_index(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings (token, id, kb_id, places), where places are structs of column and position, and lengths (id, kb_id, length)."""
    tokens = table.select("id", "kb_id", *[tx.tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    placed = lambda i: F.transform(F.col(f"t{i}"), lambda t, at: F.struct(t.alias("token"), F.lit(i).alias("part"), at.alias("at")))
    marked = F.concat(*[placed(i) for i in range(len(columns))])
    places = tokens.select("id", "kb_id", F.explode(marked).alias("p")).select("id", "kb_id", "p.*")
    postings = places.groupBy("token", "id", "kb_id").agg(F.array_sort(F.collect_list(F.struct("part", "at"))).alias("places"))
    lengths = tokens.select("id", "kb_id", sum((F.size(f"t{i}") for i in range(1, len(columns))), F.size("t0")).alias("length"))
    return postings, lengths


def _followed(places: Column, by: Column, distance: int) -> Column:
    """Places that have one of by so many tokens later in the same column."""
    return F.filter(places, lambda p: F.array_contains(by, F.struct(p["part"].alias("part"), (p["at"] + distance).alias("at"))))


def search_index(postings: DataFrame, lengths: DataFrame, query: str, kb: str | None = None, limit: int | None = 20) -> DataFrame:
    """(id, kb_id, score) from an index: reads the postings of the query's tokens only."""
    phrases = tx.query_phrases(query)
    totals = lengths.agg(F.count("*"), F.avg("length")).first()
    if not phrases or not totals[0] or not totals[1]:
        return lengths.select("id", "kb_id", F.lit(0.0).alias("score")).limit(0)
    held = postings.filter(F.col("token").isin(sorted({t for p in phrases for t in p})))
    by_row = held.groupBy("id", "kb_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("by"))
    none = F.array().cast("array<struct<part:int,at:int>>")
    hits = {}
    for j, phrase in enumerate(phrases):
        first = F.coalesce(F.try_element_at("by", F.lit(phrase[0])), none)
        for k, token in enumerate(phrase[1:], 1):
            first = _followed(first, F.coalesce(F.try_element_at("by", F.lit(token)), none), k)
        hits[f"h{j}"] = F.size(first)
    counted = by_row.withColumns(hits).drop("by")
    with_phrase = counted.agg(*[F.sum((F.col(h) > 0).cast("long")).alias(h) for h in hits]).first()
    found = counted.filter(" and ".join(f"{h} > 0" for h in hits)).join(lengths, ["id", "kb_id"])
    if kb is not None:
        found = found.filter(F.col("kb_id") == kb)
    score = F.lit(0.0)
    for h in hits:
        score = score + term_score(F.col(h), F.col("length"), F.lit(totals[1]), idf(F.lit(float(totals[0])), F.lit(float(with_phrase[h] or 0))))
    found = found.select("id", "kb_id", F.round(score, 9).alias("score"))
    return found if limit is None else found.orderBy(F.col("score").desc(), "id").limit(limit)
