"""Entity resolution: exact names, then similar names, then whoever can be asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import weights as wt
from graphloom.functions.text import jaro_winkler_similarity
from graphloom.sources.shared import cut

#: Fixed values of the tiers.
FUZZY, ASK = 0.85, 0.6
#: Shapes of names in a block, names in a list, and pairs of names that are compared at once.
SHAPES, NAMES, PAIRS = 2048, 64, 1 << 16
#: Bounds and similarities that differ by no more may be equal once rounded to nine digits.
SLACK = 2e-9


def exact_matches(new: DataFrame, entities: DataFrame) -> DataFrame:
    """(new_id, entity_id): equal normalized names in the same knowledge base, types that agree; the first by id.

    The known are first brought to the first id of each name and type, so a name that very many share makes no pairs.
    """
    kind = tx.normalize_name(F.coalesce("type", F.lit("")))
    # A blank, which no normalized type is, stands for all types of a name.
    every = F.lit(" ")
    b = entities.select("kb_id", F.col("id").alias("entity_id"), tx.normalize_name(F.col("name")).alias("key"), F.explode(F.array(kind, every)).alias("kind"))
    b = b.groupBy("kb_id", "key", "kind").agg(F.min("entity_id").alias("entity_id"))
    agreeing = F.when(kind == "", F.array(every)).otherwise(F.array(kind, F.lit("")))
    a = new.select("kb_id", F.col("id").alias("new_id"), tx.normalize_name(F.col("name")).alias("key"), F.explode(agreeing).alias("kind"))
    return a.join(b, ["kb_id", "key", "kind"]).groupBy("new_id").agg(F.min("entity_id").alias("entity_id"))


def _blocks(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(kb_id, ours, theirs): each pair of blocks of shapes of a knowledge base, as one row of work."""
    many = lambda t, n: t.groupBy("kb_id").agg(F.ceil(F.count("*") / F.lit(SHAPES)).cast("int").alias(n))
    sizes = F.broadcast(cut(many(ours, "n_ours").join(many(theirs, "n_theirs"), "kb_id"), "sizes"))

    def side(table: DataFrame, mine: str, other: str, kept: Column) -> DataFrame:
        rows = table.join(sizes, "kb_id").withColumn(f"i_{mine}", F.pmod(F.xxhash64("shape"), F.col(f"n_{mine}")).cast("int"))
        packed = rows.groupBy("kb_id", f"i_{mine}", f"n_{other}").agg(F.collect_list(kept).alias(mine))
        return packed.select("kb_id", f"i_{mine}", F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"i_{other}"), mine)

    both = side(ours, "ours", "theirs", F.struct("shape", "least")).join(side(theirs, "theirs", "ours", F.struct("shape")), ["kb_id", "i_ours", "i_theirs"])
    return both.select("kb_id", "ours", "theirs").repartition(_parts(ours))


def _parts(table: DataFrame) -> int:
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _near_shapes(ours: DataFrame, theirs: DataFrame, first: bool) -> DataFrame:
    """(kb_id, shape, their_shape, bound): shapes (kb_id, shape) whose bound is at least that of ours (kb_id, shape, least); first: of each block only the best."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = [x["shape"] for x in row["ours"]], [x["shape"] for x in row["theirs"]]
                bound = tx.similarity_bounds(a, b)
                near = bound >= np.array([x["least"] for x in row["ours"]])[:, None] - SLACK
                if first:
                    best = bound.argmax(1)
                    i = np.flatnonzero(near[np.arange(len(a)), best])
                    j = best[i]
                else:
                    i, j = np.nonzero(near)
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["kb_id"]] * len(x), pa.string()), pa.array(a, pa.string()).take(pa.array(x)), pa.array(b, pa.string()).take(pa.array(y)), pa.array(bound[x, y])], ["kb_id", "shape", "their_shape", "bound"])

    return _blocks(ours, theirs).mapInArrow(compare, "kb_id string, shape string, their_shape string, bound double")


def _best_of(pairs: DataFrame, least: float) -> DataFrame:
    """(kb_id, name, m: entity_id, similarity, old_type): the best for each name asked, of rows (kb_id, bound, asked, known) of lists of names."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, known = batch.column("asked"), batch.column("known")
            n_asked, n_known = (pc.list_value_length(x).to_numpy().astype("int64") for x in (asked, known))
            a, b = asked.flatten(), known.flatten()
            row = np.repeat(np.arange(batch.num_rows), n_asked)
            if not len(row):
                continue
            starts = np.cumsum(n_known) - n_known
            wanted = np.flatnonzero(batch.column("bound").to_numpy()[row] >= a.field("least").to_numpy() - SLACK)
            names, others = a.field("name").to_pylist(), b.field("name").to_pylist()
            ends = np.cumsum(n_known[row[wanted]])
            at = 0
            while at < len(wanted):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                some = wanted[at:to]
                at = to
                sizes = n_known[row[some]]
                begins = np.cumsum(sizes) - sizes
                i = np.repeat(some, sizes)
                j = np.arange(len(i)) + np.repeat(starts[row[some]] - begins, sizes)
                found = tx.jaro_winkler_pairs(names, others, i, j)
                best = np.maximum.reduceat(found, begins)
                # What may be the best once rounded.
                k = np.flatnonzero(found >= np.maximum(np.repeat(best, sizes), least) - SLACK)
                take = lambda x, p: x.take(pa.array(p))
                yield pa.RecordBatch.from_arrays([take(batch.column("kb_id"), row[i[k]]), take(a.field("name"), i[k]), take(b.field("entity_id"), j[k]), take(b.field("old_type"), j[k]), pa.array(found[k])], ["kb_id", "name", "entity_id", "old_type", "similarity"])

    found = pairs.mapInArrow(compare, "kb_id string, name string, entity_id string, old_type string, similarity double")
    found = found.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= least)
    return found.groupBy("kb_id", "name").agg(_better(F.struct("entity_id", "similarity", "old_type")).alias("m"))


def _better(m: Column) -> Column:
    return F.min_by(m, F.struct((-m["similarity"]).alias("s"), m["entity_id"].alias("e")))


def _listed(names: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """(keys..., name): names by shape, in lists of about ``NAMES``."""
    sizes = names.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(NAMES)).alias("lists"))
    return names.join(sizes, keys).groupBy(*keys, F.pmod(F.xxhash64("name"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct(*values)).alias(name)).drop("list")


def best_similar(new: DataFrame, entities: DataFrame, least: float = 0.0) -> DataFrame:
    """(new_id, entity_id, similarity, types_agree): the one most similar name in the knowledge base, ties to the first id; none under ``least``.

    Exact. Names are compared once each, and by shape first: names of the same letters and the same first four have one
    bound. A name is first compared with those of the shape of the highest bound, then with those of every other shape
    whose bound is not under what was found. Bounds of two blocks of shapes are one product; they are quadratic work where
    hardly two names have a shape in common.
    """
    a = cut(new.select("kb_id", F.col("id").alias("new_id"), tx.normalize_name(F.col("name")).alias("name"), F.col("type").alias("new_type")).filter("kb_id is not null and name is not null"), "new")
    asked = cut(a.select("kb_id", "name").distinct().withColumn("shape", tx.name_shape(F.col("name"))), "asked")
    b = entities.select("kb_id", F.col("id").alias("entity_id"), tx.normalize_name(F.col("name")).alias("name"), F.col("type").alias("old_type")).filter("kb_id is not null and name is not null")
    b = b.groupBy("kb_id", "name").agg(F.min_by(F.struct("entity_id", "old_type"), "entity_id").alias("m")).select("kb_id", "name", "m.*")
    known = cut(b.withColumn("their_shape", tx.name_shape(F.col("name"))), "known")
    lists = cut(_listed(known, ["kb_id", "their_shape"], ["name", "entity_id", "old_type"], "known"), "lists")
    theirs = cut(known.select("kb_id", F.col("their_shape").alias("shape")).distinct(), "shapes")
    ours = cut(asked.select("kb_id", "shape").distinct().withColumn("least", F.lit(float(least))), "shapes")
    order = F.struct("bound", "their_shape")
    first = cut(_near_shapes(ours, theirs, True).groupBy("kb_id", "shape").agg(F.max_by("their_shape", order).alias("their_shape"), F.max("bound").alias("bound")), "first")

    def compared(names: DataFrame, shapes: DataFrame) -> DataFrame:
        listed = _listed(names, ["kb_id", "shape"], ["name", "least"], "asked")
        work = listed.join(shapes, ["kb_id", "shape"]).join(lists, ["kb_id", "their_shape"]).select("kb_id", "bound", "asked", "known")
        return _best_of(work.repartition(_parts(a)), least)

    best = cut(compared(asked.withColumn("least", F.lit(float(least))), first), "best")
    reached = cut(asked.join(first.select("kb_id", "shape"), ["kb_id", "shape"]).join(best, ["kb_id", "name"], "left").select("kb_id", "shape", "name", F.coalesce("m.similarity", F.lit(float(least))).alias("least")), "reached")
    ours = cut(reached.groupBy("kb_id", "shape").agg(F.min("least").alias("least")), "shapes")
    rest = cut(_near_shapes(ours, theirs, False).join(first.select("kb_id", "shape", "their_shape"), ["kb_id", "shape", "their_shape"], "left_anti"), "rest")
    best = best.unionByName(compared(reached, rest)).groupBy("kb_id", "name").agg(_better(F.col("m")).alias("m"))
    agree = tx.types_match(F.col("new_type"), F.col("m.old_type"))
    return cut(a.join(best, ["kb_id", "name"]).select("new_id", "m.entity_id", "m.similarity", agree.alias("types_agree")), "similar")


def fuzzy_matches(new: DataFrame, entities: DataFrame, least: float = FUZZY) -> DataFrame:
    """(new_id, entity_id, similarity): the best one, if similar enough and its type agrees; no runner-up takes its place."""
    return best_similar(new, entities, least).filter(F.col("types_agree")).drop("types_agree")


def resolve(new: DataFrame, entities: DataFrame, ask: Callable[[dict, dict], bool] | None = None, may_ask: Column | None = None) -> DataFrame:
    """(new_id, entity_id, tier); entity_id is null for those without a match. ask: a model's answer for a pair in doubt; it is asked about all new rows, or those for which may_ask holds."""
    exact = cut(exact_matches(new, entities), "exact")
    left = new.join(exact, new.id == exact.new_id, "left_anti")
    similar = best_similar(left, entities, FUZZY if ask is None else ASK)
    close = (F.col("similarity") >= FUZZY) & F.col("types_agree")
    fuzzy = similar.filter(close).select("new_id", "entity_id")
    found = exact.withColumn("tier", F.lit("exact")).unionByName(fuzzy.withColumn("tier", F.lit("fuzzy")))
    if ask is not None:
        doubt = similar.filter(~close & (F.col("similarity") >= ASK)).join((new if may_ask is None else new.filter(may_ask)).select(F.col("id").alias("new_id"), F.struct("name", "type", "summary").alias("a")), "new_id").join(entities.select(F.col("id").alias("entity_id"), F.struct("name", "type", "summary").alias("b")), "entity_id")

        @F.pandas_udf("boolean")
        def same(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
            def one(x: dict, y: dict) -> bool:
                try:
                    return bool(ask(x, y))
                except Exception:  # a failed question is a no
                    return False

            return pd.Series([one(x, y) for x, y in zip(a.to_dict("records"), b.to_dict("records"), strict=True)])

        found = found.unionByName(doubt.filter(same("a", "b")).select("new_id", "entity_id", F.lit("asked").alias("tier")))
    return new.select(F.col("id").alias("new_id")).join(found, "new_id", "left")


def resolve_in_batch(mentions: DataFrame) -> DataFrame:
    """Adds entity_key to mentions (kb_id, text_id, position, name, type, summary): mentions of one text are matched in their order, each with those before it. A text's mentions are few; texts are independent, and a task goes through many of them as one stream."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = None
        seen: list[tuple[str, str, str, frozenset]] = []
        by_name: dict[str, list[int]] = {}

        def key(name: str, kind: str) -> str:
            agrees = lambda k: not kind or not k or k == kind
            match = next((seen[i][2] for i in by_name.get(name, ()) if agrees(seen[i][1])), None)
            if match is not None:
                return match
            letters = frozenset(name)
            best, at = 0.0, -1
            for i, (other, _, _, theirs) in enumerate(seen):
                # Letters that the other name lacks match nothing: most names are ruled out so.
                m = min(len(name) - len(letters - theirs), len(other) - len(theirs - letters))
                jaro = (m / len(name) + m / len(other) + 1) / 3 if m > 0 else 0.0
                if name == other or jaro + 0.4 * (1 - jaro) >= max(FUZZY, best):
                    score = jaro_winkler_similarity(name, other)
                    if score > best:
                        best, at = score, i
            if best >= FUZZY and agrees(seen[at][1]):
                return seen[at][2]
            match = name + "|" + kind
            by_name.setdefault(name, []).append(len(seen))
            seen.append((name, kind, match, letters))
            return match

        for batch in batches:
            keys = []
            for kb, text, name, kind in zip(*(batch.column(c).to_pylist() for c in ("kb_id", "text_id", "name", "type")), strict=True):
                if here != (kb, text):
                    here, seen, by_name = (kb, text), [], {}
                keys.append(key(" ".join((name or "").lower().split()), " ".join((kind or "").lower().split())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "entity_key"])

    fields = ", ".join(f"`{n}` {t}" for n, t in mentions.dtypes)
    ordered = mentions.repartition("kb_id", "text_id").sortWithinPartitions("kb_id", "text_id", F.asc_nulls_last("position"))
    return ordered.mapInArrow(keyed, f"{fields}, entity_key string")


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """(kb_id, text_id, entity_key, name, type, summary): first name, first type that says something, longest summary."""
    special = (F.trim(F.coalesce("type", F.lit(""))) != "") & (F.lower("type") != "concept")
    return mentions.groupBy("kb_id", "text_id", "entity_key").agg(
        tx.collapse_whitespace(F.min_by("name", "position")).alias("name"),
        F.coalesce(F.min_by("type", F.when(special, F.col("position"))), F.lit("concept")).alias("type"),
        F.min_by("summary", F.struct((-F.octet_length(F.coalesce("summary", F.lit("")))).alias("n"), "position")).alias("summary"),
    )


def endpoint(name: Column) -> Column:
    return tx.normalize_name(name)


def resolve_ends(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations (kb_id, source, target, ...) with source_id and target_id by names (kb_id, key, entity_id); those without both drop out."""
    for end in ("source", "target"):
        known = names.select("kb_id", F.col("key").alias(f"{end}_key"), F.col("entity_id").alias(f"{end}_id"))
        relations = relations.withColumn(f"{end}_key", endpoint(F.col(end))).join(known, ["kb_id", f"{end}_key"]).drop(f"{end}_key")
    return relations


def merge_relations(relations: DataFrame) -> DataFrame:
    """Relations of one batch that say the same become one: weights combined, longest summary."""
    order = F.struct((-F.octet_length(F.coalesce("summary", F.lit("")))).alias("n"), "position")
    return relations.groupBy("kb_id", "source_id", "type", "target_id").agg(wt.combine_all(wt.default_weight(F.col("weight"))).alias("weight"), F.min_by("summary", order).alias("summary"))
