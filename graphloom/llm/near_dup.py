"""Near-duplicate documents: a chosen-path similarity join on minwise signatures, confirmed on full sets.

A document's set is its distinct shingles of five words (A-Z lower-cased), as 64-bit hashes; with fewer words the whole
sequence is one shingle. Documents with the same set are one class, and only classes are joined.

1. A signature of ``POSITIONS`` minwise values is made of each set.
2. Chosen paths. A node starts as all classes. It branches on a position of the signature, picked by a seeded hash of
   the node's path so that all its members pick alike; members that agree on the value there go on together. Independent
   trees are repeated to reach the target recall; their first branches are dealt without repetition, since the same
   first branch would hold the same classes. Nodes of one class end. Nodes of up to ``SMALL`` classes are compared
   exhaustively by signature; larger ones branch again, level by level, with all their classes: what a class met in
   smaller nodes says nothing about those it shares only large ones with, by a passage that many hold. A node goes on
   by one position, so a level has no more rows than the one before. Those still large after ``DEPTH`` levels agree on
   so many values that they are taken as related as they are: this only gives more to confirm.
3. Stars. Each related class is confirmed on full sets against the smallest class it is related to:
   100 * intersection >= 75 * union. The members of a star are dealt into groups of ``STAR_MEMBERS``, each with its own
   copy of the star's centre, so a group of g near copies is g comparisons in many tasks.
4. Rests. Related classes form families (connected components). A family that its stars have connected is done. In the
   others, the largest connected part need not be looked at within itself: the rest of the family is compared with itself
   and with that part, all pairs that are not connected yet. Sets that exceed ``CHUNK_BYTES`` are cut into chunks, and
   each pair of chunks that has such pairs is a task, so none holds an unbounded group and no pair is left out.
5. Confirmed links give the components. Pairs already connected need no link of their own, so a group of g copies has
   g - 1 links, never all pairs.

A pair with similarity 0.75 shares a first branch on about 20 of the 27 dealt positions, and each of the two further
levels keeps it with probability 0.75 in each, however large the nodes are: it is lost by the paths with a probability of
(1 - 0.75 * 0.75 * 0.75)^27, under 1e-6. Signatures agree on at least half their positions with probability 0.99999.

Null and empty texts have an empty set and are linked with nothing. Very long texts are sets like others; a task holds a
few of them at a time. Rows that share an id are one document with several sets. Rows without an id have no component and
are kept. An empty table gives no rows. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.components import connected_components

SHINGLE = 5
#: Similarity of linked documents, in hundredths.
PERCENT = 75
POSITIONS = 64
#: First branches are dealt as if each tree had 1 / similarity of them, so that a path goes on for similar pairs.
BRANCHES = POSITIONS * PERCENT // 100
TREES = 20
SMALL, DEPTH = 256, 3
#: Least number of agreeing positions of related classes.
AGREE = POSITIONS // 2
#: Bytes of the sets of a chunk of a family.
CHUNK_BYTES = 16 << 20
#: Members that one task compares with a copy of a star's centre.
STAR_MEMBERS = 256
#: Class numbers that are sent to all tasks: at 24 bytes each in memory, under 16 MB.
BROADCAST_IDS = 600_000
REMEMBERED = 300_000
_kept: dict = {}

_random = np.random.default_rng(20)
_TIMES = _random.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
#: First branches of all trees.
FIRST = sorted(int(p) for p in _random.permutation(POSITIONS)[: round(TREES * POSITIONS / BRANCHES)])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word to a 64-bit hash; remembered by each worker."""

    def __init__(self) -> None:
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        found = self.hash(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found

    def shingles(self, text: bytes, size: int = SHINGLE) -> np.ndarray:
        """The distinct shingles of a text as ascending 64-bit hashes."""
        found = common.words(text)
        if not found:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        width = min(size, len(found))
        mixed = np.full(len(found) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = (mixed ^ hashes[k : len(found) - width + 1 + k]) * _A
            mixed ^= mixed >> np.uint64(29)
        mixed *= _B
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the minwise values."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, (_TIMES[:, None] * part[None, :] + _PLUS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame) -> DataFrame:
    """docs (id, text) to (id, n, digest, values, sketch); digest, values and sketch are null for an empty set."""
    out = {"id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "values": pa.binary(), "sketch": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.worker_cache(_kept, "words", WordHashes)
        for batch in common.pieces(batches):
            sets = [hashes.shingles(t) for t in common.column_bytes(batch.column(1))]
            signs = [signature(s) if len(s) else None for s in sets]
            yield common.record_batch(
                out,
                id=batch.column(0),
                n=[len(s) for s in sets],
                digest=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                values=[None if s is None else s.tobytes() for s in signs],
                sketch=[None if s is None else (s & 0xFFFF).astype("<u2").tobytes() for s in signs],
            )

    return common.map_arrow(docs, run, "id long, n long, digest binary, values binary, sketch binary")


def _value(position: Column) -> Column:
    return F.substring(F.col("values"), position * 4 + 1, F.lit(4))


def _sized(rows: DataFrame) -> DataFrame:
    """Members of nodes of two and more, with the node's size and first member. Sums by node are stored and joined back: Spark can then split the rows of a large node among tasks."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("class").alias("first")).filter("size > 1")
    return rows.join(common.materialize(sizes, "sizes"), "node")


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows sorted by their first columns, as lists of columns per group; groups may span batches."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        lead = list(zip(*columns[:keys], strict=True))
        at = 0
        for i in range(1, len(lead) + 1):
            if i == len(lead) or lead[i] != lead[at]:
                part = [c[at:i] for c in columns]
                if held is not None and [h[0] for h in held[:keys]] == list(lead[at]):
                    for h, p in zip(held, part, strict=True):
                        h += p
                else:
                    if held is not None:
                        yield held
                    held = part
                at = i
    if held is not None:
        yield held


def link(label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what near() finds. label: equal for what is connected already. near(i, others): which of others are near i; only those not yet connected to i are asked for."""
    links = []
    for i in range(len(label) - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(others):
            for j in near(i, others):
                if label[j] != label[i]:
                    links.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return links


def _compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, class, sketch), sorted by node, to related pairs (a, b)."""
    a: list[int] = []
    b: list[int] = []
    for _, classes, found in _by_group(batches, 1):
        signs = np.frombuffer(b"".join(found), "<u2").reshape(-1, POSITIONS)
        pairs = link(np.arange(len(classes)), lambda i, others, s=signs: others[(s[others] == s[i]).sum(axis=1) >= AGREE])
        a += [classes[i] for i, _ in pairs]
        b += [classes[j] for _, j in pairs]
        if len(a) >= 20_000:
            yield common.record_batch({"a": pa.int64(), "b": pa.int64()}, a=a, b=b)
            a, b = [], []
    if a:
        yield common.record_batch({"a": pa.int64(), "b": pa.int64()}, a=a, b=b)


def related(classes: DataFrame) -> DataFrame:
    """classes (class, values, sketch) to links (a, b) that connect all classes that share a path and agree."""
    firsts = F.array(*[F.xxhash64(F.lit(p), _value(F.lit(p))) for p in FIRST])
    level = common.materialize(_sized(classes.select(F.explode(firsts).alias("node"), "class")), "level")
    edges = None
    for depth in range(1, DEPTH + 1):
        small = level.filter(F.col("size") <= SMALL).join(classes.select("class", "sketch"), "class")
        sorted_rows = small.select("node", "class", "sketch").repartition("node").sortWithinPartitions("node", "class")
        found = common.map_arrow(sorted_rows, _compare_small, "a long, b long")
        edges = found if edges is None else edges.union(found)
        large = level.filter(F.col("size") > SMALL)
        if depth == DEPTH:
            edges = edges.union(large.filter("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b")))
            break
        if large.isEmpty():
            break
        position = F.pmod(F.xxhash64(F.col("node"), F.lit(depth)), F.lit(POSITIONS)).cast("int")
        grown = large.select("node", "class").join(classes.select("class", "values"), "class").withColumn("p", position)
        level = common.materialize(_sized(grown.select(F.xxhash64("node", "p", _value(F.col("p"))).alias("node"), "class")), "level")
    return edges.distinct()


class Sets:
    """Full sets with their sketches; near() confirms on the sets."""

    def __init__(self, shingles: list[bytes], sketches: list[bytes]):
        self.sets = [np.frombuffer(s, np.uint64) for s in shingles]
        self.sizes = np.array([len(s) for s in self.sets])
        self.signs = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, POSITIONS)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        sizes = self.sizes
        least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * least >= PERCENT * most]
        others = others[(self.signs[others] == self.signs[i]).sum(axis=1) >= AGREE]
        good = []
        for at in range(0, len(others), 512):
            part = others[at : at + 512]
            both = np.concatenate([self.sets[j] for j in part])
            place = np.minimum(np.searchsorted(self.sets[i], both), sizes[i] - 1)
            inside = np.add.reduceat((self.sets[i][place] == both).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            good.append(part[100 * inside >= PERCENT * (sizes[part] + sizes[i] - inside)])
        return np.concatenate(good) if good else others


_LINKS = {"a": pa.int64(), "b": pa.int64()}


def _confirm_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (star, slot, member, class, shingles, sketch), sorted by the first four, to confirmed links (a, b) of the centre, whose rows come first, with members."""
    for star, _, member, classes, shingles, sketches in _by_group(batches, 2):
        sets, is_member = Sets(shingles, sketches), np.array(member, bool)
        members = np.flatnonzero(is_member)
        found = {classes[j] for i in np.flatnonzero(~is_member) for j in sets.near(int(i), members)} if len(members) else set()
        if found:
            yield common.record_batch(_LINKS, a=[star[0]] * len(found), b=sorted(found))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, i, j, chunk, part, class, shingles, sketch), sorted by the first three, to confirmed links (a, b) within a chunk, or between two chunks."""
    for _, i, j, chunk, part, classes, shingles, sketches in _by_group(batches, 3):
        sets, side = Sets(shingles, sketches), np.array(chunk)
        both = i[0] != j[0]

        def near(k: int, others: np.ndarray, sets: Sets = sets, side: np.ndarray = side, both: bool = both) -> np.ndarray:
            return sets.near(k, others[side[others] != side[k]] if both else others)

        if pairs := link(np.unique(np.array(part), return_inverse=True)[1], near):
            yield common.record_batch(_LINKS, a=[classes[x] for x, _ in pairs], b=[classes[y] for _, y in pairs])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, text) to rows (class, shingles, sketch)."""
    hashes = common.worker_cache(_kept, "words", WordHashes)
    for batch in common.pieces(batches):
        sets = [hashes.shingles(t) for t in common.column_bytes(batch.column(1))]
        signs = [(signature(s) & 0xFFFF).astype("<u2").tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(signs, pa.binary())], names=["class", "shingles", "sketch"])


def star_links(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of each class with the smallest class it is related to."""
    stars = common.materialize(edges.groupBy("b").agg(F.min("a").alias("star")), "stars")
    slots = stars.groupBy("star").agg(F.ceil(F.count("*") / F.lit(STAR_MEMBERS)).cast("int").alias("slots"))
    members = stars.join(slots, "star").select("star", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), F.lit(1).alias("member"), F.col("b").alias("class"))
    centres = slots.select("star", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("member"), F.col("star").alias("class"))
    rows = members.unionByName(centres).join(sets, "class").select("star", "slot", "member", "class", "shingles", "sketch")
    return common.map_arrow(rows.repartition("star", "slot").sortWithinPartitions("star", "slot", "member", "class"), _confirm_stars, "a long, b long")


def rest_links(families: DataFrame, parts: DataFrame, sizes: DataFrame, sets: DataFrame, chunk_bytes: int) -> DataFrame:
    """Confirmed links (a, b) within families that parts do not connect. families: (node, root); parts: (node, root) of what is connected; sizes: (class, bytes)."""
    placed = families.select(F.col("node").alias("class"), F.col("root").alias("family")).join(parts.select(F.col("node").alias("class"), F.col("root").alias("part")), "class", "left")
    placed = placed.withColumn("part", F.coalesce("part", "class")).join(sizes, "class")
    placed = common.materialize(placed.groupBy("family", "part", "class").agg(F.sum("bytes").alias("bytes")), "placed")
    by_part = placed.groupBy("family", "part").agg(F.sum("bytes").alias("bytes"))
    largest = by_part.groupBy("family").agg(F.max_by("part", F.struct("bytes", "part")).alias("largest"), F.max("bytes").alias("held"), F.sum("bytes").alias("all"), F.count("*").alias("n")).filter("n > 1")
    cuts = lambda b: F.greatest(F.lit(1), F.ceil(b / F.lit(chunk_bytes))).cast("int")
    largest = largest.select("family", "largest", cuts(F.col("all") - F.col("held")).alias("rests"), cuts(F.col("held")).alias("others"))
    rows = placed.drop("bytes").join(largest, "family")
    is_rest = F.col("part") != F.col("largest")
    chunk = F.when(is_rest, F.pmod(F.xxhash64("class"), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64("class"), F.col("others"))).cast("int")
    # Chunks of the rest meet each other and those of the largest part, which meet no other of their own.
    meets = F.sequence(F.lit(0), F.when(is_rest, F.col("rests") + F.col("others")).otherwise(F.col("rests")) - 1)
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(meets))
    rows = rows.select("family", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "part", "class")
    met = rows.join(sets, "class").select("family", "i", "j", "chunk", "part", "class", "shingles", "sketch")
    return common.map_arrow(met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "class"), _confirm, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = common.materialize(sketches(texts), "sketches")
    roots = set_roots(known, texts, chunk_bytes)
    found = known.select("id", "n", "digest").join(roots, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("set_root", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def set_roots(known: DataFrame, texts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(d, set_root): for the digest of each set of known (see sketches) the smallest id of its component. texts: (id, text)."""
    whole = known.filter("digest is not null and id is not null")
    classes = common.materialize(whole.groupBy("digest").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("values").alias("values"), F.first("sketch").alias("sketch")), "classes")
    edges = common.materialize(related(classes), "edges")
    families = connected_components(edges)
    members = common.materialize(families.select(F.col("node").alias("class")), "members")
    few = members.count() <= BROADCAST_IDS
    read = texts.join(F.broadcast(members) if few else members, texts.id == members["class"]).select("class", "text")
    sets = common.materialize(common.map_arrow(read, _full_sets, "class long, shingles binary, sketch binary").filter("length(shingles) > 0"), "sets")
    links = common.materialize(star_links(edges, sets), "star-links")
    sizes = sets.select("class", F.length("shingles").alias("bytes")).groupBy("class").agg(F.sum("bytes").alias("bytes"))
    more = rest_links(families, connected_components(links), sizes, sets, chunk_bytes)
    roots = connected_components(links.unionByName(more))
    return classes.select(F.col("digest").alias("d"), "class").join(roots, F.col("class") == F.col("node"), "left").select("d", F.coalesce("root", "class").alias("set_root"))
