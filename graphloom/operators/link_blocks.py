"""Links of a graph as blocks of numbers, for rounds that visit all of them.

A node is known by a hash of its id, whose high bits choose one of p parts of the nodes; a relation lies in the block of the
parts of its ends, once for both directions. Blocks, and what rounds make of them, are files in the shared folder, on any
file system that Arrow knows; a task reads the blocks it is told of, and what it writes appears by one rename. A round moves
numbers of nodes only: each block takes the gifts of its ends and gives their sums. A node of very many links has them in p
blocks. Hashes are checked: two nodes of one hash have all of them made anew, and ids of relations that may be there twice
are compared as they are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import cut, fresh

#: Relations that are dealt at once, and links and nodes of a task that is worth starting.
DEALT, TASK_LINKS, TASK_NODES = 1 << 19, 1 << 20, 1 << 17


def _put(at: str, data: bytes) -> None:
    files, path = fs.FileSystem.from_uri(at)
    # Object stores have no folders, and a local one must be there.
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, path)


def _get(at: str) -> pa.Buffer:
    files, path = fs.FileSystem.from_uri(at)
    with files.open_input_file(path) as f:
        return f.read_buffer()


def _put_arrays(at: str, *arrays: np.ndarray) -> None:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "int64")
    # Each begins at a multiple of 8 bytes.
    _put(at, b"".join([head.tobytes(), *(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays)]))


def _get_arrays(at: str, *kinds: str) -> list[np.ndarray]:
    data = _get(at)
    sizes = np.frombuffer(data, "int64", 1 + len(kinds))[1:]
    found, start = [], 8 * (1 + len(kinds))
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        found.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, start))
        start += size + -size % 8
    return found


def _packed(names: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([names], ["node"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: object) -> pa.Array:
    with pa.ipc.open_stream(data) as r:
        return r.read_all().column("node").combine_chunks()


def _whole(parts: list[pa.Array]) -> pa.Array:
    found = pa.chunked_array(parts).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _part(hashes: np.ndarray, p: int) -> np.ndarray:
    return ((hashes.view("uint64") >> np.uint64(40)) % np.uint64(p)).astype("uint16")


def _deal(p: int, buckets: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (g, a, b): hashes of relation ids by bucket, then of ends by block, then of nodes by part, with their names when a task first meets them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, seen_check = np.empty(0, "int64"), np.empty(0, "int32")

        def split(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            for which in np.split(order, starts[1:]):
                if len(which):
                    yield int(group[which[0]]), which

        def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal seen, seen_check
            column = lambda name: _whole([b.column(name) for b in held])
            rows: list[tuple[int, bytes, bytes]] = []
            if with_ids:
                ids = column("id_hash").to_numpy()
                rows += [(g, ids[which].tobytes(), b"") for g, which in split(_part(ids, buckets).astype("int32"))]
            a, b = column("a").to_numpy(), column("b").to_numpy()
            i, j = _part(a, p).astype("int32"), _part(b, p).astype("int32")
            both = np.concatenate([a, b])
            turned = i > j
            a, b, i, j = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, j, i), np.where(turned, i, j)
            rows += [(buckets + g, a[which].tobytes(), b[which].tobytes()) for g, which in split(i * p + j)]
            # A second hash tells names of one hash apart; those that differ are named too, and found when the part is built.
            check = np.concatenate([column("check_a").to_numpy(), column("check_b").to_numpy()])
            order = np.argsort(both)
            some, check = both[order], check[order]
            first = np.diff(some, prepend=some[0] ^ 1) != 0
            first[1:] |= check[1:] != check[:-1]
            some, check, order = some[first], check[first], order[first]
            place = np.searchsorted(seen, some)
            if len(seen):
                met = np.minimum(place, len(seen) - 1)
                new = (seen[met] != some) | (seen_check[met] != check)
                some, check, order, place = some[new], check[new], order[new], place[new]
            seen, seen_check = np.insert(seen, place, some), np.insert(seen_check, place, check)
            names = _whole([*(x.column("source_id") for x in held), *(x.column("target_id") for x in held)]).take(pa.array(order))
            rows += [(buckets + p * p + g, some[which].tobytes(), _packed(names.take(pa.array(which)))) for g, which in split(_part(some, p).astype("int32"))]
            g, x, y = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["g", "a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= DEALT:
                yield dealt(held)
                held = []
        if held:
            yield dealt(held)

    return deal


def _build(folder: str, p: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the files of blocks and parts. Rows (g, n, again): how many links or nodes, -1 where two nodes have one hash; hashes of ids that came more than once."""

    def built(g: int, a: list[bytes], b: list[bytes]) -> tuple[int, int, list[int]]:
        x = np.frombuffer(b"".join(a), "int64")
        if g < buckets:
            x = np.sort(x)
            return g, len(x), np.unique(x[1:][x[1:] == x[:-1]]).tolist()
        if g < buckets + p * p:
            i, j = divmod(g - buckets, p)
            left, at_left = np.unique(x, return_inverse=True)
            right, at_right = np.unique(np.frombuffer(b"".join(b), "int64"), return_inverse=True)
            # In a fixed order, so that sums are the same in every run.
            at = np.sort(at_left * len(right) + at_right)
            counts = np.bincount(at // len(right), minlength=len(left))
            _put_arrays(f"{folder}/ends-{i}-{j}", left, right)
            _put_arrays(f"{folder}/links-{i}-{j}", counts.astype("int32"), (at % len(right)).astype("int32"))
            return g, len(at), []
        i = g - buckets - p * p
        names = _whole([_unpacked(y) for y in b])
        order = np.argsort(x, kind="stable")
        x, names = x[order], names.take(pa.array(order))
        same = np.flatnonzero(x[1:] == x[:-1])
        one, other = names.take(pa.array(same)), names.take(pa.array(same + 1))
        alike = pc.or_(pc.fill_null(pc.equal(one, other), False), pc.and_(pc.is_null(one), pc.is_null(other)))
        if not pc.all(alike, min_count=0).as_py():
            return g, -1, []
        keep = np.flatnonzero(np.diff(x, prepend=x[0] ^ 1) != 0)
        _put_arrays(f"{folder}/nodes-{i}", x[keep])
        _put(f"{folder}/names-{i}", _packed(names.take(pa.array(keep))))
        return g, len(keep), []

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, a, b = [], None, [], []
        for batch in batches:
            for g, x, y in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "b")), strict=True):
                if g != now and a:
                    made.append(built(now, a, b))
                    a, b = [], []
                now = g
                a.append(x)
                b.append(y)
        if a:
            made.append(built(now, a, b))
        g, n, again = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(n, pa.int64()), pa.array(again, pa.list_(pa.int64()))], ["g", "n", "again"])

    return build


@dataclass
class LinkBlocks:
    folder: str
    #: Links of each block that has any, and nodes of each part that has any.
    blocks: dict[tuple[int, int], int]
    parts: dict[int, int]

    @property
    def nodes(self) -> int:
        return sum(self.parts.values())


def link_blocks(edges: DataFrame) -> LinkBlocks:
    """The relations (source_id, target_id, and id: each counts once) as blocks; as many parts as give about a block for each shuffle partition."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = max(1, math.isqrt(buckets - 1) + 1)
    with_ids = "id" in edges.columns
    for salt in count():
        folder = fresh(spark, "links")
        code = lambda name: F.xxhash64(F.lit(salt), F.col(name))
        asked = edges.select("source_id", "target_id", code("source_id").alias("a"), code("target_id").alias("b"), F.hash("source_id").alias("check_a"), F.hash("target_id").alias("check_b"), *([code("id").alias("id_hash")] if with_ids else []))
        # A task that sees more relations names fewer nodes that others name too.
        dealt = asked.coalesce(max(1, buckets // 3)).mapInArrow(_deal(p, buckets, with_ids), "g int, a binary, b binary")
        made = cut(dealt.repartition(buckets, "g").sortWithinPartitions("g").mapInArrow(_build(folder, p, buckets), "g int, n long, again array<long>"), "built")
        sizes = {r["g"]: r["n"] for r in made.filter(F.col("g") >= buckets).select("g", "n").collect()}
        again = made.select(F.explode("again").alias("id_hash"))
        if with_ids and not again.isEmpty():
            coded = edges.withColumn("id_hash", code("id"))
            once = coded.join(again, "id_hash", "left_anti")
            edges, with_ids = once.unionByName(coded.join(again, "id_hash", "left_semi").dropDuplicates(["id"])).select(*edges.columns), False
        elif min(sizes.values(), default=0) >= 0:
            break
    end = buckets + p * p
    return LinkBlocks(folder, {divmod(g - buckets, p): n for g, n in sizes.items() if g < end}, {g - end: n for g, n in sizes.items() if g >= end})


def _tasks(sizes: dict, most: int) -> list[list]:
    """Keys by task, about as much work in each."""
    tasks: list[list] = [[] for _ in range(min(len(sizes), -(-sum(sizes.values()) // most)))]
    loads = [0] * len(tasks)
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        least = loads.index(min(loads))
        tasks[least].append(key)
        loads[least] += sizes[key]
    return tasks


def _each(df: DataFrame, tasks: list[list], work: Callable[[object], float]) -> list[float]:
    """work() of every key, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(key) for t in batch.column("id").to_pylist() for key in tasks[t]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["found"])

    rows = df.sparkSession.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "found double").collect()
    return [r["found"] for r in rows]


def pagerank(edges: DataFrame, seeds: list[str], n_seeds: int, alpha: float, rounds: int, epsilon: float) -> DataFrame:
    """(node, rank) of graph.pagerank, for at least one seed."""
    spark = edges.sparkSession
    held = link_blocks(edges)
    folder, blocks, parts, n = held.folder, sorted(held.blocks), sorted(held.parts), held.nodes
    if not n:
        return spark.createDataFrame([], "node string, rank double")
    by_links, by_nodes = _tasks(held.blocks, TASK_LINKS), _tasks(held.parts, TASK_NODES)

    def place(block: tuple[int, int]) -> float:
        i, j = block
        ends = _get_arrays(f"{folder}/ends-{i}-{j}", "int64", "int64")
        _put_arrays(f"{folder}/at-{i}-{j}", *(np.searchsorted(_get_arrays(f"{folder}/nodes-{x}", "int64")[0], e).astype("int32") for x, e in zip(block, ends, strict=True)))
        return 0.0

    def scatter(at: int) -> Callable[[tuple[int, int]], float]:
        """Sums of the gifts of a round, block by block; of ones in the first, which gives degrees."""

        def work(block: tuple[int, int]) -> float:
            i, j = block
            if not at:
                place(block)
            counts, other = _get_arrays(f"{folder}/links-{i}-{j}", "int32", "int32")
            places = _get_arrays(f"{folder}/at-{i}-{j}", "int32", "int32")
            left, right = (_get_arrays(f"{folder}/{at}/gift-{x}", "float64")[0][w] if at else np.ones(len(w)) for x, w in zip(block, places, strict=True))
            to_left = np.add.reduceat(right[other], np.cumsum(counts) - counts)
            to_right = np.bincount(other, weights=np.repeat(left, counts), minlength=len(right))
            _put_arrays(f"{folder}/{at}/sums-{i}-{j}", to_left, to_right)
            return 0.0

        return work

    def given(part: int, at: int) -> np.ndarray:
        total = np.zeros(held.parts[part])
        for block in blocks:
            if part in block:
                i, j = block
                places = _get_arrays(f"{folder}/at-{i}-{j}", "int32", "int32")
                sums = _get_arrays(f"{folder}/{at}/sums-{i}-{j}", "float64", "float64")
                for x, w, s in zip(block, places, sums, strict=True):
                    if x == part:
                        total[w] += s
        return total

    def start(part: int) -> float:
        names = _unpacked(_get(f"{folder}/names-{part}"))
        degree = given(part, 0)
        seed = pc.is_in(names, value_set=pa.array(seeds, pa.string())).to_numpy(zero_copy_only=False) / n_seeds
        # No join meets a node without an id: it gives nothing and is given nothing.
        met = names.is_valid().to_numpy(zero_copy_only=False).astype("float64")
        rank = np.full(len(names), 1.0 / n)
        _put_arrays(f"{folder}/about-{part}", degree, seed, met)
        _put_arrays(f"{folder}/1/rank-{part}", rank)
        _put_arrays(f"{folder}/1/gift-{part}", rank / degree * met)
        return 0.0

    def settle(at: int) -> Callable[[int], float]:
        def work(part: int) -> float:
            degree, seed, met = _get_arrays(f"{folder}/about-{part}", "float64", "float64", "float64")
            rank = _get_arrays(f"{folder}/{at}/rank-{part}", "float64")[0]
            new = alpha * seed + (1 - alpha) * given(part, at) * met
            _put_arrays(f"{folder}/{at + 1}/rank-{part}", new)
            _put_arrays(f"{folder}/{at + 1}/gift-{part}", new / degree * met)
            return float(np.abs(new - rank).max())

        return work

    files, path = fs.FileSystem.from_uri(folder)
    _each(edges, by_links, scatter(0))
    _each(edges, by_nodes, start)
    files.delete_dir(f"{path}/0")
    for i, j in blocks:
        files.delete_file(f"{path}/ends-{i}-{j}")
    last = 1
    for at in range(1, rounds + 1):
        _each(edges, by_links, scatter(at))
        change = max(_each(edges, by_nodes, settle(at)))
        files.delete_dir(f"{path}/{at}")
        last = at + 1
        if change < epsilon:
            break

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                names = _unpacked(_get(f"{folder}/names-{parts[k]}"))
                rank = pa.array(_get_arrays(f"{folder}/{last}/rank-{parts[k]}", "float64")[0])
                for row in range(0, len(names), 1 << 16):
                    yield pa.RecordBatch.from_arrays([names.slice(row, 1 << 16), rank.slice(row, 1 << 16)], ["node", "rank"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(ranks, "node string, rank double")
