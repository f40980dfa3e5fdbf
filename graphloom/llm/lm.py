"""A hidden Markov language model.

Tokens are words with A-Z lower-cased, and one end per text. Training counts every token of every training text
(``word_counts``). The model's symbols are about ``SYMBOLS`` words, the most frequent ones (of the words of the least such
level of counts, a share by their hash), the end, and classes of rarer words by their last letters; a rarer word is its
class's symbol, then the word within its class:

    P(word | state) = P(class | state) * (c + 1) / (N_class + V_class + 1)

where words without a count share the one that is added. So the model is exact over all texts, and its states and
emissions stay of a fixed size while the counts grow with the corpus.

All texts are read once as symbols and stored so, with their rarer words. Baum-Welch trains the states in ``ROUNDS``
rounds, each over all training texts, at every size: each task adds up the expected counts of its texts, and the sums over
tasks give the next model. The scaled forward recursion over a text's symbols gives its exact likelihood; the counts of
rarer words, which do not depend on states, come through a join of these words with the corpus's counts. The most frequent
of them is still in many texts of a very large corpus: its rows are a skewed partition of that join, which Spark splits.

Null and empty texts are a lone end. Repeated rows are each counted and scored. With no training texts all counts are 0
and the model is uniform; an empty table gives no rows. Extra columns play no part, whatever their names. Long texts are
processed step by step, in memory in proportion to a batch.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

STATES = 6
#: Most frequent words, about, which are symbols of their own and whose counts go to all tasks.
SYMBOLS = 65_536
#: Classes of rarer words.
CLASSES = 2048
#: Rounds of Baum-Welch over all training texts.
ROUNDS = 7
#: Added to expected counts.
PRIOR = 0.05
#: Distinct words that a counting task holds before it sends them on.
HELD = 400_000
#: Tokens of the texts that are trained on side by side, but for a longer text.
BATCH_TOKENS = 1_500_000
#: Tokens of a text that is trained on beside others as long.
LONG = 1500
#: Texts that are read at once.
TEXTS = 1024
_kept: dict = {}


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (text) to (word, c): tasks count their own words first, so that a frequent word is a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = common.record_batch({"word": pa.binary(), "c": pa.int64()}, word=list(held), c=list(held.values()))
            held.clear()
            return out

        for batch in common.pieces(batches):
            for text in common.column_bytes(batch.column(0)):
                held.update(common.words(text))
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return common.map_arrow(texts, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_class(word: bytes) -> int:
    """A rarer word's class: by its last letters, which tell languages apart, and its kind of length."""
    return zlib.crc32(word[-3:] + (b"+" if len(word) > 24 else b"")) % CLASSES


class Symbols:
    """Words to symbols. frequent: words in order; then the classes, then the end."""

    def __init__(self, frequent: list[bytes], counts: list[int]):
        self.number = {w: i for i, w in enumerate(frequent)}
        self.counts = np.array([*counts, 0], np.int64)
        self.n_words = len(frequent)
        self.end = self.n_words + CLASSES
        self.size = self.end + 1

    def of(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """The symbols of a text with its end, and its rare words in order."""
        found = common.words(text)
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
        rare = [found[i] for i in np.flatnonzero(numbers < 0)]
        numbers[numbers < 0] = [self.n_words + word_class(w) for w in rare]
        return np.append(numbers, np.int32(self.end)), rare


class Model:
    """start (S), move (S, S), emit (symbols, S): probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.by_state = np.ascontiguousarray(emit.T)

    @staticmethod
    def first(states: int, shares: np.ndarray, seed: int = 7) -> Model:
        """Near the shares of symbols in the corpus, with seeded noise, and states that tend to stay."""
        random = np.random.default_rng(seed)
        emit = shares[:, None] * random.gamma(2.0, 0.5, (len(shares), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        """Expected counts to probabilities; every symbol keeps a share of a small prior, in proportion to the corpus."""
        states = len(start)
        emit = emit + PRIOR * len(shares) * shares[:, None] / 4
        return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0)) if states else Model(start, move, emit)


def packed(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by step, then text, without gaps; how many texts are as long as each step; where each step begins. Texts come longest first."""
    lengths = np.array([len(s) for s in sequences])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    begin = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(begin[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cells = np.empty(begin[-1], np.int32)
    cells[begin[step] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate(sequences)
    return cells, active, begin


def longest_first(sequences: list[np.ndarray]) -> np.ndarray:
    return np.argsort([-len(s) for s in sequences], kind="stable")


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion; sequences come longest first."""
    cells, active, begin = packed(sequences)
    total, held, ones = np.zeros(len(sequences)), np.empty((0, 0)), np.ones(len(model.start))
    for step, n in enumerate(active):
        emitted = model.emit[cells[begin[step] : begin[step + 1]]]
        held = (model.start * emitted) if step == 0 else (held[:n] @ model.move) * emitted
        scale = held @ ones
        held /= scale[:, None]
        total[:n] += np.log10(scale)
    return total


def expected(model: Model, sequences: list[np.ndarray], sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the expected counts of starts, moves and emissions to sums; sequences come longest first.

    Arrays have a row per state. The texts of a step are the first of those of the step before it, so all steps work on
    slices side by side.
    """
    cells, active, begin = packed(sequences)
    ones, there = np.ones((1, len(model.start))), np.ascontiguousarray(model.move.T)
    emitted = model.by_state[:, cells]
    alphas = np.empty_like(emitted)
    at, counts = begin.tolist(), active.tolist()
    for step, n in enumerate(counts):
        now, here = emitted[:, at[step] : at[step + 1]], alphas[:, at[step] : at[step + 1]]
        before = model.start[:, None] if step == 0 else there @ alphas[:, at[step - 1] : at[step - 1] + n]
        np.multiply(before, now, out=here)
        inverse = 1 / (ones @ here)
        here *= inverse
        now *= inverse
    start, move, emit = sums
    # Backward: emitted becomes what a text's step and those after it give, alphas the share of each state.
    beta, moved = np.ones((len(ones[0]), len(sequences))), np.zeros_like(move)
    for step in range(len(counts) - 1, 0, -1):
        now, later = emitted[:, at[step] : at[step + 1]], beta[:, : counts[step]]
        before = alphas[:, at[step - 1] : at[step - 1] + counts[step]]
        now *= later
        moved += before @ now.T
        np.matmul(model.move, now, out=later)
        before *= later
    start += alphas[:, : at[1]].sum(axis=1)
    move += model.move * moved
    for k in range(len(alphas)):
        emit[:, k] += np.bincount(cells, alphas[k], len(emit))


def class_of(word: Column) -> Column:
    """word_class() as a column."""
    mark = F.when(F.octet_length(word) > 24, F.lit("+")).otherwise(F.lit("")).cast("binary")
    return (F.crc32(F.concat(F.substring(word, -3, 3), mark)) % CLASSES).cast("int")


def read_texts(texts: DataFrame, symbols, mark: str, end_count: int, unit: float) -> DataFrame:
    """texts (id, text, held_out, learnt) to (row, id, held_out, learnt, symbols, rare, n_known, base): each text's symbols with its end as 32-bit numbers, its rarer words in order, and the count of known tokens and base score without the counts of rarer words."""
    schema = "row long, id long, held_out boolean, learnt boolean, symbols binary, rare array<binary>, n_known long, base double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.worker_cache(_kept, mark, lambda: Symbols(*symbols.value))
        logs = np.log10((np.concatenate([known.counts[:-1], np.zeros(CLASSES), [end_count]]) + 1) * unit)
        counted = np.concatenate([np.ones(known.n_words, np.int64), np.zeros(CLASSES, np.int64), [int(end_count > 0)]])
        for batch in common.pieces(batches, TEXTS):
            read = [known.of(t) for t in common.column_bytes(batch.column(1))]
            flat = np.concatenate([s for s, _ in read])
            first = np.cumsum([0, *[len(s) for s, _ in read[:-1]]])
            places = np.cumsum([0, *[len(r) for _, r in read]])
            rare = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array([w for _, r in read for w in r], pa.binary()))
            stored = pa.array([s.astype("<i4").tobytes() for s, _ in read], pa.binary())
            rows = pa.array(row_numbers(len(read)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), batch.column(3), stored, rare, pa.array(np.add.reduceat(counted[flat], first)), pa.array(np.add.reduceat(logs[flat], first))], names=["row", "id", "held_out", "learnt", "symbols", "rare", "n_known", "base"])

    return common.map_arrow(texts, run, schema)


def expected_counts(texts: DataFrame, model, size: int, states: int) -> DataFrame:
    """texts (symbols) to (symbol, counts): sums over all texts; symbol -1 has starts, -2 and below have moves from each state. Each task sends only symbols that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        # Long texts wait for each other, as a step costs about the same for few texts as for many.
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        tokens = {False: 0, True: 0}

        def add(kind: bool) -> None:
            expected(model.value, [held[kind][i] for i in longest_first(held[kind])], sums)
            held[kind].clear()
            tokens[kind] = 0

        for batch in batches:
            for text in batch.column(0).to_pylist():
                sequence = np.frombuffer(text, "<i4")
                kind = len(sequence) > LONG
                if held[kind] and tokens[kind] + len(sequence) > BATCH_TOKENS:
                    add(kind)
                held[kind].append(sequence)
                tokens[kind] += len(sequence)
        for kind in held:
            if held[kind]:
                add(kind)
        seen = np.flatnonzero(sums[2].sum(axis=1) > 0)
        numbers = np.concatenate([[-1], -2 - np.arange(states), seen])
        counts = np.concatenate([sums[0][None, :], sums[1], sums[2][seen]])
        for at in range(0, len(numbers), 16_384):
            part = counts[at : at + 16_384]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at : at + 16_384], pa.int32()), *[pa.array(part[:, k]) for k in range(states)]], names=["symbol", *[f"s{k}" for k in range(states)]])

    schema = "symbol int, " + ", ".join(f"s{k} double" for k in range(states))
    return common.map_arrow(texts, run, schema).groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])


def frequent_words(counts: DataFrame, n_symbols: int) -> Column:
    """Which rows of counts (word, c) are symbols of their own: about n_symbols of the most frequent. Counts go by level; of the words of the level that does not fit whole, a share by their hash does."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    left = n_symbols
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.col("level").desc()).collect():
        if row["n"] > left:
            return (level > row["level"]) | ((level == row["level"]) & (common.hash_fraction(1, F.col("word")) < left / row["n"]))
        left -= row["n"]
    return F.lit(True)


def score_texts(docs: DataFrame, may_learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, n_symbols: int = SYMBOLS, rounds: int = ROUNDS, seed: int = 13) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"), may_learn.alias("learnt"))
    learnt = rows.filter("learnt")
    counts = common.materialize(word_counts(learnt.select("text")), "counts")
    n_texts = learnt.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The end is a token of each text.
    n_all, v_all = n_words + n_texts, distinct + (n_texts > 0)
    is_symbol = frequent_words(counts, n_symbols)
    frequent = sorted(((bytes(r[0]), r[1]) for r in counts.filter(is_symbol).collect()), key=lambda r: (-r[1], r[0]))
    rare_counts = counts.filter(~is_symbol)
    by_class = np.zeros((CLASSES, 2))
    for r in rare_counts.groupBy(class_of(F.col("word")).alias("k")).agg(F.sum("c"), F.count("*")).collect():
        by_class[r[0]] = r[1], r[2]
    words, totals = [w for w, _ in frequent], [c for _, c in frequent]
    symbols = spark.sparkContext.broadcast((words, totals))
    size = len(words) + CLASSES + 1
    shares = np.concatenate([totals, by_class[:, 0], [n_texts]]) + 0.5
    shares /= shares.sum()
    model = Model.first(states, shares, seed)
    read = common.materialize(read_texts(rows, symbols, common.mark(), n_texts, 1 / (n_all + v_all + 1)), "read")
    if n_texts:
        stored = read.filter("learnt").select("symbols")
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(model)
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            found = expected_counts(stored, sent, size, states).toArrow().to_pandas()
            numbers, values = found["symbol"].to_numpy(), found.iloc[:, 1:].to_numpy()
            start[:] = values[numbers == -1].sum(axis=0)
            for k in range(states):
                move[k] = values[numbers == -2 - k].sum(axis=0)
            emit[numbers[numbers >= 0]] = values[numbers >= 0]
            model = Model.from_counts(start, move, emit, shares)
            sent.unpersist()
    # What a class's symbol costs besides its emission: the tokens of the class.
    within = np.zeros(size)
    within[len(words) : len(words) + CLASSES] = -np.log10(by_class[:, 0] + by_class[:, 1] + 1)
    final = spark.sparkContext.broadcast((model, within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, costs = final.value
        for batch in common.pieces(batches, TEXTS):
            sequences = [np.frombuffer(x, "<i4") for x in batch.column(3).to_pylist()]
            lengths = np.array([len(s) for s in sequences])
            scores = np.zeros(len(sequences))
            order = longest_first(sequences)
            scores[order] = forward(trained, [sequences[i] for i in order])
            scores += np.add.reduceat(costs[np.concatenate(sequences)], np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths, pa.int64()), *batch.columns[4:], pa.array(scores)], names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    by_text = common.map_arrow(read.select("row", "id", "held_out", "symbols", "n_known", "base"), run, "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    met = read.select("row", F.explode("rare").alias("word")).join(rare_counts, "word")
    added = met.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    scored = by_text.join(added, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(n_all).cast("long").alias("train_tokens"), plus("base", "more").alias("base_score"), plus("score", "more"))


def row_numbers(n: int) -> np.ndarray:
    """Numbers for a task's next rows, unlike any other's; what is computed again gets the same ones."""
    from pyspark import TaskContext

    context = TaskContext.get()
    key = (context.partitionId(), context.taskAttemptId())
    if _rows.get("key") != key:
        _rows.clear()
        _rows.update(key=key, next=key[0] << 40)
    _rows["next"] += n
    return np.arange(_rows["next"] - n, _rows["next"])


_rows: dict = {}
