"""Language identification by prediction by partial matching (PPM).

For every language a context tree over bytes holds how often each byte followed each context of 0 to ``order`` bytes in
the language's training texts. A byte is coded in the longest context that was seen; if it did not follow there, an escape
is coded (as often as there are distinct bytes in that context: method C) and the next shorter context is tried, down to
all bytes alike. The statistics are frozen, so a byte's exact code length depends on the bytes before it alone. The
language that codes a text in the fewest bits is its own.

For speed the trees of all languages are one table: contexts that any language has seen are numbered, and the table
holds for each number and next byte the code lengths in all languages. Contexts of a text are found by following the
numbers of the shorter ones, vectorised over a batch.

Training takes a bounded sample of labelled rows: of each language, about ``sample_rows`` rows that come first in a seeded
order; whole texts. Rows of null text or language are not learnt from. Null texts and those without a letter are
``und`` with score 0. With no training rows at all, every text is ``und``. Ties go to the first language by name. Repeated
rows are each scored; an empty table gives no rows; very long texts are scored in chunks, and short of that like others.
Of extra columns those asked for are kept, and those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

UNDETERMINED = "und"
ORDER = 3
#: Rows of each language that are learnt from, about; a bound on what training gathers.
SAMPLE_ROWS = 400
#: Bytes that are scored at once.
CHUNK = 1 << 20
_kept: dict = {}


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """labelled (lang, text) to (lang, n, gram, count): the grams of 1 to order + 1 bytes of each language, as big-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 2048):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), common.column_bytes(batch.column(1)), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, values in texts.items():
                for n in range(1, order + 2):
                    grams = [gram_numbers(np.frombuffer(t, np.uint8), n) for t in values if len(t) >= n]
                    if grams:
                        found, counts = np.unique(np.concatenate(grams), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "n", "gram", "count"])

    rows = common.map_arrow(labelled.select("lang", "text"), run, "lang string, n int, gram long, count long")
    return rows.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def gram_numbers(data: np.ndarray, n: int) -> np.ndarray:
    number = np.zeros(len(data) - n + 1, np.int64)
    for k in range(n):
        number = number << 8 | data[k : len(data) - n + 1 + k]
    return number


class ContextTrees:
    """Frozen trees of all languages. counts: for a language and k, the grams of k + 1 bytes and their counts."""

    def __init__(self, langs: list[str], counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER):
        self.langs, self.order = langs, order
        grams = [np.unique(np.concatenate([counts[x][k][0] for x in langs])) for k in range(order + 1)]
        # Bytes that no tree holds share one symbol.
        self.symbol = np.full(256, len(grams[0]), np.intp)
        self.symbol[grams[0]] = np.arange(len(grams[0]))
        width = len(grams[0]) + 1
        # A context is numbered from 1 within its length; 0 is an unseen one. The suffix and the prefix of a seen context are seen too.
        contexts = [np.unique(g >> 8) for g in grams]
        #: step[k]: number of a context of k bytes and the next symbol to the number of the context of k + 1.
        self.step: list[np.ndarray] = []
        #: first[k] + number: a context's row in cost, which has the bits of each symbol in each language.
        self.first: list[int] = []
        tables, rows = [], 0
        shorter = np.full((1, width, len(langs)), 8, np.float32)
        for k, known in enumerate(contexts):
            table = np.empty((len(known) + 1, width, len(langs)), np.float32)
            table[0] = 0
            table[1:] = shorter[0 if k == 0 else np.searchsorted(contexts[k - 1], known & ((1 << 8 * (k - 1)) - 1) if k > 1 else np.zeros(len(known), np.int64)) + 1]
            for j, lang in enumerate(langs):
                gram, count = counts[lang][k]
                at = np.searchsorted(known, gram >> 8) + 1
                total, distinct = np.bincount(at, count, len(table)), np.bincount(at, minlength=len(table))
                has = total > 0
                table[has, :, j] -= np.log2(distinct[has] / (total[has] + distinct[has]))[:, None].astype(np.float32)
                table[at, self.symbol[gram & 255], j] = -np.log2(count / (total[at] + distinct[at]))
            if k < order:
                step = np.zeros((len(known) + 1, width), np.int32)
                longer = contexts[k + 1]
                step[np.searchsorted(known, longer >> 8) + 1, self.symbol[longer & 255]] = np.arange(1, len(longer) + 1)
                self.step.append(step)
            self.first.append(rows)
            rows += len(table)
            tables.append(table)
            shorter = table
        self.cost = np.concatenate(tables).reshape(-1, len(langs))
        self.width = width

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte of data in each language; the first bytes have shorter contexts."""
        symbol = self.symbol[data]
        row = np.full(len(data), self.first[0] + 1, np.intp)
        number = np.ones(len(data), np.int32)
        for k in range(1, self.order + 1):
            if len(data) <= k:
                break
            # number: of the k bytes before each byte
            number = self.step[k - 1][number[:-1], symbol[k - 1 : -1]]
            np.copyto(row[k:], number + self.first[k], where=number > 0)
        return self.cost[row * self.width + symbol]

    def bits(self, text: bytes) -> np.ndarray:
        """Exact code length of a whole text in each language."""
        data = np.frombuffer(text, np.uint8)
        total = np.zeros(len(self.langs))
        for at in range(0, len(data), CHUNK):
            back = min(at, self.order)
            total += self.code_lengths(data[at - back : at + CHUNK])[back:].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """The language, its posterior, and the bits that a byte of the text takes in it."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, None
        data = text.encode()
        bits = self.bits(data)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(data))


def train(docs: DataFrame, may_learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> tuple:
    """Counts of each language's grams, as ContextTrees takes them. The sample's bound also bounds what comes to the driver."""
    usable = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per_lang = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return [], {}, order
    limit = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_rows / per_lang[lang]))]), F.col(lang_col))
    sample = usable.filter(common.hash_fraction(seed, F.col(id_col)) < limit).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = gram_counts(sample, order).toArrow().to_pandas()
    counts = {}
    for lang in langs:
        own = found[found["lang"] == lang]
        counts[lang] = []
        for n in range(1, order + 2):
            part = own[own["n"] == n].sort_values("gram")
            counts[lang].append((part["gram"].to_numpy(np.int64), part["count"].to_numpy(np.int64)))
    return langs, counts, order


def identify(docs: DataFrame, model: tuple, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), pred_col: str = "lang_pred", score_col: str = "score", bits_col: str | None = None) -> DataFrame:
    """The columns in keep, and lang_pred and score of every whole text, which replace columns of these names; with bits_col, also the bits of a byte. A narrow map."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    mark = common.mark()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = common.worker_cache(_kept, mark, lambda: ContextTrees(*sent.value) if sent.value[0] else None)
        for batch in common.pieces(batches):
            found = [trees.predict(t) if trees else (UNDETERMINED, 0.0, None) for t in batch.column(0).to_pylist()]
            made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made[: len(names)]], names=[*batch.schema.names[1:], *names])

    names = [pred_col, score_col] + ([bits_col] if bits_col else [])
    rows = docs.select(F.col(text_col).alias("__text_to_score"), *[c for c in keep if c not in names])
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:])
    return common.map_arrow(rows, run, f"{schema}, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double"), strict=False)))
