"""Token counts by the whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens, then merges each of them. A pre-token that is a
vocabulary string need not be merged if that string, encoded alone, is known to come out as one token. That is proved
once, on the driver, for the whole vocabulary (``prove``); tasks then count such pre-tokens directly and merge only the
rest, remembering the counts of those that come back.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are each counted; an empty table gives no rows. A very long text is
cut and counted whole, like others. Columns other than ``id_col`` and
``text_col`` play no part. A tokenizer that this rule does not hold for is used as it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

#: Counts of merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Fixed value: the published pattern by which this kind of tokenizer cuts texts into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def applies(path: str) -> bool:
    """Whether the file holds a byte-level BPE without rules that reach over pre-tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return bool(plain and spec.get("normalizer") is None and model["type"] == "BPE" and not model.get("dropout") and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"))


def prove(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and that the library, given them alone, encodes as one token."""
    import regex

    tokenizer = common.load_tokenizer(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    cut = regex.compile(PRE_TOKENS).fullmatch
    decoder = tokenizer.decoder
    strings = sorted({decoder.decode([raw]) for raw in tokenizer.get_vocab()} - special)
    strings = [s for s in strings if s and "�" not in s and cut(s)]
    whole = []
    for at in range(0, len(strings), 4096):
        part = strings[at : at + 4096]
        whole += [s for s, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True) if len(e) == 1]
    return whole


class Counter:
    """Counts the tokens of texts; ``whole`` as ``prove`` gives it."""

    def __init__(self, path: str, whole: list[str] | None):
        import regex

        self.tokenizer = common.load_tokenizer(path)
        self.whole = None if whole is None else frozenset(whole)
        self.cut = regex.compile(PRE_TOKENS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else lambda s: [s]
        self.merged: dict[str, int] = {}
        self.same: dict[str, bool] = {}

    def same_classes(self, text: str) -> bool:
        """Whether our pattern and the library's sort each character into the same class; their Unicode versions can differ."""
        if text.isascii():
            return True
        for c in set(text):
            if c > "\xff" and not (known := self.same.get(c)):
                if known is None:
                    probe = f"a{c}1{c}!"
                    known = self.same[c] = [m.span() for m in self.cut.finditer(probe)] == [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
                if not known:
                    return False
        return True

    def by_library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        if self.whole is None or not self.same_classes(text):
            return self.by_library(text)
        parts = self.split(text)
        total, whole, merged = len(parts) - 1, self.whole, self.merged
        for part in parts:
            found = self.cut.findall(part)
            total += len(found)
            for p in found:
                if p not in whole:
                    n = merged.get(p)
                    if n is None:
                        if len(merged) >= REMEMBERED:
                            merged.clear()
                        n = self.by_library(p)
                        if len(p) <= 64:
                            merged[p] = n
                    total += n - 1
        return total


_kept: dict = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. A narrow map: no shuffle; the proved strings are as many as the vocabulary at most."""
    sent = docs.sparkSession.sparkContext.broadcast(prove(tokenizer) if applies(tokenizer) else None)
    mark = common.mark()
    out = {"id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.worker_cache(_kept, mark, lambda: Counter(tokenizer, sent.value))
        for batch in common.pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            yield common.record_batch(out, id=batch.column(0), n_bytes=n_bytes, n_tokens=[counter.count(t) for t in texts])

    counted = common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
