"""What an editor's hooks hand over on standard input, and what they get back."""

from __future__ import annotations

import io
import itertools
import sys
from typing import IO, TYPE_CHECKING

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import extract

if TYPE_CHECKING:
    from graphloom.engine import Engine

#: Bytes that are read, and bytes of a transcript that are kept.
READ_BYTES, TRANSCRIPT_BYTES = 1 << 20, 50_000
TEXTS = "kb_id string, content string, source string, metadata map<string,string>"


def read_input(stream: IO | None = None, most: int = READ_BYTES) -> str:
    """What is piped in, at most so many bytes, without white space at the ends; nothing from a terminal."""
    stream = stream or sys.stdin
    if stream.isatty():
        return ""
    raw = getattr(stream, "buffer", stream)
    data = raw.read(most)
    if isinstance(raw, io.TextIOBase):
        data = data.encode()[:most]
    return data.decode(errors="ignore").strip()


class Hooks:
    """The three hooks of a knowledge base. Every nth tool output is looked at."""

    def __init__(self, engine: Engine, kb: str, every: int = 1):
        self.engine, self.kb, self.every = engine, kb, max(1, every)
        self._calls = itertools.count(1)

    def _submit(self, text: str, source: str) -> bool:
        self.engine.submit(self.engine.spark.createDataFrame([(self.kb, text, source, {})], TEXTS))
        return True

    def post_tool_use(self, stream: IO | None = None) -> bool:
        """Queues a tool's output if a rule would look at it; whether it did."""
        if next(self._calls) % self.every:
            return False
        text = read_input(stream)
        if not text:
            return False
        matched = self.engine.spark.range(1).select(extract.matches(F.lit(text)).alias("m")).first()["m"]
        return bool(matched) and self._submit(text, "hook:post_tool_use")

    def pre_compact(self, stream: IO | None = None) -> bool:
        """Queues the head of a transcript."""
        text = read_input(stream)
        if not text:
            return False
        head = self.engine.spark.range(1).select(tx.cut_bytes(F.lit(text), TRANSCRIPT_BYTES).alias("t")).first()["t"]
        return self._submit(head, "hook:pre_compact")

    def user_prompt(self, stream: IO | None = None) -> str | None:
        """Memories for a prompt, as JSON."""
        text = read_input(stream)
        return self.engine.prompt_context(self.kb, text) if text else None
