"""Embedders and extractors that can be plugged in. The default embedder needs no network and always says the same."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """What is asked where no rule finds an entity. same() answers whether two entities are one; an extractor without it is not asked that."""

    def extract(self, text: str) -> dict: ...


class HashEmbedder:
    """Unit vectors of hashed words and letter triples."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                marked = f"^{word}$"
                for feature in chain([word], (marked[i : i + 3] for i in range(len(marked) - 2))):
                    h = zlib.crc32(feature.encode())
                    v[h % self.dim] += 1 if h & 0x80000000 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def parse_extraction(answer: str) -> dict:
    """A model's JSON as entities and relations with all their fields; what has no name, or lacks an end or a type, drops out."""
    answer = answer.strip()
    if answer.startswith("```"):
        answer = answer.strip("`").removeprefix("json").strip()
    found = json.loads(answer)
    text = lambda x, k: str(x.get(k) or "").strip()
    entities = [{k: text(e, k) for k in ("name", "type", "summary")} for e in found.get("entities") or [] if text(e, "name")]
    relations = [{k: text(r, k) for k in ("source", "target", "type", "summary")} | {"weight": float(r.get("weight") or 0.0)} for r in found.get("relations") or [] if all(text(r, k) for k in ("source", "target", "type"))]
    return {"entities": entities, "relations": relations}


def extract_by_model(texts: DataFrame, extractor: Extractor) -> DataFrame:
    """texts (kb_id, text_id, content) to (kb_id, text_id, x, error): a text that fails has an error and nothing found; the others are not held up by it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, errors = [], []
            for content in batch["content"].fillna(""):
                try:
                    x = extractor.extract(content)
                    found.append({"entities": list(x.get("entities") or []), "relations": list(x.get("relations") or [])})
                    errors.append(None)
                except Exception as e:
                    found.append({"entities": [], "relations": []})
                    errors.append(f"extract: {e}")
            yield pd.DataFrame({"kb_id": batch["kb_id"], "text_id": batch["text_id"], "x": found, "error": errors})

    from graphloom.operators.extract import ENTITY, RELATION

    return texts.mapInPandas(run, f"kb_id string, text_id string, x struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>, error string")


def validate(vectors: list[list[float]], count: int, dim: int | None = None) -> None:
    """As many vectors as texts, none empty, all of the configured dimension or that of the first."""
    if len(vectors) != count:
        raise ValueError(f"{len(vectors)} embeddings for {count} texts")
    for i, v in enumerate(vectors):
        dim = dim or len(v)
        if not len(v) or len(v) != dim:
            raise ValueError(f"embedding {i} has {len(v)} components, not {dim}")


def embed(table: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding") -> DataFrame:
    """The table with an embedding of a text column, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder.embed(batch[text_col].fillna("").tolist())
            validate(vectors, len(batch), embedder.dim or None)
            yield batch.assign(**{out_col: [np.asarray(v, np.float32) for v in vectors]})

    rows = table.drop(out_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, `{out_col}` array<float>")
