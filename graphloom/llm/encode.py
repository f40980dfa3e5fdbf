"""Whole texts to token ids with the tokenizers library, for tokenizers that drop white space.

Where a tokenizer treats every white-space-free run of a text by itself, a run's ids do not depend on what stands around
it, so a worker asks the library once for each run and remembers the answer. Of many texts together, the distinct runs are
found by one sort, each is looked up once, and ids are gathered by their places. Where that does not hold, the library gets
the whole text.

Runs that are plain letters, which most new ones are, are not put to the library one by one: their merges are made for
thousands of them side by side (``Merges``), by the vocabulary's own merge ranks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import pairwise

import numpy as np

from graphloom.llm import common

#: Runs that a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Texts that are encoded together: the more new runs at once, the fewer steps their merges take.
ENCODED_ROWS = 1024
#: Runs whose distinct ones are sought by one sort: memory does not grow with a text beyond its places.
RUNS_TOGETHER = 1 << 20
#: Space behind the last run, so that eight bytes can be read from any place of 16.
PADDING = b" " * 24
#: Masks that keep the first 0 to 8 bytes; odd factors of a hash.
BYTES_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def runs_apart(path: str) -> bool:
    """Whether white space always parts tokens and leaves none: then runs can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [(n["type"], n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
    splits = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and r"[^\s" in cuts[0]["pattern"].get("Regex", "")
    return bool(plain and steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and splits and not spec["model"].get("dropout"))


#: Bytes of a run that is merged side by side with others, and how many are.
LONGEST, TOGETHER = 48, 4096
#: A run by line: ASCII letters in lower case, and letters of one further Latin block, which are two bytes and of which none
#: is a mark; behind them ASCII marks other than the apostrophe, which are a token run of their own. Or anything else.
_lines = re.compile(rb"(?m)^(?:((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)|(.+))$").findall


def byte_characters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """Byte-pair merges of many words at once. A row holds a word's symbols; each round merges the first pair of the least rank of every row."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + end] for c in characters], np.int64)
        self.size = len(vocab) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        # A pair that is listed twice has its last rank.
        order = np.lexsort((-np.arange(len(keys)), keys))
        order = order[np.concatenate([[True], np.diff(keys[order]) != 0])]
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; symbols below 0 are no symbols."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        """The ids of words of one byte and more, which are one pre-token each."""
        lengths = np.array([len(w) for w in words])
        columns = np.arange(lengths.max())
        held = columns < lengths[:, None]
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = np.full(held.shape, -1, np.int64)
        symbols[held] = self.inner[data]
        rows = np.arange(len(words))
        symbols[rows, lengths - 1] = self.last[data[np.cumsum(lengths) - 1]]
        ranks = np.full(held.shape, self.none, np.int64)
        ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        done = symbols.copy()
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            more = least < self.none
            if not more.all():
                done[rows[~more]] = symbols[~more]
                rows, symbols, ranks, at, least = rows[more], symbols[more], ranks[more], at[more], least[more]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            symbols[here, at] = self.made[least]
            # What follows the pair moves up.
            source = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            tail = np.full(len(rows), -1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            symbols[:, -1] = tail
            ranks = np.take_along_axis(ranks, source, axis=1)
            ranks[:, -1] = self.none
            following = np.minimum(at + 1, len(columns) - 1)
            ranks[here, at] = np.where(following > at, self.rank(symbols[here, at], symbols[here, following]), self.none)
            before = np.maximum(at - 1, 0)
            ranks[here, before] = np.where(at > 0, self.rank(symbols[here, before], symbols[here, at]), ranks[here, before])
        kept = done >= 0
        flat = done[kept].astype(dtype).tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder(dict):
    """encode(): the ids of each text, as little-endian bytes of ``dtype``: two bytes an id if the vocabulary allows."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = common.load_tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.apart = runs_apart(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        self.merges = Merges(model) if self.apart and plain else None

    def ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, runs: Iterable[bytes]) -> None:
        """Remembers the ids of runs."""
        # Runs hold no line ends, so one search parts them all.
        words, split, usable = [], [], self.merges is not None
        for w, m, other in _lines(b"\n".join(runs)):
            if other or not usable or len(w) + len(m) > LONGEST:
                run = other or w + m
                self[run] = self.ask(run.decode())
            elif m:
                split.append((w, m))
            else:
                words.append(w)
        words += {w for w, _ in split if w not in self}.difference(words)
        # Capitals of the Latin block become small letters, as the tokenizer has them.
        small = [w if w.isascii() else w.decode().lower().encode() for w in words]
        order = np.argsort(np.fromiter(map(len, small), np.int64, len(small)), kind="stable").tolist()
        for at in range(0, len(order), TOGETHER):
            part = order[at : at + TOGETHER]
            self.update(zip([words[i] for i in part], self.merges.encode([small[i] for i in part], self.dtype), strict=True))
        for mark in {m for _, m in split if m not in self}:
            self[mark] = self.ask(mark.decode())
        for w, m in split:
            self[w + m] = self[w] + self[m]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        if not self.apart:
            return [self.ask(t.decode()) for t in texts]
        # Lower case comes first, but for texts that may hold a special string in capitals, which lower case would make special.
        lowered = [t if b"<|" in t else t.lower() for t in texts]
        blob = b" ".join(lowered) + PADDING
        starts, ends = run_bounds(blob)
        found = [self.encode_runs(blob, starts[at : at + RUNS_TOGETHER], ends[at : at + RUNS_TOGETHER]) for at in range(0, len(starts), RUNS_TOGETHER)]
        flat = b"".join(ids.tobytes() for ids, _ in found)
        # Ids before each run, and runs before each text, give where a text's ids end.
        before = np.concatenate([[0], *(counts for _, counts in found)]).cumsum() * self.dtype.itemsize
        texts_end = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
        cuts = [0, *before[np.searchsorted(starts, texts_end)].tolist()]
        return [flat[a:b] for a, b in pairwise(cuts)]

    def encode_runs(self, blob: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these runs of blob, and how many each run has. Every distinct run is looked up once."""
        first, kind = distinct_runs(blob, starts, ends)
        runs = [blob[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [r for r in runs if r not in self]
        if new:
            if len(self) + len(new) > REMEMBERED:
                self.clear()
                new = runs
            self.learn(new)
        known = [self[r] for r in runs]
        flat = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        counts = sizes[kind]
        shift = (np.cumsum(sizes) - sizes)[kind] - (np.cumsum(counts) - counts)
        return flat[np.repeat(shift, counts) + np.arange(counts.sum())], counts

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def run_bounds(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bytes other than space and 0x09-0x0D start and end; blob ends with space."""
    data = np.frombuffer(blob, np.uint8)
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13))])
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    return bounds[::2], bounds[1::2]


def distinct_runs(blob: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct run the index of one of its places, and for each place the number of its distinct run.

    Runs of 16 bytes and less are two integers and a length. They are sorted by a hash of these, and neighbours of one hash
    are compared in full; where two differ, and for longer runs, a dictionary decides.
    """
    lengths = ends - starts
    short = np.flatnonzero(lengths <= 16)
    at, size = starts[short], lengths[short]
    eights = np.ndarray((len(blob) - 7,), "<u8", blob, strides=(1,))
    low = eights[at] & BYTES_KEPT[np.minimum(size, 8)]
    high = eights[at + 8] & BYTES_KEPT[np.maximum(size - 8, 0)]
    mixed = (low * MIX[0]) ^ (high * MIX[1]) ^ (size.astype(np.uint64) * MIX[2])
    order = np.argsort(mixed ^ (mixed >> np.uint64(29)))
    low, high, size, mixed = low[order], high[order], size[order], mixed[order]
    same = mixed[1:] == mixed[:-1]
    if not ((low[1:] == low[:-1]) & (high[1:] == high[:-1]) & (size[1:] == size[:-1]))[same].all():
        short = order = short[:0]
        same = np.zeros(0, bool)
    leads = np.concatenate([np.ones(min(1, len(order)), bool), ~same])
    first = short[order[leads]]
    kind = np.empty(len(starts), np.int64)
    kind[short[order]] = np.cumsum(leads) - 1
    longer = np.flatnonzero(lengths > 16) if len(short) else np.arange(len(starts))
    if len(longer):
        numbers: dict[bytes, int] = {}
        places = zip(starts[longer].tolist(), ends[longer].tolist(), strict=True)
        which = np.array([numbers.setdefault(blob[a:b], len(numbers)) for a, b in places])
        kind[longer] = which + len(first)
        first = np.concatenate([first, longer[np.unique(which, return_index=True)[1]]])
    return first, kind
