"""Operator 5: token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Pre-tokens of a batch lie in one ragged numpy array.  In each round every sequence finds its lowest-rank
pair and merges all its occurrences at once, all sequences in one go; what survives is the token count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leafmill.llm.common import PairTable, slices, texts_of

# --- fixed value: the pre-token pattern of byte-level BPE ---
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = np.iinfo(np.int64).max
KEEP = 400_000  # pre-tokens remembered in a worker


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for themselves, the rest follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """Merge table of a tokenizer file, and the pre-token counts found so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        self.pairs = PairTable(keys)  # a pair's row is its rank
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.first = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.first[byte] = vocabulary[symbol]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        # special strings inside a text are one token each, as the library takes them by default
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.find(left * self.size + right)
        rank[rank < 0] = NEVER
        return rank

    def merge(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NEVER)
            rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            low_here = np.repeat(low, sizes)
            counts[owner[starts]] = sizes
            hit = (rank == low_here) & (low_here != NEVER)
            if not hit.any():
                break
            # of a run of overlapping equal pairs every second one merges, from the left
            fresh = hit & ~np.concatenate(([False], hit[:-1]))
            at = np.flatnonzero(hit)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), -1))[at]
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(low != NEVER, sizes)  # finished sequences leave the arrays
            keep[at + 1] = False
            counts[owner[starts]] -= np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def pieces(self, text: str) -> list[list[str]]:
        parts = self.special.split(text) if self.special else [text]
        return [self.words.findall(p) for p in parts]

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text: its pre-tokens' counts, and one for each special string."""
        split = [self.pieces(t) for t in texts]
        new = {w for parts in split for words in parts for w in words}
        if len(self.known) > KEEP:
            self.known.clear()
        fresh = [w for w in new if w not in self.known]
        counts = self.known if len(fresh) + len(self.known) <= 2 * KEEP else {w: self.known[w] for w in new - set(fresh)}
        if fresh:
            counts.update(zip(fresh, self.merge(fresh).tolist(), strict=True))
        get = counts.__getitem__
        return [sum(sum(map(get, words)) for words in parts) + len(parts) - 1 for parts in split]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text; null counts as the empty text, which has no tokens.

    ``tokenizer`` is the path of a byte-level BPE file on every machine.  Rows stay where they are: no
    shuffle.  Repeated rows and ids are counted each; other columns are not read.
    """
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(tokenizer)
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(model.count(texts), pa.int64()),
                ],
                names=[id_column, "n_bytes", "n_tokens"],
            )

    return df.select(id_column, df[text].alias("text")).mapInArrow(count, schema)
