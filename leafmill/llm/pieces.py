"""Operator 2: SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is a dummy space and its code points.  Each segment (a run of spaces and the word after it) has an
agenda of candidate merges; the best one is taken, highest score first and leftmost among equals, and the
candidates next to it are renewed.  A candidate is skipped for good when a hash keyed by the seed, the text
and its place falls below the dropout rate, so one seed always gives one segmentation and other seeds give
others.  Short segments of a batch run their agendas side by side in numpy; a long one has a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from leafmill.llm.common import U64, PairTable, mix, slices

SPACE = "▁"  # stands for a blank inside pieces
NEVER = np.iinfo(np.int64).max
LONG = 512  # symbols of a segment from which the heap is quicker
STEPS = (3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48, 128, LONG)  # segments are padded to the next of these lengths
CELLS = 200_000  # symbols side by side


class Pieces:
    """Vocabulary and merge table of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [
            i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        ids = {names[i]: i for i in plain}
        self.size = size
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # equal scores share a rank: among them the leftmost merges first
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        keys, ranks, made = [], [], []
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = ids.get(name[:cut]), ids.get(name[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    ranks.append(rank_of[model.get_score(i)])
                    made.append(i)
        self.pairs = PairTable(np.array(keys, np.int64))
        # one more entry at the end, so that row -1 is "no such pair"
        self.ranks, self.made = np.array([*ranks, NEVER >> 32], np.int64), np.array([*made, -1], np.int64)
        self.chars = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.chars[ord(name)] = i
        self.space = int(self.chars[ord(SPACE)])
        self.chars[ord(" ")] = self.space
        self.chars[ord(SPACE)] = -1  # the sign itself is spelled in bytes, so decoding is lossless
        # where no piece goes on from a word into a space, segments can be merged one by one
        self.breaks = not any(b == SPACE and a != SPACE for name in ids for a, b in zip(name, name[1:], strict=False))
        shown = [b""] * size
        for i in plain:
            shown[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            shown[i] = bytes([b])
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    # -- encoding --

    def _pairs(self, left, right, key, a, b, c, rate: int):
        """Rank of candidates; (a, b, c) are start, middle and end of the two symbols in their text."""
        row = self.pairs.find(left * self.size + right)
        row[(left < 0) | (right < 0)] = -1
        rank = self.ranks[row]
        if rate:
            place = (a.astype(U64) << U64(42)) ^ (b.astype(U64) << U64(21)) ^ c.astype(U64)
            rank = np.where(mix(key ^ mix(place)) < U64(rate), NEVER >> 32, rank)
        return rank

    def encode(self, texts: list[str], seed: int = 0, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        rate = min(int(dropout * 2**64), 2**64 - 1)
        codes = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.empty(0, np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        code = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        if not len(code):
            return np.empty(0, np.int64), sizes
        keys = mix(np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), seed & (2**64 - 1)) for t in texts], U64))
        symbol = self.chars[code].astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        ends = np.cumsum(sizes)
        place = np.arange(len(code)) - (ends - sizes)[doc]
        begins = place == 0
        if self.breaks:
            blank = symbol == self.space
            begins |= blank & ~np.concatenate(([False], blank[:-1]))
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.concatenate((starts, [len(code)])))
        final = symbol.copy()
        alive = np.ones(len(code), bool)
        long = lengths > LONG
        if long.any():
            for s, n in zip(starts[long], lengths[long], strict=True):
                self._heap(final, alive, int(s), int(n), keys[doc[s]], int(place[s]), rate)
        low = 1
        for high in STEPS:
            some = np.flatnonzero((lengths > low) & (lengths <= high) & ~long)
            low = high
            for part in np.array_split(some, max(1, len(some) * high // CELLS)) if len(some) else []:
                self._rounds(final, alive, starts[part], lengths[part], place[starts[part]], keys[doc[starts[part]]], rate)
        # characters without a piece are spelled in bytes
        final, kept, owner = final[alive], code[alive], doc[alive]
        lost = np.flatnonzero(final < 0)
        if len(lost):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in kept[lost]]
            times = np.ones(len(final), np.int64)
            times[lost] = [len(x) for x in spelled]
            at = np.repeat(final < 0, times)
            final, owner = np.repeat(final, times), np.repeat(owner, times)
            final[at] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return final, np.bincount(owner, minlength=len(texts))

    def _rounds(self, final, alive, starts, lengths, place, keys, rate: int) -> None:
        """The agendas of many segments of similar length side by side: one merge of each in every round.

        Column j is a segment, row i its i-th symbol; ``next`` and ``before`` link the symbols that are left,
        ``agenda`` holds rank and row of the candidate that begins at a symbol.
        """
        high, count = int(lengths.max()), len(starts)
        rows = np.arange(high)[:, None]
        inside = rows < lengths
        at = np.where(inside, starts + rows, 0)
        symbol = np.where(inside, final[at], -1)
        after = np.broadcast_to(rows + 1, (high, count)).astype(np.int32)
        before = np.broadcast_to(rows - 1, (high, count)).astype(np.int32)
        kept = inside.copy()
        agenda = np.full((high, count), NEVER)
        i, j = np.nonzero(inside[1:])
        rank = self._pairs(symbol[i, j], symbol[i + 1, j], keys[j], place[j] + i, place[j] + i + 1, place[j] + i + 2, rate)
        agenda[i, j] = (rank << 32) | i
        columns = np.arange(count)
        while True:
            best = agenda.min(axis=0)
            live = best >> 32 < NEVER >> 32
            left = int(live.sum())
            if left < 0.6 * len(columns):
                self._store(final, alive, starts[~live], symbol[:, ~live], kept[:, ~live], inside[:, ~live])
                if not left:
                    return
                starts, lengths, place, keys = starts[live], lengths[live], place[live], keys[live]
                symbol, after, before, kept, inside, agenda = (x[:, live] for x in (symbol, after, before, kept, inside, agenda))
                best, live = best[live], np.ones(left, bool)
                columns = np.arange(left)
            j = columns[live]
            i = best[j] & 0xFFFFFFFF
            k = after[i, j]
            symbol[i, j] = self.made[self.pairs.find(symbol[i, j] * self.size + symbol[k, j])]
            kept[k, j] = False
            agenda[k, j] = NEVER
            agenda[i, j] = NEVER
            end = after[k, j]
            after[i, j] = end
            inner = np.flatnonzero(end < lengths[j])
            before[end[inner], j[inner]] = i[inner]
            front = np.flatnonzero(before[i, j] >= 0)
            left_at = np.concatenate((i[inner], before[i[front], j[front]]))
            col = np.concatenate((j[inner], j[front]))
            right_at = after[left_at, col]
            begin = place[col]
            rank = self._pairs(symbol[left_at, col], symbol[right_at, col], keys[col], begin + left_at, begin + right_at, begin + after[right_at, col], rate)
            agenda[left_at, col] = (rank << 32) | left_at

    @staticmethod
    def _store(final, alive, starts, symbol, kept, inside) -> None:
        i, j = np.nonzero(inside)
        final[starts[j] + i] = symbol[i, j]
        alive[starts[j] + i] = kept[i, j]

    def _heap(self, final, alive, start: int, n: int, key, place: int, rate: int) -> None:
        """The same agenda for one long segment, in n log n."""
        symbol = final[start : start + n].tolist()
        stop = list(range(1, n + 1))  # end of the symbol that begins here; also the next symbol
        before = list(range(-1, n - 1))
        row_key = np.full(n, key)
        at = np.arange(n - 1)
        first = self._pairs(final[start : start + n - 1], final[start + 1 : start + n], row_key[:-1], at + place, at + 1 + place, at + 2 + place, rate)
        agenda = [(int(r), i, i + 1, i + 2) for i, r in enumerate(first) if r != NEVER >> 32]
        heapq.heapify(agenda)

        def push(i: int) -> None:
            j = stop[i]
            if j < n:
                one = [np.array([v], np.int64) for v in (symbol[i], symbol[j], i + place, j + place, stop[j] + place)]
                rank = int(self._pairs(one[0], one[1], row_key[:1], *one[2:], rate)[0])
                if rank != NEVER >> 32:
                    heapq.heappush(agenda, (rank, i, j, stop[j]))

        gone = bytearray(n)
        while agenda:
            _, i, j, k = heapq.heappop(agenda)
            if gone[i] or gone[j] or stop[i] != j or stop[j] != k:
                continue
            symbol[i] = int(self.made[self.pairs.find(np.array([symbol[i] * self.size + symbol[j]]))[0]])
            gone[j] = 1
            stop[i] = k
            if k < n:
                before[k] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        final[start : start + n] = symbol
        alive[start : start + n] = np.frombuffer(bytes(gone), np.uint8) == 0

    # -- decoding --

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts: pieces in a row, without the dummy space in front."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.starts[ids] - (ends - size), size)
        raw = self.shown[source].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [raw[a + 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(
    df: DataFrame,
    model: str,
    seed: int = 0,
    dropout: float = 0.1,
    text: str = "text",
    into: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """The rows with the piece ids of their whole text as a column ``into``; null counts as the empty text,
    which has no pieces.  Repeated rows have equal ids.

    ``dropout`` 0 gives the library's own segmentation of every text without U+2581; that sign, which
    the library turns into a blank, is spelled in bytes here.  No shuffle; memory is bounded by a slice of
    rows or one text.  ``into`` must be a new name; other columns pass through under any names.  With ``decoded``, the text
    decoded from the ids is a further column, made in the same pass.
    """
    from pyspark.sql import types as T

    for name in (into, decoded):
        if name in df.columns:
            raise ValueError(f"column {name} exists")
    back = [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType(), False), False), *back])
    at = df.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in slices(batches, text, 800_000):
            ids, counts = table.encode([t or "" for t in batch.column(at).to_pylist()], seed, dropout)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32())
            )
            texts = [pa.array(table.decode(ids, counts), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *texts], names=schema.names)

    return df.mapInArrow(encode, schema)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their piece ids as a column ``into``; null or empty ids give the empty text."""
    from pyspark.sql import types as T

    if into in df.columns:
        raise ValueError(f"column {into} exists")
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType(), False)])
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists = batch.column(at)
                counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pa.array(table.decode(flat, counts), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, into])

    return df.mapInArrow(decode, schema)
