"""Operator 6: n-gram Jaccard join over prefix trees.

1. Every document becomes the set of its 5-word shingles (64-bit hashes); equal sets are one class.
2. Shingles are counted over all classes in hash buckets of bounded size.  A shingle of one class links nothing,
   so only shared ones travel on.  Rarest first is the global order of all sets.
3. A set of n shingles needs ceil(t n) common ones with any partner, so its first n - ceil(t n) + 1 shingles in
   the global order (the prefix) hold one of them.  Sets that share too few shingles drop out here.
4. Sets are laid side by side by a label of their neighbourhood and cut into chunks; two chunks meet if
   they share a prefix shingle, every chunk meets itself.
5. In a meeting the sets of one chunk are a prefix tree.  A set of the other chunk walks down the tree: the overlap
   of a common path is counted once, and a subtree is left as soon as its remaining lengths cannot reach the
   threshold.  Pairs that are connected already are not compared again.
6. The links give components; every document takes the smallest id of its component.

No pair of documents is ever a row: chunks are, and each meeting reports a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import U64, hot_join, mix, saved, slices
from leafmill.llm.graph import components

# --- fixed values: what separates words, and what lower case means ---
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True
BYTE = mix(np.arange(256, dtype=U64))
SPAN = 1 << 16
POWER = np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15, U64))

BUCKET_SHINGLES = 2_500_000  # shingles that one task counts at once
FLUSH_SHINGLES = 1_000_000  # shingles that one task holds before it writes them out
SLICE_BYTES = 1_000_000  # text that numpy holds at once
CHUNK_SETS = 192
CHUNK_SHINGLES = 120_000


# -- sets --


def shingle_sets(raw: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence is one shingle if it has fewer words."""
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~IS_BLANK[joined]
    letters = np.flatnonzero(inside)
    out = [np.empty(0, U64)] * len(raw)
    if not len(letters):
        return out
    first = np.concatenate(([0], np.flatnonzero(np.diff(letters) > 1) + 1))
    starts = letters[first]
    sizes = np.diff(np.concatenate((first, [len(letters)])))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    terms = BYTE[LOWER[joined[letters]]] * POWER[place % SPAN]
    hashes = mix(np.add.reduceat(terms, first) + sizes.astype(U64))
    owner = np.searchsorted(ends, starts, "right")
    bounds = np.searchsorted(owner, np.arange(len(raw) + 1))
    factors = mix(np.arange(1, words + 1, dtype=U64)) | U64(1)
    grams = np.zeros(max(0, len(hashes) - words + 1), U64)
    for k in range(words):
        grams += hashes[k : k + len(grams)] * factors[k]
    grams = mix(grams)
    for d in range(len(raw)):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= words:
            out[d] = np.unique(grams[a : b - words + 1])
        elif b > a:
            own = mix(hashes[a:b] * factors[: b - a] + U64(b - a))
            out[d] = mix(np.array([np.add.reduce(own)], U64))
    return out


KEY = np.dtype("V16")
KEY_PARTS = np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<u4")])


def set_key(values: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set: a 96-bit hash and the size of the set; empty for the empty set."""
    if not len(values):
        return b""
    a, b = np.add.reduce(mix(values)), np.bitwise_xor.reduce(mix(values ^ U64(0x5851F42D4C957F2D)))
    return np.array([(a, b >> U64(32), len(values))], KEY_PARTS).tobytes()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, key) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(_texts(batch), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "key"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key binary")


# -- packed rows: many sets, or parts of them, in one row --

PACKED = "place int, keys binary, counts binary, tokens binary, ranks binary"
PACKED_SCHEMA = pa.schema([("place", pa.int32()), *[(n, pa.binary()) for n in ("keys", "counts", "tokens", "ranks")]])


def _pack(place: int, keys, counts, tokens, ranks=b"") -> dict:
    return {
        "place": int(place),
        "keys": keys.tobytes(),
        "counts": counts.astype(np.int32).tobytes(),
        "tokens": tokens.tobytes(),
        "ranks": ranks if isinstance(ranks, bytes) else ranks.astype(np.int32).tobytes(),
    }


def _unpack(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    def column(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

    return (
        column("keys", KEY),
        column("counts", np.int32).astype(np.int64),
        column("tokens", U64),
        column("ranks", np.int32).astype(np.int64),
    )


def _packed_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)


def _deal(place_of: np.ndarray, owner: np.ndarray, keys, tokens, ranks=None) -> Iterator[dict]:
    """Packed rows, one for each place, of tokens that lie in the order of their owners; none without tokens."""
    if not len(place_of):
        return
    order = np.argsort(place_of, kind="stable")
    places, begins = np.unique(place_of[order], return_index=True)
    for place, part in zip(places, np.split(order, begins[1:]), strict=True):
        present, counts = np.unique(owner[part], return_counts=True)
        yield _pack(place, keys[present], counts, tokens[part], b"" if ranks is None else ranks[part])


def _bucket_rows(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """All shingles, dealt to hash buckets; a set that a task has met before is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        keys: list[bytes] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            sizes = np.array([len(h) for h in held])
            owner = np.repeat(np.arange(len(held)), sizes)
            place = (tokens % U64(buckets)).astype(np.int64)
            return _packed_batch(list(_deal(place, owner, np.frombuffer(b"".join(keys), KEY), tokens)))

        size = 0
        for batch in slices(batches, "text", SLICE_BYTES):
            for values in shingle_sets(_texts(batch), words):
                key = set_key(values)
                if not key or key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                held.append(values)
                keys.append(key)
                size += len(values)
            if size >= FLUSH_SHINGLES:
                yield flush()
                held, keys, size = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, PACKED)


def _count_bucket(places: int):
    """Shingles of a bucket that two classes share, with their number of classes, dealt to places of classes."""

    def run(rows: pa.Table) -> pa.Table:
        keys, counts, tokens, _ = _unpack(rows)
        owner = np.repeat(np.arange(len(keys)), counts)
        # a class that several tasks have sent counts once
        _, first = np.unique(keys, return_index=True)
        once = np.zeros(len(keys), bool)
        once[first] = True
        tokens, owner = tokens[once[owner]], owner[once[owner]]
        _, group, many = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = many[group] > 1
        tokens, owner, ranks = tokens[shared], owner[shared], many[group][shared]
        place = (keys.view(KEY_PARTS)["a"] % U64(places)).astype(np.int64)
        return pa.Table.from_pylist(list(_deal(place[owner], owner, keys, tokens, ranks)), schema=PACKED_SCHEMA)

    return run


SETS = "key binary, n int, tokens binary"
SETS_SCHEMA = pa.schema([("key", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary())])


def _needed(n, percent: int):
    """Common shingles that a set of n needs with any partner: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def _order_sets(percent: int):
    """Whole sets of a place in the global order, without those that share too little to be linked."""

    def run(rows: pa.Table) -> pa.Table:
        keys, counts, tokens, ranks = _unpack(rows)
        distinct, number = np.unique(keys, return_inverse=True)
        n = distinct.view(KEY_PARTS)["n"].astype(np.int64)
        owner = np.repeat(number, counts)
        enough = np.bincount(owner, minlength=len(distinct)) >= _needed(n, percent)
        keep = enough[owner]
        owner, tokens, ranks = owner[keep], tokens[keep], ranks[keep]
        order = np.lexsort((tokens, ranks, owner))
        owner, tokens = owner[order], tokens[order]
        present, begins = np.unique(owner, return_index=True)
        return pa.Table.from_pydict(
            {
                "key": [distinct[d].tobytes() for d in present],
                "n": n[present].astype(np.int32),
                "tokens": [part.tobytes() for part in np.split(tokens, begins[1:])] if len(present) else [],
            },
            schema=SETS_SCHEMA,
        )

    return run


def prefix_length(n: int, shared: int, percent: int) -> int:
    """Shared shingles in the prefix; the unshared ones, which stand before them, take the first places."""
    return max(0, shared - _needed(n, percent) + 1)


# -- chunks --


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys, parts = part.column("key").to_pylist(), []
                for n, raw in zip(part.column("n").to_pylist(), part.column("tokens").to_pylist(), strict=True):
                    tokens = np.frombuffer(raw, np.int64)
                    parts.append(tokens[: prefix_length(n, len(tokens), percent)])
                times = np.array([len(p) for p in parts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts)), pc.take(pa.array(keys, pa.binary()), pa.array(np.repeat(np.arange(len(keys)), times)))],
                    names=["token", "key"],
                )

    return run


CHUNKS = "chunk long, keys binary, sizes binary, counts binary, tokens binary"
CHUNKS_SCHEMA = pa.schema([("chunk", pa.int64()), *[(n, pa.binary()) for n in ("keys", "sizes", "counts", "tokens")]])


def _line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition with its number and the share of a chunk that they fill up to here."""
    from pyspark import TaskContext

    part, filled = TaskContext.get().partitionId(), 0.0
    for batch in batches:
        tokens = pc.binary_length(batch.column("tokens")).to_numpy(zero_copy_only=False) / 8
        ends = filled + np.cumsum(np.maximum(1 / CHUNK_SETS, tokens / CHUNK_SHINGLES))
        filled = float(ends[-1]) if len(ends) else filled
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(ends)],
            names=[*batch.schema.names, "part", "filled"],
        )


def _pack_chunk(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    tokens = rows.column("tokens").to_pylist()
    return pa.Table.from_pydict(
        {
            "chunk": [rows.column("chunk")[0].as_py()],
            "keys": [b"".join(rows.column("key").to_pylist())],
            "sizes": [rows.column("n").to_numpy().astype(np.int32).tobytes()],
            "counts": [np.array([len(t) // 8 for t in tokens], np.int32).tobytes()],
            "tokens": [b"".join(tokens)],
        },
        schema=CHUNKS_SCHEMA,
    )


def _chunks(sets: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """The labelled sets in order of their labels, cut into chunks of bounded size across all partitions.

    Only the filling of each partition comes to the driver: one number a partition.
    """
    spark = sets.sparkSession
    lined = saved(
        sets.join(labels, "key")
        .repartitionByRange(width, "label", "key")
        .sortWithinPartitions("label", "key")
        .select("key", "n", "tokens")
        .mapInArrow(_line_up, f"{SETS}, part int, filled double"),
        "lined",
    )
    fillings = sorted(lined.groupBy("part").agg(F.max("filled").alias("filled")).collect())
    before = np.concatenate(([0.0], np.cumsum([row.filled for row in fillings])))
    starts = [(row.part, float(x)) for row, x in zip(fillings, before, strict=False)]
    starts = spark.createDataFrame(starts, "part int, start double")
    placed = lined.join(F.broadcast(starts), "part").select(
        F.floor(F.col("start") + F.col("filled")).cast("long").alias("chunk"), "key", "n", "tokens"
    )
    return saved(placed.groupBy("chunk").applyInArrow(_pack_chunk, CHUNKS), "chunks")


def _sets_of(row: dict, side: str) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    keys = [x.tobytes() for x in np.frombuffer(row["keys" + side], KEY)]
    counts = np.frombuffer(row["counts" + side], np.int32)
    tokens = np.frombuffer(row["tokens" + side], U64)
    return keys, np.frombuffer(row["sizes" + side], np.int32).astype(np.int64), np.split(tokens, np.cumsum(counts)[:-1])


def _chunk_tokens(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, sizes, sets = _sets_of(row, "")
                parts = [s[: prefix_length(int(n), len(s), percent)] for n, s in zip(sizes, sets, strict=True)]
                tokens = np.unique(np.concatenate(parts)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens), pa.array(np.full(len(tokens), row["chunk"]))], names=["token", "chunk"]
                )

    return run


# -- prefix trees --


class PrefixTree:
    """Sets as paths in one global order.  The tree is kept as its sorted paths and the depth at which each
    leaves the path before it, which is the same as nodes with their children in order."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(paths)), key=lambda i: paths[i].tolist())
        self.order = order
        self.paths = [paths[i] for i in order]
        self.sizes = sizes[order]
        self.fork = [0]
        for a, b in zip(self.paths, self.paths[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.fork.append(int(differ[0]) if len(differ) else n)

    def walk(self, probe: np.ndarray, size: int, percent: int, wanted: np.ndarray) -> Iterator[int]:
        """Stored sets (by their own number) that are linked with the probe, of those wanted.

        ``probe`` says of every shingle whether the probe has it.  Going down a path, ``met[d]`` is the
        overlap of its first d shingles; a path that leaves its predecessor at depth d goes on from met[d].  At a
        depth where the overlap and what is left of the path fall short, the subtree is passed over.
        """
        met = np.zeros(1, np.int64)
        dead = -1  # depth at which the last path was given up
        valid = 0  # depth to which ``met`` describes the last path walked
        # 100 i >= p (n + m - i)
        needs = -(-percent * (size + self.sizes) // (100 + percent))
        smallest = min(size, int(self.sizes.min()))
        floor = -(-percent * (size + smallest) // (100 + percent))
        for k, path in enumerate(self.paths):
            fork = self.fork[k]
            valid = min(valid, fork)
            if 0 <= dead <= fork:
                continue
            dead = -1
            if not wanted[self.order[k]]:
                continue
            need = int(needs[k])
            steps = met[valid] + np.cumsum(probe[path[valid:]])
            met = np.concatenate((met[: valid + 1], steps))
            valid = len(path)
            if int(met[-1]) >= need:
                yield self.order[k]
                continue
            # the bound of a whole subtree: its deepest path is as long as the probe's rest at most
            short = np.flatnonzero(met + self._below(k, met) < floor)
            if len(short):
                dead = int(short[0])

    def _below(self, k: int, met: np.ndarray) -> np.ndarray:
        """Most that can still be met under each depth of path k: the longest path that runs through it."""
        reach = self.reach(k)
        return np.maximum(0, reach - np.arange(len(met)))

    def reach(self, k: int) -> np.ndarray:
        """Longest later path through each depth of path k."""
        if not hasattr(self, "_reach"):
            self._reach = {}
        if k not in self._reach:
            longest = np.full(len(self.paths[k]) + 1, len(self.paths[k]))
            depth = len(self.paths[k])
            for later in range(k + 1, len(self.paths)):
                depth = min(depth, self.fork[later])
                if depth == 0:
                    longest[0] = max(len(p) for p in self.paths)
                    break
                longest[: depth + 1] = np.maximum(longest[: depth + 1], len(self.paths[later]))
            self._reach[k] = longest
        return self._reach[k]


class Forest:
    """Union-find over small numbers; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def meet(one: tuple, two: tuple | None, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between two chunks, or within one if ``two`` is None."""
    keys, sizes, sets = one
    split = len(keys)
    if two is not None:
        keys, sizes, sets = keys + two[0], np.concatenate((sizes, two[1])), sets + two[2]
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.array([len(s) for s in sets])
    numbered = np.split(local, np.cumsum(counts)[:-1])
    # inside a tree the most frequent shingle comes first: near copies share long paths
    often = np.bincount(local, minlength=len(tokens))
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((np.arange(len(tokens)), -often))] = np.arange(len(tokens))
    lead: dict[int, list[int]] = {}
    prefixes = [s[: prefix_length(int(n), len(s), percent)].tolist() for n, s in zip(sizes, numbered, strict=True)]
    for d in range(split):
        for t in prefixes[d]:
            lead.setdefault(t, []).append(d)
    tree = PrefixTree([np.sort(rank[s]) for s in numbered[:split]], sizes[:split])
    forest = Forest(len(keys))
    probe = np.zeros(len(tokens), bool)
    for d in range(split if two is not None else 0, len(keys)):
        near = {e for t in prefixes[d] for e in lead.get(t, ()) if two is not None or e < d}
        wanted = np.zeros(split, bool)
        low, high = percent * sizes[d], 100 * sizes[d]
        for e in near:
            if low <= 100 * sizes[e] and percent * sizes[e] <= high and forest.root(e) != forest.root(d):
                wanted[e] = True
        if not wanted.any():
            continue
        mine = rank[numbered[d]]
        probe[mine] = True
        for e in tree.walk(probe, int(sizes[d]), percent, wanted):
            forest.join(d, e)
        probe[mine] = False
    return [(keys[d], keys[forest.root(d)]) for d in range(len(keys)) if forest.root(d) != d]


LINKS_SCHEMA = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _meetings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                other = _sets_of(row, "_2") if row["keys_2"] is not None else None
                links = meet(_sets_of(row, ""), other, percent)
                if links:
                    yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], schema=LINKS_SCHEMA)

    return run


# -- the join --


def shingle_links(docs: DataFrame, total: int, words: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): keys of linked classes, enough of them to connect every component.

    ``total`` is the number of shingles of all documents; buckets and places are dealt out by it.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, total // BUCKET_SHINGLES + 1)
    counted = _bucket_rows(docs, words, buckets).groupBy("place").applyInArrow(_count_bucket(buckets), PACKED)
    sets = saved(counted.groupBy("place").applyInArrow(_order_sets(percent), SETS), "sets")
    leads = sets.mapInArrow(_prefixes(percent), "token long, key binary")
    shared = leads.groupBy("token").agg(F.min("key").alias("low"), F.count("*").alias("n")).filter("n > 1")
    # one round of the smallest key around: near sets mostly get one label; it only decides who lies beside whom
    labels = leads.join(shared, "token").groupBy("key").agg(F.min("low").alias("label"))
    chunks = _chunks(sets, labels, width)
    held = chunks.mapInArrow(_chunk_tokens(percent), "token long, chunk long")
    across = held.groupBy("token").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low < high")
    some = held.join(across.select("token"), "token")
    pairs = (
        some.join(some.select("token", F.col("chunk").alias("chunk_2")), "token")
        .filter("chunk < chunk_2")
        .select("chunk", "chunk_2")
        .distinct()
    )
    second = chunks.select(*[F.col(c).alias(f"{c}_2") for c in chunks.columns])
    met = chunks.join(pairs, "chunk").join(second, "chunk_2").drop("chunk_2")
    alone = chunks.select("*", *[F.lit(None).cast("binary").alias(f"{c}_2") for c in chunks.columns if c != "chunk"])
    rows = alone.unionByName(met).repartition(4 * width, F.xxhash64("chunk", "keys_2"))
    return rows.mapInArrow(_meetings(percent), "a binary, b binary")


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, linked) of every document.

    Two documents link when 100 * common shingles >= percent * shingles of both; ``component_id`` is the smallest doc_id
    that links lead to, its own included; ``linked`` says whether there is another one.  Words are what lies between
    the six ASCII blanks, A-Z in lower case.  A text of fewer words is one shingle; null and empty texts link with
    nothing.  Repeated rows are equal texts: they link.  A null doc_id keeps a null component if it is alone.
    Other columns are not read.
    """
    keyed = saved(set_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "keys")
    classes = keyed.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    total = keyed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    links = components(shingle_links(docs, total, words, percent))
    joined = saved(classes.join(links, F.col("key") == F.col("node"), "left").drop("node"), "joined")
    tops = saved(
        joined.filter("root is not null")
        .groupBy("root")
        .agg(F.min("low").alias("top"), F.sum("n").alias("many"), F.count("*").alias("members")),
        "tops",
    )
    # classes that hold several documents or have links; all others are their own component
    wide = saved(
        hot_join(joined, tops, "root", "members", "left")
        .select("key", F.coalesce("top", "low").alias("component"), F.coalesce("many", "n").alias("many"), "n")
        .filter("many > 1")
        .drop("many"),
        "wide",
    )
    return hot_join(keyed, wide, "key", "n", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("component").isNotNull().alias("linked"),
    )
