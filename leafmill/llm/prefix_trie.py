"""Operator 13: prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is cut into blocks of ``width`` turns, one column for each turn.  GROUP BY the node before the block, ROLLUP
over its columns, gives every prefix of every conversation at once; ``grouping_id`` tells the depth.  A node is named by the
exclusive-or of the hashes of its (place, turn) pairs, so the name of the node before any block is a running
exclusive-or and all blocks, however deep, take part in the same two aggregations.

Counts over a subtree need no walk: each node belongs to its smallest member, and a conversation owns its nodes from
some depth on.  The code points of its turns before that depth are what it shares; their sums over the members of a node
give the tokens saved below it, and a leaf is counted by its owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import saved
from leafmill.llm.ordering import crc32_sql, ranked, seated

WIDTH = 8
#: Blocks of a conversation that one window orders; longer ones add the totals of earlier runs of this many.
RUN = 1024
#: Conversation ids that are joined to one text before a node's digest is taken.
PIECE = 1000
# --- fixed values: conversations of a hundred share a head of at most five turns ---
FAMILY, HEADS = 100, 6


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes: half a SHA-256 of (role, text), then the code points of the text.  Null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(whole, 1, 32), F.lpad(F.hex(F.char_length(text)), 8, "0")))


def turn_chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def place_hash(side: int, place: Column, turn: Column) -> Column:
    """One of the two 64-bit hashes of a turn at its place; 0 where there is no turn."""
    return F.when(turn.isNotNull(), F.xxhash64(F.lit(side), place.cast("long"), turn)).otherwise(F.lit(0))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, turn): the turns of each conversation in order, null turns first, equal ones by their ids.

    Rows without a conv_id belong to no conversation and are left out.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("turn_key")
    )
    placed = ranked(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("turn_key")], "turns")
    return placed.select("conv_id", "pos", "n", F.col("turn_key").alias("turn"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, turn) and ids of all conversations, after each took the head of its family.

    Conversation c begins with the first h turns of conversation c - c % 100 and goes on with its own turns after its first
    h; h is the CRC-32 of its decimal id modulo 6.
    """
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    family = F.expr(f"conv_id - conv_id % {FAMILY}")
    heads = (
        turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1))
        .groupBy(F.col("conv_id").alias("family"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("head"))  # five at most
    )
    given = F.coalesce(F.least("h", F.size("head")), F.lit(0))
    ids = turns.filter("pos = 0").select("conv_id", family.alias("family"), taken.cast("int").alias("h"))
    begun = ids.join(heads, "family", "left").select("conv_id", "h", "head", given.alias("given"))
    first = begun.filter("given > 0").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("given"))).alias("t"))
    # a family without so long a head moves the own turns forward
    lengths = heads.select("family", F.size("head").alias("length"))
    own = (
        turns.withColumns({"family": family, "h": taken})
        .filter("pos >= h")
        .join(lengths, "family", "left")
        .select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0)))).cast("long").alias("pos"), "turn")
    )
    return first.select("conv_id", F.col("t.pos").alias("pos"), F.col("t.turn").alias("turn")).unionByName(own), ids.select("conv_id")


def blocks_of(turns: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(conv_id, block, t1 .. t<width>, name_1, name_2, chars, from_1, from_2, chars_before): conversations in blocks.

    ``name_`` and ``chars`` belong to the block alone, ``from_`` and ``chars_before`` to all before it.  A conversation
    without turns is one empty block.
    """
    columns = [f"t{j + 1}" for j in range(width)]
    slot = F.col("pos") % width
    marked = turns.unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn")))
    blocks = marked.groupBy("conv_id", F.expr(f"pos div {width}").alias("block")).agg(
        *[F.max(F.when(slot == j, F.col("turn"))).alias(c) for j, c in enumerate(columns)],
        *[F.bit_xor(place_hash(side, F.col("pos"), F.col("turn"))).alias(f"name_{side}") for side in (1, 2)],
        F.coalesce(F.sum(turn_chars(F.col("turn"))), F.lit(0)).alias("chars"),
    )
    blocks = blocks.withColumn("run", F.expr(f"block div {RUN}"))
    summed = {"from_1": F.bit_xor("name_1"), "from_2": F.bit_xor("name_2"), "chars_before": F.sum("chars")}
    runs = blocks.groupBy("conv_id", "run").agg(*[v.alias(f"run_{k}") for k, v in summed.items()])
    by_run = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = {"run_from_1": F.bit_xor, "run_from_2": F.bit_xor, "run_chars_before": F.sum}
    runs = runs.select("conv_id", "run", *[F.coalesce(f(k).over(by_run), F.lit(0)).alias(k) for k, f in total.items()])
    by_block = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({k: F.coalesce(v.over(by_block), F.lit(0)) for k, v in summed.items()}).join(runs, ["conv_id", "run"])
    return blocks.select(
        "conv_id", "block", *columns, "name_1", "name_2", "chars",
        *[F.col(f"from_{s}").bitwiseXOR(F.col(f"run_from_{s}")).alias(f"from_{s}") for s in (1, 2)],
        (F.col("chars_before") + F.col("run_chars_before")).alias("chars_before"),
    )


def prefixes(blocks: DataFrame, width: int, totals: str) -> DataFrame:
    """Every node: (depth, id_1, id_2, up_1, up_2, before, last) and the aggregates ``totals`` over its members.

    ``up_`` names the parent; ``last`` are the code points of the last turn and ``before`` those of all turns before it.
    """
    columns = [f"t{j + 1}" for j in range(width)]
    listed = ", ".join(columns)
    rolled = blocks.sparkSession.sql(
        f"SELECT block, from_1, from_2, {listed}, grouping_id() AS rolled, max(chars_before) AS chars_before, {totals} "
        f"FROM {{blocks}} GROUP BY block, from_1, from_2, ROLLUP({listed})",
        blocks=blocks,
    )
    level = F.lit(width) - F.bit_count("rolled")
    turn = F.when(level > 0, F.element_at(F.array(*columns), F.greatest(level, F.lit(1))))
    # the top of a block is the last node of the one before it, but for the root
    real = rolled.withColumns({"level": level, "last_turn": turn}).filter("last_turn IS NOT NULL OR (level = 0 AND block = 0)")
    place = F.col("block") * width

    def name(side: int, below: Column) -> Column:
        value = F.col(f"from_{side}")
        for j, c in enumerate(columns):
            value = value.bitwiseXOR(F.when(F.lit(j) < below, place_hash(side, place + j, F.col(c))).otherwise(F.lit(0)))
        return value

    chars = F.col("chars_before")
    for j, c in enumerate(columns[:-1]):
        chars = chars + F.when(F.lit(j) < F.col("level") - 1, F.coalesce(turn_chars(F.col(c)), F.lit(0))).otherwise(F.lit(0))
    known = {"depth", "block", "from_1", "from_2", "rolled", "chars_before", "level", "last_turn", *columns}
    return real.select(
        (place + F.col("level")).cast("long").alias("depth"),
        name(1, F.col("level")).alias("id_1"), name(2, F.col("level")).alias("id_2"),
        name(1, F.col("level") - 1).alias("up_1"), name(2, F.col("level") - 1).alias("up_2"),
        chars.alias("before"), F.coalesce(turn_chars(F.col("last_turn")), F.lit(0)).alias("last"),
        *[c for c in real.columns if c not in known],
    )


def digests(ends: DataFrame) -> DataFrame:
    """(id_1, id_2, ends_sha256): digest of the ascending, comma-joined conv_ids of each (id_1, id_2).

    Ids are dealt by ranges and joined to pieces there, so what one task reads of a node with very many ends are pieces.
    SHA-256 has one order only: a task streams the pieces of its nodes through it and holds one batch.
    """
    dealt = seated(ends.select("id_1", "id_2", "conv_id"), ["id_1", "id_2", "conv_id"], "ends")
    pieces = dealt.groupBy("id_1", "id_2", F.expr(f"seat div {PIECE}").alias("piece"), F.shiftright("seat", 33).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("listed")
    )
    ordered = pieces.repartition("id_1", "id_2").sortWithinPartitions("id_1", "id_2", "range", "piece").drop("range", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for key_1, key_2, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (key_1, key_2) != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (key_1, key_2), hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
            yield _digest_rows(done)
        if last is not None:
            yield _digest_rows([(*last, state.hexdigest())])

    return ordered.mapInArrow(run, "id_1 long, id_2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["id_1", "id_2", "ends_sha256"])


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations (see ``rebuilt``), all counts long.

    conv_id: smallest member; depth; parent_conv_id: smallest member of the parent (null for the root); n_convs; n_children;
    n_leaves: childless nodes at or below; saved_tokens: code points of the last turn, once for each member but the first,
    summed over the subtree; ends_sha256: digest of the ids of the members that end there.

    Null role or text is empty, a null conv_id belongs to no conversation, repeated rows are turns of their own; an empty table
    has no node.  Other columns are left out.  No group of rows is held whole: aggregates are combined before they are
    shuffled and turns are placed by ranges.
    """
    turns = saved(turns_of(conversations), "turns-placed")
    blocks = saved(blocks_of(*rebuilt(turns), width), "blocks")
    nodes = saved(prefixes(blocks, width, "min(conv_id) AS conv_id"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("up_1").alias("id_1"), F.col("up_2").alias("id_2")).agg(F.count("*").alias("n_children"))
    counted = saved(
        nodes.join(children, ["id_1", "id_2"], "left").select("id_1", "id_2", "depth", "before", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children")),
        "nodes-counted",
    )
    owned = counted.groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    whole = saved(
        blocks.groupBy("conv_id").agg(F.bit_xor("name_1").alias("id_1"), F.bit_xor("name_2").alias("id_2"), F.sum("chars").alias("chars")), "conversations"
    )
    members = whole.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "chars").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    totals = (
        "min(conv_id) AS conv_id, count(*) AS n_convs, sum(shared) AS shared, min_by(shared, conv_id) AS own_shared, sum(leaf) AS n_leaves"
    )
    rolled = prefixes(blocks.join(members, "conv_id"), width, totals)
    saved_tokens = F.col("shared") - F.col("own_shared") - (F.col("n_convs") - 1) * F.col("before")
    parents = counted.select(F.col("id_1").alias("up_1"), F.col("id_2").alias("up_2"), F.col("conv_id").alias("parent"))
    return (
        rolled.join(counted.select("id_1", "id_2", "n_children"), ["id_1", "id_2"])
        .join(digests(whole), ["id_1", "id_2"], "left")
        .join(parents, ["up_1", "up_2"], "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            saved_tokens.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def trie_sql() -> str:
    """The same nodes as DuckDB SQL over ``conversations``: prefixes as lists, subtrees by all ancestors of each node."""
    head = f"{crc32_sql('CAST(conv_id AS VARCHAR)')} % {HEADS}"
    turn = "{role: coalesce(role, ''), text: coalesce(text, '')}"
    return f"""
WITH given AS (
  SELECT conv_id, list({turn} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (SELECT conv_id, turns, {head} AS h FROM given),
built AS MATERIALIZED (
  SELECT c.conv_id, coalesce(f.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM heads c LEFT JOIN given f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}
),
nodes AS MATERIALIZED (
  SELECT turns[1:d] AS key, CAST(d AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(sha256(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (d = len(turns))), sha256('')) AS ends_sha256
  FROM built, unnest(range(0, len(turns) + 1)) AS r(d) GROUP BY key, depth
),
parents AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN parents USING (key)),
below AS (
  SELECT key[1:d] AS key, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(key[depth].text) END) AS BIGINT) AS saved_tokens
  FROM counted, unnest(range(0, depth + 1)) AS r(d) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (key) LEFT JOIN nodes p ON c.depth > 0 AND p.key = c.key[1:c.depth - 1]
"""
