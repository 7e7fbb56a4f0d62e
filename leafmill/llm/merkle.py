"""Operator 12: Merkle manifest of a dataset by slot pivots.

The leaves of a source stand in the order of their ids; level by level, conditional aggregates spread the children of a
parent into one column for each slot.  Hashing the columns one after the other gives the parent; leaving out the own slot
gives the siblings.  Parents carry the path from there to the root down again, so a proof needs one join for each level
and each level is a ``fanout``-th of the one below.  Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import saved
from leafmill.llm.ordering import crc32_sql, ranked

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: binary, after: binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest (32 bytes) of a document row; ``changed`` replaces fields by other values."""
    parts = [field(changed.get(name, F.col(name))) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def node_digest(children: Column) -> Column:
    """Digest of a node from the bytes of its children: their hexadecimal text is hashed."""
    return F.unhex(F.sha2(hexed(children).cast("binary"), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: node_digest(F.concat(step["before"], node, step["after"])))


def proof_digest(path: Column) -> Column:
    """Digest, as text, of all siblings of a path from the leaf to the root, left to right."""
    siblings = F.aggregate(path, F.lit(b""), lambda met, step: F.concat(met, step["before"], step["after"]))
    return F.sha2(hexed(siblings).cast("binary"), 256)


def _slots(fanout: int) -> list[str]:
    return [f"slot_{j}" for j in range(fanout)]


def _joined(columns: list[Column]) -> Column:
    return F.concat(*[F.coalesce(c, F.lit(b"")) for c in columns]) if columns else F.lit(b"")


@dataclass
class Forest:
    """Parents of each level, from the lowest, and the top of each tree: (tree, digest, depth)."""

    parents: list[DataFrame]
    tops: DataFrame
    fanout: int


def grow(nodes: DataFrame, fanout: int, label: str) -> Forest:
    """The parents of ``nodes`` (tree, pos, n, digest), level by level until every tree has one node."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    level, parents, tops = nodes, [], []
    while True:
        tops.append(level.filter("n = 1").select("tree", "digest", F.lit(len(parents)).alias("depth")))
        if largest <= 1:
            break
        slot = F.pmod("pos", F.lit(fanout))
        pivot = (
            level.filter("n > 1")
            .groupBy("tree", F.expr(f"pos div {fanout}").alias("pos"))
            .agg(F.max("n").alias("n"), *[F.max(F.when(slot == j, F.col("digest"))).alias(c) for j, c in enumerate(_slots(fanout))])
        )
        level = saved(
            pivot.select(
                "tree", "pos", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), *_slots(fanout),
                node_digest(_joined([F.col(c) for c in _slots(fanout)])).alias("digest"),
            ),
            f"{label}-{len(parents) + 1}",
        )
        parents.append(level)
        largest = -(-largest // fanout)
    union = tops[0]
    for top in tops[1:]:
        union = union.unionByName(top)
    return Forest(parents, union, fanout)


def with_path(nodes: DataFrame, forest: Forest, paths: DataFrame) -> DataFrame:
    """``nodes`` with their ``path`` and the other columns of ``paths`` (tree, depth, path, ...).

    ``paths`` has the way on from the top of each tree.  A top takes it as it is; other nodes put their siblings before
    the way of their parent.
    """
    slots, fanout = _slots(forest.fanout), forest.fanout
    extra = [c for c in paths.columns if c not in ("tree", "depth")]

    def above(k: int) -> DataFrame:
        """What stands over the nodes of level ``k``: parents, and the way on for the tops of that level."""
        tops = paths.filter(F.col("depth") == k).select(
            "tree", F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast("binary").alias(c) for c in slots], F.lit(True).alias("is_top"), *extra
        )
        if k == len(forest.parents):
            return tops
        rows = climb(forest.parents[k].drop("n", "digest"), k + 1)
        return rows.select("tree", "pos", *slots, F.lit(False).alias("is_top"), *extra).unionByName(tops)

    def climb(level: DataFrame, k: int) -> DataFrame:
        over = above(k).select("tree", F.col("pos").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in slots], "is_top", *extra)
        own = F.pmod("pos", F.lit(fanout))
        before = _joined([F.when(F.lit(j) < own, F.col(f"up_{c}")) for j, c in enumerate(slots)])
        after = _joined([F.when(F.lit(j) > own, F.col(f"up_{c}")) for j, c in enumerate(slots)])
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        path = F.when(F.col("is_top"), F.col("path")).otherwise(F.concat(step, "path"))
        joined = level.withColumn("parent", F.expr(f"pos div {fanout}")).join(over, ["tree", "parent"])
        return joined.withColumn("path", path).drop("parent", "is_top", *[f"up_{c}" for c in slots])

    return climb(nodes, 0)


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, leaf, subroot, root, path) of every row of ``docs``, and the columns named in ``keep``.

    Digests are 32 bytes; ``path`` has the siblings before and after the own node from the leaf to the root, through the
    subroot.  Leaves of a source ascend by doc_id (null first), equal ids by their digest; a null source is the first one.
    Every row is a leaf, repeated ones too; an empty table gives no rows.  Other columns are left out.  Rows are dealt by
    ranges of (source, doc_id), so a hot source is many tasks; texts are hashed where they are read and never shuffled.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # a null comes first
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), *keep)
    leaves = saved(ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], "leaves"), "leaves-placed")
    forest = grow(leaves.select("tree", "pos", "n", "digest"), fanout, "sources")
    sources = saved(forest.tops, "subroots")
    whole = ranked(sources.select(F.lit("").alias("whole"), "tree", "digest", "depth"), "whole", [F.col("tree")], "subroots-order")
    heads = saved(whole.select(F.col("whole").alias("tree"), "pos", "n", "digest", F.col("tree").alias("source"), "depth"), "subroots-placed")
    upper = grow(heads.select("tree", "pos", "n", "digest"), fanout, "whole")
    top = upper.tops.select("tree", "depth", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    ways = with_path(heads.withColumnRenamed("depth", "of"), upper, top)
    paths = saved(ways.select(F.col("source").alias("tree"), F.col("of").alias("depth"), "path", F.col("digest").alias("subroot"), "root"), "paths")
    placed = with_path(leaves.drop("n"), forest, paths)
    return placed.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", *keep)


def tampered_text() -> Column:
    """The text without line ends where 2 divides the CRC-32 of the id, else null."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(even & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))


def merkle_report(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` as text digests, with the root that each row gives after tampering.

    Tampering deletes the line ends of the text of every second document (see ``tampered_text``); ``verified`` tells whether
    the folded root is still the root, which it is for a text without line ends.
    """
    changed = docs.select(*FIELDS).withColumn("changed", tampered_text())
    changed = changed.withColumn("other", F.when(F.col("changed").isNotNull(), leaf_digest(text=F.col("changed"))))
    rows = merkle_manifest(changed, keep=("other",)).withColumn("folded", folded(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def merkle_sql() -> str:
    """The same report as DuckDB SQL over ``documents``: nodes upwards, then every leaf folded up its own path."""

    def row(text: str) -> str:
        values = [f"CAST({f} AS VARCHAR)" for f in FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    climb = """
  SELECT 0 AS k, {tree} AS tree, {order} AS pos, {digest} AS h, count(*) OVER (PARTITION BY {tree}) AS n FROM {rows}
  UNION ALL
  SELECT k + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3)
  FROM {name} WHERE n > 1 GROUP BY k, tree, pos // 3
"""
    low = climb.format(
        name="low", tree="tree", digest="leaf", rows="leaves",
        order="row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1",
    )
    high = climb.format(name="high", tree="''", digest="h", rows="subroots", order="row_number() OVER (ORDER BY tree) - 1")
    around = """
  SELECT tree, k, pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < x.pos), '') AS before,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > x.pos), '') AS after
  FROM {name} x JOIN {name} s USING (tree, k) WHERE x.n > 1 AND s.pos // 3 = x.pos // 3 GROUP BY tree, k, x.pos
"""
    around = around.replace("SELECT tree, k, pos,", "SELECT tree, k, x.pos AS pos,")
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {row("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS other
  FROM documents
),
low AS ({low}),
subroots AS MATERIALIZED (SELECT tree, h FROM low WHERE n = 1),
high AS ({high}),
tops AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots),
near_low AS MATERIALIZED ({around.format(name="low")}),
near_high AS MATERIALIZED ({around.format(name="high")}),
numbered AS (
  SELECT row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id, tree, doc_id, leaf, other,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves
),
up AS (
  SELECT id, tree, 0 AS k, pos, other AS h, '' AS proof FROM numbered
  UNION ALL
  SELECT id, tree, k + 1, up.pos // 3, sha256(before || h || after), proof || before || after
  FROM up JOIN near_low USING (tree, k, pos)
),
joint AS (
  SELECT id, 0 AS k, tops.pos, h, proof FROM (SELECT id, tree, arg_max(h, k) AS h, arg_max(proof, k) AS proof FROM up GROUP BY id, tree) JOIN tops USING (tree)
),
further AS (
  SELECT id, k, pos, h, proof FROM joint
  UNION ALL
  SELECT id, k + 1, f.pos // 3, sha256(before || h || after), proof || before || after
  FROM further f JOIN near_high USING (k, pos)
),
ends AS (SELECT id, arg_max(h, k) AS folded_root, arg_max(proof, k) AS proof FROM further GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM numbered JOIN ends USING (id) JOIN tops USING (tree), (SELECT h AS root FROM high WHERE n = 1)
"""
