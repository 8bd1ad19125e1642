"""A Merkle manifest of a table: every row a leaf, a tree for each source, one tree over the sources' roots.

Built bottom-up: nodes are numbered within their group, runs of ``FANOUT`` neighbours become their parent, and each level is
a written table. Proofs are pushed top-down: a level's nodes join their parents on the number, and each child puts its
siblings before the proof that its parent inherits. A parent travels once for its ``FANOUT`` children, with
their digests in one binary value, so what is shuffled for proofs is a share of the leaves, however deep the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.plans.shared import stage

FANOUT = 16
#: Stretches of groups in sorted partitions (24 bytes each) up to which their table is broadcast; beyond, Spark joins it by key.
MOST_STRETCHES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes' number, ``:`` and the value; integers as decimals."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, leaf, changed): a row's digest, and the one it has after tampering (null where it is not tampered with).

    ``grp`` is the source as a key that is never null and sorts as sources do, null first.
    """
    values = {n: F.col(n) for n in FIELDS}
    leaf = digest(*[field(c) for c in values.values()])
    lowered = digest(*[field(F.translate(c, _UPPER, _LOWER) if n == "text" else c) for n, c in values.items()])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", grp.alias("grp"), F.unhex(leaf).alias("hash"), F.when(hit, F.unhex(lowered)).alias("changed"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos`` (from 0) and ``n`` (rows) within ``grp``, in ``order``, for groups of any size.

    Rows are range-partitioned, so that a large group lies in many tasks; a row's number is its place in its task's
    stretch of the group, plus the group's rows in earlier tasks.
    """
    placed = df.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed, name).withColumn("part", F.shiftright("at", 33))
    stretches = placed.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stage(stretches.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n")), f"{name}-stretches")
    if stretches.count() <= MOST_STRETCHES:
        stretches = F.broadcast(stretches)
    return placed.join(stretches, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """From nodes(grp, pos, n, hash) all levels (grp, pos, n, hash, run), the last with one node a group at most.

    ``run`` holds the digests of a node's children. A group stops where it has one node, as a run of one does not at other places.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    found = [nodes.select("grp", "pos", "n", "hash", F.lit(None).cast("binary").alias("run"))]
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct((F.col("pos") % FANOUT).alias("at"), F.hex("hash").alias("hash"))))
        run = F.lower(F.array_join(F.transform(kids, lambda k: k["hash"]), ""))
        up = found[-1].where("n > 1").groupBy("grp", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"), run.alias("run"))
        most = -(-most // FANOUT)
        found.append(stage(up.select("grp", "pos", "n", F.unhex(digest(F.col("run"))).alias("hash"), F.unhex("run").alias("run")), f"{name}-level-{len(found)}"))
    return found


def pushed(tree: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """Proofs of the lowest level's nodes: (all its columns, ``carried``, proof).

    ``tops(grp, proof, ...carried)`` has what a group's root inherits. ``proof`` is an array of (run, at) from the node upward:
    the digests of its run, and its own place in it.
    """
    above = None
    for level in reversed(tree):
        # a group's root takes what the tops give; it stands in no run (parents of others are told apart by n)
        parents = tops.select("grp", F.lit(0).cast("long").alias("up"), F.lit(True).alias("top"), F.lit(None).cast("binary").alias("kids"), F.col("proof").alias("rest"), *carried)
        if above is not None:
            parents = parents.unionByName(above.select("grp", F.col("pos").alias("up"), F.lit(False).alias("top"), F.col("run").alias("kids"), F.col("proof").alias("rest"), *carried))
        own = level.withColumns({"up": F.when(F.col("n") > 1, F.expr(f"pos div {FANOUT}")).otherwise(F.lit(0)).cast("long"), "top": F.col("n") == 1})
        step = F.struct(F.col("kids").alias("run"), (F.col("pos") % FANOUT).cast("int").alias("at"))
        proof = F.when(F.col("top"), F.col("rest")).otherwise(F.concat(F.array(step), F.col("rest")))
        above = own.join(parents, ["grp", "up", "top"]).withColumn("proof", proof).drop("up", "top", "kids", "rest")
    return above


@dataclass
class Manifest:
    """``rows`` are the numbered leaves, ``trees`` the levels over them, ``roots`` the numbered subroots, ``over`` the levels over these."""

    rows: DataFrame
    trees: list[DataFrame]
    roots: DataFrame
    over: list[DataFrame]


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``; other columns are not looked at.

    Leaves of a source ascend by doc_id, null first, rows of one doc_id by their digest; equal rows have leaves of their own.
    Each value may be null. An empty table has no leaf, no root and no rows.
    """
    rows = numbered(stage(leaves(docs), "leaves"), ["doc_id", "hash"], "numbered")
    trees = levels(rows, "source")
    tops = trees[0].where("n = 1")
    for level in trees[1:]:
        tops = tops.union(level.where("n = 1"))
    # (the one group over all sources is spread by the sources' names)
    named = tops.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "hash")
    roots = numbered(named, ["member"], "subroots")
    return Manifest(rows, trees, roots, levels(roots, "root"))


_PROOF = "array<struct<run: binary, at: int>>"


def prove(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, proof) of every row; digests in binary, ``proof`` as ``pushed`` has it."""
    root = manifest.over[-1].select("grp", F.col("hash").alias("root"), F.expr(f"cast(array() as {_PROOF})").alias("proof"))
    # the lowest level with its members' names
    over = [manifest.roots, *manifest.over[1:]]
    members = pushed(over, root, ["root"]).select(F.col("member").alias("grp"), F.col("hash").alias("subroot"), "root", "proof")
    found = pushed([manifest.rows, *manifest.trees[1:]], stage(members, "members"), ["subroot", "root"])
    return found.select("doc_id", F.col("hash").alias("leaf"), "changed", "subroot", "root", "proof")


def siblings(step: Column) -> tuple[Column, Column]:
    """Hex digests left and right of a node in its run."""
    text = hexed(step["run"])
    return F.substring(text, F.lit(1), 64 * step["at"]), F.substring(text, 64 * step["at"] + 65, F.lit(64 * FANOUT))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(*siblings(s))), ""))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof give."""

    def step(h: Column, s: Column) -> Column:
        left, right = siblings(s)
        return digest(left, h, right)

    return F.aggregate(proof, start, step)


def verify(proofs: DataFrame) -> DataFrame:
    """Each row of ``prove`` with its digests in hex, the root that its present leaf gives, and whether that is the root."""
    now = hexed(F.coalesce("changed", "leaf"))
    shown = proofs.select("doc_id", *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("proof")).alias("proof_sha256"), folded(now, F.col("proof")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
