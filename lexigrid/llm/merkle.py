"""Merkle manifest of a data set by nested-struct rollup: roots, and a proof for every row.

A row's leaf is a SHA-256 of its fields. Within a group (a source) leaves are ranked by id, and every
ARITY consecutive nodes become their digest until one is left, the group's subroot; subroots, ranked by
group, give the root in the same way.

The rank's digits to the base ARITY are columns. Rows are dealt to blocks of ARITY ** DEPTH ranks, and
one digit after the other is grouped away: a node is a struct of its digit, its digest and the array
of its children's structs. Blocks are bounded, so a node never holds more than BLOCK leaves. The
blocks' own digests are the leaves of the next round, until each group is a single node.
Paths then go down: a block and the path above it are united and grouped by block, and explode
unfolds the structs again, a level at a time, with what stands to the left and right of each child.
No join brings leaves and proofs together, and no text is read twice.

Defined cases. Null fields are written as `-`. Null groups are a group, which comes first. Null ids come
first in their group and aren't tampered with; equal ids are ordered by their leaves, so repeated rows
get proofs of their own. An empty table gives no rows. Very long texts are hashed where they are read
and not moved. Other columns pass through whatever their names, if they are named in `keep`.

Scale: the scan leaves two digests per row, which are sorted into ranges once, dealt to blocks once and
rolled up there without another shuffle. A group of any size is spread over ranges and blocks; ranks come
from counts per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.llm.common import boxed, written
from lexigrid.llm.ranking import ranked

ARITY, DEPTH = 16, 3
BLOCK = ARITY**DEPTH
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What the manifest adds; columns of these names are replaced.
OWN = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A value so that no two rows of different values read alike: its size in bytes, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _packed(hexed: Column) -> Column:
    return F.unhex(hexed)


def _hexed(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def _strung(children: Column) -> Column:
    return F.lower(F.array_join(F.transform(children, lambda c: F.hex(c["h"])), ""))


def _rolled(nodes: DataFrame) -> DataFrame:
    """g, size, rank, h, leaf -> g, size, block, h, kids: a row per block, its leaves nested in kids."""
    digits = [F.pmod(F.floor(F.col("rank") / ARITY**d), F.lit(ARITY)).cast("int").alias(f"d{d}") for d in range(DEPTH)]
    found = nodes.select("g", "size", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"), *digits, "h", F.col("leaf").alias("kids")).repartition("g", "block")
    for d in range(DEPTH):
        above = [f"d{k}" for k in range(d + 1, DEPTH)]
        grouped = found.groupBy("g", "block", *above).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.col(f"d{d}").alias("d"), "h", "kids")), lambda x, y: x["d"] - y["d"]).alias("kids"))
        # a single node of the whole group is passed on as it is
        single = F.col("size") <= ARITY**d
        found = grouped.withColumn("h", F.when(single, F.col("kids")[0]["h"]).otherwise(_packed(digest(_strung(F.col("kids"))))))
    return found.select("g", "size", "block", "h", "kids")


def _unrolled(blocks: DataFrame) -> DataFrame:
    """g, size, kids, path above -> g, leaf, path: the levels from the leaf up, each what is left and right of the node."""
    found = blocks.select("g", "size", "path", F.col("kids").alias("kids"))
    for d in reversed(range(DEPTH)):
        strung = found.withColumn("strung", _strung(F.col("kids")))
        out = strung.select("g", "size", "path", "strung", F.posexplode("kids").alias("i", "kid"))
        step = F.array(F.struct(F.substr("strung", F.lit(1), HEX * F.col("i")).alias("left"), F.substr("strung", HEX * F.col("i") + HEX + 1).alias("right")))
        path = F.when(F.col("size") <= ARITY**d, F.col("path")).otherwise(F.concat(step, "path"))
        found = out.select("g", "size", path.alias("path"), F.col("kid.kids").alias("kids"))
    return found.select("g", F.col("kids").alias("leaf"), "path")


_PATH = "array<struct<left:string,right:string>>"


def trees(nodes: DataFrame, tag: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (g, h) of the groups of nodes (g, size, rank, h, leaf), and the blocks of each round, the lowest first."""
    rounds, most = [], nodes.agg(F.max("size")).first()[0] or 0
    while True:
        blocks = written(_rolled(nodes), tag)
        rounds.append(blocks)
        most = -(-most // BLOCK)
        if most <= 1:
            return blocks.select("g", "h"), rounds
        nodes = blocks.select("g", F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.col("block").alias("rank"), "h", F.col("block").alias("leaf"))


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The blocks with the path above each, by grouping both."""
    kind = blocks.schema["kids"].dataType
    mine = blocks.select("g", "block", "size", "kids", F.lit(None).cast(_PATH).alias("path"))
    theirs = above.select("g", "block", F.lit(None).cast("long").alias("size"), F.lit(None).cast(kind).alias("kids"), "path")
    return mine.unionByName(theirs).groupBy("g", "block").agg(F.max("size").alias("size"), F.first("kids", True).alias("kids"), F.first("path", True).alias("path"))


def proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, leaf, path) of all leaves, from the paths (g, path) above the groups' roots."""
    paths = above.select("g", F.lit(0).cast("long").alias("block"), "path")
    for blocks in reversed(rounds[1:]):
        paths = _unrolled(_under(blocks, paths)).select("g", F.col("leaf").alias("block"), "path")
    return _unrolled(_under(rounds[0], paths))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (the id by default) with leaf, subroot, root, proof_sha256, folded_root and verified.

    tampered: a condition; folded_root is then that of the row with its text's A-Z in lower case, and the siblings as they were.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c not in OWN]
    given = {c: F.col(f"`{c}`") for c in fields}
    leaf = digest(*(field(given[c]) for c in fields))
    changed = digest(*(field(F.translate(given[c], _UPPER, _LOWER) if c == text_col else given[c]) for c in fields))
    tampered = F.lit(False) if tampered is None else tampered
    rows = docs.select(
        boxed(docs, keep),
        F.col(f"`{group_col}`").cast("string").alias("g"),
        F.col(f"`{id_col}`").alias("id"),
        _packed(leaf).alias("h"),
        F.when(tampered, _packed(changed)).alias("changed"),
    )
    leaves = written(rows, "merkle-leaves")
    placed = ranked(leaves, ["g"], ["id", "h"], "merkle-ranks")
    subroots, low = trees(placed.select("g", "size", "rank", "h", F.struct(F.col("__in"), "h", "changed").alias("leaf")), "merkle-blocks")
    groups = ranked(subroots.withColumnRenamed("g", "source"), [], ["source"], "merkle-groups")
    top, high = trees(groups.select(F.lit(0).alias("g"), "size", "rank", "h", F.struct("source", "h").alias("leaf")), "merkle-top")
    starts = top.select("g", F.array().cast(_PATH).alias("path"))
    above = proofs(high, starts).select(F.col("leaf.source").alias("g"), "path")
    found = proofs(low, above).select("leaf", "path")
    whole = found.select("leaf.__in", _hexed(F.col("leaf.h")).alias("leaf"), _hexed(F.coalesce("leaf.changed", "leaf.h")).alias("shown"), "path")
    # steps to the group's root come first, those above it are as many as the tree of groups is high
    levels, n = 0, groups.count()
    while ARITY**levels < n:
        levels += 1
    within = F.slice("path", F.lit(1), F.size("path") - levels)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return whole.select(
        "__in.*",
        "leaf",
        fold(F.col("leaf"), within).alias("subroot"),
        F.lit(_root(top)).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.col("shown"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _root(top: DataFrame) -> str | None:
    """The root, one row."""
    row = top.select(_hexed(F.col("h")).alias("h")).first()
    return row["h"] if row else None
