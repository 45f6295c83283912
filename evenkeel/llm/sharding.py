"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child draws -ln(u) / weight, with u a hash of the child's name and the document's id;
the least draw wins, and only the winner's children draw next. So a level decides by its own names and weights, a document makes one draw for each child on
its path, and a child is chosen in proportion to its weight among its siblings.

Racks and regions declare their weights. A weight that changes below a declared one moves documents within that subtree
only; declaring the new sum as well (``reweighted`` with ``declare``) lets documents come from, or go to, siblings of the nodes whose weights change, and moves none between
others. Siblings that come or go likewise take or leave documents, and that is all that moves.

``grown`` adds a shard as a region of its own, which takes documents only into itself, whatever the tree. ``build_tree`` of one shard
more is that tree where the last region is full, as with 40 shards. Elsewhere it puts the shard into an open rack, whose region then draws for more: documents that come go
to any of its shards, so one step of a part-filled tree moves documents between old shards too (of 100,000, from 41 to 42 shards: see README). The tree of least draws over all
shards would move none at any size, but its levels decide nothing; both can't be had.

The law is ``key``: doc_id and the shard count decide. Slots number the rows of each shard
from 0: rows are numbered inside hash buckets, and running counts of the buckets, a table whose
size is fixed by the bucket count, shift them. A bucket that repeated rows make large is split by row number.

Defined results: null text has no bytes (size 16, checksum 0); null ids hash as one value. Rows
that share id, size and checksum may swap slots, which changes no output row. Very long texts cost one
pass for size and checksum. An empty table gives no rows. Further columns are ignored by the
report and kept by ``shard_of``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

SHARDS = 40
#: Shards of a rack, racks of a region.
RACK = 5
REGION = 4
ROW_OVERHEAD = 16
#: Rows that one bucket of a shard holds on average when slots are given; with over four times as many it is split.
BUCKET_ROWS = 200_000


@dataclass(frozen=True)
class Node:
    """A shard (no children), or a rack or region, which draws under the weight that it declares, else under the sum below it."""

    name: str
    weight: float | None = None
    shard: int | None = None
    children: tuple[Node, ...] = ()

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]

    def load(self) -> float:
        return self.weight if self.weight is not None else sum(c.load() for c in self.children)


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard {shard}", weight, shard)


def _declared(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.load() for c in children), children=tuple(children))


def build_tree(shards: int = SHARDS, rack: int = RACK, region: int = REGION) -> Node:
    """Shards in order, ``rack`` to a rack and ``region`` racks to a region, each declaring the sum of its weights; the last of each may be part full."""
    leaves = [leaf(s) for s in range(shards)]
    racks = [_declared(f"rack {k}", leaves[at : at + rack]) for k, at in enumerate(range(0, shards, rack))]
    return Node("root", children=tuple(_declared(f"region {r}", racks[at : at + region]) for r, at in enumerate(range(0, len(racks), region))))


def grown(tree: Node) -> Node:
    """With one more shard, in a rack and a region of its own: no old shard takes documents."""
    shard = 1 + max(tree.shards(), default=-1)
    racks = sum(len(r.children) for r in tree.children)
    alone = _declared(f"region {len(tree.children)}", [_declared(f"rack {racks}", [leaf(shard)])])
    return replace(tree, children=(*tree.children, alone))


def reweighted(tree: Node, shard: int, weight: float, declare: bool = False) -> Node:
    """With another weight of one shard. Its rack and region keep the weights that they declare, unless they are to declare the new sums."""

    def below(node: Node) -> Node:
        if node.shard is not None:
            return replace(node, weight=weight) if node.shard == shard else node
        if shard not in node.shards():
            return node
        children = tuple(below(c) for c in node.children)
        return replace(node, children=children, weight=sum(c.load() for c in children) if declare and node.weight is not None else node.weight)

    return below(tree)


def hold_rack(tree: Node, region: int, rack: int, children: tuple[Node, ...] | None = None) -> Node:
    """With one rack, and the region over it, held at their present weights, and with other shards in that rack if they are given."""
    regions = [*tree.children]
    racks = [*regions[region].children]
    racks[rack] = replace(racks[rack], weight=racks[rack].load(), children=children or racks[rack].children)
    regions[region] = replace(regions[region], weight=regions[region].load(), children=tuple(racks))
    return replace(tree, children=tuple(regions))


_LEAF = "name:string,weight:double,shard:int"
_TREE = f"array<struct<name:string,weight:double,below:array<struct<name:string,weight:double,below:array<struct<{_LEAF}>>>>>>"


def _written(node: Node) -> dict:
    own = {"name": node.name, "weight": node.load()}
    return own | ({"shard": node.shard} if node.shard is not None else {"below": [_written(c) for c in node.children]})


def _winner(key: Column, children: Column) -> Column:
    """The child with the least draw; the earlier one on a tie. Children of no weight are never drawn."""

    def draw(child: Column, place: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(child["name"], key), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.when(child["weight"] > 0, F.struct((-F.log(uniform) / child["weight"]).alias("draw"), place.alias("place")))

    return F.get(children, F.array_min(F.transform(children, draw))["place"])


def shard_of(docs: DataFrame, tree: Node, out: str, key: str = "doc_id") -> DataFrame:
    """docs with the shard as column ``out``; a map-side expression, over a constant that holds the tree."""
    if not tree.shards():
        return docs.withColumn(out, F.lit(None).cast("int"))
    id_ = F.col(key)
    regions = F.from_json(F.lit(json.dumps([_written(c) for c in tree.children])), _TREE)
    return docs.withColumn(out, _winner(id_, _winner(id_, _winner(id_, regions)["below"])["below"])["shard"])


def with_slots(rows: DataFrame, buckets: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows: doc_id, size, text_crc32, rid, shard and more, on which two readings agree. Adds slot."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"), F.lit(buckets)))
    # a bucket much over its share holds repeated rows, which any number tells apart
    parts = dealt.groupBy("shard", "bucket").count().select(
        F.col("shard").alias("s_shard"), F.col("bucket").alias("s_bucket"), F.ceil(F.col("count") / (4 * bucket_rows)).alias("parts")
    )
    parts = staged(parts, "slot-parts")
    here = (F.col("shard") == F.col("s_shard")) & (F.col("bucket") == F.col("s_bucket"))
    split = staged(dealt.join(parts, here).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("s_shard", "s_bucket", "parts"), "slots")
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("shard", "bucket", "part").count().select(
        F.col("shard").alias("s_shard"), F.col("bucket").alias("s_bucket"), F.col("part").alias("s_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "bucket", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        split.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, here & (F.col("part") == F.col("s_part")))
        .withColumn("slot", F.col("start") + F.col("place"))
    )


def sharded(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = staged(shard_of(shard_of(rows, build_tree(shards), "shard"), grown(build_tree(shards)), "grown_shard"), "shards")
    buckets = 1 + rows.count() // (shards * bucket_rows)
    return with_slots(rows, max(16, buckets), bucket_rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents"))
