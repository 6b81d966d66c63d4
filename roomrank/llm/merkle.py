"""11. Merkle manifest of a table: a tree of sha256 digests, and each row's proof, by cogrouped subtree exchange.

Every row is a leaf: the digest of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value.
The leaves of a source, in order of their ids, are joined in runs of ARITY, level by level, until one digest
remains (the subroot, a lone leaf itself); the subroots, in order of the sources, likewise give the root.

Work goes by superblocks of ARITY ** HEIGHT consecutive nodes, so a source of any size is dealt to many tasks:
1. One pass over the texts writes the leaves (digests only; no text is shuffled or written). They are numbered
   per source by range partitions and the running sums of their counts.
2. Up: each superblock becomes one node of the tier above, until every source has one node; the subroots are
   numbered and climb the same way. A tier has 1 / ARITY ** HEIGHT of the rows of the one below.
3. Down: a superblock's nodes are cogrouped with the one row of outer nodes it needs (the siblings on the path
   from its top to the root, at most ARITY - 1 digests a level). The task redoes the small local reduction, joins
   the local siblings with the outer ones and so has the whole path of each node; these paths are the outer rows
   of the tier below. At the leaves the proof is hashed and the present leaf folded to the root in the same call.

Nothing is collected but the number of nodes of a tier's largest group. Tables between the steps lie in the
shared folder, so lost executors cost no more than their own tasks.

Null ids come first, null sources form a source of their own (first). Rows with the same id are ordered by
their leaf; rows that are equal in every field are numbered apart, which leaves every digest the same. A text is
hashed whole in the JVM, whatever its length; empty is `0:`. An empty table gives an empty result. Other columns
of the table are not read and their names don't matter.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from roomrank.llm.shared import written
from roomrank.session import ship_package

ARITY = 16
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "left array<string>, right array<string>"  # one entry a level: the digests before and after the own node


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The trial of the registered query: A-Z are lower-cased where 5 divides crc32 of the decimal id."""
    hit = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, lower_ascii(F.col(f"`{text}`")))


def levels(nodes: list[str], arity: int, height: int, whole: bool) -> list[list[str]]:
    """The levels over `nodes`: exactly `height` of them, or if the nodes are the whole group as many as leave one node."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= height:
        low = out[-1]
        out.append([digest("".join(low[i:i + arity])) for i in range(0, len(low), arity)])
    return out


def siblings(tree: list[list[str]], i: int, arity: int) -> tuple[list[str], list[str]]:
    """The digests before and after node i in its run, on each level below the top."""
    left, right = [], []
    for low in tree[:-1]:
        start = i - i % arity
        left.append("".join(low[start:i]))
        right.append("".join(low[i + 1:start + arity]))
        i //= arity
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    for before, after in zip(left, right, strict=True):
        node = digest(before + node + after)
    return node


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows plus n (from 0, in `order` within grp) and total (rows of grp), numbered by range partitions."""
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = written(tie.repartitionByRange("grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie")
                     .withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), name)
    counts = placed.groupBy("grp", "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # a row per source and partition that holds it: no more than partitions and sources together
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("grp", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
                          F.sum("_rows").over(Window.partitionBy("grp")).alias("total"))
    return placed.join(bases, ["grp", "_part"]).withColumn("n", F.col("_pos") + F.col("_base")).drop("_part", "_pos", "_base")


def climb(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """The tiers (grp, n, digest, total) from `nodes` up to the one where each group has a single node."""
    size = arity ** height

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        total = int(pdf["total"].iloc[0])
        tree = levels(pdf["digest"].tolist(), arity, height, total <= size)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "n": [int(pdf["n"].iloc[0]) // size], "digest": [tree[-1][0]],
                             "total": [-(-total // size)]})

    tiers = [nodes.select("grp", "n", "digest", "total")]
    while (tiers[-1].agg(F.max("total")).first()[0] or 1) > 1:
        up = (tiers[-1].withColumn("block", F.floor(F.col("n") / size)).groupBy("grp", "block")
              .applyInPandas(top, "grp string, n long, digest string, total long"))
        tiers.append(written(up, "merkle-tier"))
    return tiers


def descend(tiers: list[DataFrame], outer: DataFrame, arity: int, height: int) -> DataFrame:
    """(grp, n, left, right): the whole path of each node of the lowest tier; `outer` has (grp, left, right) of the top nodes."""
    size = arity ** height

    def paths(_, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes, up = nodes.sort_values("n"), above.iloc[0]
        tree = levels(nodes["digest"].tolist(), arity, height, int(nodes["total"].iloc[0]) <= size)
        found = [siblings(tree, i, arity) for i in range(len(nodes))]
        return pd.DataFrame({"grp": nodes["grp"], "n": nodes["n"], "left": [a + list(up["left"]) for a, _ in found],
                             "right": [b + list(up["right"]) for _, b in found]})

    rows = outer.select("grp", F.lit(0).cast("long").alias("n"), "left", "right")
    for tier in reversed(tiers[:-1]):
        blocks = tier.withColumn("block", F.floor(F.col("n") / size)).groupBy("grp", "block")
        above = rows.withColumnRenamed("n", "block").groupBy("grp", "block")
        rows = written(blocks.cogroup(above).applyInPandas(paths, "grp string, n long, " + PATH), "merkle-paths")
    return rows


def manifest(docs: DataFrame, present: Column | None = None, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id",
             source: str = "source", changing: str = "text", arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is built from docs as they are. `present` is what the column `changing` holds when the rows are
    verified (null: as it was); the leaf of that is folded with the original siblings and compared with the root.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    size = arity ** height
    columns = [F.col(f"`{c}`") for c in fields]
    now = F.lit(None).cast("string") if present is None else F.when(
        present.isNotNull(), leaf([present if c == changing else F.col(f"`{c}`") for c in fields]))
    # the null source sorts before every other, the empty one included
    grp = F.coalesce(F.concat(F.lit("+"), F.col(f"`{source}`").cast("string")), F.lit(""))
    leaves = written(docs.select(grp.alias("grp"), F.col(f"`{doc_id}`").alias("id"), leaf(columns).alias("digest"), now.alias("now")), "merkle-leaves")
    leaves = numbered(leaves, ["id", "digest"], "merkle-numbered")

    tiers = climb(leaves, arity, height)
    # blocks of the leaves and their subroots: the lowest tier has one row per leaf, so a second step is always there
    tops = tiers[-1].where("n = 0").select("grp", "digest")
    sources = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"], "merkle-sources")
    over = climb(sources, arity, height)
    root = over[-1].select(F.col("digest").alias("root"))
    nothing = F.expr("cast(array() as array<string>)")
    upper = descend(over, over[-1].select("grp", nothing.alias("left"), nothing.alias("right")), arity, height)
    upper = (sources.select("n", F.col("name"), F.col("digest").alias("subroot")).join(upper.drop("grp"), "n")
             .crossJoin(F.broadcast(root)).select(F.col("name").alias("grp"), "left", "right", "subroot", "root"))  # root: one row
    upper = written(upper, "merkle-upper")

    # tiers[0] are the leaves: the paths of the tier above them are the outer rows of the leaves' superblocks
    if len(tiers) > 1:
        outer = descend(tiers[1:], upper, arity, height).withColumnRenamed("n", "block").join(upper.select("grp", "subroot", "root"), "grp")
    else:
        outer = upper.withColumn("block", F.lit(0).cast("long"))

    def finish(_, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, up = rows.sort_values("n"), above.iloc[0]
        own = rows["digest"].tolist()
        tree = levels(own, arity, height, int(rows["total"].iloc[0]) <= size)
        left_up, right_up, top = list(up["left"]), list(up["right"]), up["root"]
        proof_up = "".join(a + b for a, b in zip(left_up, right_up, strict=True))
        proofs, folded = [], []
        for i, (before, current) in enumerate(zip(own, rows["now"], strict=True)):
            left, right = siblings(tree, i, arity)
            proofs.append(digest("".join(a + b for a, b in zip(left, right, strict=True)) + proof_up))
            folded.append(fold(fold(current if isinstance(current, str) else before, left, right), left_up, right_up))
        return pd.DataFrame({"id": rows["id"], "leaf": own, "subroot": up["subroot"], "root": top, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == top for f in folded]})

    blocks = leaves.select("grp", F.floor(F.col("n") / size).alias("block"), "n", "total", F.col("id").cast("string"), "digest", "now")
    out = blocks.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(
        finish, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", doc_id)
