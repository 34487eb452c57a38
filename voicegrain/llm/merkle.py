"""Merkle manifest of a dataset: a digest tree for each source, one root, a proof for each row (operator 11).

Leaves are ordered over the cluster by a range exchange and numbered by the counts of
the partitions before.  Every partition then climbs its stretch of the numbers like a
mountain range: each level keeps the nodes of its open run on a stack, and a run of
``FANOUT`` that ends carries its digest to the level above.  Runs that lie wholly in
one partition are complete there; what is left at both edges, a bounded number of
nodes a partition and level, meets in a grouping by run, level by level.  The last run
of a level is shorter, nothing is padded.  The digests of the trees are the leaves of
one more tree, built by the same steps.

Proofs go down again: a node's path is its parent's run and the parent's path, so each
level is one join of a node with its parent, and the leaves of a run share one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
_HEX = 64
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NODE = "tree string, total long, level int, index long, hash string, run string, state string"


def digest(*values: Column) -> Column:
    """SHA-256 (hex) of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _numbered(leaves: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``leaves`` with ``index``, the place in the tree by ``order``, ``total``, the leaves of the tree, and ``part``, the partition.

    Equal leaves of one place in the order are dealt by where they were read, so a
    value that fills a third of the table does not fall to one task.
    """
    spread = leaves.withColumn("_spread", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange("tree", *order, "_spread").sortWithinPartitions("tree", *order, "_spread").drop("_spread")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("part", F.shiftright("_at", 33))
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by_tree = Window.partitionBy("tree")  # a row a partition at most
    before = F.coalesce(F.sum("_n").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", "_first", before.alias("_before"), F.sum("_n").over(by_tree).alias("total"))
    return dealt.join(counts, ["tree", "part"]).withColumn("index", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before")


class _Range:
    """The open runs of one stretch of a tree's leaves, one stack a level."""

    def __init__(self, tree: str, total: int, fanout: int):
        self.tree, self.fanout, self.done = tree, fanout, []
        self.width = [total]
        while self.width[-1] > 1:
            self.width.append(-(-self.width[-1] // fanout))
        self.open: list[list] = [[] for _ in self.width]

    def push(self, index: int, hash_: str) -> None:
        level, run = 0, None
        while True:
            stack, last = self.open[level], self.width[level] - 1
            stack.append((index, hash_, run))
            if last == 0:
                return self.close(level, "top")
            if index % self.fanout != self.fanout - 1 and index != last:
                return None
            if stack[0][0] % self.fanout:  # the run began in a partition before
                return self.close(level, "loose")
            run = "".join(x[1] for x in stack)
            self.close(level, "inner")
            level, index, hash_ = level + 1, index // self.fanout, _sha(run)

    def close(self, level: int, state: str) -> None:
        if level or state != "inner":  # complete leaves are known as they are
            self.done += [(self.tree, self.width[0], level, i, h, run, state) for i, h, run in self.open[level]]
        self.open[level] = []

    def end(self) -> list[tuple]:
        for level in range(len(self.open)):
            self.close(level, "loose")
        return self.done


def _climb(fanout: int):
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [field.split()[0] for field in _NODE.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    def run(batches):
        now, stretch = None, None
        for b in batches:
            for tree, part, total, index, leaf in zip(*[c.to_pylist() for c in b.columns]):
                if now != (tree, part):
                    if stretch is not None:
                        yield batch(stretch.end())
                    now, stretch = (tree, part), _Range(tree, total, fanout)
                stretch.push(index, leaf)
            if stretch is not None:
                yield batch(stretch.done)
                stretch.done = []
        if stretch is not None:
            yield batch(stretch.end())

    return run


def _widths(total: int, fanout: int) -> int:
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


def forest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All nodes above the numbered ``leaves (tree, part, total, index, leaf)``: ``(tree, total, level, index, hash, run, state)``.

    run: the digests of the node's members, joined.  state is ``top`` for the node
    that remains of a tree (a lone leaf itself, at level 0, without a run).
    """
    dealt = leaves.select("tree", "part", "total", "index", "leaf").repartition("tree", "part").sortWithinPartitions("tree", "part", "index")
    climbed = written(dealt.mapInArrow(_climb(fanout), _NODE), "nodes")
    loose = climbed.where("state = 'loose'")
    levels = _widths(loose.agg(F.max("total")).first()[0] or 0, fanout)
    met: list[DataFrame] = []
    for level in range(levels):
        members = loose.where(F.col("level") == level).select("tree", "total", "index", "hash")
        if met:
            members = members.union(met[-1].where("state = 'inner'").select("tree", "total", "index", "hash"))
        runs = members.groupBy("tree", "total", F.floor(F.col("index") / fanout).alias("index")).agg(F.sort_array(F.collect_list(F.struct("index", "hash"))).alias("m"))
        run = F.array_join(F.transform("m", lambda x: x["hash"]), "")
        state = F.when(F.col("total") <= fanout ** (level + 1), "top").otherwise("inner")
        met.append(written(runs.select("tree", "total", F.lit(level + 1).alias("level"), "index", F.sha2(run, 256).alias("hash"), run.alias("run"), state.alias("state")), "met"))
    nodes = climbed.where("level > 0 or state = 'top'").withColumn("state", F.regexp_replace("state", "loose", "inner"))
    for more in met:
        nodes = nodes.union(more)
    return nodes


def _paths(nodes: DataFrame, levels: int, above: DataFrame, fanout: int) -> DataFrame:
    """``(tree, index, run, path)`` of the nodes at level 1: their run, and ``(at, run)`` for each run above, up to what ``above (tree, path)`` says of the tops."""
    tops = nodes.where("state = 'top'").join(above, "tree")
    lower = None
    for level in range(levels, 0, -1):
        here = tops.where(F.col("level") == level).select("tree", "index", "run", "path")
        if lower is not None:
            parent = lower.select("tree", F.col("index").alias("_up"), F.col("run").alias("_run"), "path")
            child = nodes.where((F.col("level") == level) & (F.col("state") == "inner")).withColumn("_up", F.floor(F.col("index") / fanout))
            step = F.struct(F.pmod("index", F.lit(fanout)).cast("int").alias("at"), F.col("_run").alias("run"))
            here = here.union(child.join(parent, ["tree", "_up"]).select("tree", "index", "run", F.concat(F.array(step), "path").alias("path")))
        lower = here
    lone = tops.where("level = 0").select("tree", "index", "run", "path")
    return lone if lower is None else lower.union(lone)


def _levels(nodes: DataFrame) -> int:
    return nodes.agg(F.max("level")).first()[0] or 0


def _fold(fanout: int):
    """Proof and refolded root of each leaf of a run: ``(_id, leaf, subroot, root, proof_sha256, folded_root, verified)``."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for members, run_, path, subroot, root in zip(*[c.to_pylist() for c in b.columns]):
                path = [(_HEX * x["at"], x["run"]) for x in path]
                rest = "".join(r[:at] + r[at + _HEX :] for at, r in path)
                for member in members:
                    at, folded = _HEX * (member["index"] % fanout), member["changed"] or member["leaf"]
                    own = [(at, run_)] if run_ else []
                    proof = _sha("".join(r[:a] + r[a + _HEX :] for a, r in own) + rest)
                    for a, r in own + path:
                        folded = _sha(r[:a] + folded + r[a + _HEX :])
                    for col, value in zip(out, (member["id"], member["leaf"], subroot, root, proof, folded, folded == root)):
                        col.append(value)
            types = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    leaf is the digest of doc_id, source, lang, n_chars and text; subroot that of the
    source's tree, its leaves by ascending doc_id (null ids first, then by leaf);
    root that of all sources' trees (null source first, then by UTF-8 bytes).
    proof_sha256 is the digest of the leaf's siblings, level by level up to the root;
    folded_root is recomputed from them and the row as it is found: where 5 divides
    the CRC-32 of the decimal doc_id the found text is lower-cased in A-Z, to show
    that a changed row fails.  Null values count as ``-``; a null id is never
    changed.  Repeated rows are leaves each; equal leaves stand side by side, so
    their places may be exchanged without a difference.  A very long text is hashed
    where it is read and goes no further.  An empty table gives no rows; further
    columns are not read.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", _CAPITALS, _CAPITALS.lower())
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    leaves = docs.select(
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source"))).alias("tree"),
        F.col("doc_id").cast("long").alias("id"),
        digest(*fields, F.col("text")).alias("leaf"),
        F.when(changed, digest(*fields, low)).alias("changed"),
    )
    leaves = written(_numbered(leaves, ["id", "leaf"], "leaves"), "numbered")
    nodes = written(forest(leaves, fanout), "forest")

    tops = nodes.where("state = 'top'").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("leaf"))
    tops = written(_numbered(tops, ["name"], "tops"), "tops")
    crown = written(forest(tops, fanout), "crown")
    none = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast("array<struct<at:int,run:string>>").alias("path"))
    paths = _paths(crown, _levels(crown), none, fanout)
    root = crown.where("state = 'top'").first()
    at = F.struct(F.pmod("index", F.lit(fanout)).cast("int").alias("at"), F.col("run").alias("run"))
    named = tops.select("name", "index", F.floor(F.col("index") / fanout).alias("_up"), F.col("leaf").alias("subroot"))
    own = F.when(F.col("run").isNull(), F.col("path")).otherwise(F.concat(F.array(at), "path"))
    above = named.join(paths.select(F.col("index").alias("_up"), "run", "path"), "_up").select(F.col("name").alias("tree"), own.alias("path"), "subroot")
    above = written(above, "above")

    low_paths = _paths(nodes, _levels(nodes), above.select("tree", "path"), fanout)
    runs = leaves.groupBy("tree", F.floor(F.col("index") / fanout).alias("index")).agg(F.sort_array(F.collect_list(F.struct("index", "id", "leaf", "changed"))).alias("members"))
    proofs = runs.join(low_paths, ["tree", "index"]).join(above.select("tree", "subroot"), "tree")
    proofs = proofs.select("members", "run", "path", "subroot", F.lit(root.hash if root else "").alias("root"))
    return proofs.mapInArrow(_fold(fanout), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
