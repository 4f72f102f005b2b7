"""Merkle manifest of a dataset: one tree of digests a group of rows, and one tree over the groups' roots.

Rows become leaves in the JVM; only their digests travel from there on. Leaves get their places by a range partitioning and
counts of its parts, with the row's number as the last key, so that neither a large group nor a row that repeats a million
times lies in one task. The tree is climbed in supersteps: children message their parents, at most `fanout` messages each,
and a parent that has all of them hashes them and is a node of the next superstep. Reverse supersteps send every node's
siblings down, until each leaf's run has the whole path to the root. Every level is written to the shared folder, which
cuts the lineage and keeps what lost executors had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.llm.common import Scratch, partitions

NODE = "tree long, at long, n long, digest binary, kids array<binary>"
SEED = "tree long, height int, digest binary, path array<struct<place int, others array<binary>>>"
#: Stands for the parent of a leaf that is its group's root.
ALONE = -1


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def hashed(digests: Iterable[bytes]) -> bytes:
    """SHA-256 over the digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def placed(rows: DataFrame, by: list[Column], scratch: Scratch) -> DataFrame:
    """Written `rows` (group, id, ...) with tree, at and n: the group's place among the groups (null first), the row's place in it by `by`, its size."""
    order = [F.col("group").asc_nulls_first(), *by, F.col("id")]
    sort = rows.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    parts = scratch.save(sort.withColumn("part", F.shiftright("row", 33)), "ranges")
    counts = scratch.save(parts.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")), "counts")
    # one row a group and part it reaches into: as few as groups and parts together
    starts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n"))
    groups = scratch.save(counts.groupBy(F.col("group").alias("g")).agg(F.sum("n").alias("total"), F.min("part").alias("at_part")), "groups")
    earlier = groups.groupBy(F.col("at_part").alias("p")).agg(F.count("*").alias("k")).withColumn("earlier", F.sum("k").over(Window.orderBy("p")) - F.col("k"))
    trees = groups.join(earlier, F.col("at_part") == F.col("p")).withColumn("tree", F.col("earlier") + F.row_number().over(Window.partitionBy("at_part").orderBy(F.col("g").asc_nulls_first())) - 1)
    starts = scratch.save(starts.join(trees, F.col("group").eqNullSafe(F.col("g"))).select("tree", "g", F.col("part").alias("p"), F.col("total").alias("n"), (F.col("before") - F.col("first")).alias("shift")), "starts")
    out = parts.join(starts, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    return scratch.save(out.withColumn("at", F.col("row") + F.col("shift")).drop("p", "g", "shift", "part", "row", "group", "id"), "places")


def tasks(scratch: Scratch, rows: int) -> int:
    """Tasks of a superstep over so many rows."""
    return max(1, min(partitions(scratch.spark), rows // 10_000 + 1))


def climbed(nodes: DataFrame, count: int, widest: int, fanout: int, scratch: Scratch) -> list[DataFrame]:
    """The levels above written `nodes` (tree, at, n, digest), each written; the widest tree has `widest` of the `count` nodes."""

    def complete(item: tuple) -> tuple:
        (tree, at), messages = item
        messages = sorted(messages)
        n = messages[0][1]
        if [m[0] for m in messages] != list(range(min(fanout, n - fanout * at))):
            raise ValueError(f"node {at} of tree {tree} lacks children")
        kids = [m[2] for m in messages]
        return tree, at, -(-n // fanout), hashed(kids), kids

    levels = []
    while widest > 1:
        up = nodes.where("n > 1").select("tree", "at", "n", "digest").rdd.map(lambda v: ((v[0], v[1] // fanout), (v[1] % fanout, v[2], bytes(v[3]))))
        done = up.groupByKey(tasks(scratch, count)).map(complete)
        nodes = scratch.save(scratch.spark.createDataFrame(done, NODE, verifySchema=False), "level")
        levels.append(nodes)
        widest, count = -(-widest // fanout), -(-count // fanout)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, height, digest) of the trees' roots."""
    found = [x.where("n = 1").select("tree", F.lit(h).alias("height"), "digest") for h, x in enumerate([leaves, *levels])]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def step(kids: list, k: int) -> tuple[int, tuple]:
    """The place of a child in its run and its siblings."""
    return k, tuple(x for j, x in enumerate(kids) if j != k)


def lowest_runs(levels: list[DataFrame], seeds: DataFrame, count: int, fanout: int, scratch: Scratch) -> RDD:
    """((tree, at), (children, (root, path))) of the nodes just above the leaves; `count` is the number of leaves.

    seeds: a path for the root of each tree, with its height. A node is met by its path and messages each child the child's siblings and
    that path. A path has a step for each level up to the top: the place in the run and the siblings.
    """

    def at_height(h: int) -> RDD:
        return seeds.where(F.col("height") == h).rdd.map(lambda s: ((s[0], 0), (bytes(s[2]), tuple((x[0], tuple(map(bytes, x[1]))) for x in s[3]))))

    paths = at_height(len(levels))
    for h in range(len(levels), 0, -1):
        runs = levels[h - 1].select("tree", "at", "kids").rdd.map(lambda v: ((v[0], v[1]), [bytes(x) for x in v[2]]))
        met = runs.join(paths, tasks(scratch, count // fanout**h))
        if h > 1:
            down = met.flatMap(lambda x: [((x[0][0], x[0][1] * fanout + k), (x[1][1][0], (step(x[1][0], k), *x[1][1][1]))) for k in range(len(x[1][0]))])
            paths = down.union(at_height(h - 1))
    alone = at_height(0).map(lambda s: ((s[0][0], ALONE), ([], s[1])))
    return met.union(alone) if levels else alone


def folded(digest: bytes, path: Iterable[tuple[int, tuple]]) -> bytes:
    """The root that a node's digest and its path give."""
    for k, others in path:
        digest = hashed((*others[:k], digest, *others[k:]))
    return digest


def verified(rows: DataFrame, group: str, order: str, leaf: Column, claim: Column, fanout: int = 8, with_path: bool = False) -> DataFrame:
    """Builds the manifest of `rows` and checks a claimed leaf of each against it.

    Returns for each row: key (its <order>), leaf, subroot (its group's), root, proof (SHA-256 over the siblings' digests as hex text,
    from the leaf's run up to the root, left to right), folded_root (from claim and path), verified (folded_root is root) and, if
    asked for, path: place and siblings of each level from the leaf on. All digests are binary.

    leaf and claim are digests over columns of rows, see digest_of(); a null claim stands for the leaf itself. Leaves stand by <order>,
    nulls first, equal ones by leaf; rows that repeat entirely are leaves each. Null is a group like others, the first one; groups
    stand by UTF-8 bytes. A group of one row has that leaf as its root, one group that group's root as the root. Other columns of
    rows are ignored, whatever their names. No rows: no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    given = rows.select(F.col(group).alias("group"), F.col(order).alias("key"), leaf.alias("digest"), claim.alias("claim"))
    # a claim that is the leaf itself isn't carried
    given = scratch.save(given.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim"))).withColumn("id", F.monotonically_increasing_id()), "leaves")
    key_type = given.schema["key"].dataType.simpleString()
    shape = f"key {key_type}, leaf binary, subroot binary, root binary, proof binary, folded_root binary, verified boolean" + (", path array<struct<place int, others array<binary>>>" if with_path else "")
    leaves = placed(given, [F.col("key").asc_nulls_first(), F.col("digest")], scratch)
    count, widest = leaves.agg(F.count("*"), F.max("n")).first()
    if not count:
        return spark.createDataFrame([], shape)
    levels = climbed(leaves, count, widest, fanout, scratch)
    roots = scratch.save(tops(leaves, levels), "tops")
    n_trees = roots.count()
    tree_leaves = scratch.save(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), "digest"), "tree-leaves")
    upper = climbed(tree_leaves, n_trees, n_trees, fanout, scratch)
    top = tops(tree_leaves, upper).withColumn("path", F.array().cast("array<struct<place int, others array<binary>>>")).select("tree", "height", "digest", "path")
    root = bytes(top.first()["digest"])
    above = lowest_runs(upper, top, n_trees, fanout, scratch)
    # the path of a tree is that of its root in the tree over the trees
    of_tree = above.flatMap(lambda x: [(x[0][1] * fanout + k, (step(x[1][0], k), *x[1][1][1])) for k in range(len(x[1][0]))] or [(0, x[1][1][1])])
    seeds = roots.rdd.map(lambda r: (r[0], (r[1], bytes(r[2])))).join(of_tree, tasks(scratch, n_trees)).map(lambda x: (x[0], x[1][0][0], x[1][0][1], x[1][1]))
    seeds = scratch.save(spark.createDataFrame(seeds, SEED, verifySchema=False), "seeds")
    runs = lowest_runs(levels, seeds, count, fanout, scratch)
    own = leaves.select("tree", "at", "n", "key", "digest", "claim").rdd.map(lambda v: ((v[0], v[1] // fanout if v[2] > 1 else ALONE), (v[1] % fanout, v[3], v[4], v[5])))

    def proven(item: tuple) -> tuple:
        (place, key, digest, claim), (kids, (subroot, path)) = item[1]
        path = (step(kids, place), *path) if kids else path
        # rows without a claim fold their own leaf: that the tree holds it is checked, not assumed
        found = folded(bytes(digest if claim is None else claim), path)
        return key, digest, subroot, root, hashed(x for _, others in path for x in others), found, found == root, *((path,) if with_path else ())

    out = own.join(runs, partitions(spark)).map(proven)
    return spark.createDataFrame(out, shape, verifySchema=False)
