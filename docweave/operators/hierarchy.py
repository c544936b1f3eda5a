"""Parent-child rows to full hierarchies by tree contraction.

Contraction alternates two steps until nothing changes. Rake: nodes without active children leave.
Compress: of every unary chain an independent set of nodes leaves, each node's only child being
linked to its parent. A round's removals are written down as records. A tree contracts to its root.
A cycle contracts to one node that is its own parent and cannot leave; those are the cycles. Then
the records are read backwards: each node takes root, depth and path from the node it was removed
onto, and membership of a cycle from the child it stood above.

Every round is a fixed number of joins and aggregations, and removes all leaves and about a third of
all chain nodes, so the number of rounds grows with the logarithm of the rows, for deep chains too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import Scratch

RAKED, COMPRESSED, ACTIVE = "raked", "compressed", "active"


def _rank(c: str | Column, turn: int) -> Column:
    """A random order of nodes that changes with every round."""
    return F.xxhash64(F.lit(turn), c)


def _round(active: DataFrame, turn: int) -> DataFrame:
    """active (id, parent, hops, seg) with the step that each node takes, and what it is removed onto.

    hops and seg tell of the edge to the parent: its length, and the nodes from below the parent down to
    this node. Roots have no parent; a node that is its own parent is a contracted cycle.
    """
    loose = active.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("id")))
    below = loose.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("__n"), F.min("id").alias("__child"))
    nodes = active.join(below, "id", "left")
    own_loop = F.coalesce(F.col("parent") == F.col("id"), F.lit(False))
    mine = _rank("id", turn)
    leaf = F.col("parent").isNotNull() & ~own_loop & F.col("__n").isNull()
    chain = F.col("parent").isNotNull() & ~own_loop & (F.col("__n") == 1)
    # a node leaves a chain if its rank is above its parent's and its child's: never two neighbours at once
    local_top = (mine > _rank("parent", turn)) & (mine > _rank("__child", turn))
    two_cycle = F.col("parent") == F.col("__child")  # of two nodes in a circle the one of higher rank leaves
    leaves = chain & F.when(two_cycle, mine > _rank("parent", turn)).otherwise(local_top)
    step = F.when(leaf, RAKED).when(leaves, COMPRESSED).otherwise(ACTIVE)
    nodes = nodes.withColumn("__step", step)
    spliced = nodes.where(F.col("__step") == COMPRESSED).select(
        F.col("id").alias("__via"), F.col("parent").alias("__up"), F.col("hops").alias("__hops"), F.col("seg").alias("__seg")
    )
    moved = nodes.join(spliced, nodes["parent"] == spliced["__via"], "left")
    via = F.col("__via").isNotNull() & (F.col("__step") != COMPRESSED)
    return moved.select(
        "id",
        F.when(via, F.col("__up")).otherwise(F.col("parent")).alias("parent"),
        (F.col("hops") + F.when(via, F.col("__hops")).otherwise(F.lit(0))).alias("hops"),
        F.when(via, F.concat("__seg", "seg")).otherwise(F.col("seg")).alias("seg"),
        F.col("__child").alias("child"),
        F.col("__step").alias("step"),
    )


def contract(edges: DataFrame, scratch: Scratch, with_paths: bool) -> tuple[DataFrame, int]:
    """Runs the rounds; the core that is left (roots, and one node for each cycle), and the number of rounds.

    The records of round r are in scratch's table r<r>, in its parts step=raked and step=compressed.
    edges: (id, parent), ids unique and not null, each parent null or an id.
    """
    seg = F.array("id") if with_paths else F.array().cast("array<string>")
    active = edges.select("id", "parent", F.lit(1).alias("hops"), seg.alias("seg"))
    turn = 0
    while True:
        done = scratch.write(f"r{turn}", _round(active, turn), ["step"])
        active = done.where(F.col("step") == ACTIVE).select("id", "parent", "hops", "seg")
        if not any(scratch.has(f"r{turn}", f"step={step}") for step in (RAKED, COMPRESSED)):
            return active, turn
        turn += 1


def _linked(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent): one row an id; parents that are no id count as none."""
    links = nodes.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"))
    links = links.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    known = links.select(F.col("id").alias("__known"))
    return links.join(known, links["parent"] == known["__known"], "left").select("id", F.col("__known").alias("parent"))


def cycle_members(nodes: DataFrame, id_col: str, parent_col: str, scratch: Scratch | None = None) -> DataFrame:
    """(cycle_id, id): every node on a circle of parent links, a node that is its own parent too.

    cycle_id is the smallest id on the circle. Nodes that only hang below a circle do not come out.
    Null ids are left out, null and dangling parents end a path, an id with several rows takes its smallest
    parent (choose one row an id before, if another rule holds); an empty table has no cycles.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "cycles")
    core, rounds = contract(scratch.write("edges", _linked(nodes, id_col, parent_col)), scratch, with_paths=False)
    found = scratch.write("c", core.where(F.col("parent") == F.col("id")).select(F.col("id").alias("loop"), "id"))
    if found.isEmpty():
        return found.select(F.col("loop").alias("cycle_id"), "id")
    # backwards: a node left a chain from above its only child; it is on a circle if that child is
    for turn in range(rounds - 1, -1, -1):
        if not scratch.has(f"r{turn}", f"step={COMPRESSED}"):
            continue
        records = nodes.sparkSession.read.parquet(scratch.path(f"r{turn}")).where(F.col("step") == COMPRESSED).select(F.col("id").alias("__id"), "child")
        more = records.join(found, records["child"] == found["id"]).select("loop", F.col("__id").alias("id"))
        found = scratch.write(f"c{turn}", found.unionByName(more))
    names = found.groupBy("loop").agg(F.min("id").alias("cycle_id"))
    return found.join(names, "loop").select("cycle_id", "id")


def hierarchy(nodes: DataFrame, id_col: str, parent_col: str, scratch: Scratch | None = None) -> DataFrame:
    """(id, root, depth, path): one row a node of a tree; path is the array of ids from the root down to the node.

    A root has depth 0. Nodes on or below a circle have root, depth and path null. Nulls, dangling parents and
    repeated ids as in cycle_members; an empty table gives no row. Paths are as long as the trees are deep, which
    is the size of this result by its nature.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "hierarchy")
    core, rounds = contract(scratch.write("edges", _linked(nodes, id_col, parent_col)), scratch, with_paths=True)
    root = F.col("parent").isNull()
    solved = scratch.write(
        "t",
        core.select("id", F.when(root, F.col("id")).alias("root"), F.when(root, F.lit(0)).alias("depth"), F.when(root, F.array("id")).alias("path")),
    )
    spark = nodes.sparkSession
    for turn in range(rounds - 1, -1, -1):
        # what a round removed hangs on nodes that stayed: no two neighbours leave a chain at once, and a leaf is linked past its parent
        gone = spark.read.parquet(scratch.path(f"r{turn}")).where(F.col("step") != ACTIVE).select(F.col("id").alias("__id"), F.col("parent").alias("__onto"), "hops", "seg")
        onto = solved.select(F.col("id").alias("__at"), "root", "depth", "path")
        more = gone.join(onto, gone["__onto"] == onto["__at"], "left").select(
            F.col("__id").alias("id"), "root", (F.col("depth") + F.col("hops")).alias("depth"), F.concat("path", "seg").alias("path")
        )
        solved = scratch.write(f"t{turn}", more).unionByName(solved)
    return solved


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) from hierarchy(): every node with each node above it, itself excluded."""
    steps = tree.where(F.col("path").isNotNull()).select(F.posexplode("path").alias("__i", "ancestor"), F.col("id").alias("descendant"), "depth")
    return steps.where(F.col("__i") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("__i")).alias("distance"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    """(id, descendants): the number of nodes below each node of a tree; leaves have 0."""
    # counted before they are shuffled: of each task's nodes the ancestors
    steps = tree.where(F.col("path").isNotNull()).select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("id"))
    below = steps.groupBy("id").agg(F.count("*").alias("descendants"))
    return tree.where(F.col("path").isNotNull()).select("id").join(below, "id", "left").select("id", F.coalesce("descendants", F.lit(0).cast("bigint")).alias("descendants"))
