"""Connected components of a link table, as Spark jobs with written rounds.

Defined results: links with a null end and links of a node with itself are left out, and so are nodes without another link. Repeated links count
once. An empty table gives an empty result. Only the columns a and b are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import maybe_broadcast, save, small_enough


def _flattened(tree: DataFrame) -> DataFrame:
    """node, up of a forest (node, up) in which every node points at its root; the pointers' lengths double each pass."""
    while True:
        above = maybe_broadcast(tree.select(F.col("node").alias("at"), F.col("up").alias("top")), 1_000_000)
        jumped = tree.join(above, F.col("up") == F.col("at")).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("changed"))
        jumped = save(jumped, "tree")
        tree = jumped.select("node", "up")
        if small_enough(jumped.filter("changed"), 0):
            return tree


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b).

    Union-find by hooking roots and contracting: each round, every node with a smaller neighbour hooks to its smallest one,
    the trees are flattened, and links are carried over to the roots, where those within one tree vanish. A root left
    alone by its neighbours has a smaller neighbour after the contraction, so two rounds halve the nodes of a component at
    least: the rounds are logarithmic in the nodes, whatever the numbering, and go on until no link is left. A round flattens in about
    the logarithm of its tree's depth. Each step is a written table, so lineage stays short and lost executors cost one step.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = save(both.filter("a != b").distinct(), "links")  # a null end fails the test
    rounds = []
    while not rounds or not small_enough(both, 0):
        tree = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "tree")
        rounds.append(_flattened(tree))
        roots = maybe_broadcast(rounds[-1], 1_000_000)
        left, right = (roots.select(F.col("node").alias(f"{c}_node"), F.col("up").alias(f"{c}_up")) for c in "ab")
        both = both.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))
        both = save(both.filter("a_up != b_up").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct(), "links")
    # A round's roots are the next one's nodes, unless no link is left to them.
    found = rounds.pop()
    while rounds:
        later = maybe_broadcast(found.select(F.col("node").alias("root"), F.col("up").alias("top")), 1_000_000)
        found = rounds.pop().join(later, F.col("up") == F.col("root"), "left").select("node", F.coalesce("top", "up").alias("up"))
        found = save(found, "components")
    return found.select("node", F.col("up").alias("component"))
