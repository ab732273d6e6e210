"""Connected components by label exchange over shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.lineage import cut

#: Nodes of a key that one task joins; a key with more is split over as many salts as it takes.
NODES_PER_SALT = 1_000_000


def components_by_keys(members: DataFrame, node: str, key: str, out: str = "component") -> DataFrame:
    """(node, out): nodes that share a key, also through others, have the least node of all as ``out``.

    ``members`` has one row per node and key; a null key joins nothing, a null node is no node; a node
    without a shared key is its own component. Repeated rows count once. No pairs are made: each round
    takes the least label per key and per node (both with partial aggregation, so that a key or node
    with a third of all rows is merged before it is shuffled), then follows labels of labels, which
    halves the distance still to go. The label of a key goes back to its nodes by a join on key and salt,
    so a hot key is no hot task. Each round is cut, so a lost executor costs one round at most.
    """
    rows = members.select(F.col(node).alias("n"), F.col(key).alias("k")).where(F.col("n").isNotNull()).distinct()
    nodes = rows.select("n").distinct()
    shared = rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", F.ceil(F.col("c") / NODES_PER_SALT).cast("int").alias("salts"))
    links = cut(rows.join(shared, "k").withColumn("s", F.pmod(F.xxhash64("n"), F.col("salts")).cast("int")))
    labels = cut(links.groupBy("n").agg(F.min("k").alias("_")).select("n", F.col("n").alias("l")))
    while True:
        least = links.join(labels, "n").groupBy("k", "salts").agg(F.min("l").alias("m"))
        salted = least.select("k", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
        near = links.join(salted, ["k", "s"]).groupBy("n").agg(F.min("m").alias("l"))
        # the label's own label: labels are nodes, so one join on a unique key
        jump = near.select(F.col("n").alias("l"), F.col("l").alias("ll"))
        new = cut(near.join(jump, "l").select("n", F.least("l", "ll").alias("l")))
        changed = new.join(labels.select("n", F.col("l").alias("o")), "n").where("l <> o").limit(1).count()
        labels = new
        if not changed:
            break
    return nodes.join(labels, "n", "left").select(F.col("n").alias(node), F.coalesce("l", "n").alias(out))
