"""Subtree totals of one tree by parallel contraction, as join rounds.

Every round rakes all leaves into their parents and compresses unary chains: of the nodes with one child
left, those whose priority, drawn anew each round, beats their parent's and their child's are spliced out.
No two neighbours go at once, and who goes is known from ids alone. About a third of every chain goes each
round, so a tree of n nodes, however deep, takes O(log n) rounds, each over what is left. A spliced node's
total is its child's plus what was gathered by then; these records are expanded by pointer doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.llm.common import written

ID, PARENT, ONLY = ("c", "d"), ("pc", "pd"), ("uc", "ud")


def _priority(names: tuple[str, str], turn: int) -> Column:
    return F.xxhash64(*[F.col(n) for n in names], F.lit(turn))


def _plus(values: list[str], kind: str, other: str) -> list[Column]:
    return [(F.col(f"{kind}_{v}") + F.coalesce(F.col(f"{other}_{v}"), F.lit(0).cast("long"))).alias(f"{kind}_{v}") for v in values]


def _contract(active: DataFrame, values: list[str], turn: int) -> DataFrame:
    """One round: every node's state after its leaves are raked, and whether it is spliced out.

    a_ is what a node has gathered, w_ what an edge to the parent adds; leaf: no children are left.
    """
    inner = ~F.col("leaf")
    raked = [F.sum(F.when(F.col("leaf"), F.col(f"a_{v}") + F.col(f"w_{v}")).otherwise(0)).alias(f"g_{v}") for v in values]
    left = F.min(F.when(inner, F.struct(*ID, *[f"w_{v}" for v in values]))).alias("only")
    up = active.where("pc IS NOT NULL").groupBy(*PARENT).agg(*raked, F.sum(inner.cast("long")).alias("rest"), left)
    met = active.where(inner).join(up.withColumnsRenamed(dict(zip(PARENT, ID, strict=True))), list(ID))
    u = [F.when(F.col("rest") == 1, F.col(f"only.{n}")).alias(o) for n, o in zip(ID, ONLY, strict=True)]
    seen = met.select(*ID, *PARENT, *[f"w_{v}" for v in values], *_plus(values, "a", "g"), (F.col("rest") == 0).alias("leaf"), *u, *[F.col(f"only.w_{v}").alias(f"o_{v}") for v in values])
    first = (_priority(ID, turn) > _priority(PARENT, turn)) & (_priority(ID, turn) > _priority(ONLY, turn))
    return seen.withColumn("spliced", F.coalesce(F.col("pc").isNotNull() & F.col("uc").isNotNull() & first, F.lit(False)))


def _next(step: DataFrame, values: list[str]) -> DataFrame:
    """What is left after a round: children of spliced nodes hang on their grandparents."""
    moved = step.where("spliced").select(*[F.col(o).alias(n) for o, n in zip(ONLY, ID, strict=True)], F.col("pc").alias("nc"), F.col("pd").alias("nd"), *[(F.col(f"a_{v}") + F.col(f"w_{v}")).alias(f"m_{v}") for v in values])
    kept = step.where("NOT spliced").join(moved, list(ID), "left")
    parents = [F.when(F.col("nc").isNotNull(), F.col(n)).otherwise(F.col(p)).alias(p) for n, p in zip(("nc", "nd"), PARENT, strict=True)]
    return kept.select(*ID, *parents, *_plus(values, "w", "m"), *[f"a_{v}" for v in values], "leaf")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, values): sums over the subtree of each node, its top included.

    nodes: c, d (two longs that name a node), pc, pd (its parent; null: the root, of which there is one at
    most), leaf (whether it has no children), and the values (long). Read twice; it should be a table.
    """
    zero = F.lit(0).cast("long")
    start = nodes.select(*ID, *PARENT, *[zero.alias(f"w_{v}") for v in values], *[F.col(v).alias(f"a_{v}") for v in values], "leaf")
    done = [start.where("leaf")]
    spliced = []
    active, turn = start, 0
    left = start.where("NOT leaf").count()
    while left:
        turn += 1
        step = written(_contract(active, values, turn), "contract")
        done.append(step.where("leaf"))
        spliced.append(step.where("spliced"))
        left = step.where("NOT leaf AND NOT spliced").count()
        # Leaves of this round are in step; those of earlier rounds are raked.
        active = _next(step, values)
    known = reduce(DataFrame.unionAll, [d.select(*ID, *[F.col(f"a_{v}").alias(v) for v in values]) for d in done])
    if not spliced:
        return known
    known = written(known, "contract-known")
    links = reduce(DataFrame.unionAll, [s.select(*ID, *ONLY, *[(F.col(f"a_{v}") + F.col(f"o_{v}")).alias(v) for v in values]) for s in spliced])
    links = written(links, "contract-links")
    there = [c for c in links.columns if c not in ONLY]
    for _ in range(max(0, turn - 1).bit_length()):  # a record's child was spliced in a later round, if at all
        after = links.select(F.col("c").alias("uc"), F.col("d").alias("ud"), F.col("uc").alias("vc"), F.col("ud").alias("vd"), *[F.col(v).alias(f"n_{v}") for v in values])
        sums = [(F.col(v) + F.coalesce(f"n_{v}", zero)).alias(v) for v in values]
        links = written(links.join(after, list(ONLY), "left").select(*ID, F.coalesce("vc", "uc").alias("uc"), F.when(F.col("vc").isNotNull(), F.col("vd")).otherwise(F.col("ud")).alias("ud"), *sums), "contract-links")
    ends = known.select(F.col("c").alias("uc"), F.col("d").alias("ud"), *[F.col(v).alias(f"n_{v}") for v in values])
    expanded = links.join(ends, list(ONLY)).select(*[(F.col(v) + F.col(f"n_{v}")).alias(v) if v in values else F.col(v) for v in there])
    return known.unionByName(expanded)
