"""Connected components, and links among the members of buckets without all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webextract.llm.common import Workspace, cut


#: Edges that one task takes to the end; more are contracted by joins first.
FEW = 500_000


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges (a, b), and the least id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            return ids, ids[root]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        ids, roots = least_roots(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])


def connected_components(edges: DataFrame, few: int = FEW, rounds: int = 100) -> DataFrame:
    """edges: (a, b), bigint. Returns (id, root) for every id in edges, root being the least id of its component.

    While there are more than `few` edges, they are contracted: in an order of the ids that is drawn anew each round, every id hooks to the
    least one among itself and its neighbours, the hooks are followed once more, and edges go to the new ids. As the order is random, long
    paths shrink by a constant share too. No such step gathers a component or an id's edges in one task: the minima are partial aggregates,
    and the joins are between written tables, so that the adaptive skew join splits a hub. At most `few` edges are finished by one task
    on an executor. All is in written tables, whose sizes Spark knows; estimates for checkpoints would multiply from join to join.
    """
    space = Workspace(edges.sparkSession)
    edges = space.save(edges.select("a", "b").where("a <> b").distinct(), "edges0")
    levels: list[DataFrame] = []
    for k in range(rounds):
        if edges.count() <= few:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(F.lit(k), c)
        least = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), "b")).alias("m"))
        once = space.save(least.select(F.col("a").alias("old"), F.when(F.col("m.h") < order("a"), F.col("m.b")).otherwise(F.col("a")).alias("new")), f"once{k}")
        hooks = space.save(once.join(once.select(F.col("old").alias("new"), F.col("new").alias("newer")).hint("merge"), "new").select("old", F.col("newer").alias("new")), f"hooks{k}")
        levels.append(hooks)
        x, y = (hooks.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new")).hint("merge") for c in "ab")
        edges = space.save(edges.join(x, "a").join(y, "b").select(F.least("a_new", "b_new").alias("a"), F.greatest("a_new", "b_new").alias("b")).where("a <> b").distinct(), f"edges{k + 1}")
        space.drop(f"edges{k}")
        space.drop(f"once{k}")
    else:
        raise RuntimeError("the components did not settle")
    last = space.save(edges.repartition(1).mapInArrow(_finish, "id bigint, root bigint"), "last")
    if not levels:
        return last
    # Every id is in the first hooks; the roots follow those of later rounds.
    labels = levels[0].select(F.col("old").alias("id"), F.col("new").alias("root"))
    for k, hooks in enumerate([*levels[1:], last.select(F.col("id").alias("old"), F.col("root").alias("new"))]):
        labels = space.save(labels.join(hooks.hint("merge"), labels["root"] == hooks["old"], "left").select("id", F.coalesce("new", "root").alias("root")), f"labels{k}")
    names = space.save(labels.groupBy("root").agg(F.min("id").alias("least")), "names")
    return space.save(labels.join(names.hint("merge"), "root").select("id", F.col("least").alias("root")), "roots")


def _pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(bucket, a, b) for members of x and of y in one bucket."""
    return x.select("bucket", F.col("id").alias("a")).join(y.select("bucket", F.col("id").alias("b")).hint("merge"), "bucket")


def collisions(members: DataFrame, space: Workspace, name: str = "collisions") -> DataFrame:
    """members: (bucket, id) and maybe more columns, every such pair once. Returns them and n, the ids of the bucket, for buckets with two or more.

    The sizes are partial aggregates, and both sides of the join come from files, so a bucket of a third of all ids is split by Spark.
    """
    dealt = space.save(members, f"{name}-members")
    sizes = space.save(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-sizes")
    met = space.save(dealt.join(sizes.hint("merge"), "bucket").select(*members.columns, "n"), name)
    space.drop(f"{name}-members")
    space.drop(f"{name}-sizes")
    return met


def small_pairs(met: DataFrame, large: int, alike: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All pairs (a < b) in buckets of up to `large` members; with alike, only those whose columns f are alike, before anything is shuffled."""
    few = met.where(F.col("n") <= large)
    if alike is None:
        return _pairs(few, few).where("a < b").select("a", "b").distinct()
    x, y = few.select("bucket", F.col("id").alias("a"), F.col("f").alias("fa")), few.select("bucket", F.col("id").alias("b"), F.col("f").alias("fb"))
    return x.join(y.hint("merge"), "bucket").where("a < b").where(alike(F.col("fa"), F.col("fb"))).select("a", "b").distinct()


def _main_roots(everyone: DataFrame) -> DataFrame:
    """everyone: (bucket, id, root). Of each bucket the root with the most members (main), and its members (n)."""
    groups = everyone.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    return groups.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("n")).select("bucket", F.col("m.root").alias("main"), "n")


def bucket_links(
    met: DataFrame,
    weights: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    large: int = 128,
    leaders: int = 3,
    work: int = 100,
    crowd: Callable[[DataFrame], DataFrame] | None = None,
    few: DataFrame | None = None,
) -> DataFrame:
    """Links (a, b) that join what all pairs within the buckets would join, if verify() keeps the pairs (a < b) that are links.

    met: (bucket, id, n) from collisions(); weights: (id, weight). Buckets of up to `large` members give all their pairs. In a larger one
    the members are held against a leader first, the heaviest one; those that link to it are together already, so only the others are held
    against the rest. Where that would still be more than `work` pairs for each member, more leaders are taken, and pairs within a
    component found so far are left out. Pairs of members of one component are never needed, so no component is lost.

    crowd: where it is given, large buckets take one leader, and what that leaves apart goes to it as (bucket, id, root), a bucket being all
    members that share large buckets, directly or through others; it gives verified links (a, b) that join all that link across roots. few:
    small_pairs() of met, where the caller has them.
    """
    found = [cut(verify(small_pairs(met, large) if few is None else few))]
    rest = met.where(F.col("n") > large).select("bucket", "id")
    if rest.isEmpty():
        return found[0]
    if crowd:
        return _with_crowds(rest, verify, crowd, found[0])
    everyone = rest = cut(rest.join(weights.hint("merge"), "id").select("bucket", "id", "weight", F.col("id").alias("root")))
    total, left = everyone.count(), 0
    for _ in range(leaders):
        heads = cut(rest.groupBy("bucket").agg(F.max(F.struct("weight", "id", "root")).alias("h")).select("bucket", F.col("h.id").alias("x"), F.col("h.root").alias("rx")))
        star = everyone.select("bucket", F.col("id").alias("y"), F.col("root").alias("ry")).join(heads.hint("merge"), "bucket").where("rx <> ry")
        star = star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found.append(cut(verify(star)))
        roots = connected_components(reduce(DataFrame.union, found))
        joined = everyone.drop("root").join(roots.hint("merge"), "id", "left")
        everyone = cut(joined.select("bucket", "id", "weight", F.coalesce("root", "id").alias("root")))
        rest = cut(everyone.join(_main_roots(everyone).hint("merge"), "bucket").where("root <> main").select("bucket", "id", "weight", "root", "n"))
        left = rest.agg(F.sum("n")).first()[0] or 0
        if left <= work * total:
            break
    if left:
        x = rest.select("bucket", F.col("id").alias("x"), F.col("root").alias("rx"))
        y = everyone.select("bucket", F.col("id").alias("y"), F.col("root").alias("ry"))
        last = x.join(y.hint("merge"), "bucket").where("rx <> ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found.append(cut(verify(last)))
    return reduce(DataFrame.union, found)


def _with_crowds(rest: DataFrame, verify: Callable[[DataFrame], DataFrame], crowd: Callable[[DataFrame], DataFrame], links: DataFrame) -> DataFrame:
    """The links of large buckets, (bucket, id), by a leader each and then by crowds; after the first join all is by id, not by bucket."""
    heads = cut(rest.groupBy("bucket").agg(F.min("id").alias("x")))
    star = rest.join(heads.hint("merge"), "bucket").where("id <> x").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
    star = cut(star.distinct())
    links = links.union(cut(verify(star)))
    groups = connected_components(star).select("id", F.col("root").alias("bucket"))
    joined = groups.join(connected_components(links).hint("merge"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    joined = cut(joined)
    apart = cut(joined.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket"))
    return links.union(cut(crowd(joined.join(apart.hint("merge"), "bucket"))))
