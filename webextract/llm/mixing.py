"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows are dealt into blocks. With w_i as a source's share of the weights, block j (from 0) of source i is released at
floor(j / w_i) and due at ceil((j + 1) / w_i); in every slot the released block with the earliest deadline runs. As the shares add up to
one, every block runs within its window, so at any slot each source is less than one block off its share, to the end of the mix: the
windows are computed in integers from the weights as they are given, without rounding. The schedule is a function of the weights and of
the sources' numbers of blocks alone. There are at most max_blocks blocks and one more a source: beyond that, blocks have more rows. So
the schedule is made once and joined as a table of a proven size.

Within a source the order is that of a hash of doc_id. Row numbers don't need a source's rows in one task: rows are numbered within
hash buckets of about bucket_rows rows, and each bucket is shifted by the rows of the source in the buckets before it.

Defined results. Every row comes out once. A null source is a source of its own. Ties (repeated doc_ids, null doc_ids) are numbered
next to each other, in the order of their size. A source without a weight gets weight zero and follows all others (slot null, balanced
false). balanced says that the slot comes before the first one for which a source has no block left; up to there the mix has the target
weights, and after it the remaining sources keep their order. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A null source's name inside the operator; others get a prefix.
NULL = "n"


def exact(weights: list[float]) -> list[int]:
    """Integers in the same proportions, exactly."""
    parts = [Fraction(w) for w in weights]
    common = math.lcm(*(p.denominator for p in parts))
    return [int(p * common) for p in parts]


def pfair_schedule(weights: list[float], blocks: list[int]) -> list[list[int]]:
    """The slots in which the blocks of each source run, by earliest deadline first. A source without weight has none."""
    parts = exact(weights)
    total = sum(parts)
    out: list[list[int]] = [[] for _ in parts]
    waiting, ready, t = [(0, i, 0) for i, a in enumerate(parts) if a and blocks[i]], [], 0
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[i]), i, j))
        _, i, j = heapq.heappop(ready)
        out[i].append(t)
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, ((j + 1) * total // parts[i], i, j + 1))
        t += 1
    return out


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, block_rows: int = 32) -> DataFrame:
    """The rows of docs, with their own columns, in the order of the mix; written to files, these follow it by name and row."""
    placed = mix_sources(docs.select("doc_id", "source", F.struct(*(docs[c] for c in docs.columns)).alias("row")), weights, temperature, block_rows, carry=("row",))
    by = [F.col("slot").asc_nulls_last(), F.col("block"), F.col("place"), F.col("source")]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).select("row.*")


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    block_rows: int = 32,
    max_blocks: int = 50_000,
    bucket_rows: int = 2_000,
    max_buckets: int = 500_000,
    max_sources: int = 10_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """docs: doc_id, source. Returns doc_id, source, block, slot, place (within the block) and balanced; (slot, place) is the order.

    weights: by source; by default each source's share of the rows to the power temperature. The names of the sources come to the
    driver: they are the keys of the mix, at most max_sources of them; more raise an error. block_rows: the rows of a block, more where
    there would be over max_blocks. Row numbers are made in buckets of bucket_rows rows, more where there would be over max_buckets.
    carry: columns that come along.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(NULL)).alias("key"), *carry)
    counted = rows.select("key").groupBy("key").count().limit(max_sources + 1).collect()
    if len(counted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    counts = {r["key"]: r["count"] for r in counted}
    total = sum(counts.values())
    block_rows = max(block_rows, -(-total // max_blocks))
    named = {k: float(n) ** temperature for k, n in counts.items()} if weights is None else {(NULL if k is None else f"s{k}"): w for k, w in weights.items()}
    order = sorted(k for k, w in named.items() if w > 0 and k in counts)
    many = [-(-counts[k] // block_rows) for k in order]
    places = dict(zip(order, pfair_schedule([named[k] for k in order], many)))
    # The first slot that would be a source's that has no block left; its next block would be released then.
    parts = exact([named[k] for k in order])
    end = min((n * sum(parts) // a for n, a in zip(many, parts)), default=0)
    at = F.explode(F.from_json(F.lit(json.dumps(places)), "map<string,array<bigint>>")).alias("key", "slots")
    schedule = spark.range(1).select(at).select("key", F.posexplode("slots").alias("block", "slot")).withColumn("block", F.col("block").cast("long"))

    buckets = min(max(1, -(-total // bucket_rows)), max_buckets)
    hashed = rows.withColumn("order", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)))
    per_bucket = hashed.select("key", "bucket").groupBy("key", "bucket").agg(F.count("*").alias("n"))
    # At most max_buckets rows for a source.
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_bucket.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id")
    numbered = (
        hashed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(shifts, ["key", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("shift"))
        .withColumn("block", F.floor(F.col("rank") / block_rows))
        .withColumn("place", F.pmod(F.col("rank"), F.lit(block_rows)))
    )
    # At most max_blocks + max_sources rows of three small columns.
    dealt = numbered.join(F.broadcast(schedule), ["key", "block"], "left")
    return dealt.select("doc_id", "source", F.col("block").cast("long").alias("block"), F.col("slot").cast("long").alias("slot"), F.col("place").cast("long").alias("place"), F.coalesce(F.col("slot") < end, F.lit(False)).alias("balanced"), *carry)
