"""Filling containers of fixed capacity by hierarchical residual packing.

Items (a key and a size) are spread evenly over leaves by the hash of their key, so that a file or source of equal sizes
does not fill a leaf. Each leaf packs best-fit, largest first, and emits its finished bins; underfull bins travel on as
items to a tree of nodes, FAN_IN children each, where best-fit is repeated.

What may stop travelling: best-fit leaves at most one bin of a node half full or less, and two bins that are more than
half full can't be joined, so a node of FAN_IN children can fill at most FAN_IN bins of any one size. A child sends its
smallest bin and FAN_IN bins of each other size; the rest of that size is finished, as nothing that comes can need it.
So a node holds at most FAN_IN * (1 + FAN_IN * capacity) bins, at any size of the corpus, and the packing is the one that
sending all would give. An item above the capacity is cut into full pieces, which are containers by themselves, and a
rest that is packed like any item.

A container is named after its first member, and rows are ordered before they are packed, so a recomputed task gives the
same names. Items of null key, null size or no size are left out; a repeated key counts once, with its largest size;
equal sizes are ordered by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SLACK = 8  # a bin with at most this much room is nearly full
FAN_IN = 8  # nodes merged into one by a round
LEAF = 50_000  # items packed together by a leaf, about
BINS = "size int, doc_ids array<bigint>, pieces array<int>, tokens array<int>, full boolean, node int"


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, list]]:
    """(size, members) bins of (size, members) items, best fit, in the given order.

    The residuals that some bin has are the bits of one integer, so the tightest bin with room is a find-first-set.
    """
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]
    bits, done = 0, []
    for size, members in items:
        fit = bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            bin_ = open_[room].pop()
            if not open_[room]:
                bits &= ~(1 << room)
            bin_.append(members)
            room -= size
        else:
            bin_, room = [members], capacity - size
        if room:
            open_[room].append(bin_)
            bits |= 1 << room
        else:
            done.append((capacity, bin_))
    done += [(capacity - room, b) for room in range(capacity, 0, -1) for b in open_[room]]
    return done


def settle(items: list[tuple], capacity: int, slack: int, fan_in: int, last: bool) -> list[tuple]:
    """(size, members, full) of the bins that a node packs; those that are not full travel on.

    items: (size, members), members being (key, piece, tokens) triples; ordered here.
    """
    items.sort(key=lambda x: (-x[0], x[1][0]))
    out, sent = [], {}
    for size, parts in best_fit(items, capacity):
        members = [m for p in parts for m in p]
        full = last or capacity - size <= slack
        if not full and 2 * size > capacity:
            sent[size] = sent.get(size, 0) + 1
            full = sent[size] > fan_in
        out.append((size, members, full))
    return out


def _frame(bins: list[tuple], node: int) -> pd.DataFrame:
    rows = [(size, [m[0] for m in ms], [m[1] for m in ms], [m[2] for m in ms], full, node) for size, ms, full in bins]
    return pd.DataFrame(rows, columns=["size", "doc_ids", "pieces", "tokens", "full", "node"])


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, leaf: int = LEAF) -> DataFrame:
    """doc_id, piece, container, tokens: where each piece of each item goes.

    sizes: a key and a size for each item. The sizes and each round are cut by checkpoints, so a lost executor repeats
    one round. The sizes alone are shuffled, never the texts; a round moves only what its children left underfull.
    """
    from pyspark import TaskContext

    from ..session import cut

    items = sizes.select(sizes[key].cast("bigint").alias("id"), sizes[size].cast("bigint").alias("n")).where("id is not null and n > 0")
    items = cut(items)  # the texts are encoded once
    leaves = max(1, -(-items.count() // leaf))
    items = items.repartition(leaves, F.xxhash64("id"), "id").groupBy(F.xxhash64("id"), "id").agg(F.max("n").alias("n")).select("id", "n")
    whole = F.floor(F.col("n") / capacity).cast("int")
    pieces = items.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((n - 1) div {capacity} as int))")))
    pieces = pieces.select("id", "piece", F.when(F.col("piece") < whole, F.lit(capacity)).otherwise(F.col("n") % capacity).cast("int").alias("size"))
    rest = pieces.where(F.col("size") < capacity)

    def pack_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(n, [(i, p, n)]) for b in batches for i, p, n in zip(b["id"].tolist(), b["piece"].tolist(), b["size"].tolist(), strict=True)]
        yield _frame(settle(held, capacity, slack, fan_in, leaves == 1), TaskContext.get().partitionId() // fan_in)

    def node(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def pack_node(pdf: pd.DataFrame) -> pd.DataFrame:
            held = [(s, list(zip(d, p, t, strict=True))) for s, d, p, t in zip(pdf["size"], pdf["doc_ids"], pdf["pieces"], pdf["tokens"], strict=True)]
            return _frame(settle(held, capacity, slack, fan_in, last), int(pdf["node"].iloc[0]) // fan_in)

        return pack_node

    done, nodes = [], leaves
    bins = cut(rest.mapInPandas(pack_leaf, BINS))
    while nodes > 1:
        nodes = -(-nodes // fan_in)

        done.append(bins.where("full"))
        bins = cut(bins.where("not full").groupBy("node").applyInPandas(node(nodes == 1), BINS))
    packed = bins
    for d in done:
        packed = packed.unionByName(d)
    name = F.concat_ws("-", F.col("doc_ids")[0], F.col("pieces")[0])
    members = packed.select(name.alias("container"), F.explode(F.arrays_zip("doc_ids", "pieces", "tokens")).alias("m"))
    members = members.select(F.col("m.doc_ids").alias("doc_id"), F.col("m.pieces").alias("piece"), "container", F.col("m.tokens").alias("tokens"))
    full = pieces.where(F.col("size") == capacity).select(F.col("id").alias("doc_id"), "piece", F.concat_ws("-", "id", "piece").alias("container"), F.col("size").alias("tokens"))
    return members.unionByName(full)


def check(sizes: DataFrame, packed: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: what went in, what came out, and how many containers are overfull, items lost, repeated or split needlessly."""
    given = sizes.where(F.col(key).isNotNull() & (F.col(size) > 0)).groupBy(F.col(key).cast("bigint").alias("doc_id")).agg(F.max(size).cast("bigint").alias("given"))
    got = packed.groupBy("doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("parts"), F.countDistinct("piece").alias("distinct_parts"))
    least = F.ceil(F.col("given") / capacity)
    one = given.join(got, "doc_id", "full").agg(
        F.count("given").alias("documents_in"),
        F.count("got").alias("documents_out"),
        F.count_if(~F.col("given").eqNullSafe(F.col("got"))).alias("wrong_sizes"),
        F.count_if((F.col("parts") > least) | (F.col("parts") != F.col("distinct_parts"))).alias("wrong_pieces"),
    )
    over = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("overfull"))
    return one.join(F.broadcast(over), F.lit(True))
