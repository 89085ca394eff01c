"""Problem 9: texts packed whole into containers of fixed token capacity with certified bin counts.

Every partition is packed by best-fit decreasing and its bin count is held against a lower bound from dual-feasible
functions. Partitions that meet their bound are done. The others keep their full bins, put the contents of the rest into
one pool, are cut anew by another hash, and are packed again; the better of both outcomes stands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.tokens import VOCABULARIES, compile_vocabulary, encode_column
from skarn.session import cut, read_table, ship_package, spread


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, bins numbered from 0. Zero-sized items share the first bin."""
    bins = [0] * len(sizes)
    rooms: list[int] = []  # distinct free rooms, ascending
    at: dict[int, list[int]] = {}
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        k = bisect_left(rooms, sizes[i])
        if k < len(rooms):
            room = rooms[k]
            number = at[room].pop()
            if not at[room]:
                del at[room]
                rooms.pop(k)
        else:
            room, number, opened = capacity, opened, opened + 1
        bins[i] = number
        left = room - sizes[i]
        if left in at:
            at[left].append(number)
        else:
            at[left] = [number]
            insort(rooms, left)
    return bins


def lower_bound(count: dict[int, int], capacity: int) -> int:
    """The greatest bound of two families of dual-feasible functions; no packing of the items (size -> number) has fewer bins.

    Threshold family: items over capacity - k count a whole bin, items under k nothing, others their size; items over
    half a bin never share one. Rounding family: f(x) = floor((q + 1) x / C) / q, exact multiples keep x / C.
    Sums over sizes are prefix sums, so a histogram of n sizes takes n log n steps.
    """
    keys = sorted(s for s in count if s > 0)
    if not keys:
        return 1 if count else 0
    number, weight = [0], [0]
    for s in keys:
        number.append(number[-1] + count[s])
        weight.append(weight[-1] + s * count[s])
    best = -(-weight[-1] // capacity)

    def span(low: int, high: int) -> tuple[int, int]:
        """(items, tokens) of sizes in [low, high]."""
        i, j = bisect_left(keys, low), bisect_left(keys, high + 1)
        return number[j] - number[i], weight[j] - weight[i]

    half = capacity // 2
    for k in {0, *(s for s in keys if s <= half)}:
        large, _ = span(capacity - k + 1, capacity)
        middle, middle_sum = span(half + 1, capacity - k)
        _, small = span(max(k, 1), half)
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_sum)) // capacity)))
    for q in range(1, 31):
        # In units of 1 / (q * capacity), so that the sum is exact.
        value = sum(count[s] * (q * s if (q + 1) * s % capacity == 0 else (q + 1) * s // capacity * capacity) for s in keys)
        best = max(best, -(-value // (q * capacity)))
    return best


#: Capacities are a short fixed list.
MOST_CAPACITIES = 64


def items_of(lengths: DataFrame, capacities: DataFrame) -> DataFrame:
    """size_id, capacity, doc_id, chunk, tokens: a text over the capacity is cut into full pieces and a rest; others have one piece, chunk 0."""
    sizes = capacities.where(F.col("capacity_tokens") > 0).select(F.col("size_id").cast("int"), F.col("capacity_tokens").cast("int")).limit(MOST_CAPACITIES + 1).collect()
    if len(sizes) > MOST_CAPACITIES:
        raise ValueError(f"over {MOST_CAPACITIES} capacities")
    each = F.array(*[F.struct(F.lit(a).alias("size_id"), F.lit(b).alias("capacity_tokens")) for a, b in sizes]) if sizes else F.expr("array_repeat(named_struct('size_id', 0, 'capacity_tokens', 1), 0)")
    both = lengths.select("doc_id", "n_tokens", F.explode(each).alias("__s")).select("doc_id", "n_tokens", "__s.*")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))).cast("int")
    return both.select("size_id", F.col("capacity_tokens").alias("capacity"), "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk")).select(
        "size_id", "capacity", "doc_id", "chunk", F.least(F.col("capacity"), F.col("n_tokens") - F.col("chunk") * F.col("capacity")).cast("int").alias("tokens")
    )


PACKED = "size_id int, capacity int, doc_id bigint, chunk int, tokens int, part int, bin int, used int, bins int, bound int"


def pack_partition(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of one capacity packed, with its bin count and bound."""
    capacity = int(rows["capacity"].iloc[0])
    rows = rows.sort_values(["doc_id", "chunk"], ignore_index=True)
    sizes = rows["tokens"].tolist()
    bins = best_fit_decreasing(sizes, capacity)
    used: dict[int, int] = {}
    for b, s in zip(bins, sizes):
        used[b] = used.get(b, 0) + s
    return rows.assign(bin=bins, used=[used[b] for b in bins], bins=len(used), bound=lower_bound(Counter(sizes), capacity))


def pack(lengths: DataFrame, capacities: DataFrame, part_items: int = 20_000, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(assignment, certificate).

    lengths: doc_id, n_tokens, one row per text; capacities: size_id, capacity_tokens. assignment: size_id, doc_id, chunk,
    tokens, bin (text, unique within a size_id), bin_tokens. certificate: size_id, bins, lower_bound, tokens. Rows with a
    null doc_id or length are no items; empty texts are items of size 0. Texts are cut only if longer than the capacity.
    Partitions hold about part_items items whatever the input's size, hashed by document and piece, so that no one is
    large; rows repeated with one doc_id are packed each. An empty input gives empty tables.
    """
    ship_package(lengths.sparkSession)
    items = cut(items_of(lengths.where(F.col("doc_id").isNotNull() & F.col("n_tokens").isNotNull()), capacities))
    histogram = cut(items.groupBy("size_id", "capacity", "tokens").agg(F.count("*").alias("n")))
    largest = histogram.groupBy("size_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    open_, seed, done, kept, was = items, 0, [], None, {}
    bins: dict[int, int] = {}
    for turn in range(rounds + 1):
        parts = max(1, -(-largest // part_items))
        placed = open_.withColumn("part", F.pmod(F.xxhash64("doc_id", "chunk", F.lit(seed)), F.lit(parts)).cast("int"))
        packed = cut(placed.groupBy("size_id", "part").applyInPandas(pack_partition, PACKED).withColumn("round", F.lit(turn)))
        certified = (F.col("bins") == F.col("bound")) | (F.col("used") == F.col("capacity"))
        # One row per capacity: the bins of this packing, those that stay open, and the items in them.
        seen = packed.groupBy("size_id", "part", "bin").agg(F.first(certified).alias("closed"), F.count("*").alias("items"))
        facts = {r[0]: r for r in seen.groupBy("size_id").agg(F.count("*").alias("n"), F.count_if(~F.col("closed")).alias("open"), F.sum(F.when(~F.col("closed"), F.col("items")).otherwise(0)).alias("items")).collect()}
        if kept is not None:  # a pool that the exchange made no better keeps its bins
            worse = [s for s, r in facts.items() if r["n"] > was[s]]
            done.append(kept.where(F.col("size_id").isin(worse)))
            for s in worse:
                bins[s] += was[s]
            facts = {s: r for s, r in facts.items() if s not in worse}
            packed = packed.where(~F.col("size_id").isin(worse))
        done.append(packed.where(certified))
        was = {s: r["open"] for s, r in facts.items() if r["open"]}
        for s, r in facts.items():
            bins[s] = bins.get(s, 0) + r["n"] - r["open"]
        kept = packed.where(~certified)
        if not was or turn == rounds:
            done.append(kept)
            for s, n in was.items():
                bins[s] += n
            break
        open_, largest, seed = kept.select(*items.columns), max(facts[s]["items"] for s in was), seed + 1
        part_items = max(part_items, min(part_items * 2, 200_000))
    whole = reduce(DataFrame.unionByName, done)
    assignment = whole.select("size_id", "doc_id", "chunk", "tokens", F.concat_ws("-", "round", "part", "bin").alias("bin"), F.col("used").alias("bin_tokens"))
    rows = [(s, n) for s, n in sorted(bins.items())]
    certificate = _bound(histogram).join(F.broadcast(lengths.sparkSession.createDataFrame(rows, "size_id int, bins bigint")), "size_id")
    return assignment, certificate.select("size_id", "bins", "lower_bound", "tokens")


def _bound(histogram: DataFrame) -> DataFrame:
    """lower_bound, tokens of each size_id over all items, from the histogram of sizes (at most capacity + 1 rows each)."""

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        weights = dict(zip(rows["tokens"].tolist(), rows["n"].tolist()))
        return pd.DataFrame({"size_id": rows["size_id"].iloc[:1], "lower_bound": [lower_bound(weights, capacity)], "tokens": [int((rows["tokens"] * rows["n"]).sum())]})

    return histogram.groupBy("size_id").applyInPandas(bound, "size_id int, lower_bound bigint, tokens bigint")


def text_lengths(spark, sf_dir: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, n_tokens of every document."""
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut(encode_column(documents, "text", "ids", compile_vocabulary(name, folder)).select("doc_id", F.size("ids").alias("n_tokens")))


def p9_bins(spark, sf_dir: str) -> DataFrame:
    """size_id, doc_id, chunk, tokens, bin, bin_tokens of every piece of every document for each capacity."""
    return pack(text_lengths(spark, sf_dir), read_table(spark, sf_dir, "container_sizes"))[0]


def p9_certificate(spark, sf_dir: str) -> DataFrame:
    """size_id, bins, lower_bound, tokens."""
    return pack(text_lengths(spark, sf_dir), read_table(spark, sf_dir, "container_sizes"))[1]
