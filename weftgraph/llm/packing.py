"""Problem 9: filling fixed-capacity containers by swap-based local search."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import discard, materialize

CAPACITY = 2_048
#: Items of a group that is packed in one task, and the fill below which a group's bins are packed once more with those of other groups (parameters of :func:`pack`).
GROUP_ITEMS = 8_192
LOOSE = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([int(i)])
            left, k = capacity - size, len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(int(i))
            left -= size
        if left:
            bisect.insort(room, (left, k))
    return bins


def _choices(members: list[int], sizes: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """One or two items of a bin with their size, by size."""
    ones = sorted((int(sizes[i]), i) for i in members)
    both = [(ones[x][0] + ones[y][0], (ones[x][1], ones[y][1])) for x in range(len(ones)) for y in range(x)]
    return sorted([(s, (i,)) for s, i in ones] + both)


def _transfer(gives: list[tuple[int, tuple[int, ...]]], takes: list[tuple[int, tuple[int, ...]]], sums: list[int], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that carries most from one bin to a fuller one within its room: a move, one for one, two for one or one for two. ``sums`` are the sizes of ``takes``."""
    best, choice = 0, None
    for given, items in gives:
        if given <= room:
            if given > best:
                best, choice = given, (items, ())
            continue
        at = bisect.bisect_left(sums, given - room)  # the least that must come back
        while at < len(takes) and given - sums[at] > best:
            if len(items) == 1 or len(takes[at][1]) == 1:  # two for two is not among the steps
                best, choice = given - sums[at], (items, takes[at][1])
                break
            at += 1
        if best == room:
            break
    return choice


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least filled bins into fuller ones while that raises the sum of squared fills.

    A bin is given up only when no exchange with any other underfull bin is left, and is tried again whenever another bin has been emptied. Ends at the least possible
    number of bins, or when no exchange helps any bin.
    """
    fill = [int(sizes[b].sum()) for b in bins]
    fewest = -(-int(sizes.sum()) // capacity) if len(sizes) else 0
    order = sorted((f, k) for k, f in enumerate(fill) if f < capacity)
    alive, stuck = len(bins), set()
    known: dict[int, tuple[list, list[int]]] = {}  # choices of a bin while it stays as it is

    def choices(k: int) -> tuple[list, list[int]]:
        if k not in known:
            listed = _choices(bins[k], sizes)
            known[k] = listed, [s for s, _ in listed]
        return known[k]

    while alive > fewest:
        low = next((k for _, k in order if k not in stuck), None)
        if low is None or len(order) < 2:
            break
        order.remove((fill[low], low))
        moved = True
        while moved and bins[low]:
            moved = False
            for f, k in order:  # the partners with the most room first
                found = _transfer(choices(low)[0], *choices(k), capacity - f)
                if not found:
                    continue
                given, taken = found
                bins[low] = [i for i in bins[low] if i not in given] + list(taken)
                bins[k] = [j for j in bins[k] if j not in taken] + list(given)
                order.remove((f, k))
                known.pop(low, None)
                known.pop(k, None)
                fill[low], fill[k] = int(sizes[bins[low]].sum()), int(sizes[bins[k]].sum())
                if fill[k] < capacity:
                    bisect.insort(order, (fill[k], k))
                moved = True
                break
        if bins[low]:
            stuck.add(low)
            bisect.insort(order, (fill[low], low))
        else:
            alive -= 1
            stuck.clear()
    return [b for b in bins if b]


def _fill(items: DataFrame, key: str, capacity: int, stage: str, group_items: int) -> DataFrame:
    """Bins of hash groups of about ``group_items`` items; the number of groups follows the number of items, and each group is a task of its own but for chance."""
    groups = max(1, -(-items.count() // group_items))
    schema = T.StructType([*items.schema.fields, T.StructField("container", T.StringType()), T.StructField("filled", T.IntegerType())])

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="__group").sort_values([key, "piece_no"], kind="stable", ignore_index=True)
        sizes = frame["n_tokens"].to_numpy(np.int64)
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        at, full = np.empty(len(frame), np.int64), np.empty(len(frame), np.int32)
        for n, members in enumerate(bins):
            at[members], full[members] = n, sizes[members].sum()
        return frame.assign(container=[f"{stage}{group[0]}-{n}" for n in at], filled=full)

    grouped = items.withColumn("__group", F.pmod(F.xxhash64(key, "piece_no"), F.lit(groups)))
    return grouped.repartition(groups, "__group").groupBy("__group").applyInPandas(run, schema)


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, loose: float = LOOSE) -> DataFrame:
    """Container of every item: ``(key, piece_no, token_start, n_tokens, container, filled)``.

    ``sizes`` is (key, n_tokens), one row an item. An item above the capacity is cut into full pieces and a rest, others stay whole; items
    null or of no tokens need no place and give no row. Items are spread by hash into groups of about ``group_items``, each packed by best fit and swap-based local search;
    what lies in bins that their group left filled below ``loose`` is packed once more together. So a group wastes at most 1 - ``loose`` of its space, and the last open bins of the second pass, one for every
    ``group_items`` of loose items. The result is a written table. Ties are taken in key order. Repeated rows are items of their own. Empty tables give an empty result.
    """
    start = F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity)))
    sizes = sizes.withColumn("n_tokens", F.col("n_tokens").cast("int"))
    pieces = sizes.filter("n_tokens > 0").select(F.col(key), F.col("n_tokens").alias("all"), start.alias("token_start"))
    pieces = pieces.select(key, (F.col("token_start") / capacity).cast("int").alias("piece_no"), "token_start", F.least(F.lit(capacity), F.col("all") - F.col("token_start")).cast("int").alias("n_tokens"))
    pieces = materialize(pieces, "pieces")
    whole = pieces.filter(F.col("n_tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("w"), F.col(key).cast("string"), "piece_no")).withColumn("filled", F.col("n_tokens"))
    first = materialize(_fill(pieces.filter(F.col("n_tokens") < capacity), key, capacity, "a", group_items), "packed")
    tight = F.col("filled") >= int(capacity * loose)
    again = _fill(first.filter(~tight).drop("container", "filled"), key, capacity, "b", group_items)
    out = materialize(whole.unionByName(first.filter(tight)).unionByName(again), "containers")
    discard(pieces)
    discard(first)
    return out


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least number that could do, and the share of space used."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = F.sum("n")
    return each.agg(F.count("*").alias("n_containers"), F.ceil(total / capacity).alias("fewest"), (total / (F.count("*") * capacity)).alias("share_used"), F.max("n").alias("fullest"))
