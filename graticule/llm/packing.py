"""Filling fixed-capacity containers with texts (problem 9).

Cost-balanced packing: the cost of a text of n tokens is estimated as ``linear * n + quadratic * n^2`` (attention), texts
go in descending order to the container of the lowest cost that still has room, and a container is opened where none has.
A text is split only if it alone exceeds the capacity: into full containers and a rest that is packed like a text.

All texts are spread by a hash of their id over shards of a bounded number of tokens and rows; every shard is packed in
one task of bounded memory, so a packing of any size is a map over shards. A shard leaves at most its last containers
partly empty; with ``SHARD`` containers a shard that is a fraction of a thousandth.

Within a shard a heap has the open containers by cost. One that lacks room for the text at hand waits under its room
until the texts are small enough, so every text costs O(log n). Balancing to the end spreads the room evenly and can leave it
unused where few texts are small; so the last texts may go to the fullest container that takes them instead, from the
share of tokens on that needs the fewest containers (never more than descending best fit needs).

Defined cases: null and empty texts have 0 tokens and stand in a container like others; ties are broken by the id, so
the result is the same in every run; an empty table gives no rows; a capacity under 1 is an error; null capacities are
left out.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm import tokens
from graticule.session import checkpointed

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Shares of the tokens, in descending order of the texts, that are balanced by cost; the rest is filled in tightly.
SHARES = (1, 0.9, 0.75, 0.5, 0)
SHARD = 4096
SHARD_ROWS = 250_000


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def balance(sizes: list[int], capacity: int, upto: int | None = None) -> list[int]:
    """The container of each size; sizes are in descending order and at most the capacity.

    The first ``upto`` (by default all) go to the container of the lowest cost that has room, the others to the fullest.
    """
    upto = len(sizes) if upto is None else upto
    heap = [(0.0, c) for c in range(math.ceil(sum(sizes) / capacity) if upto else 0)]
    room = [capacity] * len(heap)
    waiting: dict[int, list[tuple[float, int]]] = {}
    rooms: list[int] = []  # of the waiting containers, ascending
    out = []
    for n in sizes[:upto]:
        while rooms and rooms[-1] >= n:  # the texts are now small enough for these
            for x in waiting.pop(rooms.pop()):
                heapq.heappush(heap, x)
        while heap and room[heap[0][1]] < n:
            x = heapq.heappop(heap)
            r = room[x[1]]
            if r in waiting:
                waiting[r].append(x)
            else:
                waiting[r] = [x]
                insort(rooms, r)
        used, c = heapq.heappop(heap) if heap else (0.0, len(room))
        if c == len(room):
            room.append(capacity)
        room[c] -= n
        out.append(c)
        heapq.heappush(heap, (used + cost(n), c))
    # by room, at most as many lists as the capacity has tokens
    of: dict[int, list[int]] = {}
    for c in range(len(room) - 1, -1, -1):
        of.setdefault(room[c], []).append(c)
    rooms = sorted(of)
    for n in sizes[upto:]:
        at = bisect_left(rooms, n)
        if at == len(rooms):
            c, r = len(room), capacity
            room.append(capacity)
        else:
            r = rooms[at]
            c = of[r].pop()
            if not of[r]:
                del of[r], rooms[at]
        room[c] = r - n
        if r - n in of:
            of[r - n].append(c)
        else:
            of[r - n] = [c]
            insort(rooms, r - n)
        out.append(c)
    return out


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Numbers from 0 without gaps, one for each size (descending, none above the capacity).

    Of the packings in which all, most, ... or none of the tokens are balanced by cost, the one with the fewest
    containers; of equals the most balanced.
    """
    ends = np.cumsum(sizes) if sizes else np.zeros(0)
    best: list[int] | None = None
    fewest = 0
    for share in SHARES:
        upto = len(sizes) if share == 1 else int(np.searchsorted(ends, share * (ends[-1] if len(ends) else 0)))
        where = balance(sizes, capacity, upto)
        if best is None or len(set(where)) < fewest:
            best, fewest = where, len(set(where))
    number = {c: i for i, c in enumerate(dict.fromkeys(best))}
    return [number[c] for c in best]


def pack(sizes: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", n: str = "n_tokens") -> DataFrame:
    """(pack_name, container, key, start_token, n_tokens): where each text, or each part of a text above the capacity, stands.

    ``container`` is unique within its pack_name.
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity must be at least 1")
    kind = dict(sizes.dtypes)[key]
    total, count = sizes.agg(F.sum(n), F.count("*")).first()
    plan = [(name, int(c), max(1, math.ceil((total or 0) / (SHARD * c)), math.ceil(count / SHARD_ROWS))) for name, c in capacities]
    packs = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(c).alias("capacity"), F.lit(s).alias("shards")) for name, c, s in plan])
    items = sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("_n"), F.explode(packs).alias("_p")).select("_key", "_n", "_p.*")
    items = items.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.col("shards")).cast("int"))
    cut = F.when(F.col("_n") <= F.col("capacity"), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.col("capacity"))))
    parts = items.select("pack_name", "capacity", "_shard", "_key", F.explode(cut).alias("_part"), "_n").select("pack_name", "capacity", "_shard", "_key", (F.col("_part") * F.col("capacity")).alias("start_token"), F.least(F.col("capacity").cast("bigint"), F.col("_n") - F.col("_part") * F.col("capacity")).alias("n_tokens"))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "_key", "start_token"], ascending=[False, True, True], kind="stable", na_position="last")
        where = pack_sizes(rows["n_tokens"].tolist(), int(rows["capacity"].iloc[0]))
        first = int(rows["_shard"].iloc[0]) << 32
        return pd.DataFrame({"pack_name": rows["pack_name"], "container": np.array(where, np.int64) + first, key: rows["_key"], "start_token": rows["start_token"], "n_tokens": rows["n_tokens"]})

    return parts.groupBy("pack_name", "_shard").applyInPandas(shard, f"pack_name string, container bigint, `{key}` {kind}, start_token bigint, n_tokens bigint")


def pack_texts(df: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", **tokenizer) -> DataFrame:
    """Containers for all texts, measured in tokens. The texts are encoded once; only ids and lengths go on."""
    names = [(r[0], r[1]) for r in capacities.select("pack_name", "capacity_tokens").collect() if r[1] is not None]
    if not names:
        raise ValueError("no capacity is given")
    sizes = checkpointed(tokens.encode(df, key, text, "n_tokens", sizes_only=True, **tokenizer))
    return pack(sizes, names, key)


def report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, containers, least, tokens, unused, mean_cost, cost_spread) of packings: how full and how even they are.

    ``least`` is the volume's lower bound of containers, ``unused`` the share of their room that stays empty and
    ``cost_spread`` the standard deviation of the containers' costs over their mean. Two sums per container are shuffled.
    """
    n = F.col("n_tokens")
    by = packed.groupBy("pack_name", "container").agg(F.sum(n).alias("_n"), F.sum(LINEAR * n + QUADRATIC * n * n).alias("_c"))
    out = by.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("_n").alias("tokens"), F.avg("_c").alias("mean_cost"), (F.stddev_pop("_c") / F.greatest(F.avg("_c"), F.lit(1e-9))).alias("cost_spread"))
    cap = capacities.select("pack_name", F.col("capacity_tokens").cast("double").alias("_cap"))
    out = out.join(cap, "pack_name")
    return out.select("pack_name", "containers", F.ceil(F.col("tokens") / F.col("_cap")).alias("least"), "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("_cap"))).alias("unused"), "mean_cost", "cost_spread")
