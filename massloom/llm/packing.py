"""Filling of containers of fixed capacity by hierarchical multi-length packing.

Items are routed to the tier of the smallest capacity that holds them; larger ones are cut into pieces of the largest capacity.
Tiers are packed from long to short by best fit in decreasing size: a short item first takes a gap of a longer tier's container, then one of its
own tier, then a new container. The containers of a tier are dealt to step groups of equal number so that their costs balance. The rows
are spread over shards of a fixed number of items, each packed by one task; what that leaves unused is less than a container of each
capacity a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import materialize

#: Capacities in tokens, ascending: the context sizes of the tiers.
CAPACITIES = (512, 2048, 8192)
#: Items of a shard, about; containers of a step group.
SHARD_ITEMS = 20_000
STEP_CONTAINERS = 8


class _Gaps:
    """Open containers by the space they have left; the least sufficient space is found in a bit set."""

    def __init__(self) -> None:
        self.bits, self.by_space = 0, {}

    def add(self, space: int, container: int) -> None:
        if space > 0:
            self.by_space.setdefault(space, []).append(container)
            self.bits |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        """(space, container) of the tightest fit."""
        above = self.bits >> size
        if not above:
            return None
        space = size + (above & -above).bit_length() - 1
        held = self.by_space[space]
        container = held.pop()
        if not held:
            self.bits &= ~(1 << space)
        return space, container


def pack_sizes(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(container, offset) of each size, none above the largest capacity, and the capacity of each container. Sizes of 0 take no space."""
    sizes = np.asarray(sizes, np.int64)
    caps = sorted(capacities)
    tier = np.searchsorted(caps, sizes)
    order = np.lexsort((np.arange(len(sizes)), -sizes, -tier))
    where, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    kinds: list[int] = []
    longer, own, at = _Gaps(), _Gaps(), -1
    for i in order.tolist():
        size, t = int(sizes[i]), int(tier[i])
        if t != at:  # the containers of the tiers before are gaps to fill first
            for space, held in own.by_space.items():
                for c in held:
                    longer.add(space, c)
            own, at = _Gaps(), t
        if size == 0:
            if not kinds:
                kinds.append(caps[0])
                own.add(caps[0], 0)
            where[i] = 0
            continue
        source = longer if (found := longer.take(size)) is not None else own
        if found is None and (found := own.take(size)) is None:
            kinds.append(caps[t])
            found = (caps[t], len(kinds) - 1)
        space, c = found
        where[i], offset[i] = c, kinds[c] - space
        source.add(space - size, c)
    return where, offset, kinds


def step_groups(costs: Sequence[float], kinds: Sequence[int], per_step: int = STEP_CONTAINERS) -> np.ndarray:
    """The step of each container: steps hold containers of one capacity, dealt back and forth in descending cost."""
    costs, kinds = np.asarray(costs, float), np.asarray(kinds)
    steps, first = np.zeros(len(costs), np.int64), 0
    for kind in np.unique(kinds):
        mine = np.flatnonzero(kinds == kind)
        mine = mine[np.lexsort((mine, -costs[mine]))]
        n = -(-len(mine) // per_step)
        turn, place = np.divmod(np.arange(len(mine)), n)
        steps[mine] = first + np.where(turn % 2 == 0, place, n - 1 - place)
        first += n
    return steps


def pack(items: DataFrame, key: str, size: str, capacities: Sequence[int] = CAPACITIES, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(`key`, piece_no, n_tokens, container_id, capacity, start, step_group) of each item, or of each piece of one above the capacity.

    Null and negative sizes count as 0; an item of size 0 takes no space of a container. Repeated rows are items of their own, equal keys
    are spread like others. An empty table gives no rows. Only the two named columns are read; they are written once, so that a lost
    executor doesn't change what shard a row is in.
    """
    sized = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    sized = materialize(sized, "sizes")
    most = max(capacities)
    pieces = F.greatest(F.ceil(F.col("size") / most), F.lit(1))
    n_pieces = sized.agg(F.sum(pieces)).first()[0] or 0
    n_shards = -(-n_pieces // shard_items) or 1
    # The place of a row in the written files is its identity, whatever its key. Pieces of one item are spread as well.
    cut = sized.select("key", "size", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(1), pieces.cast("int"))).alias("piece_no"))
    cut = cut.select("key", "row", "piece_no", F.least(F.col("size") - (F.col("piece_no") - 1) * most, F.lit(most)).cast("int").alias("n_tokens"), F.pmod(F.xxhash64("row", "piece_no"), F.lit(n_shards)).alias("shard"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece_no"], ignore_index=True)
        where, start, kinds = pack_sizes(pdf["n_tokens"].to_numpy(), capacities)
        costs = np.bincount(where, pdf["n_tokens"].to_numpy(float) ** 2, len(kinds))
        step = step_groups(costs, kinds)
        base = int(pdf["shard"].iloc[0]) << 32
        return pdf.assign(container_id=base + where, capacity=np.asarray(kinds, np.int32)[where], start=start.astype(np.int32), step_group=base + step[where])[columns]

    columns = ["key", "piece_no", "n_tokens", "container_id", "capacity", "start", "step_group"]
    kind = items.schema[key].dataType.simpleString()
    out = cut.groupBy("shard").applyInPandas(packed, f"key {kind}, piece_no int, n_tokens int, container_id bigint, capacity int, start int, step_group bigint")
    return out.withColumnRenamed("key", key)


