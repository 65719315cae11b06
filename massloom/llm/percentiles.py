"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers, at each level at most one of them full while values arrive; a full buffer has K values, each standing for
2**level of the input. Two full buffers of a level collapse into one of the next by taking every second of their merged values, which can move
the rank of any value by at most 2**level. Offsets alternate, so errors partly cancel, but the stated bound counts every collapse in full:
with L levels it is below n * L / (2 * K). Sketches of partitions, files or days merge the same way. Rows are sketched where they are, so
a hot group is a few buffers by the time of the shuffle, and those of one group merge in a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a full buffer.
K = 4096
#: Groups that a task sketches at once, and sketches that one task merges for a group.
GROUPS_IN_MEMORY = 2_000
VALUES_IN_MEMORY = 4_000_000
FAN_IN = 64

#: A sketch as columns: values ascending within each buffer, the buffers' levels and lengths, the bound of the rank error, and exact figures.
FIELDS = "n bigint, lowest double, highest double, rank_error bigint, levels array<int>, sizes array<int>, buffer_values array<double>"


class Sketch:
    """Values with a bounded rank error. `add` and `merge` in any order give a valid sketch; the same order gives the same one."""

    __slots__ = ("buffers", "error", "highest", "k", "loose", "lowest", "n", "offset")

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.error, self.offset = k, 0, 0, 0
        self.lowest, self.highest = np.inf, -np.inf
        self.loose: list[np.ndarray] = []
        self.buffers: dict[int, list[np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.lowest, self.highest = min(self.lowest, values.min()), max(self.highest, values.max())
            self.loose.append(values)
            self._fill()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.error += other.error
        self.lowest, self.highest = min(self.lowest, other.lowest), max(self.highest, other.highest)
        self.loose += other.loose
        for level, held in other.buffers.items():
            self.buffers.setdefault(level, []).extend(held)
        self._fill()

    def _fill(self) -> None:
        if sum(map(len, self.loose)) >= self.k:
            values = np.concatenate(self.loose)
            full = len(values) // self.k * self.k
            self.buffers.setdefault(0, []).extend(np.sort(values[:full]).reshape(self.k, -1).T)
            self.loose = [values[full:]] if full < len(values) else []
        level = min(self.buffers, default=0)
        while level <= max(self.buffers, default=-1):
            held = self.buffers.get(level, [])
            while len(held) > 1:
                a, b = held.pop(), held.pop()
                self.buffers.setdefault(level + 1, []).append(np.sort(np.concatenate([a, b]), kind="stable")[self.offset :: 2])
                self.offset ^= 1
                self.error += 1 << level
            if not held:
                self.buffers.pop(level, None)
            level += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending values and, for each, how many input values are at or below it, about."""
        parts = [(v, 1) for v in self.loose] + [(v, 1 << level) for level, held in self.buffers.items() for v in held]
        values = np.concatenate([v for v, _ in parts])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(np.repeat([w for _, w in parts], [len(v) for v, _ in parts])[order])

    def quantile(self, share: float) -> float:
        """The value of rank ceil(share * n), at least 1; exact for the first and last rank and while nothing has collapsed."""
        rank = max(1, int(np.ceil(share * self.n)))
        if rank == 1 or rank == self.n:
            return float(self.lowest if rank == 1 else self.highest)
        values, upto = self.weighted()
        return float(values[np.searchsorted(upto, rank)])

    def row(self) -> tuple:
        loose = np.sort(np.concatenate(self.loose)) if self.loose else np.zeros(0)
        flat = ([(-1, loose)] if len(loose) else []) + [(level, v) for level in sorted(self.buffers) for v in self.buffers[level]]
        values = np.concatenate([v for _, v in flat])
        return self.n, float(self.lowest), float(self.highest), self.error, [x for x, _ in flat], [len(v) for _, v in flat], values

    @classmethod
    def from_row(cls, row: Sequence, k: int = K) -> Sketch:
        s = cls(k)
        s.n, s.lowest, s.highest, s.error, levels, sizes, values = row
        at, values = 0, np.asarray(values, float)
        for level, size in zip(levels, sizes, strict=True):
            part, at = values[at : at + size], at + size
            if level < 0:
                s.loose.append(part)
            else:
                s.buffers.setdefault(level, []).append(part)
        return s


def _batch(keys: Sequence[tuple], sketches: Sequence[Sketch], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(*k, *s.row()) for k, s in zip(keys, sketches, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(df: DataFrame, keys: Sequence[str]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], FIELDS])
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def day_sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """A sketch (`keys` and FIELDS) of `value` for each group of `keys`: write it, and any set of days can be merged later.

    Null, NaN and infinite values take no part; a group without values has no row; null keys are a group. Repeated rows count as often as they
    occur. Only the named columns are read.
    """
    taken = rows.select(*keys, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    ddl, schema = _schema(taken, keys)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Sketch] = {}
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            if groups:
                yield _batch(list(groups), list(groups.values()), schema)
            groups.clear()

        for b in batches:
            if not b.num_rows:
                continue
            coded = [c.dictionary_encode() for c in b.columns[:-1]]
            codes = np.zeros(b.num_rows, np.int64)
            for c in coded:
                codes = codes * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            values = b.column(b.num_columns - 1).to_numpy()[order]
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            names = zip(*[c.take(pa.array(order[starts])).to_pylist() for c in b.columns[:-1]], strict=True)
            for name, i, j in zip(names, starts, np.r_[starts[1:], len(values)], strict=True):
                groups.setdefault(name, Sketch(k)).add(values[i:j])
            held += b.num_rows
            if len(groups) > GROUPS_IN_MEMORY or held > VALUES_IN_MEMORY:
                yield from hand_on()
                held = 0
        yield from hand_on()

    return merged(taken.mapInArrow(sketch, ddl), keys, k)


def _merge_once(sketches: DataFrame, by: Sequence[str], keys: Sequence[str], k: int) -> DataFrame:
    """One sketch for each group of `by`, of which `keys` stay; a group's sketches follow each other in its task's rows."""
    ddl, schema = _schema(sketches, keys)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    grouped = sketches.select(*by, *names).repartition(*by).sortWithinPartitions(*by, *names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, total = None, None
        out_keys, out = [], []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns[: len(by) + 6]]
            lists = b.column(len(by) + 6)
            for i, name in enumerate(zip(*columns[: len(by)], strict=True)):
                s = Sketch.from_row((*[c[i] for c in columns[len(by) :]], lists[i].values.to_numpy()), k)
                if name == before:
                    total.merge(s)
                    continue
                if total is not None:
                    out_keys.append(before[: len(keys)])
                    out.append(total)
                    if len(out) >= GROUPS_IN_MEMORY // 4:
                        yield _batch(out_keys, out, schema)
                        out_keys, out = [], []
                before, total = name, s
        if total is not None:
            yield _batch([*out_keys, before[: len(keys)]], [*out, total], schema)

    return grouped.mapInArrow(merge, ddl)


def merged(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """The sketches of finer groups, days or partitions as one for each group of `keys`.

    First those that a hash of their contents puts together, FAN_IN lots for each group, then these: no task gets all of a hot group's.
    """
    lot = F.pmod(F.xxhash64("n", "lowest", "highest", "buffer_values"), F.lit(FAN_IN)).alias("lot")
    first = _merge_once(sketches.select("*", lot), [*keys, "lot"], keys, k)
    return _merge_once(first, keys, keys, k)


def percentiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], k: int = K) -> DataFrame:
    """(`keys`, n_values, p01 ... of `shares` in percent, rank_error): each value's rank is within rank_error of ceil(share * n_values)."""
    names = [f"p{round(100 * s):02d}" for s in shares]
    ddl = ", ".join([*[f"`{c}` {sketches.schema[c].dataType.simpleString()}" for c in keys], "n_values bigint", *[f"{n} double" for n in names], "rank_error bigint"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(x.split()[0])).to_pylist() for x in FIELDS.split(", ")[:6]]
            lists = b.column(b.schema.get_field_index("buffer_values"))
            found = [[] for _ in shares]
            for i in range(b.num_rows):
                s = Sketch.from_row((*[c[i] for c in columns], lists[i].values.to_numpy()), k)
                for f, share in zip(found, shares, strict=True):
                    f.append(s.quantile(share))
            kept = [b.column(b.schema.get_field_index(c)) for c in keys]
            arrays = [*kept, b.column(b.schema.get_field_index("n")), *[pa.array(f, pa.float64()) for f in found], b.column(b.schema.get_field_index("rank_error"))]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "n_values", *names, "rank_error"])

    return sketches.mapInArrow(read, ddl)


def readable_number(col: Column) -> Column:
    """The number of a cell that holds one readable number, in plain or scientific notation with spaces around it; else null."""
    bare = F.btrim(col)
    return F.when(bare.rlike(r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"), bare.try_cast("double"))

