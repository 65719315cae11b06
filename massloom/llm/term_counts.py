"""Occurrences and record frequency of every term by last-seen counters.

A counter of a term holds its occurrences, the number of records that hold it, and the last record seen, so no record needs a set of
its terms. Tokens are hash-partitioned by term and ordered by record, and each partition is read through once with one counter at a time.
Before the shuffle the tokens of a batch are drawn together into one row for each term (first and last record, occurrences, records), which
makes a term in a third of all records cost one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.functions.text import WHITE
from massloom.session import materialize

#: Terms in more than this share of the records that hold any term are too common; terms in one record are too rare.
COMMON_SHARE = 0.01
#: Records of a task are numbered from its number times this, so the records of two tasks never overlap.
_RECORDS_OF_TASK = 1 << 40
_RUNS = "field_name string, term string, first_record bigint, last_record bigint, occurrences bigint, n_records bigint"
_SUMS = "field_name string, term string, occurrences bigint, n_records bigint"


def runs_of_batch(texts: pa.Array, records: np.ndarray, splitter: str) -> tuple[pa.Table, np.ndarray]:
    """(a row for each term: term, first_record, last_record, occurrences, n_records; the records that hold any term).

    `records` are ascending numbers, one for each text; equal numbers are one record. Tokens of a term come in record order, and one counts
    a record where it differs from the last one seen.
    """
    pieces = pc.split_pattern_regex(texts.cast(pa.large_string()), splitter)
    terms = pc.utf8_trim(pc.list_flatten(pieces), WHITE)
    held = pc.greater(pc.utf8_length(terms), 0)
    owner = records[pc.list_parent_indices(pieces).filter(held).to_numpy()]
    coded = terms.filter(held).cast(pa.string()).dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, rec = code[order], owner[order]
    new_term = np.r_[True, code[1:] != code[:-1]][: len(code)]
    new_record = new_term | np.r_[True, rec[1:] != rec[:-1]][: len(code)]
    first = np.flatnonzero(new_term)
    last = np.r_[first[1:], len(code)].astype(np.int64) - 1 if len(first) else first
    seen = np.add.reduceat(new_record.astype(np.int64), first) if len(first) else first
    columns = [coded.dictionary.take(pa.array(code[first])), pa.array(rec[first]), pa.array(rec[last]), pa.array(last - first + 1), pa.array(seen)]
    return pa.table(columns, ["term", "first_record", "last_record", "occurrences", "n_records"]), np.unique(owner)


class LastSeen:
    """Merges runs that come ordered by field, term and first record: (field, term) -> occurrences, records, last record."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.occurrences = self.records = 0
        self.last = -1

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The finished counters: the last one of a batch stays open."""
        size = batch.num_rows
        if not size:
            return
        field, term = (batch.column(i).dictionary_encode() for i in (0, 1))
        f, t = (c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (field, term))
        first, last, occ, rec = (batch.column(i).to_numpy() for i in (2, 3, 4, 5))
        new = np.r_[True, (f[1:] != f[:-1]) | (t[1:] != t[:-1])]
        # A record that the run before has seen already counts once.
        rec = rec - np.r_[False, ~new[1:] & (first[1:] == last[:-1])]
        at = np.flatnonzero(new)
        occ, rec = np.add.reduceat(occ, at), np.add.reduceat(rec, at)
        fields, terms = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
        key = (fields[0].as_py(), terms[0].as_py())
        done: list[tuple] = []
        if key == self.key:
            occ[0] += self.occurrences
            rec[0] += self.records - int(first[0] == self.last)
        else:
            done = self.rest()
        self.key = (fields[-1].as_py(), terms[-1].as_py())
        self.occurrences, self.records, self.last = int(occ[-1]), int(rec[-1]), int(last[-1])
        if done:
            yield _sums(*zip(*done, strict=True))
        if len(at) > 1:
            yield _sums(fields.slice(0, len(at) - 1), terms.slice(0, len(at) - 1), occ[:-1], rec[:-1])

    def rest(self) -> list[tuple]:
        return [] if self.key is None else [(*self.key, self.occurrences, self.records)]


def _sums(fields, terms, occurrences, records) -> pa.RecordBatch:
    columns = [pa.array(fields, pa.string()), pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["field_name", "term", "occurrences", "n_records"])


def count_terms(rows: DataFrame, fields: dict[str, str], record: str | None = None, common_share: float = COMMON_SHARE) -> DataFrame:
    """(field_name, term, occurrences, n_records, mark) of every distinct term.

    `fields` maps columns to the pattern of their separators; white space around terms and empty terms don't count; null texts hold
    none. Each row is a record, or all rows with the same value of the column `record` are (null is a record of its own value). mark is
    `rare` for one record, `common` for more than `common_share` of the records that hold any term of the field, else null. Only the named
    columns are read. An empty table gives no rows.
    """
    columns = list(fields)
    if record is None:
        take = rows.select(*columns)
    else:
        take = rows.select(F.xxhash64(record).alias("record_hash"), F.col(record).alias("record"), *columns).repartition("record_hash").sortWithinPartitions("record_hash", "record")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, before = TaskContext.get().partitionId() * _RECORDS_OF_TASK, None
        holders = dict.fromkeys(fields, 0)
        last_holder = dict.fromkeys(fields, -1)
        for b in batches:
            if not b.num_rows:
                continue
            if record is None:
                numbers = np.arange(base, base + b.num_rows)
            else:
                ids = b.column(1).to_pylist()
                changed = np.fromiter((x != y for x, y in zip(ids, [before, *ids], strict=False)), bool, len(ids))
                numbers, before = base + np.cumsum(changed), ids[-1]
            base = int(numbers[-1]) + (record is None)
            for f, splitter in fields.items():
                found, held = runs_of_batch(b.column(b.schema.get_field_index(f)), numbers, splitter)
                if len(held):
                    holders[f] += len(held) - int(held[0] == last_holder[f])
                    last_holder[f] = int(held[-1])
                    yield from found.add_column(0, "field_name", pa.array([f] * len(found), pa.string())).to_batches()
        for f, n in holders.items():  # the records of this task that hold any term, under no term
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([None], pa.string()), *[pa.array([x], pa.int64()) for x in (base, base, 0, n)]], ["field_name", "term", "first_record", "last_record", "occurrences", "n_records"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LastSeen()
        for b in batches:
            yield from counter.add(b)
        if left := counter.rest():
            yield _sums(*zip(*left, strict=True))

    ordered = take.mapInArrow(runs, _RUNS).repartition("field_name", "term").sortWithinPartitions("field_name", "term", "first_record")
    sums = materialize(ordered.mapInArrow(merge, _SUMS), "terms")
    # One row for each field.
    holders = sums.filter("term IS NULL").select("field_name", F.col("n_records").alias("holders"))
    mark = F.when(F.col("n_records") == 1, "rare").when((F.col("n_records") > 1) & (F.col("n_records") > F.col("holders") * F.lit(common_share)), "common")
    out = sums.filter("term IS NOT NULL").join(F.broadcast(holders), "field_name")
    return out.select("field_name", "term", "occurrences", "n_records", mark.alias("mark"))


def separators(chars: str, white: bool) -> str:
    """The pattern of one or more of `chars`, and of white space where that separates too."""
    marks = chars + (WHITE if white else "")
    return "[" + "".join("\\x{%x}" % ord(c) for c in marks) + "]+"
