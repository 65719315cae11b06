"""Cells that hold several values, as one value per row with its place.

A quote-aware finite-state tokenizer cuts a cell at the delimiters that stand outside quotes and brackets. Some values hold delimiters
themselves (`Nuclear kinase 4, long form`); the runs of pieces that make up a listed value are found by a join of candidate
runs with the listed values that hold a delimiter, and stay whole. Each distinct cell is tokenized once. Nothing is broadcast by hand: the
list grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.functions.text import WHITE, strip

#: Delimiters of a field, white space among them where values never hold any.
CODE_DELIMITERS = "|;,/\t\n\r "
NAME_DELIMITERS = "|;,/\t\n\r"
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def _matched_brackets(text: str) -> set[int]:
    """Places of the brackets that have a partner."""
    stack: list[int] = []
    matched: set[int] = set()
    open_of = dict.fromkeys(")]}", 0)  # open brackets by their closer, so a closer without one costs nothing
    for at, ch in enumerate(text):
        if ch in _CLOSERS:
            stack.append(at)
            open_of[_CLOSERS[ch]] += 1
        elif open_of.get(ch):
            while True:  # open ones within the pair have no partner
                last = stack.pop()
                closer = _CLOSERS[text[last]]
                open_of[closer] -= 1
                if closer == ch:
                    break
            matched.add(last)
            matched.add(at)
    return matched


def _closing_quote(text: str, at: int, delimiters: str, dead: set[int]) -> int:
    """The place of the quote that closes the one at `at` and is followed by a delimiter or the end; -1 if there is none.

    `dead` holds the places from which earlier searches came to nothing, so that no stretch is searched twice.
    """
    end = at + 1
    seen = []
    while True:
        end = text.find('"', end)
        if end < 0 or end in dead:
            break
        seen.append(end)
        if text[end - 1] == "\\" and end - 1 > at:
            end += 1
        elif text.startswith('""', end):
            end += 2
        else:
            after = end + 1
            while after < len(text) and text[after] in WHITE and text[after] not in delimiters:
                after += 1
            if after == len(text) or text[after] in delimiters:
                return end
            break
    dead.update(seen)
    return -1


def tokenize(text: str, delimiters: str) -> list[tuple[int, int, str | None]]:
    """Pieces (start, end, unquoted text or None if not quoted) between the delimiters outside quotes and brackets."""
    brackets = _matched_brackets(text) if any(c in text for c in "([{") else ()
    unclosed = False
    pieces: list[tuple[int, int, str | None]] = []
    start = at = depth = 0
    quoted: str | None = None
    dead: set[int] = set()
    fresh = True  # nothing but white space since the last delimiter
    size = len(text)
    while at < size:
        ch = text[at]
        if fresh and ch == '"' and not unclosed:
            end = _closing_quote(text, at, delimiters, dead)
            if end < 0:
                unclosed = text.find('"', at + 1) < 0
                fresh = False
            else:
                quoted, fresh, at = text[at + 1 : end].replace('""', '"').replace('\\"', '"'), False, end
        elif depth == 0 and ch in delimiters:
            pieces.append((start, at, quoted))
            start, quoted, fresh = at + 1, None, True
        elif brackets and at in brackets:
            depth += 1 if ch in _CLOSERS else -1
            fresh = False
        elif ch not in WHITE:
            fresh = False
        at += 1
    pieces.append((start, size, quoted))
    return pieces


def runs(text: str, delimiters: str, most: int) -> list[str]:
    """Texts of the runs of 2 to `most` + 1 unquoted pieces: each could be one value that holds delimiters."""
    pieces = tokenize(text, delimiters) if most else []
    found = []
    for i, (start, _, quoted) in enumerate(pieces):
        for j in range(i, min(len(pieces), i + most + 1)):
            if pieces[j][2] is not None or quoted is not None:
                break
            if j > i and (run := text[start : pieces[j][1]].strip(WHITE)):
                found.append(run)
    return found


def values(text: str, delimiters: str, listed: frozenset[str] | set[str] = frozenset(), most: int = 0) -> list[str]:
    """The values of a cell in order, empty ones left out; of the runs that are listed, the longest from the left stays whole."""
    pieces = tokenize(text, delimiters)
    found, i = [], 0
    while i < len(pieces):
        start, end, quoted = pieces[i]
        taken = i
        if quoted is None and listed:
            for j in range(i + 1, min(len(pieces), i + most + 1)):
                if pieces[j][2] is not None:
                    break
                if text[start : pieces[j][1]].strip(WHITE) in listed:
                    taken = j
        value = (text[start : pieces[taken][1]] if quoted is None else quoted).strip(WHITE)
        if value:
            found.append(value)
        i = taken + 1
    return found


def split_values(rows: DataFrame, key: str, fields: dict[str, str], listed: DataFrame) -> DataFrame:
    """(`key`, field_name, value_no, item_text) for each value of each cell that holds two or more.

    `fields` maps column names to their delimiters; `listed` has (field_name, value) of the known values. Only the named columns are
    read. Null, empty and blank cells and cells of one value give no rows; a quote without a partner is text; repeated rows come out as often
    as they occur.
    """
    special = listed.filter(F.coalesce(*[F.when(F.col("field_name") == f, F.col("value").rlike(_any_of(d))) for f, d in fields.items()]))
    special = special.select("field_name", strip(F.col("value")).alias("run")).distinct()
    # One row for each field: the most delimiters in a listed value bound the length of a run.
    count = F.coalesce(*[F.when(F.col("field_name") == f, F.length("run") - F.length(F.translate("run", d, ""))) for f, d in fields.items()])
    most = {f: int(n) for f, n in special.groupBy("field_name").agg(F.max(count)).collect()}

    cut = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields]))
    worth = F.coalesce(*[F.when(F.col("field_name") == f, F.col("cell").rlike(_any_of(d))) for f, d in fields.items()])
    long = rows.select(F.col(key).alias("key"), cut).filter(worth)
    cells = long.select("field_name", "cell").distinct()

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [runs(c, fields[f], most.get(f, 0)) for f, c in zip(b["field_name"], b["cell"], strict=True)]
            out = b.assign(run=found).explode("run").dropna(subset=["run"])
            yield out[["field_name", "cell", "run"]]

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = frozenset()
            items = [values(c, fields[f], none if h is None else set(h), most.get(f, 0)) for f, c, h in zip(b["field_name"], b["cell"], b["hits"], strict=True)]
            out = b[["field_name", "cell"]].assign(items=items)
            yield out[out["items"].map(len) > 1]

    hits = cells.mapInPandas(candidates, "field_name string, cell string, run string").join(special, ["field_name", "run"])
    hits = hits.groupBy("field_name", "cell").agg(F.collect_set("run").alias("hits"))
    known = cells.join(hits, ["field_name", "cell"], "left")
    cut_cells = known.mapInPandas(tokenized, "field_name string, cell string, items array<string>")
    out = long.join(cut_cells, ["field_name", "cell"]).select("key", "field_name", F.posexplode("items").alias("place", "item_text"))
    return out.select(F.col("key").alias(key), "field_name", (F.col("place") + 1).alias("value_no"), "item_text")


def _any_of(delimiters: str) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in delimiters) + "]"


def listed_values(*tables: DataFrame) -> DataFrame:
    """(field_name, value) of the accessions (bare and as decoys), names, genes with synonyms and organisms of the protein tables."""
    parts = []
    for t in tables:
        pairs = [("accession", F.col("accession")), ("accession", F.concat(F.lit("DECOY_"), F.col("accession"))), ("protein_name", F.col("protein_name")), ("gene_name", F.col("gene_name")), ("gene_name", F.col("gene_synonym")), ("organism_name", F.col("organism_name"))]
        parts.append(t.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), c.alias("value")) for f, c in pairs]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The packed fields of the match table.
MATCH_FIELDS = {"accession": CODE_DELIMITERS, "protein_name": NAME_DELIMITERS, "gene_name": CODE_DELIMITERS, "organism_name": NAME_DELIMITERS}
