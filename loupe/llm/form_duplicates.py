"""Problem 6: records that differ in form only, collapsed to one with an exact count of copies.

Records become canonical (entity key, plain words; labelled fields in sorted order), are range-partitioned by canonical form and row
number, sorted within the partitions by Spark's external sort, and scanned once: adjacent rows with equal full keys make a run.
The row number is part of the range key, so a run of any length is spread over as many partitions as its size asks for. A run
that reaches a partition's border gives one summary per partition (key, first row, count); these few summaries are merged
and tell every part of the run its true first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.keys import entity_key
from loupe.llm.text import MIN_WORDS, canonical, enough
from loupe.session import cut, stored


def canonical_records(rows: DataFrame) -> DataFrame:
    """(row_ord, canon) of rows (row_ord, entity_id, text) that count: non-blank entity, enough words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [canonical(t) for t in b["text"]]
            keep = [enough(w, MIN_WORDS) for w in words]
            b = b.assign(canon=[f"{e}\t{w}" for e, w in zip(b["entity"], words)])
            yield b.loc[keep, ["row_ord", "canon"]]

    picked = rows.select(F.col("row_ord").cast("long"), entity_key(F.col("entity_id").cast("string")).alias("entity"), F.col("text").cast("string").alias("text"))
    return picked.where(F.col("entity").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, "row_ord long, canon string")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one partition: (row_ord, kept, border, n). kept is the run's first row here; n is 0 but in the run's last row here.

    border is a 128-bit name of the key where the run may go on beyond the partition, else empty.
    """
    from xxhash import xxh3_128_hexdigest

    name = lambda k: xxh3_128_hexdigest(k.encode())
    key: str | None = None
    first, n, at_start = 0, 0, True
    held: tuple | None = None
    for b in batches:
        out = []
        for row, canon in zip(b["row_ord"].tolist(), b["canon"].tolist()):
            if canon != key:
                if held is not None:
                    out.append((*held[:2], name(key) if at_start else "", n))
                at_start = key is None
                key, first, n = canon, row, 0
            elif held is not None:
                out.append((*held[:2], name(key) if at_start else "", 0))
            n += 1
            held = (row, first)
        yield pd.DataFrame(out, columns=["row_ord", "kept", "border", "n"])
    if held is not None:
        yield pd.DataFrame([(*held, name(key), n)], columns=["row_ord", "kept", "border", "n"])


def runs(rows: DataFrame) -> DataFrame:
    """The scanned runs of all partitions, see _scan()."""
    # written once: finding the ranges reads the records as well
    records = stored(canonical_records(rows))
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.repartitionByRange(parts, "canon", "row_ord").sortWithinPartitions("canon", "row_ord")
    return ordered.mapInPandas(_scan, "row_ord long, kept long, border string, n long")


def form_duplicates(rows: DataFrame) -> DataFrame:
    """(row_ord, kept_row_ord, n) of every counting row; n sums to the copies of the group.

    rows: row_ord, entity_id, text; other columns are left out. Null or blank entity_id and texts of fewer than four words (null
    and empty ones too) never count. Ties: the smallest row_ord is kept; a row_ord that comes twice counts as two copies.
    Empty tables give no rows.
    """
    members = cut(runs(rows))  # numbers only; the sorted texts are read once
    # a run that begins at a partition's first row may go on from the one before; the last run may go on in the next
    inner = members.where("border = ''").select("row_ord", F.col("kept").alias("kept_row_ord"), "n")
    edge = members.where("border <> ''")
    # at most two runs of a partition touch its borders, so the summaries are no more than twice the partitions and may be broadcast
    firsts = edge.groupBy("border").agg(F.min("kept").alias("first"))
    outer = edge.join(F.broadcast(firsts), "border").select("row_ord", F.col("first").alias("kept_row_ord"), "n")
    return inner.unionByName(outer)


def collapse(rows: DataFrame) -> DataFrame:
    """(kept_row_ord, copies): one row per record, whatever its form."""
    return form_duplicates(rows).groupBy("kept_row_ord").agg(F.sum("n").alias("copies"))


def repeats(rows: DataFrame) -> DataFrame:
    """(kept_row_ord, row_ord): every row that repeats an earlier one."""
    return form_duplicates(rows).where(F.col("row_ord") != F.col("kept_row_ord")).select("kept_row_ord", "row_ord")
