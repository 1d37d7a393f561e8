"""Problem 2: no contributor above its cap, the best records kept.

Bounded heaps of (score, identifier) pairs decide. Every partition keeps, of each contributor, no more than its cap's best pairs, and
counts what it leaves out. Heaps are merged as a tree: a heap of a cap that is a share of the data could outgrow a task, so a contributor's
heap is one of segments, fixed ranges of the score's order and, among equal scores, of identifiers. Segments better than the one that holds
the cap's last pair belong to the heap whole; of that one the merged heaps keep the room that is left; worse segments leave it. The identifiers in the
heaps then semi-join the full records, and contributors of which something was left out are those above their cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.keys import domain, entity_key
from loupe.session import cut, stored

#: Segments of identifiers among equal scores.
RANGES = 1 << 16
#: A table of so many contributors is small enough to be sent to every task.
FEW = 10_000
#: Branches that meet at a node of the merge tree below its root.
BRANCHES = 16
#: Pairs that a partition gathers before it cuts its heaps to size.
GATHER = 500_000


def quality(rows_text: Column, rating: Column) -> Column:
    """A quality score in [0, 1]: half for length up to 120 words, a quarter for a rating in 1..5, a quarter for little shouting."""
    words = F.size(F.filter(F.split(F.coalesce(rows_text, F.lit("")), r"\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace(F.coalesce(rows_text, F.lit("")), r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(F.coalesce(rows_text, F.lit("")), r"[^\p{Lu}]+", ""))
    calm = F.when(letters > 0, 1 - capitals / letters).otherwise(0.0)
    valid = F.when(rating.between(1, 5), 1.0).otherwise(0.0)
    return F.round(0.5 * F.least(words, F.lit(120)) / 120 + 0.25 * valid + 0.25 * calm, 6)


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bounded heaps of a partition over pairs (domain, entity_key, room, score, row_id, gone): of each contributor the `room` best pairs stay, the greatest score first, then the smallest id.

    What does not stay is counted: a row without row_id has the number in gone.
    """
    keys = ["domain", "entity_key"]
    gone: dict[tuple, list[int]] = {}
    held: list[pd.DataFrame] = []
    size = 0

    def settle() -> pd.DataFrame:
        x = pd.concat(held, ignore_index=True).sort_values([*keys, "score", "row_id"], ascending=[True, True, False, True], ignore_index=True)
        new = np.r_[True, (x["domain"].to_numpy()[1:] != x["domain"].to_numpy()[:-1]) | (x["entity_key"].to_numpy()[1:] != x["entity_key"].to_numpy()[:-1])]
        first = np.flatnonzero(new)
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        stays = rank < x["room"].to_numpy()
        for (d, e, room), n in x[~stays].groupby([*keys, "room"]).size().items():
            gone.setdefault((d, e), [room, 0])[1] += n
        return x[stays]

    for b in batches:
        held.append(b)
        size += len(held[-1])
        if size >= GATHER:
            held = [settle()]
            # twice what is held at least, so that large heaps aren't sorted again for every batch
            size = 0 if len(held[0]) < GATHER else -len(held[0])
    if held:
        yield settle()
    if gone:
        yield pd.DataFrame([(d, e, room, None, None, n) for (d, e), (room, n) in gone.items()], columns=[*keys, "room", "score", "row_id", "gone"])


_HEAP = "domain string, entity_key string, room long, score double, row_id long, gone long"


def _merged(heaps: DataFrame) -> DataFrame:
    """The merge tree: heaps of a contributor meet in BRANCHES nodes, then in one."""
    branch = F.pmod(F.xxhash64("row_id"), F.lit(BRANCHES)).cast("int")
    once = heaps.repartition("domain", "entity_key", branch).mapInPandas(_best, _HEAP).where("row_id IS NOT NULL")
    return once.repartition("domain", "entity_key").mapInPandas(_best, _HEAP)


def rooms(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """(domain, cap) of every domain that has a cap; cap is in rows, rounded down. rows: keyed()."""
    limits = caps.where("max_pct IS NOT NULL").groupBy(domain(F.col("domain")).alias("domain")).agg(F.min("max_pct").alias("max_pct")).where("domain IS NOT NULL")
    totals = rows.groupBy("domain").agg(F.count("*").alias("total"))
    # a row per domain, four at most
    return totals.join(F.broadcast(limits), "domain").select("domain", F.floor(F.col("total") * F.col("max_pct") / 100).cast("long").alias("cap"))


def keyed(rows: DataFrame) -> DataFrame:
    """(row_id, domain, entity_key, score) of rows that have a domain and a non-blank entity_id.

    rows: row_ord, domain, entity_id, text, rating. Null scores cannot arise; null texts and ratings score low.
    """
    return rows.select(
        F.col("row_ord").cast("long").alias("row_id"),
        domain(F.col("domain").cast("string")).alias("domain"),
        entity_key(F.col("entity_id").cast("string")).alias("entity_key"),
        quality(F.col("text").cast("string"), F.col("rating")).alias("score"),
    ).where("domain IS NOT NULL AND entity_key IS NOT NULL")


def _cut_at(pairs: DataFrame, few: int, place: Column) -> tuple[DataFrame, DataFrame]:
    """The pairs in ranges (small place first) that fit whole into the room, and those of the next range with the room left for it."""
    keys = ["domain", "entity_key"]
    ranged = pairs.withColumn("range", place)
    sizes = ranged.groupBy(*keys, "room", "range").agg(F.count("*").alias("m"))
    # as many rows a contributor as there are ranges, whatever the number of its pairs
    running = sizes.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys).orderBy("range")))
    last = running.where("upto >= room AND upto - m < room").select(*keys, F.col("range").alias("last"), (F.col("room") - F.col("upto") + F.col("m")).alias("left"))
    marked = ranged.join(_small(last, few), keys)
    edge = marked.where("range = last").withColumn("room", F.col("left"))
    return marked.where("range < last").drop("range", "last", "left"), edge.drop("range", "last", "left")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of at most `rows` rows, with a broadcast hint if these are few."""
    return F.broadcast(table) if rows <= FEW else table


def heaps_of(rows: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, over): the pairs (domain, entity_key, row_id) in the merged heaps of contributors that had to leave something out, and these contributors with n, kept.

    A contributor that fits into one heap of its cap has no row in either. Rows without row_ord can't be told apart and never stay in a heap.
    """
    keys = ["domain", "entity_key"]
    pairs = keyed(rows).where("row_id IS NOT NULL")
    # four rows at most
    sized = pairs.join(F.broadcast(rooms(pairs, caps)), "domain").select(*keys, F.col("cap").alias("room"), "score", "row_id", F.lit(0).cast("long").alias("gone"))
    heaps = stored(sized.mapInPandas(_best, _HEAP))
    offered = heaps.groupBy(*keys, "room").agg((F.count("row_id") + F.sum("gone")).alias("n"))
    over = cut(offered.where("n > room"))
    # a share of p percent leaves 100 / p of these a domain at most; only their heaps go on to the merge
    few = over.count()
    full = heaps.where("row_id IS NOT NULL").join(_small(over.select(*keys), few), keys)
    above, edge = _cut_at(full, few, F.round((1 - F.col("score")) * 1_000_000).cast("long"))
    # equal scores are left: segments of identifiers
    span = edge.groupBy(*keys).agg(F.min("row_id").alias("lo"), F.greatest(F.lit(1.0), (F.max("row_id") - F.min("row_id") + 1) / RANGES).alias("width"))
    first, edge = _cut_at(edge.join(_small(span, few), keys), few, F.floor((F.col("row_id") - F.col("lo")) / F.col("width")).cast("long"))
    last = _merged(edge.select(*keys, "room", "score", "row_id", "gone")).where("row_id IS NOT NULL")
    kept = above.select(*keys, "row_id").unionByName(first.select(*keys, "row_id")).unionByName(last.select(*keys, "row_id"))
    kept = stored(kept)
    held = kept.groupBy(*keys).agg(F.count("*").alias("kept"))
    # a cap of no rows keeps none, so a contributor may be missing from the heaps
    left = over.join(held, keys, "left").select(*keys, "n", F.coalesce("kept", F.lit(0)).alias("kept"))
    return kept, left.where("kept < n")


def over_cap(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """(domain, entity_key, n, kept): contributors whose heaps had to leave rows out."""
    return heaps_of(rows, caps)[1]


def cap_contributors(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    rows: row_ord (unique), domain, entity_id, text, rating and any others. Rows without a domain, an entity or a cap for their
    domain stay. Of a contributor above its cap the best rows by quality() stay, on ties those with the smaller row_ord.
    Empty tables give no rows; an empty table of caps keeps all.
    """
    kept, over = heaps_of(rows, caps)
    over = over.select(F.col("domain").alias("__od"), F.col("entity_key").alias("__oe"))
    x = rows.withColumns({"__d": domain(F.col("domain").cast("string")), "__e": entity_key(F.col("entity_id").cast("string"))})
    tall = (x["__d"] == over["__od"]) & (x["__e"] == over["__oe"])
    best = x.join(over, tall, "left_semi").join(kept.select(F.col("row_id").alias("__row")), F.col("row_ord") == F.col("__row"), "left_semi")
    return x.join(over, tall, "left_anti").unionByName(best).drop("__d", "__e")
