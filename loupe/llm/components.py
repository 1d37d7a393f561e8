"""Problem 1: splits that keep related records together.

Entity keys that share a text are tied. Components of the ties come from parallel hooking and shortcutting over a parent table:
every edge whose ends have different roots hooks the larger root under the smallest root it meets, then parents jump to
their parents' parents until every node points at a root. Both steps are joins and aggregations of tables; nothing but the
number of changed rows reaches the driver. Component sizes then meet the wanted shares by subset-sum bitsets over the
multiplicities of the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.keys import entity_key
from loupe.llm.text import enough, plain
from loupe.session import cut

#: Totals that the subset sum looks at first; it looks at more where these don't hold the wanted one.
WINDOW = 1 << 20
#: Entities of one text that are paired in one task.
CLASS = 1_000
#: Parts into which the components of one size are divided to number them without gathering them.
BUCKETS = 256


def memberships(rows: DataFrame) -> DataFrame:
    """Distinct (text_key, entity_key) of rows (entity_id, text) that count, pre-aggregated before the shuffle by distinct()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for b in batches:
            words = [plain(t) for t in b["text"]]
            keep = [enough(w) for w in words]
            b = b.assign(text_key=[xxh3_128_digest(w.encode()) for w in words])
            yield b.loc[keep, ["text_key", "entity_key"]]

    picked = rows.select(entity_key(F.col("entity_id").cast("string")).alias("entity_key"), F.col("text").cast("string").alias("text"))
    return picked.where(F.col("entity_key").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, "text_key binary, entity_key string").distinct()


def star_edges(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships of texts that tie entities, and an edge from each such entity to the text's smallest: linear in the members."""
    shared = members.groupBy("text_key").agg(F.min("entity_key").alias("least"), F.max("entity_key").alias("most")).where("least <> most")
    tied = members.join(shared.select("text_key", "least"), "text_key")
    return tied, tied.where("entity_key <> least").select(F.col("least").alias("u"), F.col("entity_key").alias("v")).distinct()


def _jumped(hooks: DataFrame) -> DataFrame:
    """Every hook under what its target is hooked under, and whether it moved."""
    up = hooks.select(F.col("root").alias("under"), F.col("under").alias("above"))
    return hooks.join(up, "under", "left").select("root", F.coalesce("above", "under").alias("under"), F.col("above").isNotNull().alias("moved"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    Edges are kept between roots only, so a round works on what is still unsettled; the parent table takes the hooks of all rounds at the end.
    """
    ordered = lambda u, v: [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]
    every = cut(edges.select(*ordered("u", "v")).distinct())
    parent = every.select(F.col("u").alias("node")).union(every.select("v")).distinct().withColumn("root", F.col("node"))
    live = every.where("u <> v")
    for _ in range(rounds):
        if live.isEmpty():
            return parent
        # hook: each larger root under the smallest root that it meets
        hooks = live.groupBy(F.col("v").alias("root")).agg(F.min("u").alias("under"))
        while True:
            # shortcut: twice in one job, until all hooks point at roots
            hooks = cut(_jumped(_jumped(hooks).drop("moved")))
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.select("root", "under")
        parent = parent.join(hooks, "root", "left").select("node", F.coalesce("under", "root").alias("root"))
        # edges go between the new roots
        left, right = hooks.toDF("u", "ru"), hooks.toDF("v", "rv")
        ends = live.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        live = cut(ends.where("u <> v").select(*ordered("u", "v")).distinct())
    raise RuntimeError("components did not settle")


def ties(rows: DataFrame) -> DataFrame:
    """(entity_key_a, entity_key_b): direct ties, found in the components of the hooked graph.

    A component of two entities is its only tie, so it comes from the parent table as it stands. In larger components the members of
    each text class are paired within the component. Entities of different components share no text.
    """
    tied, edges = star_edges(cut(memberships(rows)))
    parent = cut(components(edges))
    sizes = parent.groupBy("root").agg(F.count("*").alias("size"), F.max("node").alias("other"))
    # the root is the component's smallest node
    two = sizes.where("size = 2").select(F.col("root").alias("entity_key_a"), F.col("other").alias("entity_key_b"))
    large = parent.join(sizes.where("size > 2").select("root"), "root").select(F.col("node").alias("entity_key"), "root")
    return two.unionByName(_pairs(tied.join(large, "entity_key").select("root", "text_key", "entity_key"))).distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """(entity_key_a, entity_key_b) of members (root, text_key, entity_key) of one class (root, text_key).

    A class of more than CLASS members is cut into that many parts as it has CLASS members; one side of a pair goes to its part, the other side to all.
    """
    parts = members.groupBy("root", "text_key").agg(F.ceil(F.count("*") / CLASS).cast("int").alias("parts"))
    sized = members.join(parts, ["root", "text_key"])
    a = sized.select("root", "text_key", F.pmod(F.xxhash64("entity_key"), F.col("parts")).cast("int").alias("part"), F.col("entity_key").alias("entity_key_a"))
    b = sized.select("root", "text_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("entity_key").alias("entity_key_b"))
    return a.join(b, ["root", "text_key", "part"]).where("entity_key_a < entity_key_b").select("entity_key_a", "entity_key_b")


def tie_classes(rows: DataFrame) -> DataFrame:
    """(component, text_key, members, links): a row for each text that ties entities, with the number of ties it stands for; no pair is expanded."""
    tied, edges = star_edges(cut(memberships(rows)))
    roots = components(edges)
    inside = tied.select("text_key", "entity_key").join(roots.select(F.col("node").alias("entity_key"), F.col("root").alias("component")), "entity_key")
    return inside.groupBy("component", "text_key").agg(F.count("*").alias("members")).withColumn("links", F.expr("members * (members - 1) div 2"))


def _reach(sizes: dict[int, int], wanted: int, most: int) -> tuple[dict[int, int], int]:
    """(components of each size, total) whose total is nearest to `wanted`, of all totals up to `most`.

    A bit for each total that can be reached; multiplicities enter as binary parts. Kept for each total is the part that first
    reached it, so memory is bounded by the window, not by the number of sizes.
    """
    mask = (1 << (most + 1)) - 1
    first = np.full(most + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    bits = 1
    for s in sorted(sizes):
        left, part = sizes[s], 1
        while left > 0 and not (bits >> wanted) & 1:
            take = min(part, left)
            left, part = left - take, part * 2
            if s * take > most:
                continue
            fresh = (bits << (s * take)) & mask & ~bits
            if fresh:
                octets = np.frombuffer(fresh.to_bytes(most // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(octets)
                at = (some[:, None] * 8 + np.arange(8))[np.unpackbits(octets[some], bitorder="little").reshape(-1, 8) == 1]
                first[at] = len(parts)
                bits |= fresh
            parts.append((s, take))
    low = (bits & ((1 << (wanted + 1)) - 1)).bit_length() - 1
    above = bits >> wanted
    high = wanted + (above & -above).bit_length() - 1 if above else None
    at = total = low if high is None or wanted - low <= high - wanted else high
    taken: dict[int, int] = {}
    while at:
        s, take = parts[first[at]]
        taken[s] = taken.get(s, 0) + take
        at -= s * take
    return taken, total


def closest_subset(sizes: dict[int, int], wanted: int) -> dict[int, int]:
    """How many components of each size to take so that their total is as near `wanted` as can be (the smaller on ties).

    Largest components are taken first while more than WINDOW is missing; the subset sum settles the rest. Where that misses
    `wanted` the window grows until it is met or holds everything, so the result is the nearest total at any size.
    """
    sizes = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    total = sum(s * n for s, n in sizes.items())
    wanted = max(0, min(wanted, total))
    window = WINDOW
    while True:
        taken: dict[int, int] = {}
        missing = wanted
        for s in sorted(sizes, reverse=True):
            take = min(sizes[s], max(0, missing - window) // s)
            if take:
                taken[s] = take
                missing -= s * take
        rest = {s: n - taken.get(s, 0) for s, n in sizes.items() if n > taken.get(s, 0)}
        more, reached = _reach(rest, missing, min(2 * missing, sum(s * n for s, n in rest.items())))
        if reached == missing or not taken:
            for s, n in more.items():
                taken[s] = taken.get(s, 0) + n
            return taken
        window *= 4


def allot(sizes: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """Of each split but the largest, how many components of each size it takes; the largest split takes the rest."""
    total = sum(s * n for s, n in sizes.items())
    weight = sum(shares.values()) or 1
    order = sorted(shares, key=lambda k: (shares[k], k))
    left, out = dict(sizes), {}
    for name in order[:-1]:
        out[name] = closest_subset(left, round(total * shares[name] / weight))
        for s, n in out[name].items():
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    out[order[-1]] = left
    return out


def split_related(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(row_ord, component, split) of every row.

    rows: row_ord, entity_id, text. Rows of one entity, and of entities tied by a text, share a split. A row without entity is a
    component of its own ('#' and its row number). Null and short texts tie nothing. Splits get as near their shares as whole
    components allow. Repeated rows stay; empty tables give no rows; extra columns are left out.
    """
    x = rows.select("row_ord", entity_key(F.col("entity_id").cast("string")).alias("entity_key"))
    _, edges = star_edges(cut(memberships(rows)))
    roots = components(edges)
    # the tie graph is joined per entity, not per row: entities are far fewer and hot ones count once
    entities = x.where("entity_key IS NOT NULL").groupBy("entity_key").agg(F.count("*").alias("n"))
    entities = cut(entities.join(roots.select(F.col("node").alias("entity_key"), "root"), "entity_key", "left").select("entity_key", "n", F.coalesce("root", "entity_key").alias("component")))
    own = F.concat(F.lit("#"), F.col("row_ord").cast("string"))
    single = x.where("entity_key IS NULL").groupBy(own.alias("component")).agg(F.count("*").alias("size"))
    sized = cut(entities.groupBy("component").agg(F.sum("n").alias("size")).unionByName(single).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")))
    # different sizes of components number at most the square root of twice the rows
    counts = sized.groupBy("size").agg(F.count("*").alias("n"))
    plan = allot({r["size"]: r["n"] for r in counts.toLocalIterator()}, shares)
    last = max(shares, key=lambda k: (shares[k], k))
    bounds, seen = [], {}
    for name, taken in plan.items():
        for s, n in taken.items():
            if name != last and n:
                bounds.append((s, seen.get(s, 0), seen.get(s, 0) + n, name))
                seen[s] = seen.get(s, 0) + n
    spark = rows.sparkSession
    cuts = spark.createDataFrame(bounds, "size long, lo long, hi long, split string")
    # number the components of a size: position within a bucket, after the buckets before it
    before = sized.groupBy("size", "bucket").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy("size").orderBy("bucket")) - F.col("m"))
    numbered = sized.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("component"))).join(before.select("size", "bucket", "before"), ["size", "bucket"])
    numbered = numbered.withColumn("at", F.col("before") + F.col("rank") - 1)
    placed = numbered.join(cuts, (numbered["size"] == cuts["size"]) & (numbered["at"] >= cuts["lo"]) & (numbered["at"] < cuts["hi"]), "left").select(
        "component", F.coalesce("split", F.lit(last)).alias("split")
    )
    by_entity = cut(entities.select("entity_key", "component").join(placed, "component"))
    named = x.where("entity_key IS NOT NULL").join(by_entity, "entity_key").select("row_ord", "component", "split")
    alone = x.where("entity_key IS NULL").select("row_ord", own.alias("component")).join(placed, "component").select("row_ord", "component", "split")
    return named.unionByName(alone)


def shares_of(table: DataFrame) -> dict[str, float]:
    """{split: share} of a table of wanted proportions, a row per split."""
    rows = table.where("split IS NOT NULL AND share_pct IS NOT NULL").groupBy("split").agg(F.max("share_pct").alias("p")).collect()
    return {r["split"]: float(r["p"]) for r in rows}
