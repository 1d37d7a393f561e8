"""Problem 3: a sample whose categories follow target proportions, by the cube method.

Cells get an expected size: all there is where that falls short of the target or the minimum, else at least the minimum and the rest in proportion to the targets. Each record's
inclusion probability is its cell's expected size over the cell's rows. The flight phase moves the probabilities of a few
records at a time along a vector that leaves all balancing totals as they are, until one of them is 0 or 1. It runs on each
part of the records alone; parts are made by a hash of the record, so the draw is the same on any cluster. The records that a part cannot settle,
one a cell at most, move up to the next level, BRANCH parts at a time, and fly on there. Landing settles the last few records of all.

The balancing variables are the indicators of the cells, so every cell's sample is within one record of its expected size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.keys import domain, label
from loupe.session import cut

#: Parts whose unresolved records meet in one at the next level of the merge.
BRANCH = 32
#: Records of a part at the lowest level, about.
PART = 50_000


def expected_sizes(available: dict[tuple, int], targets: dict[tuple, tuple[float, int]], n: int) -> dict[tuple, float]:
    """Expected sample size of each cell.

    A cell with fewer rows than its share of n or than its minimum gives all it has. The others get their minimum, and in proportion to
    their shares what is left of n, never more than they have. The sum is n unless all cells with a target hold fewer rows, or
    the minimums and what there is of cells below theirs come to more than n.
    """
    room = {c: float(available.get(c, 0)) for c in targets}
    short = {c for c, (share, least) in targets.items() if room[c] * 100 < share * n or room[c] < least}
    sizes = {c: room[c] for c in short}
    rest = max(0.0, n - sum(sizes.values()))
    full = {c: t for c, t in targets.items() if c not in short}
    floors = {c: float(least) for c, (_, least) in full.items()}
    total = sum(floors.values())
    if total >= rest:
        return sizes | floors
    lo, hi = 0.0, 1.0
    size = lambda scale: {c: min(room[c], max(floors[c], scale * n * share / 100)) for c, (share, _) in full.items()}
    most = sum(room[c] for c, (share, _) in full.items() if share > 0) + sum(floors[c] for c, (share, _) in full.items() if share <= 0)
    while sum(size(hi).values()) < min(rest, most) - 1e-6 and hi < 1e9:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(size(mid).values()) < rest else (lo, mid)
    return sizes | size(hi)


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The fast flight of the cube: p after all moves that keep sum(p * x / p0) for every column of x.

    p: inclusion probabilities strictly between 0 and 1. x: a row of balancing variables, already divided by p0, for each record.
    Works on a window of as many records as there are constraints, and one more; a settled record makes room for the next.
    """
    p = p.copy()
    width = x.shape[1] + 1
    order = rng.permutation(len(p))
    window = list(order[:width])
    following = width
    eps = 1e-9
    while len(window) > 1:
        a = x[window].T
        # a vector of the kernel of a; with few records left there may be none
        _, s, vt = np.linalg.svd(a, full_matrices=True)
        rank = int((s > 1e-9 * max(1.0, s[0] if len(s) else 1.0)).sum())
        if rank >= len(window):
            break
        u = vt[-1]
        u = np.where(np.abs(u) < 1e-11, 0.0, u)
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        step = up if rng.random() < down / (up + down) else -down
        q = q + step * u
        q[q < eps], q[q > 1 - eps] = 0.0, 1.0
        p[window] = q
        window = [i for i, v in zip(window, q) if 0 < v < 1]
        while len(window) < width and following < len(order):
            window.append(order[following])
            following += 1
    return p


def pair_flight(p: np.ndarray, cell: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The same flight when the balancing variables are indicators of disjoint cells.

    The kernel vectors are then the pairs of one cell, (1, -1): all records of a cell fly in pairs at once, and each pair
    settles one of the two at least, until a cell has one open record at most.
    """
    p = p.copy()
    live = np.lexsort((rng.random(len(p)), cell))
    live = live[(p[live] > 0) & (p[live] < 1)]
    while len(live) > 1:
        c = cell[live]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        place = np.arange(len(live)) - np.repeat(first, np.diff(np.r_[first, len(live)]))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (c[1:] == c[:-1]))
        if not len(left):
            break
        a, b = live[left], live[left + 1]
        q, r = p[a], p[b]
        up, down = np.minimum(1 - q, r), np.minimum(q, 1 - r)
        step = np.where(rng.random(len(a)) < down / (up + down), up, -down)
        for at, v in ((a, q + step), (b, r - step)):
            p[at] = np.where(v < 1e-9, 0.0, np.where(v > 1 - 1e-9, 1.0, v))
        live = live[(p[live] > 0) & (p[live] < 1)]
    return p


def _fly(seed: int, last: bool):
    """applyInPandas over (part, row_id, cell, p): flight of one part; with `last`, landing of what is left."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("row_id", ignore_index=True)
        rng = np.random.default_rng([seed, int(key[0])])
        p = pair_flight(x["p"].to_numpy(copy=True), x["cell"].to_numpy(), rng)
        open_ = np.flatnonzero((p > 0) & (p < 1))
        if last and len(open_):
            # landing: the cells' constraints are dropped, the sample's size is kept
            q = flight(p[open_], np.ones((len(open_), 1)), rng)
            p[open_] = np.where((q > 0) & (q < 1), rng.random(len(q)) < q, q)
        return x.assign(p=p)

    return run


def cell_counts(rows: DataFrame) -> dict[tuple, int]:
    """Rows of each (domain, label) cell: twelve at most."""
    counted = rows.groupBy("domain", "label").agg(F.count("*").alias("n")).collect()
    return {(r["domain"], r["label"]): r["n"] for r in counted}


def targets_of(table: DataFrame) -> dict[tuple, tuple[float, int]]:
    """{(domain, label): (percent, least rows)}; of a cell given twice the greater values count, null values are 0."""
    t = table.select(domain(F.col("domain")).alias("d"), label(F.col("sentiment_label")).alias("l"), "target_pct", "min_rows").where("d IS NOT NULL AND l IS NOT NULL")
    rows = t.groupBy("d", "l").agg(F.coalesce(F.max("target_pct"), F.lit(0)).alias("p"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("m")).collect()
    return {(r["d"], r["l"]): (float(r["p"]), int(r["m"])) for r in rows}


def _taken(drawn: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in drawn.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def _draw(records: DataFrame, p: dict[int, float], parts: int, seed: int) -> DataFrame:
    """(row_id, cell) of the records (row_id, cell) that the flight and the landing draw; p: probabilities by cell."""
    lookup = records.sparkSession.createDataFrame([(c, min(1.0, q)) for c, q in p.items() if q > 0], "cell int, p double")
    part = F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int")
    # a row per target cell
    open_ = records.join(F.broadcast(lookup), "cell").select(part.alias("part"), "row_id", "cell", "p")
    settled, level = [], 0
    while True:
        # a part leaves at most one open record a cell, so BRANCH parts make a small one
        state = cut(open_.groupBy("part").applyInPandas(_fly(seed + level, parts == 1), "part int, row_id long, cell int, p double"))
        settled.append(state.where("p = 1"))
        if parts == 1:
            return reduce(DataFrame.unionByName, settled).select("row_id", "cell")
        parts, level = -(-parts // BRANCH), level + 1
        open_ = state.where("p > 0 AND p < 1").withColumn("part", F.floor(F.col("part") / BRANCH).cast("int"))


def balanced_sample(rows: DataFrame, targets: DataFrame, n: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    rows: row_ord (unique), domain, sentiment_label. n: rows of the sample, by default a tenth, rounded down, of the rows with a domain and a label.
    sample: (row_ord, domain, sentiment_label), each row at most once. report: a row per target cell with available, wanted
    (target percent of n), min_rows, expected, taken, residual (taken - wanted) and unmet: the first flight took all its rows, and they are below wanted or min_rows.
    Where the minimums need more than n, what they drew flies once more, down to n.
    Rows without a domain, a label or a row_ord are left out; those outside the target cells are never drawn. A cell without rows is reported with 0. Empty tables give an
    empty sample and a report of unmet cells; an empty target table gives neither.
    """
    spark = rows.sparkSession
    x = rows.select(F.col("row_ord").cast("long").alias("row_id"), domain(F.col("domain").cast("string")).alias("domain"), label(F.col("sentiment_label").cast("string")).alias("label"))
    x = x.where("row_id IS NOT NULL AND domain IS NOT NULL AND label IS NOT NULL")
    available, wanted = cell_counts(x), targets_of(targets)
    n = sum(available.values()) // 10 if n is None else n
    sizes = expected_sizes(available, wanted, n)
    cells = sorted(wanted)
    parts = max(1, -(-sum(available.values()) // PART))
    named = F.broadcast(spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], "domain string, label string, cell int"))
    # a row per target cell: twelve here, bounded by the table of targets
    celled = x.join(named, ["domain", "label"]).select("row_id", "cell")
    drawn = _draw(celled, {i: sizes[c] / available[c] for i, c in enumerate(cells) if available.get(c)}, parts, seed)
    full = taken = _taken(drawn)
    if sum(sizes.values()) > n + 1e-6:
        # minimums that n cannot hold: what they drew flies once more
        scale = n / sum(sizes.values())
        sizes = {c: s * scale for c, s in sizes.items()}
        drawn = _draw(drawn, {i: sizes[c] / taken[i] for i, c in enumerate(cells) if taken.get(i)}, parts, seed + 1000)
        taken = _taken(drawn)
    # the report is made of what was drawn
    lines = []
    for i, c in enumerate(cells):
        share, least = wanted[c]
        have, goal, got = available.get(c, 0), share * n / 100, taken.get(i, 0)
        # the cell has been drawn to its last row and still misses
        lines.append((c[0], c[1], have, goal, least, sizes[c], got, got - goal, full.get(i, 0) >= have and (have * 100 < share * n or have < least)))
    report = spark.createDataFrame(lines, "domain string, sentiment_label string, available long, wanted double, min_rows long, expected double, taken long, residual double, unmet boolean")
    sample = drawn.join(named, "cell").select(F.col("row_id").alias("row_ord"), "domain", F.col("label").alias("sentiment_label"))
    return sample, report
