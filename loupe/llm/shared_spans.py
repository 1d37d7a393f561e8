"""Problem 10: long exact spans that records share.

Only text that occurs more than once can be shared, so the index is built over that alone. Sampling by content picks, of every run of
consecutive blocks of BLOCK characters that `least` characters hold, the block with the least hash, in all texts alike; every `least`
characters hold a picked block. A block that at least two documents hold sends the passage around it, as far as `least` characters
that hold the block can reach, to the shard of the block's hash. There a compressed FM-index (wavelet matrix over the Burrows-Wheeler
transform) is built over the different passages, and backward search of all passages in step finds the intervals of at least `least`
characters that also occur in a passage of another document. Their union is the shared text, exactly.

Equal passages are pre-aggregated into one, with two of their documents as marks, which is all that "in another document"
asks. A block that very many different passages hold is divided by what stands round it: a shared run goes on for half of the missing
characters on the left or on the right, so passages meet again in smaller groups that agree in more characters; each
halving doubles the copies of such passages at most, and no two groups are paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.fm_index import FMIndex
from loupe.session import cut, stored

LEAST = 200
BLOCK = 96
#: Characters of the passages of one index, about; a block that holds more is divided by what stands round it.
INDEX_CHARS = 1_000_000
#: The bit table of shared blocks has 2 ** MOST_BITS bits at most.
MOST_BITS = 30
#: The columns of a passage's name.
NAMES = ("name", "name2")
#: Documents that are hashed in one piece.
CHUNK = 48
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2 ** 64, and of its inverse."""
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def block_hashes(codes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """A hash of each run of `block` characters: differences of prefix sums of a polynomial, shifted back and mixed."""
    n = len(codes) - block + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(16, (len(codes)).bit_length()))
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= up[: len(codes)]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(h, out=sums[1:])
        out = (sums[block:] - sums[:n]) * down[:n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
    return out * _MULTIPLIER


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value of every run of `width` values; the lowest bits of the values give way to their places."""
    low = np.uint64((1 << 20) - 1)
    n = len(values) - width + 1
    least = (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low)
    size = 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[:n], least[width - size : width - size + n])
    at = np.arange(n)
    return at + (((least & low).astype(np.int64) - at) & int(low))


def anchors(texts: list[str], least: int = LEAST, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, hash) of the picked blocks of texts: any run of `least` characters of a text holds one whole.

    The texts are hashed in one piece. Runs that reach from one text into the next may pick a few blocks more.
    """
    codes = code_points("".join(texts))
    lengths = np.array([len(t) for t in texts], np.int64)
    h = block_hashes(codes, block)
    window = least - block + 1
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.cumsum(lengths)
    inside = np.ones(len(h), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - block + 1) : e] = False
    at = np.unique(_least_places(np.where(inside, h, np.uint64(2**64 - 1)), window))
    at = at[inside[at]]
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - lengths)[text], h[at]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), CHUNK):
            yield b.iloc[i : i + CHUNK]


def _picked_blocks(docs: DataFrame, least: int) -> DataFrame:
    """(hash, doc_id): the picked blocks of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _chunks(batches):
            text, _, h = anchors(b["text"].tolist(), least)
            yield pd.DataFrame({"hash": h.view(np.int64), "doc_id": b["doc_id"].to_numpy()[text]})

    return docs.mapInPandas(run, "hash long, doc_id long")


def _table(common: DataFrame) -> np.ndarray:
    """A bit table of the hashes that occur in two documents, of a size between bounds; collisions only send more passages."""
    from loupe.llm.leaks import _bits

    bits = 1 << min(max(16 * common.count(), 1 << 20).bit_length(), MOST_BITS)
    return _bits(common.select(F.col("hash").alias("h")), bits)


def _passages(docs: DataFrame, least: int, table: np.ndarray) -> DataFrame:
    """(doc_id, hash, at, inner, passage) around every block in the table; inner: the block's place in the passage."""
    from loupe.llm.leaks import _has

    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _chunks(batches):
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            text, place, h = anchors(texts, least)
            here = _has(shared.value, h)
            out = []
            for t, p, x in zip(text[here].tolist(), place[here].tolist(), h[here].view(np.int64).tolist()):
                lo = max(0, p + BLOCK - least)
                out.append((ids[t], x, lo, p - lo, texts[t][lo : p + least]))
            yield pd.DataFrame(out, columns=["doc_id", "hash", "at", "inner", "passage"])

    return docs.mapInPandas(run, "doc_id long, hash long, at int, inner int, passage string")


class Marked:
    """An index with the passage, and so the documents, of each suffix. low, high: two documents of each passage."""

    def __init__(self, flat: np.ndarray, of: np.ndarray, alphabet: int, low: np.ndarray, high: np.ndarray):
        self.index = FMIndex(flat, alphabet)
        owner = np.r_[of, of[-1]][self.index.suffix]
        # a range of suffixes belongs to more than one document if neighbours differ in it or a passage in it has two documents
        lows = low[owner]
        differ, double = np.r_[False, lows[1:] != lows[:-1]], lows != high[owner]
        # counts of both before each place: of neighbours that differ from lo + 1 on, of passages with two documents from lo on
        upto = np.r_[0, np.cumsum(differ.astype(np.int32) + double, dtype=np.int32)]
        self.upto, self.from_lo = upto, upto[:-1] + differ
        self.index.compress()

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        there = hi > lo
        return there & (self.upto.take(hi) > self.from_lo.take(np.where(there, lo, 0)))


def _search(least: int):
    """All passages of a group against the group's index; (name, name2, start, end) of shared intervals within the passages."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        passages = g["passage"].tolist()
        coded = [code_points(p) for p in passages]
        lengths = np.array([len(c) for c in coded], np.int64)
        # symbols in the order of the characters; 1 ends a passage
        known, every = np.unique(np.concatenate(coded), return_inverse=True)
        starts = np.cumsum(lengths + 1) - lengths - 1
        flat = np.ones(int(lengths.sum()) + len(g), np.int64)
        flat[np.arange(len(every)) + np.repeat(np.arange(len(g)), lengths)] = every + 2
        low, high = g["low"].to_numpy(np.int64), g["high"].to_numpy(np.int64)
        of = np.repeat(np.arange(len(g)), lengths + 1)
        left, right = Marked(flat, of, len(known) + 1, low, high), Marked(flat[::-1], of[::-1], len(known) + 1, low, high)

        def reach(rows: np.ndarray, begin: np.ndarray, stop: np.ndarray, by: int) -> np.ndarray:
            """How far, not beyond stop, the text from `begin` on occurs in another document too: to the left (by = -1) or to the right (by = 1)."""
            side = left if by < 0 else right
            at = begin.copy()
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), side.index.n, np.int64)
            live = np.flatnonzero(at != stop)
            while len(live):
                new_lo, new_hi = side.index.step(flat[starts[rows[live]] + at[live] - (by < 0)], lo[live], hi[live])
                good = side.shared(new_lo, new_hi)
                live, new_lo, new_hi = live[good], new_lo[good], new_hi[good]
                lo[live], hi[live] = new_lo, new_hi
                at[live] += by
                live = live[at[live] != stop[live]]
            return at

        out = []
        rows = np.arange(len(g))
        target = g["inner"].to_numpy(np.int64)
        least_end, most_end = target + BLOCK, lengths.copy()
        while len(rows):
            # the greatest end up to which the text from `target` is shared, then the least start of what is shared up to there
            end = reach(rows, target, most_end, 1)
            on = end >= least_end
            rows, target, end, least_end = rows[on], target[on], end[on], least_end[on]
            start = reach(rows, end, np.zeros(len(rows), np.int64), -1)
            long = end - start >= least
            out += list(zip(rows[long].tolist(), start[long].tolist(), end[long].tolist()))
            # another document may go further to the left with an earlier end
            on = (start > 0) & (end - 1 >= least_end)
            rows, target, most_end, least_end = rows[on], start[on] - 1, end[on] - 1, least_end[on]
        found = np.array(out, np.int64).reshape(-1, 3)
        names = {c: g[c].to_numpy(np.int64)[found[:, 0]] for c in NAMES}
        return pd.DataFrame(names | {"start": found[:, 1], "end": found[:, 2]})

    return run


def shared_intervals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end): intervals of at least `least` characters that another document also has.

    They overlap; their union is all of the document that lies in such intervals.

    docs: doc_id, text. Null and shorter texts share nothing. Characters are Unicode code points, compared exactly. A doc_id that
    comes twice counts as one document: its rows are no "other" document to each other. Empty tables give no rows.
    """
    if least < BLOCK:
        raise ValueError(f"spans of fewer than {BLOCK} characters are not searched")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.length("text") >= least)
    ends = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    common = stored(_picked_blocks(texts, least).groupBy("hash").agg(*ends).where("low <> high").select("hash"))
    found = _passages(texts, least, _table(common))
    # the 128-bit name of a passage and its block
    named = found.withColumn("name", F.xxhash64("passage", "inner", "hash")).withColumn("name2", F.xxhash64(F.lit(1), "hash", "inner", "passage"))
    found = stored(named)
    # equal passages meet once, with two documents as marks; pre-aggregated before the shuffle
    merged = stored(found.groupBy("hash", "inner", "passage", *NAMES).agg(*ends))
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = merged.withColumn("key", F.col("hash")).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    wide = least - BLOCK
    ready, whole = [], []
    while True:
        # a block that other documents don't hold can share nothing
        sizes = group.groupBy("key").agg(F.sum(F.length("passage") + 1).alias("chars"), F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("key", "chars")
        group = cut(group.join(sizes, "key"))
        ready.append(group.where(F.col("chars") <= INDEX_CHARS))
        large = group.where(F.col("chars") > INDEX_CHARS).drop("chars")
        # all passages of a group that agree in `least` characters share these
        whole.append(large.where(F.col("i") + F.col("j") >= wide).select(*NAMES, (F.col("inner") - F.col("i")).alias("start"), (F.col("inner") + BLOCK + F.col("j")).alias("end")))
        large = large.where(F.col("i") + F.col("j") < wide)
        if large.isEmpty():
            break
        # a run of `least` characters round the block goes on for half of what is missing on the left, or on the right
        half = F.ceil((wide - F.col("i") - F.col("j")) / 2).cast("int")
        more = F.explode(F.array(F.struct((F.col("i") + half).alias("i"), F.col("j")), F.struct(F.col("i"), (F.col("j") + half).alias("j")))).alias("more")
        group = large.select("hash", "inner", "passage", *NAMES, "low", "high", more).select("*", "more.i", "more.j").drop("more")
        group = group.where((F.col("inner") >= F.col("i")) & (F.col("inner") + BLOCK + F.col("j") <= F.length("passage"))).dropDuplicates([*NAMES, "i", "j"])
        around = F.substring(F.col("passage"), F.col("inner") - F.col("i") + 1, F.col("i") + F.col("j") + BLOCK)
        group = group.withColumn("key", F.xxhash64("hash", "i", "j", around))
    several = reduce(DataFrame.unionByName, ready)
    total = several.agg(F.sum(F.length("passage") + 1)).first()[0] or 0
    shards = max(parts, int(total // INDEX_CHARS) + 1)
    body = several.select(F.pmod("key", F.lit(shards)).alias("shard"), "passage", "inner", "low", "high", *NAMES)
    searched = body.repartition(3 * shards, "shard").groupBy("shard").applyInPandas(_search(least), "name long, name2 long, start int, end int")
    spans = reduce(DataFrame.unionByName, whole, searched).groupBy(*NAMES, "start").agg(F.max("end").alias("end"))
    back = found.select("doc_id", "at", *NAMES).join(spans, list(NAMES))
    return back.select("doc_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")).distinct()


def shared_coverage(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share, spans): how much of each document is shared elsewhere; documents that share nothing have no row."""
    spans = shared_intervals(docs, least).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    # intervals in order of their start: what each adds beyond the furthest end so far
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], x["end"]).alias("upto"),
        (acc["spans"] + F.when(x["start"] > acc["upto"], 1).otherwise(0)).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("upto"), F.lit(0).alias("spans"))
    summed = spans.select("doc_id", F.aggregate("s", zero, step).alias("r"))
    lengths = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.length("text")).alias("n_chars"))
    return lengths.join(summed, "doc_id").select("doc_id", "n_chars", F.col("r.n").alias("shared_chars"), F.round(F.col("r.n") / F.col("n_chars"), 6).alias("share"), F.col("r.spans").alias("spans"))
