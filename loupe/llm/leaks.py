"""Problem 9: evaluation texts inside a training corpus, also where numbers, names or units were exchanged.

Every text becomes a sequence of template words: numbers, units and names turn into typed placeholders, decided by the word alone, so
equal words give equal templates wherever they stand. Windows of WIDTH template words of the items are a table, and so are those of the
corpus; they meet in a hash join. Where they meet the words decide: all WIDTH plain words equal is an exact leak, and equal
up to placeholders is a re-parameterised one if the slots are consistent: the same word of the item always faces
the same word of the document, and the other way round; of a matched stretch the longest part counts where they are.

Names are words that never occur in lower case inside an item; the item vocabulary is closed, so a corpus word outside it can only be
somebody else's name, and is one.

Two bit tables of fixed size travel with the tasks, whatever the size of the evaluation set: the ordinary words of the items by hash,
which tells names from words, and the items' windows by hash, which keeps corpus windows out of the join that cannot meet any. Collisions
in the first can only hide a template leak, as equal words have equal templates anyway; those in the second only make the join larger.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.overlap import Words, window_hashes, word_hashes
from loupe.llm.text import plain
from loupe.session import stored

WIDTH = 12
#: Bits of the table of ordinary words and of the table of windows.
WORD_BITS, WINDOW_BITS = 1 << 25, 1 << 27
#: Item tables of so many rows at most are sent to every task; larger ones are shuffled.
FEW = 200_000
#: Words for units of time, money, length, weight and counting.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years euro euros dollar dollars pound pounds cent cents "
    "percent km m cm mm mile miles metre metres meter meters kg g gram grams litre litres star stars step steps time times".split()
)
_NUMBER = re.compile(r"\d+(?:st|nd|rd|th)?\Z|\d[\w]*\Z")
_BLANK = re.compile(r"\S+")
NUM, UNIT, NAME = "\x01", "\x02", "\x03"


def _cased(text: str) -> Iterator[tuple[str, bool, bool]]:
    """(word, whether it stands capitalised inside a sentence, whether it stands in lower case) of a text's words."""
    start = True
    for m in _BLANK.finditer(text):
        raw = m.group()
        upper = raw[:1].isupper()
        for w in plain(raw).split():
            yield w, upper and not start, not upper
        start = raw[-1] in ".!?:\""


def _bits(hashes: DataFrame, size: int) -> np.ndarray:
    """A table of `size` bits with a bit for each of the hashes (h), by its lowest bits; made in parts and joined by the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(size // 8, np.uint8)
        for b in batches:
            at = b["h"].to_numpy(np.int64) & (size - 1)
            np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pd.DataFrame({"bits": [zlib.compress(table.tobytes(), 1)]})

    out = np.zeros(size // 8, np.uint8)
    for r in hashes.coalesce(4).mapInPandas(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(table) * 8 - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Templates(Words):
    """Hashes of the template words of words."""

    def __init__(self, ordinary: np.ndarray):
        super().__init__()
        self.ordinary = ordinary

    def of(self, word: str) -> str:
        """The template word: a placeholder, or the word itself."""
        from xxhash import xxh3_64_intdigest

        if word in UNITS:
            return UNIT
        if _NUMBER.match(word):
            return NUM
        return word if _has(self.ordinary, np.array([xxh3_64_intdigest(word)], np.uint64))[0] else NAME


class Kinds(dict):
    """The template words of words."""

    def __init__(self, templates: Templates):
        super().__init__()
        self.templates = templates

    def __missing__(self, word: str) -> str:
        t = self[word] = self.templates.of(word)
        return t


def _longest_consistent(a: list[str], b: list[str], ta: list[str]) -> int:
    """Words of the longest part, of WIDTH or more, in which every slot filler of one side faces one filler of the other and no more than a quarter of the words are slots; 0 if there is none."""
    slots = [t in (NUM, UNIT, NAME) for t in ta]
    # a part has few enough slots where this does not fall from its start to its end
    level = np.arange(len(ta) + 1) - 4 * np.r_[0, np.cumsum(slots, dtype=np.int64)]
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    held = Counter()
    best, hi = WIDTH - 1, 0
    for lo in range(len(ta)):
        while hi < len(ta) and (not slots[hi] or (there.get(a[hi], b[hi]) == b[hi] and back.get(b[hi], a[hi]) == a[hi])):
            if slots[hi]:
                there[a[hi]], back[b[hi]] = b[hi], a[hi]
                held[a[hi]] += 1
            hi += 1
        good = np.flatnonzero(level[lo + best + 1 : hi + 1] >= level[lo])
        if len(good):
            best += int(good[-1]) + 1
        if slots[lo]:
            held[a[lo]] -= 1
            if not held[a[lo]]:
                del there[a[lo]], back[b[lo]]
    return best if best >= WIDTH else 0


def _longest_equal(a: list[str], b: list[str]) -> int:
    best = run = 0
    for x, y in zip(a, b):
        run = run + 1 if x == y else 0
        best = max(best, run)
    return best


def _ordinary_words(items: DataFrame) -> np.ndarray:
    """The bit table of the items' words that are no names."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, list[bool]] = {}
            for t in b["text"]:
                for w, capital, small in _cased(t):
                    had = seen.setdefault(w, [False, False])
                    had[0] |= capital
                    had[1] |= small
            yield pd.DataFrame([(w, c, s) for w, (c, s) in seen.items()], columns=["word", "capital", "small"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            yield pd.DataFrame({"h": np.array([xxh3_64_intdigest(w) for w in b["word"]], np.uint64).view(np.int64)})

    judged = items.mapInPandas(words, "word string, capital boolean, small boolean").groupBy("word").agg(F.max("capital").alias("capital"), F.max("small").alias("small"))
    ordinary = judged.where(~(F.col("capital") & ~F.col("small") & (F.length("word") > 2)))
    return _bits(ordinary.select("word").mapInPandas(hashed, "h long"), WORD_BITS)


def _runs(places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each row of neighbours."""
    start = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            yield places[start], places[i - 1]
            start = i


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, words, item_share): items that leaked into a document, a row per document, item and kind.

    docs: doc_id, text. items: item_id, item_text. kind exact: at least WIDTH consecutive plain words are equal. kind template: at least
    WIDTH template words are, at least one slot differs, slots are consistent and at most a quarter of the words, and there is no
    exact leak of this item in the document. words: length of the longest stretch; item_share: its share of the item. Null, empty and
    short texts leak nothing; a doc_id that comes twice is reported once, so is an item_id; empty tables give no rows.
    """
    context = docs.sparkSession.sparkContext
    given = items.select(F.col("item_id").cast("long"), F.col("item_text").cast("string").alias("text")).where(F.col("text").isNotNull())
    ordinary = context.broadcast(_ordinary_words(given.select("text")))

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Templates(ordinary.value)
        for b in batches:
            b["words"] = [plain(t) for t in b["text"]]
            b["hashes"] = [window_hashes(word_hashes(w.split(), memo), WIDTH).view(np.int64) for w in b["words"]]
            yield b.loc[b["hashes"].str.len() > 0, ["item_id", "words", "hashes"]]

    entries = stored(given.mapInPandas(item_windows, "item_id long, words string, hashes array<long>").dropDuplicates(["item_id", "words"]))
    windows = entries.select("item_id", F.xxhash64("words").alias("item_name"), F.posexplode("hashes").alias("j", "hash"))
    wanted = context.broadcast(_bits(windows.select(F.col("hash").alias("h")), WINDOW_BITS))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Templates(ordinary.value)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].tolist(), b["text"]):
                words = plain(text).split()
                if len(words) < WIDTH:
                    continue
                hashes = window_hashes(word_hashes(words, memo), WIDTH)
                for lo, hi in _runs(np.flatnonzero(_has(wanted.value, hashes)).tolist()):
                    out.append((doc, lo, " ".join(words[lo : hi + WIDTH]), hashes[lo : hi + 1].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "at", "words", "hashes"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    parts = stored(picked.mapInPandas(stretches, "doc_id long, at int, words string, hashes array<long>"))
    small = windows.count() <= FEW
    sent = F.broadcast if small else lambda table: table
    key = ["doc_id", "at", "name"]
    named = parts.withColumn("name", F.xxhash64("words"))
    met = named.select(*key, F.posexplode("hashes").alias("i", "hash")).join(sent(windows), "hash")
    met = met.groupBy(*key, "item_id", "item_name", (F.col("i") - F.col("j")).alias("shift")).agg(F.sort_array(F.collect_set("i")).alias("places"))
    faced = met.join(named.select(*key, "words").dropDuplicates(key), key)
    faced = faced.join(sent(entries.select("item_id", F.xxhash64("words").alias("item_name"), F.col("words").alias("item_words"))), ["item_id", "item_name"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = Kinds(Templates(ordinary.value)).__getitem__
        for b in batches:
            out = []
            for doc, item, shift, places, mine, theirs in zip(*(b[c].tolist() for c in ("doc_id", "item_id", "shift", "places", "words", "item_words"))):
                mine, theirs = mine.split(), theirs.split()
                exact = template = 0
                for lo, hi in _runs(list(places)):
                    x, y = mine[lo : hi + WIDTH], theirs[lo - shift : hi - shift + WIDTH]
                    kinds = list(map(kind, x))
                    if kinds != list(map(kind, y)):
                        continue  # windows that only have the same hash
                    equal = _longest_equal(x, y)
                    if equal >= WIDTH:
                        exact = max(exact, equal)
                    else:
                        template = max(template, _longest_consistent(y, x, kinds))
                out.append((doc, item, exact, template, len(theirs)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "exact", "template", "n"])

    judged = faced.mapInPandas(judge, "doc_id long, item_id long, exact int, template int, n int").groupBy("doc_id", "item_id")
    best = judged.agg(F.max("exact").alias("exact"), F.max("template").alias("template"), F.max("n").alias("n"))
    words = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("template"))
    kind = F.when(F.col("exact") > 0, "exact").otherwise("template")
    return best.where("exact > 0 OR template > 0").select("doc_id", "item_id", kind.alias("kind"), words.alias("words"), F.round(words / F.col("n"), 6).alias("item_share"))
