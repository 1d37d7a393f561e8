"""Problem 7: text that was read with a wrong character encoding.

Words with characters beyond ASCII are scored by character trigrams, smoothed and without case, of the clean words of the same corpus: as
they stand, and after each encode-decode chain that they survive, which is every pair of the encodings listed below. For every chain the
stretches of words with the greatest total gain count, any number of them in a text, and the text is repaired there if the gain is beyond a
margin; where stretches of several chains meet, the likeliest has its words first. A stretch may be one word or the whole text, so text that is
damaged in places only is found as well. The margin is validated on all clean words, as they are and garbled on purpose by every chain: clean words stay as
they are. A replacement character always marks damage that cannot be undone.

The model is of fixed size (BUCKETS hashed trigram counts and a count for each of 65,536 characters), whatever the corpus.
Counting is done in every partition and summed; the arrays alone are sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.session import cut

BUCKETS = 1 << 18
#: Gains are counted in so many steps to 1, up to so much on either side of 0.
STEPS, MOST_GAIN = 1000, 200
#: Of each hundred clean words this many at most may be taken for garbled.
MOST_FALSE_PERCENT = 0.05
REPLACEMENT = chr(0xFFFD)
#: A word, with the no-break spaces that a wrong encoding puts into it.
_WORD = re.compile("[^ \t\n\r\x0b\x0c]*[^\x00-\x7f][^ \t\n\r\x0b\x0c]*")
_CONTROL = re.compile(r"[\x80-\x9f]")
_ACCENTED = re.compile(r"(?<!\S)[%s-%s]{3,}(?!\S)" % (chr(0xC0), chr(0xFF)))
_CAPITALS, _SMALL = re.compile("[А-Я]"), re.compile("[а-я]")
_MIXED = re.compile("[a-z][А-яё]|[А-яё][a-z]")
_DIGITS = re.compile(r"\d+")
#: Encodings that text is read with, and those it may have been written in, with their usual names.
READ_AS = {"cp1252": "windows-1252", "latin-1": "latin-1", "cp1250": "windows-1250", "cp1251": "windows-1251", "mac_roman": "mac-roman", "cp437": "cp437", "koi8-r": "koi8-r"}
WRITTEN_IN = {"utf-8": "utf-8", "cp1251": "windows-1251", "koi8-r": "koi8-r", "cp1252": "windows-1252", "cp1250": "windows-1250", "mac_roman": "mac-roman", "cp437": "cp437", "cp866": "cp866", "shift_jis": "shift-jis"}
#: (name, the encoding it was read with, the encoding it was written in): every pair of different encodings.
CHAINS: list[tuple[str, str, str]] = [(f"{WRITTEN_IN[w]} as {READ_AS[r]}", r, w) for w in WRITTEN_IN for r in READ_AS if r != w and (r, w) != ("latin-1", "cp1252")]
#: Margins are never below these: for chains from UTF-8, for single-byte chains.
LEAST_MARGIN = (2.0, 8.0)
#: Characters beyond ASCII that a stretch of a single-byte chain must have.
LEAST_LETTERS = 6
#: Chains that may follow each other: text that was garbled twice.
DEPTH = 2


def _encode(text: str, encoding: str) -> bytes | None:
    """Bytes of a text in a single-byte encoding; control characters stand for the bytes that the encoding leaves undefined."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) <= 0x9F:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _legible(read_as: str, written_in: str, text: str) -> bool:
    """Whether a reading is text at all: it has no control characters, and what comes from UTF-8 holds more than spaces beyond ASCII."""
    if written_in == "utf-8":
        return read_as in ("cp1252", "latin-1") or any(not c.isascii() and not c.isspace() for c in text)
    return all(c.isprintable() or c.isspace() for c in text)


RECASED = "utf-8 after a change of case"


def readings(word: str, depth: int = DEPTH) -> dict[str, tuple[str, ...]]:
    """Texts that may stand behind a word, with the chains that lead there; the shortest chain for each."""
    found: dict[str, tuple[str, ...]] = {word: ()}
    edge = [word]
    # a later change of case also changed the letters that stand for bytes
    for changed in (_recased(word, str.upper), _recased(word, str.lower)):
        if changed not in found:
            found[changed] = (RECASED,)
            edge.append(changed)
    for step in range(depth):
        following = []
        for w in edge:
            raws = {r: _encode(w, r) for r in READ_AS}
            for name, read_as, written_in in CHAINS:
                if (step or found[w]) and written_in != "utf-8":
                    continue
                raw = raws[read_as]
                if raw is None:
                    continue
                try:
                    new = raw.decode(written_in)
                except UnicodeDecodeError:
                    continue
                if new not in found and _legible(read_as, written_in, new):
                    found[new] = (*found[w], name)
                    # only what came from UTF-8 is followed further: single-byte chains lead from every word to every other
                    if written_in == "utf-8":
                        following.append(new)
        edge = following
    return {r: names for r, names in found.items() if names not in ((), (RECASED,))}


def unchanged(word: str) -> list[str]:
    """The single-byte chains that leave a word as it is."""
    out = []
    raws = {r: _encode(word, r) for r in READ_AS}
    for name, read_as, written_in in CHAINS:
        raw = raws[read_as]
        if raw is not None and written_in != "utf-8":
            try:
                if raw.decode(written_in) == word:
                    out.append(name)
            except UnicodeDecodeError:
                pass
    return out


def _recased(word: str, case) -> str:  # noqa: ANN001
    return "".join(c if c.isascii() or len(case(c)) != 1 else case(c) for c in word)


def garble(word: str, name: str) -> str | None:
    """A word read with the wrong encoding of a chain; None if it cannot be."""
    read_as, written_in = next((r, w) for n, r, w in CHAINS if n == name)
    try:
        raw = word.encode(written_in)
    except UnicodeEncodeError:
        return None
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(read_as))
        except UnicodeDecodeError:
            out.append(chr(b))
    made = "".join(out)
    return made if made != word else None


def _bare(word: str) -> str:
    return "\x02" + _DIGITS.sub("0", word.lower()) + "\x03"


def _slots(word: str) -> list[tuple[int, int]]:
    """Hashed places of a word's trigrams and of the pairs before their last characters."""
    from xxhash import xxh3_64_intdigest

    w = _bare(word)
    return [(xxh3_64_intdigest(w[i : i + 3]) % BUCKETS, xxh3_64_intdigest("\x00" + w[i : i + 2]) % BUCKETS) for i in range(len(w) - 2)]


def _single(word: str) -> list[int]:
    """Places of a word's single characters, for the backing-off."""
    return [BUCKETS + min(ord(ch), 0xFFFF) for ch in _bare(word)[2:]]


class TrigramModel:
    """log P(word) by interpolated trigrams over hashed counts."""

    SIZE = BUCKETS + 0x10000

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float64)
        self.total = max(1.0, float(self.counts[BUCKETS:].sum()))
        self.memo: dict[str, float] = {}

    def _part(self, t: str) -> float:
        from xxhash import xxh3_64_intdigest

        c3, c2 = self.counts[xxh3_64_intdigest(t) % BUCKETS], self.counts[xxh3_64_intdigest("\x00" + t[:2]) % BUCKETS]
        # a character that no clean word has is next to impossible
        p1 = (self.counts[BUCKETS + min(ord(t[2]), 0xFFFF)] + 1e-3) / (self.total + 65.536)
        return float(np.log((c3 + 5.0 * p1) / (c2 + 5.0)))

    def score(self, word: str) -> float:
        w, memo, total = _bare(word), self.memo, 0.0
        for i in range(len(w) - 2):
            t = w[i : i + 3]
            p = memo.get(t)
            if p is None:
                if len(memo) > 500_000:
                    memo.clear()
                p = memo[t] = self._part(t)
            total += p
        return total


def _odd_script(text: str) -> bool:
    """Many words of accented Latin letters alone, of Latin and Cyrillic letters, or more Cyrillic capitals than small letters: a single-byte chain may be behind it."""
    if len(_ACCENTED.findall(text)) > 2 or _MIXED.search(text):
        return True
    capitals = len(_CAPITALS.findall(text))
    return capitals > 0 and capitals > len(_SMALL.findall(text))


def _clean_word(w: str) -> bool:
    if _CONTROL.search(w):
        return False
    for _, read_as, written_in in CHAINS:
        if written_in == "utf-8":
            raw = _encode(w, read_as)
            if raw is not None and not raw.isascii():
                try:
                    raw.decode("utf-8")
                    return False
                except UnicodeDecodeError:
                    pass
    return True


def looks_clean(text: str, memo: dict[str, bool]) -> bool:
    """No replacement or control character, no odd script, and no word that is well-formed UTF-8 behind a single-byte encoding."""
    if REPLACEMENT in text or _odd_script(text):
        return False
    for w in _WORD.findall(text):
        good = memo.get(w)
        if good is None:
            if len(memo) > 200_000:
                memo.clear()
            good = memo[w] = _clean_word(w)
        if not good:
            return False
    return True


def train(texts: DataFrame) -> tuple[TrigramModel, tuple[float, float]]:
    """The model of the clean words of all rows of `texts` (text), and the validated margins."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        sums = np.zeros(TrigramModel.SIZE, np.int64)
        seen: dict[str, int] = {}
        judged: dict[str, bool] = {}

        def add() -> pd.DataFrame:
            for word, n in seen.items():
                for a, b in _slots(word):
                    sums[[a, b]] += n
                for a in _single(word):
                    sums[a] += n
            words = pd.DataFrame({"slot": np.full(len(seen), -1), "n": np.fromiter(seen.values(), np.int64, len(seen)), "word": pd.Series(list(seen), dtype=object)})
            seen.clear()
            return words

        for b in batches:
            for t in b["text"]:
                if t and not t.isascii() and looks_clean(t, judged):
                    for w in _WORD.findall(t):
                        seen[w] = seen.get(w, 0) + 1
            if len(seen) > 200_000:
                yield add()
        yield add()
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"slot": at, "n": sums[at], "word": pd.Series([""] * len(at), dtype=object)})

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "slot long, n long, word string")
    summed = cut(counted.groupBy("slot", "word").agg(F.sum("n").alias("n")))
    # at most SIZE sums reach the driver
    sums = np.zeros(TrigramModel.SIZE, np.int64)
    frame = summed.where("slot >= 0").select("slot", "n").toPandas()
    sums[frame["slot"].to_numpy(np.int64)] = frame["n"].to_numpy(np.int64)
    model = TrigramModel(sums)
    return model, validated_margin(model, summed.where("slot < 0").select("word"))


def family(chains: tuple[str, ...]) -> int:
    """0: all chains come from UTF-8, which few other texts survive; 1: single-byte chains, which every text survives."""
    return int(not all(c.startswith("utf-8") for c in chains))


def gains(model: TrigramModel, word: str) -> dict[tuple[str, ...], tuple[float, str]]:
    """By chains: how much likelier the reading is than the word as it stands, and the reading."""
    own = model.score(word)
    out = {names: (model.score(other) - own - (len(names) - 1), other) for other, names in readings(word).items()}
    # a word that a chain doesn't touch speaks neither for it nor against it
    return out | {(name,): (0.0, word) for name in unchanged(word)}


def trials(model: TrigramModel, word: str) -> tuple[tuple[float, float], list[tuple[int, float]]]:
    """Of a clean word, for each family the greatest gain of any reading; of the word garbled by each chain, (family, gain of the word)."""
    best = [-float(MOST_GAIN)] * 2
    for names, (g, _) in gains(model, word).items():
        best[family(names)] = max(best[family(names)], g)
    own, spoilt = model.score(word), []
    for name, read_as, written_in in CHAINS:
        made = garble(word, name)
        raw = _encode(made, read_as) if made else None
        if raw is not None:
            try:
                undone = raw.decode(written_in)
            except UnicodeDecodeError:
                continue
            if undone == word and _legible(read_as, written_in, word):
                spoilt.append((family((name,)), own - model.score(made)))
    return (best[0], best[1]), spoilt


def _quantile(steps: np.ndarray, n: np.ndarray, share: float) -> float:
    """The least gain that at least `share` of all have at most. steps: gains in order, in steps; n: how many of each."""
    upto = np.cumsum(n)
    return float(steps[min(int(np.searchsorted(upto, share * upto[-1])), len(steps) - 1)]) / STEPS


def validated_margin(model: TrigramModel, words: DataFrame) -> tuple[float, float]:
    """For each family: above the gains of all but few clean words, and as far below those of garbled words as these allow.

    words: every different clean word (word). Their gains are counted where they are; the counts alone reach the driver, at most two for each step.
    """
    shared = words.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = TrigramModel(shared.value)
        counts: dict[tuple[bool, int, int], int] = {}

        def count(clean: bool, of: int, gain: float) -> None:
            # a clean word's gain is rounded up, a garbled one's down
            step = round(max(-MOST_GAIN, min(gain, MOST_GAIN)) * STEPS + (0.5 if clean else -0.5))
            counts[clean, of, step] = counts.get((clean, of, step), 0) + 1

        for b in batches:
            for w in b["word"]:
                best, spoilt = trials(judge, w)
                for of in (0, 1):
                    count(True, of, best[of])
                for of, g in spoilt:
                    count(False, of, g)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["clean", "family", "step", "n"])

    parts = max(12, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = words.repartition(parts, "word").mapInPandas(run, "clean boolean, family int, step int, n long")
    every = counted.groupBy("clean", "family", "step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
    out = []
    for f in (0, 1):
        clean, spoilt = (every[(every["clean"] == c) & (every["family"] == f)] for c in (True, False))
        low = _quantile(clean["step"].to_numpy(), clean["n"].to_numpy(), 1 - MOST_FALSE_PERCENT / 100) if len(clean) else 0.0
        low = max(low, 0.0)
        high = _quantile(spoilt["step"].to_numpy(), spoilt["n"].to_numpy(), 0.02) if len(spoilt) else low + 8.0
        out.append(max(LEAST_MARGIN[f], low + 1.0, min((low + high) / 2, 10.0)))
    return out[0], out[1]


def _best_stretch(values: list[float]) -> tuple[float, int, int]:
    """Total, start and end of the stretch with the greatest total."""
    best, lo, hi = 0.0, 0, 0
    run, start = 0.0, 0
    for i, v in enumerate(values):
        if run <= 0:
            run, start = 0.0, i
        run += v
        if run > best:
            best, lo, hi = run, start, i + 1
    return best, lo, hi


def _all_stretches(values: list[float], margin: float) -> list[tuple[float, int, int]]:
    """Total, start and end of the best stretch, then of the best ones on either side of it, and so on while they are beyond the margin."""
    out, todo = [], [(0, len(values))]
    while todo:
        a, b = todo.pop()
        total, lo, hi = _best_stretch(values[a:b])
        if total > margin:
            out.append((total, a + lo, a + hi))
            todo += [(a, a + lo), (a + hi, b)]
    return out


def find_garbled(rows: DataFrame, model: TrigramModel | None = None, margin: tuple[float, float] | None = None) -> DataFrame:
    """(row_ord, restored, chains, lost): the garbled rows of `rows` (row_ord, text).

    restored: the text with every garbled word replaced by its likeliest reading. lost: replacement characters stay, so the original
    is not fully restored. chains: names of the repairs, sorted, `; ` between them. Null, empty and ASCII texts are never garbled. Repeated
    rows are each reported; extra columns are left out; empty tables give no rows.
    """
    if model is None or margin is None:
        model, margin = train(rows)
    shared = rows.sparkSession.sparkContext.broadcast((model.counts.astype(np.float32), margin))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, margins = shared.value
        judge = TrigramModel(counts)
        memo: dict[str, dict[tuple[str, ...], float]] = {}

        def of(word: str) -> dict[tuple[str, ...], float]:
            key = _DIGITS.sub("0", word)
            if key not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[key] = {names: g for names, (g, _) in gains(judge, key).items()}
            return memo[key]

        def enough(text: str, spots: list[tuple[int, int]], scored: list[dict[tuple[str, ...], float]], names: tuple[str, ...], words: Iterable[int]) -> bool:
            # a single-byte chain shows only in several characters, of words that it changes
            return not family(names) or sum(not c.isascii() for i in words if scored[i].get(names) for c in text[spots[i][0] : spots[i][1]]) >= LEAST_LETTERS

        def repair(text: str) -> tuple[str, set[str]]:
            spots = [m.span() for m in _WORD.finditer(text)]
            scored = [of(text[lo:hi]) for lo, hi in spots]
            hopeful = {names for s in scored for names, g in s.items() if g > 0}
            accepted: list[tuple[float, tuple[str, ...], int, int]] = []
            for names in hopeful:
                values = [max(-8.0, s.get(names, -8.0)) for s in scored]
                accepted += [(t, names, x, y) for t, x, y in _all_stretches(values, margins[family(names)]) if enough(text, spots, scored, names, range(x, y))]
            # the likeliest stretch has its words; another one is judged by what is left to it
            new: dict[int, tuple[str, tuple[str, ...]]] = {}
            for total, names, lo, hi in sorted(accepted, key=lambda a: (-a[0], a[1], a[2])):
                free = [i for i in range(lo, hi) if i not in new]
                if len(free) < hi - lo:
                    left = sum(max(-8.0, scored[i].get(names, -8.0)) for i in free)
                    if left <= margins[family(names)] or not enough(text, spots, scored, names, free):
                        continue
                for i in free:
                    g = scored[i].get(names, -8.0)
                    # inside a stretch of a single-byte chain short words are read as their neighbours are
                    if g > 0 or (family(names) and g > -6):
                        word = text[spots[i][0] : spots[i][1]]
                        reading = next((r for r, n in readings(word).items() if n == names), None)
                        if reading is not None:
                            new[i] = (reading, names)
            out, at = [], 0
            for i in sorted(new):
                out += [text[at : spots[i][0]], new[i][0]]
                at = spots[i][1]
            return "".join([*out, text[at:]]), {c for _, names in new.values() for c in names}

        for b in batches:
            out = []
            for row, text in zip(b["row_ord"].tolist(), b["text"]):
                if not text or text.isascii():
                    continue
                fixed, used = repair(text)
                lost = REPLACEMENT in text
                if used or lost:
                    out.append((row, fixed, "; ".join(sorted(used)), lost))
            yield pd.DataFrame(out, columns=["row_ord", "restored", "chains", "lost"])

    picked = rows.select(F.col("row_ord").cast("long"), F.col("text").cast("string").alias("text"))
    return picked.mapInPandas(run, "row_ord long, restored string, chains string, lost boolean")
