"""Problem 5: the same or nearly the same text in train and in another split.

Two texts count as near if at most one plain word in five of the longer one is changed, added or dropped (edit distance over
words). Exact copies are collapsed first, so a group of copies is scanned once and expanded only in the result.

The passages of the evaluation texts are the patterns of Aho-Corasick automata. An evaluation text of n words has at most n // 4 edits
to any near text, however long that is, and an edit touches one passage of several that don't overlap. So each text is
divided into n // 4 + 1 passages of 2 to 6 words. With k edits at least n // 4 + 1 - k passages are left whole, wherever the edits
are, and these are found in the other text: the scan loses no pair, however common a passage is. Counts over all training texts decide
where the passages' borders lie, so that they are rare.

Evaluation texts, in the order of their length, are shared out to shards of bounded size. The automaton of a shard scans every training text that isn't too
short or too long for the shard, many texts in step. Found passages lead to the evaluation texts that have them among their k + 1 rarest. Matched intervals of one evaluation text in one training text are merged into
its coverage; pairs that are covered in enough passages, at places that few enough edits can explain, are settled by a
banded edit distance on the spot, as the shard holds the evaluation texts too. The passages matched in any training text
give the coverage of each evaluation record.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.text import MIN_WORDS, plain
from loupe.session import stored

#: Least and most words of a passage.
NARROW, WIDE = 2, 6
#: How far the end of a passage may be from where equal passages would end.
SWAY = 3
#: Words of the evaluation texts of one shard, about; a text is never divided.
SHARD_WORDS = 8_000_000
#: Shards whose automata are sent out together.
ROUND = 2
#: Training texts that are worked on at once.
CHUNK = 500
#: Training texts that go through an automaton in step.
STEP = 4_000
#: The counters that the training texts' passages share, and how many of them are added up together.
SLOTS, BLOCK_OF_COUNTS = 1 << 20, 1 << 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of words, and the words' 64-bit hashes by number. Emptied when it has grown large."""

    MOST = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.table = np.empty(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        n = len(self)
        if n == len(self.table):
            self.table = np.r_[self.table, np.empty(n, np.uint64)]
        self.table[n] = xxh3_64_intdigest(self.of(word))
        self[word] = n
        return n

    def of(self, word: str) -> str:
        """What is hashed for a word."""
        return word


def word_hashes(words: list[str], memo: Words) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(memo) > memo.MOST:
        memo.clear()
    at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    return memo.table[at]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * _MULTIPLIER + hashes[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _slots(hashes: np.ndarray, width: int) -> np.ndarray:
    """The counter of each run of `width` words."""
    return (window_hashes(hashes, width) & np.uint64(SLOTS - 1)).astype(np.int64)


def most_edits(n: np.ndarray) -> np.ndarray:
    """Most edits between a text of n words and a near text of any length: its partner has up to 5 * (n // 4) + n % 4 words."""
    return n // 4


def borders(lengths: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the passages, text by text: of each most_edits() + 1 that don't overlap, with the least sum of counts.

    lengths: words of each text. hashes: the word hashes of all texts, one after the other. counts: by width and counter. The end of
    passage j stays within SWAY words of j equal parts of the text, so the work is linear.
    """
    total = len(hashes)
    far = np.float32(1e18)
    cost = np.full((WIDE + 1, total + WIDE + 1), far, np.float32)
    for w in range(NARROW, WIDE + 1):
        at = _slots(hashes, w)
        # one is added, so that fewer common words are better than none at all being known
        cost[w, : len(at)] = counts[w][at].astype(np.float32) + 1.0 / w
    base = np.cumsum(lengths) - lengths
    pieces = most_edits(lengths) + 1
    order = np.argsort(-pieces, kind="stable")
    n, p, b = lengths[order], pieces[order], base[order]
    sway = np.arange(-SWAY, SWAY + 1)
    rows = len(order)
    # best[t, s]: least cost with passages so far whose last ends no later than the s-th place of its range
    best = np.zeros((rows, len(sway)), np.float32)
    ends_before = np.zeros((rows, len(sway)), np.int64)
    chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(1, int(p[0]) + 1 if rows else 1):
        live = int(np.searchsorted(-p, -j, side="right"))
        middle = (j * n[:live]) // p[:live]
        end = np.minimum(middle[:, None] + sway, n[:live, None])
        value = np.full((live, len(sway)), far, np.float32)
        start_of = np.zeros((live, len(sway)), np.int64)
        from_of = np.zeros((live, len(sway)), np.int64)
        first = ends_before[:live, 0]
        for w in range(NARROW, WIDE + 1):
            start = end - w
            # the place in the range of the passage before: it ends no later than this one starts
            slot = start - first[:, None] if j > 1 else np.where(start >= 0, len(sway) - 1, -1)
            known = (slot >= 0) & (start >= 0)
            slot = np.clip(slot, 0, len(sway) - 1)
            v = np.where(known, np.take_along_axis(best[:live], slot, 1) + cost[w][np.maximum(0, b[:live, None] + start)], far)
            better = v < value
            value = np.where(better, v, value)
            start_of = np.where(better, start, start_of)
            from_of = np.where(better, slot, from_of)
        # ends no later: carry the best from left to right
        carried = np.zeros((live, len(sway)), np.int64)
        for s in range(1, len(sway)):
            worse = value[:, s] > value[:, s - 1]
            carried[:, s] = np.where(worse, carried[:, s - 1], s)
            value[:, s] = np.where(worse, value[:, s - 1], value[:, s])
        best[:live], ends_before[:live] = value, middle[:, None] - SWAY
        chosen.append((start_of, end, from_of * 16 + carried))
    flat = np.cumsum(pieces) - pieces
    where = flat[order]
    starts, ends = np.empty(int(pieces.sum()), np.int64), np.empty(int(pieces.sum()), np.int64)
    slot = np.full(rows, len(sway) - 1)
    for j in range(len(chosen), 0, -1):
        start_of, end, link = chosen[j - 1]
        at = np.arange(len(end))
        s = link[at, slot[: len(end)]] % 16
        starts[where[: len(end)] + j - 1], ends[where[: len(end)] + j - 1] = start_of[at, s], end[at, s]
        slot[: len(end)] = link[at, s] // 16
    return starts, ends


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance over words in a band of `most` on either side; most + 1 if it is larger."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    if most == 0:
        return 1
    far = most + 1
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        row[0] = i if i <= most else far
        x = a[i - 1]
        for j in range(lo, hi + 1):
            best = last[j - 1] + (x != b[j - 1])
            if last[j] + 1 < best:
                best = last[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            row[j] = best
        if min(row[lo - 1 : hi + 1]) > most:
            return far
        last = row
    return min(last[m], far)


def settle(a: list, b: list, most: int) -> int:
    """edit_distance(), but texts whose words alone differ too much are not compared in order."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    count: dict = {}
    for w in a:
        count[w] = count.get(w, 0) + 1
    common = 0
    for w in b:
        n = count.get(w, 0)
        if n:
            count[w] = n - 1
            common += 1
    return most + 1 if max(len(a), len(b)) - common > most else edit_distance(a, b, most)


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) & 255


class Numbers(dict):
    """Numbers of words in the order of their coming."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Lookup:
    """Where each of many 64-bit keys stands in an array of different keys: buckets by the keys' mixed bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.order, self.keys = order.astype(np.int32), keys[order]
        self.first = np.r_[0, np.cumsum(np.bincount(bucket, minlength=1 << bits))].astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        bucket = self._bucket(keys)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at < end)
        at, end, keys = at[live], end[live], keys[live]
        while len(live):
            same = self.keys[at] == keys
            out[live[same]] = self.order[at[same]]
            on = np.flatnonzero(~same & (at + 1 < end))
            live, at, end, keys = live[on], at[on] + 1, end[on], keys[on]
        return out


class Automaton:
    """An Aho-Corasick automaton whose symbols are numbers of words; many texts go through it in step."""

    #: The last 2 ** MEMO steps, about, are known.
    MEMO = 21

    def __init__(self, rows: np.ndarray, widths: np.ndarray, vocabulary: int):
        """The trie. rows: the words of each passage, one passage a row; repeats are allowed. `passage` numbers the different ones."""
        self.vocabulary = vocabulary
        node = np.zeros(len(rows), np.int64)
        self.levels: list[np.ndarray] = []
        self.size = 1
        for depth in range(rows.shape[1]):
            on = np.flatnonzero(widths > depth)
            keys, of = np.unique(node[on] * vocabulary + rows[on, depth], return_inverse=True)
            node[on] = self.size + of
            self.levels.append(keys)
            self.size += len(keys)
        ends, self.passage = np.unique(node, return_inverse=True)
        #: the passage that ends at each node, -1 if none does
        self.ending = np.full(self.size, -1, np.int32)
        self.ending[ends] = np.arange(len(ends))

    def build(self) -> None:
        """The failure links, and for each node the next one on its way back at which a passage ends."""
        # nodes are numbered by depth, then by parent and word, so a node's number is the place of its key
        self.forward = Lookup(np.concatenate(self.levels).astype(np.uint64))
        self.failure, self.link = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        first = 1
        for depth, keys in enumerate(self.levels):
            nodes = slice(first, first + len(keys))
            if depth:
                back = self.step(self.failure[keys // self.vocabulary].astype(np.int64), keys % self.vocabulary)
                self.failure[nodes] = back
                self.link[nodes] = np.where(self.ending[back] >= 0, back, self.link[back])
            first += len(keys)
        self.levels = []
        self.output = np.where(self.ending >= 0, np.arange(self.size), self.link).astype(np.int32)
        self.taken, self.taken_to = np.full(1 << self.MEMO, -1, np.int64), np.zeros(1 << self.MEMO, np.int32)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after a word, along failure links where there is no way forward."""
        out = np.zeros(len(state), np.int64)
        live = np.arange(len(state))
        while len(live):
            at = self.forward.find((state * self.vocabulary + word).astype(np.uint64))
            out[live] = at + 1
            on = np.flatnonzero((at < 0) & (state > 0))
            live, state, word = live[on], self.failure[state[on]].astype(np.int64), word[on]
        return out

    def known_step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """step(), by a table of the last steps that were taken."""
        way = state * self.vocabulary + word
        slot = ((way.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.MEMO)).astype(np.int64)
        out = self.taken_to[slot].astype(np.int64)
        new = np.flatnonzero(self.taken[slot] != way)
        if len(new):
            out[new] = self.step(state[new], word[new])
            self.taken[slot[new]] = way[new]
            # of several ways with one slot one stays, and its end has to be of the same way
            last = new[self.taken[slot[new]] == way[new]]
            self.taken_to[slot[last]] = out[last]
        return out

    def run(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the last word, passage) of all passages in texts, which begin in `flat` at `first`."""
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        state = np.zeros(len(order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, side="left"))
            word = flat[first[:live] + i].astype(np.int64)
            known = np.flatnonzero((word >= 0) & (word < self.vocabulary))
            before = state[known]
            state[:live] = 0
            state[known] = self.known_step(before, word[known])
            node = self.output[state[:live]]
            hit = np.flatnonzero(node)
            node = node[hit]
            while len(hit):
                found.append((order[hit], np.full(len(hit), i), self.ending[node]))
                node = self.link[node]
                on = np.flatnonzero(node)
                hit, node = hit[on], node[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        text, end, passage = (np.concatenate(x) for x in zip(*found))
        by_text = np.argsort(text, kind="stable")
        return text[by_text], end[by_text], passage[by_text].astype(np.int64)


#: Texts that are numbered have so many places without a word between them.
MARGIN = 1


def _places(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """np.searchsorted(), with what is wanted in order: neighbours are found near each other."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(values, wanted[order])
    return out


class Shard:
    """Some evaluation texts and the automaton of their passages.

    With k edits at least pieces - k passages are whole, so one of the k + 1 that fewest evaluation texts share is. A text is entered under its
    passages in that order, and looked up under the first k + 1 of them, as the length of the other text allows; whole ones are then counted in all.
    """

    #: Meetings of passages with their evaluation texts that are looked at together, about.
    BLOCK = 1 << 18
    #: Words that training texts have besides, which are numbered until they are so many.
    MORE = 500_000

    def __init__(self, ids: np.ndarray, texts: list[str], starts: np.ndarray, ends: np.ndarray):
        """starts, ends: of the passages of all texts, one text after the other, as borders() gives them."""
        self.ids = ids
        self.numbers = Numbers()
        self.flat, self.first, self.n = self._numbered(texts)
        self.vocabulary = len(self.numbers)
        self.bits = np.array([_bit(w) for w in self.numbers], np.uint8)
        self.picture = self._picture(self.flat, self.n)
        self.pieces = most_edits(self.n) + 1
        self.owner = np.repeat(np.arange(len(texts)), self.pieces).astype(np.int32)
        self.begin = np.cumsum(self.pieces) - self.pieces
        self.width, self.place = (ends - starts).astype(np.int32), starts.astype(np.int32)
        column = np.arange(WIDE)
        where = (self.first[self.owner] + starts)[:, None] + np.minimum(column, self.width[:, None] - 1)
        self.automaton = Automaton(self.flat[where], self.width, max(1, self.vocabulary))
        #: the passage that each piece is, and how many pieces each passage is
        self.passage = self.automaton.passage
        self.holders = np.bincount(self.passage)
        #: passages that some training text has had
        self.seen = np.zeros(len(self.holders), bool)

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers of all texts with margins of -1, where each text begins, and its words."""
        number = self.numbers.__getitem__
        parts = [np.empty(0, np.int32)]
        length = np.array([t.count(" ") + 1 for t in texts], np.int64)
        for i in range(0, len(texts), CHUNK):
            words = " ".join(texts[i : i + CHUNK]).split(" ")
            parts.append(np.fromiter(map(number, words), np.int32, len(words)))
        first = np.cumsum(length + MARGIN) - length
        flat = np.full(int((length + MARGIN).sum()) + MARGIN, -1, np.int32)
        flat[np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)] = np.concatenate(parts)
        return flat, first, length

    def _picture(self, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """256 bits of a text's words."""
        picture = np.zeros((len(length), 256), np.uint8)
        picture[np.repeat(np.arange(len(length)), length), self.bits[flat[flat >= 0]]] = 1
        return np.packbits(picture, axis=1).view(np.uint64)

    def build(self) -> Shard:
        self.automaton.build()
        self.passage_width = np.zeros(len(self.holders), np.int64)
        self.passage_width[self.passage] = self.width
        total = len(self.owner)
        order = np.lexsort((self.holders[self.passage], self.owner))
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total) - np.repeat(self.begin, self.pieces)
        n = self.n[self.owner]
        self.span = int(self.n.max(initial=0)) + 1
        entered = self.passage * self.span + self.place
        order = np.argsort(entered, kind="stable")
        #: entries by passage and place: the piece's text, and the least and most words of a near one for which it is looked up (k + 1 pieces are enough for k edits)
        self.entered, self.text = entered[order], self.owner[order]
        self.least = np.where(rank <= n // 5, n - n // 5, 5 * rank)[order].astype(np.int32)
        self.most = (5 * (n // 4) + n % 4)[order].astype(np.int32)
        return self

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, number of the evaluation text, edits, words of the longer one, covered words) of near texts."""
        if len(self.numbers) > self.vocabulary + self.MORE:
            for word in list(self.numbers)[self.vocabulary :]:
                del self.numbers[word]
            self.bits = self.bits[: self.vocabulary]
        flat, first, length = self._numbered(texts)
        fresh = list(islice(self.numbers, len(self.bits), None))
        self.bits = np.r_[self.bits, np.array([_bit(w) for w in fresh], np.uint8)]
        text, end, passage = self.automaton.run(flat, first, length)
        if not len(text):
            return
        self.seen[passage] = True
        picture = self._picture(flat, length)
        at = end + 1 - self.passage_width[passage]
        # what is left whole has moved by no more than the edits before it: a fifth of the longer text, a quarter of the shorter one
        name, far = passage * self.span, length[text] // 4
        begin = _places(self.entered, name + np.clip(at - far, 0, self.span - 1))
        meets = _places(self.entered, name + np.minimum(at + far, self.span - 1) + 1) - begin
        # texts are taken together up to BLOCK meetings, so a hot passage fills no memory
        hits = np.searchsorted(text, np.arange(len(texts) + 1))
        upto = np.r_[0, np.cumsum(meets)][hits]
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + self.BLOCK, "right")) - 1)
            mine = slice(hits[i], hits[j])
            yield from self._near(flat, first, length, picture, text[mine], at[mine], passage[mine], begin[mine], meets[mine])
            i = j

    def _near(
        self, flat: np.ndarray, first: np.ndarray, length: np.ndarray, picture: np.ndarray, text: np.ndarray, at: np.ndarray, passage: np.ndarray, begin: np.ndarray, meets: np.ndarray
    ) -> Iterator[tuple[int, int, int, int, int]]:
        """scan() of passages that were hit: the number of the text, the place, the first entry and the number of entries that each meets."""
        slot = np.arange(int(meets.sum()), dtype=np.int32) + np.repeat((begin - (np.cumsum(meets) - meets)).astype(np.int32), meets)
        other = np.repeat(length[text].astype(np.int32), meets)
        keep = np.flatnonzero((self.least[slot] <= other) & (other <= self.most[slot]))
        pairs = np.sort(np.repeat(text, meets)[keep] * len(self.n) + self.text[slot[keep]])
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        t, r = pairs // max(1, len(self.n)), pairs % max(1, len(self.n))
        most = np.maximum(self.n[r], length[t]) // 5
        # each edit changes at most two bits of the picture of a text's words
        differ = np.bitwise_count(self.picture[r] ^ picture[t]).sum(axis=1, dtype=np.int64)
        enough = np.flatnonzero(differ <= 2 * most)
        t, r, most = t[enough], r[enough], most[enough]
        if not len(t):
            return
        # the passages of an evaluation text that are whole in a training text, and the words they cover
        each = self.pieces[r]
        pair = np.repeat(np.arange(len(r)), each)
        piece = np.arange(len(pair)) + np.repeat(self.begin[r] - (np.cumsum(each) - each), each)
        longest = int(length.max()) + 1
        hits = np.sort((text * len(self.holders) + passage) * longest + at)
        name = (t[pair] * len(self.holders) + self.passage[piece]) * longest
        least = _places(hits, name + np.maximum(0, self.place[piece] - most[pair]))
        there = hits[np.minimum(least, len(hits) - 1)]
        there = (least < len(hits)) & (there <= name + np.minimum(longest - 1, self.place[piece] + most[pair]))
        whole = np.bincount(pair, weights=there, minlength=len(r))
        covered = np.bincount(pair, weights=there * self.width[piece], minlength=len(r))
        for i in np.flatnonzero(whole >= each - most).tolist():
            a = self.flat[self.first[r[i]] : self.first[r[i]] + self.n[r[i]]].tolist()
            b = flat[first[t[i]] : first[t[i]] + length[t[i]]].tolist()
            edits = settle(a, b, int(most[i]))
            if edits <= most[i]:
                yield int(t[i]), int(r[i]), edits, max(len(a), len(b)), int(covered[i])


#: The shard that this worker used last, by its name.
_BUILT: dict[str, Shard] = {}


def _pack(rows: pd.DataFrame) -> bytes:
    """Evaluation texts (id, words, starts, ends) in the order of their ids."""
    rows = rows.sort_values("id")
    flat = lambda c: np.concatenate([np.frombuffer(x, np.int32) for x in rows[c]])
    return zlib.compress(pickle.dumps((rows["id"].to_numpy(np.int64), rows["words"].tolist(), flat("starts"), flat("ends"))), 1)


def _unpack(packed: bytes) -> Shard:
    ids, texts, starts, ends = pickle.loads(zlib.decompress(packed))
    return Shard(ids, texts, starts.astype(np.int64), ends.astype(np.int64))


def _scanner(number: int, shared: Broadcast):
    """mapInPandas over training texts (id, words): near texts, and at the end of the partition the passages that were seen."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: Shard | None = None
        for b in batches:
            if shard is None:
                shard = _BUILT.get(name)
                if shard is None:
                    _BUILT.clear()
                    shard = _BUILT[name] = _unpack(shared.value).build()
                shard.seen[:] = False
            for i in range(0, len(b), STEP):
                ids = b["id"].to_numpy(np.int64)[i : i + STEP]
                found = [(int(shard.ids[r]), int(ids[t]), edits, longer, covered) for t, r, edits, longer, covered in shard.scan(b["words"].tolist()[i : i + STEP])]
                yield pd.DataFrame(found, columns=["a_id", "b_id", "edits", "longer", "covered"]).assign(shard=number, seen=None)
        if shard is not None:
            yield pd.DataFrame({"a_id": [None], "b_id": [None], "edits": [None], "longer": [None], "covered": [None], "shard": [number], "seen": [zlib.compress(np.packbits(shard.seen).tobytes(), 1)]})

    return run


_FOUND = "a_id long, b_id long, edits int, longer int, covered int, shard int, seen binary"


def _counts(texts: DataFrame) -> np.ndarray:
    """How often the texts hold the passages, by width and counter; every text counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, sums = Words(), np.zeros((WIDE + 1, SLOTS), np.uint32)
        for b in batches:
            for i in range(0, len(b), STEP):
                lengths, hashes = _hashed(b["words"].iloc[i : i + STEP], memo)
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(hashes))
                for w in range(NARROW, WIDE + 1):
                    at = _slots(hashes, w)
                    sums[w] += np.bincount(at[left[: len(at)] >= w], minlength=SLOTS).astype(np.uint32)
        blocks = sums.reshape(-1, BLOCK_OF_COUNTS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": used, "sums": [zlib.compress(blocks[i].tobytes(), 1) for i in used]})

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK_OF_COUNTS, np.uint32)
        for packed in parts["sums"]:
            total += np.frombuffer(zlib.decompress(packed), np.uint32)
        return pd.DataFrame({"block": [key[0]], "sums": [zlib.compress(total.tobytes(), 1)]})

    form = "block int, sums binary"
    summed = texts.select("words").mapInPandas(run, form).groupBy("block").applyInPandas(add, form)
    counts = np.zeros(((WIDE + 1) * SLOTS // BLOCK_OF_COUNTS, BLOCK_OF_COUNTS), np.uint32)
    # the counters reach the driver once, whatever the number of texts
    for r in summed.collect():
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["sums"]), np.uint32)
    return counts.reshape(WIDE + 1, SLOTS)


def _hashed(words: pd.Series, memo: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the word hashes of all, one after the other."""
    split = [w.split(" ") for w in words]
    return np.array([len(w) for w in split], np.int64), word_hashes([w for words in split for w in words], memo)


def _divided(evaluation: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, n, words, shard, starts, ends) of evaluation texts (id, n, words, shard)."""
    shared = evaluation.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for b in batches:
            for i in range(0, len(b), CHUNK):
                part = b[["id", "n", "words", "shard"]].iloc[i : i + CHUNK]
                lengths, hashes = _hashed(part["words"], memo)
                starts, ends = borders(lengths, hashes, shared.value)
                parts = np.cumsum(most_edits(lengths) + 1)[:-1]
                cut_up = lambda x: [y.astype(np.int32).tobytes() for y in np.split(x, parts)]
                yield part.assign(starts=cut_up(starts), ends=cut_up(ends))

    return evaluation.mapInPandas(run, "id long, n int, words string, shard int, starts binary, ends binary")


def _sharded(evaluation: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The evaluation texts with their shard, and the least and most words of each shard's texts.

    Texts of like length share a shard. What reaches the driver is a row for each different length.
    """
    lengths = [(r["n"], r["k"]) for r in evaluation.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").toLocalIterator()]
    spans: list[tuple[int, int]] = []
    places: list[tuple[int, int, int]] = []
    held = SHARD_WORDS
    for n, k in lengths:
        if held + n * k <= SHARD_WORDS:
            spans[-1] = (spans[-1][0], n)
            places.append((n, len(spans) - 1, 1))
            held += n * k
            continue
        parts = -(-n * k // SHARD_WORDS)
        places.append((n, len(spans), parts))
        spans += [(n, n)] * parts
        held = n * k if parts == 1 else SHARD_WORDS
    where = evaluation.sparkSession.createDataFrame(places, "n int, first int, parts int")
    shard = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return evaluation.join(F.broadcast(where), "n").withColumn("shard", shard).drop("first", "parts"), spans


def scan_training(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the automata find, see _FOUND, and the evaluation texts with their shards, of texts (id, in_train, in_eval, n, words)."""
    train = distinct.where("in_train").select("id", "n", "words")
    evaluation = distinct.where("in_eval").select("id", "n", "words")
    # shards are known before the texts are divided, which is done once
    placed, spans = _sharded(evaluation)
    placed = stored(_divided(placed, _counts(train)))
    context = distinct.sparkSession.sparkContext
    found: list[DataFrame] = []
    for start in range(0, len(spans), ROUND):
        shards = range(start, min(start + ROUND, len(spans)))
        scans, sent = [], []
        for s in shards:
            # a shard is bounded by SHARD_WORDS, however large the evaluation set is
            sent.append(context.broadcast(_pack(placed.where(F.col("shard") == s).select("id", "words", "starts", "ends").toPandas())))
            least, most = spans[s]
            fits = F.col("n").between(least - least // 5, 5 * (most // 4) + most % 4)
            scans.append(train.where(fits).select("id", "words").mapInPandas(_scanner(s, sent[-1]), _FOUND))
        found.append(stored(reduce(DataFrame.unionByName, scans)))
        for b in sent:
            b.destroy()
    empty = distinct.sparkSession.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionByName, found, empty), placed


def _rows_and_texts(splits: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_ord, split, source, text_key) of rows in splits, and a row per different text: (text_key, id, in_train, in_eval, n, words), named by its smallest row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for b in batches:
            b["words"] = [plain(t) for t in b["text"]]
            b["n"] = b["words"].str.count(" ").astype("int32") + 1
            b = b[b["n"] >= MIN_WORDS].copy()
            b["text_key"] = [xxh3_128_digest(w.encode()) for w in b["words"]]
            yield b[["row_ord", "split", "source", "text_key", "n", "words"]]

    raw = texts.select(F.col("row_ord").cast("long"), F.col("source").cast("string"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    listed = splits.select(F.col("row_ord").cast("long"), F.col("split").cast("string")).where(F.col("split").isNotNull()).distinct()
    rows = stored(raw.join(listed, "row_ord").mapInPandas(run, "row_ord long, split string, source string, text_key binary, n int, words string"))
    in_train = F.col("split") == "train"
    kinds = rows.groupBy("text_key").agg(
        F.min("row_ord").alias("id"), F.bool_or(in_train).alias("in_train"), F.bool_or(~in_train).alias("in_eval"), F.first("n").alias("n"), F.first("words").alias("words")
    )
    return rows.select("row_ord", "split", "source", "text_key").distinct(), stored(kinds)


def cross_split_overlaps(splits: DataFrame, texts: DataFrame) -> DataFrame:
    """All overlaps between train and the other splits.

    splits: row_ord, split. texts: row_ord, source, text; rows without a split take no part. Gives a row per pair: train_row_ord, row_ord, split,
    source, edits, longer (words of the longer text), covered (words of the row's text in matched passages). Null texts and texts of fewer than four
    words never count; null splits are no split; extra columns are left out; a row listed twice in the same split counts once; empty tables give no rows.
    """
    rows, distinct = _rows_and_texts(splits, texts)
    return _expanded(rows, distinct, scan_training(distinct)[0])


def _expanded(rows: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    linked = found.where("a_id IS NOT NULL").select("a_id", "b_id", "edits", "longer", "covered")
    # only texts with a link go back to their rows
    ends = linked.select(F.col("a_id").alias("id")).union(linked.select("b_id")).distinct()
    members = rows.join(distinct.select("text_key", "id").join(ends, "id"), "text_key").select("id", "row_ord", "split", "source")
    train = members.where("split = 'train'").select(F.col("id").alias("b_id"), F.col("row_ord").alias("train_row_ord"))
    other = members.where("split <> 'train'").select(F.col("id").alias("a_id"), "row_ord", "split", "source")
    return linked.join(other, "a_id").join(train, "b_id").select("train_row_ord", "row_ord", "split", "source", "edits", "longer", "covered")


def overlaps_and_coverage(splits: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The overlaps, see cross_split_overlaps(), and the coverage of each evaluation record.

    coverage: row_ord, split, source, words, covered. covered: words of its passages that occur in training texts of a length that a near text
    may have, merged over all of them. The passages are those that the automata look for, so covered may fall short of all common words.
    """
    rows, distinct = _rows_and_texts(splits, texts)
    found, placed = scan_training(distinct)

    def merge(key: tuple, seen: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame({"id": [], "words": [], "covered": []})
        shard = _unpack(_pack(members))
        bits = np.zeros(-(-len(shard.holders) // 8), np.uint8)
        for s in seen["seen"]:
            bits |= np.frombuffer(zlib.decompress(s), np.uint8)
        hit = np.unpackbits(bits)[: len(shard.holders)].astype(bool)[shard.passage]
        covered = np.bincount(shard.owner, weights=shard.width * hit, minlength=len(shard.ids))
        return pd.DataFrame({"id": shard.ids, "words": shard.n, "covered": covered.astype(np.int64)})

    seen = found.where("seen IS NOT NULL").select("shard", "seen").groupBy("shard")
    of_text = seen.cogroup(placed.select("shard", "id", "words", "starts", "ends").groupBy("shard")).applyInPandas(merge, "id long, words long, covered long")
    keyed = distinct.where("in_eval").select("text_key", "id").join(of_text, "id")
    coverage = rows.where("split <> 'train'").join(keyed, "text_key").select("row_ord", "split", "source", "words", "covered")
    return _expanded(rows, distinct, found), coverage
