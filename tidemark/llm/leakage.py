"""Evaluation texts leaking into training text (problem 9).

A prefix-filtered set join on word shingles, then exact containment. Words are
taken apart from case, accents, punctuation, layout and markup. A document
holds an item if one or two passages, in the item's order, cover ``COVER`` of
the item's words with at most about one word in eight changed, added or
dropped, names and numbers included. Five-word shingles could not survive that
(one change in eight words leaves few of them whole), so shingles have three.

1. Items: equal texts are one; its shingles by 64-bit hash, and a Bloom filter
   over those of all items, of a size that follows their number. More than
   ``AT_ONCE`` shingles are taken in several passes, so that the filter that
   tasks receive is bounded.
2. Corpus, one pass: of each document the positions of shingles in the filter;
   only documents with enough of them, those of one passage within ``WINDOW``
   words, go on, with their text. The corpus is never shuffled.
3. Rarity: shingles of an item are ordered by how often the corpus has them.
   A held item has at least ``t`` shingles in the document, ``u`` of them on the
   diagonals (position in the document less position in the item) of its longer
   passage. Its prefix is all but its ``u // 2`` most common shingles, of
   which there are then ``t - u // 2`` and ``u - u // 2``.
4. Join of the prefix on the hash; hits are counted by diagonal, in the map
   before the shuffle. Pairs that meet the length and positional bounds go on.
5. Verification: the other hits of a pair are counted from its text, and the
   bounds asked again in full. Then the best two passages in order within windows
   of the hits, by local alignment, window by window, measured from the first to
   the last matched word with the edits of both taken together. Passages that
   together lack half of their names and numbers (words of few item texts and words
   of digits, by their place in the alignment) are sentences of the same form and
   do not count; verbatim passages have all of theirs.

Defined results: null, empty and blank texts, and items or documents with a
null id, give nothing; a passage has ``LEAST_PASSAGE`` words, so an item of that
many or fewer is held word for word only; repeated ids give a pair once; there
is no limit on items or documents per case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.words import shingles, tokens, words
from tidemark.session import materialize

SHINGLE = 3
#: Share of the item's words the passages must span; two fifths less what edits at the ends hide.
COVER = 0.36
#: Edits per word of a passage: one in eight, and one more where alignment counts a change twice.
EDITS = 1 / 7
#: Words of the shortest passage; shorter ones are shared phrases.
LEAST_PASSAGE = 5
#: A word in no more item texts than this share of them (and in two at least) tells items of one form apart.
RARE_IN = 0.01
#: Words between two passages up to which they are one sentence with other words in it.
BETWEEN = 9
#: Of an edit against a match, tried in turn.
PENALTIES = (3, 2, 1)
#: Penalty of an edit and weight of a mark in the bounds before an alignment is traced; each is necessary, the first of them the sharpest.
BOUNDS = ((1, 4), (3, 1))
#: Stands for words left out between two windows.
GAP = -2
WINDOW = 256
DIAGONAL = 16
#: Bits of the filter for each shingle, and shingles of one pass over the corpus (a filter of 16 MB).
BITS_EACH = 16
AT_ONCE = 2**23
#: Prefix shingles up to which they are sent to every task (a few MB); more are joined by shuffling.
SENT_SHINGLES = 200_000
#: Cells of an alignment held at a time.
CELLS = 2**21
#: Words of the windows that are aligned at once for the bounds.
TOGETHER = 2**14
ITEMS_AT_ONCE = 512


def needed(n_words: int) -> tuple[int, int]:
    """Fewest whole shingles of a held item: in all, and on the diagonals of its longer passage."""
    few = max(1, min(2, n_words - SHINGLE + 1))
    kept = 1 - SHINGLE * EDITS
    return max(few, int(COVER * n_words * kept) - 2 * (SHINGLE - 1)), max(few, int(COVER / 2 * n_words * kept) - (SHINGLE - 1))


def _drift(n_words: int) -> int:
    """By how much the diagonal of a passage moves at most, and the width of a group of diagonals."""
    return max(DIAGONAL, -(-n_words // 7) + 1)


def item_shingles(h: np.ndarray) -> np.ndarray:
    """Shingles of an item; one shorter than a shingle is one itself."""
    return shingles(h, min(SHINGLE, len(h)))


# --- Items ----------------------------------------------------------------------

_ITEMS = "item string, text string, n int, words array<string>, h array<bigint>"


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (w := words(t))]
        plain = [" ".join(w) for _, w in rows]
        h, bounds = tokens(plain)
        hashes = [h[bounds[k] : bounds[k + 1]].view(np.int64) for k in range(len(rows))]
        columns = [pa.array([i for i, _ in rows], pa.string()), pa.array(plain, pa.string()), pa.array([len(w) for _, w in rows], pa.int32()), pa.array([w for _, w in rows], pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "text", "n", "words", "h"])


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [item_shingles(np.array(h, np.int64).view(np.uint64)) for h in b.column("h").to_pylist()]
        bounds = [needed(len(h)) for h in b.column("h").to_pylist()]
        extra = [pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([t for t, _ in bounds], pa.int32()), pa.array([u for _, u in bounds], pa.int32()), pa.array([_drift(len(h)) for h in b.column("h").to_pylist()], pa.int32())]
        yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "shingles", "t", "u", "drift"])


def _distinct_items(known: DataFrame) -> DataFrame:
    """(text, n, h, marks, shingles, t, u, drift): one row per text; marks are the places of its names and numbers."""
    texts = known.groupBy("text").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.first("h").alias("h"))
    total = texts.count()
    at = texts.select("text", F.posexplode("words").alias("p", "w"))
    rare = at.groupBy("w").agg(F.count_distinct("text").alias("n")).where(F.col("n") <= max(2, int(RARE_IN * total))).select("w", F.lit(True).alias("rare"))
    marked = at.join(rare, "w", "left").where(F.col("rare") | F.col("w").rlike(r"^\p{Nd}+$"))
    marks = marked.groupBy("text").agg(F.collect_list("p").alias("marks"))
    rows = texts.select("text", "n", "h").join(marks, "text", "left").select("text", "n", "h", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"))
    return rows.mapInArrow(_with_shingles, "text string, n int, h array<bigint>, marks array<int>, shingles array<bigint>, t int, u int, drift int")


# --- Filter ---------------------------------------------------------------------


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64(2**bits - 1)).astype(np.int64)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _isset(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bloom_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    bitmap = np.zeros(2**bits // 8, np.uint8)
    for b in batches:
        h = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        for slot in _slots(h, bits):
            _set(bitmap, slot)
    yield pa.RecordBatch.from_arrays([pa.array([bitmap.tobytes()], pa.binary())], ["bits"])


def _bloom(items: DataFrame, n_shingles: int) -> tuple[np.ndarray, int]:
    """The items' filter: four bitmaps of at most AT_ONCE * BITS_EACH bits reach the driver."""
    bits = max(16, int(n_shingles * BITS_EACH - 1).bit_length())
    parts = items.select("shingles").coalesce(4).mapInArrow(lambda it: _bloom_batches(it, bits), "bits binary").collect()
    out = np.zeros(2**bits // 8, np.uint8)
    for (p,) in parts:
        out |= np.frombuffer(p, np.uint8)
    return out, bits


# --- Corpus ---------------------------------------------------------------------


def _suspects(batches: Iterator[pa.RecordBatch], bloom, bits: int, least: int, near: int, sizes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """(doc, text, pos, hash) of documents with ``least`` filter hits, ``near`` of them, one passage's, within WINDOW words."""
    bitmap = bloom.value
    for b in batches:
        texts = b.column(1).to_pylist()
        hashes, bounds = tokens(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        at, found = [], []
        for size in sizes:
            s = shingles(hashes, size)
            one, two = _slots(s, bits)
            hit = np.flatnonzero(_isset(bitmap, one))
            hit = hit[_isset(bitmap, two[hit])]
            # A shingle is one document's.
            hit = hit[owner[hit] == owner[hit + size - 1]]
            at.append(hit)
            found.append(s[hit])
        where, what = np.concatenate(at), np.concatenate(found)
        if len(sizes) > 1:
            order = np.argsort(where, kind="stable")
            where, what = where[order], what[order]
        of = owner[where]
        edges = np.searchsorted(of, np.arange(len(texts) + 1))
        keep, positions, kept = [], [], []
        for i in np.flatnonzero(np.diff(edges) >= least).tolist():
            pos = where[edges[i] : edges[i + 1]] - bounds[i]
            if (pos[near - 1 :] - pos[: len(pos) - near + 1]).min() <= WINDOW:
                keep.append(i)
                positions.append(pos.astype(np.int32))
                kept.append(what[edges[i] : edges[i + 1]].view(np.int64))
        if keep:
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(keep)) for c in b.columns], pa.array(positions, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.int64()))], ["doc", "text", "pos", "hash"])


# --- Alignment ------------------------------------------------------------------

Passage = tuple[list[tuple[int, int]], int]


def _table(a: np.ndarray, b: np.ndarray, penalty: int, left: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
    """Scores of local alignments ending at each word of ``a`` and ``b``; a match +1, an edit -penalty.

    ``left`` is the last column of the block before. A passage starts from 0,
    or from ``floor``, the best of what came before it. ``a`` and ``b`` are word
    numbers, below -1 for a gap that no passage crosses. A row of the table is
    a few vector operations; gaps along ``b`` are a running maximum.
    """
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int32) if floor is None else floor.copy()
    table[:, 0] = left
    far = n + 1  # more than any alignment scores
    slope = np.zeros(m + 1, np.int32)
    slope[1:] = penalty * np.arange(1, m + 1, dtype=np.int32)
    slope[1:] += np.cumsum(np.where(b < -1, far, 0), dtype=np.int32)
    miss = np.where(b < -1, -far, -penalty).astype(np.int32)
    gains: dict[int, np.ndarray] = {}
    row = np.empty(m + 1, np.int32)
    for i, word in enumerate(a.tolist()):
        gain = gains.get(word)
        if gain is None:
            gain = gains[word] = np.where(b == word, 1, miss).astype(np.int32)
        here, above = table[i + 1], table[i]
        row[0] = here[0]
        np.add(above[:-1], gain, out=row[1:])
        np.maximum(row[1:], above[1:] - penalty, out=row[1:])
        np.maximum(row[1:], here[1:], out=row[1:])
        row += slope
        np.maximum.accumulate(row, out=row)
        np.subtract(row[1:], slope[1:], out=here[1:])
    return table


class _Blocks:
    """Tables of one pair, block by block of the document's words; borders are kept, tables one at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray, penalty: int, tables: tuple | None = None) -> None:
        self.a, self.b, self.penalty = a, b, penalty
        if tables is not None:
            self.width, self.held = max(1, len(b)), (0, tables)
            i, j = divmod(int(tables[2].argmax()), tables[2].shape[1])
            self.score, self.end = int(tables[2][i, j]), (i, j)
            return
        self.width = max(64, CELLS // (len(a) + 1))
        n = len(a) + 1
        zero = np.zeros(n, np.int32)
        # Of each block: the left borders of both tables, and the best of a first passage before it.
        self.borders = [(zero, zero, zero)]
        self.held: tuple[int, tuple] | None = None
        self.score, self.end = 0, (0, 0)
        for k in range(max(1, -(-len(b) // self.width))):
            one, before, two = self.tables(k)
            i, j = divmod(int(two.argmax()), two.shape[1])
            if int(two[i, j]) > self.score:
                self.score, self.end = int(two[i, j]), (i, k * self.width + j)
            self.borders.append((one[:, -1].copy(), two[:, -1].copy(), before[:, -1].copy()))

    def tables(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One passage, the best first one so far, and two passages."""
        if self.held is None or self.held[0] != k:
            part = self.b[k * self.width : (k + 1) * self.width]
            left_one, left_two, left_before = self.borders[k]
            one = _table(self.a, part, self.penalty, left_one)
            before = np.maximum.accumulate(one, axis=0)
            before[:, 0] = left_before
            np.maximum.accumulate(before, axis=1, out=before)
            self.held = k, (one, before, _table(self.a, part, self.penalty, left_two, before))
        return self.held[1]

    def at(self, which: int, i: int, j: int) -> int:
        """A score of table ``which`` at word counts i and j."""
        k = max(0, (j - 1) // self.width)
        return int(self.tables(k)[which][i, j - k * self.width])

    def trace(self, which: int, i: int, j: int) -> Passage:
        """The matches of the alignment that ends at (i, j), in order, and its edits."""
        a, b, matches, edits = self.a, self.b, [], 0
        while i and j:
            here = self.at(which, i, j)
            if here <= (0 if which == 0 else self.at(1, i, j)):
                break
            if a[i - 1] == b[j - 1] and here == self.at(which, i - 1, j - 1) + 1:
                i, j = i - 1, j - 1
                matches.append((i, j))
                continue
            edits += 1
            if here == self.at(which, i - 1, j - 1) - self.penalty:
                i, j = i - 1, j - 1
            elif here == self.at(which, i - 1, j) - self.penalty:
                i -= 1
            else:
                j -= 1
        return matches[::-1], edits

    def first(self, i: int, j: int) -> tuple[int, int]:
        """Where the best passage within the first i and j words ends."""
        best, place = -1, (0, 0)
        for k in range(max(0, (j - 1) // self.width) + 1):
            one = self.tables(k)[0][: i + 1, : j - k * self.width + 1]
            x, y = divmod(int(one.argmax()), one.shape[1])
            if int(one[x, y]) > best:
                best, place = int(one[x, y]), (x, k * self.width + y)
        return place

    def passages(self) -> list[Passage]:
        """The best two passages in the order of both texts."""
        second = self.trace(2, *self.end)
        # The score where the second begins is that of the first.
        i, j = second[0][0] if second[0] else self.end
        return [p for p in (self.trace(0, *self.first(i, j)), second) if p[0]]


def _grow(matches: list[tuple[int, int]], edits: int, a: np.ndarray, b: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> list[Passage]:
    """The passage, and the passages that come of crossing one more edit each time at an end with a match behind it."""
    out = [(matches, edits)]
    for _ in range(4):
        (i0, j0), (i1, j1) = matches[0], matches[-1]
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            i, j = i0 - di - 1, j0 - dj - 1
            if i >= low[0] and j >= low[1] and a[i] == b[j] and min(b[j:j0]) >= -1:
                grown = [(i, j)]
                while i > low[0] and j > low[1] and a[i - 1] == b[j - 1]:
                    i, j = i - 1, j - 1
                    grown.insert(0, (i, j))
                matches, edits = grown + matches, edits + 1
                break
            i, j = i1 + di + 1, j1 + dj + 1
            if i < high[0] and j < high[1] and a[i] == b[j] and min(b[j1:j]) >= -1:
                grown = [(i, j)]
                while i + 1 < high[0] and j + 1 < high[1] and a[i + 1] == b[j + 1]:
                    i, j = i + 1, j + 1
                    grown.append((i, j))
                matches, edits = matches + grown, edits + 1
                break
        else:
            break
        out.append((matches, edits))
    return out


# --- Verification ---------------------------------------------------------------


def _within(gains: np.ndarray) -> np.ndarray:
    """For each row, the most that two stretches of it gain."""
    in_one = one = in_two = two = np.zeros(len(gains), np.int32)
    for x in gains.T:
        in_two = np.maximum(in_two, one) + x
        in_one = np.maximum(in_one, 0) + x
        one = np.maximum(one, in_one)
        two = np.maximum(np.maximum(two, in_two), one)
    return two


def _least(n: np.ndarray | int, penalty: int) -> np.ndarray | float:
    """What a held item's passages score at least, their edits at their most.

    As they match as many marks as they lose, any gain for each mark matched
    and as much a loss for each one lost leaves that bound as it is.
    """
    return COVER * n * (1 - (1 + penalty) * EDITS)


def _reach(a: np.ndarray, marks: np.ndarray, b: np.ndarray, penalty: int, weight: int, kept: np.ndarray | None = None) -> np.ndarray:
    """Scores of the best two passages of many pairs at once, a mark matched or lost counting ``weight`` more.

    ``a`` (padded by -3) and ``b`` (padded by GAP) have a row for each pair.
    ``kept`` takes the tables of one passage, of the first and of two.
    """
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    m, pairs = b.shape
    far = np.int32((1 + weight) * len(a) + 1)
    gap = b <= GAP
    slope = np.zeros((m + 1, pairs), np.int32)
    slope[1:] = np.cumsum(np.where(gap, far, penalty), axis=0)
    one, before, two, row, ahead = (np.zeros((m + 1, pairs), np.int32) for _ in range(5))
    best = np.zeros(pairs, np.int32)
    hit, lost = (1 + weight * marks.T).astype(np.int32), (penalty + weight * marks.T).astype(np.int32)
    lost[a == -3] = far
    for i, word in enumerate(a):
        lose = lost[i]
        gain = np.where(b == word, hit[i], np.where(gap, -far, -lose))
        for table in (one, two):
            row[0] = 0
            np.add(table[:-1], gain, out=row[1:])
            np.subtract(table, lose, out=ahead)
            np.maximum(row, ahead, out=row)
            np.maximum(row, 0 if table is one else before, out=row)
            row += slope
            np.maximum.accumulate(row, axis=0, out=table)
            table -= slope
            if table is one:
                np.maximum.accumulate(table, axis=0, out=ahead)
                np.maximum(before, ahead, out=before)
        np.maximum(best, two.max(axis=0), out=best)
        if kept is not None:
            kept[0, i + 1], kept[1, i + 1], kept[2, i + 1] = one, before, two
    return best


def _enough(passages: list[Passage], n: int, marks: np.ndarray) -> bool:
    """Whether passages cover enough of the item, edits and names counted over all of them together."""
    covered = sum(m[-1][0] - m[0][0] + 1 for m, _ in passages)
    length = sum(len(m) + e for m, e in passages)
    if covered < COVER * n or sum(e for _, e in passages) > EDITS * length:
        return False
    own = sum(int(marks[m[0][0] : m[-1][0] + 1].sum()) for m, _ in passages)
    if len(passages) == 2:
        # A few words between that both texts have in like number were changed: their names and numbers are lost ones.
        (i0, j0), (i1, j1) = passages[0][0][-1], passages[1][0][0]
        if i1 - i0 <= BETWEEN and j1 - j0 <= BETWEEN:
            own += int(marks[i0 + 1 : i1].sum())
    return 2 * sum(int(marks[i]) for m, _ in passages for i, _ in m) >= own


def _ordered(p: Passage, q: Passage) -> bool:
    return p[0][-1][0] < q[0][0][0] and p[0][-1][1] < q[0][0][1]


def _judged(blocks: _Blocks, item: _Item) -> bool | None:
    """True if the best passages at this penalty are enough, False if no other penalty's can be, else None."""
    n, a, b = item.n, item.numbers, blocks.b
    if blocks.score < _least(n, blocks.penalty):
        return False
    passages, shortest = blocks.passages(), min(LEAST_PASSAGE, n)
    tried = [passages]
    # What is too short for a passage leaves its words to the other one.
    if len(long := [p for p in passages if len(p[0]) + p[1] >= shortest]) < len(passages):
        tried.append(long)
    if len(passages) == 2:
        (m, e), (k, f) = passages
        (i0, j0), (i1, j1) = m[-1], k[0]
        if b[j0 + 1 : j1].min(initial=0) > GAP:
            # Both as one, the words between them as edits.
            tried.append([(m + k, e + f + max(i1 - i0, j1 - j0) - 1)])
    for found in tried:
        grown = []
        for k, (matches, edits) in enumerate(found):
            low = found[0][0][-1] if k else (-1, -1)
            high = found[1][0][0] if k == 0 and len(found) == 2 else (n, len(b))
            grown.append([p for p in _grow(matches, edits, a, b, (low[0] + 1, low[1] + 1), high) if len(p[0]) + p[1] >= shortest])
        for one in grown:
            if any(_enough([p], n, item.marks) for p in one):
                return True
        if len(grown) == 2 and any(_ordered(p, q) and _enough([p, q], n, item.marks) for p in grown[0] for q in grown[1]):
            return True
    return None


class _Item:
    """An item's word numbers, names and numbers, and shingles, ready to be looked up."""

    def __init__(self, h: np.ndarray, marks: np.ndarray) -> None:
        self.h, self.n, self.size = h, len(h), min(SHINGLE, len(h))
        self.known, numbers = np.unique(h, return_inverse=True)
        self.numbers = numbers.astype(np.int32)
        self.marks = np.zeros(self.n, bool)
        self.marks[marks] = True
        found = item_shingles(h)
        self.order = np.argsort(found, kind="stable")
        self.shingles = found[self.order]

    def spans(self, s: np.ndarray) -> list[tuple[int, int]]:
        """Where in a document with shingles ``s`` the hits lie; none if they do not meet the bounds."""
        left = np.searchsorted(self.shingles, s, "left")
        at = np.flatnonzero(self.shingles[np.minimum(left, len(self.shingles) - 1)] == s)
        left = left[at]
        times = np.searchsorted(self.shingles, s[at], "right") - left
        pos = np.repeat(at, times)
        first = np.cumsum(times) - times
        t, u = needed(self.n)
        if len(pos) < t:
            return []
        group = (pos - self.order[np.repeat(left - first, times) + np.arange(len(pos))]) // _drift(self.n)
        low = int(group.min())
        counts = np.zeros(int(group.max()) - low + 3, np.int64)
        np.add.at(counts, group - low + 1, 1)
        if (counts[1:] + counts[:-1]).max() < u:
            return []
        # A passage has two shingles, of neighbouring diagonals, unless it is one shingle.
        if self.n > SHINGLE:
            k = group - low + 1
            pos = pos[counts[k - 1] + counts[k] + counts[k + 1] > 1]
        return _merged(np.unique(pos), self.n + self.n // 6 + self.size, self.size)

    def windows(self, doc: np.ndarray, s: np.ndarray) -> np.ndarray | None:
        """The numbers of the document's words around its hits, GAP between windows."""
        parts: list[np.ndarray] = []
        for lo, hi in self.spans(s):
            part = doc[lo:hi]
            at = np.minimum(np.searchsorted(self.known, part), len(self.known) - 1)
            parts += [np.where(self.known[at] == part, at, -1).astype(np.int32), np.array([GAP], np.int32)]
        return np.concatenate(parts[:-1]) if parts else None


def _merged(at: np.ndarray, around: int, size: int) -> list[tuple[int, int]]:
    """Windows of ``around`` words to both sides of each position, merged where they meet."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * around + size)
    lows, highs = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(max(0, int(lo) - around), int(hi) + size + around) for lo, hi in zip(lows, highs)]


def _rows(arrays: list[np.ndarray], fill: int) -> np.ndarray:
    """Arrays as the rows of one, padded."""
    out = np.full((len(arrays), max(map(len, arrays))), fill, np.int32)
    for row, a in zip(out, arrays):
        row[: len(a)] = a
    return out


def held_pairs(docs: list[np.ndarray], items: list[list[_Item]]) -> list[tuple[int, int]]:
    """(document, place among its items) of every held pair; cheap bounds of all pairs come before alignments."""
    pairs = [(d, k) for d, own in enumerate(items) for k in range(len(own))]
    if not pairs:
        return []
    # Words that a document lacks are edits wherever the others stand.
    present = []
    for doc, own in zip(docs, items):
        if own:
            known, h = np.unique(doc), np.concatenate([i.h for i in own])
            there = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            present += np.split(there, np.cumsum([i.n for i in own])[:-1])
    flat = [i for own in items for i in own]
    n = np.array([i.n for i in flat])
    alive = np.arange(len(pairs))
    for penalty, weight in BOUNDS:
        if len(alive):
            gains = [np.where(present[k], 1, -penalty) + flat[k].marks * np.where(present[k], weight, -weight) for k in alive]
            alive = alive[_within(_rows(gains, -penalty)) >= _least(n[alive], penalty)]
    waiting: list[tuple[int, np.ndarray]] = []
    by_doc: dict[tuple[int, int], np.ndarray] = {}
    for k in alive.tolist():
        d, item = pairs[k][0], flat[k]
        if (d, item.size) not in by_doc:
            by_doc[d, item.size] = shingles(docs[d], item.size)
        b = item.windows(docs[d], by_doc[d, item.size])
        if b is not None:
            waiting.append((k, b))
    # Alignments of pairs of like size at once; a very long one by itself, block by block.
    small = [x for x in waiting if flat[x[0]].n * len(x[1]) <= CELLS // 8]
    long = [x for x in waiting if flat[x[0]].n * len(x[1]) > CELLS // 8]
    reached = []
    for group, (a, marks, b) in _groups(small, flat):
        score = _reach(a, marks, b, *BOUNDS[0])
        reached += [x for x, s in zip(group, score) if s >= _least(flat[x[0]].n, BOUNDS[0][0])]
    found = []
    # A high penalty leaves out the words behind an edit at an end, a low one takes in what only looks alike.
    for penalty in PENALTIES:
        open_: list[tuple[int, np.ndarray]] = []
        for group, (a, marks, b) in _groups(reached, flat):
            tables = np.zeros((3, a.shape[1] + 1, b.shape[1] + 1, len(group)), np.int32)
            _reach(a, marks, b, penalty, 0, tables)
            for g, (k, own) in enumerate(group):
                own_tables = tuple(t[: flat[k].n + 1, : len(own) + 1, g] for t in tables)
                verdict = _judged(_Blocks(flat[k].numbers, own, penalty, own_tables), flat[k])
                if verdict:
                    found.append(k)
                elif verdict is None:
                    open_.append((k, own))
        reached = open_
        still = []
        for k, own in long:
            verdict = _judged(_Blocks(flat[k].numbers, own, penalty), flat[k])
            if verdict:
                found.append(k)
            elif verdict is None:
                still.append((k, own))
        long = still
    return [pairs[k] for k in sorted(found)]


def _groups(waiting: list[tuple[int, np.ndarray]], items: list[_Item]) -> Iterator[tuple[list, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Pairs of like size, with their padded words, marks and windows."""
    waiting = sorted(waiting, key=lambda x: len(x[1]))
    at = 0
    while at < len(waiting):
        stop = at + 1
        while stop < len(waiting) and (stop - at + 1) * len(waiting[stop][1]) <= TOGETHER:
            stop += 1
        group = waiting[at:stop]
        own = [items[k] for k, _ in group]
        yield group, (_rows([i.numbers for i in own], -3), _rows([i.marks for i in own], 0), _rows([b for _, b in group], GAP))
        at = stop


def _lists(column: pa.Array, kind: type) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[lo:hi].astype(kind, copy=False) for lo, hi in zip(offsets[:-1], offsets[1:])]


def _verify(batches: Iterator[pa.RecordBatch], sent=None) -> Iterator[pa.RecordBatch]:
    """(doc, item) of the pairs that hold; items come with the pairs, or all of them with ``sent``."""
    known: dict[int, _Item] = {}
    for b in batches:
        keys = b.column("doc").to_pylist()
        hashes, bounds = tokens(b.column("text").to_pylist())
        of = b.column("pairs").offsets.to_numpy()
        own = b.column("pairs").values
        if len(known) > 4 * ITEMS_AT_ONCE:
            known.clear()
        if sent is None:
            names = own.field("item").to_pylist()
            for name, h, marks in zip(names, _lists(own.field("h"), np.int64), _lists(own.field("marks"), np.int64)):
                if name not in known:
                    known[name] = _Item(h.view(np.uint64), marks)
        else:
            names = own.to_pylist()
            for name in set(names) - known.keys():
                known[name] = _Item(*sent.value[name])
        docs = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(keys))]
        found = held_pairs(docs, [[known[name] for name in names[lo:hi]] for lo, hi in zip(of[:-1], of[1:])])
        yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d, _ in found], b.schema.field("doc").type), pa.array([names[of[d] + k] for d, k in found], pa.int64())], ["doc", "item"])


def holds(item: list[str], distinct: set[str], doc: list[str]) -> bool:
    """Whether a document of these words holds an item of these; ``distinct`` are its names, numbers are known as such."""
    h, _ = tokens([" ".join(item)])
    d, _ = tokens([" ".join(doc)])
    marks = np.array([i for i, w in enumerate(item) if w.isdigit() or w in distinct], np.int64)
    return bool(held_pairs([d], [[_Item(h, marks)]]))


# --- Join -----------------------------------------------------------------------


def _pass(corpus: DataFrame, items: DataFrame, n_shingles: int) -> DataFrame:
    """(doc, item) of the documents of ``corpus`` that hold one of ``items``."""
    spark, doc_type = corpus.sparkSession, corpus.schema["doc"].dataType.simpleString()
    least, near, shortest, n_items = items.agg(F.min("t"), F.min("u"), F.min("n"), F.count(F.lit(1))).first()
    bitmap, bits = _bloom(items, n_shingles)
    bloom, sizes = spark.sparkContext.broadcast(bitmap), range(min(SHINGLE, shortest), SHINGLE + 1)
    kept = corpus.mapInArrow(lambda it: _suspects(it, bloom, bits, least, near, sizes), f"doc {doc_type}, text string, pos array<int>, hash array<bigint>")
    suspects = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "suspects")
    hits = suspects.select("row", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select("row", F.col("x.pos").alias("pos"), F.col("x.hash").alias("h"))

    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    each = items.select("item", "t", "u", "drift", F.size("shingles").alias("m"), F.posexplode("shingles").alias("p", "h"))
    order = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "h", "p")
    ranked = each.join(counts, "h", "left").withColumn("rank", F.row_number().over(order))
    left_out = F.floor(F.col("u") / 2)
    prefix = materialize(ranked.where(F.col("rank") <= F.col("m") - left_out).select("item", "h", "p", "drift", (F.col("t") - left_out).alias("t"), (F.col("u") - left_out).alias("u")), "prefixes")
    if n_shingles <= SENT_SHINGLES:
        prefix = F.broadcast(prefix)
    joined = hits.join(prefix, "h").withColumn("d", F.floor((F.col("pos") - F.col("p")) / F.col("drift")).cast("int"))
    diagonals = joined.groupBy("row", "item", "d").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), F.max("u").alias("u"))
    pairs = diagonals.groupBy("row", "item").agg(F.sum("n").alias("n"), F.max("t").alias("t"), F.max("u").alias("u"), F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("by"))
    # Hits on two neighbouring diagonals, as a drifting passage leaves them.
    beside = F.exists(F.map_keys("by"), lambda d: F.try_element_at("by", d) + F.coalesce(F.try_element_at("by", d + F.lit(1)), F.lit(0)) >= F.col("u"))
    chosen = pairs.where((F.col("n") >= F.col("t")) & beside).select("row", "item")

    # A document's pairs are verified together, its words taken once; of many items by slices of about ITEMS_AT_ONCE.
    sent = None
    if n_shingles <= SENT_SHINGLES:
        sent = spark.sparkContext.broadcast({r[0]: (np.array(r[1], np.int64).view(np.uint64), np.array(r[2], np.int64)) for r in items.select("item", "h", "marks").collect()})
        each = chosen.select("row", "item", F.col("item").alias("pair"))
    else:
        each = chosen.join(items.select("item", "h", "marks"), "item").select("row", "item", F.struct("item", "h", "marks").alias("pair"))
    # Alignment costs more than its rows weigh: the number of its tasks is not left to their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slice_ = F.pmod("item", F.lit(-(-n_items // ITEMS_AT_ONCE)))
    found = each.groupBy("row", slice_.alias("slice")).agg(F.collect_list("pair").alias("pairs")).repartition(tasks, "row")
    ready = found.join(suspects.select("row", "doc", "text"), "row").select("doc", "text", "pairs")
    return ready.mapInArrow(lambda it: _verify(it, sent), f"doc {doc_type}, item long")


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key) of every document that holds an item."""
    item_type = items.schema[item_key].dataType
    source = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull())
    known = materialize(source.mapInArrow(_item_batches, _ITEMS), "items")
    distinct = materialize(_distinct_items(known).withColumn("item", F.monotonically_increasing_id()), "item-texts")
    n_shingles = distinct.agg(F.sum(F.size("shingles"))).first()[0]
    if not n_shingles:
        return docs.select(F.col(doc_key).alias("doc")).limit(0).select(F.col("doc").alias(doc_key), F.lit(None).cast(item_type).alias(item_key))
    corpus = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    passes = -(-n_shingles // AT_ONCE)
    parts = [distinct if passes == 1 else distinct.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i) for i in range(passes)]
    found = None
    for part in parts:
        one = _pass(corpus, part, -(-n_shingles // passes))
        found = one if found is None else found.unionByName(one)
    named = known.select("text", F.col("item").alias("name")).join(distinct.select("text", "item"), "text").select("item", "name")
    pairs = found.join(named, "item").select("doc", F.col("name").alias("item")).distinct()
    return pairs.select(F.col("doc").alias(doc_key), F.col("item").cast(item_type).alias(item_key))
