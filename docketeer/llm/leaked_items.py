"""Problem 9: evaluation passages inside training documents.

Wu-Manber search over words: every run of WINDOW words of an item is a pattern. Blocks of two words give the shift by which
the search may jump, suffix buckets give the patterns to compare, and a direct comparison confirms each. From a confirmed
occurrence the passage is followed to both sides through words that were changed, added or left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import map_arrow

#: Words in a pattern. A passage of 15 words or more of which MATCHED agree always has a run of five equal words:
#: with e unequal places there are e + 1 runs, and (n - e) / (e + 1) is above 4 for every n from 15 on.
WINDOW = 5
MATCHED = 0.89
#: Words of items searched for in one pass over the documents; more items take more passes.
WORDS_A_PASS = 2_000_000
_WORD = re.compile(r"\w+")
#: A word broken at the end of a line.
_BROKEN = re.compile(r"[-¬‐­] ?\r?\n\s*(?=[^\W\d_])")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower().replace("_", " "))


class WuManber:
    """Finds every run of WINDOW words that is also in an item."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        self.window, self.items = window, dict(items)
        #: Suffix block -> prefix words -> places (item, position).
        self.buckets: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
        self.shift: dict[tuple, int] = {}
        for item, words in items:
            for at in range(len(words) - window + 1):
                run = tuple(words[at : at + window])
                self.buckets.setdefault(run[-2:], defaultdict(list))[run[:-2]].append((item, at))
                for k in range(window - 1):
                    block, by = run[k : k + 2], window - 2 - k
                    self.shift[block] = min(by, self.shift.get(block, by))

    def search(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, position in the item, position in ``words``)."""
        m, far, shift, buckets = self.window, self.window - 1, self.shift, self.buckets
        i, n = m - 1, len(words)
        while i < n:
            by = shift.get((words[i - 1], words[i]), far)
            if by:
                i += by
                continue
            for item, at in buckets[words[i - 1], words[i]].get(tuple(words[i - m + 1 : i - 1]), ()):
                yield item, at, i - m + 1
            i += 1


def follow(a: list[str], i: int, b: list[str], j: int, step: int, worst: int = 2, back: int = 9) -> list[tuple[int, int]]:
    """From equal words at a[i], b[j], walk in direction ``step``: the places (i, j) of equal words behind it.

    An unequal place is taken as a changed, added or left-out word, whichever lets more of the next words agree.
    The walk ends when more than ``worst`` of the last ``back`` places were unequal.
    """
    equal, past = [], []
    i, j = i + step, j + step
    while 0 <= i < len(a) and 0 <= j < len(b):
        if a[i] == b[j]:
            equal.append((i, j))
            past.append(0)
            i, j = i + step, j + step
        else:
            best, move = -1, (1, 1)
            for di, dj in ((1, 1), (0, 1), (1, 0), (1, 2), (2, 1), (2, 2)):
                run, x, y = 0, i + di * step, j + dj * step
                while run < 4 and 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
                    run, x, y = run + 1, x + step, y + step
                score = run - 0.6 * (di + dj > 2)
                if score > best:
                    best, move = score, (di, dj)
            past.append(1)
            if max(move) > 1:
                past.append(1)
            i, j = i + move[0] * step, j + move[1] * step
        if sum(past[-back:]) > worst:
            break
    return equal


def best_part(equal: list[tuple[int, int]], min_words: int) -> tuple[int, int, int, int] | None:
    """(matched words, first item word, item words spanned, words spanned): the part of a walk with the most equal words that agrees well enough."""
    best = None
    for x, (i0, j0) in enumerate(equal):
        if len(equal) - x <= (best[0] if best else 0):
            break
        for y in range(len(equal) - 1, x, -1):
            matched, span, wide = y - x + 1, equal[y][0] - i0 + 1, equal[y][1] - j0 + 1
            longest = max(span, wide)
            if longest < min_words or best and matched <= best[0]:
                break
            if matched >= MATCHED * longest:
                best = matched, i0, span, wide
                break
    return best


def passages(search: WuManber, words: list[str], min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(item, matched words, first item word, item words spanned, words spanned): the longest passage of each item of which MATCHED agree."""
    best: dict[int, tuple] = {}
    covered: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for item, at, pos in search.search(words):
        if any(i0 <= at <= i1 and j0 <= pos <= j1 for i0, i1, j0, j1 in covered[item]):
            continue
        a = search.items[item]
        equal = [*reversed(follow(a, at, words, pos, -1)), (at, pos), *follow(a, at, words, pos, 1)]
        (i0, j0), (i1, j1) = equal[0], equal[-1]
        covered[item].append((i0, i1, j0, j1))
        if max(i1 - i0, j1 - j0) + 1 >= min_words and (part := best_part(equal, min_words)):
            best[item] = max(best.get(item, (0,)), part)
    return [(item, *rest) for item, rest in best.items()]


def find_passages(documents: DataFrame, items: DataFrame, min_words: int = 15, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_start, item_words, doc_words): the longest passage of at least ``min_words`` words of each item in each document.

    The items are the query set, taken to the driver in blocks of WORDS_A_PASS words and each searched for in all documents: a map
    without shuffle. Case, punctuation, spacing and line breaks don't count. Null and empty texts and items with fewer than WINDOW
    words give no rows; repeated documents give repeated findings, by doc_id once.
    """
    blocks, size = [[]], 0
    for r in items.select(item_col, item_text).distinct().toLocalIterator():
        words = words_of(r[1])
        if size + len(words) > WORDS_A_PASS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], words))
        size += len(words)
    texts = documents.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    found = None
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = WuManber(block)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in passages(search, words_of(text), min_words)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.int32()) for c in cols[2:]], names=["doc_id", "item_id", "matched", "item_start", "item_words", "doc_words"])

        part = map_arrow(texts, run, "doc_id bigint, item_id bigint, matched int, item_start int, item_words int, doc_words int")
        found = part if found is None else found.unionByName(part)
    return found.distinct()
