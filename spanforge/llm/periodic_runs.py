"""Periodic runs of words: a suffix automaton with link-cut access finds repeats that follow on themselves.

The words of a stretch are appended to a suffix automaton. Then each prefix is
accessed as in a link-cut tree of its suffix links: the path to the root takes
the prefix's end as its colour, the last occurrence of all that the path
spells. A segment of one old colour that is recoloured says how far back its
longest text occurred last; if that text is at least as long as the way back,
the two make a square, and with a text of several ways back a run. Preferred
paths are kept as segments on heavy paths, so that an access takes a logarithm
of segments, amortised.

Words that can't be in a run aren't appended: a run of period q repeats every
m-gram at most q words later, over a stretch in proportion to q. Stretches
where that holds for one of the powers of two above q are found with sorted
hashes over many documents at once; they contain their runs whole.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import pieces

#: A run has so many words at least, and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Longer m-grams than this aren't hashed: by then, chance repeats nothing over a whole stretch.
LONGEST_GRAM = 8
SLICE_BYTES = 4 << 20

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixAutomaton:
    """Of a sequence of integers. A state's first transition is in two arrays; only states that branch have a dict."""

    def __init__(self, words):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self._word, self._to = array("q", [-1]), array("i", [-1])
        self._more: dict[int, dict[int, int]] = {}
        self.prefix = array("i")
        for w in words:
            self.prefix.append(self._append(w))

    def _append(self, w: int) -> int:
        length, link, word, to, more = self.length, self.link, self._word, self._to, self._more
        last = self.prefix[-1] if self.prefix else 0
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        to.append(-1)
        p = last
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {w: new}
                elif w in others:
                    q = others[w]
                    break
                else:
                    others[w] = new
            p = link[p]
        else:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        word.append(word[q])
        to.append(to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = copy
            elif (others := more.get(p)) and others.get(w) == q:
                others[w] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
        return new

    def heavy_paths(self) -> array:
        """For each state the first state of its heavy path in the tree of suffix links."""
        n = len(self.length)
        order = np.argsort(np.frombuffer(self.length, np.intc), kind="stable").tolist()
        link, size, most, heavy = self.link, array("i", [1]) * n, array("i", [0]) * n, array("i", [-1]) * n
        for v in reversed(order[1:]):
            p, s = link[v], size[v]
            size[p] += s
            if s > most[p]:
                most[p], heavy[p] = s, v
        head = array("i", range(n))
        for v in order[1:]:
            if heavy[link[v]] == v:
                head[v] = head[link[v]]
        return head


def runs_of(words, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of integers, by start, then period."""
    automaton = SuffixAutomaton(words)
    length, link, head = automaton.length, automaton.link, automaton.heavy_paths()
    coloured: dict[int, list[tuple[int, int]]] = {}  # by heavy path, its lowest segment first: (length of its longest text, colour)
    ends: dict[tuple[int, int], int] = {}
    repeats = min_periods - 1
    for end, v in enumerate(automaton.prefix):
        below = -1  # the colour of the segment below: one colour on two heavy paths is one segment
        while v > 0:
            top, longest = head[v], length[v]
            segments = coloured.get(top)
            if segments is None:
                coloured[top] = [(longest, end)]
            else:
                seen, above = [], -1
                while segments and segments[-1][0] <= longest:
                    seen.append(segments.pop())
                if segments and (not seen or seen[-1][0] < longest):
                    seen.append((longest, segments[-1][1]))
                if seen:
                    above = seen[0][1]
                for n, colour in seen:
                    back = end - colour
                    if colour != below and n >= repeats * back and n + back >= min_words:
                        ends[end - n - back + 1, back] = end
                below = above
                segments.append((longest, end))
            v = link[top]
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def _shortest(low: int, gram: int, min_words: int, min_periods: int) -> int:
    """Of how many words in a row a run with a period from low to 2 * low - 1 repeats the m-gram within a period at least."""
    turn = min_words // min_periods
    periods = {min(max(q, low), 2 * low - 1) for q in (turn, turn + 1)}
    return max(1, min(max(min_words, min_periods * q) - q for q in periods) - gram + 1)


def stretches(ids: np.ndarray, doc: np.ndarray, starts: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int]]:
    """[first, last) of disjoint stretches of all documents' words that hold every run whole.

    ids and doc: each word's number and its document's; starts: where documents start, and the end.
    """
    n = len(ids)
    if not n:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = mixed ^ (mixed >> np.uint64(29))
    at, gram, low, most = np.arange(n), 1, 1, int(np.diff(starts).max())
    found = []
    gap = None
    while min_periods * low <= most:
        if gap is None:
            order = np.argsort(h[at], kind="stable")
            same = np.flatnonzero(h[at[order[1:]]] == h[at[order[:-1]]])
            here = at[order[same]]
            gap = at[order[same + 1]] - here
            by_place = np.argsort(here)
            here, gap = here[by_place], gap[by_place]
        near = here[gap < 2 * low]
        if len(near):
            cut = np.flatnonzero(np.diff(near) != 1)
            first, last = near[np.r_[0, cut + 1]], near[np.r_[cut, len(near) - 1]]
            enough = last - first + 1 >= _shortest(low, gram, min_words, min_periods)
            first, last = first[enough], last[enough]
            found.append((first, np.minimum(last + 2 * low + gram, starts[doc[first] + 1])))
        low *= 2
        if gram < LONGEST_GRAM and gram < low:
            # An m-gram twice as long repeats only where both of its halves do; later occurrences of these are kept too.
            again = np.zeros(n + gram, bool)
            again[here] = True
            again[here + gap] = True
            at = np.flatnonzero(again[:n] & again[gram : n + gram])
            at = at[doc[at] == doc[np.minimum(at + gram, n - 1)]]
            new = np.zeros(n, np.uint64)
            pair = h[at] * np.uint64(0xFF51AFD7ED558CCD) + h[at + gram]
            new[at] = pair ^ (pair >> np.uint64(31))
            h, gram, gap = new, 2 * gram, None
    if not found:
        return []
    first, last = (np.concatenate(x) for x in zip(*found))
    by_place = np.argsort(first, kind="stable")
    merged: list[tuple[int, int]] = []
    for a, b in zip(first[by_place].tolist(), last[by_place].tolist()):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def document_runs(texts: list[bytes | None], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of each text, and its runs."""
    words = [t.split() if t else [] for t in texts]  # at the bytes 9 to 13 and 32
    number = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((number[x] for w in words for x in w), np.int64, int(sizes.sum()))
    starts = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(len(words)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for a, b in stretches(ids, doc, starts, min_words, min_periods):
        d = int(doc[a])
        shift = a - int(starts[d])
        runs[d] += [(s + shift, n, q) for s, n, q in runs_of(ids[a:b].tolist(), min_words, min_periods)]
    return words, runs


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        kept = bytearray(b"\1" * len(words))
        for s, n, q in runs:
            kept[s + q : s + n] = bytes(n - q)
        words = [w for w, k in zip(words, kept) if k]
    return b" ".join(words)


def with_runs(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Add ``runs`` and ``collapsed`` to every row; columns of these names are replaced.

    Words are what stands between ASCII white space. A run is a stretch of words
    of smallest period q, of at least ``min_words`` words and ``min_periods``
    (3 or more) periods, that can't be extended; ``runs`` has them by start, then
    period, with words numbered from 0. ``collapsed`` is the text's words joined
    by one space, less those that a run contains after its first period. A
    null or empty text has no runs and an empty collapsed text. Texts are read whole,
    a text in one task; what a slice of texts needs is some forty times its bytes, and
    only stretches that may hold runs go through the automaton. Repeated rows and
    ids stay as they are. Nothing is shuffled.
    """
    if min_periods < 3 or min_words < 1:
        raise ValueError("min_periods is 3 at least, min_words 1")

    @F.arrow_udf(f"struct<runs: {RUN_TYPE}, collapsed: string>")
    def find(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in pieces(rows, SLICE_BYTES):
            words, runs = document_runs(part.cast(pa.binary()).to_pylist(), min_words, min_periods)
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            offsets = np.r_[0, np.cumsum([len(found) for found in runs])]
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
            collapsed = pa.array([_collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
            yield pa.StructArray.from_arrays([listed, collapsed], ["runs", "collapsed"])

    name = "found"
    while name in docs.columns:
        name += "_"
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    found = docs.withColumn(name, find.asNondeterministic()(F.col(f"`{text_col}`")))
    return found.select(*kept, F.col(f"`{name}`.runs"), F.col(f"`{name}`.collapsed"))
