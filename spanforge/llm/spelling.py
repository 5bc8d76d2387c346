"""Spelling variants: words within one edit, found by k-d trees over letter counts.

One inserted or deleted letter moves a word's letter counts by one, a replaced
letter moves two of them by one each, so that near words lie within L1 distance
two. For each pair of lengths (equal, or one apart) the words of one length
are in k-d trees, and the others' boxes of that size prune the search; in the
leaves that are left, letters are compared in their order.

The upper levels of a length's tree split its words into cells, each a task's
group; the lower levels are built inside the task. A word goes to its own cell, and
as a question to every cell that its box reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, materialize

#: Letters are counted in so many buckets (code point modulo): letters that share one only prune less.
LETTERS = 97
#: Words a cell is meant to hold, and words of the sample (by hash, so about as many) that its splits are taken from.
CELL_WORDS = 16_384
SAMPLE_WORDS = 65_536
SAMPLE_LEAF = 16
#: Words a leaf of a tree within a cell holds.
LEAF_WORDS = 32
#: Letters that are compared at once.
BLOCK = 1 << 22
QUERY_BLOCK = 1 << 15
#: A word's form is a near word with so many times its occurrences.
RATIO = 5

LETTER_RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_matrix(words: list[str]) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """words x LETTERS; counts end at 255, which brings words nearer only."""
    n, length = codes.shape
    out = np.zeros((n, LETTERS), np.uint8)
    rows = np.arange(n)
    for k in range(length):
        bucket = codes[:, k] % LETTERS
        value = out[rows, bucket]
        out[rows, bucket] = value + (value < 255)
    return out


@dataclass
class Tree:
    """A k-d tree: an inner node is (letter, most, left, right), a leaf (-1, its number, 0, 0); members: the rows of each leaf."""

    nodes: list[tuple[int, int, int, int]]
    members: list[np.ndarray]


def build_tree(counts: np.ndarray, leaf_words: int) -> Tree:
    """Split at the letter and number that halve a node best, until a node is small or of one vector only."""
    nodes: list[tuple[int, int, int, int]] = []
    members: list[np.ndarray] = []
    waiting = [(np.arange(len(counts)), -1, False)]
    while waiting:
        rows, parent, right = waiting.pop()
        if parent >= 0:
            letter, most, a, b = nodes[parent]
            nodes[parent] = (letter, most, a, len(nodes)) if right else (letter, most, len(nodes), b)
        split = None
        if len(rows) > leaf_words:
            part = counts[rows]
            middle = np.partition(part, len(rows) // 2, axis=0)[len(rows) // 2].astype(np.int64)
            tried = np.stack([middle - 1, middle])
            below = np.stack([(part <= t).sum(0) for t in tried])
            off = np.where((tried < 0) | (below == len(rows)) | (below == 0), len(rows), np.abs(2 * below - len(rows)))
            which, letter = np.unravel_index(off.argmin(), off.shape)
            if off[which, letter] < len(rows):
                split = int(letter), int(tried[which, letter])
        if split is None:
            nodes.append((-1, len(members), 0, 0))
            members.append(rows)
        else:
            left = counts[rows, split[0]] <= split[1]
            nodes.append((*split, 0, 0))
            waiting += [(rows[left], len(nodes) - 1, False), (rows[~left], len(nodes) - 1, True)]
    return Tree(nodes, members)


def home_leaves(tree: Tree, counts: np.ndarray) -> np.ndarray:
    """For each word the leaf that holds its vector."""
    out, waiting = np.zeros(len(counts), np.int64), [(0, np.arange(len(counts)))]
    while waiting:
        node, rows = waiting.pop()
        letter, most, a, b = tree.nodes[node]
        if letter < 0:
            out[rows] = most
            continue
        left = counts[rows, letter] <= most
        waiting += [(c, r) for c, r in ((a, rows[left]), (b, rows[~left])) if len(r)]
    return out


def leaves_in_reach(tree: Tree, counts: np.ndarray, longer: int):
    """(leaf, rows): the words whose box meets the leaf's, for words of a tree that are ``longer`` (-1, 0, 1) than these.

    A letter is in excess by one at most and missing by one at most, and not both for lengths one apart.
    """
    most_over, most_under = (1, 0) if longer < 0 else (0, 1) if longer > 0 else (1, 1)
    n = len(counts)
    full = {}  # letter: (low, high) of the box, where it is bounded
    waiting = [(0, np.arange(n), np.zeros(n, np.int16), np.zeros(n, np.int16), full)]
    while waiting:
        node, rows, over, under, box = waiting.pop()
        letter, most, a, b = tree.nodes[node]
        if letter < 0:
            yield most, rows
            continue
        value = counts[rows, letter].astype(np.int16)
        low, high = box.get(letter, (0, 255))
        other_over, other_under = over - np.maximum(value - high, 0), under - np.maximum(low - value, 0)
        for child, new_low, new_high in ((a, low, most), (b, most + 1, high)):
            new_over, new_under = other_over + np.maximum(value - new_high, 0), other_under + np.maximum(new_low - value, 0)
            near = (new_over <= most_over) & (new_under <= most_under)
            if near.any():
                waiting.append((child, rows[near], new_over[near], new_under[near], box | {letter: (new_low, new_high)}))


def _one_edit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of a, rows of b) at exactly one edit, for words of lengths at most one apart."""
    if a.shape[1] > b.shape[1]:
        j, i = _one_edit(b, a)
        return i, j
    size = a.shape[1]
    if size == b.shape[1]:
        return np.nonzero((a[:, None] != b[None]).sum(2) == 1)
    head = np.logical_and.accumulate(a[:, None] == b[None, :, :size], axis=2).sum(2)
    tail = np.logical_and.accumulate(a[:, None, ::-1] == b[None, :, :0:-1], axis=2).sum(2)
    return np.nonzero(head + tail >= size)


def near_in_cell(words: list[str], n: np.ndarray, asked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a cell's words (of one length) and words that ask: (rows of asked with a near word, how many, the row of the best).

    Best: largest n, then the smaller word.
    """
    none = np.empty(0, np.int64)
    if not words or not asked:
        return none, none, none
    codes = word_matrix(words)
    tree = build_tree(letter_counts(codes), LEAF_WORDS)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    best, count = np.full(len(asked), len(words)), np.zeros(len(asked), np.int64)
    sizes = np.array([len(w) for w in asked])
    for size in np.unique(sizes).tolist():
        of_size = np.flatnonzero(sizes == size)
        for at in range(0, len(of_size), QUERY_BLOCK):
            rows = of_size[at : at + QUERY_BLOCK]
            theirs = word_matrix([asked[i] for i in rows])
            for leaf, found in leaves_in_reach(tree, letter_counts(theirs), codes.shape[1] - size):
                inside = tree.members[leaf]
                for some in range(0, len(inside), 4 * LEAF_WORDS):
                    part = inside[some : some + 4 * LEAF_WORDS]
                    step = max(1, BLOCK // (len(part) * codes.shape[1]))
                    for k in range(0, len(found), step):
                        i, j = _one_edit(theirs[found[k : k + step]], codes[part])
                        here = rows[found[k : k + step][i]]
                        np.add.at(count, here, 1)
                        np.minimum.at(best, here, rank[part[j]])
    by_rank = np.argsort(rank)
    some = np.flatnonzero(count)
    return some, count[some], by_rank[best[some]]


def _trees(words: DataFrame) -> dict[int, Tree]:
    """The upper levels of the trees of lengths with more than a cell of words, from a sample of SAMPLE_WORDS.

    The driver sees the sample and one count for each such length.
    """
    sizes = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > CELL_WORDS).collect()}
    if not sizes:
        return {}
    keep = min(1.0, SAMPLE_WORDS / sum(sizes.values()))
    sample = words.where(F.col("size").isin(list(sizes))).where(F.xxhash64("word") / F.lit(2.0**64) + 0.5 < keep).select("word", "size").collect()
    by_size: dict[int, list[str]] = {}
    for r in sample:
        by_size.setdefault(r["size"], []).append(r["word"])
    return {s: build_tree(letter_counts(word_matrix(sorted(w))), max(SAMPLE_LEAF, len(w) * CELL_WORDS // sizes[s])) for s, w in by_size.items()}


def _places(trees: dict[int, Tree], asking: bool):
    """Rows (word, n, size) to (size, cell, word, n): a word's own cell, or all cells that may hold near words."""

    def place(size: int, counts: np.ndarray):
        for target in (size - 1, size, size + 1) if asking else (size,):
            if target not in trees:
                yield target, np.zeros(len(counts), np.int64), np.arange(len(counts))
            elif not asking:
                yield target, home_leaves(trees[target], counts), np.arange(len(counts))
            else:
                for leaf, rows in leaves_in_reach(trees[target], counts, target - size):
                    yield target, np.full(len(rows), leaf), rows

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), QUERY_BLOCK):
                    part = batch.take(pa.array(rows[at : at + QUERY_BLOCK]))
                    counts = letter_counts(word_matrix(part.column("word").to_pylist())) if any(s in trees for s in (size - 1, size, size + 1)) else np.zeros((len(part), 0), np.uint8)
                    for target, cells, found in place(size, counts):
                        taken = part.take(pa.array(found))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), target), pa.int32()), pa.array(cells, pa.int32()), taken.column("word"), taken.column("n")], ["size", "cell", "word", "n"])

    return run


def _search(home: pa.Table, asked: pa.Table) -> pa.Table:
    words, n, questions = home.column("word").to_pylist(), home.column("n").to_numpy(), asked.column("word")
    rows, count, best = near_in_cell(words, n, questions.to_pylist())
    return pa.table({"word": questions.take(pa.array(rows)), "n_near": pa.array(count, pa.int64()), "near": pa.array([words[i] for i in best], pa.string()), "near_n": pa.array(n[best], pa.int64())})


def count_words(docs: DataFrame, run: Column, *, least_length: int, least: int) -> DataFrame:
    """(word, n): the words of ``least_length`` code points at least that occur ``least`` times over all rows; ``run`` gives a row's array of words."""
    words = docs.select(F.explode(run).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_runs(text: Column) -> Column:
    """The runs of letters (A to Z, a to z, U+00C0 to U+00FF) of a text, with A to Z in lower case; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(LETTER_RUN), F.lit(0))


def spelling_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n).

    Two words are near at exactly one inserted, deleted or replaced code point;
    n_near counts them. The form is the near word of largest n (ties: the smaller
    word) if its n is ``ratio`` times the word's at least, else null with form_n;
    ``ratio`` is 2 or more, so that forms lead to more frequent words and end. The
    root is where they end, the word itself if it has no form. Rows of one
    word are added up, null words and those without letters go, a null n counts as
    0; other columns are ignored. No pair leaves a task: a cell answers each
    question with a count and its best word.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 at least")
    n = F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")
    rows = words.select("word", "n").where("word <> ''").groupBy("word").agg(n).withColumn("size", F.char_length("word"))
    stored = materialize(rows, "words")
    trees = _trees(stored)
    schema = "size int, cell int, word string, n bigint"
    home, asked = (stored.mapInArrow(_places(trees, asking), schema) for asking in (False, True))
    answers = home.groupBy("size", "cell").cogroup(asked.groupBy("size", "cell")).applyInArrow(_search, "word string, n_near bigint, near string, near_n bigint")
    best = answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    far = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    joined = stored.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        # A word of n 0 has no form among words of n 0, so that forms have an end.
        F.when(far & (-F.col("best.n") > F.col("n")), F.struct(F.col("best.word").alias("word"), (-F.col("best.n")).alias("n"))).alias("form"),
    )
    found = materialize(joined.select("word", F.col("form.word").alias("form"), "n", "n_near", F.col("form.n").alias("form_n")), "forms")
    discard(stored)
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Follow (word, root) to the end by pointer jumping: every round doubles the way."""
    links = materialize(links, "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(links)
        moved = ahead.where("moved").limit(1).count()
        links = ahead
        if not moved:
            return links.select("word", "root")
