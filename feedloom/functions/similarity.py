"""String similarity: what Spark has no built-in for, as Arrow UDFs over whole batches.

``ratio`` is the Ratcliff-Obershelp ratio of Python's difflib. It is not
symmetric; callers decide about letter case and about which side comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import materialize


def ratio_of(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def ratio_at_least(a: str, b: str, least: float) -> bool:
    """As ``ratio_of(a, b) >= least``, where cheap upper bounds decide most pairs."""
    total = len(a) + len(b)
    if not total:
        return True
    if 2 * min(len(a), len(b)) < least * total:
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


@lru_cache(maxsize=200_000)
def letter_bits(text: str) -> int:
    """A bit for each letter of a text, told from others of its kind by its number; two texts differ in the letters that one lacks."""
    bits, seen = 0, {}
    for c in text:
        seen[c] = nth = seen.get(c, 0) + 1
        bits ^= 1 << (ord(c) + 43 * nth) % 192
    return bits


@lru_cache(maxsize=200_000)
def _ratio_again(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ratio_if_at_least(a: str, b: str, least: float) -> float | None:
    """``ratio_of(a, b)`` if it is ``least`` or more. Letters that one has and the other lacks decide most pairs; pairs that come again are known."""
    if (letter_bits(a) ^ letter_bits(b)).bit_count() > (1 - least) * (len(a) + len(b)) + 1e-9:
        return None
    r = _ratio_again(a, b)
    return r if r >= least else None


class Target:
    """A text that many others are compared with: difflib indexes its second text only once."""

    def __init__(self, text: str):
        self.text = text
        self._m = SequenceMatcher(None, "", text)

    def at_least(self, other: str, least: float) -> bool:
        """As ``ratio_at_least(other, self.text, least)``."""
        if other == self.text:
            return True
        total = len(other) + len(self.text)
        if 2 * min(len(other), len(self.text)) < least * total:
            return False
        self._m.set_seq1(other)
        return self._m.quick_ratio() >= least and self._m.ratio() >= least


def ratio(a: str | Column, b: str | Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def sm_ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio_of(p, q) for p, q in zip(x, y)], dtype="float64")

    return sm_ratio(a, b)


def length_bound(a: str | Column, b: str | Column, least: float) -> Column:
    """Whether lengths alone allow a ratio of ``least``: ratio <= 2 min / (la + lb)."""
    x, y = (F.length(F.col(c)) if isinstance(c, str) else F.length(c) for c in (a, b))
    return 2 * F.least(x, y) >= F.lit(least) * (x + y)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and code points plus 1 with a row for each text, 0 behind its end."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    width = max(1, int(size.max(initial=0)))
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return size, np.where(np.arange(width) < size[:, None], points + np.uint32(1), np.uint32(0))


def _marks(size: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Two words of 64 bits a text: each letter, told from others of its kind by its number, flips one bit. ``size`` must not fall.

    What two texts have in common flips the same bits, so their words differ in no more bits than they have letters that the other lacks.
    """
    marks = np.zeros((2, len(size)), dtype=np.uint64)
    for at in range(letters.shape[1]):
        rows = slice(int(np.searchsorted(size, at, side="right")), None)
        c = letters[rows, at]
        bit = (c + 43 * (letters[rows, :at] == c[:, None]).sum(axis=1)) % 128
        flip = np.uint64(1) << (bit % 64).astype(np.uint64)
        for k in (0, 1):
            marks[k, rows] ^= np.where(bit // 64 == k, flip, np.uint64(0))
    return marks


def _common_letters(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Longest common subsequences of all pairs of rows at once, a bit for each letter of the first text, which has 64 at most."""
    rows, p = np.unique(p, return_inverse=True)
    others, q = np.unique(q, return_inverse=True)
    code, both = np.unique(np.concatenate((x[rows].ravel(), y[others].ravel())), return_inverse=True)
    first, second = both[: x[rows].size].reshape(len(rows), -1), both[x[rows].size :].reshape(len(others), -1)
    masks = np.zeros((len(rows), len(code)), dtype=np.uint64)
    every = np.arange(len(rows))
    for at in range(min(64, first.shape[1])):
        masks[every, first[:, at]] |= np.uint64(1) << np.uint64(at)
    masks[:, code == 0] = 0  # behind the end
    row = np.full(len(p), np.uint64(2**64 - 1), dtype=np.uint64)
    for at in range(second.shape[1]):
        hit = row & masks[p, second[q, at]]
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row)


PAIRS_AT_ONCE = 200_000


def likely_pieces(x: list[str], y: list[str], least: float, among: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``likely_pairs`` a piece at a time. ``among`` tells which pairs of a piece are asked for, before the costlier bound."""
    if not x or not y:
        return
    orders, sizes, letters, marks = [], [], [], []
    for side in (x, y):
        size, points = _letters(side)
        order = np.argsort(size, kind="stable")
        for to, value in ((orders, order), (sizes, size[order]), (letters, points[order])):
            to.append(value)
        marks.append(_marks(sizes[-1], letters[-1]))
    (la, lb), (one, other) = sizes, (m[0] ^ m[1] for m in marks)

    def judged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if among is not None:
            asked = among(orders[0][p], orders[1][q])
            p, q = p[asked], q[asked]
        able = np.ones(len(p), dtype=bool)
        rows = np.flatnonzero((la[p] <= 64) & (la[p] > 0))
        if len(rows):
            i, j = p[rows], q[rows]
            a, b = letters[0][:, : la[i].max()], letters[1][:, : max(1, lb[j].max())]
            able[rows] = _common_letters(a, b, i, j) >= least * (la[i] + lb[j]) / 2 - 1e-9
        return orders[0][p[able]], orders[1][q[able]]

    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for n in np.unique(la):
        # Letters that one has and the other lacks, at most; lengths that allow no match are left out.
        spare = np.floor((1 - least) * (n + lb) + 1e-9)
        fits = np.flatnonzero(np.abs(n - lb) <= spare)
        if not len(fits):
            continue
        low, high = int(fits[0]), int(fits[-1]) + 1  # lengths in order: no gaps
        limit, right = np.minimum(spare[low:high], 255).astype(np.uint8), other[low:high]
        start, stop = (int(np.searchsorted(la, n, side=s)) for s in ("left", "right"))
        step = max(1, PAIRS_AT_ONCE // len(right))
        for k in range(start, stop, step):
            end = min(k + step, stop)
            p, q = np.divmod(np.flatnonzero(np.bitwise_count(one[k:end, None] ^ right[None, :]) <= limit), len(right))
            p, q = p + k, q + low
            differ = np.bitwise_count(marks[0][0][p] ^ marks[1][0][q]).astype(np.int64) + np.bitwise_count(marks[0][1][p] ^ marks[1][1][q])
            keep = differ <= spare[q]
            found.append((p[keep], q[keep]))
            waiting += len(found[-1][0])
            if waiting >= PAIRS_AT_ONCE:
                yield judged(found)
                found, waiting = [], 0
    if waiting:
        yield judged(found)


def likely_pairs(x: list[str], y: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may reach a ratio of ``least``: what ``ratio`` matches is a common subsequence of both.

    Lengths and letters come first (a few ns a pair: two words are compared), then the longest common subsequence.
    """
    pieces = [*likely_pieces(x, y, least), (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    return np.concatenate([p for p, _ in pieces]), np.concatenate([q for _, q in pieces])


def possible_pairs(x: list[str], y: list[str], least: float) -> list[tuple[int, int]]:
    """``likely_pairs`` as a list."""
    p, q = likely_pairs(x, y, least)
    return list(zip(p.tolist(), q.tolist()))


def word_edits(a: list[str], b: list[str]) -> int:
    """Unit-cost edits between two token lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def word_levenshtein(a: str | Column, b: str | Column) -> Column:
    """Edits between two array columns of tokens."""

    @F.pandas_udf(T.IntegerType())
    def edits(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else word_edits(list(p), list(q)) for p, q in zip(x, y)], dtype="Int32")

    return edits(a, b)


CONFUSION = "array<struct<kind:string,truth:string,read:string>>"


def confusions_of(truth: str, read: str) -> list[dict]:
    """What was read for what, from the alignment of two texts; equal-long replacements letter by letter."""
    out = []
    for kind, a, b, c, d in SequenceMatcher(None, truth, read).get_opcodes():
        if kind == "equal":
            continue
        if kind == "replace" and b - a == d - c:
            out += [{"kind": "substitute", "truth": x, "read": y} for x, y in zip(truth[a:b], read[c:d])]
        elif kind == "delete":
            out += [{"kind": "delete", "truth": x, "read": ""} for x in truth[a:b]]
        elif kind == "insert":
            out += [{"kind": "insert", "truth": "", "read": x} for x in read[c:d]]
        else:
            out.append({"kind": "substitute", "truth": truth[a:b], "read": read[c:d]})
    return out


def confusions(truth: str | Column, read: str | Column) -> Column:
    @F.pandas_udf(CONFUSION)
    def aligned(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else confusions_of(p, q) for p, q in zip(x, y)])

    return aligned(truth, read)


def other_player_of_one_line(victim: str, kept: list[str], alike: float = 0.85, stem_alike: float = 0.85, digits_below: float = 0.60) -> bool:
    """Whether a victim is another player than all victims that a chain kept, though of a like name: for the guard of repeated lines.

    It must have digits, be like none of them, and have the letters of one of them with other digits (labels of one character).
    """
    split = lambda t: ("".join(c for c in t if not c.isdigit()), "".join(c for c in t if c.isdigit()))
    letters, digits = split(victim)
    if not digits or any(ratio_of(victim, other) >= alike for other in kept):
        return False
    others = [split(other) for other in kept]
    return any(d and ratio_of(letters, s) >= stem_alike and ratio_of(digits, d) < digits_below for s, d in others)


#: Names of a block at most, and blocks that fewer names are dealt to as well, so that all cores have some.
BLOCK, LEAST_BLOCK, LEAST_BLOCKS = 32_000, 2_000, 6
#: Partitions for the groups of two blocks, told by number, as by size alone few tasks would get them all.
GROUP_PARTS = 96


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK), min(LEAST_BLOCKS, -(-n // LEAST_BLOCK)))


def _meet(texts: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``texts`` (text, own: its block, ...) in every group of two blocks i <= j; ``first`` are those of block i."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = texts.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return met.withColumn("first", F.col("own") <= F.col("other")).drop("own", "other")


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")


def candidate_pairs(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """(a, b): all pairs of texts whose ratio without letter case can reach ``least``; of ``left`` alone each pair once, a < b.

    Texts are dealt to blocks and every two blocks meet in one group, where upper bounds of the ratio decide
    (``likely_pairs``). No pair is lost, and only pairs that pass leave the group. A text is sent once for each
    block of the other side.
    """
    def placed(df: DataFrame) -> tuple[DataFrame, int]:
        texts = materialize(df.select("text", F.lower("text").alias("low")).where("length(low) > 0").distinct(), "texts")
        blocks = _blocks(texts.count())
        return texts.withColumn("own", _block_of(blocks)), blocks

    def to_all(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    x, n = placed(left)
    if right is None:
        rows = _meet(x, n)
    else:
        y, m = placed(right)
        rows = x.select("text", "low", F.col("own").alias("i"), to_all(m).alias("j"), F.lit(True).alias("first"))
        rows = rows.unionByName(y.select("text", "low", to_all(n).alias("i"), F.col("own").alias("j"), F.lit(False).alias("first")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf["first"]]
        alone = right_is_left and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        other = one if alone else pdf[~pdf["first"]]
        p, q = likely_pairs(one["low"].tolist(), other["low"].tolist(), least)
        a, b = one["text"].to_numpy(dtype=object)[p], other["text"].to_numpy(dtype=object)[q]
        if right_is_left:
            rising = np.fromiter((s < t for s, t in zip(a, b)), dtype=bool, count=len(a))
            keep = rising | (not alone)  # in one block a pair is found both ways
            a, b = np.where(rising, a, b)[keep], np.where(rising, b, a)[keep]
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    right_is_left = right is None
    return rows.repartition(GROUP_PARTS, "i", "j").groupBy("i", "j").applyInPandas(run, "a string, b string")


#: Names of one prefix in a cell at most; names of several short prefixes compared at once.
CELL, TOGETHER = 4_000, 500


def _meet_by_prefix(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` (text, head, ...) in groups (bucket, i, j): of every two cells, i <= j, of a prefix; ``own`` is a row's cell."""
    sizes = rows.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    own = rows.join(sizes, "head").withColumn("own", F.pmod(F.xxhash64("text"), F.col("cells")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "cells")
    return met.withColumn("bucket", F.pmod(F.xxhash64("head"), F.lit(GROUP_PARTS)))


def _heads_together(heads: pd.Series) -> pd.Series:
    """Numbers of the runs of heads to be compared at once, for ``heads`` in order."""
    counts = heads.value_counts(sort=False).sort_index()
    return heads.map(pd.Series((counts.cumsum() - 1) // TOGETHER, index=counts.index))


def prefix_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of ``texts`` (text, head) with one head, their prefix, whose ratio without letter case can reach ``least``.

    A prefix of many names is dealt to cells, every two of which meet; prefixes of few names share their groups.
    """
    rows = texts.select("text", "head", F.lower("text").alias("low")).where("text is not null").distinct()
    met = _meet_by_prefix(rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values(["head", "text"])
        out: list[tuple] = []
        for _, some in pdf.groupby(_heads_together(pdf["head"]), sort=False):
            one, other = (some, some) if i == j else (some[some["own"] == i], some[some["own"] == j])
            p, q = likely_pairs(one["low"].tolist(), other["low"].tolist(), least)
            (a, b), (h, k) = ((one[c].to_numpy(dtype=object)[p], other[c].to_numpy(dtype=object)[q]) for c in ("text", "head"))
            out += [(min(s, t), max(s, t)) for s, t, u, v in zip(a, b, h, k) if u == v and (i < j or s < t)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return met.repartition(GROUP_PARTS, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(run, "a string, b string")


def _forest(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[str, str]]:
    """Pairs of ``tie`` that hold together what the similar rows of ``left`` and ``right`` (places) tie: fewer than there are ties.

    A pair whose ties hold together already is not compared any more. Of two names that of more matches, or the first, is the first text.
    """
    node, ties = pd.factorize(rows["tie"])
    node_of, head = node.tolist(), pd.factorize(rows["head"])[0] if "head" in rows else None
    names = list(zip((-rows["matches"]).tolist(), rows["text"], rows["low"]))
    parent, out = list(range(len(ties))), []

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        roots = np.array(parent)
        while ((up := roots[roots]) != roots).any():
            roots = up
        p, q = left[p], right[q]
        asked = roots[node[p]] != roots[node[q]]
        if left is right:
            asked &= p < q
        return asked if head is None else asked & (head[p] == head[q])

    x, y = ([names[k][2] for k in side.tolist()] for side in (left, right))
    for p, q in likely_pieces(x, y, least, apart):
        for i, j in zip(left[p].tolist(), right[q].tolist()):
            a, b = top(node_of[i]), top(node_of[j])
            if a != b:
                first, second = sorted((names[i], names[j]))
                if ratio_of(first[2], second[2]) >= least:
                    parent[b] = a
                    out.append((ties[node_of[i]], ties[node_of[j]]))
    return out


TIES = "a string, b string"


def prefix_ties(names: DataFrame, least: float) -> DataFrame:
    """(a, b): what ties the names (text, low, head, matches, tie) of one head whose ratio reaches ``least``, as a forest in each group of ``prefix_pairs``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        pdf = pdf.sort_values(["head", "text"])
        out: list[tuple] = []
        for _, some in pdf.groupby(_heads_together(pdf["head"]), sort=False):
            left = np.flatnonzero((some["own"] == some["i"]).to_numpy())
            out += _forest(some, left, left if alone else np.flatnonzero((some["own"] == some["j"]).to_numpy()), least)
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return _meet_by_prefix(names).repartition(GROUP_PARTS, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(run, TIES)


def block_ties(names: DataFrame, least: float) -> DataFrame:
    """(a, b): what ties the names (text, low, matches, tie) whose ratio reaches ``least``, as a forest in each group of ``candidate_pairs``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["first"].to_numpy(dtype=bool)
        left = np.flatnonzero(first)
        out = _forest(pdf, left, left if first.all() else np.flatnonzero(~first), least)
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    blocks = _blocks(names.count())
    return _meet(names.withColumn("own", _block_of(blocks)), blocks).repartition(GROUP_PARTS, "i", "j").groupBy("i", "j").applyInPandas(run, TIES)


def digit_conflict(a: str | Column, b: str | Column, least: float = 0.6) -> Column:
    """Both end in three or more digits that don't resemble each other: two different players."""
    end = lambda c: F.regexp_extract(c, "([0-9]{3,})$", 1)
    both = (end(a) != "") & (end(b) != "")
    return both & (F.coalesce(ratio(end(a), end(b)), F.lit(1.0)) < least)
