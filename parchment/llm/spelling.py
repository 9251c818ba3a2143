"""Spelling variants: words one edit apart, by two-dimensional range reporting with wavelet trees, and the forms they lead to.

A word t of T letters and a word q agree but for position i of t if t has q's prefix of i letters and q's suffix of T - 1 - i:
with q as long as t that is a replaced letter, with q one shorter an inserted one. Among words of T letters, those with the
prefix are an interval of their forward order, those with the suffix one of the order of their reversals. Each word is a point
(forward rank, reverse rank), and the words wanted are the points in the rectangle of both intervals.

Spark deals the words out: the positions of t are cut into spans, and a group holds all words that agree outside of one span
(members: of T letters; askers: of T or T - 1). A group of over GROUP letters is dealt out again by the halves of its span, down to a
single position, where a group is as large as the alphabet at most. So no group grows with the table, and no pair is lost: each
position is in one span of each word. Groups are packed into blocks of bounded size, and each block has a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stash

#: Letters of a group beyond which it is dealt out again by half spans, and letters after which a block ends with its group.
GROUP, BLOCK = 400_000, 400_000
#: Rectangles that a tree answers at once.
ASKED = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WaveletTree:
    """A permutation of 0..n-1 by bits, high ones first: at each level the values whose bit is 0 come before the others, in order."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros[level][i]: how many of the first i values there have bit 0
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one, dtype=np.int64))))
            values = np.concatenate((values[~one], values[one]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each value in low..high-1 at a place in left..right-1, for all rectangles together."""
        ask = np.flatnonzero((left < right) & (low < high))
        left, right, value = left[ask], right[ask], np.zeros(len(ask), np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            ask = np.concatenate((ask, ask))
            left, right = np.concatenate((l0, left - l0 + zeros[-1])), np.concatenate((r0, right - r0 + zeros[-1]))
            value = np.concatenate((value, value + (1 << level)))
            keep = (left < right) & (value < high[ask]) & (value + (1 << level) > low[ask])
            ask, left, right, value = ask[keep], left[keep], right[keep], value[keep]
        return ask, value


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points of words, a row each; -1 beyond the end."""
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64) - (np.arange(width) >= np.fromiter(map(len, words), np.int64, len(words))[:, None])


class _Order:
    """Words in order; for a prefix length, where the members that share a word's prefix stand among all members."""

    def __init__(self, letters: np.ndarray, member: np.ndarray):
        self.order = np.lexsort(letters.T[::-1])
        self.place = np.empty(len(letters), np.int64)
        self.place[self.order] = np.arange(len(letters))
        same = letters[self.order[1:]] == letters[self.order[:-1]]
        self.common = np.concatenate(([0], np.cumprod(same, axis=1).sum(1)))  # letters shared with the word before
        self.before = np.concatenate(([0], np.cumsum(member[self.order])))
        self.rank = self.before[self.place]  # a member's rank among members

    def interval(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.common < prefix
        first[0] = True
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        ends = np.append(starts[1:], len(first))
        return self.before[starts[group]][self.place], self.before[ends[group]][self.place]


def near_in_block(words: list[str], member: np.ndarray, width: int, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, member) rows of words that agree but for one position of the member in `span`, each pair once; and each word's place in order.

    A member asks for those with a letter replaced, and has `width` letters; the others, one letter shorter, for those with one more.
    Where several positions give the same longer word, the first of them counts.
    """
    ahead = _letters(words, width)
    backward = _letters([w[::-1] for w in words], width)
    forward, reverse = _Order(ahead, member), _Order(backward, member)
    at = np.flatnonzero(member)
    points = np.empty(len(at), np.int64)
    points[forward.rank[at]] = reverse.rank[at]
    tree = WaveletTree(points)
    by_reverse = np.empty(len(at), np.int64)
    by_reverse[reverse.rank[at]] = at
    askers, found = [], []
    for i in range(*span):
        left, right = forward.interval(i)
        low, high = reverse.interval(width - 1 - i)
        # A member is in its own rectangle, so one of width or height 1 holds no other.
        wide = np.where(member, 1, 0)
        ask = np.flatnonzero((right - left > wide) & (high - low > wide))
        for part in (ask[j : j + ASKED] for j in range(0, len(ask), ASKED)):
            which, value = tree.report(left[part], right[part], low[part], high[part])
            a, b = part[which], by_reverse[value]
            new = a != b
            if i:  # of equal letters side by side in the longer word, the first is the inserted one
                new &= member[a] | (ahead[b, i - 1] != ahead[b, i])
            askers.append(a[new]), found.append(b[new])
    none = [np.empty(0, np.int64)]
    return np.concatenate(askers or none), np.concatenate(found or none), forward.place


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())])


def _summed(words: list[str], n: np.ndarray, place: np.ndarray, of: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """Of each word in `of`: how many near ones, and the one of largest n, ties to the first in order; `less` is minus its n."""
    order = np.lexsort((place[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    count = np.diff(np.append(first, len(of)))
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in of[first]], pa.string()), pa.array(count), pa.array(-n[near[first]]), pa.array([words[i] for i in near[first]], pa.string())], schema=_NEAR)


def _blocks(batches):
    """Rows of sorted batches in blocks of whole groups: all of one width and span, ended by the first group that brings them to BLOCK letters."""
    rows: list[tuple] = []
    last = None
    for b in batches:
        columns = [b[c].to_pylist() for c in ("width", "start", "stop", "head", "tail", "word", "n", "member")]
        for r in zip(*columns, strict=True):
            if last is not None and r[:5] != last and (r[:3] != last[:3] or len(rows) * last[0] >= BLOCK):
                yield last[:3], rows
                rows = []
            last = r[:5]
            rows.append(r[5:])
    if rows:
        yield last[:3], rows


def _report(batches):
    for (width, start, stop), rows in _blocks(batches):
        words, n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        member = np.array([r[2] for r in rows])
        if len(rows) < 2 or not member.any():
            continue
        asker, found, place = near_in_block(words, member, width, (start, stop))
        inserted = ~member[asker]  # the longer word is near the shorter one, too
        if len(asker):
            yield _summed(words, n, place, np.concatenate((asker, found[inserted])), np.concatenate((found, asker[inserted])))


def _spans(rows: DataFrame, cuts: Column) -> DataFrame:
    """rows (word, n, member, width) once for each span [start, stop) of `cuts`, with what lies before and after it in a member."""
    rows = rows.withColumn("cut", F.explode(cuts)).select("word", "n", "member", "width", F.col("cut.start").alias("start"), F.col("cut.stop").alias("stop"))
    return rows.withColumns({"head": F.expr("left(word, start)"), "tail": F.expr("right(word, width - stop)")})


def _halves(start: Column, stop: Column) -> Column:
    middle = F.floor((start + stop) / 2).cast("int")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))
    return F.when(stop - start > 1, F.array(span(start, middle), span(middle, stop))).otherwise(F.array(span(start, stop)))


_KEY = ["width", "start", "stop", "head", "tail"]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, less, form) of each word that has a near one: their count, minus the largest n among them, and the first in order with that n.

    `words` is (word, n), each word once. Near are two words that differ by exactly one inserted, deleted or replaced code point.
    """
    width = F.length("word")
    role = lambda member: F.struct(F.lit(member).alias("member"), (width if member else width + 1).cast("int").alias("width"))
    rows = words.select("word", "n", F.inline(F.array(role(True), role(False))))
    rows = _spans(rows, _halves(F.lit(0), F.col("width")))
    done = None
    while True:
        large = stash(rows.groupBy(*_KEY).count().filter((F.col("count") * F.col("width") > GROUP) & (F.col("stop") - F.col("start") > 1)).select(*_KEY))
        if large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        small = rows.join(large, _KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = _spans(rows.join(large, _KEY, "left_semi").select("word", "n", "member", "width", "start", "stop"), _halves(F.col("start"), F.col("stop")))
    done = done.repartition(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "word", "n", "member")
    found = in_arrow(done, _report, "word string, n_near long, less long, form string")
    best = F.min(F.struct("less", "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.less", "best.form")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): of (word, form), where each chain of forms ends. Chains double their reach each round; there is no cycle."""
    links = stash(links.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("next"))
        reached = stash(links.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        links = reached.select("word", "root")
        if reached.filter("on").isEmpty():
            return links


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each of `words` (word string, n long, each word once).

    form is the near word of largest n, the first in code-point order if several have it, where that n is at least `times` the
    word's own (which must be 2 or more, so that chains end); root is where the chain of forms ends, the word itself without a form.
    Null words go. Empty tables give empty ones. Further columns are not read.
    """
    words = stash(words.filter("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words)
    has = F.col("less").isNotNull() & (-F.col("less") >= F.col("n") * times) & (-F.col("less") > F.col("n"))
    rows = stash(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("form")).alias("form"),
            F.when(has, -F.col("less")).alias("form_n"),
        )
    )
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def counted_words(docs: DataFrame, pattern: str, least_chars: int = 5, least_n: int = 3, every: int = 0) -> DataFrame:
    """(word, n): runs of `pattern` in all whole texts, with A-Z lower-cased, of `least_chars` code points or more, found `least_n` times or more.

    With `every`, a run of a document loses its code point h % length where `every` divides h, the unsigned crc32 of
    `<doc_id>:<run>` in UTF-8; a row without an id loses none. A null or empty text has no run. Repeated rows each count. Counts
    are summed within tasks first, so a frequent word is one row a task; texts of any length are read whole. Further columns are not read.
    """
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), run.alias("run"))
    # lower() is fast, and lowers only A-Z where all is ASCII.
    rows = rows.select("id", F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("word"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        cut = F.expr("concat(left(word, cast(h % length(word) as int)), substr(word, cast(h % length(word) as int) + 2))")
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))
    return rows.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)
