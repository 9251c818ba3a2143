"""Best-fit packing of token sequences, by bin completion with bounds."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import Recent, in_arrow, slices, stash

SEQUENCE = 4096
#: Pieces that one task packs together. A block wastes less than one sequence beyond what its lengths force.
BLOCK = 40_000
#: Bytes of a worker's memory of words; words of more bytes are not remembered.
MEMORY, REMEMBERED_BYTES = 40 << 20, 64
#: Pieces looked at (for fillings, and for what is left after each) after which the search in a block ends with its incumbent.
STEPS = 3_000_000
#: The first dive tries fillings of three pieces that waste less than this. It is an incumbent, and no filling is barred from the search.
THIRDS = 4
_END = 1


class WordTokens:
    """Ids of texts, word by word: this vocabulary drops white space, and nothing reaches across it."""

    #: Fixed value: the split pattern of the vocabulary's file.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Words of Latin letters, which normalisation only lowers; without what could be a special token.
    LATIN = regex.compile(r"(?!.*<\|)[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words = Recent(MEMORY)

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.LATIN.fullmatch(text):
            parts = self.SPLIT.findall(text.lower())
            parts = parts if text.isascii() else ["".join(map(self.letters.__getitem__, p.encode())) for p in parts]
            ids = [t.id for p in parts for t in self.model.tokenize(p)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; a null text has none."""
        words = text.encode("utf-8", "replace").split() if text else []
        out = list(map(self.words.new.get, words))
        if None in out:
            found: dict[bytes, bytes] = {}
            for w, x in zip(words, out, strict=True):
                if x is None and w not in found:
                    found[w] = self.words.old.get(w) or self.word(w)
            out = [found[w] if x is None else x for w, x in zip(words, out, strict=True)]
            for w, x in found.items():
                if len(w) <= REMEMBERED_BYTES:
                    self.words.put(w, x, len(w) + len(x))
        return b"".join(out)


@lru_cache(2)
def load(path: str) -> WordTokens:
    """A vocabulary, read once in each worker."""
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document's ids and then id 1, cut into pieces of `size` (the last may be shorter): id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is one piece of the end id alone. Rows are taken one by one: repeated ids give repeated pieces.
    """
    kind = docs.select(id).schema[0].dataType.simpleString()
    end = np.array([_END], "<u4").tobytes()

    def run(batches):
        words = load(path)
        for batch in slices(batches, "text"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(batch["text"].to_pylist()):
                raw = words.encode(t) + end
                for n, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    row.append(i), piece.append(n), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4"))
            columns = [batch["id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = in_arrow(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), run, f"id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<long>' * with_ids}")
    return out.withColumnRenamed("id", id)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins by best-fit decreasing: each piece, longest first, goes to the fullest bin that it fits in."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    rooms = 0  # a bit for each free space that some bin has
    for x in np.sort(lengths)[::-1].tolist():
        if fit := rooms >> x << x:
            free = (fit & -fit).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                rooms ^= 1 << free
        else:
            free, at = size, len(bins)
            bins.append([])
        bins[at].append(x)
        room.setdefault(free - x, []).append(at)
        rooms |= 1 << (free - x)
    return bins


def bound(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing is below: for each a, pieces over size - a are alone, others over size / 2 each open a bin, and pieces from a to size / 2 fill what these leave."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(size + 1))
    half = size // 2
    a = np.arange(half + 1)
    over = number[-1] - number[half]
    middle = number[size - a] - number[half]
    left = middle * size - (total[size - a] - total[half])
    small = total[half] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    return int((over + np.maximum(0, -((left - small) // size))).max())


class _Pieces:
    """Pieces as counts, with a bit for each length that is left, forwards and backwards."""

    def __init__(self, lengths, size: int):
        self.size, self.count = size, np.bincount(lengths, minlength=size + 1).tolist()
        self.have = sum(1 << x for x in range(1, size + 1) if self.count[x])
        self.back = sum(1 << (size - x) for x in range(1, size + 1) if self.count[x])

    def take(self, x: int, n: int = 1) -> None:
        self.count[x] -= n
        if not self.count[x]:
            self.have ^= 1 << x
            self.back ^= 1 << (self.size - x)

    def longest(self, most: int) -> int:
        return (self.have & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def two(self, total: int, other: int = 0) -> list[int]:
        """The two pieces of this sum of which one is longest, beside a piece `other`."""
        both = self.have & self.back >> (self.size - total)
        while both > 1:
            x = both.bit_length() - 1
            y = total - x
            if x >= y and all(self.count[z] >= (x, y, other).count(z) for z in (x, y)):
                return [x, y]
            both ^= 1 << x
            if x < y:
                break
        return []

    def completion(self, free: int) -> list[int]:
        """A filling of `free` with the least waste: the best-fit one (again and again the longest piece that fits), unless one
        of one or two pieces wastes less, or one of three, of which those that waste less than THIRDS are tried."""
        best, rest = [], free
        while (x := self.longest(rest)) > 0:
            n = min(rest // x, self.count[x] - best.count(x))
            if n <= 0:
                y = x
                while (y := self.longest(y - 1)) > 0 and self.count[y] <= best.count(y):
                    pass
                if y <= 0:
                    break
                x, n = y, min(rest // y, self.count[y] - best.count(y))
            best += [x] * n
            rest -= n * x
        if rest and (x := self.longest(free)) > free - rest:
            best, rest = [x], free - x
        if rest:
            x = free
            while (x := self.longest(x - 1)) * 2 >= free - rest and rest:
                y = self.longest(min(x, free - x))
                if y == x and self.count[x] < 2:
                    y = self.longest(y - 1)
                if y > 0 and free - x - y < rest:
                    best, rest = [x, y], free - x - y
        for waste in range(min(rest, THIRDS)):
            total = free - waste
            x = total
            while (x := self.longest(x - 1)) * 3 >= total:
                if found := self.two(total - x, x):
                    return [x, *found]
        return best


def _lowered(bits: int, most: int) -> int:
    """bits, and each of them moved down by 1 to `most` places."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits >> step
        done += step
    return bits


def fillings(free: int, pieces: list[int], tick) -> list[list[int]]:
    """The undominated sets of pieces (falling) that fit in `free`, least waste first. A set is dominated if a piece outside it can take
    the place of some of its pieces (of more than one, if it is no longer than they are): what it frees packs no worse than it."""
    count: dict[int, int] = {}
    for x in pieces:
        count[x] = count.get(x, 0) + 1
    lengths = sorted(count, reverse=True)
    out: list[tuple[int, list[int]]] = []

    every = sum(1 << x for x in lengths)

    def dominated(fill: list[int], waste: int) -> bool:
        spare, one, more = every, 0, 0  # sums of one piece of the filling, and of more, as bits
        for x in fill:
            more |= (more | one) << x
            one |= 1 << x
            if fill.count(x) == count[x]:
                spare &= ~(1 << x)
        tick(len(fill))
        return bool(_lowered(spare, waste) & more or waste and _lowered(spare >> 1, waste - 1) & one)

    def down(at: int, rest: int, fill: list[int]) -> None:
        tick(1 + len(lengths) - at)
        fits = False
        for k in range(at, len(lengths)):
            x = lengths[k]
            if x > rest:
                continue
            if fill.count(x) < count[x]:
                fits = True
                down(k, rest - x, [*fill, x])
        if not fits and not dominated(fill, rest):
            out.append((rest, fill))

    down(0, free, [])
    return [fill for _, fill in sorted(out, key=lambda f: (f[0], [-x for x in f[1]]))]


class _Ended(Exception):
    pass


def search(lengths: list[int], size: int, below: int, tick) -> list[list[int]] | None:
    """Fewer than `below` bins for the pieces, by depth-first bin completion; None if there are none. tick is told the pieces looked at."""
    failed: set[tuple[int, ...]] = set()

    def down(rest: list[int], left: int) -> list[list[int]] | None:
        if not rest:
            return []
        if (*rest, left) in failed or bound(np.array(rest), size) > left:
            return None
        for fill in fillings(size - rest[0], rest[1:], tick):
            tick(len(rest))
            others = rest[1:]
            for x in fill:
                others.remove(x)
            if (found := down(others, left - 1)) is not None:
                return [[rest[0], *fill], *found]
        failed.add((*rest, left))
        return None

    return down(sorted(lengths, reverse=True), below - 1)


def pack_lengths(lengths: np.ndarray, size: int = SEQUENCE, steps: int = STEPS) -> list[list[int]]:
    """Bins, as few as the search finds; never more than best-fit decreasing makes.

    Incumbents are best-fit decreasing and the first dive of bin completion: the longest piece left opens a bin, the filling
    that wastes least ends it. While they are above the bound, the dive is taken back, last bins first: those of the last
    4, 8, 16, ... bins are searched for a packing in fewer, branch by branch, with the bound for what is left. The search
    ends when the bound is met, when all bins were taken back (the packing is then the best), or after `steps`.
    """
    best, least = best_fit(lengths, size), bound(lengths, size)
    if len(best) <= least:
        return best
    left, dive = _Pieces(lengths, size), []
    while (top := left.longest(size)) > 0:
        left.take(top)
        fill = [top, *left.completion(size - top)]
        left.count[top] += 1  # how often the bin can be made
        need = {x: fill.count(x) for x in fill}
        times = min(left.count[x] // n for x, n in need.items())
        left.count[top] -= 1
        for x, n in need.items():
            if n * times - (x == top):
                left.take(x, n * times - (x == top))
        dive += [fill] * times
    best = min(best, dive, key=len)
    tried = 0

    def tick(n: int) -> None:
        nonlocal tried
        tried += n
        if tried > steps:
            raise _Ended

    last = 4
    try:
        while len(best) > least:
            again = [x for b in best[-last:] for x in b]
            if bound(np.array(again), size) < min(last, len(best)) and (found := search(again, size, min(last, len(best)), tick)):
                best = best[: -last] + found
            elif last >= len(best):
                break
            else:
                last *= 2
    except (_Ended, RecursionError):
        pass
    return best


def place(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and its place there."""
    where = {int(x): list(np.flatnonzero(lengths == x)[::-1]) for x in np.unique(lengths)}
    bins, offsets, number = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for fill in pack_lengths(lengths, size):
        at = 0
        for x in fill:
            i = where[x].pop()
            bins[i], offsets[i] = number, at
            at += x
        number += 1
    return bins, offsets


def pack(rows: DataFrame, length: str = "length", size: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """rows (pieces of 1 to `size` tokens) with sequence_id and offset, long, which replace columns of these names.

    Rows are dealt into blocks of about `block` by a number each row gets, not by a key, so that no value makes a block
    large; each block is packed by itself. Rows are first written to the shared folder: a task that is run again packs
    the same rows. Equal lengths, and equal rows, are taken in row order. Nulls in other columns and any names are kept;
    a null length, or one that is not from 1 to `size`, is an error. An empty table gives an empty one.
    """
    rows = rows.drop("sequence_id", "offset")
    whole = stash(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(length).cast("long").alias("length"), F.monotonically_increasing_id().alias("n")))
    blocks = max(1, -(-whole.count() // block))
    kind = rows.schema.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        lengths = table["length"].to_numpy()
        if table["length"].null_count or lengths.min() < 1 or lengths.max() > size:
            raise ValueError(f"lengths must be 1 to {size}")
        bins, offsets = place(lengths.astype(np.int64), size)
        return table.select(["row"]).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = whole.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)))
    packed = dealt.groupBy("block").applyInArrow(run, f"row {kind}, sequence_id long, offset long")
    return packed.select("row.*", "sequence_id", "offset")
