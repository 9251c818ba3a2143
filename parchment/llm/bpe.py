"""Byte-level BPE: encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import math
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Recent, in_arrow, slices

#: Fixed value: the split pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of each of a worker's memories of words; words of more characters are not remembered.
MEMORY, REMEMBERED_CHARS = 36 << 20, 64
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 100_000
#: Ids that are decoded at once.
DECODED_IDS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """The suffix automaton of a set of byte strings: a state for each class of their substrings that end at the same places.

    After reading bytes, the state holds the longest suffix of what was read that is a substring of some string. A string of
    the set is the longest one of its state, so the strings that end here are met along the suffix links, longest first.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.token = [-1], [0], [-1]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length), self.token.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """q's state for the strings that come from p by c, where q holds longer ones too."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, string: bytes, token: int) -> None:
        last = 0
        for c in string:
            if (q := self.next[last].get(c)) is not None:
                last = self._split(last, q, c)
                continue
            now, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                self.link[now] = self._split(p, self.next[p][c], c)
            last = now
        self.token[last] = token

    def close(self) -> None:
        """Find the next state with a string along the links of each state; call it after the last add."""
        self.onward = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.onward[s] = up if self.token[up] >= 0 else self.onward[up]


def read_bytes(path: str) -> tuple[dict, dict[int, bytes], dict[str, int]]:
    """The model of a vocabulary file, the bytes of each id, and the ids of special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    found = {i: bytes(letters[c] for c in t) for t, i in model["model"]["vocab"].items()}
    return model["model"], found | {i: t.encode() for t, i in special.items()}, special


class Bpe:
    """A vocabulary with its merges, as tables of ids.

    Every prefix of a word has one last token in its encoding. A token t that ends the prefix is that one if t is what
    the encoder makes of its own bytes and t can follow the last token of the prefix before it: see `follows`.
    """

    def __init__(self, path: str):
        model, self.bytes, self.special = read_bytes(path)
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = n
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), n
        self._spines: dict[tuple[int, int], list[int]] = {}
        self._pairs = Recent(PAIRS * 220)
        self.automaton = SuffixAutomaton()
        for t, i in sorted((t, i) for i, t in self.bytes.items()):
            if i not in self.special.values() and self._whole(i):
                self.automaton.add(t, i)
        self.automaton.close()
        self._split = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._words, self._parts = Recent(MEMORY), Recent(MEMORY)

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens that hold the last (side 1) or first (side 0) byte of a token, as its merges make them."""
        if (token, side) not in self._spines:
            line = [token]
            while line[-1] in self.parts:
                line.append(self.parts[line[-1]][side])
            self._spines[token, side] = line[::-1]
        return self._spines[token, side]

    def _meets(self, a: int, b: int) -> tuple[float, bool]:
        """The rank of the first merge across the border of a and b, and whether both are whole by then; infinity if none comes."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            across = self.rank.get((left[i], right[j]), math.inf)
            next_left = self.born[left[i + 1]] if i + 1 < len(left) else math.inf
            next_right = self.born[right[j + 1]] if j + 1 < len(right) else math.inf
            if across < next_left and across <= next_right:  # of equal merges the leftmost comes first
                return across, i + 1 == len(left) and j + 1 == len(right)
            if next_left == next_right == math.inf:
                return math.inf, True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _whole(self, token: int) -> bool:
        """Whether the encoder makes this one token of its bytes."""
        if token not in self.parts:
            return len(self.bytes[token]) == 1
        a, b = self.parts[token]
        rank, last = self._meets(a, b)
        return rank == self.born[token] and last and self._whole(a) and self._whole(b)

    def follows(self, a: int, b: int) -> bool:
        """Whether a and b stay side by side: no merge joins them."""
        key = a << 32 | b
        if (found := self._pairs.get(key)) is None:
            found = self._meets(a, b)[0] == math.inf
            self._pairs.put(key, found, 0)
        return found

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit numbers."""
        raw = word.encode("utf-8", "replace")
        size, known, automaton = len(raw), self._pairs.new, self.automaton
        moves, links, lengths, tokens, onward = automaton.next, automaton.link, automaton.length, automaton.token, automaton.onward
        last, back = [0] * (size + 1), [0] * (size + 1)
        state = held = 0
        for end, c in enumerate(raw, 1):
            while (to := moves[state].get(c)) is None and state:
                state = links[state]
                held = lengths[state]
            if to is not None:
                state, held = to, held + 1
            at = state if tokens[state] >= 0 and lengths[state] == held else onward[state]
            while at:  # a token that ends here, longest first: the only one that fits is the prefix's last
                token, start = tokens[at], end - lengths[at]
                if start:
                    fit = known.get(last[start] << 32 | token)
                    if fit is None:
                        fit = self.follows(last[start], token)
                if not start or fit:
                    last[end], back[end] = token, start
                    break
                at = onward[at]
        out = []
        while size:
            out.append(last[size])
            size = back[size]
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def _ids(self, word: str) -> bytes:
        if (found := self._words.get(word)) is None:
            found = self.encode_word(word)
            if len(word) <= REMEMBERED_CHARS:
                self._words.put(word, found, 2 * len(word) + len(found))
        return found

    def _after_space(self, part: str) -> bytes | None:
        """Ids of a space and then part, where that can be cut off from what surrounds it; else None."""
        if (found := self._parts.get(part)) is not None:
            return found
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        pieces = self._split.findall(" " + part)
        if len(pieces) == 1:
            found = self.encode_word(pieces[0])
        else:
            head = self._after_space(pieces[0][1:]) if len(pieces[0]) > 1 and pieces[0][0] == " " else None
            found = b"".join((self._ids(pieces[0]) if head is None else head, *map(self._ids, pieces[1:])))
        if len(part) <= REMEMBERED_CHARS:
            self._parts.put(part, found, 2 * len(part) + len(found))
        return found

    def _plain(self, text: str) -> bytes:
        # A word starts at each space between two characters that are none, and nothing reaches across.
        first, *rest = text.split(" ")
        out = list(map(self._parts.new.get, rest))
        if None in out:
            out = [self._after_space(part) if x is None else x for x, part in zip(out, rest, strict=True)]
        if None in out or first[-1:].isspace():
            return b"".join(map(self._ids, self._split.findall(text)))
        return b"".join((*map(self._ids, self._split.findall(first)), *out))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit numbers. Strings of special tokens become these."""
        if not text:
            return b""
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self._cut.split(text))


class Decoder:
    """The bytes of each id."""

    def __init__(self, path: str):
        found = read_bytes(path)[1]
        every = [found.get(i, b"") for i in range(max(found) + 1)]
        self._size = np.array([len(x) for x in every])
        self._start = np.cumsum(self._size) - self._size
        self._all = np.frombuffer(b"".join(every), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids that lie one behind the other, from ends[i] to ends[i + 1]; bytes that are no UTF-8 become U+FFFD."""
        out: list[str] = []
        at = 0
        while at < len(ends) - 1:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED_IDS, "right")) - 1)
            part = ids[ends[at] : ends[to]]
            sizes = self._size[part]
            stops = np.concatenate(([0], np.cumsum(sizes)))
            text = self._all[np.repeat(self._start[part] - stops[:-1], sizes) + np.arange(stops[-1])].tobytes()
            cuts = stops[ends[at : to + 1] - ends[at]]
            out += [text[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = to
        return out


@lru_cache(1)
def load(path: str) -> Bpe:
    """A vocabulary, read once in each worker."""
    return Bpe(path)


@lru_cache(1)
def load_decoder(path: str) -> Decoder:
    return Decoder(path)


def _fields(df: DataFrame, without: str) -> tuple[list[str], str]:
    kept = [c for c in df.columns if c != without]
    return kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)


def _arrays(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids behind each other, and where each begins and ends."""
    return np.frombuffer(b"".join(ids), "<i4"), np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs without the text column and with `into`, array<int>: the ids of the whole text.

    A null or empty text has no ids. Rows are taken one by one, so ties, repeats and other columns do not matter; `into`
    replaces a column of that name. An empty table gives an empty one. Nothing is shuffled; a worker holds one vocabulary,
    memories of words of bounded size, and a few MB of texts, or one text that is longer.
    """
    kept, fields = _fields(docs.drop(into), text)

    def run(batches):
        bpe = load(path)
        for batch in slices(batches, text):
            column = _id_lists(*_arrays([bpe.encode(t) for t in batch[text].to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), column], names=[*kept, into])

    return in_arrow(docs.select(*kept, text), run, f"{fields}{', ' * bool(kept)}`{into}` array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with `into`, string: the text of each row's ids (empty for null or no ids). Rows are taken one by one; ties, repeats
    and other columns do not matter, a column named like `into` is replaced, and an empty table gives an empty one."""
    kept, fields = _fields(rows, into)

    def run(batches):
        decoder = load_decoder(path)
        for batch in slices(batches, ids):
            column = batch[ids]
            ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
            texts = decoder.decode(column.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return in_arrow(rows.select(*kept), run, f"{fields}, `{into}` string")


def recode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs without the text column and with `ids` and `into`: what encode and then decode give, in one pass."""
    kept, fields = _fields(docs.drop(ids, into), text)

    def run(batches):
        bpe, decoder = load(path), load_decoder(path)
        for batch in slices(batches, text):
            found, ends = _arrays([bpe.encode(t) for t in batch[text].to_pylist()])
            columns = [*(batch[c] for c in kept), _id_lists(found, ends), pa.array(decoder.decode(found, ends), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, into])

    return in_arrow(docs.select(*kept, text), run, f"{fields}{', ' * bool(kept)}`{ids}` array<int>, `{into}` string")
