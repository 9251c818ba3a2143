"""A scan of texts for the phrases of a dictionary: whole phrases, leftmost first, the longest at a place, never overlapping.

Texts and phrases are cut into words and single other characters, and a trie of these is walked from each place of a text. A
dictionary of more than a checked size is not sent to tasks, as it may be larger than their memory: of a batch of texts the runs of
tokens as long as a phrase are hashed at once, those whose bit no phrase has go, and the rest are joined with the phrases; a fold
over the places of a document picks the ones that count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.folding import fold_array, folded
from ..sources.shared import cut

#: Phrases and their characters in one trie at most; what is sent to each executor at once.
PART_PHRASES, PART_CHARS = 200_000, 8_000_000
#: Longer phrases are looked up only where a phrase has the same first tokens, this many; characters whose hashes a task holds at once.
FIRST, CHARS = 3, 1 << 20
_TOKEN = re.compile(r"\w+|\W")
_END = ""  # no token is empty, so it can mark where a phrase ends


def trie(phrases: list[tuple[str, object]]) -> dict:
    """Nested dictionaries by token; under _END is the phrase's key. Of equal phrases the first counts."""
    root: dict = {}
    for phrase, key in phrases:
        at = root
        for token in _TOKEN.findall(phrase):
            at = at.setdefault(token, {})
        if at is not root:
            at.setdefault(_END, key)
    return root


def matches(text: str, root: dict) -> Iterator[tuple[int, int, object]]:
    """(start, stop, key) of the phrases in a text, in characters."""
    tokens = _TOKEN.findall(text)
    word = [t[0] == "_" or t[0].isalnum() for t in tokens]
    n, place, i = len(tokens), 0, 0
    while i < n:
        best, at, j, far = None, root, i, place
        # A phrase neither begins nor ends inside of a word.
        if tokens[i] in root and (word[i] or i == 0 or not word[i - 1]):
            while j < n and (at := at.get(tokens[j])) is not None:
                far += len(tokens[j])
                j += 1
                if _END in at and (word[j - 1] or j == n or not word[j]):
                    best = j, far, at[_END]
        if best:
            yield place, best[1], best[2]
        step = best[0] if best else i + 1
        place += sum(len(tokens[k]) for k in range(i, step))
        i = step


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, start and falling stop -> those that do not overlap one taken before."""
    doc, free = object(), 0
    for b in batches:
        keep = []
        for d, start, stop in zip(*(b[c].to_pylist() for c in ("doc", "start", "stop")), strict=True):
            if d != doc:
                doc, free = d, 0
            keep.append(start >= free)
            if start >= free:
                free = stop
        yield b.filter(pa.array(keep, pa.bool_()))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_words: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _is_word(points: np.ndarray) -> np.ndarray:
    """Whether code points are of words, as `\\w` has it."""
    if not _words:
        _words.append(np.array([(c := chr(i)) == "_" or c.isalnum() for i in range(0x110000)]))
    return _words[0][points]


class Runs:
    """The tokens of texts, and hashes of runs of them, from running sums: a character at place i counts times _STEP ** i."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        edges = np.cumsum([0, *map(len, texts)])  # of texts
        new = np.zeros(n + 1, bool)
        new[edges] = True
        word = _is_word(points)
        new[:-1] |= ~word | ~np.append(False, word[:-1])
        new[n] = True
        self.at = np.flatnonzero(new)  # starts of tokens, and the end
        self.size = len(self.at) - 1
        first = self.at[:-1]
        self.row = np.searchsorted(edges, first, "right") - 1
        self.base, self.last = edges[self.row], np.searchsorted(first, edges[self.row + 1]) if n else first  # where a token's text starts, and the token after its text
        own, same = word[first], np.append(False, self.row[1:] == self.row[:-1])[: self.size]  # a token is a word; it follows one of its text
        before = np.append(False, own)
        self.starts = own | ~same | ~before[:-1]  # a phrase may begin at token i: not inside of a word
        self.ends = before | ~np.append(own & same, False)  # or end before it
        powers = lambda x: np.cumprod(np.append(np.uint64(1), np.full(n, x)))
        self.back, marks = powers(_BACK), _mix(points.astype(np.uint64) + _STEP)
        self.sums = np.append(np.uint64(0), np.cumsum(marks * powers(_STEP)[:-1]))

    def of(self, i: np.ndarray, tokens: int) -> np.ndarray:
        """Hashes of runs of so many tokens from tokens i on, which are in the same text."""
        a, b = self.at[i], self.at[i + tokens]
        return _mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64)).view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases with the hash of all their tokens, that of the first ones, and their number."""
    for b in batches:
        for b in _parts(b, "phrase"):  # noqa: B020, PLW2901
            runs = Runs(b["phrase"].to_pylist())
            first = np.flatnonzero(np.append(True, np.diff(runs.row) != 0)) if runs.size else np.empty(0, np.int64)
            n, h, lead = runs.last[first] - first, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for tokens in np.unique(n).tolist():
                of = n == tokens
                h[of], lead[of] = runs.of(first[of], tokens), runs.of(first[of], min(tokens, FIRST))
            yield b.append_column("h", pa.array(h)).append_column("lead", pa.array(lead)).append_column("n", pa.array(n.astype(np.int32)))


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts of about CHARS characters; a longer text is a part by itself."""
    upto, at = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(batch[column]), 0).to_numpy(zero_copy_only=False))), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHARS, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _bits(known: DataFrame, n: int):
    """A broadcast of bits, 2 ** 27 (16 MB) at most and of a number that is a power of two: set where a phrase's h or lead has its low bits."""
    size = min(1 << 27, 1 << max(16, (32 * n).bit_length()))
    got = known.select(F.explode(F.array("h", "lead")).alias("h")).select(F.col("h").bitwiseAND(F.lit(size - 1).cast("long")).alias("bit")).groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(size >> 3, np.uint8)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return known.sparkSession.sparkContext.broadcast(out)


def _joined(texts: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(doc, start, stop, key) of all places of phrases (phrase, key), n of them, in texts (doc, text), overlapping ones too. The texts are read once, however many phrases there are."""
    doc, key = texts.schema["doc"].dataType, known.schema["key"].dataType
    known = cut(known.mapInArrow(_hashed, f"phrase string, key {key.simpleString()}, h long, lead long, n int"))
    lengths = sorted(r.n for r in known.select("n").distinct().collect())
    bits = _bits(known, n)

    def run(batches):
        held = lambda h: (bits.value[(h & (8 * len(bits.value) - 1)) >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch["doc"], fold_array(batch["text"])], names=["doc", "text"])
            for b in _parts(whole, "text"):
                runs, places = Runs(b["text"].to_pylist()), []
                may = np.flatnonzero(runs.starts)
                lead = may[may + FIRST <= runs.last[may]]
                lead = lead[held(runs.of(lead, FIRST))]
                for tokens in lengths:
                    i = lead if tokens > FIRST else may
                    i = i[i + tokens <= runs.last[i]]
                    i = i[runs.ends[i + tokens]]
                    h = runs.of(i, tokens)
                    found = held(h)
                    places.append((i[found], runs.at[i[found]], runs.at[i[found] + tokens], h[found]))
                i, start, stop, h = (np.concatenate(x) for x in zip(*places, strict=True))
                said = pa.array([runs.text[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(runs.row[i])), pa.array((start - runs.base[i]).astype(np.int32)), pa.array((stop - runs.base[i]).astype(np.int32)), pa.array(h), said], names=["doc", "start", "stop", "h", "phrase"])

    places = texts.mapInArrow(run, f"doc {doc.simpleString()}, start int, stop int, h long, phrase string")
    return places.join(known.select("h", "phrase", "key"), ["h", "phrase"]).select("doc", "start", "stop", "key")


def scan(docs: DataFrame, phrases: DataFrame, part_phrases: int = PART_PHRASES) -> DataFrame:
    """(doc, start, stop, key) of each phrase found in the folded texts of docs (doc, text), in characters of these.

    `phrases` is (phrase, key); they are folded, empty ones go, and one with several keys has the smallest. A dictionary of more
    than `part_phrases` phrases, or PART_CHARS characters, is not sent to tasks as a trie, but joined. The documents are read
    once. Null documents are left out, null texts have no phrase.
    """
    spark = docs.sparkSession
    known = phrases.select(folded(F.col("phrase")).alias("phrase"), "key").filter("phrase <> '' and key is not null").groupBy("phrase").agg(F.min("key").alias("key"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    kinds = docs.schema["doc"].dataType.simpleString(), phrases.schema["key"].dataType.simpleString()
    schema = f"doc {kinds[0]}, start int, stop int, key {kinds[1]}"
    key_type = to_arrow_type(phrases.schema["key"].dataType)
    texts = docs.filter("doc is not null").select("doc", "text")
    if size.n > part_phrases or size.chars > PART_CHARS:
        return _joined(texts, known, size.n).repartition("doc").sortWithinPartitions("doc", "start", F.desc("stop")).mapInArrow(_first_free, schema)
    root = spark.sparkContext.broadcast(trie([(r.phrase, r.key) for r in known.collect()]))

    def run(batches):
        for b in batches:
            found = [(i, *m) for i, t in enumerate(fold_array(b["text"]).to_pylist()) for m in matches(t, root.value)]
            if found:
                at, start, stop, key = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(at)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(key, key_type)], ["doc", "start", "stop", "key"])

    return texts.mapInArrow(run, schema)


def expected_keys(found: DataFrame) -> DataFrame:
    """(doc, keys) of a scan: the distinct keys of each document, in order."""
    return found.select("doc", "key").distinct().groupBy("doc").agg(F.sort_array(F.collect_list("key")).alias("keys"))
