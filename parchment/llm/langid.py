"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices

GRAMS = (1, 2, 3)
#: Ranks in a profile, of a language or a document.
PROFILE = 300
#: Bound of the sample that profiles are learned from: about so many documents of each language, all if there are fewer.
SAMPLE_PER_LANG = 4000
#: Profiles are broadcast: at most so many languages of PROFILE n-grams each.
MAX_LANGS = 10_000
UNKNOWN = "und"
_BLOCK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(text: str) -> np.ndarray:
    """n-grams of letters and word ends, each as up to 3 code points of 21 bits; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 32).astype(np.int64)
    points = np.concatenate(([32], points, [32]))
    points = points[(points != 32) | (np.concatenate(([33], points[:-1])) != 32)]
    out = [points[points != 32]]
    for n in GRAMS[1:]:
        gram = points[: len(points) - n + 1]
        for i in range(1, n):
            gram = (gram << 21) | points[i : len(points) - n + 1 + i]
        out.append(gram)
    return np.concatenate(out)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _blocks(text: str, size: int):
    """Parts of a text of `size` characters or more (but for the last), cut before white space."""
    at = 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to]
        at = to


def gram_counts(text: str, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a whole text, in order, and their counts. Long texts are counted in blocks, with the n-grams across their borders."""
    counts, before = [(np.empty(0, np.int64),) * 2], -1
    for part in _blocks(text, block):
        grams = _grams(part)
        if not len(grams):
            continue
        counts.append(np.unique(grams, return_counts=True))
        letters = grams[grams < 1 << 21]  # the single letters come first, in order
        if before >= 0:
            counts.append((np.array([before << 42 | 32 << 21 | int(letters[0])]), np.array([1])))
        before = int(letters[-1])
        if len(counts) > 16:
            counts = [_sum(counts)]
    return _sum(counts) if len(counts) > 2 else counts[-1]


def learn_profiles(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", id: str = "doc_id", profile: int = PROFILE, sample_per_lang: int = SAMPLE_PER_LANG) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, by falling count (ties: smaller n-gram), from rows where `labelled` holds.

    Rows with a null language or text teach nothing. The sample takes rows by a hash of their id, about sample_per_lang a language.
    """
    known = docs.filter(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return {}
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang) == r[0], F.lit(sample_per_lang / r[1])).otherwise(share)
    known = known.filter(F.pmod(F.xxhash64(F.col(id)), F.lit(1 << 30)) < share * (1 << 30)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in slices(batches, "text"):
            sums: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                sums.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in sums.items():
                keys, counts = _sum(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    sums = in_arrow(known, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= profile).collect()  # at most MAX_LANGS * profile rows
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Profiles as one sorted list of n-grams and their ranks in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        keys, counts = gram_counts(text)
        if not len(keys):
            return UNKNOWN, 0.0
        keys = keys[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == keys, self.ranks[:, at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(keys)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.size * len(keys))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", profile: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score added (they replace columns of these names).

    Only the text is read. A null text, or one without a letter, is `und` with score 0; of equal distances the first
    language by name wins. Repeated rows get equal answers, texts of any length are counted whole, an empty table gives an
    empty one, and without profiles all rows are `und`. score is 1 - distance / greatest possible distance.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    table = Profiles(profiles, profile)

    def label(batches):
        for batch in slices(batches, text):
            answers = [table.predict(t) for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())], names=[*kept, "lang_pred", "score"])

    return in_arrow(docs.select(*kept), label, f"{fields}, lang_pred string, score double")


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.col(id).cast("string")) % 4 == 2


def train(docs: DataFrame, **options) -> dict[str, list[int]]:
    """Profiles from the rows of docs that are not held out; a null id is never held out."""
    return learn_profiles(docs, ~F.coalesce(held_out(options.get("id", "doc_id")), F.lit(False)), **options)


