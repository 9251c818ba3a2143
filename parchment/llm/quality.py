"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

SYMBOLS = "#*$%&|<>"
#: Marks that may stand beside a stop word.
MARKS = ".,;:!?\"'()[]"

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "for", "it", "on", "as", "was", "are", "this", "by", "from", "at"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "est", "pour", "par", "sur", "pas", "au", "aux"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "un", "una", "que", "por", "con", "para", "es", "se", "lo", "no", "su", "al"],
}


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= metric <= most; a bound that is None does not bind."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The method's own rules, beside those of `base_failed`.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_word_share", least=0.02),
    Rule("dup_line_share", most=0.5),
)


#: Low bits of a packed code, which hold a word's place. In texts with more words all runs are compared.
PLACE_BITS = 24


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words stand in a run of `window` words that occurs twice or more in the text.

    Each run gets a hash. If all differ, no run repeats. Else longs of hash and place are sorted, equal hashes stand side
    by side, and only the runs among them are compared word by word (after a second sort). The places of true repeats, sorted, cover min(window, distance to
    the next) words each. Time is that of the sorts, for texts of any length.
    """
    n = F.size(words)
    place = (1 << PLACE_BITS) - 1

    def codes(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), n - (window - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, window)]))

    def packed(c: Column) -> Column:
        return F.sort_array(F.transform(c, lambda x, i: x.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))))

    def suspects(p: Column) -> Column:
        alike = lambda x, y: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.lit(False))
        near = F.filter(p, lambda x, i: alike(x, F.get(p, i - 1)) | alike(x, F.get(p, i + 1)))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit(place)).cast("int"))

    def run_at(i: Column) -> Column:
        return F.struct(*[F.get(words, i + j).alias(f"w{j}") for j in range(window)], i.alias("at"))

    def same(a: Column, b: Column) -> Column:
        out = a["w0"] == b["w0"]
        for j in range(1, window):
            out = out & (a[f"w{j}"] == b[f"w{j}"])
        return F.coalesce(out, F.lit(False))

    def repeats(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x)), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(places: Column) -> Column:
        return let(let(F.sort_array(F.transform(places, run_at)), repeats), covered)

    every = F.sequence(F.lit(0), n - window)
    none = F.lit(0).cast("long")
    few = let(codes(words), lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), none).otherwise(let(let(packed(c), suspects), exact)))
    return F.when(n < window, none).when(n > place, exact(every)).otherwise(few)


def measures(text: Column) -> Column:
    """A struct of all measures of a text. Counts of a null text are 0. Stop words are those of any language, in any case, with or without MARKS beside them."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})

    def line_part(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def char_part(solid: Column) -> Column:
        n = F.length(solid)
        return F.struct(n.cast("long").alias("word_chars"), (n - F.length(F.regexp_replace(solid, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"))

    def word_part(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            let(F.array_join(words, ""), char_part).alias("c"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    plain = F.split(F.translate(F.lower(text), MARKS, " " * len(MARKS)), SPACE + "+")
    stops = F.size(F.filter(plain, lambda w: w.isin(stop))).cast("long")
    return F.struct(let(words, word_part).alias("w"), let(lines, line_part).alias("l"), stops.alias("n_stop_words"))


def compile_rules(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> Column:
    """One boolean expression that holds where every rule does."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (metrics[r.metric] >= r.least)
        if r.most is not None:
            out = out & (metrics[r.metric] <= r.most)
    return out


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """docs with a struct column `into`: counts, base_failed and kept.

    Only built-in functions run, in one projection without a shuffle. Null and empty texts have zero counts and fail;
    repeated rows are judged alike; `into` replaces a column of that name, other columns are left as they are.
    """
    m = measures(F.col(text))

    def verdict(m: Column) -> Column:
        n = m["w"]["n_words"]
        at_least_1 = F.greatest(n, F.lit(1))
        metrics = {
            "mean_word_chars": m["w"]["c"]["word_chars"] / at_least_1,
            "symbols_per_word": m["w"]["c"]["n_symbols"] / at_least_1,
            "stop_word_share": m["n_stop_words"] / at_least_1,
            "dup_line_share": m["l"]["n_dup_lines"] / F.greatest(m["l"]["n_lines"], F.lit(1)),
        }
        failed = (n < 50) | (100 * m["w"]["n_repeat_words"] > 50 * n)
        return F.struct(
            n.alias("n_words"),
            m["w"]["c"]["word_chars"].alias("word_chars"),
            m["w"]["c"]["n_symbols"].alias("n_symbols"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & compile_rules(rules, metrics)).alias("kept"),
        )

    return docs.withColumn(into, let(m, verdict))
