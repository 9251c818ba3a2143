"""Paragraphs that hold several clauses, cut where a further one begins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Characters that a piece has at least, words of an anchor, and the share of capitals in it.
LEAST_CHARS, TERM_WORDS, PHRASE_WORDS, CAPITAL_SHARE = 25, 6, 8, 0.75
#: Quotes; a number of two levels or more, or a section's, with what may follow it; the end of a sentence before it.
QUOTES = "\"'‘’“”"
NUMBERS = (
    rf"(?<![\w.])\d{{1,3}}(?:\.\d{{1,3}})+\.?(?:\s+|(?=[{QUOTES}(]))",
    r"(?<![\w.])(?:SECTION|Section|ARTICLE|Article|CLAUSE|Clause)\s+(?:\d{1,3}(?:\.\d{1,3})*|[IVXLC]{1,6})(?:\([A-Za-z0-9]{1,3}\))?\.?\s+",
)
SENTENCE_ENDS, CLOSERS = ".:;!?", QUOTES + ")]"
#: Words before the end of a sentence that make the number a reference.
REFERENCES = frozenset(
    "under in of to per see with by and or at from into upon pursuant subject accordance provided set forth described referenced referred above below herein hereof thereof this that said such any "
    "section sections clause clauses article articles paragraph paragraphs exhibit schedule annex appendix than exceed exceeds least more less within".split()
)
_NUMBERS = [re.compile(n) for n in NUMBERS]
_WORD_BEFORE = re.compile(r"([A-Za-z]+)\W?$")
_TERM, _PHRASE = re.compile(rf"[{QUOTES}]([^{QUOTES}]{{1,60}})[{QUOTES}]"), re.compile(r"([^.:\n]{1,80})[.:]")


def _opens_a_sentence(text: str, at: int, references: bool) -> bool:
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    mark = end - 1 if end and text[end - 1] in SENTENCE_ENDS else end - 2 if end > 1 and text[end - 1] in CLOSERS and text[end - 2] in SENTENCE_ENDS else -1
    if mark < 0 or end == at:
        return False
    word = _WORD_BEFORE.search(text[max(0, mark - 30) : mark]) if references else None
    return not (word and word[1].lower() in REFERENCES)


def _reads_as_a_clause(rest: str) -> bool:
    """Whether a text starts with a short defined term in quotes, or a short phrase with capitals that a point or colon closes."""
    rest = rest.lstrip()
    if (term := _TERM.match(rest)) and len(term[1].split()) <= TERM_WORDS:
        return True
    phrase = _PHRASE.match(rest)
    words = phrase[1].split() if phrase else []
    if not words or len(words) > PHRASE_WORDS:
        return False
    named = [w for w in words if w[0].isalpha()]
    return phrase[1].isupper() or (bool(named) and sum(w[0].isupper() for w in named) >= CAPITAL_SHARE * len(named))


def boundaries(text: str, references: bool = False) -> list[int]:
    """Where in a text a further clause begins: at a number after the end of a sentence, with LEAST_CHARS on both sides, that an anchor follows.

    With `references`, not where the sentence before ends in a word that refers (`as set forth above. 2.1 Fees.`). The rules
    that this follows name that guard, but it never held in them, so it is off unless asked for.
    """
    found = {m.start() for n in _NUMBERS for m in n.finditer(text) if LEAST_CHARS <= m.start() <= len(text) - LEAST_CHARS and _opens_a_sentence(text, m.start(), references) and _reads_as_a_clause(text[m.end() : m.end() + 400])}
    return sorted(found)


def pieces(text: str | None) -> list[str]:
    """The clauses of a text in order, stripped; the text as it is, if it holds one or none."""
    cuts = boundaries(text) if text else []
    parts = [p for a, b in zip([0, *cuts], [*cuts, None], strict=True) if (p := text[a:b].strip())] if cuts else []
    return parts if len(parts) > 1 else [text or ""]


@udtf(returnType="seg int, piece string")
class SplitInline:
    """The pieces of a text, from 0 on."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(pieces(text))


def register(spark: SparkSession) -> None:
    """Make split_inline(text) known to SQL, for lateral joins."""
    spark.udtf.register("split_inline", SplitInline)
