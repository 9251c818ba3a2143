"""The form in which labels, headings and phrases are compared, computed in Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Dashes and quotes that are compared as plain ones.
FOLDED = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"'}
_FOLD = str.maketrans(FOLDED)
#: White space as `\\s` of Unicode has it.
_SPACES = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+".encode().decode("unicode_escape")


def fold_array(texts: pa.Array) -> pa.Array:
    """NFKC, plain dashes and quotes, case folding, one space for each run of white space, none at the ends; null is empty.

    ASCII values are lowered by Arrow; only values with other characters are folded one by one, each distinct one once.
    """
    texts = pc.fill_null(texts, "")
    plain = pc.string_is_ascii(texts)
    if pc.all(plain).as_py() is False:
        encoded = pc.dictionary_encode(texts)
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        folded = pa.array([v if v.isascii() else unicodedata.normalize("NFKC", v).translate(_FOLD).casefold() for v in encoded.dictionary.to_pylist()], pa.string())
        texts = folded.take(encoded.indices)
    low = pc.ascii_lower(texts)
    return pc.utf8_trim(pc.replace_substring_regex(low, _SPACES, " "), " ")


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return fold_array(texts)


def folded(text: Column) -> Column:
    """A text as labels and headings are compared."""
    return _folded(text)


#: Words that lead a label of an exhibit, and marks after them.
_LEAD = r"(?i)^(exhibit|schedule|annex|appendix|attachment|addendum)\s*"
_MARKS = r"^[\s:\-–—]+"


def exhibit_label(raw: Column) -> Column:
    """A reviewer's label of an exhibit for grouping: without the leading word and marks, in lower case, single spaced, without a final s; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), _LEAD, ""), _MARKS, "")
    text = F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))
    return F.nullif(F.when((F.length(text) > 2) & text.endswith("s"), F.regexp_replace(text, "s$", "")).otherwise(text), F.lit(""))
