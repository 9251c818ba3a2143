"""Numbers of clauses as column expressions: how they are written, and how a typed one is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

#: The forms of a typed number, in the order they are tried, and words after which a number is a wrapped reference.
FORMS = {
    "dotted": r"^\s*(\d+(?:\.\d+)+)\.?(?:[\s ]+|(?=[“”\"‘’'(]))",
    "section": r"^\s*(?:SECTION|Section|ARTICLE|Article|CLAUSE|Clause)\s+((?:[0-9]+(?:\.[0-9]+)*|[IVXLC]+)(?:\([A-Za-z0-9]{1,3}\))?)\.?\s*[-–—:]?\s*",
    "num_dot": r"^\s*(\d{1,3})[.)][\s ]+",
    "paren": r"^\s*\(([A-Za-z]{1,4}|\d{1,3})\)[\s ]*",
    "roman_dot": r"^\s*([IVX]{2,6}|[ivx]{2,6})[.)][\s ]+",
    "alpha_dot": r"^\s*([A-Za-z])[.)][\s ]+",
}
CONNECTIVES = ("and", "or", "of", "through", "above", "below", "hereof", "herein", "hereunder")
#: What a small roman number looks like, and the letters that may be one or a letter of a list.
ROMAN = r"^(?:x{0,3})(?:ix|iv|v?i{0,3})$"
AMBIGUOUS = ("i", "v", "x")


def typed_number(text: Column) -> Column:
    """struct(kind, token, cls, depth, delim, upper, shown, rest) of the number a paragraph starts with; null if there is none, or it is a wrapped reference.

    Each form is matched once. Two letters or more are a number with a point only if they are a roman one.
    """

    def parts(kind: str, full: Column) -> Column:
        token = F.regexp_extract(full, r"\d+(?:\.\d+)+", 0) if kind == "dotted" else F.regexp_extract(full, FORMS["section"], 1) if kind == "section" else F.regexp_extract(full, "[A-Za-z0-9]+", 0)
        return F.struct(F.lit(kind).alias("kind"), token.alias("token"), full.alias("full"))

    def hit(kind: str) -> Column:
        return let(F.regexp_extract(text, FORMS[kind], 0), lambda full: F.when((full != "") & _is_roman(full, kind), parts(kind, full)))

    def read(found: Column) -> Column:
        token, kind = found["token"], found["kind"]
        low, shown = F.lower(token), F.btrim(found["full"], F.lit(_BLANK))
        own = kind.isin("dotted", "section")
        cls = F.when(own, kind).when(low.rlike("^[0-9]+$"), "decimal").when(low.isin(*AMBIGUOUS), "ambiguous").when(low.rlike(ROMAN), "roman").otherwise("alpha")
        depth = F.when(kind == "dotted", F.size(F.split(token, r"\."))).when(kind == "section", 1)
        delim = F.when(shown.startswith("("), "paren").when(shown.endswith(")"), "rparen").otherwise("dot")
        rest = F.btrim(F.substr(text, F.length(found["full"]) + 1), F.lit(_BLANK))
        wrapped = F.rtrim(F.regexp_extract(rest, r"^\S+", 0), F.lit(",;")).isin(*CONNECTIVES)
        upper = (token != low) & (token == F.upper(token))
        return F.when(~wrapped, F.struct(kind, token.alias("token"), cls.alias("cls"), depth.alias("depth"), delim.alias("delim"), upper.alias("upper"), shown.alias("shown"), rest.alias("rest")))

    return let(F.coalesce(*map(hit, FORMS)), lambda found: F.when(found.isNotNull(), read(found)))


_BLANK = " \t\n\r\f\v"


def _is_roman(full: Column, kind: str) -> Column:
    return F.lower(F.regexp_extract(full, "[A-Za-z]+", 0)).rlike(ROMAN) if kind == "roman_dot" else F.lit(True)


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a whole number, with an m for each thousand; empty for 0 and below."""
    digits = [("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")]
    parts = [F.get(F.array(*map(F.lit, row)), (F.floor(n / 10**k) % 10).cast("int")) for k, row in enumerate(digits)]
    return F.when(n > 0, F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), *reversed(parts))).otherwise("")


#: Letters that a long can need; the first number of 1, 2, ... letters.
_FIRSTS = [(26**k - 1) // 25 for k in range(1, 14)]


def letters(n: Column) -> Column:
    """1 is a, 26 z, 27 aa, 703 aaa, and so on; empty for 0 and below."""
    n = n.cast("long")
    size = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in _FIRSTS]), lambda x: x <= n))
    powers = F.array(*[F.lit(26**k).cast("long") for k in range(13)])
    firsts = F.array(*[F.lit(x).cast("long") for x in _FIRSTS])

    def written(b: Column) -> Column:
        at = n - F.get(firsts, b - 1)
        return F.array_join(F.transform(F.sequence(b - 1, F.lit(0)), lambda k: F.char((F.lit(97) + F.pmod(_div(at, F.get(powers, k)), F.lit(26))).cast("int"))), "")

    return F.when(n > 0, let(size, written)).otherwise("")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def formatted(n: Column, form: Column) -> Column:
    """A counter's value in a number format of a word processor; in decimals if the format is unknown."""
    plain = n.cast("string")
    return (
        F.when(form == "decimalZero", F.lpad(plain, F.greatest(F.length(plain), F.lit(2)), F.lit("0"))).when(form == "lowerLetter", letters(n)).when(form == "upperLetter", F.upper(letters(n)))
        .when(form == "lowerRoman", roman(n)).when(form == "upperRoman", F.upper(roman(n))).when(form == "none", "").otherwise(plain)
    )
