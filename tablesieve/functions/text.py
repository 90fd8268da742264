"""Text expressions: cell values as text, the two tokenisers and term counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The token classes the two scores are defined on.
WORD = r"[\p{L}\p{N}_]{2,}"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
# Characters whose class Python and Java agree on, whatever their versions of Unicode.
PLAIN = r"\x{0}-\x{24F}"

MISSING = "None"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def space_tokens(text: Column) -> Column:
    """Lower-case pieces between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), SPACE), lambda t: t != "")


def trimmed(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def term_counts(tokens: Column) -> Column:
    """Tokens of one text as an array of (term, tf): run lengths of the sorted tokens."""
    empty = F.array().cast("array<struct<term:string,tf:int>>")

    def starts(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        return F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    def lengths(ordered: Column, at: Column) -> Column:
        def run(i: Column, nth: Column) -> Column:
            end = F.coalesce(F.get(at, nth + 1), F.size(ordered))
            return F.struct(F.get(ordered, i).alias("term"), (end - i).alias("tf"))

        return F.transform(at, run)

    def counted(ordered: Column) -> Column:
        runs = let(starts(ordered), lambda at: lengths(ordered, at))
        return F.when(F.size(ordered) > 0, runs).otherwise(empty)

    return let(F.sort_array(tokens), counted)


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """A cell of any type as the text used for ranking and in table text; null stays null.

    Booleans print as True/False and doubles without exponent between 1e-4 and 1e16.
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        plain = value.cast("string")
        digits = F.regexp_replace(plain.cast("decimal(38,20)").cast("string"), r"0+$", "")
        digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
        mantissa = F.regexp_replace(F.split_part(plain, F.lit("E"), F.lit(1)), r"\.0$", "")
        power = F.split_part(plain, F.lit("E"), F.lit(2)).try_cast("int")
        sign = F.when(power < 0, "-").otherwise("+")
        return (
            F.when(F.isnan(value), "nan")
            .when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
            .when(~plain.contains("E"), plain)
            .when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16), digits)
            .otherwise(F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0")))
        )
    return value.cast("string")


def shown(value: Column) -> Column:
    """Cell text as it appears in rows: a missing value is written out."""
    return F.coalesce(value, F.lit(MISSING))


def json_value(text: Column, dtype: str, single_quotes: bool = False) -> Column:
    """``text`` read as one JSON value of ``dtype``; null when it is anything else or has text after it.

    The value is put inside an object with a closing field, which is only found if the value ends
    where the text ends.
    """
    whole = F.concat(F.lit('{"a":'), text, F.lit(',"end":1}'))
    options = {"allowSingleQuotes": str(single_quotes).lower()}
    return let(
        F.from_json(whole, f"a {dtype}, end int", options), lambda v: F.when(v.end == 1, v.a)
    )


def joined(items: Column, separator: str, order: str, text: str) -> Column:
    """Aggregate: ``text`` of the collected (order, text) items, in order. Groups must be bounded."""
    return F.array_join(F.transform(F.sort_array(items), lambda i: i.getField(text)), separator)
