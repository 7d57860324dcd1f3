"""Column functions on text that follow Unicode rules: white space, line ends and digits of any script.

Patterns run with Java's ``U`` (Unicode classes) and ``d`` (only a line feed ends a line) flags.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x1c-\x1f]"
# The characters that Unicode classes as white space, and the separators of files, groups, records and units.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Classes begin with the ranges of all their signs: most signs of a text are told by them alone. Single signs of Latin-1 are one test.
LINE_END = r"[\n-\x1e\x85-\u2029&&[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]](?:(?<=\r)\n)?"
_RANGES, _SPACES = r"\t-\x20\x85-\u3000", r"\t\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_IN_LINE = rf"[{_RANGES}&&[{_SPACES}\x1c\x1d\x1e\x1f]]"  # WHITE as a class, without the line feed
_WHITE = rf"[{_RANGES}&&[\n{_SPACES}\x1c\x1d\x1e\x1f]]"  # WHITE as a class
_EDGES = rf"^{_WHITE}++|{_WHITE}(?<!{_WHITE}{_WHITE}){_WHITE}*+\z"
_UNICODE_WHITE = rf"[{_RANGES}&&[\n{_SPACES}]]"  # what Java's Unicode class of white space has

# Full-width signs and radicals that extraction reads as their usual forms.
HALF_WIDTH_FROM = "：（）￥＊⼦⼈⽅⾦⼤"
HALF_WIDTH_TO = ":()¥*子人方金大"
# The smaller set that layout routing reads as usual forms.
ROUTING_FROM = "⼦⼈⽉⽇（）"
ROUTING_TO = "子人月日()"


DATE_PARTS = r"(\d{4})年(\d{1,2})月(\d{1,2})日"  # a printed day


def flagged(pattern: str, multiline: bool = False) -> str:
    return ("(?dmU)" if multiline else "(?dU)") + pattern


def not_empty(text: Column) -> Column:
    """The text, null if it is empty. ``nullif`` would compute it twice."""
    return let(text, lambda x: F.when(x != "", x))


def found(text: Column, pattern: str, multiline: bool = False) -> Column:
    """Whether the pattern occurs."""
    return text.rlike(flagged(pattern, multiline))


def whole(text: Column, pattern: str) -> Column:
    """Whether the pattern is the whole text."""
    return text.rlike(flagged(rf"^(?:{pattern})\z"))


def group(text: Column, pattern: str, n: int = 1, multiline: bool = False) -> Column:
    """Group ``n`` of the first occurrence; null without one, and if the group is empty or took no part."""
    return not_empty(F.regexp_extract(text, flagged(pattern, multiline), n))


def every(text: Column, pattern: str, n: int = 1, multiline: bool = False) -> Column:
    """Group ``n`` of all occurrences."""
    return F.regexp_extract_all(text, F.lit(flagged(pattern, multiline)), F.lit(n))


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, flagged(pattern), by)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words(text: Column, unicode: bool = True) -> Column:
    """``text`` cut at white space. ``split`` compiles its pattern for every row, unless it is one plain sign."""
    return F.split(F.regexp_replace(text, f"{_UNICODE_WHITE}+" if unicode else r"\s+", " "), " ")


def present(text: Column) -> Column:
    """Trimmed, null if nothing is left."""
    return not_empty(F.regexp_replace(text, _EDGES, ""))


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"{_WHITE}+", "")


def compact_lines(all_lines: Column) -> Column:
    """Each line without any white space, by one pass over all of them; lines hold no line feed. One empty line for no lines."""
    return F.split(F.regexp_replace(F.array_join(all_lines, "\n"), f"{_IN_LINE}+", ""), "\n", -1)


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no line."""
    return let(F.split(F.regexp_replace(text, LINE_END, "\n"), "\n", -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def trimmed_lines(all_lines: Column) -> Column:
    return F.transform(all_lines, trimmed)


def filled_lines(all_lines: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(all_lines, trimmed), lambda x: x != "")


def _translated(text: Column, signs: str, others: str) -> Column:
    """``translate`` for texts that hold one of the signs (radicals or full-width) only: looking for them is much quicker."""
    return let(text, lambda x: F.when(x.rlike(rf"[\u2f00-\u2fff\uff00-\uffff&&[{signs}]]"), F.translate(x, signs, others)).otherwise(x))


def half_width(text: Column) -> Column:
    return _translated(text, HALF_WIDTH_FROM, HALF_WIDTH_TO)


def routing_form(text: Column) -> Column:
    return _translated(compact(text), ROUTING_FROM, ROUTING_TO)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    ``get`` would derive the type of its array anew for every row, through all that the body is made of.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of(values: Column) -> Column:
    """The first non-null element; null if there is none."""
    return let(F.filter(values, lambda x: x.isNotNull()), lambda x: F.get(x, 0))


def indexes(array: Column) -> Column:
    """0 to size - 1; empty for an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def part(array: Column, start: Column, length: Column | int) -> Column:
    """``length`` elements from index ``start`` (from 0), as many as there are."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(array, start + 1, F.greatest(length, F.lit(0)))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_of(text: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd from parts that may hold spaces; months and days get two digits."""
    return F.concat_ws("-", compact(year), F.lpad(compact(month), 2, "0"), F.lpad(compact(day), 2, "0"))
