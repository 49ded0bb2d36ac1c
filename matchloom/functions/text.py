"""Column expressions for Unicode-aware text handling: white space, lines, sentences, sections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space of Unicode, with the separators U+001C to U+001F.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(c: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(_BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{_WS}+", " "))


def lines(c: Column) -> Column:
    return F.split(c, _LINE)


def sentences(c: Column) -> Column:
    """Non-blank pieces between white space that follows ``.``, ``!`` or ``?``, stripped."""
    return F.filter(F.transform(F.split(c, f"(?<=[.!?]){_WS}+"), strip), lambda s: s != "")


def section_split(c: Column, markers: list[str]) -> Column:
    """Struct of main and rest: what is before and after the first line that contains a marker; the line itself goes.

    Without one, both are the whole text. An empty second part is "None".
    """

    def parted(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda line: _any([F.contains(line, F.lit(m)) for m in markers])), F.lit(True)).cast("int")
        return let(at, lambda i: F.when(i > 0, pair(F.slice(parts, F.lit(1), F.greatest(i - 1, F.lit(0))), F.slice(parts, i + 1, F.size(parts)))).otherwise(whole(strip(c))))

    some = lambda x: F.when(x == "", F.lit("None")).otherwise(x)
    joined = lambda x: strip(F.array_join(x, "\n"))
    pair = lambda a, b: F.struct(joined(a).alias("main"), some(joined(b)).alias("rest"))
    whole = lambda x: let(x, lambda v: F.struct(v.alias("main"), some(v).alias("rest")))
    return let(lines(c), parted)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def numbered_items(c: Column) -> Column:
    """Texts of the lines that begin with a digit 1-9, without their number; blank ones are left out."""
    items = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s.rlike("^[1-9]"))
    cut = F.transform(items, lambda s: F.when(s.rlike(r"^(?:[1-9]\p{N}|[1-9])\."), strip(F.regexp_replace(s, r"^(?:[1-9]\p{N}|[1-9])\.", ""))).otherwise(s))
    return F.filter(cut, lambda s: s != "")


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by a column; values may hold any characters. Null values are empty."""
    import re

    out = []
    for piece in re.split(r"(\{\w*\})", template):
        name = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
        out.append(F.coalesce(values[name], F.lit("")) if name in values else F.lit(piece))
    return F.concat(*out)


def word_tokens(c: Column) -> Column:
    """The default tokenizer: pieces between white space."""
    return F.filter(F.split(c, f"{_WS}+"), lambda t: t != "")


def char_tokens(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda t: t != "")


def middle_cut(c: Column, tokens, joiner: str, threshold: int, long_tail: bool = False) -> Column:
    """Texts of more than ``threshold`` tokens as first half, " ... ", last half; with ``long_tail`` the tail of an odd threshold is the longer."""
    t, head = tokens(c), threshold // 2
    tail = threshold - head if long_tail else head
    cut = F.concat(F.array_join(F.slice(t, F.lit(1), F.lit(head)), joiner), F.lit(" ... "), F.array_join(F.slice(t, F.greatest(F.size(t) - tail + 1, F.lit(1)), F.lit(tail)), joiner))
    return F.when(F.size(t) > threshold, cut).otherwise(c)
