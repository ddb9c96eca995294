"""Columns over message text: cleaning, simple tokens, types, pattern text, bins, id sets, scores."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as T

#: A run of word characters or any one other character.
SIMPLE_TOKEN = r"(\w+|.)"


def sanitize(line: Column) -> Column:
    """Without a final newline; each byte that isn't printable ASCII becomes ``X`` (tabs too)."""
    ascii_ = F.regexp_replace(F.regexp_replace(line, r"\n$", ""), r"[\x00-\x1F\x7F]", "X")
    two = F.regexp_replace(ascii_, r"[\u0080-߿]", "XX")
    three = F.regexp_replace(two, r"[ࠀ-￿&&[^\uD800-\uDFFF]]", "XXX")
    return F.regexp_replace(three, r"[^\x00-\x7F]", "XXXX")


def simple_tokens(body: Column) -> Column:
    """All simple tokens in order."""
    return F.regexp_extract_all(body, F.lit(SIMPLE_TOKEN), F.lit(1))


def parsed_type(token: Column) -> Column:
    """The type that the simple tokenizer sees: white space, decimal, one mark, or text."""
    return F.when(token.rlike(r"^\s+$"), T.WHITESPACE).when(token.rlike(r"^[0-9]+$"), T.DEC_INT).when(token.rlike(r"^\W$"), T.SEPARATOR).otherwise(T.TEXT)


def resolved_type(type_mask: Column, parsed: Column) -> Column:
    """The dictionary's say over the parser's: host name, then word, then service."""
    known = F.coalesce(type_mask, F.lit(0).cast("long"))
    has = lambda name: known.bitwiseAND(F.lit(T.mask(name))) != 0
    return F.when(has("HOSTNAME"), T.HOSTNAME).when(has("WORD"), T.WORD).when(has("SERVICE"), T.SERVICE).otherwise(parsed)


def rendered_type(number: Column) -> Column:
    """How a pattern shows an element that isn't fixed."""
    out = F
    for i, text in enumerate(T.RENDERED, 1):
        out = out.when(number == i, text)
    for i, name in enumerate(T.CRAY_NAMES, 32):
        out = out.when(number == i, f"<{name.lower()}>")
    return out.otherwise("*")


def rendered(token: Column, number: Column) -> Column:
    return F.when(number.isin(T.WORD, T.SEPARATOR), token).otherwise(rendered_type(number))


def pattern_of(tokens: Column, words: Iterable[str]) -> Column:
    """Pattern text of simple tokens, for a word list small enough to be part of the query."""
    known = [*words]

    def one(t: Column) -> Column:
        return F.when(t.isin(known), t).when(t.rlike(r"^\s+$"), " ").when(t.rlike(r"^[0-9]+$"), "<dec>").when(t.rlike(r"^\W$"), t).otherwise("*")

    return F.array_join(F.transform(tokens, one), "")


def bin_start(epoch: Column, width: int | Column) -> Column:
    """The start of the bin that a number of seconds falls into."""
    return (F.floor(epoch / width) * width).cast("long")


def has_mask(type_mask: Column, names: str) -> Column:
    return type_mask.bitwiseAND(F.lit(T.parse_types(names))) != 0


def first_type(type_mask: Column) -> Column:
    """The number of the lowest bit; 0 for an empty mask."""
    low = type_mask.bitwiseAND(-type_mask)
    return F.when(type_mask == 0, 0).otherwise(F.length(F.bin(low))).cast("int")


def escaped(text: Column) -> Column:
    """Bytes that aren't graphic ASCII as ``\\xNN``."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    graphic = lambda p: (F.conv(p, 16, 10).cast("int") > 32) & (F.conv(p, 16, 10).cast("int") < 127)
    return F.array_join(F.transform(pairs, lambda p: F.when(graphic(p), F.chr(F.conv(p, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\x"), p))), "")


def parse_id_set(text: str) -> list[tuple[int, int]]:
    """``1,5-10,55`` to inclusive ranges, in order, overlapping or touching ones joined."""
    out: list[tuple[int, int]] = []
    spans = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        spans.append((int(low), int(high or low)))
    for low, high in sorted(spans):
        if low > high:
            raise ValueError(f"range {low}-{high} is empty")
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def format_id_set(ranges: Iterable[tuple[int, int]]) -> str:
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in ranges)


def in_id_set(column: Column, text: str) -> Column:
    out = F.lit(False)
    for low, high in parse_id_set(text):
        out = out | column.between(low, high)
    return out


def keyword_score(text: Column, weights: Iterable[tuple[str, float]]) -> Column:
    """Sum of the weights of the case-insensitive expressions that occur in a text."""
    out = F.lit(0.0)
    for pattern, weight in weights:
        out = out + F.when(text.rlike(f"(?i){pattern}"), F.lit(float(weight))).otherwise(0.0)
    return out


def metric_bin(value: Column, recipe: str) -> tuple[str, Column]:
    """``name:v0,v1,...`` to the name and the bin of a value: 0 below v0, then one more from each bound on."""
    name, _, bounds = recipe.partition(":")
    out = F.lit(0)
    for bound in sorted(float(b) for b in bounds.split(",")):
        out = out + F.when(value >= bound, 1).otherwise(0)
    return name, F.when(value.isNotNull(), out)


_UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


def parse_duration(text: str) -> int:
    """``1d``, ``2h``, ``30m`` or seconds; a unit alone is one of it."""
    if m := re.fullmatch(r"\s*(\d*)\s*([dhms]?)\s*", text.lower()):
        if m[1] or m[2]:
            return int(m[1] or 1) * _UNITS[m[2] or "s"]
    raise ValueError(f"no duration: {text}")


def auto_bin_width(seconds: int) -> int:
    """The bin width that suits a span: at most about sixty bins, of a minute, an hour or a day."""
    return 86400 if seconds // 3600 > 60 else 3600 if seconds // 60 > 60 else 60
