"""Typed tokens of raw log lines by longest match, and the headers of log lines.

At each place the longest token wins, of equally long ones the earlier rule. A regular expression takes the
first alternative instead, so a small function tries the rules and a pandas UDF runs it in batches.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .. import types as T

# fixed values: the token classes of system logs in rule order
_X = "[0-9A-Fa-f]"
_TEXT = r"(?:[A-Za-z_]+[A-Za-z0-9\-_.]*[A-Za-z0-9\-_]|[A-Za-z]+)"
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_ISO = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:[+-]\d\d:\d\d|Z)"
_BSD = rf"(?:{'|'.join(_MONTHS)}) +\d{{1,2}},? +(?:\d{{4}} +)?\d\d:\d\d:\d\d"
_LOCAL = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"
_IP4, _IP6 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:/[0-9]{1,2})?", rf"(?:(?:{_X}{{1,4}})?:){{5}}{_X}{{1,4}}(?:/[0-9]{{1,3}})?"
SYSLOG = [
    ("ETH_ADDR", rf"{_X}{{2}}(?::{_X}{{2}}){{5}}"),
    ("PRIORITY", r"<[0-9]+>"),
    ("TEXT", _TEXT),
    ("IP4_ADDR", _IP4),
    ("IP6_ADDR", _IP6),
    ("DEC_INT", r"[0-9]+"),
    ("HEX_INT", rf"(?:0[xX])?{_X}+"),
    ("FLOAT", r"[0-9]+\.[0-9]*(?:[eE][0-9]+\.[0-9]*)?"),
    ("PATH", r"(?:/[A-Za-z0-9_\-~.]+)+"),
    ("URL", rf"[hH][tT]{{2}}[pP][sS]?://{_TEXT}(?:/{_TEXT})*/?"),
    ("TIMESTAMP", _ISO),
    ("TIMESTAMP", _BSD),
    ("TIMESTAMP", _LOCAL),
    ("SERVICE", r"\[[A-Za-z_\-]+(?:\.[A-Za-z_\-]+)*:[A-Za-z_\-]+\]"),
    ("SEPARATOR", r"[!-/:-@\[-`{-~]"),
    ("WHITESPACE", r"[ \t\r\n\f\v]+"),
]
# fixed values: what the second grammar adds, before the others; text comes after numbers there
_HOST, _SLOT, _NID, _LINK = r"c\d+-\d+c\d+s\d+n\d+", r"c\d+-\d+c\d+s\d+", r"nid\d{2}\d+", r"c\d+-\d+c\d+s\d+[ag]\d+l\d+"
_ADDED = [
    ("HOSTNAME", _HOST),
    ("HOSTNAME", _NID),
    ("SLOT", _SLOT),
    ("ASIC_RTR_LINK", _LINK),
    ("HOST_LIST", rf"{_HOST}(?:[ ,]{_HOST})+"),
    ("SLOT_LIST", rf"{_SLOT}(?:[ ,]{_SLOT})+"),
    ("RTR_LIST", rf"{_LINK}(?:[ ,]{_LINK})+"),
    ("NID_LIST", r"(?:\s+\d+:)(?:\s*\d+:)+"),
    ("HASH_LIST", r"(?:#\d{3}){2,}"),
    ("DEC_LIST", r"(?:\d+-\d+|\d+)(?:,(?:\d+-\d+|\d+))+"),
    ("HEX_DUMP", rf"{_X}{{2}}(?: +{_X}{{2}})+"),
    ("CHAR_DUMP", r"\*\S{3,}\*"),
]
CRAY = _ADDED + [r for r in SYSLOG if r[0] != "TEXT" and r[0] != "SEPARATOR" and r[0] != "WHITESPACE"] + [r for r in SYSLOG if r[0] in ("TEXT", "SEPARATOR", "WHITESPACE")]
GRAMMARS = {"syslog": SYSLOG, "cray": CRAY}
#: Numbers are one type in the second grammar's messages.
_AS_NUMBER = {"HEX_INT", "DEC_INT", "FLOAT"}


def lex(line: str, grammar: str = "syslog") -> list[tuple[str, int]]:
    """All tokens and their types; a character no rule knows is a separator."""
    rules = [(name, re.compile(pattern, re.A)) for name, pattern in GRAMMARS[grammar]]
    return _lex(line, rules, grammar == "cray")


def _lex(line: str, rules: list[tuple[str, re.Pattern]], numbers: bool) -> list[tuple[str, int]]:
    out, at = [], 0
    while at < len(line):
        end, name = at, "SEPARATOR"
        for rule, pattern in rules:
            if rule == "PRIORITY" and at:
                continue
            if (m := pattern.match(line, at)) and m.end() > end:
                end, name = m.end(), rule
        end = max(end, at + 1)
        out.append((line[at:end], T.NUMBER["NUMBER" if numbers and name in _AS_NUMBER else name]))
        at = end
    return out


def tokens(line: Column, grammar: str = "syslog") -> Column:
    """``array<struct<text, type>>`` of a line; null for a null line."""
    kind = ArrayType(StructType().add("text", StringType()).add("type", IntegerType()))
    table = GRAMMARS[grammar]

    def run(lines: pd.Series) -> pd.Series:
        rules = [(name, re.compile(pattern, re.A)) for name, pattern in table]
        return lines.map(lambda x: None if x is None else [{"text": t, "type": n} for t, n in _lex(x, rules, grammar == "cray")])

    return F.pandas_udf(run, kind)(line)


_HEAD = {
    "hwerr": rf"^({_LOCAL}|{_ISO}|{_BSD})\s+(?:\|)\s+({_TEXT})\[({_TEXT}|{_IP4})\]",
    "bsd": rf"^<\d+>({_BSD})\s+\[[A-Za-z_.\-]+:[A-Za-z_\-]+\][^\s]",
    "versioned": rf"^<\d+>\d+\s+({_ISO}|{_LOCAL}|{_BSD})\s+[\[(]?({_IP4}|{_IP6}|{_TEXT})[\])]?(?:\s|$)",
    "priority": rf"^<\d+>({_ISO}|{_LOCAL}|{_BSD})\s+[\[(]?({_IP4}|{_IP6}|{_TEXT})[\])]?(?:\s|$)",
    "plain": rf"^({_ISO}|{_LOCAL}|{_BSD})\s+[\[(]?({_IP4}|{_IP6}|{_TEXT})[\])]?(?:\s|$)",
    "bare": rf"^(?:<\d+>\d*\s*)?({_ISO}|{_LOCAL}|{_BSD})\s",
}


def header(line: Column) -> Column:
    """``struct<format, ts, host, body>`` of a line, null where no known header begins it.

    host is null where the header has none; ts is the text of the time; body what follows the header.
    """
    out = F.lit(None)
    parts = {"hwerr": (1, 3), "bsd": (1, None), "versioned": (1, 2), "priority": (1, 2), "plain": (1, 2), "bare": (1, None)}
    for name in reversed(_HEAD):
        ts, host = parts[name]
        pattern = _HEAD[name]
        whole = F.regexp_extract(line, pattern, 0)
        found = F.struct(F.lit(name).alias("format"), F.regexp_extract(line, pattern, ts).alias("ts"), (F.regexp_extract(line, pattern, host) if host else F.lit(None).cast("string")).alias("host"), F.ltrim(F.substring(line, F.length(whole) + 1, F.length(line))).alias("body"))
        out = F.when(line.rlike(pattern), found).otherwise(out)
    return out


def epoch_us(ts: Column, year: int | None = None, zone: str = "UTC") -> Column:
    """Microseconds of a header's time: ISO with its offset; local and BSD times in ``zone``, the latter in ``year`` or the present one."""
    iso = F.to_timestamp(F.when(ts.rlike(r"^\d{4}-\d\d-\d\dT"), ts))
    bsd = F.regexp_replace(F.regexp_replace(ts, ",", ""), " +", " ")
    with_year = F.when(bsd.rlike(r"^\w+ \d+ \d{4} "), bsd).otherwise(F.regexp_replace(bsd, r"^(\w+ \d+) ", f"$1 {year or dt.date.today().year} "))
    local = F.coalesce(F.to_timestamp_ntz(F.when(ts.rlike(r"^\d{4}-\d\d-\d\d \d"), ts), F.lit("yyyy-MM-dd HH:mm:ss")), F.to_timestamp_ntz(F.when(ts.rlike("^[A-Z]"), with_year), F.lit("MMM d yyyy HH:mm:ss")))
    return F.unix_micros(F.coalesce(iso, F.to_utc_timestamp(local.cast("string"), zone) if zone != "UTC" else local.cast("timestamp"))).cast(LongType())


def parse(lines: Iterable[str]) -> list[list[tuple[str, int]]]:
    return [lex(x) for x in lines]
