"""Token types: their numbers, masks, and how patterns show them."""

from __future__ import annotations

# fixed values: the built-in types in order from 1, and how a pattern renders each
NAMES = ["TYPE", "PRIORITY", "VERSION", "TIMESTAMP", "HOSTNAME", "SERVICE", "PID", "IP4_ADDR", "IP6_ADDR", "ETH_ADDR", "HEX_INT", "DEC_INT", "FLOAT", "NUMBER", "PATH", "URL", "WORD", "SEPARATOR", "WHITESPACE", "TEXT"]
RENDERED = ["<type>", "<prio>", "<vers>", "<ts>", "<host>", "<svc>", "<pid>", "<ip4>", "<ip6>", "<mac>", "<hex>", "<dec>", "<float>", "<num>", "<path>", "<url>", "<word>", "<sep>", " ", "*"]
# fixed values: the types that the second grammar adds, from 32
CRAY_NAMES = ["ASIC_RTR_NODE", "ASIC_RTR_LINK", "DEC_LIST", "HEX_DUMP", "CHAR_DUMP", "NID_LIST", "HASH_LIST", "HOST_LIST", "SLOT", "SLOT_LIST", "RTR_LIST"]

NUMBER = {name: i for i, name in enumerate(NAMES, 1)} | {name: i for i, name in enumerate(CRAY_NAMES, 32)}
NAME = {i: name for name, i in NUMBER.items()}
HOSTNAME, SERVICE, DEC_INT, WORD, SEPARATOR, WHITESPACE, TEXT = (NUMBER[n] for n in ("HOSTNAME", "SERVICE", "DEC_INT", "WORD", "SEPARATOR", "WHITESPACE", "TEXT"))
#: Elements of these types keep their token in a pattern or stand for white space; all others are wildcards.
FIXED = (WORD, SEPARATOR, WHITESPACE)
#: First ids: hosts, other tokens, patterns; the pattern id that stands for all patterns.
FIRST_HOST_ID, FIRST_TOKEN_ID, FIRST_PATTERN_ID, ALL_PATTERNS = 0x100, 2_000_001, 256, 1


def mask(name_or_number: str | int) -> int:
    """The bit of a type."""
    number = NUMBER[name_or_number] if isinstance(name_or_number, str) else name_or_number
    return 1 << (number - 1)


def parse_types(text: str) -> int:
    """``WORD,HOSTNAME`` or ``WORD|HOSTNAME`` or a hexadecimal number to a mask."""
    if text.lower().startswith("0x"):
        return int(text, 16)
    out = 0
    for name in text.replace("|", ",").split(","):
        if name.strip() not in NUMBER:
            raise LookupError(f"unknown token type: {name.strip()}")
        out |= mask(name.strip())
    return out


def has_type(type_mask: int, name_or_number: str | int) -> bool:
    return bool(type_mask & mask(name_or_number))


def first_type(type_mask: int) -> int:
    """The number of the lowest bit; 0 for an empty mask."""
    return (type_mask & -type_mask).bit_length()


def names_of(type_mask: int) -> list[str]:
    return [NAME.get(i, f"TYPE_{i}") for i in range(1, 64) if type_mask & mask(i)]


def is_wildcard(number: int) -> bool:
    return number not in FIXED
