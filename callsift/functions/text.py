"""String expressions whose edge cases differ from Spark's plain built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space (``trim`` only drops U+0020).

    The look-behind lets the tail match start only at the first space of a run,
    which keeps long inner runs linear.
    """
    return F.regexp_replace(text, rf"^{_SPACE}+|(?<!{_SPACE}){_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def clean_path(path: Column) -> Column:
    """Collapse runs of ``/`` and drop a trailing one, except for the root."""
    collapsed = F.regexp_replace(path, "/+", "/")
    return F.when(collapsed == "/", collapsed).otherwise(F.regexp_replace(collapsed, r"/\z", ""))


def path_prefix(path: Column, depth: int = 1) -> Column:
    """The first ``depth`` path segments with one leading slash."""
    segments = F.split(F.regexp_replace(path, r"^/+|(?<!/)/+\z", ""), "/", -1)
    return F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, depth), "/"))


def truncate_utf8(text: Column, max_bytes: int, marker: str) -> Column:
    """Keep at most ``max_bytes`` UTF-8 bytes; a cut character becomes U+FFFD."""
    kept = F.substring(text.cast("binary"), 1, max_bytes).cast("string")
    return F.when(
        F.octet_length(text) > max_bytes, F.concat(F.make_valid_utf8(kept), F.lit(marker))
    ).otherwise(text)


def fixed_decimals(number: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, half-even on the exact binary value, no grouping."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", number, F.lit(pattern))


def float_text(number: Column) -> Column:
    """Shortest decimal text of a double: plain digits from 1e-4 up to 1e16."""
    text = number.cast("string")
    size = F.abs(number)
    digits = text.try_cast("decimal(38,20)").cast("string")
    plain = F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")
    tiny = F.regexp_replace(
        F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "E-0$1"
    )
    return (
        F.when((size >= 1e-3) & (size < 1e7), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(size >= 1e16, F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E", "e+"))
        .when(size > 0, F.lower(tiny))
        .otherwise(text)
    )


def _group(name: str) -> str:
    """A group name that Java accepts: letters and digits only."""
    return name.replace("_", "U95") if "_" in name else name


def java_pattern(pattern: str) -> str:
    """A Python-style pattern as a case-insensitive Java regex.

    Flags: Unicode classes, and only ``\\n`` as a line end, as Python has it.
    """
    translated = re.sub(r"(?<!\\)((?:\\\\)*)\(\?#[^)]*\)", r"\1", pattern)
    translated = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_group(m[1])}>", translated)
    translated = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{_group(m[1])}>", translated)
    # Unicode classes and letters only where the pattern has any: they cost time.
    wide = re.search(r"\\[wWsSdDbB]", translated) or not translated.isascii()
    return ("(?idU)" if wide else "(?id)") + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", translated)


# Control characters that a replacement may write as escapes.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def java_replacement(replacement: str) -> str:
    """A Python-style replacement (``\\1``, ``\\g<name>``, ``\\n``) in Java syntax, ``$`` literal."""

    def translate(token: re.Match) -> str:
        if token["group"]:
            name = token["group"]
            return f"${name}" if name.isdigit() else f"${{{_group(name)}}}"
        if token["number"]:
            return f"${token['number']}"
        if token["escape"]:
            return _ESCAPES.get(token["escape"], "\\\\" + token["escape"].replace("\\", ""))
        return "\\$"

    parts = r"\\g<(?P<group>\w+)>|\\(?P<number>[1-9]\d?)|\\(?P<escape>.)|\$"
    return re.sub(parts, translate, replacement, flags=re.DOTALL)
