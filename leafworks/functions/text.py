"""Text expressions shared by operators; all are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode scripts as code point ranges, in order; those written from right to left; those that need shaping.
SCRIPTS = {
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "Devanagari": [(0x0900, 0x097F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x0980, 0x09FF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Lao": [(0x0E80, 0x0EFF)],
    "Tibetan": [(0x0F00, 0x0FFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Korean": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "CJK": [(0x4E00, 0x9FFF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF)],
    "Cyrillic": [(0x0400, 0x04FF), (0x0500, 0x052F)],
    "Greek": [(0x0370, 0x03FF)],
    "Latin": [(0x0000, 0x024F)],
}
RTL = ["Arabic", "Hebrew"]
SHAPED = ["Arabic", "Hebrew", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam", "Thai", "Lao", "Tibetan", "Myanmar"]
# Script labels by ISO 15924, in order; Zyyy stands for everything else.
LABELS = {
    "Latn": [(0x0041, 0x024F), (0x1E00, 0x1EFF)], "Arab": [(0x0600, 0x06FF), (0x0750, 0x077F)], "Hebr": [(0x0590, 0x05FF)], "Deva": [(0x0900, 0x097F)], "Hans": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
    "Grek": [(0x0370, 0x03FF)], "Cyrl": [(0x0400, 0x04FF)], "Thai": [(0x0E00, 0x0E7F)],
}


def ranges(parts: list[tuple[int, int]]) -> str:
    """What stands in a character class for these code points, for Java's and RE2's expressions alike."""
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in parts)


def words(text: Column) -> Column:
    """Runs of anything but white space, Unicode's too; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def contains_count(text: Column, indicators: list[str]) -> Column:
    """How many of the indicators occur in text, case folded."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for i in indicators:
        total = total + low.contains(i.lower()).cast("int")
    return total


def scrub(text: Column, most: int) -> Column:
    """White space collapsed, e-mail addresses and phone-like digit runs dropped, cut to most characters."""
    out = F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "")
    return F.substring(F.regexp_replace(out, r"[0-9][0-9 -]{6,}[0-9]", ""), 1, most)
