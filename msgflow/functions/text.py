"""Text functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters written for letters, two letters whose lower case would not be one letter, and noise.
LEET = "4@3€1!|05$"
LEET_LETTERS = "aaeeiiioss"
ONE_TO_ONE = "İΣ"
ONE_TO_ONE_LOWER = "iσ"
NOISE = r"[\p{P}\p{S}\p{Z}\s\x0B\x{85}]"
SEPARATORS = r"[^\p{L}\p{M}\p{N}_]+"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
FEATURES = 4096


def normalize_leet(text: Column) -> Column:
    """Letters only: written-over characters become letters, punctuation, symbols and white space go."""
    return F.lower(F.regexp_replace(F.translate(text, LEET + ONE_TO_ONE, LEET_LETTERS + ONE_TO_ONE_LOWER), NOISE, ""))


def tokens(text: Column) -> Column:
    """Words in lower case; NULL text has none."""
    return F.coalesce(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""), F.array().cast("array<string>"))


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    digits = F.hex(F.encode(word, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, 2), 16, 10).cast("bigint")
    steps = F.when(F.octet_length(word) > 0, F.sequence(F.lit(1), F.octet_length(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(FNV_OFFSET).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME) % (1 << 32))


def feature_ids(text: Column, size: int = FEATURES) -> Column:
    """Sorted distinct hashed word features of a text (binary bag of words)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: fnv1a(w) % size)))


def human_bytes(n: Column) -> Column:
    """``B``, ``KB``, ``MB`` or ``GB`` with at most one decimal."""
    power = F.when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1 << 10, 1).otherwise(0)
    shown = F.regexp_replace(F.round(n.cast("double") / F.pow(F.lit(1024.0), power), 1).cast("string"), r"\.0$", "")
    return F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power + 1))
