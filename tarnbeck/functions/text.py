"""Text expressions: normalisation, tokens, templates.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NON_DISTINCTIVE, RULES


def normalize(text: Column) -> Column:
    """Lower case, white space trimmed, punctuation and symbols gone, white space runs as one space."""
    trimmed = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"[\p{P}\p{S}]", ""), r"(?U)\s+", " ")


def words(text: Column) -> Column:
    """The words of a normalised text (none for an empty one)."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def ascii_norm(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), 1), " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"[a-z0-9']+"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), lambda s: s != "")


def is_non_distinctive(normalized: Column) -> Column:
    """True for texts of filler words alone, and for empty ones."""
    return F.size(F.array_except(words(normalized), F.array(*[F.lit(w) for w in NON_DISTINCTIVE]))) == 0


def strip_special_tokens(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|[^|]*\|>", "")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-/ ()]", "_")


def premise(text: Column, context: Column) -> Column:
    """The scorer's input: the last words of the context, if there are any, before the text."""
    have = F.filter(F.split(context, r"\s+"), lambda w: w != "")
    last = F.array_join(F.slice(have, F.greatest(F.size(have) - RULES.context_words + 1, F.lit(1)), RULES.context_words), " ")
    return F.when(F.size(have) > 0, F.concat(F.lit("Before: "), last, F.lit(" Now: "), text)).otherwise(text)


def context_before(segment: Column, alert: Column, earlier: Column) -> Column:
    """What was said before an alert: earlier segments, and its own segment up to the alert."""
    at = F.when(segment == alert, F.lit(0)).otherwise(F.instr(segment, alert) - 1)
    own = F.when(at > 0, F.substring(segment, F.lit(1), at)).otherwise("")
    return F.trim(F.concat_ws(" ", earlier, own))


def md5_percent(key: Column) -> Column:
    """int(md5(key), 16) % 100, folded over four 32-bit words (2**32 % 100 = 96)."""
    h = F.md5(key)
    total: Column = F.lit(0).cast("long")
    for k in range(4):
        total = (total * 96 + F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long")) % 100
    return total


def md5_split(key: Column) -> Column:
    p = md5_percent(key)
    return F.when(p < 70, "train").when(p < 85, "dev").otherwise("test")
