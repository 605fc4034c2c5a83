"""Track identity: normalised names and tiered keys, as Column functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide which names are one.
VERSION_TAG = r"(?iu)\s*[\(\[][^)\]]*\b(remaster(?:ed)?|remix|edit|radio\s+edit|extended|bonus\s+track|live|explicit|clean|version|acoustic|mono|stereo|deluxe|re[\- ]?record(?:ed)?)\b[^)\]]*[\)\]]"
VERSION_TAIL = r"(?iu)\s[-–—]\s.*\b(remaster(?:ed)?|edit|version|mix|acoustic|re[\- ]?record(?:ed)?)\b.*$"
FEATURING = r"(?iu)\s*(?:[\(\[])?\s*\b(?:feat(?:\.|uring)?|ft\.?)\b.*?(?:[\)\]]|$)"
SEPARATOR = r"(?iu)\s*(?:,|&|\band\b|/|\+|;|×|\bx\b)\s*"
LEADING_THE = r"(?iu)^the\s+"
#: Provider ids in order of trust, with the prefix of their keys.
PROVIDER_PREFIXES = (("acrcloud", "acr"), ("audd", "audd"), ("shazam", "shz"), ("catalog", "cat"))


def _folded() -> tuple[str, str, dict[str, str]]:
    """Letters and digits whose compatibility decomposition, without combining marks, holds ASCII ones: single ones and their fold, and others with theirs."""
    single, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if any(c.isascii() and c.isalnum() for c in plain):
            if len(plain) == 1:
                single[chr(code)] = plain
            else:
                several[chr(code)] = plain
    return "".join(single), "".join(single.values()), several


FOLDED, FOLDS, EXPANDED = _folded()


def strip_diacritics(text: Column) -> Column:
    """Letters and digits without diacritics and in plain form; only rows that are not ASCII are looked at further."""
    one = F.translate(text, FOLDED, FOLDS)
    pairs = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in EXPANDED.items())), F.lit("\x02"), F.lit("\x01"))
    more = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    expandable = text.rlike(f"[{''.join(map(re.escape, EXPANDED))}]")
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).when(expandable, more).otherwise(one)


def clean_token(text: Column) -> Column:
    """Lower case a-z and 0-9 only, diacritics stripped."""
    return F.regexp_replace(F.lower(strip_diacritics(text)), "[^a-z0-9]+", "")


def without_tags(text: Column) -> Column:
    """Version tags taken out until none is left; each turn that finds one takes a bracket, so their number bounds the turns."""
    turns = F.array_repeat(F.lit(0), F.regexp_count(text, F.lit(r"[\(\[]")))
    return F.when(text.rlike(VERSION_TAG), F.aggregate(turns, text, lambda t, _: F.regexp_replace(t, VERSION_TAG, ""))).otherwise(text)


def normalized_title(title: Column) -> Column:
    """Title without featured artists, version tags, version tail and leading article; empty for null."""
    text = without_tags(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), FEATURING, ""))
    return clean_token(F.regexp_replace(F.regexp_replace(text, VERSION_TAIL, ""), LEADING_THE, ""))


def normalized_artists(artist: Column) -> Column:
    """Artists cleaned, distinct and sorted, joined by semicolons; empty for null."""
    text = F.regexp_replace(F.trim(F.coalesce(artist, F.lit(""))), FEATURING, "")
    parts = F.transform(F.split(text, SEPARATOR), lambda p: clean_token(F.regexp_replace(F.trim(p), LEADING_THE, "")))
    return F.array_join(F.array_distinct(F.array_sort(F.filter(parts, lambda p: p != ""))), ";")


def fuzzy_key(artist: Column, title: Column) -> Column:
    return F.concat(normalized_artists(artist), F.lit("::"), normalized_title(title))


def identity_key(artist: Column, title: Column, isrc: Column, provider_ids: Column) -> Column:
    """Key of the best tier there is: recording code, provider id, names, each with its tag. Two tracks merge if their keys are equal."""
    code = F.upper(F.nullif(F.trim(isrc), F.lit("")))
    by_provider = [F.concat(F.lit(f"{prefix}::"), F.lower(F.nullif(F.trim(provider_ids[name]), F.lit("")))) for name, prefix in PROVIDER_PREFIXES]
    return F.coalesce(F.concat(F.lit("isrc::"), code), *by_provider, F.concat(F.lit("fuzzy::"), fuzzy_key(artist, title)))


def tier(key: Column) -> Column:
    """isrc, provider_id or fuzzy by the key's tag; unknown for a key without one."""
    by_provider = F.lit(False)
    for _, prefix in PROVIDER_PREFIXES:
        by_provider = by_provider | key.startswith(f"{prefix}::")
    return F.when(key.startswith("isrc::"), "isrc").when(by_provider, "provider_id").when(key.startswith("fuzzy::"), "fuzzy").otherwise("unknown")
