"""Guards over questions and answers: masking, detection, redaction, risk, places."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lists
from lodestone.functions.text import LEFT, RIGHT, edged, fold_vowels
from lodestone.functions.words import let

EMAIL = rf"{LEFT}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{RIGHT}"
LONG_ID, SHORT_ID = rf"{LEFT}\d{{12}}{RIGHT}", r"(?<!\d)\d{9}(?!\d)"
#: As a word edge before '+' means a word character before it, a number with +84 counts inside a word only.
PHONE = rf"(?:(?<=[\p{{L}}\p{{N}}_])\+84|{LEFT}0)\d{{9,10}}{RIGHT}"
MOBILE = rf"(?:(?<=[\p{{L}}\p{{N}}_])\+84|{LEFT}0)(?:3|5|7|8|9)\d{{8}}{RIGHT}"


def _digits(c: Column) -> Column:
    """Whether there can be a number of the kinds above: each has nine digits in a row. Few texts do, and this is soon told."""
    return c.rlike("[0-9]{9}")


def mask(c: Column) -> Column:
    """Everything sensitive replaced by its kind, for logs."""
    kinds = ((LONG_ID, "[REDACTED_CCCD]"), (PHONE, "[REDACTED_PHONE]"), (EMAIL, "[REDACTED_EMAIL]"), (SHORT_ID, "[REDACTED_CMND]"))
    text = F.coalesce(c, F.lit(""))
    every = reduce(lambda acc, k: F.regexp_replace(acc, k[0], k[1]), kinds, text)
    return F.when(_digits(text), every).when(F.contains(text, F.lit("@")), F.regexp_replace(text, *kinds[2])).otherwise(text)


def has_sensitive(c: Column) -> Column:
    numbers = c.rlike(LONG_ID) | c.rlike(SHORT_ID) | c.rlike(PHONE)
    return F.coalesce((_digits(c) & numbers) | (F.contains(c, F.lit("@")) & c.rlike(EMAIL)), F.lit(False))


def sensitive_counts(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    count = lambda p: F.when(F.contains(text, F.lit("@")) if p == EMAIL else _digits(text), F.regexp_count(text, F.lit(p))).otherwise(0)
    return F.struct(*[count(p).alias(k) for k, p in (("long_ids", LONG_ID), ("short_ids", SHORT_ID), ("phones", PHONE), ("emails", EMAIL))])


def redact(c: Column, allowed: Column) -> Column:
    """Sensitive matches replaced, but for those that occur in the allowed text. Each kind is cut into the stretches before
    its matches, so every match is judged where it stands."""
    numbers, permitted = ((LONG_ID, "[REDACTED_CCCD]"), (SHORT_ID, "[REDACTED_CMND]"), (MOBILE, "[REDACTED_PHONE]")), F.coalesce(allowed, F.lit(""))

    def one(text: Column, pattern: str, tag: str) -> Column:
        def shown(t: Column, found: Column) -> Column:
            kinds = F.transform(found, lambda m: F.when((permitted != "") & F.contains(permitted, m), m).otherwise(F.lit(tag)))
            whole = F.array_join(F.flatten(F.zip_with(F.split(t, pattern), kinds, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
            return F.when(F.size(found) == 0, t).otherwise(whole)

        return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda found: shown(t, found)))

    text = F.coalesce(c, F.lit(""))
    plain = F.when(_digits(text), reduce(lambda acc, k: one(acc, *k), numbers, text)).otherwise(text)
    return let(plain, lambda t: F.when(F.contains(t, F.lit("@")), one(t, EMAIL, "[REDACTED_EMAIL]")).otherwise(t))


def output_guard(answer: Column, mode: Column, disclaimer: str, allowed: Column) -> Column:
    clean = redact(answer, allowed)
    if not disclaimer:
        return clean
    return F.when((mode == "strict") & ~F.contains(clean, F.lit(disclaimer)), F.concat(clean, F.lit(f"\n\n{disclaimer}"))).otherwise(clean)


def _opening(pattern: str) -> str:
    """Letters that every match of a pattern begins with, small; nothing where that isn't plain or they are few."""
    depth, plain = 0, pattern.removeprefix(LEFT).replace("\\.", ".")
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth <= 0:
            return ""
    found = re.match(r"\.?[^\W\d_][\w ]*", plain)
    if not found:
        return ""
    kept = found[0][:-1] if plain[found.end() : found.end() + 1] in ("?", "*", "{") else found[0]
    return kept.lower() if len(kept) > 2 else ""


def input_guard(c: Column, patterns: Sequence[str] = lists.INJECTION) -> Column:
    """Null if the question may pass, else the reason. Patterns are tried on texts that hold an opening of them, whatever its
    case; letters that are small ones of others by upper case alone (and İ) let a text through to the patterns."""
    text = F.coalesce(c, F.lit(""))
    opened = [p for p in patterns if _opening(p)]
    any_of = lambda some: text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in some)) if some else F.lit(False)
    may = let(F.lower(text), lambda low: reduce(lambda a, p: a | F.contains(low, F.lit(_opening(p))), opened, text.rlike("[\u0130\u0131\u017f\u212a]")))
    return F.when(~text.rlike(r"[^\s]"), F.lit("empty_input")).when((may & any_of(opened)) | any_of([p for p in patterns if not _opening(p)]), F.lit("prompt_injection"))


def risk(c: Column, keywords: Sequence[str] = (), high: Sequence[tuple] = lists.HIGH_RISK, medium: Sequence[tuple] = lists.MEDIUM_RISK) -> Column:
    """struct<level, force_strict, reasons>."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    any_of = lambda words: text.rlike("(?iu)" + "|".join(edged(w) for w in words))
    first = F.coalesce(*[F.when(any_of([k.strip().lower()]), F.lit(f"domain_risk:{k}")) for k in keywords], F.lit(None).cast("string"))
    top = F.array_compact(F.array(*[F.when(any_of(words), F.lit(name)) for name, words in high], first))
    mid = F.array_compact(F.array(*[F.when(any_of(words), F.lit(name)) for name, words in medium], F.lit(None).cast("string")))
    level = F.when(F.size(top) > 0, "high").when(F.size(mid) > 0, "medium").otherwise("low")
    return F.struct(level.alias("level"), (F.size(top) > 0).alias("force_strict"), F.when(F.size(top) > 0, top).otherwise(mid).alias("reasons"))


def mode(configured: Column, force_strict: Column) -> Column:
    wanted = F.lower(F.coalesce(configured, F.lit("strict")))
    return F.when((wanted == "strict") | force_strict, F.lit("strict")).otherwise(F.lit("friendly"))


def refuses(reasons: Column, c: Column, actions: Sequence[str], subjects: Sequence[str] = ("medical",)) -> Column:
    """Whether a fixed refusal is due: a reason of the given kinds together with one of the action words."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.arrays_overlap(reasons, F.array(*[F.lit(s) for s in subjects])) & reduce(lambda a, w: a | F.contains(text, F.lit(w)), actions, F.lit(False))


def unsupported_place(c: Column, supported: Sequence[str], places: Sequence[str] = lists.OTHER_PLACES, folded: Sequence[str] = lists.OTHER_PLACES_FOLDED) -> Column:
    """Whether the text names a place of the lists, and none that is supported. Without supported places: never."""
    if not supported:
        return F.lit(False)
    low = F.lower(F.coalesce(c, F.lit("")))
    plain = fold_vowels(low)
    known = reduce(lambda a, s: a | F.contains(low, F.lit(s.lower())) | F.contains(plain, fold_vowels(F.lit(s))), supported, F.lit(False))
    return ~known & (low.rlike("(?iu)" + "|".join(map(edged, places))) | plain.rlike("(?i)" + "|".join(map(edged, folded))))
