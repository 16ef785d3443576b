"""Normalizers, tokenizers and phrase functions as column expressions.

Several tokenizers exist side by side because their callers depend on their differences; none is shared between callers.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words and what speech recognition makes of them, after a word for drawer (fixed values).
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "won": "1", "too": "2", "tree": "3", "fore": "4"}
DRAWER_WORDS = ["drawer", "door", "draw"]
#: Phrases with which users correct a reply (fixed values).
CORRECTION_CUES = ["did not mean", "didn't mean", "i meant", "no i said", "no, i said", "i said", "that is wrong", "that's wrong", "wrong item", "not that one"]
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6}
CARDINALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}


def mapping(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def normal_text(c) -> Column:
    """Lower case, white space collapsed.  (Compatibility forms are folded by ``functions.unicode.nfkc`` where they matter.)"""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def words(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def drawer_tokens(c) -> Column:
    """Words, with number words turned into digits right after a word for drawer."""
    raw = words(c)
    before = F.slice(F.concat(F.array(F.lit("")), raw), 1, F.size(raw))
    number = mapping(NUMBER_WORDS)
    return F.zip_with(raw, before, lambda w, p: F.when(p.isin(*DRAWER_WORDS) & number[w].isNotNull(), number[w]).otherwise(w))


def unicode_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))


def norm_alnum(c) -> Column:
    """Letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def source_words(c) -> Column:
    """Bracketed tags dropped, door read as drawer, homophones and number words as digits, <item> kept."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"\[[^\]]*\]", " "), r"\bdoor\b", "drawer")
    raw = F.regexp_extract_all(plain, F.lit("<item>|[a-z0-9]+"), F.lit(0))
    number = mapping({**{k: str(v) for k, v in CARDINALS.items()}, "too": "2", "to": "2"})
    return F.transform(raw, lambda w: F.coalesce(number[w], w))


def number_variants(c) -> Column:
    """A phrase and its other number by its last word's ending: ies/y, s, consonant+y/ies, +s."""
    last = F.element_at(F.split(c, " "), -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(last))
    cut = lambda n: F.substring(last, F.lit(1), F.length(last) - n)
    other = (
        F.when(last.endswith("ies") & (F.length(last) > 3), F.concat(cut(3), F.lit("y")))
        .when(last.endswith("s") & ~last.endswith("ss") & (F.length(last) > 1), cut(1))
        .when(last.endswith("y") & (F.length(last) > 1) & ~F.substring(last, -2, 1).isin(*"aeiou"), F.concat(cut(1), F.lit("ies")))
        .otherwise(F.concat(last, F.lit("s")))
    )
    return F.array_distinct(F.array(c, F.concat(head, other)))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether a phrase's words stand next to each other in a token array."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def is_correction(c) -> Column:
    t = normal_text(c)
    found = F.lit(False)
    for cue in CORRECTION_CUES:
        found = found | t.contains(cue)
    return found


def rejected(c) -> Column:
    return F.lower(c).rlike(r"\b(not there|wrong|can't find|cannot find|couldn't find|isn't there|not in)\b")


def drawer_mentions(c) -> Column:
    """Drawer numbers said as "drawer two", "drawer 2" or "second drawer", in that order."""
    t = F.lower(c)
    after = F.regexp_extract_all(t, F.lit(r"\bdrawer\s+(one|two|three|four|five|six|[0-9]+)\b"), F.lit(1))
    ahead = F.regexp_extract_all(t, F.lit(r"\b(first|second|third|fourth|fifth|sixth)\s+drawer\b"), F.lit(1))
    numbers, order = mapping(CARDINALS), mapping(ORDINALS)
    return F.concat(F.transform(after, lambda w: F.coalesce(numbers[w], F.expr("cast(null as int)"), w.try_cast("int"))), F.transform(ahead, lambda w: order[w]))


def timing_bucket(ms: Column, edges=(1000, 3000, 7000, 15000)) -> Column:
    """The first edge that isn't exceeded, as "<=edge"; above all ">last"; null is "missing"."""
    out = F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        out = F.when(ms <= e, f"<={e}").otherwise(out)
    return F.when(ms.isNull(), "missing").otherwise(out)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex from two SHA-256 passes: the padded keys are constants."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
