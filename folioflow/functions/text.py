"""Text functions as Column expressions; NFC and the sequence ratio are Arrow-batched UDFs, as Spark has no builtin."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Glyphs and what they stand for.
SAME_WIDTH = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "•": "*", "·": "*", " ": " "}
WIDER = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "—": "--", "…": "..."}
GONE = "­​�"
#: Characters outside these are noise of character recognition.
CLEAN_CLASS = "\\x20-\\x7E¡-ɏ–—’“”\\n\\r\\t"
#: The part of it that is ASCII, which a pattern passes over much faster than the whole.
CLEAN_ASCII = "\\x20-\\x7E\\n\\r\\t"
WORD = "[\\p{L}\\p{N}_]"


#: Unicode white space and the separators \x1c to \x1f, as Python strips them.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space. No pattern, which would be tried at every blank."""
    return F.trim(c, F.lit(BLANKS))


def fix_ligatures(c: Column) -> Column:
    out = F.translate(c, "".join(SAME_WIDTH) + GONE, "".join(SAME_WIDTH.values()))
    for glyph, plain in WIDER.items():
        out = F.replace(out, F.lit(glyph), F.lit(plain))
    return out


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column, raw: Column) -> Column:
    """nfc of c, made of raw; only texts with characters beyond ASCII are sent to it."""
    return F.coalesce(nfc(F.when(F.octet_length(raw) != F.length(raw), c)), c)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def remove_noise(c: Column, threshold: float = 0.02) -> Column:
    """Noise characters go if they are threshold of the text or more; tokens left blank go, unless they hold a line break."""
    noisy = F.regexp_count(F.regexp_replace(c, f"[{CLEAN_ASCII}]+", ""), F.lit(f"[^{CLEAN_CLASS}]")) / F.length(c)
    pairs = F.transform(F.split(c, " "), lambda t: F.struct(t.alias("was"), F.regexp_replace(t, f"[^{CLEAN_CLASS}]", "").alias("now")))
    kept = F.filter(pairs, lambda p: (F.length(strip(p["now"])) > 0) | p["was"].contains("\n"))
    return F.when((F.length(c) == 0) | (noisy < threshold), c).otherwise(F.array_join(F.transform(kept, lambda p: p["now"]), " "))


def join_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, f"({WORD})-\\s*\\n\\s*({WORD})", "$1$2")


def normalize_space(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))


def clean(c: Column) -> Column:
    """All cleaning steps in order; an empty text stays empty."""
    return F.when(F.length(c) == 0, c).otherwise(normalize_space(join_hyphens(remove_noise(composed(fix_ligatures(c), c)))))


def comparable(c: Column) -> Column:
    """Lower case, white space to one space, dashes and quotes made plain."""
    out = F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")
    return F.translate(composed(out, c), "‒–—‘’‚“”„", "---'''\"\"\"")


def join_currency(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(USD|GBP|EUR|AUD|CAD)\s+", "$1")


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))
