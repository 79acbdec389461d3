"""Scalar normalisation of landed disclosure fields, as column expressions."""

from __future__ import annotations

import unicodedata

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size label -> (minimum, maximum), matched in this order.
SIZE_LABELS = {
    "1k-15k": (1_000, 15_000),
    "15k-50k": (15_000, 50_000),
    "50k-100k": (50_000, 100_000),
    "100k-250k": (100_000, 250_000),
    "250k-500k": (250_000, 500_000),
    "500k-1m": (500_000, 1_000_000),
    "1m-5m": (1_000_000, 5_000_000),
    "5m+": (5_000_000, 5_000_000),
}

# Accepted date formats, tried in this order.
PAGE_DATE_FORMATS = ("d MMM yyyy", "MMM d yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy")
API_DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d")

# Keywords -> transaction type, tried in this order.
TYPE_KEYWORDS = (
    (("purchase", "buy"), "buy"),
    (("sale", "sell"), "sell"),
    (("exchange",), "exchange"),
    (("option",), "option"),
    (("receive",), "receive"),
)


def blank_to_null(col: Column) -> Column:
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def _size(low: Column, high: Column) -> Column:
    return F.struct(
        low.cast("bigint").alias("size_min"), high.cast("bigint").alias("size_max"),
        F.floor((low + high) / 2).cast("bigint").alias("size_midpoint"),
    )


def parse_size(col: Column) -> Column:
    """Size label -> (min, max, integer midpoint); dashes, ``$``, commas and spaces are tolerated."""
    text = F.regexp_replace(F.regexp_replace(F.lower(col), "[–—]", "-"), r"[$,\s]", "")
    none = F.lit(None).cast("bigint")
    low = high = None
    for label, (lo, hi) in SIZE_LABELS.items():
        hit = text.contains(label)
        low = F.when(hit, lo) if low is None else low.when(hit, lo)
        high = F.when(hit, hi) if high is None else high.when(hit, hi)
    return _size(low.otherwise(none), high.otherwise(none))


def parse_amount(col: Column) -> Column:
    """``$a - $b``, ``Over $x`` or one amount -> (min, max, integer midpoint)."""
    text = F.trim(F.lower(F.regexp_replace(col, "[$,]", "")))
    whole = lambda s: F.when(s != "", s).try_cast("bigint")
    over = whole(F.regexp_extract(text, r"(\d+)", 1))
    # Only digits and separators matter: the first two runs of digits between separators.
    runs = F.regexp_replace(text, "[^0-9to–-]", "")
    first = whole(F.regexp_extract(runs, "^[to–-]*([0-9]+)", 1))
    second = whole(F.regexp_extract(runs, "^[to–-]*[0-9]+[to–-]+([0-9]+)", 1))
    is_over = text.startswith("over")
    low = F.when(is_over, over).otherwise(first)
    high = F.when(is_over, over).otherwise(F.coalesce(second, first))
    return _size(low, high)


def _shape(fmt: str) -> str:
    """Regular expression of a format's outline, so that parsing is only tried where it can succeed."""
    for token, pattern in (("yyyy", r"\d{4}"), ("MMM", "[A-Za-z]{3}"), ("M", r"\d{1,2}"), ("d", r"\d{1,2}"), (" ", r"\s+")):
        fmt = re.sub(rf"(?<![A-Za-z\\]){token}(?![A-Za-z])" if token != " " else " ", lambda _: pattern, fmt)
    return f"^{fmt}$"


def parse_date(col: Column, formats: Sequence[str] = API_DATE_FORMATS, as_of: Column | None = None) -> Column:
    """First matching format wins, junk gives NULL.

    With ``as_of`` also relative words and squeezed page dates ("14:01Today", "9 Feb2026").
    """
    text = F.trim(col)
    if as_of is not None:
        # The squeezed forms in which pages write dates.
        text = F.trim(F.regexp_replace(text, r"^\d{1,2}:\d{2}\s*", ""))
        text = F.regexp_replace(text, r"([A-Za-z]{3})(\d{4})", "$1 $2")
        text = F.regexp_replace(text, r"(\d{1,2})([A-Za-z])", "$1 $2")
    parsed = F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_date(text, f)) for f in formats])
    if as_of is None:
        return parsed
    word = F.lower(col)
    return F.when(word.contains("today"), as_of).when(word.contains("yesterday"), F.date_sub(as_of, 1)).otherwise(parsed)


def norm_tx_type(col: Column) -> Column:
    text = F.trim(F.lower(col))
    out = None
    for words, kind in TYPE_KEYWORDS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(text)


def norm_party(col: Column) -> Column:
    """Names, initials and ``GOP`` -> party name; anything else in title case."""
    text = F.trim(F.lower(col))
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(text.startswith("r") | (text == "gop"), "Republican")
        .when(text.startswith("d"), "Democrat").when(text.startswith("i"), "Independent").otherwise(F.initcap(text))
    )


def party_from_code(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text.isin("100", "D"), "Democrat").when(text.isin("200", "R"), "Republican")


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def synthetic_filer_id(name: Column, chamber: Column) -> Column:
    house = F.coalesce(F.lower(chamber).contains("house"), F.lit(False))
    return F.concat(F.when(house, "FH_").otherwise("FS_"), slug(name))


def make_trade_id(filer_id: Column, ticker: Column, date: Column, tx_type: Column, chamber: Column) -> Column:
    house = F.coalesce(F.lower(chamber).contains("house"), F.lit(False))
    return F.concat_ws(
        "_", F.when(house, "fmph").otherwise("fmps"), filer_id, F.coalesce(ticker, F.lit("NOTICKER")),
        F.date_format(date, "yyyyMMdd"), F.substring(tx_type, 1, 1),
    )


def _accents() -> tuple[str, str]:
    """Every accented lower-case Latin letter with the ASCII letter that it decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, plain) for c, plain in pairs if c == c.lower() and plain != c and plain.isascii()]
    return "".join(c for c, _ in pairs), "".join(plain for _, plain in pairs)


_ACCENTED, _PLAIN = _accents()


def fold_name(col: Column) -> Column:
    """Lower case, accents folded, only ASCII letters, space, hyphen and apostrophe kept."""
    return F.regexp_replace(F.translate(F.lower(F.trim(col)), _ACCENTED, _PLAIN), "[^a-z '-]", "")
