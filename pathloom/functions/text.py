"""Text expressions: names, keys, positions written as text, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without signal in a place name.
OFFLINE_STOPWORDS = ("the", "a", "an", "at", "to", "in", "of", "building", "hall", "center", "centre", "house")
STOPWORDS = ("the", "and", "for", "building", "hall", "center", "centre", "house")
#: A plain decimal number; positions are two of them, or three with a height, between commas.
NUMBER = "-?[0-9]+([.][0-9]+)?"


def parse_gps(text: Column) -> Column:
    """(latitude, longitude) of "a, b", swapped where only the swap makes sense; null for other text."""
    given = F.transform(F.split(F.trim(text), ","), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    fits = F.size(given).isin(2, 3) & F.forall(given, lambda p: p.rlike(f"^{NUMBER}$"))
    a, b = (F.get(given, F.lit(k)).try_cast("double") for k in (0, 1))
    swap = ((F.abs(a) > 90) & (F.abs(b) <= 90)) | ((F.abs(a) > 50) & (F.abs(b) < 50))
    lat, lng = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.when(fits, F.struct(lat.alias("latitude"), lng.alias("longitude")))


def node_key(lng: Column, lat: Column) -> Column:
    """Name of a node by its rounded position."""
    part = lambda x: F.bround(x * 100000, 0).cast("long").cast("string")
    return F.concat(F.lit("n"), part(lng), F.lit("_"), part(lat))


def key_position(key: Column) -> Column:
    parts = F.split(F.substring(key, 2, 64), "_")
    return F.struct((parts[0].cast("double") / 100000).alias("longitude"), (parts[1].cast("double") / 100000).alias("latitude"))


def worded_key(lat: Column, lng: Column) -> Column:
    """The older name: n39p32_m76p62."""
    text = F.concat(F.lit("n"), F.format_string("%.2f", lat), F.lit("_"), F.format_string("%.2f", lng))
    return F.translate(text, ".-", "pm")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_name(text: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(plain(text), " ")), "")


def signal_words(text: Column) -> Column:
    """Words of three letters or more that are no stop words."""
    return F.filter(F.split(F.lower(text), "[^A-Za-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def accessibility(code: Column) -> Column:
    """A survey code's grade; the first arm that matches wins, unknown codes are null."""
    text = F.lower(F.regexp_replace(code, "[^A-Za-z]", ""))
    return (
        F.when(text.contains("non"), "NonCompliant")
        .when(text.contains("partial"), "PartiallyCompliant")
        .when(text.contains("compliant"), "FullyCompliant")
        .when(text != "", "Other")
    )


def distance_label(metres: Column) -> Column:
    return F.when(metres >= 1000, F.concat(F.format_string("%.1f", metres / 1000), F.lit(" km"))).otherwise(
        F.concat(F.floor(metres + 0.5).cast("long").cast("string"), F.lit(" m"))
    )
