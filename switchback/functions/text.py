"""Names and text as Column expressions."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that a search expands.
ABBREVIATIONS = {
    "mt": "mount", "mtn": "mountain", "pt": "point", "st": "saint", "ft": "fort", "lk": "lake", "pk": "peak", "cr": "creek",
    "crk": "creek", "cyn": "canyon", "jct": "junction", "spgs": "springs", "spr": "spring", "fk": "fork", "br": "bridge",
    "brg": "bridge", "trl": "trail", "hwy": "highway", "rd": "road", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}
SIMILAR = 0.3


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def trigrams(text) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def similarity(a, b) -> Column:
    """Jaccard of the trigram sets; 0 if both are empty."""
    x, y = trigrams(a), trigrams(b)
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def is_similar(a, b, least: float = SIMILAR) -> Column:
    return similarity(a, b) >= least


def search_name(name) -> Column:
    """Lower case with abbreviated words written out."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.trim(F.array_join(F.transform(F.split(F.lower(_c(name)), r"\s+"), lambda w: F.coalesce(F.element_at(table, w), w)), " "))


def _latin(kind: str) -> tuple[str, str]:
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text) -> Column:
    """Latin letters without their marks, by a table made from their decompositions."""
    return F.regexp_replace(F.translate(_c(text), *_latin("strip")), r"\p{M}+", "")


def peak_name(name) -> Column:
    """Comparable name: no marks, lower case, letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(name)), r"[^a-z0-9]+", " "))


def trailhead_name(name) -> Column:
    """Comparable trailhead name: the words trail and head say nothing."""
    plain = F.regexp_replace(peak_name(name), r"\b(trail ?heads?|th|trails?|parking( area| lot)?|access)\b", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def tokens(name) -> Column:
    return F.array_distinct(F.filter(F.split(_c(name), r"\s+"), lambda w: w != ""))


def tokens_contained(a, b, least: int = 2) -> Column:
    """All words of the shorter name are in the other; it must have `least` words."""
    x, y = tokens(a), tokens(b)
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return (F.size(small) >= least) & (F.size(F.array_except(small, large)) == 0)


def token_dice(a, b) -> Column:
    x, y = tokens(a), tokens(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


GENERIC_ROUTE = r"^(gps|track|route|untitled|activity|hike|run|walk|recording|new route)?[ _-]*\d*$"


def is_named_route(name) -> Column:
    """A name that says more than that something was recorded."""
    return F.coalesce((F.length(F.trim(_c(name))) >= 4) & ~F.lower(F.trim(_c(name))).rlike(GENERIC_ROUTE), F.lit(False))


def shorten(text, most: int = 300) -> Column:
    """Whole sentences up to `most` characters; else words up to it and an ellipsis."""
    t = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, r"^(.*[.!?])(?:\s|$)", 1)
    cut = F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…"))
    return F.when(F.length(t) <= most, t).when(F.length(whole) > 0, whole).otherwise(cut)


def prefix_match(text, query: str) -> Column:
    """Case-insensitive prefix; LIKE's special characters are plain."""
    return F.startswith(F.lower(_c(text)), F.lit(query.lower()))


def token_prefix_match(text, query: str) -> Column:
    """Every word of the query starts a word of the text."""
    words = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+")
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.exists(words, _starts(w))
    return out


def _starts(word: str):
    return lambda t: F.startswith(t, F.lit(word))


def stable_id(prefix: str, *parts, length: int = 16) -> Column:
    """Deterministic id from parts by SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[_c(p).cast("string") for p in parts])), 1, length))


def road_reference(kind, number) -> Column:
    """Short road reference such as FR 25-100."""
    return F.concat_ws(" ", F.when(_c(kind) == "forest", "FR").when(_c(kind) == "blm", "BLM").otherwise("Rd"), F.regexp_replace(F.trim(_c(number)), r"^0+(?=\d)", ""))


@F.pandas_udf(T.StringType())
def encode_polyline6(line: pd.Series) -> pd.Series:
    """Encoded polyline at 1e-6 of arrays of (lat, lng) structs: bit shifts have no built-in form over a running difference."""

    def one(points) -> str | None:
        if points is None:
            return None
        out, last = [], [0, 0]
        for p in points:
            for k, v in enumerate((p["lat"], p["lng"])):
                now = int(v * 1e6 + (0.5 if v >= 0 else -0.5))
                d, last[k] = now - last[k], now
                d = ~(d << 1) if d < 0 else d << 1
                while d >= 0x20:
                    out.append(chr((0x20 | (d & 0x1F)) + 63))
                    d >>= 5
                out.append(chr(d + 63))
        return "".join(out)

    return line.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])))
def decode_polyline6(text: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        at, vals, out = 0, [0, 0], []
        while at < len(s):
            for k in (0, 1):
                shift = value = 0
                while True:
                    b = ord(s[at]) - 63
                    at += 1
                    value |= (b & 0x1F) << shift
                    shift += 5
                    if b < 0x20:
                        break
                vals[k] += ~(value >> 1) if value & 1 else value >> 1
            out.append({"lat": vals[0] / 1e6, "lng": vals[1] / 1e6})
        return out

    return text.map(one)


@F.pandas_udf(T.StringType())
def elevation_token(z: pd.Series) -> pd.Series:
    """Shortest decimal text without exponent or trailing zeros."""

    def one(x):
        if x is None or x != x or x in (float("inf"), float("-inf")):
            return None
        t = format(x, "f") if abs(x) < 1e15 and float(format(x, "f")) == x else format(Decimal(repr(float(x))), "f")
        t = t.rstrip("0").rstrip(".") if "." in t else t
        return "0" if t in ("-0", "") else t

    return z.map(one)


def profile(tokens_column) -> Column:
    """Base64 of pipe-joined elevation tokens."""
    return F.base64(F.encode(F.array_join(_c(tokens_column), "|"), "utf-8"))


def opaque_cursor(*parts) -> Column:
    return F.base64(F.encode(F.to_json(F.struct(*parts)), "utf-8"))
