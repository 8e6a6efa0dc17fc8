"""Text, URL and JSON columns."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def url_without_query(url: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_detail_url(url: Column, segment: str = "vehicle") -> Column:
    return url_path(url).contains(f"/{segment}/")


def segment_after(url: Column, segment: str = "vehicle") -> Column:
    """The path segment that follows `segment` (any case), unless it is the last of the path; else null."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    at = F.array_position(F.transform(parts, F.lower), segment)
    return F.when((at > 0) & (at + 1 < F.size(parts)), F.get(parts, at.cast("int")))


def vin_in_path(url: Column) -> Column:
    """A 17-character token without I, O and Q."""
    return empty_to_null(F.regexp_extract(F.upper(url_path(url)), r"\b([A-HJ-NPR-Z0-9]{17})\b", 1))


def dedup_key(url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("vin:"), vin_in_path(url)), F.concat(F.lit("url:"), url_without_query(url)))


def image_url_upsized(url: Column) -> Column:
    return F.regexp_replace(url, r"/\d+x\d+/", "/2048x2048/")


def feature_key(c: Column) -> Column:
    """Lower case, each run of other characters than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def hashtag(c: Column, longest: int = 28) -> Column:
    """One token stays as it is; of several, those not in capitals are capitalised. Null if empty or too long."""
    tokens = F.filter(F.split(F.regexp_replace(c, "[^A-Za-z0-9]+", " "), " "), lambda t: t != "")
    joined = F.array_join(F.transform(tokens, lambda t: F.when(F.upper(t) == t, t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1000))))), "")
    tag = F.when(F.size(tokens) == 1, F.get(tokens, F.lit(0))).otherwise(joined)
    return F.when((F.length(tag) > 0) & (F.length(tag) <= longest), F.concat(F.lit("#"), tag))


def city_state(address: Column) -> Column:
    """Of street, city, state and more the city and the state's first word; of two parts both; else the address as it is."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    long = F.concat_ws(", ", F.get(parts, F.lit(1)), F.get(F.split(F.get(parts, F.lit(2)), " "), F.lit(0)))
    return F.when(n >= 3, long).when(n == 2, F.array_join(parts, ", ")).otherwise(address)


def tidy_text(c: Column) -> Column:
    """Markup to text: <br> is a line end, tags go, then references are decoded; at most one empty line."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    decoded = F.when(bare.contains("&"), unescaped(bare)).otherwise(bare)
    spaced = F.regexp_replace(F.regexp_replace(decoded, "[ \t]+", " "), " ?\n ?", "\n")
    return empty_to_null(F.trim(F.regexp_replace(spaced, "\n{3,}", "\n\n")))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Upper case after every character that isn't a letter (initcap looks at spaces alone)."""
    return texts.map(str.title, na_action="ignore")


@F.pandas_udf(StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Letters apart from their accents, ligatures and the like as plain letters."""
    return texts.astype("string").str.normalize("NFKD")


def slug(c: Column, longest: int = 80) -> Column:
    """ASCII letters and digits; white space and underscores, in runs, are a hyphen; hyphens stay, but for those at the ends; `vehicle` if nothing is left."""
    blank = r"\s\x1C-\x1F_"
    kept = F.regexp_replace(decomposed(c), f"[^A-Za-z0-9{blank}-]+", "")
    hyphened = F.btrim(F.regexp_replace(kept, f"[{blank}]+", "-"), F.lit("-"))
    return F.when(c.isNotNull(), F.coalesce(empty_to_null(F.substring(hyphened, 1, longest)), F.lit("vehicle")))


def _balanced(text: str, marker: str) -> str | None:
    at = text.find(marker)
    start = text.find("{", at + len(marker)) if at >= 0 else -1
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                try:
                    json.loads(text[start : i + 1])
                except ValueError:
                    return None
                return text[start : i + 1]
    return None


def balanced_json(text: Column, marker: str) -> Column:
    """The JSON object that begins after the marker, as text; null if none or malformed. Braces in strings
    don't count, so no pattern can find its end."""

    @F.pandas_udf(StringType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _balanced(t, marker), na_action="ignore")

    return found(text)


def first_extracted(text: Column, extractors: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The first extractor (name, marker) in order that finds an object: the object and the name."""
    found = [(name, balanced_json(text, marker)) for name, marker in extractors]
    return F.coalesce(*(c for _, c in found)), F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in found))


def titled(c: Column) -> Column:
    """Title case as columns alone: a letter after what is no letter is upper-cased, all others are lower-cased."""
    starts = F.split(F.lower(c), r"(?<![\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(starts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")
