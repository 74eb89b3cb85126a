"""Similarities of names, dates, places and identifiers as Column expressions.

Null means not comparable and stays null unless a rule below says otherwise.
"""

from __future__ import annotations

import functools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

EARTH_M = 6_371_000.0


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jaro(a: str, b: str) -> float:
    """Share of matching characters within half the longer length, transpositions counted half."""
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (y for y, t in zip(b, taken) if t))) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@functools.lru_cache(1 << 16)
def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro, raised for up to four common first characters where it is above 0.7; both empty 1, one empty 0."""
    s = jaro(a, b)
    if s > 0.7:
        n = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            n += 1
        s += 0.1 * n * (1 - s)
    return s


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """:func:`jaro_winkler_text` over Arrow batches; Spark has no built-in. Score distinct pairs only."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_text(p, q) for p, q in zip(x, y)], dtype="float64")

    ship(SparkSession.active())
    return run(c(a), c(b))


def levenshtein_bytes(a: Column | str, b: Column | str) -> Column:
    """1 - edits / longer length, edits in characters but lengths in UTF-8 bytes; two empty texts give 1."""
    a, b = c(a), c(b)
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def levenshtein(a: Column | str, b: Column | str) -> Column:
    """1 - edits / longer length, both in characters."""
    a, b = c(a), c(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def combined(a: Column | str, b: Column | str) -> Column:
    return 0.7 * jaro_winkler(a, b) + 0.3 * levenshtein_bytes(a, b)


_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202"


def soundex_reset(name: Column | str) -> Column:
    """Soundex in which H and W, like vowels, part equal codes; empty where there is no ASCII letter."""
    letters = F.regexp_replace(F.upper(F.trim(c(name))), "[^A-Z]", "")
    runs = F.regexp_replace(F.translate(letters, _LETTERS, _DIGITS), r"(.)\1+", "$1")
    return F.when(letters == "", "").otherwise(F.concat(F.substring(letters, 1, 1), F.rpad(F.translate(F.substring(runs, F.lit(2), F.char_length(runs)), "0", ""), 3, "0")))


def soundex(name: Column | str) -> Column:
    """Soundex in which H and W are transparent; null where there is no ASCII letter."""
    letters = F.regexp_replace(c(name), "[^A-Za-z]", "")
    return F.when(letters != "", F.soundex(letters))


def phonetic(a: Column, b: Column) -> Column:
    """Of two Soundex codes: 1 if equal, else the common prefix over 4; 0 if either is empty."""
    prefix = reduce(lambda n, i: F.when(F.substring(a, 1, i) == F.substring(b, 1, i), i).otherwise(n), range(1, 5), F.lit(0))
    return F.when((a == "") | (b == ""), 0.0).otherwise(prefix / 4)


#: Fixed groups of equivalent given names.
NICKNAMES = [
    ["william", "bill", "billy", "will"], ["robert", "bob", "bobby", "rob"], ["richard", "dick", "rick", "ricky"], ["james", "jim", "jimmy", "jamie"], ["john", "jack", "johnny"],
    ["michael", "mike", "mickey"], ["elizabeth", "liz", "beth", "betty", "betsy"], ["margaret", "maggie", "meg", "peggy"], ["catherine", "cathy", "kate", "katie"],
    ["jennifer", "jen", "jenny"], ["christopher", "chris"], ["anthony", "tony"], ["thomas", "tom", "tommy"], ["joseph", "joe", "joey"], ["charles", "charlie", "chuck"],
]


def nickname_class(name: Column | str) -> Column:
    """Number of the group a name belongs to, or null."""
    table = F.create_map(*[F.lit(x) for i, g in enumerate(NICKNAMES) for n in g for x in (n, i)])
    return table[F.lower(F.trim(c(name)))]


def given_name(a: str, b: str) -> Column:
    """0.95 for nicknames of each other, else the better of Jaro-Winkler and Levenshtein."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).when(nickname_class(a) == nickname_class(b), 0.95).otherwise(F.greatest(jaro_winkler(x, y), levenshtein(x, y)))


def family_name(a: str, b: str) -> Column:
    """The best of Jaro-Winkler, Levenshtein and 0.85 for names that sound the same."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    sound = F.when(soundex_reset(x) == soundex_reset(y), 0.85).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(F.greatest(jaro_winkler(x, y), levenshtein(x, y), sound))


def birth_date(a: str, b: str) -> Column:
    """Tiers for dates that differ by a day, a swap or one part; both missing 0.5, one missing 0."""
    x, y = c(a), c(b)
    year, month, day = F.year(x) == F.year(y), F.month(x) == F.month(y), F.dayofmonth(x) == F.dayofmonth(y)
    swap = (F.month(x) == F.dayofmonth(y)) & (F.dayofmonth(x) == F.month(y))
    return (
        F.when(x.isNull() & y.isNull(), 0.5).when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).when(year & month & (F.abs(F.datediff(x, y)) <= 1), 0.95)
        .when(year & swap, 0.90).when(year & month, 0.85).when(year & day, 0.80).when((F.abs(F.year(x) - F.year(y)) <= 1) & month & day, 0.80).when(year, 0.50).otherwise(0.0)
    )


def gender(a: str, b: str) -> Column:
    x, y = F.lower(a), F.lower(b)
    return F.when((x == "unknown") | (y == "unknown"), 0.5).when(x == y, 1.0).otherwise(0.0)


def postal_code(a: str, b: str) -> Column:
    """Hyphens aside: equal 1, five equal first characters 0.95, three 0.70, else 0."""
    x, y = F.replace(F.trim(a), F.lit("-"), F.lit("")), F.replace(F.trim(b), F.lit("-"), F.lit(""))
    first = lambda n: (F.char_length(x) >= n) & (F.char_length(y) >= n) & (F.substring(x, 1, n) == F.substring(y, 1, n))
    return F.when(x == y, 1.0).when(first(5), 0.95).when(first(3), 0.70).otherwise(0.0)


def squeezed(x: Column | str) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(c(x), r"[^\p{L}\p{N}]", ""))


def identifier(a: Column, b: Column) -> Column:
    """Of (type, system, value) structs: 0 for another type or system, 1 if equal, 0.98 but for hyphens and blanks."""
    plain = lambda v: F.regexp_replace(v, "[- ]", "")
    same = (a["type"] == b["type"]) & a["system"].eqNullSafe(b["system"])
    return F.when(~same, 0.0).when(a["value"] == b["value"], 1.0).when(plain(a["value"]) == plain(b["value"]), 0.98).otherwise(0.0)


def best_of(a: str, b: str, score) -> Column:
    """The largest score over all pairs of two arrays; null if either is empty. Only for native scores."""
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: score(x, y)))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def geo_reciprocal(metres: Column, reference_km: float = 1.0) -> Column:
    return 1 / (1 + metres / 1000 / reference_km)


def gaussian(distance: Column, scale: float = 50.0) -> Column:
    """exp(-(d/s)^2); 0 for a missing or negative distance."""
    return F.when(distance >= 0, F.exp(-F.pow(distance / scale, 2))).otherwise(0.0)


def half_life(seconds: Column, half: float = 3600.0) -> Column:
    return F.pow(F.lit(2.0), -F.abs(seconds) / half)


def geo_decay(metres: Column) -> Column:
    return 1 / F.exp(metres / 1000 / 2)


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inside a box; one whose west is beyond its east crosses the antimeridian."""
    x = (lon >= west) | (lon <= east) if west > east else (lon >= west) & (lon <= east)
    return (lat >= south) & (lat <= north) & x


def search_box(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """West, south, east, north around a point; the whole range of longitudes near a pole."""
    import math

    r = math.degrees(metres / EARTH_M)
    south, north = max(-90.0, lat - r), min(90.0, lat + r)
    if south <= -90 or north >= 90:
        return -180.0, south, 180.0, north
    w = math.degrees(math.asin(min(1.0, math.sin(math.radians(r)) / math.cos(math.radians(lat)))))
    wrap = lambda x: (x + 180) % 360 - 180
    return (-180.0, south, 180.0, north) if w >= 180 else (wrap(lon - w), south, wrap(lon + w), north)


def parse_box(text: str) -> tuple[float, float, float, float]:
    """``west,south,east,north`` with its ranges checked."""
    w, s, e, n = (float(x) for x in text.split(","))
    if not (-180 <= w <= 180 and -180 <= e <= 180 and -90 <= s <= n <= 90):
        raise ValueError("a bound is out of range")
    return w, s, e, n


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))


def url(a: str, b: str) -> Column:
    """Scheme aside: equal 1, same host 0.75, else 0."""
    plain = lambda u: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c(u))), "^[a-z][a-z0-9+.-]*://", ""), "/+$", "")
    return F.when(plain(a) == plain(b), 1.0).when((url_host(a) == url_host(b)) & (url_host(a) != ""), 0.75).otherwise(0.0)


def weighted(*parts: tuple[Column, float], renormalize: bool = True) -> Column:
    """Weighted mean of scores. Missing ones leave the mean, or count 0 where ``renormalize`` is false; nothing left gives 0."""
    top = reduce(Column.__add__, [F.coalesce(s, F.lit(0.0)) * w for s, w in parts])
    if not renormalize:
        return top / sum(w for _, w in parts)
    weight = reduce(Column.__add__, [F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts])
    return F.when(weight > 0, top / weight).otherwise(0.0)


def lifted(a: str, b: str, score: Column) -> Column:
    """A score of given names, at least 0.9 for nicknames of each other."""
    return F.when(nickname_class(a) == nickname_class(b), F.greatest(score, F.lit(0.9))).otherwise(score)


def name_part_lists(a: str, b: str) -> Column:
    """Of two arrays of prefixes, or of suffixes: both empty 1, one empty 0.5, else the best Jaro-Winkler of the first elements.

    Lists of one element are what records have; longer ones are scored exploded, with :func:`jaro_winkler` and a maximum.
    """
    x, y = F.coalesce(c(a), F.array()), F.coalesce(c(b), F.array())
    first = jaro_winkler(F.lower(F.coalesce(F.get(x, F.lit(0)), F.lit(""))), F.lower(F.coalesce(F.get(y, F.lit(0)), F.lit(""))))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.5).otherwise(first)


def full_name(family: Column, given: Column, prefix: Column, suffix: Column) -> Column:
    """Half the family name, 0.4 of the given name and a tenth of the mean of prefix and suffix."""
    return 0.5 * family + 0.4 * given + 0.1 * ((prefix + suffix) / 2)


#: Fixed abbreviations of street words, replaced in this order wherever they stand.
STREET_WORDS = [("street", "st"), ("avenue", "ave"), ("road", "rd"), ("drive", "dr"), ("boulevard", "blvd"), ("lane", "ln"), ("court", "ct"), ("circle", "cir")]


def street(x: Column | str) -> Column:
    """Trimmed, lower case, street words abbreviated, without full stops and commas."""
    out = F.lower(F.trim(c(x)))
    for word, short in STREET_WORDS:
        out = F.replace(out, F.lit(word), F.lit(short))
    return F.translate(out, ".,", "")


def exact_or_jaro_winkler(a: Column, b: Column) -> Column:
    """1 if equal but for case, else Jaro-Winkler in lower case; null if either is missing."""
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(jaro_winkler(F.lower(a), F.lower(b)))


def address_fixed(postal: Column, city: Column, state: Column, street_: Column) -> Column:
    """Postal code and street 0.3 each, city and state 0.2 each; a missing part counts 0."""
    return weighted((postal, 0.3), (city, 0.2), (state, 0.2), (street_, 0.3), renormalize=False)


def address_present(postal: Column, locality: Column, street_: Column, region: Column, country: Column) -> Column:
    """0.30, 0.25, 0.25, 0.10 and 0.10 over the parts that both sides have; nothing in common gives 0."""
    return weighted((postal, 0.30), (locality, 0.25), (street_, 0.25), (region, 0.10), (country, 0.10))


def tax_id(a: Column, b: Column) -> Column:
    """1 for equal ASCII letters and digits, case aside, else 0, as for a missing one."""
    plain = lambda x: F.lower(F.regexp_replace(x, "[^0-9A-Za-z]", ""))
    return F.when((plain(a) != "") & (plain(a) == plain(b)), 1.0).otherwise(0.0)


def document(a: Column, b: Column) -> Column:
    """Of (type, number, country) structs: equal type and number 1, with another country 0.95, else 0."""
    plain = lambda x: F.regexp_replace(F.upper(F.trim(x)), "[-. ]", "")
    same = (a["type"] == b["type"]) & (plain(a["number"]) != "") & (plain(a["number"]) == plain(b["number"]))
    return F.when(same & a["country"].eqNullSafe(b["country"]), 1.0).when(same, 0.95).otherwise(0.0)
