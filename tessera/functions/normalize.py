"""Normal forms, format checks and check digits as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.similarity import c


def nfkd_name(name: Column | str) -> Column:
    """NFKD without combining marks and ASCII punctuation, lower case, blanks collapsed."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x) and not (x.isascii() and not x.isalnum() and not x.isspace()))
        return s.map(lambda t: None if t is None else " ".join(plain(t).lower().split()))

    return run(c(name))


def nfkc_fold(text: Column | str) -> Column:
    """Trimmed, NFKC, lower case."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.strip()).lower())

    return run(c(text))


#: Fixed words that say only a company's legal form.
LEGAL_WORDS = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "gmbh", "ag", "sa", "sas", "sasu", "srl",
    "spa", "bv", "nv", "oy", "ab", "as", "pty", "pte", "kk", "kg", "ohg", "ug", "sl", "sarl", "eurl", "the", "and", "&",
]


def legal_name(folded: Column | str) -> Column:
    """Words of a folded name without legal forms, unless nothing would be left."""
    words = F.filter(F.split(F.regexp_replace(c(folded), r"[.,]", " "), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(LEGAL_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def domain(url: Column | str) -> Column:
    """Host without user, port, trailing dot and ``www.``."""
    host = F.regexp_extract(F.lower(F.trim(c(url))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def clean_url(url: Column | str) -> Column:
    """Without fragment and bare final slash, scheme and host in lower case."""
    u = F.regexp_replace(F.trim(c(url)), "#.*$", "")
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    out = F.concat(F.lower(head), F.substring(u, F.char_length(head) + 1, F.char_length(u)))
    return F.regexp_replace(out, r"^([a-z][a-z0-9+.-]*://[^/?]*)/$", "$1")


def course_code(text: Column | str) -> Column:
    return F.upper(F.regexp_replace(c(text), r"\s+", ""))


def case_number(text: Column | str) -> Column:
    return F.upper(F.regexp_replace(c(text), r"[^A-Za-z0-9]", ""))


def phone(text: Column | str, country: str = "1") -> Column:
    """Plus and digits: ten digits and more that begin with the country's code stay, others but those behind a plus get it; empty without digits."""
    digits = F.regexp_replace(c(text), "[^0-9]", "")
    n = F.char_length(digits)
    whole = ((n >= 10) & digits.startswith(country)) | ((n != 10) & c(text).startswith("+"))
    return F.when(digits == "", "").when(whole, F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit(f"+{country}"), digits))


#: Fixed abbreviations of street types, written out in this order; letter case counts.
STREET_TYPES = [("St.", "Street"), ("St ", "Street "), ("Ave.", "Avenue"), ("Ave ", "Avenue "), ("Rd.", "Road"), ("Rd ", "Road "), ("Dr.", "Drive"), ("Blvd.", "Boulevard"), ("Ln.", "Lane"), ("Ct.", "Court")]


def street_line(text: Column | str) -> Column:
    """Trimmed, with street types written out."""
    out = F.trim(c(text))
    for short, word in STREET_TYPES:
        out = F.replace(out, F.lit(short), F.lit(word))
    return out


def title_case(text: Column | str) -> Column:
    """Words with a first capital, parted by single blanks."""
    return F.initcap(F.regexp_replace(F.trim(c(text)), r"\s+", " "))


def fold_set(texts: Column) -> Column:
    """Distinct folded texts in order."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else sorted({unicodedata.normalize("NFKC", t.strip()).lower() for t in a if t is not None}))

    return run(texts)


def unix_seconds(text: Column | str) -> Column:
    """Seconds since 1970 of an ISO 8601 time, in UTC unless it names a zone; null if malformed."""
    t = c(text)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))))), F.lit(None).cast("long"))


#: Fixed patterns of the format checks.
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "doi": r"^10\.\d{4,9}/\S+$", "bcp47": r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$", "icd10": r"^[A-Z]\d[0-9A-Z](\.[0-9A-Z]{1,4})?$",
    "url": r"^https?://[^\s/]+\S*$", "date": r"^\d{4}-\d{2}-\d{2}$", "time": r"^([01]\d|2[0-3]):[0-5]\d$", "country": r"^[A-Z]{2}$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
}


def well_formed(kind: str, text: Column | str) -> Column:
    """Whether a text has the form; a date must also exist."""
    ok = c(text).rlike(FORMATS[kind])
    return ok & F.try_to_timestamp(c(text), F.lit("yyyy-MM-dd")).isNotNull() if kind == "date" else ok


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda d: d.cast("int"))


def _weighted(text: Column, weight) -> Column:
    """Sum of digit times weight(position from 0)."""
    return F.aggregate(F.transform(_digits(text), lambda d, i: d * weight(i)), F.lit(0), lambda a, x: a + x)


def gs1(text: Column | str, *lengths: int) -> Column:
    """Mod-10 check digit with weights 3 and 1 from the right (GTIN, GLN)."""
    t = c(text)
    n = F.char_length(t)
    total = _weighted(t, lambda i: F.when((n - i) % 2 == 0, 3).otherwise(1))
    return F.when(t.rlike(r"^\d+$") & n.isin(list(lengths or (8, 12, 13, 14))), total % 10 == 0).otherwise(False)


def nhs_number(text: Column | str) -> Column:
    """Ten digits, blanks aside, with the mod-11 check digit (weights 10 to 2)."""
    t = F.regexp_replace(c(text), "[ -]", "")
    rest = 11 - _weighted(F.substring(t, 1, 9), lambda i: 10 - i) % 11
    check = F.when(rest == 11, 0).otherwise(rest)
    return F.when(t.rlike(r"^\d{10}$"), check == F.substring(t, 10, 1).cast("int")).otherwise(False)


def isbn10(text: Column | str) -> Column:
    t = F.upper(F.regexp_replace(c(text), "[ -]", ""))
    last = F.when(F.substring(t, 10, 1) == "X", 10).otherwise(F.substring(t, 10, 1).try_cast("int"))
    return F.when(t.rlike(r"^\d{9}[\dX]$"), (_weighted(F.substring(t, 1, 9), lambda i: 10 - i) + last) % 11 == 0).otherwise(False)


def issn(text: Column | str) -> Column:
    t = F.upper(F.regexp_replace(c(text), "-", ""))
    last = F.when(F.substring(t, 8, 1) == "X", 10).otherwise(F.substring(t, 8, 1).try_cast("int"))
    return F.when(t.rlike(r"^\d{7}[\dX]$"), (_weighted(F.substring(t, 1, 7), lambda i: 8 - i) + last) % 11 == 0).otherwise(False)


def lei(text: Column | str) -> Column:
    """Twenty characters, ISO 7064 mod 97-10: letters as 10 to 35, the remainder 1."""
    t = F.upper(F.trim(c(text)))
    value = F.transform(F.split(t, ""), lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55))
    rest = F.aggregate(value, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.when(t.rlike("^[0-9A-Z]{18}[0-9]{2}$"), rest == 1).otherwise(False)


def verhoeff(text: Column | str) -> Column:
    """The dihedral check over D5 (SNOMED CT); its tables follow from the group and one permutation."""
    times = [[(a + b) % 5 if a < 5 and b < 5 else (a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    step, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    table = lambda t: F.array(*[F.array(*map(F.lit, r)) for r in t])
    product, place = table(times), table(rows)
    back = F.reverse(_digits(c(text)))
    moved = F.transform(back, lambda d, i: F.get(F.get(place, i % 8), d))
    return F.when(c(text).rlike(r"^\d+$"), F.aggregate(moved, F.lit(0), lambda a, x: F.get(F.get(product, a), x)) == 0).otherwise(False)


def validate(df, rules: dict[str, Column], into: str = "errors"):
    """``df`` with the names of all rules that fail (a null test counts as passed)."""
    return df.withColumn(into, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])))
