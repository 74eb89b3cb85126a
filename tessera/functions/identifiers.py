"""Checks of national personal identifiers, by scheme: a documented subset. Each takes the digits as a text and gives true or false."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.normalize import nhs_number

Check = Callable[[Column], Column]


def digit(t: Column, i: int) -> Column:
    """The digit at a place, from 1."""
    return F.substring(t, i, 1).try_cast("int")


def total(t: Column, weights: list[int]) -> Column:
    """Sum of the first digits times their weights."""
    return reduce(Column.__add__, [digit(t, i + 1) * w for i, w in enumerate(weights)])


def all_digits(n: int, check: Check) -> Check:
    return lambda t: F.when(t.rlike(rf"^[0-9]{{{n}}}$"), check(t)).otherwise(False)


def luhn(n: int) -> Check:
    def check(t: Column) -> Column:
        own = [F.when(2 * digit(t, i) > 9, 2 * digit(t, i) - 9).otherwise(2 * digit(t, i)) if (n - i) % 2 else digit(t, i) for i in range(1, n + 1)]
        return reduce(Column.__add__, own) % 10 == 0

    return check


def modulo_11(weights: list[int], at: int, below_two: bool = False) -> Check:
    """The digit ``at`` is the remainder, a remainder of 10 giving 0; or, with ``below_two``, 0 for one below two and else 11 less it."""

    def check(t: Column) -> Column:
        rest = total(t, weights) % 11
        return (F.when(rest < 2, 0).otherwise(11 - rest) if below_two else rest % 10) == digit(t, at)

    return check


def cascade(t: Column) -> Column:
    """Two passes: the second one's weights where the first leaves 10."""
    first, second = total(t, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1]) % 11, total(t, [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]) % 11
    return F.when(first < 10, first).otherwise(second % 10) == digit(t, 11)


def _ssn(t: Column) -> Column:
    return ~F.substring(t, 1, 3).isin("000", "666") & (F.substring(t, 1, 1) != "9") & (F.substring(t, 4, 2) != "00") & (F.substring(t, 6, 4) != "0000")


def _belgian(t: Column) -> Column:
    n, check = F.substring(t, 1, 9).try_cast("long"), F.substring(t, 10, 2).try_cast("int")
    return (97 - n % 97 == check) | (97 - (n + 2_000_000_000) % 97 == check)


def _brazilian(t: Column) -> Column:
    first, second = modulo_11([10, 9, 8, 7, 6, 5, 4, 3, 2], 10, True), modulo_11([11, 10, 9, 8, 7, 6, 5, 4, 3, 2], 11, True)
    return first(t) & second(t) & (F.replace(t, F.substring(t, 1, 1), F.lit("")) != "")


#: Scheme: number of digits and check; weights are fixed by the schemes.
NUMERIC: dict[str, tuple[int, Check]] = {
    "nhs": (10, nhs_number),
    "us_ssn": (9, all_digits(9, _ssn)),
    "nl_bsn": (9, all_digits(9, lambda t: (total(t, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0) & (t != "000000000"))),
    "se_personnummer": (10, all_digits(10, luhn(10))),
    "bg_egn": (10, all_digits(10, modulo_11([2, 4, 8, 5, 10, 9, 7, 3, 6], 10))),
    "cz_rc": (10, all_digits(10, lambda t: t.try_cast("long") % 11 == 0)),
    "ee_ik": (11, all_digits(11, cascade)),
    "lt_ak": (11, all_digits(11, cascade)),
    "pl_pesel": (11, all_digits(11, lambda t: (10 - total(t, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == digit(t, 11))),
    "pl_nip": (10, all_digits(10, lambda t: total(t, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == digit(t, 10))),
    "pt_nif": (9, all_digits(9, modulo_11([9, 8, 7, 6, 5, 4, 3, 2], 9, True))),
    "jp_my_number": (12, all_digits(12, modulo_11([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2], 12, True))),
    "lv_pk": (11, all_digits(11, lambda t: (1101 - total(t, [1, 6, 3, 7, 9, 10, 5, 8, 4, 2])) % 11 % 10 == digit(t, 11))),
    "be_nn": (11, all_digits(11, _belgian)),
    "br_cpf": (11, all_digits(11, _brazilian)),
    "dk_cpr": (10, all_digits(10, lambda t: F.lit(True))),
}


def spanish(text: Column) -> Column:
    """DNI or NIE: eight digits, or X, Y, Z for a first 0, 1, 2 and seven, then the letter of the number modulo 23."""
    t = F.upper(F.regexp_replace(text, "[- ]", ""))
    n = F.translate(F.substring(t, 1, 8), "XYZ", "012").try_cast("int")
    letter = F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), n % 23 + 1, F.lit(1))
    return F.when(t.rlike("^[0-9XYZ][0-9]{7}[A-Z]$"), letter == F.substring(t, 9, 1)).otherwise(False)


def french(text: Column) -> Column:
    """NIR: thirteen digits, 2A and 2B counting as 19 and 18 in the department, and 97 less their remainder modulo 97."""
    t = F.upper(F.regexp_replace(text, "[- ]", ""))
    n = F.replace(F.replace(F.substring(t, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18")).try_cast("long")
    return F.when(t.rlike("^[0-9]{5}([0-9]{2}|2A|2B)[0-9]{8}$"), 97 - n % 97 == F.substring(t, 14, 2).try_cast("int")).otherwise(False)


def finnish(text: Column) -> Column:
    """HETU: day, month, year, century sign, three digits and the character of the nine digits modulo 31."""
    t = F.upper(F.trim(text))
    n = F.concat(F.substring(t, 1, 6), F.substring(t, 8, 3)).try_cast("long")
    letter = F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (n % 31 + 1).cast("int"), F.lit(1))
    return F.when(t.rlike("^[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Y]$"), letter == F.substring(t, 11, 1)).otherwise(False)
