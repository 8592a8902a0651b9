"""Checks of identifiers, as expressions; every one is false for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, rotations 0-4, reflections 5-9."""
    turn, flip = (a % 5 + (b % 5 if a < 5 else -(b % 5))) % 5, (a >= 5) != (b >= 5)
    return turn + 5 * flip


def verhoeff(value: Column) -> Column:
    """Twelve digits, the first from 2 on, with a right check digit."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([base[x] for x in rows[-1]])
    moves = F.array(*[F.lit(x) for r in rows for x in r])
    product = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    d = F.reverse(digits(value))
    steps = F.transform(F.split(d, ""), lambda c, i: F.get(moves, (i % 8) * 10 + c.cast("int")))
    check = F.aggregate(steps, F.lit(0), lambda c, x: F.get(product, c * 10 + x))
    return F.coalesce(F.when(digits(value).rlike("^[2-9][0-9]{11}$"), check == 0), F.lit(False))


def iban(value: Column) -> Column:
    v = F.upper(F.regexp_replace(value, "[ -]", ""))
    turned = F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))
    number = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int")))
    rest = F.aggregate(number, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))
    return F.coalesce(F.when(v.rlike("^[A-Z0-9]{15,34}$"), rest == 1), F.lit(False))


def ssn(value: Column) -> Column:
    return F.coalesce(digits(value).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"), F.lit(False))


def pan(value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Z]{3}[ABCFGHLJPTK][A-Z][0-9]{4}[A-Z]$"), F.lit(False))
