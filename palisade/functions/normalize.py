"""Normalisation of text before anything is matched against it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alike letters and the Latin ones they fold to.
LOOKALIKES = (
    "аеорсхуіѕјАВЕКМНОРСТХ"
    "αονρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "ıłøǀ⁄"
)
FOLDED = "aeopcxyisjABEKMHOPCTX" + "aovptuABEZHIKMNOPTYX" + "ilol/"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
#: Runs of blanks, and single ones other than a space, which is what they become.
BLANKS = r"[ \t\x{00A0}\x{2000}-\x{200A}\x{3000}]{2,}|[\t\x{00A0}\x{2000}-\x{200A}\x{3000}]"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, LOOKALIKES, FOLDED)


def collapse_blanks(text: Column) -> Column:
    return F.when(text.contains("  ") | text.contains("\t") | ~_ascii(text), F.regexp_replace(text, BLANKS, " ")).otherwise(text)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def compose(text: Column | str) -> Column:
    """Compatibility composition (NFKC), for which the JVM functions have no counterpart; plain ASCII stays as it is and isn't sent to Python."""
    text = F.col(text) if isinstance(text, str) else text
    other = _nfkc(F.when(~_ascii(text), text))
    return F.when(_ascii(text), text).otherwise(other)


def normalize(text: Column) -> Column:
    """All steps that need no Python; `compose` comes before them where text may hold compatibility forms. What is folded or stripped isn't ASCII."""
    return collapse_blanks(F.when(_ascii(text), text).otherwise(fold_lookalikes(strip_invisible(text))))


def change_count(before: Column, after: Column) -> Column:
    """Places that differ, and the difference in length."""
    shared = F.least(F.length(before), F.length(after))
    differ = F.zip_with(F.slice(F.split(before, ""), 1, shared), F.slice(F.split(after, ""), 1, shared), lambda a, b: (a != b).cast("long"))
    return F.aggregate(differ, F.lit(0).cast("long"), lambda s, x: s + x) + F.abs(F.length(before) - F.length(after))
