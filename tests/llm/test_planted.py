"""Planted personal data and clean numbers, written without the operator's patterns."""

from palisade.llm import pii_surrogates as ps

NAMES = [
    "Mr J. Smith", "Mrs O'Brien", "Mr McDonald", "Mr John McDonald", "Mr John Ronald Tolkien", "Dr Smith-Jones", "Herr Ludwig von Beethoven",
    "Prof. A. B. de la Cruz", "Ms SMITH", "Mr J. R. R. Tolkien",
]
PHONES = [
    "+14155552671", "4155552671", "030 1234567", "(030) 1234567", "+49 30 12345678", "+33 6 12345678", "(415) 555-2671", "415-555-2671",
    "06 12 34 56 78", "1-800-555-1234", "030/1234567", "+49 30 1234 5678", "+49 (0)30 1234567", "555-1234",
]
CLEAN = [
    "2024-01-15", "12.05.2023", "05.12.2023", "10 20 30 40", "1990-1995", "20240115", "100 200 300", "1990 1991 1992", "3.1415926535", "1,000,000",
    "page 12 of 345", "2024-01-15 10:30", "10.5 and 20.25",
]


def test_planted(spark):
    rows = [(i, f"so {v} said, and more") for i, v in enumerate([*NAMES, *PHONES, *CLEAN])]
    out = {r.doc_id: (r.text, r.n_entities) for r in ps.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    wrong = []
    for i, text in rows:
        new, n = out[i]
        value, put = text[3:-15], new[3:-15]
        if value in CLEAN:
            good = new == text and n == 0
        else:
            good = n == 1 and new.startswith("so ") and new.endswith(" said, and more") and put != value
            if value in PHONES:
                good = good and ["9" if c.isdigit() else c for c in put] == ["9" if c.isdigit() else c for c in value]
            else:
                parts = [w for w in value.split()[1:] if w[0].isupper() and len(w) > 2]
                good = good and put.split()[0] == value.split()[0] and len(put.split()) == len(value.split()) and not any(w in put.split() for w in parts)
        if not good:
            wrong.append((text, new, n))
    assert not wrong


def test_possessive_is_the_same_surname(spark):
    docs = spark.createDataFrame([(1, "Mr Smith's car, Mr Smith")], "doc_id long, text string")
    new = ps.replace(docs, "k").first().text
    assert new.split("'s car, ")[0] == new.split("'s car, ")[1]
