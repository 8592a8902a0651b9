"""What is cheaper to look for than a pattern is in every text that the pattern matches, and verdicts are those of the patterns alone."""

import re

from pyspark.sql import functions as F

from palisade.functions import rails
from palisade.functions.normalize import compose, normalize

PATTERNS = [rails.parse_rule(r)[0] for r in (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)] + [p for _, _, p in rails.INJECTION]
TEXTS = (
    "PASSWORD : x", "Api-Key=1", "apikey=1", "use PK-ABCDEFGH12345678", "ghp_" + "a" * 20, "akia" + "B" * 16, "begin rsa private KEY", "BEGIN PRIVATE KEY", "bearer " + "x" * 20, "Drop the Database", "truncate table",
    "delete FROM x", "delete every files", "delete all the licences", "rm  -rf", "wipe the index", "Ignore earlier\ninstruction", "disregard any training", "display the initial rules", "You are\tnow in", "god mode", "a DAN", "dance", "pretend to be",
    "pretend that you", "</INST>", "<instruction>", "[ End  of prompt ]", "[inst]", "plain é İ K ſ", "passworD=İ", "", None,
)


def test_needed():
    assert rails.needed(r"(?:ab)?c[de]+fg|HIJ") == [{"fg", "hij"}]
    assert rails.needed(r"a*|b") == [] and rails.needed("") == [] and rails.needed("(?<!foo)é1ab") == [{"1ab"}]
    for p in PATTERNS:
        assert rails.needed(p)
        for t in filter(None, TEXTS):
            if re.search(p, t, re.I | re.A):
                assert all(any(s in t.lower() for s in some) for some in rails.needed(p))


def test_as_the_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    t = F.col("text")
    rules = (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)
    plain = F.greatest(*(F.when(t.rlike(f"(?i){p}"), s).otherwise(0.0) for _, s, p in rails.INJECTION))
    any_ = F.coalesce(F.greatest(*(t.rlike(f"(?i){rails.parse_rule(r)[0]}") for r in rules)), F.lit(False))
    for r in rows.select("text", plain.alias("a"), rails.injection_score(t).alias("b"), any_.alias("c"), (rails.rule_verdict(t, rules) == "block").alias("d"), rails.injection_technique(t).alias("e")).collect():
        assert r.a == r.b and r.c == r.d
        best = [k for k, s, p in rails.INJECTION if s == r.a and re.search(p, r.text or "", re.I | re.A)]
        assert r.e == (best[0] if best else None)


def test_blanks(spark):
    rows = ["a b", "a  b", "a\tb", " \t a", "a b", "é 　  b", "ﬁ​x", "аb", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", normalize(compose("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == ["a b", "a b", "a b", " a", "a b", "é b", "fix", "ab", None]
