"""Secret scans: plain patterns, and multipart credentials linked within a scope.

Plain spans (`assign`, `access`, `hex`) always count. Other parts are weak by themselves:
`weak_id` (a long upper-case identifier, or a login or client id being assigned),
`weak_secret` (a mixed string of 20+ characters, or a short value assigned to a secret's
keyword) and `endpoint` (an address with a scheme). All parts of a text become rows with
an interval widened by `SCOPE` characters; interval joins on (text, bucket) keep a weak part
only when its complement is in scope:
- a weak_id beside a plain secret, a weak_secret beside an access identifier;
- a weak_id and a weak_secret beside each other and an endpoint;
- an endpoint beside an identifier and a secret, weak or plain.
Offsets are code points, ends exclusive; weak spans that touch a plain one are left out.

Null texts are empty: no spans. Rows with equal texts have equal spans: parts are kept
once per text, by its md5, so a text copied many times is linked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import Staged, read

SCOPE, BUCKET, STRETCH = 200, 512, 64
OUT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: The plain patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"""(?<![A-Za-z0-9])(?:[A-Z](?=[A-Z]*[0-9])[A-Z0-9]{15,}(?![A-Za-z0-9])|(?i:user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,})"""
WEAK_SECRET = r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"""
ENDPOINT = r"(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/@%-]+"

_SPAN = "struct<start:int,stop:int>"


def _spans(text: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, stop, m), from the lengths of matches and of what is between.
    The walk goes over stretches of `STRETCH` matches, so that lists are copied in pieces."""
    none = "cast(array() as array<struct<start:int,stop:int,m:string>>)"
    found, between = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STRETCH).cast("int")), lambda i: F.slice(zipped, i * STRETCH + 1, STRETCH))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
        F.array_append(a["out"], F.struct((a["at"] + F.length(x["b"])).alias("start"), (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("stop"), x["m"].alias("m"))).alias("out"),
    )
    inner = lambda a, part: F.aggregate(part, F.struct(a["at"].alias("at"), F.expr(none).alias("out")), step)
    outer = lambda a, done: F.struct(done["at"].alias("at"), F.array_append(a["out"], done["out"]).alias("out"))
    walked = F.aggregate(
        stretches, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,stop:int,m:string>>>)").alias("out")),
        lambda a, part: outer(a, inner(a, part)), lambda a: F.flatten(a["out"]),
    )
    return F.when(F.col(text).rlike(pattern), walked).otherwise(F.expr(none))


def _typed(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """`docs` without its text, with the columns `OUT`, which replace those of the same names."""
    keep = [c for c in docs.columns if c not in ("text", *OUT)]
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    long_value = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 12
    rows = rows.select(
        "row", "t", _spans("t", ASSIGN).alias("assigned"), _spans("t", ACCESS).alias("access"), _spans("t", HEX).alias("hex"),
        _spans("t", WEAK_ID).alias("weak_id"), _spans("t", WEAK_SECRET).alias("weak_secret"), _spans("t", ENDPOINT).alias("endpoint"),
    )
    rows = rows.withColumn("assign", F.filter("assigned", long_value)).withColumn("weak_secret", F.concat("weak_secret", F.filter("assigned", lambda s: ~long_value(s))))
    rows = rows.select("row", "t", *(_typed(F.col(k), i).alias(k) for i, k in enumerate(KINDS)))
    rows = rows.withColumn("base", F.concat(*KINDS[:3])).withColumn("weak", F.concat(*KINDS[3:]))
    open_ = (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1)
    staged = Staged(
        rows.select("row", "base", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.when(open_, F.col("weak")).alias("weak"), F.when(open_, F.md5("t")).alias("key")), "secret-parts"
    ).df

    parts = staged.where("key is not null").select("key", F.explode(F.concat("base", "weak")).alias("p")).select("key", "p.kind", "p.start", "p.stop").distinct()
    parts = Staged(_apart(Staged(parts, "all-parts").df), "parts").df
    linked = _linked(parts).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("extra"))
    plain = staged.where("key is null").withColumn("extra", F.expr("cast(null as array<struct<start:int,kind:int,stop:int>>)"))
    out = plain.unionByName(staged.where("key is not null").join(linked, "key", "left"))
    extra = F.coalesce("extra", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)"))
    return out.select(
        "row.*", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_linked"),
    )


def _apart(parts: DataFrame) -> DataFrame:
    """`parts` without the weak ones that touch a plain one."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("stop") / BUCKET)))
    plain, weak = parts.where("kind < 3"), parts.where("kind >= 3")
    near = plain.select(F.col("key").alias("k2"), F.col("start").alias("start2"), F.col("stop").alias("stop2"), cells.alias("cell2"))
    touch = weak.withColumn("cell", cells).join(near, (F.col("key") == F.col("k2")) & (F.col("cell") == F.col("cell2")) & (F.col("start2") < F.col("stop")) & (F.col("stop2") > F.col("start")), "left_semi")
    return plain.unionByName(weak.join(touch.select(*weak.columns).distinct(), weak.columns, "left_anti"))


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts (key, kind, start, stop) whose complements are in scope."""
    cell = lambda a: F.floor(a / BUCKET)
    wide = parts.select(
        F.col("key").alias("k2"), F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("stop").alias("stop2"),
        F.explode(F.sequence(cell(F.col("start") - SCOPE), cell(F.col("stop") + SCOPE))).alias("cell2"),
    )
    kind = {k: i for i, k in enumerate(KINDS)}

    def beside(rows: DataFrame, *kinds: str) -> DataFrame:
        near = wide.where(F.col("kind2").isin([kind[k] for k in kinds]))
        cells = rows.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))))
        on = (F.col("key") == F.col("k2")) & (F.col("cell") == F.col("cell2")) & (F.col("start2") <= F.col("stop") + SCOPE) & (F.col("stop2") >= F.col("start") - SCOPE)
        return cells.join(near, on, "left_semi").drop("cell").distinct()

    ids, secrets, ends = (parts.where(F.col("kind") == kind[k]) for k in ("weak_id", "weak_secret", "endpoint"))
    near_end = (beside(beside(ids, "weak_secret"), "endpoint"), beside(beside(secrets, "weak_id"), "endpoint"))
    found = [beside(ids, "assign", "hex"), beside(secrets, "access"), *near_end, beside(beside(ends, "access", "weak_id"), "assign", "hex", "weak_secret")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
