"""Reversible tokens: values leave the text for a table of sealed entries, and come back only for their owner, in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import spans

TOKEN = r"<([A-Z_0-9]+):([0-9a-f]{12})(?:\s[^>]*)?>"


def token_of(*parts: Column) -> Column:
    """Twelve hex digits from what is unique to an occurrence; without parts, random ones (write the table before it is read twice)."""
    return F.substring(F.sha2(F.concat_ws("|", *parts) if parts else F.uuid(), 256), 1, 12)


def tokenized(rows: DataFrame, key: str, owner: str, found: Column, text: str = "text") -> DataFrame:
    """`rows` with `marked`, an array of (kind, value, token) in order, and `masked`, the text with <KIND:token> in their places."""
    put = lambda s: F.concat(F.lit("<"), s["kind"], F.lit(":"), token_of(F.col(key).cast("string"), F.col(owner).cast("string"), s["start"].cast("string"), s["value"]), F.lit(">"))
    marked = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), token_of(F.col(key).cast("string"), F.col(owner).cast("string"), s["start"].cast("string"), s["value"]).alias("token")))
    return rows.withColumn("marked", marked).withColumn("masked", spans.splice(F.col(text), found, put))


def sealed(tokenized_: DataFrame, owner: str, created: str, secret: str) -> DataFrame:
    """The vault: token, owner, kind, created and the value, encrypted with its owner bound to it."""
    each = tokenized_.select(F.col(owner).cast("string").alias("owner"), F.col(created).alias("created"), F.explode("marked").alias("m"))
    blob = F.aes_encrypt(F.col("m.value"), F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.col("owner"))
    return each.select(F.col("m.token").alias("token"), "owner", F.col("m.kind").alias("kind"), "created", blob.alias("blob"))


def asked(reads: DataFrame, vault: DataFrame, secret: str, ttl_s: int, text: str = "masked") -> DataFrame:
    """(read_id, i, token, value, denied) of every token in `reads` (read_id, principal, at, text): the value, or why not."""
    tokens = reads.select("read_id", "principal", "at", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(2))).alias("i", "token"))
    held = tokens.join(vault, "token", "left")
    value = F.try_aes_decrypt(F.col("blob"), F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"), F.col("principal").cast("string")).cast("string")
    age = F.unix_timestamp("at") - F.unix_timestamp("created")
    denied = (
        F.when(F.col("blob").isNull(), "unknown").when((F.lit(ttl_s) > 0) & (age > ttl_s), "expired")
        .when(F.col("owner") != F.col("principal").cast("string"), "owner_mismatch").when(value.isNull(), "tampered")
    )
    return held.select("read_id", "i", "token", F.when(denied.isNull(), value).alias("value"), denied.alias("denied"))


def revealed(reads: DataFrame, answers: DataFrame, text: str = "masked") -> DataFrame:
    """`reads` with `shown`: each token replaced by its value where that was allowed, else as it is."""
    by = answers.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("i", "value")))["value"].alias("v"))
    found = spans.find(F.col(text), TOKEN, "token")
    out = reads.join(by, "read_id", "left")
    placed = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), F.coalesce(F.get("v", i), s["value"]).alias("value"), s["ord"].alias("ord")))
    return out.withColumn("shown", spans.splice(F.col(text), placed, lambda s: s["value"])).drop("v")


def resolved(reads: DataFrame, vault: DataFrame, secret: str, ttl_s: int, resolution: Column, text: str = "masked") -> DataFrame:
    """`reads` with `shown` and `n_revealed`. Where resolution is never, no token is looked up and the text stays as it is;
    else owner and age decide as in `asked`."""
    answers = asked(reads.where(F.coalesce(resolution, F.lit("owner_only")) != "never"), vault, secret, ttl_s, text)
    n = answers.groupBy("read_id").agg(F.count("value").alias("n_revealed"))
    return revealed(reads, answers, text).join(n, "read_id", "left").fillna(0, ["n_revealed"])
