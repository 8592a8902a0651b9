"""Tool runs replayed: what became of every call that a run asked for, with which arguments, and how the run ended.

A run is what a model asked for, in order: rows of (run, principal, at, step from 1, place within the step, tool, args as a
map of texts, result, error, decided). A row without a tool is the model's answer. `error` is "timeout" or "failed", where
the tool gave nothing; `decided` is what was said about a call that writes: true, false, or null while nobody has spoken.

The rules: steps after MAX_STEPS aren't taken. Every call counts, until MAX_CALLS did; the calls after these get the budget's
answer. A tool that isn't there and arguments that the rails block end the call, not the run. A writing call waits for a decision,
which ends the replay if there is none; with one, the rest of its step is dropped, and the run goes on with the next step.
Only then a call runs, and its result is judged before anyone reads it.

(run, step, place) is unique, and rows with a null in it are left out. A null map or result is an empty one. An empty table
gives an empty table. Other columns pass through; names that begin with two underscores are ours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import pii, rails, vault

MAX_STEPS, MAX_CALLS = 6, 10
#: Tools by name: whether they write, and which arguments they may see unmasked.
Tools = dict[str, tuple[bool, tuple[str, ...]]]
RAN = ("done", "withheld", "timed_out", "failed")
BLOCKED = ("unknown", "refused", "declined", "withheld")
_KEY = "struct<step:int,place:int>"


def of_arguments(text: Column) -> Column:
    """The verdict on what a model composed: words, identifiers and rules."""
    return rails.fold(
        F.when(F.size(rails.blocked_terms(text)) > 0, "mask").otherwise("pass"), F.when(F.size(pii.detect(text)) > 0, "mask").otherwise("pass"),
        rails.rule_verdict(text, (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)),
    )


def of_results(text: Column) -> Column:
    """The verdict on what a tool gave back: as for arguments, and no instruction may stand in it."""
    return rails.fold(of_arguments(text), F.when(rails.injection_score(text) >= rails.INJECTION_THRESHOLD, "block").otherwise("pass"))


def _among(tool: Column, names: list[str]) -> Column:
    return F.coalesce(tool.isin(names), F.lit(False))


def screened(asks: DataFrame, tools: Tools, arguments: Callable[[Column], Column] = of_arguments, results: Callable[[Column], Column] = of_results) -> DataFrame:
    """`asks` with args_verdict, result_verdict, and __gate: the call is one that has to wait for a person."""
    given = F.coalesce(F.to_json("args"), F.lit("{}"))
    back = F.when(F.col("error").isNull(), results(F.coalesce("result", F.lit("")))).otherwise("pass")
    out = asks.where("run is not null and step is not null and place is not null").withColumn("args_verdict", arguments(given)).withColumn("result_verdict", back)
    gate = _among(F.col("tool"), [n for n, (writes, _) in tools.items() if writes]) & (F.col("args_verdict") != "block")
    return out.withColumn("__gate", gate)


def _folded(rows: Column, most: int) -> Column:
    """The state after `rows` (step, place, answer, gate, decided) in order: calls used, the last one that counted, gates that were reached, where it ended and how."""
    none = F.lit(None)
    start = F.struct(
        F.lit(0).alias("used"), none.cast(_KEY).alias("last"), F.expr(f"cast(array() as array<{_KEY}>)").alias("gates"), none.cast(_KEY).alias("stop"), none.cast("string").alias("status"),
    )

    def put(s: Column, **new: Column) -> Column:
        return F.struct(*(new.get(n, s[n]).alias(n) for n in ("used", "last", "gates", "stop", "status")))

    def step(s: Column, x: Column) -> Column:
        at = F.struct(x["step"].alias("step"), x["place"].alias("place"))
        counted = dict(used=s["used"] + 1, last=at)
        gated = counted | {"gates": F.concat(s["gates"], F.array(at))}
        dropped = F.exists(s["gates"], lambda g: g["step"] == x["step"])
        return (
            F.when(s["stop"].isNotNull(), s).when(x["answer"], put(s, stop=at, status=F.lit("answered"))).when(dropped | (s["used"] >= most), s)
            .when(x["gate"] & x["decided"].isNull(), put(s, **gated, stop=at, status=F.lit("awaiting"))).when(x["gate"], put(s, **gated)).otherwise(put(s, **counted))
        )

    return F.aggregate(rows, start, step)


def ended(screened_: DataFrame, max_steps: int = MAX_STEPS, max_calls: int = MAX_CALLS) -> DataFrame:
    """(run, used, last, gates, stop, status) of every run: answered, awaiting, out_of_steps, or open where the rows end before.

    What decides are the first `max_calls` + 1 rows of each of the first steps, since a step's calls count from its front. These are
    taken before the shuffle, so a run of any length reaches its task as some dozens of rows, in one array."""
    front = Window.partitionBy("run", "step").orderBy("place")
    head = screened_.where((F.col("step") >= 1) & (F.col("step") <= max_steps)).withColumn("__n", F.row_number().over(front)).where(F.col("__n") <= max_calls + 1)
    row = F.struct(F.col("step").cast("int").alias("step"), F.col("place").cast("int").alias("place"), F.col("tool").isNull().alias("answer"), F.col("__gate").alias("gate"), F.col("decided").alias("decided"))
    # an answer far behind in its step has to be seen as well
    answers = screened_.where((F.col("step") >= 1) & (F.col("step") <= max_steps) & F.col("tool").isNull()).groupBy("run", "step").agg(F.min("place").alias("place"))
    answer = F.struct(F.col("step").cast("int").alias("step"), F.col("place").cast("int").alias("place"), F.lit(True).alias("answer"), F.lit(False).alias("gate"), F.lit(None).cast("boolean").alias("decided"))
    beyond = screened_.groupBy("run").agg(F.max("step").alias("most"))
    folded = head.select("run", row.alias("r")).unionByName(answers.select("run", answer.alias("r"))).groupBy("run").agg(_folded(F.array_sort(F.collect_set("r")), max_calls).alias("f"))
    status = F.coalesce("f.status", F.when(F.col("most") > max_steps, "out_of_steps").otherwise("open"))
    return beyond.join(folded, "run", "left").select("run", F.coalesce("f.used", F.lit(0)).alias("used"), "f.last", "f.gates", "f.stop", status.alias("status"))


def replayed(screened_: DataFrame, tools: Tools, max_steps: int = MAX_STEPS, max_calls: int = MAX_CALLS) -> DataFrame:
    """Every row with `outcome` and `verdict` (null where nothing was decided), and its run's `status`.

    Outcomes: done, withheld, timed_out, failed, unknown, refused, declined, awaiting, budget, skipped, unreached, answer."""
    run = ended(screened_, max_steps, max_calls).select("run", *(F.col(c).alias(f"__{c}") for c in ("used", "last", "gates", "stop")), "status")
    at = F.struct(F.col("step").cast("int").alias("step"), F.col("place").cast("int").alias("place"))
    dropped = F.exists("__gates", lambda g: (g["step"] == F.col("step")) & (g["place"] < F.col("place")))
    outcome = (
        F.when((F.col("step") > max_steps) | (F.col("step") < 1) | (at > F.col("__stop")), "unreached").when(F.col("tool").isNull(), "answer").when(dropped, "skipped")
        .when((F.col("__used") >= max_calls) & (F.lit(max_calls < 1) | (at > F.col("__last"))), "budget").when(~_among(F.col("tool"), list(tools)), "unknown").when(F.col("args_verdict") == "block", "refused")
        .when(F.col("__gate") & F.col("decided").isNull(), "awaiting").when(F.col("__gate") & ~F.col("decided"), "declined")
        .when(F.col("error") == "timeout", "timed_out").when(F.col("error").isNotNull(), "failed").when(F.col("result_verdict") == "block", "withheld").otherwise("done")
    )
    verdict = F.when(F.col("outcome").isin(*BLOCKED), "block").when(F.col("outcome").isin(*RAN), rails.fold(F.col("args_verdict"), F.col("result_verdict")))
    out = screened_.join(run, "run").withColumn("outcome", outcome).withColumn("verdict", verdict)
    return out.drop("__gate", "__used", "__last", "__gates", "__stop")


def resolved(calls: DataFrame, held: DataFrame, tools: Tools, secret: str, ttl_s: int) -> DataFrame:
    """`calls` that ran, with `seen`, the arguments as their tool saw them, and `unmasked`, how many of them changed.

    A token gives way to its value where the tool is entitled to the argument and the run's principal owns the token, in time;
    every other argument stays as the model wrote it. Only entitled arguments with a token in them meet the vault."""
    entitled = F.lit(False)
    for name, (_, own) in tools.items():
        entitled = entitled | ((F.col("tool") == name) & F.col("name").isin(*own)) if own else entitled
    ran = calls.where(F.col("outcome").isin(*RAN))
    each = ran.select("run", "step", "place", "tool", "principal", "at", F.explode("args").alias("name", "masked")).where(entitled & F.col("masked").rlike(vault.TOKEN))
    reads = each.select(F.struct("run", "step", "place", "name").alias("read_id"), "principal", "at", "masked")
    shown = vault.revealed(reads, vault.asked(reads, held, secret, ttl_s)).select("read_id.*", "shown", (F.col("shown") != F.col("masked")).alias("new"))
    by = shown.groupBy("run", "step", "place").agg(F.map_from_entries(F.collect_list(F.struct("name", "shown"))).alias("__seen"), F.count_if("new").alias("unmasked"))
    out = ran.join(by, ["run", "step", "place"], "left").withColumn("seen", F.transform_values("args", lambda k, v: F.coalesce(F.col("__seen")[k], v)))
    return out.drop("__seen").fillna(0, ["unmasked"])


def summed(calls: DataFrame) -> DataFrame:
    """(run, status, calls, ran, verdict) by run: the strictest verdict of its calls counts."""
    counted = ~F.col("outcome").isin("unreached", "skipped", "budget", "answer")
    return calls.groupBy("run", "status").agg(
        F.count_if(counted).alias("calls"), F.count_if(F.col("outcome").isin(*RAN)).alias("ran"), rails.verdict_of(F.coalesce(F.max(rails.rank(F.col("verdict"))), F.lit(0))).alias("verdict"),
    )
