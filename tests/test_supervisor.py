"""A supervisor's replayed rounds against a plain walk over all small plans, and over requests at every limit."""

import itertools

from palisade.operators import supervisor

LEVELS = ("pass", "flag", "mask", "block")
PLANS = "request string, round int, agents array<string>, more boolean, at_s double, text string"
RESULTS = "request string, agent string, action string"
SAID = "request string, action string, confidence double, at_s double"
ACTS = {"a": "mask", "b": "escalate", "c": "pass"}


def walked(rounds, acts, said, max_rounds, max_calls, agents):
    """(made, agents that ran, status, action) of one request, whose `rounds` are (agents, more, at_s)."""
    made, ran, status = 0, [], None
    for n in range(max_rounds):
        if n >= len(rounds):
            return made, ran, "no_plan", "escalate"
        names, more, at = rounds[n]
        if at > 45:
            return made, ran, "late", "escalate"
        if not names:
            return made, ran, "none", "pass"
        if made >= max_calls:
            return made, ran, "budget", "escalate"
        taken = 0
        for a in dict.fromkeys(names):
            if taken + made == max_calls:
                status = "budget"
                break
            if a not in agents:
                status = status or "unregistered"
            taken += 1
            ran += [a] if a not in ran else []
        made += taken
        if status:
            return made, ran, status, None if status == "unregistered" else "escalate"
        if not more:
            break
    else:
        return made, ran, "rounds", "escalate"
    if said and said[2] is not None and said[2] > 45:
        return made, ran, "late", "escalate"
    got = [acts.get(a, "escalate") for a in ran]
    floor = max([LEVELS.index(x) for x in got if x != "escalate"], default=0)
    if len(ran) == 1:
        wanted = got[0]
    elif not said or said[0] not in (*LEVELS, "escalate") or said[1] is None or not 0 <= said[1] <= 1:
        return made, ran, "malformed", "escalate"
    else:
        wanted = said[0]
    if wanted == "escalate":
        return made, ran, "decided", LEVELS[floor] if floor else wanted
    return made, ran, "decided", LEVELS[max(floor, LEVELS.index(wanted))]


def compare(spark, cases, max_rounds, max_calls, agents):
    plans = [(f"r{i}", n + 1, *r, "clash") for i, (rounds, _, _) in enumerate(cases) for n, r in enumerate(rounds)]
    results = [(f"r{i}", a, x) for i, (_, acts, _) in enumerate(cases) for a, x in acts.items()]
    said = [(f"r{i}", *s) for i, (_, _, s) in enumerate(cases) if s]
    out = supervisor.decided(spark.createDataFrame(plans, PLANS).repartition(4), spark.createDataFrame(results, RESULTS), spark.createDataFrame(said, SAID), max_rounds, max_calls, 45.0, agents)
    got = {r["request"]: r for r in out.collect()}
    for i, (rounds, acts, s) in enumerate(cases):
        if rounds:
            made, ran, status, action = walked(rounds, acts, s, max_rounds, max_calls, agents)
            g = got[f"r{i}"]
            if status == "unregistered":
                assert (g["status"], g["action"]) == (status, None)
            else:
                assert (g["made"], g["ran"], g["status"], g["action"]) == (made, ran, status, action), (rounds, acts, s)
    assert len(got) == sum(1 for c in cases if c[0])


def test_all_small_plans(spark):
    lists = [list(p) for n in range(4) for p in itertools.product("ab", repeat=n)]
    one = [((p, more, 1.0),) for p in lists for more in (False, True)]
    two = [x + y for x in one for y in one]
    three = [x + y for x in [t for t in two if t[0][1] and t[1][1]] for y in one[::3]]
    for most in (1, 2, 3, 4):
        compare(spark, [(r, ACTS, ("flag", 0.5, 2.0)) for r in one + two + three], 3, most, ("a", "b", "c"))


def test_ends(spark):
    plan = ((["a", "b"], False, 1.0),)
    said = [None, ("flag", 0.5, 2.0), ("escalate", 1.0, 2.0), ("unheard", 0.5, 2.0), ("block", 1.2, 2.0), ("block", -0.1, None), ("block", None, 1.0), ("pass", 0.0, 45.0), ("pass", 0.0, 45.5), (None, 0.5, 1.0)]
    acts = [{}, {"a": "pass", "b": "escalate"}, {"a": "escalate", "b": "escalate"}, {"a": "mask"}, {"a": "block", "b": "flag"}]
    cases = [(p, a, s) for p in (plan, ((["a"], False, 1.0),), ((["a", "gone"], False, 1.0),), (([], True, 1.0),), ((None, None, 1.0),), ((["a"], None, 1.0),), ((["a"], False, 46.0),)) for a in acts for s in said]
    compare(spark, cases, 3, 6, ("a", "b", "c"))


def test_nulls_and_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (PLANS, RESULTS, SAID)]
    assert supervisor.decided(*none).count() == 0
    rows = spark.createDataFrame([(None, 1, ["pii"], False, 1.0, ""), ("a", None, ["pii"], False, 1.0, ""), ("b", 1, ["pii"], False, None, ""), ("c", 2, ["pii"], False, 1.0, "")], PLANS)
    out = {r["request"]: (r["status"], r["action"]) for r in supervisor.decided(rows, *none[1:]).collect()}
    assert out == {"b": ("decided", "escalate"), "c": ("no_plan", "escalate")}
