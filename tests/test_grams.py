"""Substring joins against ``in``."""

import random

from tintype.operators import grams, pairing


def test_least_name_that_holds_a_fragment(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé_.%\\") for _ in range(n))
    names = [word(rng.randrange(1, 14)) for _ in range(400)]
    asked = ["", "a", "%", "_", "é", "aa", "zz", "zzzzz", *(n[i : i + m] for n in names[:150] for i, m in [(rng.randrange(len(n)), rng.randrange(1, 9))]), *(word(5) for _ in range(60))]
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    found = grams.least_containing(df([*asked, None, asked[9]], "fragment"), df([*names, None, names[0]], "name"))
    got = {r.fragment: r.name for r in found.collect()}
    assert got == {a: min(n for n in names if a in n) for a in set(asked) if any(a in n for n in names)} and found.count() == len(got)
    assert grams.least_containing(df(asked, "fragment"), df([], "name")).count() == 0
    plan = grams.least_containing(df([x for x in asked if x], "fragment"), df(names, "name"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") <= 1  # only for the empty fragment, against one row


def test_matches_inside_names_and_names_without_mark(spark):
    names = ["met_12_portrait_77_v2.jpg", "met_12_portrait_7.jpg", "europ_9_old_door.png", "other_portrait_7.jpg", "met_a.jpg"]
    asked = {"x_dmg_portrait_7.png": "met_12_portrait_7.jpg", "x_dmg_old_door.jpg": "europ_9_old_door.png", "rait_77.png": "met_12_portrait_77_v2.jpg", "x_dmg_t_7_dmg_z.png": "met_12_portrait_7.jpg", "nothing.png": None, "x_dmg_.png": "europ_9_old_door.png"}
    df = lambda rows: spark.createDataFrame([(x,) for x in rows], "filename string")
    assert {r.damaged: r.reference for r in pairing.match_reference(df(asked), df(names)).collect()} == asked
    assert {r.reference for r in pairing.match_reference(df(["x_dmg_door.jpg"]), df(names), extension=True).collect()} == {None}
    assert {r.reference for r in pairing.match_reference(df(["x_dmg_door.png"]), df(names), extension=True).collect()} == {"europ_9_old_door.png"}


def test_no_side_that_grows_is_broadcast(spark):
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    names = df([f"met_{i % 7}_{i}.jpg" for i in range(300)], "filename")
    plan = pairing.match_reference(df(["x_dmg_29.png", "x_dmg_299.png", "x_dmg_.png"], "filename"), names)
    done = plan.collect()
    assert {r.damaged: r.reference for r in done} == {"x_dmg_29.png": min(f"met_{i % 7}_{i}.jpg" for i in range(300) if "29" in f"met_{i % 7}_{i}"), "x_dmg_299.png": "met_5_299.jpg", "x_dmg_.png": "met_0_0.jpg"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text  # the one row of sizes meets the names in a nested loop
