"""Table functions by argument, and JSON of unlike shapes."""

import json
import random
from collections import Counter

from tideline.operators import calls, variants
from tideline.sources.adapter import table

SF = "/root/testdata/sf0.001"


def test_a_call_for_each_row_is_one_plan_in_the_jvm(spark):
    calls.register(spark, *(table(spark, SF, n) for n in ("card", "item", "relation")))
    codes = spark.createDataFrame([("tk-1",), ("nothing",), (None,), ("' or true --",)], "code string")
    out = spark.sql("select a.code as asked, c.* from {codes} a, lateral task_card(a.code) c", codes=codes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "LateralJoin" not in plan  # it has become a join
    assert {r.asked for r in out.collect()} <= {"tk-1"}
    one = spark.sql("select * from tasks_search(3, 'ORDER', cast(null as string))")
    assert one.count() == table(spark, SF, "task").filter("project_id = 3").count()
    levels = Counter(r.level for r in spark.sql("select * from story_tree(7)").collect())
    assert levels[0] == 1 and levels[1] == table(spark, SF, "task").filter("story_id = 7").count() and levels[2] == levels[1] - 1


def test_shapes_of_generated_json(spark):
    rnd = random.Random(5)

    def value(depth=0):
        kind = rnd.randrange(7 if depth < 3 else 5)
        if kind < 5:
            return [None, True, 1.5, 12, "x"][kind]
        return [value(depth + 1) for _ in range(rnd.randrange(3))] if kind == 5 else {k: value(depth + 1) for k in rnd.sample(["a", "b c", "d.e"], rnd.randrange(4))}

    def kind_of(v):
        return "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "number"

    want, texts = Counter(), []
    for _ in range(300):
        root = value()
        texts.append(json.dumps(root))
        level = [("$", root)]
        for _ in range(3):
            want.update((path, kind_of(v)) for path, v in level)
            level = [(f"{p}.{k}", x) for p, v in level if isinstance(v, dict) for k, x in v.items()] + [(f"{p}[]", x) for p, v in level if isinstance(v, list) for x in v]
    texts += ["{", "", "nul", None]
    want["$", "malformed"] += 3
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, k int")
    got = {(r.path, r.kind): r.n for r in variants.shapes(df, "t", ["k"]).collect()}
    assert got == dict(want)
