from tideline.sources import schemas


def test_every_schema_parses_and_every_rule_fits(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in schemas.SCHEMAS.items()}
    assert len(tables) == 37
    got = {r.rule: r.n for r in schemas.violations(tables).collect()}
    assert set(got) == {r[0] for r in schemas.CHECKS} | {r[0] for r in schemas.UNIQUE} and not any(got.values())


def test_violations(spark):
    project = spark.createDataFrame([("1", "x", "AB"), ("2", "", "ab"), ("3", None, None), ("4", "y", "AB")], "id string, name string, mnemonic string")
    runs = spark.createDataFrame([("t", "a", None, "odd"), ("t", "a", None, None), ("t", "b", None, "success")], "task_id string, agent_id string, finished_at timestamp, outcome string")
    got = {r.rule: r.n for r in schemas.violations({"project": project, "task_run": runs}).collect()}
    assert got == {"project_name_length": 1, "project_mnemonic_form": 1, "one_mnemonic": 1, "run_outcome_known": 1, "one_active_run": 1}
