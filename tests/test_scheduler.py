"""The scheduler answers for each pair of a task and an agent, not for their numbers."""

import __spark_entry__ as entry
from tideline.plans import decisions
from tideline.sources.adapter import table

SF = "/root/testdata/sf0.01"


def test_every_pair_has_its_answer(spark):
    """A parallel team's agents each have a row, and what is counted by task and answer is what the tasks' own counts say."""
    rows = entry.queries()["scheduler_decisions"](spark, SF).cache()
    assert rows.columns == ["task_id", "agent_id", "run_mode", "decision"] and "agent_id" in entry.oracle_sql()["scheduler_decisions"].rsplit("select p.", 1)[1].split("case")[0]
    tasks = {r.task_id: r for r in decisions._candidates(spark, SF)[0].collect()}
    agents = {}
    for r in decisions._staff(spark, SF).collect():
        agents.setdefault((r.type_key, r.status_key), set()).add(r.agent_id)
    got, answers = {}, {}
    for r in rows.collect():
        got.setdefault(r.task_id, []).append(r.agent_id)
        answers.setdefault(r.task_id, []).append(r.decision)
    assert got.keys() == tasks.keys() and max(map(len, got.values())) > 1
    for t, r in tasks.items():
        team = agents.get((r.type_key, r.status_key), {None})
        assert len(got[t]) == len(team) and set(got[t]) == team
        if not r.reserved and None not in team:
            assert [answers[t].count(k) for k in ("running", "retry_pause", "provider_paused")] == [r.n_running, r.n_pause, r.n_paused] and answers[t].count(r.rest) == r.n_free
    assert table(spark, SF, "task").count() > len(tasks)
