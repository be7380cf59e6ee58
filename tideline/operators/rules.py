"""Rules as data: named predicates, mirroring edges, and decisions by the first rule that denies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions by name over the columns of facts; null facts never satisfy one.
PREDICATES: dict[str, Callable[[], Column]] = {}


def predicate(name: str):
    """Registers a condition; an unknown name in a flow is an error, not a condition that never holds."""

    def keep(f: Callable[[], Column]) -> Callable[[], Column]:
        PREDICATES[name] = f
        return f

    return keep


predicate("children_any_active")(lambda: F.col("any_active"))
predicate("children_all_closed")(lambda: (F.col("n") > 0) & F.col("all_closed"))
predicate("children_all_blocked")(lambda: (F.col("n") > 0) & F.col("all_blocked"))
predicate("blocked_by_children")(lambda: F.col("blocked_rule") == "M5")
predicate("psi_plan_registered_current")(lambda: F.col("plan_ref") >= F.coalesce("ref_version", F.lit(1)))
predicate("psi_manager_approved")(lambda: (F.col("manager_state") == "approved") & F.col("manager_current"))
predicate("psi_manager_rejected")(lambda: F.col("manager_state") == "rejected")


def satisfied(names: Column) -> Column:
    """All named predicates hold. Facts become one map, so a flow's conditions stay data."""
    facts = F.create_map(*(x for name, f in PREDICATES.items() for x in (F.lit(name), F.coalesce(f(), F.lit(False)))))
    return F.forall(names, lambda w: F.coalesce(F.element_at(facts, w), F.raise_error(F.concat(F.lit("unknown predicate "), w)).cast("boolean")))


def mirrored(facts: DataFrame, edges: DataFrame, keep: list[str], status: str = "status_key") -> DataFrame:
    """keep, target and rule: of the edges from a row's status whose conditions hold, the first by position; else null."""
    open_edges = facts.join(F.broadcast(edges), F.col("at") == F.col(status)).filter(satisfied(F.col("when")))  # a flow's edges: dozens
    first = open_edges.groupBy(*keep).agg(F.min_by(F.struct("target", "rule"), "position").alias("edge"))
    return facts.select(*keep).join(first, keep, "left").select(*keep, "edge.target", "edge.rule")


# The order of stages, by which a move is forward; statuses that count as work; ways out that no gate holds;
# the report that a status has to leave behind.
STAGES = {"pending": 0, "backlog": 1, "todo": 2, "in_progress": 3, "review_ready": 4, "in_review": 4, "qa_ready": 5, "in_testing": 5, "done": 6}
ACTIVE = ("in_progress", "in_review", "in_testing")
ESCAPES = ("blocked", "canceled")
REPORTS = {"in_progress": "dev_report", "in_review": "review_report", "in_testing": "qa_report"}


def stage(c: str) -> Column:
    return reduce(lambda w, x: w.when(F.col(c) == x[0], x[1]), STAGES.items(), F.when(F.lit(False), -1)).otherwise(0)


def _gate(state: str) -> tuple[Column, Column, Column]:
    """Of a checklist's state (struct of total, open, failed; null where there is none): not created, open, failed."""
    total, still, failed = (F.coalesce(F.col(f"{state}.{x}"), F.lit(0)) for x in ("total", "open", "failed"))
    return total == 0, still > 0, failed > 0


def decided(asked: DataFrame) -> Column:
    """The code of the first rule that denies a move, or ok.

    asked has, per row: current, target; target_known (the flow has the target), runner (of the edge; null without one),
    cond_links, cond_checklist, cond_artifact; subject (agent, auto, human), assigned, current_terminal; blocked,
    plan_stale, psi_failed; source_gate and target_gate (the checklists' kinds), source_state and target_state (struct of
    total, open, failed) and has_report. Rights come first, then links, plan, acceptance, checklists, and the report.
    """
    agent, runner = F.col("subject") == "agent", F.col("runner")
    gated = F.col("cond_checklist") & ~F.col("target").isin(*ESCAPES)
    forward = gated & (stage("target") > stage("current")) & F.col("source_gate").isNotNull()
    entry = gated & (runner != "auto") & F.col("target_gate").isNotNull()
    none, still, failed = _gate("source_state")
    none_there = _gate("target_state")[0]
    rules = [
        (runner.isNull() & ~F.col("target_known"), "no_status"),
        (runner.isNull(), "no_edge"),
        ((F.col("subject") == "auto") & ~runner.isin("auto", "auto_or_agent"), "runner_auto"),
        (agent & ~F.col("assigned"), "agent_not_assigned"),
        (agent & ~runner.isin("agent", "auto_or_agent"), "runner_agent"),
        (agent & (F.col("target") == "canceled"), "agent_cancel"),
        (agent & F.coalesce("current_terminal", F.lit(False)), "agent_terminal"),
        (F.col("cond_links") & F.col("target").isin(*ACTIVE) & F.col("blocked"), "links_blocked"),
        ((F.col("target") == "done") & F.col("plan_stale"), "plan_stale"),
        ((F.col("target") == "done") & (F.col("psi_failed") > 0), "psi_failed"),
        (forward & none, "checklist_not_created"),
        (forward & still, "checklist_not_closed"),
        (forward & failed, "checklist_failed"),
        (entry & (F.col("target") == "in_progress") & none_there, "checklist_not_created"),
        (entry & (F.col("target") == "in_review") & (stage("target") > stage("current")) & none_there, "checklist_not_created"),
        (F.col("cond_artifact") & F.col("current").isin(*REPORTS) & ~F.col("has_report"), "artifact_missing"),
    ]
    return F.coalesce(*(F.when(c, F.lit(k)) for c, k in rules), F.lit("ok"))
