"""Schemas of the workflow model's tables, and its constraints as queries for rows that break them.

Spark keeps no constraints, so a rule is a query: violations() gives one row a rule with the number of rows against it.
Ids are text; times are in UTC.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and columns of the model that queries use; secrets and widgets' columns are left out.
SCHEMAS = {
    "project": "id string, name string, mnemonic string, description string, is_archived boolean, next_number int, created_at timestamp",
    "dead_mnemonic": "mnemonic string",
    "user": "id string, name string, user_type string, is_chat_bot boolean, is_service boolean, created_at timestamp",
    "task_type": "id string, key string, label string, is_builtin boolean",
    "app_setting": "key string, value string, description string, updated_at timestamp",
    "session": "id string, user_id string, expires_at timestamp, created_at timestamp",
    "alias_column": "id string, label string, color string, position int",
    "flow_version": "id string, task_type_id string, version int, is_current boolean, is_published boolean, created_by string, created_at timestamp",
    "flow_status": "id string, flow_version_id string, status_key string, label string, checklist_gate string, is_entry boolean, is_terminal boolean, is_blocking boolean, alias_column_id string, kind string, position int, behaviors array<string>",
    "flow_transition": "id string, flow_version_id string, from_status string, to_status string, runner string, cond_checklist boolean, cond_links boolean, cond_artifact boolean, rule_code string, when array<string>",
    "flow_preset": "id string, name string, description string, is_builtin boolean, definition string, updated_at timestamp",
    "task": "id string, project_id string, code string, task_type_id string, title string, description_md string, status_key string, flow_version_id string, priority string, story_id string, author_id string, created_at timestamp, updated_at timestamp, reserved_by string, reserved_at timestamp, heartbeat_at timestamp, retry_count int, m4_count int, blocked_reason string, blocked_rule string, ref_version int, ref_hash string, runs_reset_at timestamp",
    "checklist": "id string, task_id string, kind string, source_ref_version int, manager_review_version int, manager_review_state string, created_at timestamp",
    "checklist_item": "id string, checklist_id string, position int, kind string, level int, text string, status string, psi_expected string, psi_actual string, bug_task_id string, linked_task_id string, carried_from_version int",
    "task_relation": "id string, from_task string, to_task string, kind string, created_at timestamp",
    "tag": "id string, label string, is_author boolean",
    "task_tag": "task_id string, tag_id string",
    "task_assignee": "task_id string, user_id string",
    "task_comment": "id string, task_id string, author_id string, body string, created_at timestamp",
    "task_artifact": "id string, task_id string, kind string, version int, body_md string, created_by string, created_at timestamp",
    "task_branch": "id string, task_id string, branch_name string, created_at timestamp, merged_at timestamp, head_commit string, merge_commit string, diff_stats string",
    "task_run": "id string, task_id string, agent_id string, status_key string, attempt_no int, started_at timestamp, heartbeat_at timestamp, finished_at timestamp, outcome string, detail string, reason_code string, input_tokens long, output_tokens long, cache_tokens long, session_id string",
    "task_run_log": "id string, run_id string, seq int, kind string, text string, data string, created_at timestamp",
    "chronicle_payload": "id string, body string, expires_at timestamp",
    "chronicle": "id string, task_id string, event_type string, author_id string, author_kind string, rule_code string, message string, payload_id string, created_at timestamp",
    "psi_document": "id string, story_id string, version int, author_id string, created_at timestamp",
    "psi_run": "id string, psi_doc_id string, run_by string, passed int, failed int, ran_at timestamp",
    "psi_run_item": "id string, psi_run_id string, item_id string, position int, item_text string, expected string, status string, actual string",
    "notification": "id string, code string, recipient_id string, event_key string, message string, tech_detail string, resolved_at timestamp, created_at timestamp",
    "settings_journal": "id string, who_id string, entity string, summary string, diff array<struct<field:string,old:string,new:string>>, created_at timestamp",
    "chat_message": "id string, user_id string, role string, body string, task_code string, created_at timestamp",
    "pending_intent": "user_id string, payload string, created_at timestamp, expires_at timestamp",
    "tool_artifact": "id string, kind string, name string, rel_path string, description string, content_hash string, size_bytes int, updated_at timestamp",
    "agent_profile": "user_id string, role string, connection_id string, is_preset boolean, preset_source string, model string, allowed_tools array<string>, mcp_servers map<string,string>, agent_dir string, skills array<string>",
    "assignment": "id string, task_type_id string, status_key string, user_id string, mode string, position int",
    "connection": "id string, name string, protocol string, url string, model string, token_tail string, check_status string, is_active boolean, created_at timestamp",
    "provider_preset": "id string, name string, protocol string, base_url string, is_builtin boolean",
}

#: Fixed values: (rule, table, what must hold; null passes, as for a CHECK).
CHECKS = [
    ("project_name_length", "project", "length(name) between 1 and 64"),
    ("project_mnemonic_form", "project", "mnemonic rlike '^[A-Z0-9]{2,10}$'"),
    ("user_type_known", "user", "user_type in ('human', 'agent')"),
    ("status_gate_known", "flow_status", "checklist_gate in ('developer', 'reviewer', 'tester')"),
    ("status_key_form", "flow_status", "status_key rlike '^[a-z0-9_]+$'"),
    ("transition_runner_known", "flow_transition", "runner in ('human', 'agent', 'auto', 'auto_or_agent')"),
    ("task_title_length", "task", "length(title) between 1 and 64"),
    ("task_description_length", "task", "length(description_md) <= 150000"),
    ("task_priority_known", "task", "priority in ('low', 'medium', 'high', 'critical')"),
    ("task_not_its_own_story", "task", "id <> story_id"),
    ("item_kind_known", "checklist_item", "kind in ('heading', 'item')"),
    ("item_level_range", "checklist_item", "level between 1 and 5"),
    ("item_status_known", "checklist_item", "kind = 'heading' or status in ('todo', 'in_progress', 'closed', 'done', 'failed')"),
    ("relation_not_to_itself", "task_relation", "from_task <> to_task"),
    ("relation_kind_known", "task_relation", "kind in ('do_after', 'blocked_by')"),
    ("event_type_known", "chronicle", "event_type in ('field', 'transition', 'force', 'agent', 'denied', 'psi', 'bug')"),
    ("auto_event_has_rule", "chronicle", "author_kind <> 'auto' or rule_code is not null"),
    ("run_item_status_known", "psi_run_item", "status in ('todo', 'done', 'failed')"),
    ("run_outcome_known", "task_run", "outcome in ('success', 'failed', 'blocked', 'interrupted')"),
    ("assignment_mode_known", "assignment", "mode in ('parallel', 'replacement')"),
    ("connection_status_known", "connection", "check_status in ('active', 'checked', 'unchecked', 'error')"),
]

#: Fixed values: (rule, table, columns, among which rows) for what must be unique.
UNIQUE = [
    ("one_mnemonic", "project", ["mnemonic"], "true"),
    ("one_code", "task", ["code"], "true"),
    ("one_current_version", "flow_version", ["task_type_id"], "is_current"),
    ("one_status_key", "flow_status", ["flow_version_id", "status_key"], "true"),
    ("one_edge", "flow_transition", ["flow_version_id", "from_status", "to_status"], "true"),
    ("one_checklist_kind", "checklist", ["task_id", "kind"], "true"),
    ("one_relation", "task_relation", ["from_task", "to_task", "kind"], "true"),
    ("one_artifact_version", "task_artifact", ["task_id", "kind", "version"], "true"),
    ("one_active_run", "task_run", ["task_id", "agent_id"], "finished_at is null"),
    ("one_open_notification", "notification", ["code", "event_key"], "resolved_at is null"),
    ("one_active_connection", "connection", ["is_active"], "is_active"),
    ("one_assignment", "assignment", ["task_type_id", "status_key", "user_id"], "true"),
    ("one_tool", "tool_artifact", ["kind", "name"], "true"),
]


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the model from Parquet, with its schema stated."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """rule and n for every rule over the given tables. All checks of a table are one pass over it."""
    parts = []
    for name, df in tables.items():
        checks = [(rule, must) for rule, table, must in CHECKS if table == name]
        if checks:
            counts = df.agg(*(F.count_if(~F.expr(must)).alias(rule) for rule, must in checks))
            parts.append(counts.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule, _ in checks))).alias("x")).select("x.*"))
        for rule, table, columns, among in UNIQUE:
            if table == name:
                several = df.filter(among).dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("k"))
                parts.append(several.agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts)
