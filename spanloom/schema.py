"""Column names and types of the tables that the library's operators share."""

from __future__ import annotations

#: One row an event of a session log; seq orders a session's events.
EVENTS = """session_id string, seq bigint, event_id string, ts timestamp, kind string, name string, call_id string, model string,
output_tokens bigint, mode string, success boolean, error_message string,
tool_requests array<struct<call_id string, arguments string>>,
model_metrics map<string, struct<input bigint, output bigint, cache_read bigint, cache_write bigint>>, loaded_tools array<string>"""

SESSIONS = "session_id string, agent string, agent_version string, producer string, started_at timestamp, cwd string, repository string, branch string, file_path string"
WARNINGS = "file_path string, line_no bigint, kind string, error string"
STORED_SESSIONS = "id string, agent string, dominant_model string, started_at bigint, duration_ms bigint, raw_path string, raw_mtime bigint, total_input_tokens bigint, total_output_tokens bigint, total_cache_read bigint, total_cache_creation bigint, ingested_at bigint"

#: Wire type of an event -> kind; the fixed tag list of the session log format.
KINDS = {
    "session.start": "session_start", "session.info": "session_info", "session.mode_changed": "mode_changed", "session.model_change": "model_change", "session.plan_changed": "plan_changed", "session.warning": "session_warning",
    "session.resume": "session_resume", "session.compaction_start": "compaction_start", "session.compaction_complete": "compaction_complete", "session.shutdown": "session_shutdown", "user.message": "user_message",
    "assistant.turn_start": "turn_start", "assistant.turn_end": "turn_end", "assistant.message": "assistant_message", "system.message": "system_message", "system.notification": "system_notification",
    "tool.execution_start": "tool_start", "tool.execution_complete": "tool_complete", "tool.user_requested": "tool_user_requested", "hook.start": "hook_start", "hook.end": "hook_end", "skill.invoked": "skill_invoked", "abort": "abort",
    "permission.requested": "permission_requested", "permission.completed": "permission_completed", "subagent.started": "subagent_started", "subagent.completed": "subagent_completed", "subagent.failed": "subagent_failed",
}

#: Fields under data that a line of a type must have, else it becomes a parse warning.
REQUIRED = {
    "session.start": ["sessionId", "version", "producer", "copilotVersion", "startTime", "context.cwd", "alreadyInUse"], "session.info": ["infoType", "message"], "session.mode_changed": ["previousMode", "newMode"],
    "session.model_change": ["newModel"], "session.plan_changed": ["operation"], "session.shutdown": ["shutdownType", "codeChanges"], "user.message": ["content", "interactionId"], "assistant.turn_start": ["turnId"], "assistant.turn_end": ["turnId"],
    "assistant.message": ["messageId", "model", "content", "interactionId", "outputTokens"], "system.message": ["role", "content"], "system.notification": ["content", "kind"], "tool.execution_start": ["toolCallId", "toolName", "arguments"],
    "tool.execution_complete": ["toolCallId", "success"], "tool.user_requested": ["toolCallId", "toolName", "arguments.command", "arguments.description"], "hook.start": ["hookInvocationId", "hookType", "input.sessionId", "input.timestamp", "input.cwd"],
    "hook.end": ["hookInvocationId", "hookType", "success"], "skill.invoked": ["name", "path", "content", "source", "description", "trigger"], "abort": ["reason"], "permission.completed": ["result.kind"], "subagent.failed": ["error"],
}
