"""Schemas of the log and of the state tables, and the names of event types and statuses."""

from __future__ import annotations

LOG = "stream_id string, seq bigint, event_type string, idempotency_key string, payload string, timestamp_ms bigint"
RETENTION = "stream_id string, trim_before bigint"
TASK_EVENTS = "task_id string, seq bigint, event_type string, epoch bigint, worker_id string, result string, error string"
WORKFLOW_EVENTS = "workflow_id string, seq bigint, event_type string, step_id string, task_id string, attempt int, result string, error string, timestamp_ms bigint"
ACTOR_EVENTS = "actor_id string, seq bigint, event_type string, worker_id string, epoch bigint, command_seq bigint, command_count bigint, state string, snapshot_count bigint"
# Names that logs hold.
TASK_EVENT_TYPES = ("TaskSubmitted", "TaskStarted", "TaskRedelivered", "TaskCompleted", "TaskFailed")
WORKFLOW_EVENT_TYPES = ("WorkflowStarted", "StepScheduled", "StepStarted", "StepSucceeded", "StepFailed", "WorkflowCompleted", "WorkflowFailed")
ACTOR_EVENT_TYPES = ("ActorCreated", "ActorOwnershipGranted", "ActorCommandSubmitted", "ActorCommandApplied", "ActorCommandFailed", "ActorSnapshotCreated")
TERMINAL = ("SUCCEEDED", "FAILED")
KINDS = {"task": "task", "wf": "workflow", "actor": "actor", "llm": "llm"}
