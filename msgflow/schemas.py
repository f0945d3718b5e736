"""Schemas of the records the engine stores and streams, as Spark writes them in text: they need no session."""

MESSAGE = "id string, room bigint, author string, content string, at_ns bigint, at_ts timestamp, toxicity_score double"
PAYLOAD_DDL = "struct<text:struct<content:string>,audio:struct<transcription:string,duration_sec:double>,file:struct<filename:string,mime_type:string,size:bigint,content:string,author:string,page_count:int>>"
ANALYSIS = f"id string, entity_id string, namespace string, at_ns bigint, at_ts timestamp, summary string, tags array<string>, scores map<string,double>, payload_type string, payload {PAYLOAD_DDL}, version string"
FILE_REQUEST = "path string, drive_id string, size bigint, attributes int, mime_type string, magic_bytes binary, scanned_at timestamp, source_type string"
TASK = "id string, drive_id string, path string, raw_mime_type string, effective_mime_type string, size bigint, priority int, created_at_ns bigint, retry_count int, state string"
USER = "id string, email string, password_hash string, roles array<string>, created_at bigint"
NODE_STATUS = "node_id string, node_type string, pid bigint, pid_status string, cpu_percent double, ram_bytes bigint, queue_size bigint, max_capacity bigint, reported_at timestamp"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
CHUNK = "file_id string, seq int, kind string, data binary, sha256 string"
