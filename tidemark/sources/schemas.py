"""Schemas of the JSON lines that are read and written."""

BINDING = "STRUCT<action_yml_sha:STRING,commit_sha:STRING,first_observed:STRING,last_observed:STRING,observation_count:BIGINT,stable_days:BIGINT,target_sha:STRING,tree_sha:STRING>"
OBSERVATION = """observation_id STRING, repo STRING, observed_at STRING, poller_version STRING, method STRING, refresh_reason STRING,
  outcome STRUCT<type:STRING,http_status:INT,etag:STRING,refs:ARRAY<STRUCT<name:STRING,ref_type:STRING,target_sha:STRING,commit_sha:STRING,tree_sha:STRING,peeled_type:STRING,action_yml_sha:STRING>>,error_class:STRING,backoff_applied:BIGINT,reason:STRING>,
  rate_limit_remaining BIGINT, secondary_limit_observed STRUCT<status:INT,retry_after:BIGINT,request_rate_rpm:BIGINT>, redirect_location STRING, archived BOOLEAN, action_path STRING, scheduled_at STRING, actual_start STRING"""
ENTRY = f"""ancestry STRING, classification STRING, correlation STRUCT<all_to_same_target:BOOLEAN,batch_id:STRING,member_seqs:ARRAY<BIGINT>,note:STRING,refs_moved_together:ARRAY<STRING>>, corrects_seq BIGINT,
  detection_latency_note STRING, diff STRUCT<diff_possibly_truncated:BOOLEAN,files_added:BIGINT,files_modified:BIGINT,files_removed:BIGINT,files_renamed:BIGINT,paths:ARRAY<STRING>>, entry_hash STRING, event STRING, format_version INT,
  `from` {BINDING}, gap_seconds BIGINT, http_status INT, observation_digest STRUCT<date:STRING,failed:BIGINT,files:ARRAY<STRUCT<path:STRING,sha256:STRING>>,not_modified:BIGINT,note:STRING,ok:BIGINT,repos_polled:BIGINT,skipped:BIGINT>,
  observation_window_seconds BIGINT, population_change STRUCT<change:STRING,note:STRING,path:STRING,reason:STRUCT<type:STRING,via:STRING>>, prev_hash STRING, reason STRING, recorded_at STRING, redirect_location STRING, ref STRING, ref_form STRING,
  ref_type_after STRING, ref_type_before STRING, repo STRING, seq BIGINT, severity STRING, source_observations ARRAY<STRING>, `to` {BINDING}"""
HEAD = "head STRUCT<entry_hash:STRING,log_id:STRING,recorded_at:STRING,seq:BIGINT>, key_id STRING, public_key STRING, rekor STRUCT<artifact_hash:STRING,error:STRING,integrated_time:BIGINT,log_id:STRING,log_index:BIGINT,uuid:STRING>, signature STRING"
WATCHED = "repo STRING, path STRING, added_at STRING, reason STRUCT<type:STRING,source:STRUCT<type:STRING,org:STRING,name:STRING>,via_repo:STRING,via_path:STRING,via_commit:STRING>, active BOOLEAN, note STRING"
OBJECT = "sha STRING, kind STRING, commit_sha STRING, tree_sha STRING, action_yml_sha STRING, action_yml_known BOOLEAN"
COMPARED = "old_sha STRING, new_sha STRING, result STRUCT<ancestry:STRING,files_added:BIGINT,files_removed:BIGINT,files_modified:BIGINT,files_renamed:BIGINT,paths:ARRAY<STRING>,diff_possibly_truncated:BOOLEAN>"
ACTION = "kind STRING, pattern STRING, tag STRING, `from` STRING, `to` STRING, performed_at STRING, corrects_performed_at STRING, correction_kind STRING, reason STRING"
SAMPLE = "mode STRING, ramp_rpm INT, timestamp STRING, repo STRING, status INT, retry_after STRING, etag STRING, latency_ms BIGINT"
