"""Schemas of the usage logs.

Fixed values: column names, types and order follow the account usage logs of the platform.
Ids, bytes, counts and milliseconds are ``bigint``, credits are decimals (nine digits is the
finest the logs carry), times are wall-clock UTC.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

QUERY_HISTORY = """
query_id string, query_text string, database_id bigint, database_name string,
schema_id bigint, schema_name string, query_type string, session_id bigint,
user_name string, role_name string, warehouse_id bigint, warehouse_name string,
warehouse_size string, warehouse_type string, cluster_number bigint, query_tag string,
execution_status string, error_code string, error_message string,
start_time timestamp_ntz, end_time timestamp_ntz, total_elapsed_time bigint,
bytes_scanned bigint, percentage_scanned_from_cache double, bytes_written bigint,
bytes_written_to_result bigint, bytes_read_from_result bigint, rows_produced bigint,
rows_inserted bigint, rows_updated bigint, rows_deleted bigint, rows_unloaded bigint,
bytes_deleted bigint, partitions_scanned bigint, partitions_total bigint,
bytes_spilled_to_local_storage bigint, bytes_spilled_to_remote_storage bigint,
bytes_sent_over_the_network bigint, compilation_time bigint, execution_time bigint,
queued_provisioning_time bigint, queued_repair_time bigint, queued_overload_time bigint,
transaction_blocked_time bigint, outbound_data_transfer_cloud string,
outbound_data_transfer_region string, outbound_data_transfer_bytes bigint,
inbound_data_transfer_cloud string, inbound_data_transfer_region string,
inbound_data_transfer_bytes bigint, list_external_files_time bigint,
credits_used_cloud_services double, release_version string,
external_function_total_invocations bigint, external_function_total_sent_rows bigint,
external_function_total_received_rows bigint, external_function_total_sent_bytes bigint,
external_function_total_received_bytes bigint, query_load_percent bigint,
is_client_generated_statement boolean, query_acceleration_bytes_scanned bigint,
query_acceleration_partitions_scanned bigint,
query_acceleration_upper_limit_scale_factor bigint, transaction_id bigint,
child_queries_wait_time bigint, role_type string, query_hash string,
query_hash_version bigint, query_parameterized_hash string,
query_parameterized_hash_version bigint
"""

LOAD_HISTORY = """
start_time timestamp_ntz, end_time timestamp_ntz, warehouse_id bigint, warehouse_name string,
avg_running decimal(38,2), avg_queued_load decimal(38,2),
avg_queued_provisioning decimal(38,2), avg_blocked decimal(38,2)
"""

WAREHOUSE_EVENTS = """
timestamp timestamp_ntz, warehouse_id bigint, warehouse_name string, cluster_number bigint,
event_name string, event_reason string, event_state string, user_name string,
role_name string, query_id string
"""

METERING = """
start_time timestamp_ntz, end_time timestamp_ntz, warehouse_id bigint, warehouse_name string,
credits_used decimal(38,9), credits_used_compute decimal(38,9),
credits_used_cloud_services decimal(38,9)
"""

LIVE_QUERIES = """
query_id string, query_text string, database_name string, schema_name string,
query_type string, session_id bigint, user_name string, role_name string,
warehouse_name string, warehouse_size string, warehouse_type string, cluster_number bigint,
query_tag string, execution_status string, error_code bigint, error_message string,
start_time timestamp_ntz, end_time timestamp_ntz, total_elapsed_time bigint,
bytes_scanned bigint, rows_produced bigint, compilation_time bigint, execution_time bigint,
queued_provisioning_time bigint, queued_repair_time bigint, queued_overload_time bigint,
transaction_blocked_time bigint, outbound_data_transfer_cloud string,
outbound_data_transfer_region string, outbound_data_transfer_bytes bigint,
inbound_data_transfer_cloud string, inbound_data_transfer_region string,
inbound_data_transfer_bytes bigint, credits_used_cloud_services double,
list_external_file_time bigint, release_version string,
external_function_total_invocations bigint, external_function_total_sent_rows bigint,
external_function_total_received_rows bigint, external_function_total_sent_bytes bigint,
external_function_total_received_bytes bigint, is_client_generated_statement boolean
"""

USERS = """
user_id bigint, name string, created_on timestamp_ntz, deleted_on timestamp_ntz,
login_name string, display_name string, first_name string, last_name string, email string,
must_change_password boolean, has_password boolean, comment string, disabled variant,
snowflake_lock variant, default_warehouse string, default_namespace string,
default_role string, ext_authn_duo variant, ext_authn_uid string,
bypass_mfa_until timestamp_ntz, last_success_login timestamp_ntz, expires_at timestamp_ntz,
locked_until_time timestamp_ntz, has_rsa_public_key boolean,
password_last_set_time timestamp_ntz, owner string, default_secondary_role string
"""

SERVERLESS_TASKS = """
start_time timestamp_ntz, end_time timestamp_ntz, credits_used decimal(38,9), task_id bigint,
task_name string, schema_id bigint, schema_name string, database_id bigint,
database_name string
"""

TASK_HISTORY = """
name string, query_text string, condition_text string, schema_name string,
task_schema_id bigint, database_name string, task_database_id bigint,
scheduled_time timestamp_ntz, completed_time timestamp_ntz, state string,
return_value string, query_id string, query_start_time timestamp_ntz, error_code string,
error_message string, graph_version bigint, run_id bigint, root_task_id string,
scheduled_from string, instance_id bigint, attempt_number bigint, config string,
query_hash string, query_hash_version bigint, query_parameterized_hash string,
query_parameterized_hash_version bigint, graph_run_group_id string, backfill_info variant
"""

SESSIONS = """
session_id bigint, created_on timestamp_ntz, user_name string, authentication_method string,
login_event_id bigint, client_application_version string, client_application_id string,
client_environment string, client_build_id string, client_version string,
closed_reason string
"""

LOGIN_HISTORY = """
event_id bigint, event_timestamp timestamp_ntz, event_type string, user_name string,
client_ip string, reported_client_type string, reported_client_version string,
first_authentication_factor string, second_authentication_factor string, is_success string,
error_code bigint, error_message string, related_event_id bigint, connection string
"""

STORAGE_METRICS = """
id bigint, table_name string, table_schema_id bigint, schema_name string,
table_catalog_id bigint, table_catalog string, clone_group_id bigint, is_transient string,
active_bytes bigint, time_travel_bytes bigint, failsafe_bytes bigint,
retained_for_clone_bytes bigint, deleted boolean, table_created timestamp_ntz,
table_dropped timestamp_ntz, table_entered_failsafe timestamp_ntz,
schema_created timestamp_ntz, schema_dropped timestamp_ntz, catalog_created timestamp_ntz,
catalog_dropped timestamp_ntz, comment string, instance_id bigint
"""

HYBRID_TABLES = """
id bigint, name string, schema_id bigint, schema_name string, database_id bigint,
database_name string, owner string, row_count bigint, bytes bigint, retention_time bigint,
created timestamp_ntz, last_altered timestamp_ntz, deleted timestamp_ntz, comment string,
owner_role_type string
"""

HYBRID_TABLE_USAGE = """
object_type string, object_id string, object_name string, start_time timestamp_ntz,
end_time timestamp_ntz, credits_used decimal(38,9)
"""

VIEW_REFRESH_HISTORY = """
start_time timestamp_ntz, end_time timestamp_ntz, credits_used decimal(38,9),
table_id bigint, table_name string, schema_id bigint, schema_name string,
database_id bigint, database_name string
"""

OBJECT_DEPENDENCIES = """
referenced_database string, referenced_schema string, referenced_object_name string,
referenced_object_id bigint, referenced_object_domain string, referencing_database string,
referencing_schema string, referencing_object_name string, referencing_object_id bigint,
referencing_object_domain string, dependency_type string
"""

TAG_REFERENCES = """
tag_database string, tag_schema string, tag_id bigint, tag_name string, tag_value string,
object_database string, object_schema string, object_id bigint, object_name string,
object_deleted timestamp_ntz, domain string, column_id bigint, column_name string
"""

TAGS = """
tag_id bigint, tag_name string, tag_schema_id bigint, tag_schema string,
tag_database_id bigint, tag_database string, tag_owner string, tag_comment variant,
created timestamp_ntz, last_altered timestamp_ntz, deleted timestamp_ntz,
allowed_values variant, owner_role_type string
"""

# Rules, schedules and logs the engine itself keeps.
LABELS = """
name string, group_name string, group_rank bigint, label_created_at timestamp_ntz,
condition string, enabled boolean, label_modified_at timestamp_ntz, is_dynamic boolean,
label_id string
"""

PROBES = """
name string, condition string, notify_writer boolean, notify_writer_method string,
notify_other string, notify_other_method string, cancel boolean, enabled boolean,
probe_modified_at timestamp_ntz, probe_created_at timestamp_ntz
"""

PROBE_ACTIONS = """
action_time timestamp_ntz, probe_name string, query_id string,
actions_taken map<string,string>, outcome string
"""

SCHEDULES = """
id_val string, name string, start_at int, finish_at int, size string,
suspend_minutes bigint, resume boolean, scale_min bigint, scale_max bigint,
warehouse_mode string, comment string, weekday boolean, day string, enabled boolean,
last_modified timestamp_ntz
"""

TASK_LOG = """
task_start timestamp_ntz, success boolean, task_name string, object_name string,
input string, output string, task_finish timestamp_ntz, task_run_id string, query_id string,
range_min timestamp_ntz, range_max timestamp_ntz
"""

HOURLY_QUOTA = """
day date, hour_of_day int, name string, persona string, credits_used double,
last_updated timestamp_ntz
"""

SOURCES = {
    "QUERY_HISTORY": QUERY_HISTORY,
    "WAREHOUSE_LOAD_HISTORY": LOAD_HISTORY,
    "WAREHOUSE_EVENTS_HISTORY": WAREHOUSE_EVENTS,
    "WAREHOUSE_METERING_HISTORY": METERING,
    "LIVE_QUERIES": LIVE_QUERIES,
    "USERS": USERS,
    "SERVERLESS_TASK_HISTORY": SERVERLESS_TASKS,
    "TASK_HISTORY": TASK_HISTORY,
    "SESSIONS": SESSIONS,
    "LOGIN_HISTORY": LOGIN_HISTORY,
    "TABLE_STORAGE_METRICS": STORAGE_METRICS,
    "HYBRID_TABLES": HYBRID_TABLES,
    "HYBRID_TABLE_USAGE_HISTORY": HYBRID_TABLE_USAGE,
    "MATERIALIZED_VIEW_REFRESH_HISTORY": VIEW_REFRESH_HISTORY,
    "OBJECT_DEPENDENCIES": OBJECT_DEPENDENCIES,
    "TAG_REFERENCES": TAG_REFERENCES,
    "TAGS": TAGS,
}


def schema(ddl: str) -> StructType:
    """Struct type of a schema text."""
    return StructType.fromDDL(" ".join(ddl.split()))
