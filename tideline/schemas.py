"""DDL schemas of the envelope, the dimensions and the ledgers."""

ENVELOPE = """
    event_id string, logical_event_id string, idempotency_key string, tab_id string, sequence bigint,
    previous_logical_event_id string, event_source string, site_code string, env string,
    token_version int, jwt_id string, event_name string, event_version int, event_time timestamp,
    received_at timestamp, anonymous_id string, session_id string, user_id string, origin string,
    url string, path string, referrer string, user_agent string, ip_hash string, sdk_name string,
    sdk_version string, properties variant, context variant
"""

SITE = """
    site_code string, tenant_id string, site_id string, status string, tracking_enabled boolean,
    allowed_domains array<string>, token_version int, sample_rate double, schema_version int,
    timezone string
"""

SNAPSHOT = """
    tenant_id string, external_subject_id string, lifecycle_status string,
    source_updated_at string, source_mutation_id string, merged_into_external_subject_id string
"""

SNAPSHOT_PAGE = f"""
    subject_type string, source_revision string, next_cursor string, has_more boolean,
    subjects array<struct<{', '.join(f.strip().replace(' ', ': ') for f in SNAPSHOT.split(','))}>>
"""

CONTEXT = """
    context_key string, context_version int, context_family string, parent_context_key string,
    parent_context_version int, status string
"""

REGISTRY = f"""
    schema_version int, registry_version bigint, registry_revision string,
    contexts array<struct<{', '.join(f.strip().replace(' ', ': ') for f in CONTEXT.split(','))}>>
"""

RUN = """
    run_id string, projection_name string, projection_version int, status string,
    started_at timestamp, completed_at timestamp, affected_days bigint, rows_read bigint,
    rows_written bigint, last_error string
"""

REVISIONS = """
    schema_version int, registry_version bigint, registry_revision string, payload_checksum string,
    status string, activated_at timestamp
"""

DEFINITIONS = """
    context_key string, context_version int, context_family string, parent_context_key string,
    parent_context_version int
"""

ENTRIES = "registry_revision string, context_key string, context_version int, status string"
