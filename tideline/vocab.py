"""Fixed values of the data model, in natural order."""

# Payload keys that reject an event.
BLOCKED_KEYS = (
    "password", "token", "access_token", "refresh_token", "authorization", "cookie",
    "secret", "private_key", "credit_card", "card_number", "cvv", "dni", "document",
)
MAX_PAYLOAD_BYTES = 65536
MAX_PAYLOAD_DEPTH = 16
MAX_TEXT = 255
MAX_BATCH_EVENTS = 50
MAX_SUBJECTS = 100

SOURCES = ("web", "server")

SUBJECT_EVENTS = (
    "subject_impression", "subject_viewed", "subject_selected", "subject_associated",
    "subject_deactivated", "subject_reactivated", "subject_merged",
)
SIGNAL_EVENTS = ("subject_impression", "subject_viewed", "subject_selected", "subject_associated")
LIFECYCLE_EVENTS = ("subject_deactivated", "subject_reactivated", "subject_merged")
LIFECYCLE_STATUS = {
    "subject_deactivated": "inactive",
    "subject_reactivated": "active",
    "subject_merged": "merged",
}
LIFECYCLE_STATUSES = ("unknown", "active", "inactive", "merged")

ITEM_EVENTS = (
    "item_impression", "item_viewed", "item_image_zoomed",
    "cart_item_added", "checkout_started", "purchase_completed",
)
ORDER_EVENTS = ("checkout_started", "purchase_completed")

CONTEXT_FAMILIES = (
    "search", "selection", "transaction", "service", "support", "content", "navigation",
)
NORMALIZATION_STATUSES = (
    "normalized", "invalid_subject", "unsupported_subject_type", "timezone_unresolved",
    "idempotency_conflict", "lifecycle_ignored",
)
RESOLUTION_STATUSES = (
    "registry_disabled", "registered", "unregistered", "inactive_context", "family_unresolved",
)
RUN_STATUSES = ("running", "completed", "failed", "skipped_locked")

# Public payload fields outside the envelope, and where they are routed.
PROPERTY_EXTRAS = ("raw", "items", "filters", "route_name", "search_term", "previous_page")
CONTEXT_EXTRAS = ("app", "consent")
SITE_EXTRAS = (
    "allowed_domains", "site_code", "site_id", "status", "tenant_id", "tracking_enabled",
)

# Form payloads.
FORM_EVENTS = (
    "form_validation_attempt", "form_completed", "form_abandoned",
    "form_step_advanced", "form_step_viewed",
)
FORM_BLOCKED_KEYS = (
    "value", "values", "text", "message", "email", "phone",
    "address", "document", "dni", "card", "password", "token",
)
FIELD_NAME_PATTERN = "^[a-zA-Z0-9_.-]{1,80}$"

SESSION_GAP_SECONDS = 30 * 60
PAGE_VIEW_WINDOW_MS = 1000
KEY_TTL_SECONDS = 24 * 60 * 60
STALE_AFTER_SECONDS = 48 * 60 * 60
RUN_EVERY_SECONDS = 24 * 60 * 60
GLOBAL_WINDOW_DAYS = 90
CONTEXT_WINDOW_DAYS = 30
DEFAULT_LIMIT = 10
MAX_LIMIT = 100
MAX_DELIVERIES = 5

HISTOGRAM_BOUNDS = (
    0.01, 0.025, 0.05, 0.1, 0.25, 0.3, 0.5, 1.0,
    2.5, 5.0, 10.0, 30.0, 60.0, 300.0, 1800.0, 3600.0,
)

GLOBAL_PROJECTION = "subject_global"
CONTEXT_PROJECTION = "subject_context"
