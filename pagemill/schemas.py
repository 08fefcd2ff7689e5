"""Record shapes shared by sources and operators."""

from __future__ import annotations

FETCH_LOG = (
    "url string, final_url string, tier string, attempt int, status int, html string, error string, elapsed_ms int"
)
SNAPSHOT = (
    "url string, ts timestamp, snapshot_id bigint, iso string, hash string, title string, "
    "status int, method string, text string"
)
# Method names of the fetch tiers.
FAST, STEALTH = "fast", "stealth"
METHODS = {FAST: "fetch_fast", STEALTH: "fetch_stealth"}
NOT_ATTEMPTED = "not attempted"
