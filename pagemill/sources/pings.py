"""Usage pings: JSON payloads checked and shaped, rejects kept with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Payload and field sizes, form of an id.
MAX_PAYLOAD_BYTES = 4096
ID_CHARS = 64
FIELD_CHARS = 32
ID_FORM = r"^[0-9a-f]{8,64}\z"


def check_pings(payloads: DataFrame, body: str = "body", received_at: str = "received_at") -> DataFrame:
    """Ping columns plus ``reject_reason`` (null = accepted): too large, bad json or bad id, in that order."""
    v = F.try_parse_json(body)

    def field(name: str, chars: int):
        return F.left(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")), F.lit(chars))

    # a time of 0 or none at all falls back to the moment of receipt
    sent = F.try_variant_get(v, "$.ts", "string").try_cast("double")
    usable = sent.isNotNull() & (sent != 0) & ~F.isnan(sent)
    clean_id = field("id", ID_CHARS)
    reason = (
        F.when(F.octet_length(body) > MAX_PAYLOAD_BYTES, "payload too large")
        .when(v.isNull(), "bad json")
        .when(~clean_id.rlike(ID_FORM), "bad id")
    )
    others = [c for c in payloads.columns if c not in (body, received_at)]
    return payloads.select(
        *others,
        clean_id.alias("id"),
        *(field(n, FIELD_CHARS).alias(n) for n in ("version", "python", "platform")),
        F.when(usable, F.timestamp_seconds(sent)).otherwise(F.col(received_at)).alias("ts"),
        F.col(received_at).alias("received_at"),
        reason.alias("reject_reason"),
    )


def read_pings(payloads: DataFrame, body: str = "body", received_at: str = "received_at"):
    """(accepted pings, rejected payloads with their reason)."""
    checked = check_pings(payloads, body, received_at)
    ok = F.col("reject_reason").isNull()
    return checked.filter(ok).drop("reject_reason"), checked.filter(~ok)
