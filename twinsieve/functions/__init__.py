from twinsieve.functions.expressions import (
    byte_size,
    content_digest,
    display_bytes,
    display_count,
    identity,
    is_regular_file,
    snapshot_name,
)

__all__ = [
    "byte_size",
    "content_digest",
    "display_bytes",
    "display_count",
    "identity",
    "is_regular_file",
    "snapshot_name",
]
