from twinsieve.sources.files import inventory_of, scan_listing, unreadable, walk_tree
from twinsieve.sources.history import (
    as_of,
    latest_digests,
    read_history,
    reuse_from_history,
    snapshot_history,
)
from twinsieve.sources.manifest import (
    manifest_from_inventory,
    manifest_from_rows,
    read_inventory,
    regular_files,
    union_roots,
)
from twinsieve.sources.snapshot import (
    next_snapshot,
    read_digest_list,
    read_snapshot,
    snapshot_path,
    store_bucketed,
    write_snapshot,
)

__all__ = [
    "as_of",
    "inventory_of",
    "latest_digests",
    "manifest_from_inventory",
    "manifest_from_rows",
    "next_snapshot",
    "read_digest_list",
    "read_history",
    "read_inventory",
    "read_snapshot",
    "regular_files",
    "reuse_from_history",
    "scan_listing",
    "snapshot_history",
    "snapshot_path",
    "store_bucketed",
    "union_roots",
    "unreadable",
    "walk_tree",
    "write_snapshot",
]
