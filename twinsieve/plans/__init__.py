from twinsieve.plans.jobs import (
    dedupe_job,
    hash_dry_run,
    hash_job,
    job_dry_run,
    merge_previous,
    pending_rows,
    purge_dry_run,
    purge_job,
)

__all__ = [
    "dedupe_job",
    "hash_dry_run",
    "hash_job",
    "job_dry_run",
    "merge_previous",
    "pending_rows",
    "purge_dry_run",
    "purge_job",
]
