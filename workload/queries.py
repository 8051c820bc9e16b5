"""The queries of the workload: name -> (spark, sf_dir) -> DataFrame."""

import uuid
from functools import partial

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import snapshot_name
from twinsieve.operators import (
    balance,
    canonical,
    digest,
    group_state,
    linking,
    pending,
    purge,
    reconcile,
    reports,
    reuse,
    store,
)
from twinsieve.plans import (
    dedupe_job,
    hash_dry_run,
    hash_job,
    job_dry_run,
    merge_previous,
    purge_dry_run,
    purge_job,
)
from twinsieve.sources import (
    inventory_of,
    manifest_from_inventory,
    manifest_from_rows,
    next_snapshot,
    read_history,
    read_snapshot,
    regular_files,
    reuse_from_history,
    snapshot_history,
    store_bucketed,
    union_roots,
    write_snapshot,
)
from twinsieve.streaming import (
    digest_resumed,
    first_seen,
    planned_links,
    save_stream,
    start_keyed_link_stream,
    start_link_stream,
)
from twinsieve.workspace import new_path, stage
from workload.fixture import (
    STEP_US,
    contradicting,
    document_path,
    document_payloads,
    fixture,
    on_two_devices,
    on_unknown_device,
    table,
)

# ---------------------------------------------------------------- sources, sinks


def inventory(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir).derived.select(
        "path",
        "root",
        F.struct(
            "mode",
            F.col("inode").alias("ino"),
            F.col("device").alias("dev"),
            F.col("links").alias("nlink"),
            "size",
            "mtime_us",
        ).alias("stat"),
    )


def manifest_build(spark, sf_dir):
    return manifest_from_inventory(inventory(spark, sf_dir))


def rows_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return manifest_from_rows(docs, document_path(), "text", root=F.col("source"))


def rows_of_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return manifest_from_rows(pages, F.col("url"), "html", root=F.lit("pages"))


def rows_of_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("/conversations/"), "conv_id", F.lit("/"), "turn")
    return manifest_from_rows(turns, path, "text", root=F.lit("conversations"))


def rows_of_benchmark(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    path = F.concat(F.lit("/benchmark/"), "item_id")
    return manifest_from_rows(items, path, "text", root=F.lit("benchmark"))


def roots_union(spark, sf_dir):
    docs = rows_of_documents(spark, sf_dir)
    overlapping = docs.withColumn("root", F.lit("all documents"))
    others = [rows_of_pages(spark, sf_dir), rows_of_conversations(spark, sf_dir)]
    return union_roots(docs, *others, rows_of_benchmark(spark, sf_dir), overlapping)


def prev_load(spark, sf_dir):
    return read_snapshot(spark, fixture(spark, sf_dir).previous_path)


def merged(spark, sf_dir):
    """Old digests reused, not yet reconciled."""
    f = fixture(spark, sf_dir)
    return reuse.reuse_digests(f.manifest, f.previous)


def synced(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return merge_previous(f.manifest, f.previous)


def next_snapshot_round_trip(spark, sf_dir):
    path = write_snapshot(synced(spark, sf_dir), new_path(spark, "snapshots"), "1")
    return read_snapshot(spark, path)


def snapshot_names(spark, sf_dir):
    roots = fixture(spark, sf_dir).manifest.groupBy("root").agg(F.count("*").alias("n_files"))
    return roots.withColumn("directory", F.concat(F.lit("D:\\data/"), "root")).select(
        "directory", "n_files", snapshot_name("directory").alias("snapshot_name")
    )


# ------------------------------------------------------------- filters and joins


def bucketed(df, buckets=4):
    """As a table bucketed by path, with a name of its own."""
    return store_bucketed(df, f"by_path_{uuid.uuid4().hex}", buckets)


def reuse_digests_bucketed(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return reuse.reuse_bucketed(bucketed(f.manifest), bucketed(f.previous))


def reuse_by_path(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return reuse.reuse_by_path(f.manifest, f.previous)


def three_snapshots(spark, sf_dir):
    """The old snapshot, a run in which a quarter of the rows was away, and a full one."""
    f, base = fixture(spark, sf_dir), new_path(spark, "history")
    here = f.hashed.filter(F.col("mtime_us") / STEP_US % 4 != 1)
    runs = {"2026-01-01": f.previous, "2026-01-02": here, "2026-01-03": f.hashed}
    for snapshot_id, rows in runs.items():
        write_snapshot(rows, base, snapshot_id)
    return base


def history(spark, sf_dir):
    return snapshot_history(read_history(spark, three_snapshots(spark, sf_dir)))


def reuse_history(spark, sf_dir):
    """From the first two snapshots only."""
    saved = read_history(spark, three_snapshots(spark, sf_dir), until="2026-01-02")
    return reuse_from_history(fixture(spark, sf_dir).manifest, saved)


def mismatches(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return reuse.digest_mismatches(f.hashed, f.previous)


def mismatch_cleared(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return reuse.clear_mismatches(f.hashed, f.previous)


def snapshot_changes(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return reuse.snapshot_changes(f.manifest, f.previous)


def content_digest(spark, sf_dir):
    return digest.digest_table(document_payloads(spark, sf_dir), "text")


def apply_digests(spark, sf_dir):
    m = stage(merged(spark, sf_dir), "merged")
    pending_paths = stage(pending.without_digest(m), "pending")
    found = digest.digest_rows(pending_paths, document_payloads(spark, sf_dir), "text")
    return digest.apply_digests(m, found)


def on_merged(operator):
    return lambda spark, sf_dir: operator(merged(spark, sf_dir))


def on_stored_merged(operator):
    return lambda spark, sf_dir: operator(stage(merged(spark, sf_dir), "merged"))


def on_synced(operator):
    return lambda spark, sf_dir: operator(synced(spark, sf_dir))


def on_stored_synced(operator):
    return lambda spark, sf_dir: operator(stage(synced(spark, sf_dir), "synced"))


def on_manifest(operator):
    return lambda spark, sf_dir: operator(fixture(spark, sf_dir).manifest)


def on_hashed(operator):
    return lambda spark, sf_dir: operator(fixture(spark, sf_dir).hashed)


def dup_groups_incremental(spark, sf_dir):
    """Groups of a first inventory, brought up to date over two runs: rows come and go,
    some content is replaced, and some paths become objects of their own."""
    minute = F.col("mtime_us") / STEP_US
    full = fixture(spark, sf_dir).hashed
    before = full.filter(minute % 5 != 0).withColumn(
        "md5", F.when(minute % 7 == 0, F.md5(F.concat("md5", F.lit("x")))).otherwise(F.col("md5"))
    )
    later = full.filter(minute % 3 != 1).withColumn(
        "inode", F.when(minute % 4 != 0, F.col("inode"))
    )
    before, later, full = (stage(rows, "inventory") for rows in (before, later, full))
    objects = stage(group_state.content_objects(before), "objects")
    groups = stage(group_state.groups_of(objects), "groups")
    for old, new in ((before, later), (later, full)):
        changes = stage(group_state.object_changes(old, new), "changes")
        merged_ = stage(group_state.merged_changes(objects, changes), "merged-changes")
        objects = stage(group_state.updated_objects(objects, changes, merged_, new), "objects")
        groups = stage(group_state.updated_groups(groups, objects, changes), "groups")
    return groups


# ------------------------------------------------------------------------- plans


def canon(policy):
    def run(spark, sf_dir):
        groups = canonical.canonicals(fixture(spark, sf_dir).hashed, policy)
        return groups.select("device", "md5", "n", "canonical_path", "canonical_inode")

    return run


def link_plan(policy):
    return on_hashed(partial(linking.link_plan, policy=policy))


def apply_link_plan(spark, sf_dir):
    hashed = fixture(spark, sf_dir).hashed
    return linking.apply_link_plan(hashed, linking.link_plan(hashed))


def link_plan_two_devices(spark, sf_dir):
    return linking.link_plan(on_two_devices(fixture(spark, sf_dir).hashed))


def on_purge(operator):
    """Rows with their true digest where one is known after reuse, against the list
    of all digests the previous snapshot holds."""

    def run(spark, sf_dir):
        return operator(stage(synced(spark, sf_dir), "synced"), fixture(spark, sf_dir).previous)

    return run


def device_guard(spark, sf_dir):
    return reports.device_report(on_two_devices(fixture(spark, sf_dir).manifest))


def run_summary(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return reports.run_summary(f.hashed, f.previous)


def report_display(spark, sf_dir):
    """Readable totals of each root, as they are and a million times as large."""
    per_root = (
        fixture(spark, sf_dir)
        .manifest.groupBy("root")
        .agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    )
    text = reports.display(per_root.unionByName(_million_fold(per_root)))
    return text


def _million_fold(totals):
    return totals.select(
        "root",
        (F.col("n_files") * 1000003).alias("n_files"),
        (F.col("n_bytes") * 1000003).alias("n_bytes"),
    )


# -------------------------------------------------------------------------- jobs


def digest_documents(spark, sf_dir):
    return lambda rows: digest.digest_rows(rows, document_payloads(spark, sf_dir), "text")


def job_hash(spark, sf_dir, *, refresh=False, skip_unique_sizes=False):
    f = fixture(spark, sf_dir)
    return hash_job(
        f.manifest,
        None if refresh else f.previous,
        digest_documents(spark, sf_dir),
        skip_unique_sizes=skip_unique_sizes,
    )


class Lost(Exception):
    """Stands for the loss of the driver."""


# Small, so that the fixture makes several slices. Each commit scans the documents.
SLICE_BYTES, MOST_COMMITS = 8 << 20, 8


def job_hash_resumed(spark, sf_dir):
    """A run that is lost after its first slice, and the same run started again."""
    f, folder, digest_them = fixture(spark, sf_dir), new_path(spark, "digest-log"), digest_documents(spark, sf_dir)
    done = []

    def lost_after_one(rows):
        if done:
            raise Lost
        done.append(1)
        return digest_them(rows)

    def job(one_by_one):
        way = partial(
            digest_resumed,
            folder=folder,
            digest=one_by_one,
            slice_bytes=SLICE_BYTES,
            slices=2,
            most_commits=MOST_COMMITS,
        )
        return hash_job(f.manifest, f.previous, way)

    try:
        return job(lost_after_one)
    except StreamingQueryException:
        return job(digest_them)


def pending_bins(spark, sf_dir):
    rows = stage(pending.without_digest(synced(spark, sf_dir)), "pending")
    return balance.digest_bins(rows, BIN_BYTES, OBJECT_COST)


# Of the fixture's scale: some documents are larger than half of a bin.
BIN_BYTES, OBJECT_COST = 40_000, 100


def run_summary_observed(spark, sf_dir):
    f = fixture(spark, sf_dir)
    to_write, counts = reports.observed(f.hashed, f.previous)
    return reports.observed_summary(stage(to_write, "hashed"), counts)


def job_dedupe(spark, sf_dir, policy="max_links", **options):
    f = fixture(spark, sf_dir)
    _, plan = dedupe_job(
        f.manifest,
        f.previous,
        digest_documents(spark, sf_dir),
        policy=policy,
        one_device=True,
        **options,
    )
    return plan


def job_two_runs(spark, sf_dir):
    """A run, its snapshot, and a second run after a quarter of the rows was touched."""
    first = job_hash(spark, sf_dir)
    saved = read_snapshot(spark, write_snapshot(first, new_path(spark, "snapshots"), "1"))
    touched = (F.col("mtime_us") / STEP_US % 4 == 1).cast("long")
    now = fixture(spark, sf_dir).manifest.withColumn("mtime_us", F.col("mtime_us") + touched)
    return hash_job(stage(now, "touched"), saved, digest_documents(spark, sf_dir))


def on_purge_job(job):
    """A whole run, then the first path of each object whose digest the snapshot has."""

    def run(spark, sf_dir):
        hashed = stage(job_hash(spark, sf_dir), "hashed")
        return job(hashed, fixture(spark, sf_dir).previous, first_of_inode=True)

    return run


def dry_run_job(spark, sf_dir, **options):
    f = fixture(spark, sf_dir)
    return job_dry_run(f.manifest, f.previous, **options)


def run_summary_skipped(spark, sf_dir):
    hashed = job_hash(spark, sf_dir, refresh=True, skip_unique_sizes=True)
    return reports.run_summary(stage(hashed, "hashed"), fixture(spark, sf_dir).previous)


def on_contradicting(operator):
    def run(spark, sf_dir):
        f = fixture(spark, sf_dir)
        return operator(f.manifest, contradicting(f.previous))

    return run


def link_plan_unknown_device(policy):
    def run(spark, sf_dir):
        return linking.link_plan(on_unknown_device(fixture(spark, sf_dir).hashed), policy)

    return run


def dry_run(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return hash_dry_run(f.manifest, f.previous)


# ------------------------------------------------------------------------- store


def refs_of_documents(spark, sf_dir):
    return store.store_refs(document_payloads(spark, sf_dir), "text")


def store_blobs(spark, sf_dir):
    refs = stage(refs_of_documents(spark, sf_dir), "refs")
    redundant = stage(store.redundant_paths(refs), "redundant")
    return store.store_blobs(document_payloads(spark, sf_dir), "text", redundant)


def store_restore(spark, sf_dir):
    refs = stage(refs_of_documents(spark, sf_dir), "refs")
    redundant = stage(store.redundant_paths(refs), "redundant")
    payloads = document_payloads(spark, sf_dir)
    blobs = stage(store.store_blobs(payloads, "text", redundant), "blobs")
    return store.store_restore(refs, blobs)


def references(spark, sf_dir):
    """Counts of the store as the previous snapshot left it, and what changed since."""
    f = fixture(spark, sf_dir)
    old = f.previous.filter("md5 is not null").select("path", "md5")
    counts = old.groupBy("md5").agg(F.count("*").alias("n_refs"))
    return counts, store.ref_changes(old, f.hashed.select("path", "md5"))


def store_refcounts(spark, sf_dir):
    return store.apply_ref_changes(*references(spark, sf_dir))


def store_upsert(spark, sf_dir):
    """A store of most documents, brought up to date with another selection of them."""
    docs = table(spark, sf_dir, "documents")
    path = document_path().alias("path")
    before = docs.filter("doc_id % 5 <> 0").select(path, "text")
    after = docs.filter("doc_id % 7 <> 0").select(path, "text")
    old, new = (stage(store.store_refs(rows, "text"), "refs") for rows in (before, after))
    blobs = stage(store.store_blobs(before, "text", stage(store.redundant_paths(old), "redundant")), "blobs")
    counts = stage(old.filter("md5 is not null").groupBy("md5").agg(F.count("*").alias("n_refs")), "counts")
    changes = stage(store.ref_changes(old, new), "changes")
    paths = stage(store.new_blob_paths(new, counts, changes), "new-blobs")
    unused = store.garbage(store.apply_ref_changes(counts, changes))
    return store.upserted(blobs, store.new_blobs(after, "text", paths), unused)


# --------------------------------------------------------------------- streaming


def document_stream(spark, sf_dir):
    # A pattern, because a stream takes a single file only that way.
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    return manifest_from_rows(docs, document_path(), "text", root=F.col("source"))


def stream_first_seen(spark, sf_dir):
    out, checkpoint = new_path(spark, "first-seen"), new_path(spark, "first-seen-checkpoint")
    stream = first_seen(document_stream(spark, sf_dir)).select("md5")
    save_stream(stream, out, checkpoint, every=None).awaitTermination()
    return spark.read.parquet(out)


def stream_link_plan(spark, sf_dir):
    base = new_path(spark, "link-stream")
    start_link_stream(document_stream(spark, sf_dir), base, every=None).awaitTermination()
    return planned_links(spark, base)


def stream_link_plan_batches(spark, sf_dir, start=start_link_stream):
    """The manifest arrives in four parts; each finds what was elected before."""
    base, arrivals = new_path(spark, "link-stream"), new_path(spark, "link-arrivals")
    rows = fixture(spark, sf_dir).hashed
    for part in range(4):
        arriving = rows.filter(F.col("mtime_us") / STEP_US % 4 == part)
        arriving.write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(rows.schema).parquet(arrivals)
        start(stream, base, every=None).awaitTermination()
    return planned_links(spark, base)


WITHIN = "10 minutes"


def stream_first_seen_within(spark, sf_dir):
    """All digests at once, again after 5 minutes and again after an hour, when the
    bound of 10 minutes has let the first ones go."""
    source, out = new_path(spark, "timed"), new_path(spark, "first-within")
    checkpoint = new_path(spark, "first-within-checkpoint")
    digests = fixture(spark, sf_dir).hashed.select("md5")
    marker = digests.limit(1).withColumn("md5", F.lit("marker"))
    for minute, rows in ((0, digests), (5, digests), (59, marker), (60, digests)):
        seen = F.timestamp_seconds(F.lit(1704067200 + 60 * minute))
        rows.select("md5", seen.alias("seen"), F.lit(minute).alias("minute")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("md5 string, seen timestamp, minute int").parquet(source)
        stream = first_seen(stream, event_time="seen", within=WITHIN).select("md5", "minute")
        save_stream(stream, out, checkpoint, every=None).awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    # sources and sinks
    "manifest_build": manifest_build,
    "manifest_documents": rows_of_documents,
    "manifest_pages": rows_of_pages,
    "manifest_conversations": rows_of_conversations,
    "manifest_benchmark": rows_of_benchmark,
    "roots_union": roots_union,
    "prev_load": prev_load,
    "next_snapshot": next_snapshot_round_trip,
    "snapshot_name": snapshot_names,
    # filters and projections
    "regular_files": lambda spark, sf_dir: regular_files(fixture(spark, sf_dir).manifest),
    "linked_missing": on_merged(reconcile.linked_without_digest),
    "digest_mismatches": mismatches,
    "digest_mismatch_cleared": mismatch_cleared,
    "mismatch_examples": lambda spark, sf_dir: reuse.mismatch_examples(mismatches(spark, sf_dir)),
    "content_digest": content_digest,
    # snapshot reuse
    "reuse_digests": merged,
    "reuse_digests_bucketed": reuse_digests_bucketed,
    "reuse_by_path": reuse_by_path,
    "snapshot_changes": snapshot_changes,
    "reuse_digests_contradicting": on_contradicting(reuse.reuse_digests),
    "reuse_by_path_contradicting": on_contradicting(reuse.reuse_by_path),
    "snapshot_changes_contradicting": on_contradicting(reuse.snapshot_changes),
    "snapshot_history": history,
    "reuse_history": reuse_history,
    # reconciliation within physical objects
    "inode_profile": on_merged(reconcile.inode_profile),
    "inode_flags": on_merged(reconcile.inode_flags),
    "inode_conflicts": on_stored_merged(reconcile.inode_conflicts),
    "inode_sync": synced,
    "inode_sync_fill_only": on_stored_merged(reconcile.fill_digests),
    "affected_rows": on_stored_merged(reconcile.affected_rows),
    # pending work
    "pending_all": on_synced(lambda m: pending.by_size(pending.without_digest(m))),
    "size_groups": on_manifest(pending.size_groups),
    "size_groups_exploded": on_stored_synced(pending.size_collisions),
    "pending_size_collision": on_stored_synced(
        lambda m: pending.by_size_largest_first(pending.size_collisions(m).drop("n"))
    ),
    "pending_one_per_inode": on_synced(lambda m: pending.one_per_inode(pending.without_digest(m))),
    "apply_digests": apply_digests,
    "digest_bins": pending_bins,
    # groups, canonical members, plans
    "dup_groups": on_hashed(canonical.duplicate_groups),
    "dup_groups_incremental": dup_groups_incremental,
    "dup_rows": on_hashed(canonical.duplicate_rows),
    "canon_max_links": canon("max_links"),
    "canon_modal_inode": canon("modal_inode"),
    "canon_first_seen": canon("first_seen"),
    "link_plan_max_links": link_plan("max_links"),
    "link_plan_modal_inode": link_plan("modal_inode"),
    "link_plan_first_seen": link_plan("first_seen"),
    "link_plan_two_devices": link_plan_two_devices,
    "link_plan_unknown_device_max_links": link_plan_unknown_device("max_links"),
    "link_plan_unknown_device_modal_inode": link_plan_unknown_device("modal_inode"),
    "link_plan_unknown_device_first_seen": link_plan_unknown_device("first_seen"),
    "apply_link_plan": apply_link_plan,
    "purge_candidates": on_purge(purge.purge_candidates),
    "purge_survivors": on_purge(purge.purge_survivors),
    "purge_one_per_inode": on_purge(purge.purge_one_per_inode),
    # reports
    "scan_totals": on_manifest(reports.scan_totals),
    "dry_run": dry_run,
    "device_guard": device_guard,
    "savings": on_hashed(reports.savings),
    "digest_size_check": on_hashed(reports.digest_size_check),
    "digest_size_check_previous": lambda spark, sf_dir: reports.digest_size_check(
        fixture(spark, sf_dir).previous
    ),
    "savings_sure": on_hashed(reports.sure_savings),
    "dry_run_job": dry_run_job,
    "dry_run_job_skip_unique": partial(dry_run_job, skip_unique_sizes=True),
    "run_summary": run_summary,
    "run_summary_skipped": run_summary_skipped,
    "run_summary_observed": run_summary_observed,
    "report_display": report_display,
    # jobs
    "job_hash": job_hash,
    "job_hash_refresh": partial(job_hash, refresh=True),
    "job_hash_skip_unique": partial(job_hash, skip_unique_sizes=True),
    "job_hash_resumed": job_hash_resumed,
    "job_two_runs": job_two_runs,
    "job_dedupe": job_dedupe,
    "job_dedupe_modal": partial(job_dedupe, policy="modal_inode"),
    "job_dedupe_first_seen": partial(job_dedupe, policy="first_seen"),
    "job_dedupe_skip_unique": partial(job_dedupe, skip_unique_sizes=True),
    "job_purge": on_purge_job(purge_job),
    "purge_dry_run": on_purge_job(purge_dry_run),
    # content store
    "store_refs": refs_of_documents,
    "store_blobs": store_blobs,
    "store_restore": store_restore,
    "store_refcounts": store_refcounts,
    "store_garbage": lambda spark, sf_dir: store.garbage(store_refcounts(spark, sf_dir)),
    "store_upsert": store_upsert,
    # streaming
    "stream_first_seen": stream_first_seen,
    "stream_first_seen_within": stream_first_seen_within,
    "stream_link_plan": stream_link_plan,
    "stream_link_plan_batches": stream_link_plan_batches,
    "stream_link_plan_keyed": partial(stream_link_plan_batches, start=start_keyed_link_stream),
}
