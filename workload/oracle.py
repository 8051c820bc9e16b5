"""The same queries as SQL over the given tables, for an independent check."""

MANIFEST_COLUMNS = "path, root, device, inode, mode, size, mtime_us, links"

FIXTURE = """
docs AS (
  SELECT doc_id, source AS root,
         '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path,
         CAST(strlen(text) AS BIGINT) AS size, md5(text) AS content_md5, text
  FROM documents),
inodes AS (
  SELECT *, CASE WHEN doc_id % 3 <> 0
                 THEN min(CASE WHEN doc_id % 3 <> 0 THEN doc_id END)
                      OVER (PARTITION BY content_md5)
                 ELSE doc_id END AS inode
  FROM docs),
manifest AS (
  SELECT doc_id, path, root, CAST(0 AS BIGINT) AS device, inode,
         CAST(CASE doc_id % 10 WHEN 9 THEN 16877 WHEN 8 THEN 41471 ELSE 33188 END
              AS INTEGER) AS mode,
         size, 1704067200000000 + doc_id * 60000000 AS mtime_us,
         CAST(count(*) OVER (PARTITION BY inode) + inode % 4 AS BIGINT) AS links,
         content_md5,
         CASE WHEN inode IS NULL OR inode = 0 THEN 'path:' || path
              ELSE '0:' || CAST(inode AS VARCHAR) END AS identity
  FROM inodes),
previous AS (
  SELECT path, inode,
         CASE WHEN doc_id % 11 = 0 THEN size + 1 ELSE size END AS size,
         CASE WHEN doc_id % 7 = 0 THEN mtime_us - 1 ELSE mtime_us END AS mtime_us,
         CASE WHEN doc_id % 13 = 0 THEN NULL
              WHEN doc_id % 6 = 1 THEN md5(content_md5 || 'x')
              ELSE content_md5 END AS md5
  FROM manifest WHERE doc_id % 5 <> 0
  UNION ALL
  SELECT path || '.gone', inode + 1000000, size, mtime_us, content_md5
  FROM manifest WHERE doc_id % 50 = 0),
hashed AS (SELECT *, content_md5 AS md5 FROM manifest),
merged AS (
  SELECT m.*, p.md5
  FROM manifest m LEFT JOIN previous p
    ON m.path = p.path AND m.size = p.size AND m.mtime_us = p.mtime_us),
synced AS (
  SELECT * EXCLUDE (md5),
         CASE WHEN count(*) OVER w = 1 THEN md5
              WHEN min(md5) OVER w = max(md5) OVER w THEN max(md5) OVER w END AS md5
  FROM merged WINDOW w AS (PARTITION BY identity)),
mismatched AS (
  SELECT h.path, h.size, h.mtime_us, h.md5, p.md5 AS old_md5
  FROM hashed h JOIN previous p
    ON h.path = p.path AND h.size = p.size AND h.mtime_us = p.mtime_us
  WHERE h.md5 <> p.md5),
size_counts AS (
  SELECT size, CAST(count(*) AS BIGINT) AS n FROM manifest GROUP BY size HAVING count(*) > 1)
"""


def with_fixture(select: str, more: str = "") -> str:
    return f"WITH {FIXTURE}{more} {select}"


def manifest_of(source: str, md5: str = "md5") -> str:
    return f"SELECT {MANIFEST_COLUMNS}, {md5} AS md5 FROM {source}"


# --------------------------------------------------------------- rows as objects


def rows_as_manifest(table: str, path: str, payload: str, root: str) -> str:
    return f"""
SELECT {path} AS path, {root} AS root, CAST(0 AS BIGINT) AS device,
       CAST(NULL AS BIGINT) AS inode, CAST(33188 AS INTEGER) AS mode,
       CAST(strlen({payload}) AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime_us,
       CAST(1 AS BIGINT) AS links, md5({payload}) AS md5
FROM {table}"""


DOCUMENT_PATH = "'/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)"
ROWS_OF_DOCUMENTS = rows_as_manifest("documents", DOCUMENT_PATH, "text", "source")
ROWS_OF_PAGES = rows_as_manifest("pages", "url", "html", "'pages'")
ROWS_OF_CONVERSATIONS = rows_as_manifest(
    "conversations",
    "'/conversations/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)",
    "text",
    "'conversations'",
)
ROWS_OF_BENCHMARK = rows_as_manifest(
    "benchmark", "'/benchmark/' || CAST(item_id AS VARCHAR)", "text", "'benchmark'"
)
ROOTS_UNION = f"""
SELECT path, min(root) AS root, min(device) AS device, min(inode) AS inode,
       min(mode) AS mode, min(size) AS size, min(mtime_us) AS mtime_us,
       min(links) AS links, min(md5) AS md5
FROM ({ROWS_OF_DOCUMENTS} UNION ALL {ROWS_OF_PAGES} UNION ALL {ROWS_OF_CONVERSATIONS}
      UNION ALL {ROWS_OF_BENCHMARK}
      UNION ALL SELECT * REPLACE ('all documents' AS root) FROM ({ROWS_OF_DOCUMENTS}))
GROUP BY path"""

# ------------------------------------------------------- elections and link plans

# Order of the members within a content group; the first is canonical.
ORDERS = {
    "max_links": "links DESC, path",
    "first_seen": "mtime_us, path",
    "modal_inode": "same_object DESC, object_path, path",
}


def elected(source: str, policy: str) -> str:
    """CTEs that end in `members`: every row with the canonical one of its content."""
    return f""",
objects AS (
  SELECT *, count(*) OVER (PARTITION BY device, md5, identity) AS same_object,
         min(path) OVER (PARTITION BY device, md5, identity) AS object_path
  FROM {source} WHERE md5 IS NOT NULL),
members AS (
  SELECT *, first_value(path) OVER w AS canonical_path,
         first_value(inode) OVER w AS canonical_inode,
         first_value(identity) OVER w AS canonical_identity
  FROM objects
  WINDOW w AS (PARTITION BY device, md5 ORDER BY {ORDERS[policy]}
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


PLAN = """SELECT md5, path, inode, canonical_path, canonical_inode, size
FROM members WHERE identity <> canonical_identity"""


def canon(policy: str) -> str:
    return with_fixture(
        """SELECT device, md5, CAST(count(*) AS BIGINT) AS n,
                  min(canonical_path) AS canonical_path, min(canonical_inode) AS canonical_inode
           FROM members GROUP BY device, md5""",
        elected("hashed", policy),
    )


def link_plan(policy: str, source: str = "hashed", more: str = "") -> str:
    return with_fixture(PLAN, more + elected(source, policy))


TWO_DEVICES = """,
far AS (
  SELECT * REPLACE (CAST(CASE WHEN root = 'src19' THEN 1 ELSE 0 END AS BIGINT) AS device,
                    CASE WHEN inode IS NULL OR inode = 0 THEN identity
                         ELSE CASE WHEN root = 'src19' THEN '1:' ELSE '0:' END
                              || CAST(inode AS VARCHAR) END AS identity)
  FROM hashed)"""

UNKNOWN_DEVICE = """,
known AS (SELECT * FROM hashed WHERE doc_id % 3 <> 1)"""

# Snapshot rows for one path, size and mtime that contradict each other are not used.
CONTRADICTING = """,
doubled AS (
  SELECT * FROM previous
  UNION ALL SELECT * REPLACE (md5(md5 || 'y') AS md5) FROM previous WHERE size % 4 = 0),
settled AS (
  SELECT path, size, mtime_us, CASE WHEN min(md5) = max(md5) THEN min(md5) END AS md5
  FROM doubled GROUP BY path, size, mtime_us)"""
REUSED_CONTRADICTING = """
SELECT m.path, m.root, m.device, m.inode, m.mode, m.size, m.mtime_us, m.links, p.md5
FROM manifest m LEFT JOIN settled p
  ON m.path = p.path AND m.size = p.size AND m.mtime_us = p.mtime_us"""

# -------------------------------------------------------------------------- jobs


def finished(start: str, pending: str) -> str:
    """CTEs that end in `finished`: rows of `start`, where the first path of each
    object among the `pending` rows is digested and shares its digest."""
    return f""",
waiting AS (SELECT * FROM {start} s WHERE md5 IS NULL AND {pending}),
picked AS (
  SELECT identity, min_by(content_md5, path) AS new_md5 FROM waiting GROUP BY identity),
finished AS (
  SELECT s.* REPLACE (coalesce(s.md5, k.new_md5) AS md5)
  FROM {start} s LEFT JOIN picked k ON s.identity = k.identity)"""


NO_DIGESTS = """,
fresh AS (SELECT *, CAST(NULL AS VARCHAR) AS md5 FROM manifest)"""
SHARES_SIZE = "EXISTS (SELECT 1 FROM size_counts c WHERE c.size = s.size)"

SECOND_RUN = """,
again AS (
  SELECT * EXCLUDE (md5) REPLACE (mtime_us + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS mtime_us),
         CASE WHEN doc_id % 4 <> 1 THEN md5 END AS md5
  FROM finished),
agreed AS (
  SELECT * EXCLUDE (md5),
         CASE WHEN count(*) OVER w = 1 THEN md5
              WHEN min(md5) OVER w = max(md5) OVER w THEN max(md5) OVER w END AS md5
  FROM again WINDOW w AS (PARTITION BY identity)),
twice AS (
  SELECT * REPLACE (coalesce(md5, content_md5) AS md5) FROM agreed)"""

# ----------------------------------------------------------------------- purging

LISTED = "EXISTS (SELECT 1 FROM previous p WHERE p.md5 = s.md5)"

# ----------------------------------------------------------------------- display

# Decimal size units.
UNITS = ["kB", "MB", "GB", "TB", "PB", "EB"]


def bytes_text(n: str) -> str:
    cases = [f"WHEN {n} = 1 THEN '1 Byte'", f"WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) || ' Bytes'"]
    for power, unit in enumerate(UNITS, start=1):
        tenth = 1000**power // 10
        tenths = f"(CAST({n} AS HUGEINT) * 2 + {tenth}) // {2 * tenth}"
        text = f"CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || ' {unit}'"
        last = power == len(UNITS)
        cases.append(f"ELSE {text}" if last else f"WHEN {n} < {1000 ** (power + 1)} THEN {text}")
    return "CASE " + " ".join(cases) + " END"


FIRST_OF_LISTED = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY identity ORDER BY path) AS nth
    FROM finished s WHERE {LISTED}) WHERE nth = 1"""

TOTALS = """SELECT CAST(count(*) AS BIGINT) AS n_files,
                   CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes FROM """

# ------------------------------------------------------------------------- store

REFS = f"SELECT {DOCUMENT_PATH} AS path, md5(text) AS md5 FROM documents"

ORACLE = {
    "manifest_build": with_fixture(
        manifest_of("manifest", "CAST(NULL AS VARCHAR)") + " WHERE (mode & 61440) = 32768"
    ),
    "manifest_documents": ROWS_OF_DOCUMENTS,
    "manifest_pages": ROWS_OF_PAGES,
    "manifest_conversations": ROWS_OF_CONVERSATIONS,
    "manifest_benchmark": ROWS_OF_BENCHMARK,
    "roots_union": ROOTS_UNION,
    "prev_load": with_fixture("SELECT * FROM previous"),
    "next_snapshot": with_fixture(
        "SELECT path, inode, size, mtime_us, md5 FROM synced WHERE md5 IS NOT NULL"
    ),
    "snapshot_name": with_fixture(
        """SELECT 'D:\\data/' || root AS directory, CAST(count(*) AS BIGINT) AS n_files,
                  'fs_info-D-data-' || root || '.parquet' AS snapshot_name
           FROM manifest GROUP BY root"""
    ),
    "regular_files": with_fixture(
        manifest_of("manifest", "CAST(NULL AS VARCHAR)") + " WHERE (mode & 61440) = 32768"
    ),
    "linked_missing": with_fixture(manifest_of("merged") + " WHERE links > 1 AND md5 IS NULL"),
    "digest_mismatches": with_fixture("SELECT * FROM mismatched"),
    "digest_mismatch_cleared": with_fixture(
        manifest_of(
            "hashed h",
            "CASE WHEN NOT EXISTS (SELECT 1 FROM mismatched x WHERE x.path = h.path) THEN md5 END",
        )
    ),
    "mismatch_examples": with_fixture(
        """SELECT path, (SELECT CAST(count(*) AS BIGINT) FROM mismatched) AS n_mismatches
           FROM mismatched ORDER BY path LIMIT 5"""
    ),
    "content_digest": f"""SELECT {DOCUMENT_PATH} AS path, md5(text) AS md5,
                                 CAST(strlen(text) AS BIGINT) AS size FROM documents""",
    "reuse_digests": with_fixture(manifest_of("merged")),
    "reuse_by_path": with_fixture(
        """SELECT m.path, m.root, m.device, m.inode, m.mode, m.size, m.mtime_us, m.links,
                  CASE WHEN p.size = m.size AND p.mtime_us = m.mtime_us THEN p.md5 END AS md5
           FROM manifest m LEFT JOIN previous p ON m.path = p.path"""
    ),
    "snapshot_changes": with_fixture(
        """SELECT coalesce(m.path, p.path) AS path,
                  CASE WHEN p.path IS NULL THEN 'new' WHEN m.path IS NULL THEN 'deleted'
                       WHEN m.size <> p.size OR m.mtime_us <> p.mtime_us THEN 'changed'
                       WHEN p.md5 IS NULL THEN 'unhashed' ELSE 'reused' END AS change
           FROM manifest m FULL JOIN previous p ON m.path = p.path"""
    ),
    "reuse_digests_contradicting": with_fixture(REUSED_CONTRADICTING, CONTRADICTING),
    "reuse_by_path_contradicting": with_fixture(REUSED_CONTRADICTING, CONTRADICTING),
    "snapshot_changes_contradicting": with_fixture(
        """SELECT coalesce(m.path, p.path) AS path,
                  CASE WHEN p.path IS NULL THEN 'new' WHEN m.path IS NULL THEN 'deleted'
                       WHEN m.size <> p.size OR m.mtime_us <> p.mtime_us THEN 'changed'
                       WHEN p.md5 IS NULL THEN 'unhashed' ELSE 'reused' END AS change
           FROM manifest m FULL JOIN settled p ON m.path = p.path""",
        CONTRADICTING,
    ),
    "inode_profile": with_fixture(
        """SELECT identity, CAST(count(*) AS BIGINT) AS n_paths,
                  CAST(count(md5) AS BIGINT) AS n_hashed,
                  CAST(count(DISTINCT md5) AS BIGINT) AS n_digests, min(path) AS first_path
           FROM merged GROUP BY identity"""
    ),
    "inode_flags": with_fixture(
        """SELECT identity, bool_and(md5 IS NOT NULL) AS all_hashed,
                  bool_or(md5 IS NOT NULL) AS any_hashed, bool_and(md5 IS NULL) AS none_hashed
           FROM merged GROUP BY identity"""
    ),
    "inode_conflicts": with_fixture(
        """SELECT identity, md5, CAST(count(*) AS BIGINT) AS n_paths,
                  (SELECT CAST(count(DISTINCT y.md5) AS BIGINT) FROM merged y
                   WHERE y.identity = x.identity) AS n_digests, min(path) AS first_path
           FROM merged x WHERE md5 IS NOT NULL AND identity IN (
             SELECT identity FROM merged GROUP BY identity HAVING count(DISTINCT md5) > 1)
           GROUP BY identity, md5"""
    ),
    "inode_sync": with_fixture(manifest_of("synced")),
    "inode_sync_fill_only": with_fixture(
        manifest_of(
            "merged",
            """coalesce(md5, CASE WHEN count(DISTINCT md5) OVER (PARTITION BY identity) = 1
                                       AND bool_or(links > 1 AND md5 IS NULL)
                                           OVER (PARTITION BY identity)
                                  THEN max(md5) OVER (PARTITION BY identity) END)""",
        )
    ),
    "affected_rows": with_fixture(
        manifest_of("merged")
        + """ WHERE identity IN (
                SELECT identity FROM merged WHERE links > 1 AND md5 IS NULL)"""
    ),
    "pending_all": with_fixture(manifest_of("synced") + " WHERE md5 IS NULL"),
    "size_groups": with_fixture("SELECT size, n FROM size_counts"),
    "size_groups_exploded": with_fixture(
        f"""SELECT {MANIFEST_COLUMNS}, md5, n FROM synced JOIN size_counts USING (size)
            WHERE md5 IS NULL"""
    ),
    "pending_size_collision": with_fixture(
        manifest_of("synced s") + f" WHERE md5 IS NULL AND {SHARES_SIZE}"
    ),
    "pending_one_per_inode": with_fixture(
        f"""SELECT {MANIFEST_COLUMNS}, md5, identity, n FROM (
              SELECT *, row_number() OVER (PARTITION BY identity ORDER BY path) AS nth,
                     CAST(count(*) OVER (PARTITION BY identity) AS BIGINT) AS n
              FROM synced WHERE md5 IS NULL) WHERE nth = 1"""
    ),
    "apply_digests": with_fixture(manifest_of("merged", "coalesce(md5, content_md5)")),
    "dup_groups": with_fixture(
        """SELECT device, md5, CAST(count(*) AS BIGINT) AS n_paths,
                  CAST(count(DISTINCT identity) AS BIGINT) AS n_objects,
                  max(size) AS size, min(path) AS first_path
           FROM hashed GROUP BY device, md5
           HAVING count(*) > 1 AND count(DISTINCT identity) > 1"""
    ),
    "dup_rows": with_fixture(
        manifest_of("hashed")
        + " WHERE md5 IN (SELECT md5 FROM hashed GROUP BY md5 HAVING count(*) > 1)"
    ),
    "canon_max_links": canon("max_links"),
    "canon_modal_inode": canon("modal_inode"),
    "canon_first_seen": canon("first_seen"),
    "link_plan_max_links": link_plan("max_links"),
    "link_plan_modal_inode": link_plan("modal_inode"),
    "link_plan_first_seen": link_plan("first_seen"),
    "link_plan_two_devices": link_plan("max_links", "far", TWO_DEVICES),
    "link_plan_unknown_device_max_links": link_plan("max_links", "known", UNKNOWN_DEVICE),
    "link_plan_unknown_device_modal_inode": link_plan("modal_inode", "known", UNKNOWN_DEVICE),
    "link_plan_unknown_device_first_seen": link_plan("first_seen", "known", UNKNOWN_DEVICE),
    "apply_link_plan": with_fixture(
        """SELECT path, root, device,
                  CASE WHEN identity <> canonical_identity THEN canonical_inode
                       ELSE inode END AS inode,
                  mode, size, mtime_us, links, md5 FROM members""",
        elected("hashed", "max_links"),
    ),
    "purge_candidates": with_fixture(manifest_of("synced s") + f" WHERE {LISTED}"),
    "purge_survivors": with_fixture(manifest_of("synced s") + f" WHERE NOT {LISTED}"),
    "purge_one_per_inode": with_fixture(
        f"""SELECT {MANIFEST_COLUMNS}, md5 FROM (
              SELECT *, row_number() OVER (PARTITION BY identity ORDER BY path) AS nth
              FROM synced s WHERE {LISTED}) WHERE nth = 1"""
    ),
    "scan_totals": with_fixture(TOTALS + "manifest"),
    "dry_run": with_fixture(TOTALS + "synced WHERE md5 IS NULL"),
    "device_guard": with_fixture(
        """SELECT root, CAST(count(DISTINCT device) AS BIGINT) AS n_devices,
                  min(device) AS lo_device, max(device) AS hi_device FROM far GROUP BY root""",
        TWO_DEVICES,
    ),
    "savings": with_fixture(
        """SELECT CAST(count(*) AS BIGINT) AS n_groups,
                  CAST(coalesce(sum(objects - 1), 0) AS BIGINT) AS n_objects_freed,
                  CAST(coalesce(sum((objects - 1) * size), 0) AS BIGINT) AS n_bytes_freed
           FROM (SELECT count(DISTINCT identity) AS objects, max(size) AS size
                 FROM hashed GROUP BY device, md5 HAVING count(DISTINCT identity) > 1)"""
    ),
    "digest_size_check": with_fixture(
        """SELECT CAST(count(*) AS BIGINT) AS n_ambiguous FROM (
             SELECT md5 FROM hashed GROUP BY md5 HAVING count(DISTINCT size) > 1)"""
    ),
    "digest_size_check_previous": with_fixture(
        """SELECT CAST(count(*) AS BIGINT) AS n_ambiguous FROM (
             SELECT md5 FROM previous WHERE md5 IS NOT NULL
             GROUP BY md5 HAVING count(DISTINCT size) > 1)"""
    ),
    "savings_sure": with_fixture(
        """SELECT CAST(count(*) AS BIGINT) AS n_objects_planned,
                  CAST(count(*) FILTER (paths >= links) AS BIGINT) AS n_objects_surely_freed,
                  CAST(coalesce(sum(size) FILTER (paths >= links), 0) AS BIGINT)
                    AS n_bytes_surely_freed
           FROM (SELECT count(*) AS paths, max(links) AS links, max(size) AS size
                 FROM members WHERE identity <> canonical_identity GROUP BY identity)""",
        elected("hashed", "max_links"),
    ),
    "dry_run_job": with_fixture(
        TOTALS
        + "(SELECT min_by(size, path) AS size FROM synced WHERE md5 IS NULL GROUP BY identity)"
    ),
    "dry_run_job_skip_unique": with_fixture(
        TOTALS
        + f"""(SELECT min_by(size, path) AS size FROM synced s
               WHERE md5 IS NULL AND {SHARES_SIZE} GROUP BY identity)"""
    ),
    "run_summary_skipped": with_fixture(
        """SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(count(md5) AS BIGINT) AS n_saved,
                  CAST(count(*) - count(md5) AS BIGINT) AS n_without_digest,
                  (SELECT CAST(count(*) AS BIGINT) FROM finished h JOIN previous p
                     ON h.path = p.path AND h.size = p.size AND h.mtime_us = p.mtime_us
                   WHERE h.md5 <> p.md5) AS n_mismatches,
                  (SELECT CAST(count(*) AS BIGINT) FROM (
                     SELECT md5 FROM finished WHERE md5 IS NOT NULL GROUP BY device, md5
                     HAVING count(DISTINCT identity) > 1)) AS n_duplicate_groups
           FROM finished""",
        NO_DIGESTS + finished("fresh", SHARES_SIZE),
    ),
    "run_summary": with_fixture(
        """SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(count(md5) AS BIGINT) AS n_saved,
                  CAST(count(*) - count(md5) AS BIGINT) AS n_without_digest,
                  (SELECT CAST(count(*) AS BIGINT) FROM mismatched) AS n_mismatches,
                  (SELECT CAST(count(*) AS BIGINT) FROM (
                     SELECT md5 FROM hashed GROUP BY device, md5
                     HAVING count(DISTINCT identity) > 1)) AS n_duplicate_groups
           FROM hashed"""
    ),
    "report_display": with_fixture(
        f"""SELECT n_files, n_bytes, format('{{:,}}', n_files) AS files_text,
                   {bytes_text("n_bytes")} AS bytes_text
            FROM (SELECT CAST(count(*) * f.fold AS BIGINT) AS n_files,
                         CAST(sum(size) * f.fold AS BIGINT) AS n_bytes
                  FROM manifest, (VALUES (1), (1000003)) f (fold) GROUP BY root, f.fold)"""
    ),
    "job_hash": with_fixture(manifest_of("finished"), finished("synced", "true")),
    "job_hash_refresh": with_fixture(
        manifest_of("finished"), NO_DIGESTS + finished("fresh", "true")
    ),
    "job_hash_skip_unique": with_fixture(
        manifest_of("finished"), finished("synced", SHARES_SIZE)
    ),
    "job_dedupe": with_fixture(PLAN, finished("synced", "true") + elected("finished", "max_links")),
    "job_two_runs": with_fixture(
        manifest_of("twice"), finished("synced", "true") + SECOND_RUN
    ),
    "job_dedupe_modal": with_fixture(
        PLAN, finished("synced", "true") + elected("finished", "modal_inode")
    ),
    "job_dedupe_first_seen": with_fixture(
        PLAN, finished("synced", "true") + elected("finished", "first_seen")
    ),
    "job_dedupe_skip_unique": with_fixture(
        PLAN, finished("synced", SHARES_SIZE) + elected("finished", "max_links")
    ),
    "job_purge": with_fixture(
        manifest_of(f"({FIRST_OF_LISTED})"), finished("synced", "true")
    ),
    "purge_dry_run": with_fixture(
        TOTALS + f"({FIRST_OF_LISTED})", finished("synced", "true")
    ),
    "store_refs": REFS,
    "store_blobs": """SELECT md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size,
                             text AS payload FROM documents GROUP BY text""",
    "store_restore": f"SELECT {DOCUMENT_PATH} AS path, text AS payload FROM documents",
    "stream_first_seen": "SELECT DISTINCT md5(text) AS md5 FROM documents",
    "stream_link_plan": f"""
SELECT md5, path, CAST(NULL AS BIGINT) AS inode, canonical_path,
       CAST(NULL AS BIGINT) AS canonical_inode, size
FROM (SELECT {DOCUMENT_PATH} AS path, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size,
             min({DOCUMENT_PATH}) OVER (PARTITION BY md5(text)) AS canonical_path
      FROM documents)
WHERE path <> canonical_path""",
    "stream_link_plan_batches": with_fixture(
        """SELECT md5, path, inode, canonical_path, canonical_inode, size FROM (
             SELECT *, first_value(path) OVER w AS canonical_path,
                    first_value(inode) OVER w AS canonical_inode,
                    first_value(identity) OVER w AS canonical_identity
             FROM hashed WINDOW w AS (PARTITION BY device, md5 ORDER BY doc_id % 4, path
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
           WHERE identity <> canonical_identity"""
    ),
}

ORACLE["reuse_digests_bucketed"] = ORACLE["reuse_digests"]
ORACLE["job_hash_resumed"] = ORACLE["job_hash"]
ORACLE["run_summary_observed"] = ORACLE["run_summary"]
ORACLE["stream_link_plan_keyed"] = ORACLE["stream_link_plan_batches"]
ORACLE["digest_bins"] = with_fixture(
    """SELECT path, 2 * (start // 20000) + CASE WHEN size + 100 > 20000 THEN 1 ELSE 0 END AS bin,
              size AS bytes
       FROM (SELECT path, size,
                    CAST(coalesce(sum(size + 100) OVER (
                      ORDER BY size, substr(md5(path), 1, 4), path
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
             FROM synced WHERE md5 IS NULL)"""
)
REFCOUNTS = """
SELECT md5, CAST(count(*) FILTER (is_new) AS BIGINT) AS n_refs FROM (
  SELECT md5, false AS is_new FROM previous WHERE md5 IS NOT NULL
  UNION ALL SELECT md5, true FROM hashed WHERE md5 IS NOT NULL) GROUP BY md5"""
ORACLE["store_refcounts"] = with_fixture(REFCOUNTS)
ORACLE["store_garbage"] = with_fixture(f"SELECT md5 FROM ({REFCOUNTS}) WHERE n_refs = 0")
ORACLE["store_upsert"] = """
SELECT md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size, text AS payload
FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL GROUP BY text"""
ORACLE["stream_first_seen_within"] = with_fixture(
    """SELECT DISTINCT md5, minute FROM hashed, (VALUES (0), (60)) t (minute) WHERE md5 IS NOT NULL
       UNION ALL SELECT 'marker', 59"""
)
ORACLE["dup_groups_incremental"] = ORACLE["dup_groups"]
SAVED = """,
first_run AS (SELECT path, size, mtime_us, md5 FROM previous WHERE md5 IS NOT NULL),
second_run AS (SELECT path, size, mtime_us, md5 FROM hashed WHERE doc_id % 4 <> 1),
third_run AS (SELECT path, size, mtime_us, md5 FROM hashed WHERE md5 IS NOT NULL),
saved AS (
  SELECT 1 AS run, '2026-01-01' AS snapshot, * FROM first_run
  UNION ALL SELECT 2, '2026-01-02', * FROM second_run
  UNION ALL SELECT 3, '2026-01-03', * FROM third_run)"""
ORACLE["snapshot_history"] = with_fixture(
    """SELECT path, size, mtime_us, md5, min(snapshot) AS valid_from, max(snapshot) AS valid_to,
              CAST(count(*) AS BIGINT) AS n_snapshots
       FROM (SELECT *, run - row_number() OVER (
                    PARTITION BY path, size, mtime_us, md5 ORDER BY run) AS start FROM saved)
       GROUP BY path, size, mtime_us, md5, start""",
    SAVED,
)
ORACLE["reuse_history"] = with_fixture(
    f"""SELECT {MANIFEST_COLUMNS}, (
          SELECT max_by(s.md5, s.run) FROM saved s
          WHERE s.path = m.path AND s.size = m.size AND s.mtime_us = m.mtime_us AND s.run < 3) AS md5
       FROM manifest m""",
    SAVED,
)
