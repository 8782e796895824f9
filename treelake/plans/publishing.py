"""Queries: publishing, leases, archives and verified objects."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import functions as F

from treelake.operators import publishing as op
from treelake.plans.registry import Registry
from treelake.plans.relations import SELF, SUBTREE, op as relations
from treelake.sources import archives

R = Registry()
add = R.add

BASE = "SELECT path, flags FROM {dirents} WHERE (flags & 2) = 0 AND (rowid % 7 <> 0 OR (flags & 1) <> 0)"
OVERLAY = """SELECT path, parent, CASE WHEN rowid % 13 = 0 THEN 4 ELSE flags END AS flags, mtime % 50 AS inode, mtime % 3 + 1 AS linkcount, rowid % 11 = 0 AS whiteout,
    rowid % 9 = 0 AND rowid % 13 <> 0 AND (flags & 1) <> 0 AS opaque FROM {dirents} WHERE (flags & 2) = 0 AND path <> '' AND (rowid % 5 = 0 OR rowid % 7 = 0 OR rowid % 11 = 0 OR rowid % 13 = 0)"""


def worktree(t):
    return op.worktree_changes(t.spark.sql(BASE, dirents=t.dirents), t.spark.sql(OVERLAY, dirents=t.dirents))


add("df_worktree", worktree, f"""
    WITH b AS ({BASE}), o AS ({OVERLAY}),
    e AS (SELECT o.path FROM o JOIN b ON b.path = o.path WHERE (b.flags & 1) <> 0 AND (o.whiteout OR o.opaque OR (o.flags & 1) = 0)),
    l AS (SELECT DISTINCT b.path FROM b JOIN e ON starts_with(b.path, e.path || '/')),
    x AS (SELECT coalesce(b.path, o.path) AS path, o.parent, o.inode, CASE
        WHEN b.path IS NOT NULL AND o.path IS NOT NULL AND NOT o.whiteout THEN CASE WHEN (b.flags & 1) <> 0 AND (o.flags & 1) <> 0 AND NOT o.opaque AND l.path IS NULL THEN 'touch' ELSE 'replace' END
        WHEN b.path IS NULL THEN CASE WHEN NOT o.whiteout THEN 'add' END
        WHEN o.whiteout OR l.path IS NOT NULL THEN 'remove' END AS action, coalesce((o.flags & 1) = 0 AND o.linkcount > 1, false) AS linked
      FROM b FULL JOIN o ON o.path = b.path LEFT JOIN l ON l.path = b.path)
    SELECT path, action, CASE WHEN linked AND action IN ('add', 'replace') THEN count(*) OVER (PARTITION BY parent, inode, linked AND action IN ('add', 'replace')) ELSE 1 END AS links FROM x WHERE action IS NOT NULL""")

EARLIER = "SELECT path AS catalog, sha1 AS digest, size AS revision FROM {nested} WHERE size % 3 <> 0"
BITS = "concat_ws('|', path, flags, mode, size, mtime, coalesce(hash, '-'), symlink, uid, gid, hardlinks)"
add("snk_catalog", lambda t: op.catalog_headers(t.dirents, t.spark.sql(EARLIER, nested=t.nested)), f"""
    SELECT c.catalog, md5(concat_ws('|', c.catalog, entries, bits)) AS digest, coalesce(e.revision, 0) + 1 AS revision, e.digest AS previous, last_modified, entries, file_size
    FROM (SELECT catalog, bit_xor(('0x' || substring(md5({BITS}), 1, 15))::bigint) AS bits, count(*) AS entries, max(mtime) AS last_modified,
            sum(CASE WHEN (flags & 4) <> 0 AND (flags & 8) = 0 THEN size ELSE 0 END)::bigint AS file_size FROM {{dirents}} GROUP BY catalog) c
    LEFT JOIN ({EARLIER}) e ON e.catalog = c.catalog""")

OWNERS = "SELECT cast(n_nationkey AS int) AS old, cast(n_nationkey + 1000 AS int) AS new FROM {nation} WHERE n_nationkey % 2 = 0"
add("up_migrate", lambda t: op.migrated(t.dirents, t.spark.sql(OWNERS, nation=t.nation))[0].select("catalog", "path", "uid", "hash", "hardlinks"), f"""
    SELECT catalog, path, coalesce(o.new, uid) AS uid, CASE WHEN (flags & 64) <> 0 THEN NULL ELSE hash END AS hash,
      CASE WHEN (flags & 4) <> 0 AND hardlinks > 1 THEN 1 ELSE hardlinks END AS hardlinks FROM {{dirents}} LEFT JOIN ({OWNERS}) o ON o.old = uid""")
UNPIVOT = f"ON {', '.join(relations.COUNTERS)} INTO NAME counter VALUE value"
add("up_migrate_counters", lambda t: op.migrated(t.dirents, t.spark.sql(OWNERS, nation=t.nation))[1], f"""
    WITH own AS ({SELF}), sub AS ({SUBTREE})
    SELECT catalog, counter, sum(value)::bigint AS value FROM (SELECT * FROM (UNPIVOT own {UNPIVOT}) UNION ALL SELECT * FROM (UNPIVOT sub {UNPIVOT})) GROUP BY ALL""")

add("src_fetch", lambda t: op.verified(t.documents.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.sha1(F.concat("text", F.lit("x")))).otherwise(F.sha1("text")).alias("hash"), F.col("text").alias("content"))).select("doc_id", "hash", "ok"), """
    SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN sha1(text || 'x') ELSE sha1(text) END AS hash, text IS NOT NULL AND doc_id % 9 <> 0 AS ok FROM {documents}""")


def lease_requests(t):
    action = F.when(F.col("event_id") % 4 == 3, "commit").when(F.col("event_id") % 4 == 2, "cancel").otherwise("new")
    token = F.when(action == "commit", F.col("event_id") - 3).when(action == "cancel", F.col("event_id") - 1).otherwise(F.col("event_id"))
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("/"), "event_type")))
    return t.ticks.select(F.col("event_id").alias("seq"), (F.col("t") * 1000).alias("t"), F.concat(F.lit("repo"), (F.col("user_id") % 3).cast("string")).alias("repository"),
                          path.alias("path"), action.alias("action"), token.cast("string").alias("token"))


add("st_lease", lambda t: op.replayed_leases(lease_requests(t), 3_600_000))


def one_archive(text: str | None) -> bytes:
    """A tar archive of a text: a directory, the text and a link to it."""
    data, buffer = (text or "").encode(), io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name, kind, size, link in (("./d/", tarfile.DIRTYPE, 0, ""), ("./d/text", tarfile.REGTYPE, len(data), ""), ("d/again", tarfile.LNKTYPE, 0, "./d/text")):
            head = tarfile.TarInfo(name)
            head.type, head.size, head.linkname = kind, size, link
            tar.addfile(head, io.BytesIO(data))
    return buffer.getvalue()


add("src_tar", lambda t: archives.tar_entries(t.documents.select(F.col("doc_id").cast("string").alias("archive"), F.udf(one_archive, "binary", useArrow=False)("text").alias("content")), "/base").select("archive", "path", "kind", "size", "target"), """
    SELECT doc_id::varchar AS archive, '/base/' || m.path AS path, m.kind AS kind, CASE WHEN m.kind = 'file' THEN coalesce(strlen(text), 0) ELSE 0 END AS size, CASE WHEN m.kind = 'hardlink' THEN '/base/d/text' ELSE '' END AS target
    FROM {documents}, (VALUES ('d', 'directory'), ('d/text', 'file'), ('d/again', 'hardlink')) m(path, kind)""")

QUERIES, SQL = R.queries, R.sql
