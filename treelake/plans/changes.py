"""Queries: writes, versions, trees, garbage collection, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.operators import changes as op
from treelake.operators import trees
from treelake.operators.entries import has
from treelake.operators.relations import all_chunks, missing, self_counters, subtree_weights
from treelake.plans.registry import Registry

R = Registry()
add = R.add

# writes
NEW_LINKS = "SELECT catalog, path || '.n' AS path, mtime % 50 AS inode FROM {dirents} WHERE (flags & 4) <> 0 AND uid < 4"


def new_links(t):
    return t.dirents.filter("(flags & 4) <> 0 and uid < 4").select("catalog", F.concat("path", F.lit(".n")).alias("path"), (F.col("mtime") % 50).alias("inode"))


add("up_insert", lambda t: op.inserted(t.refs.filter("type < 2"), t.refs, ["hash"]), "SELECT * FROM {refs}")
add("up_update", lambda t: op.updated(t.dirents.select("path", "catalog", "mode", "mtime"), t.new_tree.select("path", "catalog", "mode", F.lit(5).cast("long").alias("mtime")), ["path", "catalog"], ["mode", "mtime"]), """
    SELECT d.path, d.catalog, coalesce(n.mode, d.mode) AS mode, CASE WHEN n.path IS NULL THEN d.mtime ELSE 5 END AS mtime FROM {dirents} d LEFT JOIN {new_tree} n ON n.path = d.path AND n.catalog = d.catalog""")
add("up_delete", lambda t: op.deleted(t.refs, t.refs.filter("hash < '8'"), ["hash"]), "SELECT * FROM {refs} WHERE hash >= '8'")
add("up_replace", lambda t: op.replaced(t.refs, t.refs.filter("type = 1").withColumn("timestamp", F.lit(7).cast("long")), ["hash"]), "SELECT hash, type, CASE WHEN type = 1 THEN 7 ELSE timestamp END AS timestamp FROM {refs}")
add("up_counter", lambda t: op.counted(t.dirents.select(F.col("catalog").alias("counter"), F.col("size").alias("value")), t.dirents.filter("uid = 1").select(F.col("catalog").alias("counter"), (-F.col("size")).alias("value"))),
    "SELECT catalog AS counter, sum(CASE WHEN uid = 1 THEN 0 ELSE size END)::bigint AS value FROM {dirents} GROUP BY catalog")
add("up_incall", lambda t: t.dirents.select("path", "catalog", F.when(F.col("hardlinks") > 1, F.col("hardlinks") + 1).otherwise(F.col("hardlinks")).alias("hardlinks")), "SELECT path, catalog, CASE WHEN hardlinks > 1 THEN hardlinks + 1 ELSE hardlinks END AS hardlinks FROM {dirents}")
add("up_breaklinks", lambda t: op.broken_hardlinks(t.dirents).select("path", "catalog", "hardlinks"), "SELECT path, catalog, CASE WHEN (flags & 4) <> 0 AND hardlinks > 1 THEN 1 ELSE hardlinks END AS hardlinks FROM {dirents}")
add("up_bulkhash", lambda t: op.without_bulk_hash(t.dirents).select("path", "catalog", "hash"), "SELECT path, catalog, CASE WHEN (flags & 64) = 0 THEN hash END AS hash FROM {dirents}")
add("up_fixstats", lambda t: op.fixed_start(t.stats), "SELECT publish_id, finish_time, CASE WHEN start_time = '' THEN finish_time ELSE start_time END AS start_time, files_added, files_removed, success FROM {stats}")
add("up_prune", lambda t: op.retained(op.fixed_start(t.stats), "2024-06-20 13:00:00", 60), """
    SELECT * FROM (SELECT publish_id, finish_time, CASE WHEN start_time = '' THEN finish_time ELSE start_time END AS start_time, files_added, files_removed, success FROM {stats})
    WHERE NOT start_time::timestamp < timestamp '2024-06-20 00:00:00' - INTERVAL 60 DAY""")
add("up_expire", lambda t: t.leases.filter("expiration >= 1705000000000"), "SELECT * FROM {leases} WHERE expiration >= 1705000000000")
add("up_rollback", lambda t: op.rolled_back(t.tags, "t5", "new", 999999).select("name", "hash", "revision", "branch"), """
    SELECT name, hash, revision, branch FROM {tags} WHERE NOT ((revision > (SELECT revision FROM {tags} WHERE name = 't5') OR name = 't5') AND branch = '')
    UNION ALL SELECT name, 'new', 999999, branch FROM {tags} WHERE name = 't5'""")
NAMED = "SELECT CASE name WHEN 't1' THEN 'trunk' WHEN 't2' THEN 'trunk-previous' ELSE name END AS name, hash, revision FROM {tags}"


def named(t):
    return t.tags.select(F.when(F.col("name") == "t1", "trunk").when(F.col("name") == "t2", "trunk-previous").otherwise(F.col("name")).alias("name"), "hash", "revision")


add("up_undotags", lambda t: op.undo_tags(named(t), "new", 999999), f"""
    SELECT CASE name WHEN 'trunk' THEN 'trunk-previous' ELSE name END AS name, hash, revision FROM ({NAMED}) WHERE name <> 'trunk-previous' UNION ALL SELECT 'trunk', 'new', 999999""")
add("up_move", lambda t: op.moved_tag(t.tags, "t7", "moved").select("name", "hash"), "SELECT name, CASE name WHEN 't7' THEN 'moved' ELSE hash END AS hash FROM {tags}")


def auto(t):
    return t.tags.select(F.concat(F.lit("generic-"), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("name"), "timestamp")


add("up_autotag", lambda t: op.stale_auto_tags(auto(t), 850000000), "SELECT 'generic-' || strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS name, timestamp FROM {tags} WHERE timestamp < 850000000")
def first_dir(t):
    return t.dirents.filter("catalog = '/r1/n1' and (flags & 35) = 1").agg(F.min("path")).first()[0] or "/none"


add("up_partition", lambda t: op.partitioned(t.dirents, first_dir(t)).select("catalog", "path", "flags"), """
    WITH p AS (SELECT min(path) AS p FROM {dirents} WHERE catalog = '/r1/n1' AND (flags & 35) = 1)
    SELECT CASE WHEN path = p OR starts_with(path, p || '/') THEN p ELSE catalog END AS catalog, path, CASE WHEN path = p THEN flags | 32 ELSE flags END AS flags FROM {dirents}, p
    UNION ALL SELECT catalog, path, flags | 2 FROM {dirents}, p WHERE path = p""")
add("up_mergeparent", lambda t: op.merged_into_parent(t.dirents.withColumn("hardlinks", F.when(F.expr("catalog = '' and path = '/r2'"), 3 * 4294967296 + 2).otherwise(F.col("hardlinks"))), "/r1/n1", "").select("catalog", "path", "flags", "hardlinks"), """
    SELECT CASE catalog WHEN '/r1/n1' THEN '' ELSE catalog END AS catalog, path, CASE WHEN path = '/r1/n1' THEN flags & ~2 ELSE flags END AS flags,
      CASE WHEN catalog = '' AND path = '/r2' THEN 12884901890 WHEN catalog = '/r1/n1' AND hardlinks > 4294967296 THEN hardlinks + 12884901888 ELSE hardlinks END AS hardlinks FROM {dirents} WHERE NOT (catalog = '/r1/n1' AND path = '/r1/n1')""")
add("ag_hardgroup", lambda t: op.grouped_hardlinks(t.dirents, new_links(t)).select("catalog", "path", "hardlinks"), f"""
    WITH n AS ({NEW_LINKS}), g AS (SELECT catalog, inode, count(*) AS links FROM n GROUP BY catalog, inode HAVING count(*) > 1),
    k AS (SELECT g.*, row_number() OVER (PARTITION BY g.catalog ORDER BY inode) + (SELECT max(hardlinks // 4294967296) FROM {{dirents}} d WHERE d.catalog = g.catalog) AS id FROM g)
    SELECT n.catalog, n.path, coalesce(id * 4294967296 + links, 1)::bigint AS hardlinks FROM n LEFT JOIN k ON k.catalog = n.catalog AND k.inode = n.inode""")
add("up_shrinkgroup", lambda t: op.shrunk_hardlinks(t.dirents, t.dirents.filter("hardlinks > 1 and gid = 0").select("catalog", "path")).select("catalog", "path", "hardlinks"), """
    SELECT d.catalog, d.path, d.hardlinks - coalesce(n, 0) AS hardlinks FROM {dirents} d
    LEFT JOIN (SELECT catalog, hardlinks // 4294967296 AS g, count(*) AS n FROM {dirents} WHERE hardlinks > 1 AND gid = 0 GROUP BY ALL) x ON x.catalog = d.catalog AND x.g = d.hardlinks // 4294967296 AND x.g > 0
    WHERE NOT (hardlinks > 1 AND gid = 0)""")
add("up_swap", lambda t: op.replaced(t.nested.select("path", "sha1", "size"), t.spark.sql("SELECT '/r1/n1' AS path, 'fresh' AS sha1, cast(9 AS bigint) AS size"), ["path"]), "SELECT path, CASE path WHEN '/r1/n1' THEN 'fresh' ELSE sha1 END AS sha1, CASE path WHEN '/r1/n1' THEN 9 ELSE size END AS size FROM {nested}")
add("up_clone", lambda t: op.cloned(t.dirents, "/r1/n1", "/copy/x").select("path", "parent", "name", "md5path", "flags"), """
    SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, md5(path) AS md5path, flags & ~34 AS flags FROM
      (SELECT '/copy/x' || substring(path, 7) AS path, flags FROM {dirents} WHERE (path = '/r1/n1' OR path LIKE '/r1/n1/%') AND (flags & 32) = 0)""")
add("up_defrag", lambda t: op.defragmented(t.dirents.filter("rowid % 3 <> 0")).select("catalog", "path", "rowid"), "SELECT catalog, path, row_number() OVER (PARTITION BY catalog ORDER BY rowid) AS rowid FROM {dirents} WHERE rowid % 3 <> 0")


def commands(t):
    return t.ticks.select(F.col("event_id").alias("seq"), F.md5(F.concat(F.col("user_id").cast("string"), "event_type")).alias("sha1"),
                                                     F.when(F.col("event_id") % 2 == 0, "touch").when(F.col("event_id") % 9 == 0, "pin").otherwise("unpin").alias("command"))


add("up_quotatouch", lambda t: op.touched(t.cache, commands(t)), """
    WITH k AS (SELECT event_id AS seq, md5(user_id::varchar || event_type) AS sha1, CASE WHEN event_id % 2 = 0 THEN 'touch' WHEN event_id % 9 = 0 THEN 'pin' ELSE 'unpin' END AS command FROM {ticks})
    SELECT c.sha1, c.size, coalesce((SELECT max(seq) FROM k WHERE k.sha1 = c.sha1 AND command = 'touch'), acseq) AS acseq,
      CASE (SELECT arg_max(command, seq) FROM k WHERE k.sha1 = c.sha1 AND command <> 'touch') WHEN 'pin' THEN 1 WHEN 'unpin' THEN 0 ELSE pinned END AS pinned FROM {cache} c""")

# versions
CMP = """SELECT path, name, hardlinks % 4294967296 AS lc, size, mode, mtime, coalesce(mtimens, -1) AS ns, symlink, hash, hardlinks // 4294967296 AS grp, flags FROM {T} WHERE (flags & 2) = 0"""
DIFF = f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'R' ELSE 'M' END AS change,
    CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN CASE WHEN a.lc <> b.lc THEN 2 ELSE 0 END + CASE WHEN a.size <> b.size THEN 4 ELSE 0 END + CASE WHEN a.mode <> b.mode THEN 8 ELSE 0 END
      + CASE WHEN a.mtime <> b.mtime OR a.ns <> b.ns THEN 16 ELSE 0 END + CASE WHEN a.symlink <> b.symlink THEN 32 ELSE 0 END + CASE WHEN a.hash IS DISTINCT FROM b.hash THEN 64 ELSE 0 END
      + CASE WHEN a.grp <> b.grp THEN 128 ELSE 0 END END AS mask, coalesce(b.flags, a.flags) AS flags
    FROM ({CMP.replace('{T}', '{old_tree}')}) a FULL JOIN ({CMP.replace('{T}', '{new_tree}')}) b ON a.path = b.path"""
CHANGED = f"SELECT * FROM ({DIFF}) WHERE change <> 'M' OR mask <> 0"
add("df_tree", lambda t: op.tree_diff(t.old_tree, t.new_tree).select("path", "change"), f"SELECT path, change FROM ({CHANGED})")
add("df_mask", lambda t: op.tree_diff(t.old_tree, t.new_tree).filter("change = 'M'").select("path", "mask"), f"SELECT path, mask FROM ({CHANGED}) WHERE change = 'M'")
add("jn_diff", lambda t: op.tree_diff(t.old_tree, t.new_tree, t.nested.filter("size % 2 = 0")).select("path", "change"), f"""
    SELECT path, change FROM ({CHANGED}) c WHERE NOT EXISTS (SELECT 1 FROM {{nested}} n WHERE n.size % 2 = 0 AND (c.path = n.path OR c.path LIKE n.path || '/%'))""")
add("df_report", lambda t: op.diff_report(op.tree_diff(t.old_tree, t.new_tree)), f"""
    SELECT path, change || ' ' || CASE WHEN (flags & 8) <> 0 THEN 'S' WHEN (flags & 1) <> 0 THEN 'D' ELSE 'F' END || ' ' || CASE WHEN change = 'M' THEN CASE WHEN (mask & 4) <> 0 THEN 'S' ELSE '' END || CASE WHEN (mask & 8) <> 0 THEN 'M' ELSE '' END
      || CASE WHEN (mask & 16) <> 0 THEN 'T' ELSE '' END || CASE WHEN (mask & 64) <> 0 THEN 'C' ELSE '' END ELSE '' END || ' ' || path AS line FROM ({CHANGED})""")
SCENE = """WITH gone AS (SELECT min(path) AS p FROM {dirents} WHERE catalog = '/r1/n1' AND (flags & 35) = 1),
    n AS (SELECT catalog, path, parent, name, CASE WHEN rowid % 29 = 0 AND (flags & 1) = 0 THEN 12 ELSE flags END AS flags, mode, size, mtime, mtimens, hardlinks, hash,
                 CASE WHEN rowid % 29 = 0 AND (flags & 1) = 0 THEN 'to' ELSE symlink END AS symlink, uid, gid, md5path, rowid FROM {new_tree} WHERE NOT EXISTS (SELECT 1 FROM gone WHERE path = p OR starts_with(path, p || '/'))),
    h AS (SELECT * FROM {old_tree} WHERE (flags & 2) = 0 UNION ALL SELECT * FROM (SELECT * FROM {new_tree} WHERE rowid % 17 = 0 AND rowid % 3 = 0 AND (flags & 1) = 0) x
          UNION ALL SELECT catalog, path || '/late', path, 'late', 4, mode, 5, mtime, mtimens, 1, 'late', '', uid, gid, md5path, 0 FROM {old_tree} WHERE (flags & 3) = 1)"""
INSIDE = "(path = '{S}' OR path LIKE '{S}/%')"
THREE_WAY = SCENE + f""", o AS (SELECT * FROM {{old_tree}} WHERE (flags & 2) = 0 AND {INSIDE}), m AS (SELECT * FROM n WHERE (flags & 2) = 0 AND {INSIDE}),
    c AS (SELECT coalesce(o.path, m.path) AS path, o.path IS NULL OR m.path IS NOT NULL AS stays, o.flags & 1 = 1 AND coalesce(m.flags & 1, 0) = 0 AS emptied FROM o FULL JOIN m ON m.path = o.path WHERE o.path IS NULL OR m.path IS NULL
          OR (o.size, o.mode, o.mtime, o.symlink, o.hardlinks, coalesce(o.hash, '')) IS DISTINCT FROM (m.size, m.mode, m.mtime, m.symlink, m.hardlinks, coalesce(m.hash, '')))
    SELECT {{C}} FROM (SELECT * FROM h WHERE NOT {INSIDE} UNION ALL SELECT * FROM m WHERE path IN (SELECT path FROM c WHERE stays)
      UNION ALL SELECT * FROM h WHERE {INSIDE} AND path NOT IN (SELECT path FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE emptied AND starts_with(h.path, c.path || '/'))) x"""


def three_way(t, scope):
    new = t.new_tree.crossJoin(F.broadcast(t.dirents.filter("catalog = '/r1/n1' and (flags & 35) = 1").agg(F.min("path").alias("p")))).filter("p is null or not (path = p or startswith(path, p || '/'))").drop("p")
    link = F.expr("rowid % 29 = 0 and (flags & 1) = 0")
    new = new.withColumns({"flags": F.when(link, 12).otherwise(F.col("flags")), "symlink": F.when(link, "to").otherwise(F.col("symlink"))})
    added = t.new_tree.filter("rowid % 17 = 0 and rowid % 3 = 0 and (flags & 1) = 0")
    late = t.old_tree.filter("(flags & 3) = 1").withColumns({"parent": F.col("path"), "path": F.concat("path", F.lit("/late")), "name": F.lit("late"), "flags": F.lit(4), "size": F.lit(5).cast("long"), "hardlinks": F.lit(1).cast("long"), "hash": F.lit("late"), "symlink": F.lit("")})
    head = t.old_tree.filter(~has(2)).unionByName(added).unionByName(late)
    return op.scoped_merge(head, t.old_tree, new, scope)


add("df_merge", lambda t: three_way(t, "/r1").select("path", "flags", "mode", "size", "hash"), THREE_WAY.replace("{S}", "/r1").replace("{C}", "path, flags, mode, size, hash"))
add("df_commit", lambda t: three_way(t, "/r2/n2").groupBy("catalog").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")), THREE_WAY.replace("{S}", "/r2/n2").replace("{C}", "catalog, count(*) AS entries, sum(size)::bigint AS bytes") + " GROUP BY catalog")
add("rp_counts", lambda t: op.merge_counts(op.tree_diff(t.old_tree, t.new_tree)), f"SELECT change, CASE WHEN (flags & 8) <> 0 THEN 'symlink' WHEN (flags & 1) <> 0 THEN 'directory' ELSE 'file' END AS kind, count(*) AS count FROM ({CHANGED}) GROUP BY ALL")

# traversal
EDGES = "SELECT '' AS parent, '/r' || r_regionkey AS child FROM {region} UNION ALL SELECT '/r' || n_regionkey, '/r' || n_regionkey || '/n' || n_nationkey FROM {nation}"


def edges(t):
    return t.dirents.filter("path <> '' AND path NOT LIKE '%/c%'").select("parent", F.col("path").alias("child")).distinct()


def root(t):
    return t.spark.sql("SELECT '' AS node")


REACH = f"WITH RECURSIVE e AS ({EDGES}), w AS (SELECT '' AS node, 0 AS level UNION ALL SELECT child, level + 1 FROM w JOIN e ON e.parent = w.node)"
add("gr_bfs", lambda t: trees.walk(root(t), edges(t)), f"{REACH} SELECT node, level FROM w")
add("gr_dfs", lambda t: trees.walk(root(t), edges(t)).orderBy(F.desc("level"), "node"), f"{REACH} SELECT node, level FROM w")
add("gr_list", lambda t: trees.walk(t.nested.filter("size < 1005").select(F.col("path").alias("node")), edges(t), 0), "SELECT path AS node, 0 AS level FROM {nested} WHERE size < 1005")
add("gr_tree", lambda t: trees.walk(root(t), edges(t)).join(t.nested, F.col("node") == F.col("path"), "left").select("node", "level", F.concat(F.expr("repeat(' ', level)"), "node").alias("line"), "size"),
    f"{REACH} SELECT node, level, repeat(' ', level) || node AS line, n.size FROM w LEFT JOIN {{nested}} n ON n.path = node")
HIST = """WITH RECURSIVE h AS (SELECT hash, previous, mtime, 0 AS age FROM {revisions} r WHERE depth = (SELECT max(depth) FROM {revisions} x WHERE x.cust = r.cust)
    UNION ALL SELECT r.hash, r.previous, r.mtime, h.age + 1 FROM h JOIN {revisions} r ON r.hash = h.previous WHERE h.age < {D} AND h.mtime >= {M})"""


def heads(t):
    return t.revisions.groupBy("cust").agg(F.max_by("hash", "depth").alias("hash")).select("hash")


hist = lambda d, m: HIST.replace("{D}", str(d)).replace("{M}", str(m))
add("gr_hist", lambda t: trees.history(heads(t), t.revisions, 3, 850000000), f"{hist(3, 850000000)} SELECT hash, age FROM h")
add("gr_chain", lambda t: trees.chain(heads(t), t.revisions), "SELECT hash FROM {revisions}")
add("gr_norepeat", lambda t: trees.history(t.revisions.filter("depth % 2 = 0").select("hash"), t.revisions, 1, 0).groupBy("hash").count().select("hash", F.col("count").alias("n")),
    "SELECT hash, 1 AS n FROM {revisions} WHERE depth % 2 = 0 UNION SELECT previous, 1 FROM {revisions} WHERE depth % 2 = 0")
add("gr_named", lambda t: t.tags.groupBy("hash").agg(F.count("*").alias("tags")), "SELECT hash, count(*) AS tags FROM {tags} GROUP BY hash")
add("gr_missing", lambda t: trees.walk(root(t), edges(t).filter("child <> '/r1'")), f"{REACH} SELECT node, level FROM w WHERE node <> '/r1' AND node NOT LIKE '/r1/%'")
add("gr_descend", lambda t: t.places.select("path", F.col("mount").alias("catalog")).join(t.nested.select(F.col("path").alias("catalog"), "sha1"), "catalog").select("path", "sha1"), "SELECT p.path, n.sha1 FROM {places} p JOIN {nested} n ON p.path LIKE n.path || '/%'")
add("gr_dirtab", lambda t: t.dirents.filter(has(1) & ~has(2) & ~has(32) & F.col("path").rlike("^/r1/n[^/]*/c[^/]*/?$") & ~F.col("path").rlike("^/r1/.*7/?$")).select("path"),
    "SELECT path FROM {dirents} WHERE (flags & 35) = 1 AND regexp_full_match(path, '/r1/n[^/]*/c[^/]*') AND path NOT LIKE '%7'")

# garbage collection and replication
REFD = "SELECT mount AS part, c.hash FROM {places} p JOIN {chunks} c ON c.path = p.path"


def referenced(t):
    return t.places.select(F.col("mount").alias("part"), "path").join(t.chunks.select("path", "hash"), "path").select("part", "hash")


def preserved(t):
    return t.nested.filter("size % 3 <> 0").select(F.col("path").alias("part"))


add("gc_mark", lambda t: referenced(t).join(preserved(t), "part", "left_semi").select("hash").distinct(), f"SELECT DISTINCT hash FROM ({REFD}) WHERE part IN (SELECT path FROM {{nested}} WHERE size % 3 <> 0)")
add("gc_guard", lambda t: preserved(t).agg((F.count("*") > 0).alias("safe")), "SELECT count(*) > 0 AS safe FROM {nested} WHERE size % 3 <> 0")
SWEPT = f"SELECT hash, count(*) AS requests FROM ({REFD}) WHERE part IN (SELECT path FROM {{nested}} WHERE size % 3 = 0) AND hash NOT IN (SELECT hash FROM ({REFD}) WHERE part IN (SELECT path FROM {{nested}} WHERE size % 3 <> 0)) GROUP BY hash"


def sweep(t):
    return trees.swept(referenced(t), preserved(t))


add("gc_sweep", sweep, SWEPT)
add("set_sweep", lambda t: sweep(t).select("hash"), f"SELECT hash FROM ({SWEPT})")
add("gc_bytes", lambda t: sweep(t).join(t.chunks.groupBy("hash").agg(F.min("size").alias("size")), "hash").agg(F.sum("size").alias("bytes")), f"SELECT sum(size)::bigint AS bytes FROM ({SWEPT}) JOIN (SELECT hash AS h, min(size) AS size FROM {{chunks}} GROUP BY hash) ON h = hash")
add("gc_aux", lambda t: t.refs.filter("type = 2 and timestamp < 850000000").join(t.refs.filter("hash < '4'").select("hash"), "hash", "left_anti"), "SELECT * FROM {refs} WHERE type = 2 AND timestamp < 850000000 AND hash >= '4'")
add("set_reflist", lambda t: referenced(t).select("hash").union(t.refs.select("hash")).union(t.nested.select("sha1")).distinct(), f"SELECT hash FROM ({REFD}) UNION SELECT hash FROM {{refs}} UNION SELECT sha1 FROM {{nested}}")
add("set_skip", lambda t: t.refs.select("hash").join(t.refs.filter("type = 0").select("hash"), "hash", "left_anti"), "SELECT hash FROM {refs} WHERE type <> 0")
add("rp_pull", lambda t: missing(all_chunks(t.dirents, t.chunks), t.chunks.filter("o % 2 = 0")), """
    SELECT DISTINCT hash FROM (SELECT hash FROM {dirents} WHERE (flags & 128) = 0 AND hash IS NOT NULL UNION SELECT c.hash FROM {dirents} d JOIN {chunks} c ON c.path = d.path WHERE (flags & 64) <> 0 AND (flags & 128) = 0)
    WHERE hash NOT IN (SELECT hash FROM {chunks} WHERE o % 2 = 0)""")
add("rp_shrink", lambda t: op.tree_diff(t.new_tree, t.old_tree).groupBy("change").count().withColumnRenamed("count", "n"), f"SELECT CASE change WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE 'M' END AS change, count(*) AS n FROM ({CHANGED}) GROUP BY 1")
add("rp_fixup", lambda t: t.dirents.filter(has(2)).join(t.dirents.filter(has(1)).groupBy(F.col("parent").alias("path")).count(), "path", "left").select("path", (F.coalesce("count", F.lit(0)) + 2).alias("linkcount")),
    "SELECT d.path, (SELECT count(*) FROM {dirents} k WHERE k.parent = d.path AND (k.flags & 1) <> 0) + 2 AS linkcount FROM {dirents} d WHERE (d.flags & 2) <> 0")

# checks
BROKEN = "SELECT path, catalog, CASE WHEN rowid % 29 = 0 THEN '' ELSE name END AS name, flags, CASE WHEN rowid % 31 = 0 THEN -1 ELSE size END AS size, hardlinks, CASE WHEN rowid % 37 = 0 THEN NULL ELSE hash END AS hash, symlink, mtimens FROM {dirents}"


def broken(t):
    return t.dirents.withColumns({"name": F.when(F.col("rowid") % 29 == 0, "").otherwise(F.col("name")), "size": F.when(F.col("rowid") % 31 == 0, F.lit(-1).cast("long")).otherwise(F.col("size")), "hash": F.when(F.col("rowid") % 37 == 0, None).otherwise(F.col("hash"))})


add("ck_entries", lambda t: trees.entry_violations(broken(t)), f"""
    WITH d AS ({BROKEN}) SELECT path, catalog, 'empty name' AS rule FROM d WHERE name = '' AND path <> '' UNION ALL SELECT path, catalog, 'file without content' FROM d WHERE (flags & 4) <> 0 AND (flags & 72) = 0 AND hash IS NULL
    UNION ALL SELECT path, catalog, 'symlink size' FROM d WHERE (flags & 8) <> 0 AND size <> length(symlink) UNION ALL SELECT path, catalog, 'negative size' FROM d WHERE size < 0""")
add("ck_chunks", lambda t: trees.chunk_violations(t.dirents, t.chunks.filter("o % 50 <> 0 or n <> 2")), """
    SELECT d.path, coalesce(c.n_chunks, 0) AS n_chunks, coalesce(c.gaps, 0) AS gaps, coalesce(c.total, 0) AS total, d.size, coalesce(c.n_chunks > 0 AND c.gaps = 0 AND c.total = d.size, false) AS ok FROM {dirents} d LEFT JOIN
      (SELECT path, count(*) AS n_chunks, count(*) FILTER (off <> coalesce(prev, 0)) AS gaps, sum(size)::bigint AS total FROM (SELECT *, lag(off + size) OVER (PARTITION BY path ORDER BY off) AS prev FROM {chunks} WHERE o % 50 <> 0 OR n <> 2) GROUP BY path) c
    ON c.path = d.path WHERE (d.flags & 64) <> 0""")
add("ck_links", lambda t: trees.group_violations(t.dirents).select("parent", "grp", "members", "linkcount", "equal"), """
    SELECT * FROM (SELECT parent, hardlinks // 4294967296 AS grp, count(*) AS members, max(hardlinks % 4294967296) AS linkcount, min(size) = max(size) AS equal FROM {dirents} WHERE hardlinks >= 4294967296 GROUP BY catalog, parent, grp)
    WHERE members <> linkcount OR NOT equal""")
add("ck_counters", lambda t: self_counters(t.dirents).select("catalog", "regular").join(self_counters(t.new_tree).select("catalog", F.col("regular").alias("stored")), "catalog", "full_outer").filter(~F.col("regular").eqNullSafe(F.col("stored"))), """
    SELECT a.catalog, a.n AS regular, b.n AS stored FROM (SELECT catalog, count(*) FILTER ((flags & 4) <> 0 AND (flags & 8) = 0) AS n FROM {dirents} GROUP BY 1) a
    FULL JOIN (SELECT catalog, count(*) FILTER ((flags & 4) <> 0 AND (flags & 8) = 0) AS n FROM {new_tree} GROUP BY 1) b ON a.catalog = b.catalog WHERE a.n IS DISTINCT FROM b.n""")
add("ck_transition", lambda t: trees.transition_violations(t.dirents.withColumn("mode", F.when(has(2) & (F.col("rowid") % 2 == 0), 0).otherwise(F.col("mode")))), "SELECT path FROM {dirents} WHERE (flags & 2) <> 0 AND rowid % 2 = 0 AND mode <> 0")
add("ck_reflog", lambda t: t.nested.select(F.col("sha1").alias("hash")).join(t.refs.select("hash"), "hash", "left_anti"), "SELECT sha1 AS hash FROM {nested} WHERE sha1 NOT IN (SELECT hash FROM {refs})")
add("ck_scrub", lambda t: t.documents.select("doc_id", F.sha1("text").alias("found"), F.when(F.col("doc_id") % 9 == 0, F.lit("x")).otherwise(F.sha1("text")).alias("name")).filter("found <> name or not name rlike '^[0-9a-f]{40}$'"), "SELECT doc_id, sha1(text) AS found, 'x' AS name FROM {documents} WHERE doc_id % 9 = 0")
add("ck_cachefsck", lambda t: t.objects.withColumn("size", F.when(F.col("source") == "src1", F.col("size") + 1).otherwise(F.col("size"))).join(t.documents.select("doc_id", F.md5("text").alias("again"), F.length("text").cast("long").alias("n")), "doc_id").filter("hash <> again or size <> n").select("doc_id", "size", "n"), "SELECT doc_id, n_chars + 1 AS size, length(text) AS n FROM {documents} WHERE source = 'src1' AND n_chars + 1 <> length(text)")
add("ck_manifest", lambda t: t.tags.agg(F.max("revision").alias("revision"), F.max_by("hash", "revision").alias("root"), (F.count_if(F.col("branch") != "") > 0).alias("has_branches")), "SELECT max(revision) AS revision, arg_max(hash, revision) AS root, count(*) FILTER (branch <> '') > 0 AS has_branches FROM {tags}")

# balancing
add("bl_balance", lambda t: trees.balanced(subtree_weights(t.dirents).filter("path rlike '/c[0-9]+$'").select(F.regexp_replace("path", "/[^/]*$", "").alias("group"), F.col("path").alias("name"), "weight"), 30, 10), """
    WITH c AS (SELECT parent AS "group", d.path AS name, 1 + (SELECT count(*) FROM {dirents} k WHERE k.parent = d.path AND k.catalog = d.catalog) AS weight FROM {dirents} d WHERE regexp_matches(path, '/c[0-9]+$')),
    w AS (SELECT *, 1 + sum(weight) OVER (PARTITION BY "group") - coalesce(sum(weight - 1) OVER (PARTITION BY "group" ORDER BY weight DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM c)
    SELECT "group", name, weight FROM w WHERE l > 30 AND weight >= 10""")


def directories(t):
    """Directories of the partitions as one tree, from one pass over the entries: a partition's root stands for its mount point."""
    place = F.when(has(1), F.col("path")).otherwise(F.col("parent")).alias("path")
    d = t.dirents.filter(~has(2)).groupBy(place).agg(F.max(F.when(has(1), F.col("parent"))).alias("parent"), F.count_if(has(1)).alias("dirs"), F.count_if(~has(1)).alias("files"))
    return d.filter("dirs > 0").select("path", "parent", (F.col("files") + 1).alias("entries"), F.lit(False).alias("mount"))


add("bl_cascade", lambda t: trees.balanced_tree(directories(t), 300, 10))
add("bl_limit", lambda t: t.dirents.groupBy("catalog").count().filter(F.col("count") > 60).select("catalog", F.col("count").alias("entries")), "SELECT catalog, count(*) AS entries FROM {dirents} GROUP BY catalog HAVING count(*) > 60")
add("bl_dirty", lambda t: trees.dirty_partitions(t.nested.filter("size < 1003").select(F.col("path").alias("catalog"))), "SELECT path AS catalog FROM {nested} WHERE size < 1003 UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM {nested} WHERE size < 1003 UNION SELECT ''")
add("lm_size", lambda t: t.dirents.filter(F.col("size") > 200).filter(has(4)).select("path", "size"), "SELECT path, size FROM {dirents} WHERE size > 200 AND (flags & 4) <> 0")
QUERIES, SQL = R.queries, R.sql
