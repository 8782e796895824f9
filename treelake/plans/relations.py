"""Queries: joins, aggregates, orderings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.operators import relations as op
from treelake.operators.entries import has
from treelake.plans.registry import Registry

R = Registry()
add = R.add

# joins
add("jn_dangling", lambda t: op.dangling_mounts(t.dirents.withColumn("catalog", F.when(F.col("parent") == "/r1/n1", "").otherwise(F.col("catalog")))).select("catalog", "path"),
    "SELECT '' AS catalog, '/r1/n1' AS path FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM {dirents} WHERE parent = '/r1/n1')")
add("jn_hashes", lambda t: op.content_hashes(t.dirents, t.chunks), """
    SELECT hash, 0 AS is_chunk FROM {dirents} WHERE (flags & 128) = 0 AND hash IS NOT NULL
    UNION SELECT c.hash, 1 FROM {dirents} d JOIN {chunks} c ON c.path = d.path WHERE (flags & 128) = 0""")
add("jn_allchunks", lambda t: op.all_chunks(t.dirents, t.chunks), """
    SELECT hash, CASE WHEN flags & 1 = 1 THEN 'L' ELSE '' END AS kind, ((flags >> 8) & 7) + 1 AS algorithm, (flags >> 11) & 7 AS compression FROM {dirents} WHERE (flags & 128) = 0 AND hash IS NOT NULL
    UNION SELECT c.hash, 'P', ((flags >> 8) & 7) + 1, (flags >> 11) & 7 FROM {dirents} d, {chunks} c WHERE c.path = d.path AND (flags & 64) <> 0 AND (flags & 128) = 0""")
add("jn_dirlink", lambda t: op.directory_links(t.dirents), """
    SELECT d.catalog, d.path, count(k.path) + 2 AS linkcount FROM {dirents} d LEFT JOIN {dirents} k ON k.catalog = d.catalog AND k.parent = d.path AND (k.flags & 1) <> 0
    WHERE (d.flags & 1) <> 0 GROUP BY d.catalog, d.path""")


def inodes(t):
    return t.dirents.filter("(flags & 4) <> 0").select((F.col("mtime") % 5000).alias("inode"), "path", "parent")


INODES = "(SELECT mtime % 5000 AS inode, path, parent FROM {dirents} WHERE (flags & 4) <> 0)"
add("jn_hlscratch", lambda t: op.hardlink_candidates(inodes(t)), f"SELECT DISTINCT a.inode, a.path FROM {INODES} a JOIN {INODES} b ON a.inode = b.inode AND a.path <> b.path")
add("jn_hlgroup", lambda t: op.hardlink_groups(inodes(t)), f"SELECT inode, count(*) AS members, count(DISTINCT parent) = 1 AS supported FROM {INODES} GROUP BY inode HAVING count(*) > 1")
add("jn_migmeta", lambda t: t.dirents.select("path", "catalog", "mode", "hardlinks").join(op.directory_links(t.dirents), ["catalog", "path"], "left").join(
        t.nested.select("path", "sha1"), "path", "left").select("path", "catalog", F.coalesce("sha1", F.lit("")).alias("nested"), F.coalesce("linkcount", F.col("hardlinks").bitwiseAND(F.lit(4294967295))).alias("linkcount"), F.shiftright("mode", 6).alias("owner_bits")), """
    SELECT d.path, d.catalog, coalesce(n.sha1, '') AS nested, coalesce(l.linkcount, hardlinks % 4294967296) AS linkcount, mode >> 6 AS owner_bits FROM {dirents} d
    LEFT JOIN (SELECT a.catalog, a.path, count(k.path) + 2 AS linkcount FROM {dirents} a LEFT JOIN {dirents} k ON k.catalog = a.catalog AND k.parent = a.path AND (k.flags & 1) <> 0
               WHERE (a.flags & 1) <> 0 GROUP BY a.catalog, a.path) l ON l.catalog = d.catalog AND l.path = d.path
    LEFT JOIN {nested} n ON n.path = d.path""")
USED = "SELECT DISTINCT branch FROM {tags} WHERE branch IN ('b0', 'b4', 'b12', 'b16')"
add("jn_prune", lambda t: op.prune_branches(t.branches, t.tags.filter(F.col("branch").isin("b0", "b4", "b12", "b16")).select("branch").distinct()), f"""
    WITH RECURSIVE kept AS (SELECT branch FROM {{branches}} WHERE parent IS NULL UNION {USED}),
    up AS (SELECT branch, parent, initial_revision FROM {{branches}} WHERE branch IN (SELECT branch FROM kept)
           UNION ALL SELECT u.branch, b.parent, u.initial_revision FROM up u JOIN {{branches}} b ON b.branch = u.parent WHERE u.parent NOT IN (SELECT branch FROM kept))
    SELECT branch, parent, initial_revision FROM up WHERE parent IS NULL OR parent IN (SELECT branch FROM kept)""")
add("jn_notin", lambda t: t.branches.join(t.tags.select("branch"), "branch", "left_semi"), "SELECT * FROM {branches} WHERE branch IN (SELECT DISTINCT branch FROM {tags})")
add("jn_scalar", lambda t: t.dirents.join(F.broadcast(t.dirents.filter("hardlinks > 1").agg(F.min_by("hardlinks", "path").alias("hardlinks"))), "hardlinks", "left_semi").select("path", (F.col("hardlinks") + 1).alias("hardlinks")),
    "SELECT path, hardlinks + 1 AS hardlinks FROM {dirents} WHERE hardlinks = (SELECT hardlinks FROM {dirents} WHERE hardlinks > 1 ORDER BY path LIMIT 1)")
add("jn_lru1", lambda t: t.cache.filter("pinned <> 2").orderBy("acseq").limit(1), "SELECT * FROM {cache} WHERE acseq = (SELECT min(acseq) FROM {cache} WHERE pinned <> 2)")
ASKED = "SELECT 'repo0' AS repository, '/u3/click' AS path UNION ALL SELECT 'repo1', '/u1' UNION ALL SELECT 'repo2', '/u2/view/x'"
add("jn_lease", lambda t: op.overlapping_text(t.leases, t.spark.sql(ASKED)), f"""
    SELECT l.*, a.path AS asked FROM {{leases}} l JOIN ({ASKED}) a ON a.repository = l.repository WHERE starts_with(a.path, l.path) OR starts_with(l.path, a.path)""")
add("jn_pathoverlap", lambda t: op.overlapping_paths(t.leases, t.spark.sql(ASKED)), f"""
    SELECT DISTINCT l.*, a.path AS asked FROM {{leases}} l JOIN ({ASKED}) a ON a.repository = l.repository
    WHERE starts_with(a.path || '/', l.path || '/') OR starts_with(l.path || '/', a.path || '/')""")
add("jn_snapsync", lambda t: op.synchronised(t.tags.filter("revision % 7 <> 0"), t.tags.filter("revision % 5 <> 0").withColumn("hash", F.when(F.col("revision") % 11 == 0, "x").otherwise(F.col("hash")))), """
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'insert' WHEN a.name IS NULL THEN 'remove' ELSE 'replace' END AS action
    FROM (SELECT * FROM {tags} WHERE revision % 7 <> 0) a FULL JOIN (SELECT name, CASE WHEN revision % 11 = 0 THEN 'x' ELSE hash END AS hash FROM {tags} WHERE revision % 5 <> 0) b ON a.name = b.name
    WHERE a.name IS NULL OR b.name IS NULL OR a.hash <> b.hash""")
add("jn_exists", lambda t: op.missing(t.chunks, t.chunks.filter("o % 3 = 0")), "SELECT DISTINCT hash FROM {chunks} WHERE hash NOT IN (SELECT hash FROM {chunks} WHERE o % 3 = 0)")


def manifests(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_set("l_suppkey").alias("layers"))


add("jn_layers", lambda t: op.unused_layers(t.lineitem.filter("l_orderkey < 100").groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_set("l_partkey").alias("layers")), t.part.select(F.col("p_partkey").alias("layer"))),
    "SELECT p_partkey AS layer FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_orderkey < 100)")
add("jn_backlink", lambda t: op.backlink_counts(manifests(t)),
    "SELECT l_suppkey AS layer, count(DISTINCT l_orderkey) AS images, min(l_orderkey) AS first FROM {lineitem} GROUP BY l_suppkey")
add("jn_idmap", lambda t: op.mapped_ids(t.dirents, t.spark.sql("SELECT * FROM VALUES (1, 1001), (2, 1002) AS m(old, new)"), 99),
    "SELECT path, CASE uid WHEN 1 THEN 1001 WHEN 2 THEN 1002 ELSE 99 END AS uid FROM {dirents}")
add("jn_flat", lambda t: op.missing(t.nested.select(F.col("sha1").alias("hash")), t.nested.filter("size % 2 = 0").select(F.col("sha1").alias("hash"))), "SELECT sha1 AS hash FROM {nested} WHERE size % 2 <> 0")

# aggregates
add("ag_count", lambda t: t.dirents.agg(F.count("*").alias("n")).withColumn("what", F.lit("dirents")).union(t.chunks.agg(F.count("*")).withColumn("what", F.lit("chunks"))).union(t.tags.agg(F.count("*")).withColumn("what", F.lit("tags"))).union(t.refs.agg(F.count("*")).withColumn("what", F.lit("refs"))),
    "SELECT count(*) AS n, 'dirents' AS what FROM {dirents} UNION ALL SELECT count(*), 'chunks' FROM {chunks} UNION ALL SELECT count(*), 'tags' FROM {tags} UNION ALL SELECT count(*), 'refs' FROM {refs}")
add("ag_chunkcount", lambda t: t.chunks.groupBy("path").count().withColumnRenamed("count", "n"), "SELECT path, count(*) AS n FROM {chunks} GROUP BY path")
FILE = "(flags & 4) <> 0 AND (flags & 8) = 0 AND (flags & 16) = 0"
SELF = f"""SELECT catalog, count(*) FILTER ({FILE}) AS regular, count(*) FILTER ((flags & 8) <> 0) AS symlink, count(*) FILTER ((flags & 16) <> 0) AS special,
    count(*) FILTER ((flags & 1) <> 0 AND (flags & 2) = 0) AS dir, count(*) FILTER ((flags & 2) <> 0) AS nested, count(*) FILTER ((flags & 64) <> 0) AS chunked,
    coalesce(sum(size) FILTER ({FILE}), 0)::bigint AS file_size, coalesce(sum(size) FILTER ((flags & 64) <> 0), 0)::bigint AS chunked_size,
    count(*) FILTER ((flags & 128) <> 0) AS external, coalesce(sum(size) FILTER ((flags & 128) <> 0), 0)::bigint AS external_file_size FROM {{dirents}} GROUP BY catalog"""
SUBTREE = f"""SELECT a.catalog, {', '.join(f'coalesce(sum(b.{c}), 0)::bigint AS {c}' for c in op.COUNTERS)} FROM own a
    LEFT JOIN own b ON b.catalog <> a.catalog AND starts_with(b.catalog || '/', a.catalog || '/') GROUP BY a.catalog"""
add("ag_self", lambda t: op.self_counters(t.dirents), SELF)
add("ag_numchunks", lambda t: op.self_counters(t.dirents).select("catalog", (F.col("regular") + F.col("chunked")).alias("n")), f"SELECT catalog, regular + chunked AS n FROM ({SELF})")
add("ag_subtree", lambda t: op.subtree_counters(op.self_counters(t.dirents)), f"WITH own AS ({SELF}) {SUBTREE}")
add("ag_total", lambda t: op.total_counters(own := op.self_counters(t.dirents), op.subtree_counters(own)), f"""
    WITH own AS ({SELF}), sub AS ({SUBTREE}) SELECT catalog, counter, sum(value)::bigint AS value FROM (
      SELECT * FROM (UNPIVOT own ON {', '.join(op.COUNTERS)} INTO NAME counter VALUE value) UNION ALL SELECT * FROM (UNPIVOT sub ON {', '.join(op.COUNTERS)} INTO NAME counter VALUE value)) GROUP BY ALL""")
add("ag_diff", lambda t: op.unpivoted(op.self_counters(t.new_tree)).withColumnRenamed("value", "b").join(op.unpivoted(op.self_counters(t.old_tree)), ["catalog", "counter"]).select("catalog", "counter", (F.col("b") - F.col("value")).alias("change")), f"""
    WITH a AS ({SELF.replace('{dirents}', '{old_tree}')}), b AS ({SELF.replace('{dirents}', '{new_tree}')})
    SELECT y.catalog, y.counter, y.value - x.value AS change FROM (UNPIVOT a ON {', '.join(op.COUNTERS)} INTO NAME counter VALUE value) x
    JOIN (UNPIVOT b ON {', '.join(op.COUNTERS)} INTO NAME counter VALUE value) y ON x.catalog = y.catalog AND x.counter = y.counter""")
add("ag_merge", lambda t: op.self_counters(t.dirents).select(F.when(F.col("catalog") == "/r1/n1", "").otherwise(F.col("catalog")).alias("catalog"), "regular", "file_size").groupBy("catalog").agg(F.sum("regular").alias("regular"), F.sum("file_size").alias("file_size")),
    f"SELECT CASE catalog WHEN '/r1/n1' THEN '' ELSE catalog END AS catalog, sum(regular)::bigint AS regular, sum(file_size)::bigint AS file_size FROM ({SELF}) GROUP BY 1")
add("ag_maxlink", lambda t: t.dirents.agg(F.shiftright(F.max("hardlinks"), 32).alias("group")), "SELECT max(hardlinks) // 4294967296 AS \"group\" FROM {dirents}")
add("ag_waste", lambda t: t.dirents.filter("rowid % 3 <> 0").groupBy("catalog").agg((1.0 - F.count("*") / F.max("rowid")).alias("waste")), "SELECT catalog, 1.0::double - count(*)::double / max(rowid) AS waste FROM {dirents} WHERE rowid % 3 <> 0 GROUP BY catalog")
add("ag_mig20_stats", lambda t: t.dirents.groupBy("catalog").agg(F.count("*").alias("entries"), F.max("rowid").alias("top")), "SELECT catalog, count(*) AS entries, max(rowid) AS top FROM {dirents} GROUP BY catalog")
add("ag_kind", lambda t: op.kinds(t.dirents, t.chunks), f"""
    SELECT count(*) FILTER ({FILE}) AS regular, sum(size) FILTER ({FILE})::bigint AS regular_size, count(*) FILTER ((flags & 128) <> 0) AS external, sum(size) FILTER ((flags & 128) <> 0)::bigint AS external_size,
    count(*) FILTER ((flags & 8) <> 0) AS symlink, count(*) FILTER ((flags & 16) <> 0) AS special, count(*) FILTER ((flags & 64) <> 0) AS chunked, sum(size) FILTER ((flags & 64) <> 0)::bigint AS chunked_size,
    count(*) FILTER ((flags & 1) <> 0) AS dir, (SELECT count(*) FROM {{chunks}}) AS blobs, (SELECT sum(size)::bigint FROM {{chunks}}) AS blob_size FROM {{dirents}}""")
add("ag_filestats", lambda t: t.dirents.filter(has(4) & ~has(8)).groupBy("catalog").agg(F.countDistinct("hash").alias("objects"), F.count("*").alias("files")).join(
        t.dirents.groupBy("catalog").agg(F.count("*").alias("entries"), F.sum(F.when(has(8), F.length("symlink")).otherwise(0)).cast("long").alias("symlink_length")), "catalog", "right"), """
    SELECT d.catalog, f.objects, f.files, d.entries, d.symlink_length FROM (SELECT catalog, count(*) AS entries, sum(CASE WHEN (flags & 8) <> 0 THEN length(symlink) ELSE 0 END)::bigint AS symlink_length FROM {dirents} GROUP BY catalog) d
    LEFT JOIN (SELECT catalog, count(DISTINCT hash) AS objects, count(*) AS files FROM {dirents} WHERE (flags & 4) <> 0 AND (flags & 8) = 0 GROUP BY catalog) f ON f.catalog = d.catalog""")
add("ag_dedup", lambda t: t.objects.groupBy("hash").agg(F.min("size").alias("size"), F.count("*").alias("files")), "SELECT hash, min(size) AS size, count(*) AS files FROM {objects} GROUP BY hash")
add("ag_cachesum", lambda t: t.cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("gauge"), F.coalesce(F.sum(F.when(F.col("pinned") != 0, F.col("size"))), F.lit(0)).alias("pinned")),
    "SELECT coalesce(sum(size), 0)::bigint AS gauge, coalesce(sum(size) FILTER (pinned <> 0), 0)::bigint AS pinned FROM {cache}")
add("ag_maxseq", lambda t: t.cache.agg(F.coalesce(F.max(F.col("acseq").bitwiseAND(F.lit((1 << 63) - 1))), F.lit(0)).alias("seq")), "SELECT coalesce(max(acseq & 9223372036854775807), 0) AS seq FROM {cache}")
WEIGHT = """SELECT d.catalog, d.path, CASE WHEN (d.flags & 2) <> 0 THEN 1 ELSE count(*) END AS weight FROM {dirents} d
    JOIN {dirents} e ON e.catalog = d.catalog AND starts_with(e.path || '/', d.path || '/') WHERE (d.flags & 1) <> 0 GROUP BY d.catalog, d.path, d.flags"""
add("ag_weight", lambda t: op.subtree_weights(t.dirents), WEIGHT)
add("ag_hashlist", lambda t: op.chunk_list_hash(t.chunks), "SELECT path, sha1(unhex(string_agg(hash, '' ORDER BY off, hash))) AS digest FROM {chunks} GROUP BY path")
add("ag_hitrate", lambda t: t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("d"), F.count_if(F.col("event_type") != "click").alias("n")).select("user_id", F.when(F.col("n") > 0, 100 * (1 - F.col("d") / F.col("n"))).alias("hitrate")),
    "SELECT user_id, CASE WHEN n > 0 THEN 100 * (1 - d::double / n) END AS hitrate FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS d, count(*) FILTER (event_type <> 'click') AS n FROM {events} GROUP BY user_id)")
add("ag_ratio", lambda t: t.dirents.groupBy("catalog").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select("catalog", F.expr("s div 1024").alias("kib"), F.expr("s div 1000").alias("kb"), (F.col("s") / F.col("n")).alias("ratio")),
    "SELECT catalog, (sum(size) // 1024)::bigint AS kib, (sum(size) // 1000)::bigint AS kb, sum(size)::double / count(*) AS ratio FROM {dirents} GROUP BY catalog")
add("ag_lease_merge", lambda t: t.ticks.groupBy("user_id").agg(F.sum("amount").alias("bytes"), F.count("*").alias("files")), "SELECT user_id, sum(amount)::bigint AS bytes, count(*) AS files FROM {ticks} GROUP BY user_id")
add("ag_bench", lambda t: op.text_median(t.ticks, "event_type", "amount"),
    "SELECT event_type, list_sort(list(amount::varchar))[count(*) // 2 + 1] AS median, max(amount) AS maximum FROM {ticks} GROUP BY event_type")


def file_stats(t):
    tables = op.file_statistics(t.dirents, t.chunks)
    total = {"catalogs": "file_size", "objects": "size", "files": "1", "files_objects": "1", "symlinks": "length"}
    rows = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(F.expr(total[name])).cast("long").alias("total")) for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


add("snk_filestats", file_stats, """
    WITH f AS (SELECT * FROM {dirents} WHERE (flags & 28) = 4), fo AS (SELECT path, hash, size FROM f WHERE (flags & 64) = 0 AND hash IS NOT NULL UNION ALL SELECT c.path, c.hash, c.size FROM f JOIN {chunks} c ON c.path = f.path WHERE (flags & 64) <> 0)
    SELECT 'catalogs' AS table_name, count(DISTINCT catalog) AS n, sum(size)::bigint AS total FROM {dirents} UNION ALL SELECT 'objects', count(*), sum(s)::bigint FROM (SELECT hash, max(size) AS s FROM fo GROUP BY hash)
    UNION ALL SELECT 'files', count(*), count(*) FROM f UNION ALL SELECT 'files_objects', count(*), count(*) FROM fo UNION ALL SELECT 'symlinks', count(*), sum(length(symlink))::bigint FROM {dirents} WHERE (flags & 8) <> 0""")

# orderings
add("so_tags", lambda t: t.tags.orderBy(F.desc("timestamp"), F.desc("revision")), "SELECT * FROM {tags} ORDER BY timestamp DESC, revision DESC")
add("so_chunks", lambda t: t.chunks.groupBy("path").agg(F.array_sort(F.collect_list("off")).alias("offs")).select("path", F.array_join(F.transform("offs", lambda x: x.cast("string")), ",").alias("offs")), "SELECT path, string_agg(off::bigint::varchar, ',' ORDER BY off) AS offs FROM {chunks} GROUP BY path")
add("so_hashes", lambda t: op.ordered_hashes(t.tags), "SELECT hash, timestamp, revision FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY timestamp, revision) AS k FROM {tags}) WHERE k = 1 ORDER BY timestamp, revision")
add("so_reflog", lambda t: t.refs.filter("type = 1 AND timestamp < 850000000").orderBy(F.desc("timestamp")), "SELECT * FROM {refs} WHERE type = 1 AND timestamp < 850000000 ORDER BY timestamp DESC")
add("tk_asof", lambda t: op.tags_as_of(t.tags, t.tags.select((F.col("timestamp") + 43200).alias("t"))), """
    SELECT t, arg_max(name, g.revision) AS name, max(g.revision) AS revision FROM (SELECT DISTINCT timestamp + 43200 AS t FROM {tags}) q
    JOIN {tags} g ON g.branch = '' AND g.timestamp <= q.t GROUP BY t""")
add("tk_head", lambda t: op.top_by(t.tags, ["branch"], [F.desc("revision")]).select("branch", "name", "revision"), "SELECT branch, arg_max(name, revision) AS name, max(revision) AS revision FROM {tags} GROUP BY branch")
add("tk_maxchild", lambda t: op.top_by(op.subtree_weights(t.dirents).withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).filter("weight > 1 and path <> ''"), ["catalog", "parent"], [F.desc("weight"), F.col("path")]).select("catalog", "parent", "path", "weight"), f"""
    SELECT catalog, parent, path, weight FROM (SELECT *, row_number() OVER (PARTITION BY catalog, parent ORDER BY weight DESC, path) AS k FROM
      (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM ({WEIGHT}) WHERE weight > 1 AND path <> '')) WHERE k = 1""")
GEO = "s_suppkey AS k, (s_suppkey * 37 % 170 - 85)::double AS lat, (s_suppkey * 91 % 360 - 180)::double AS lon"
add("so_geo", lambda t: t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 37 % 170 - 85).cast("double").alias("lat"), (F.col("s_suppkey") * 91 % 360 - 180).cast("double").alias("lon")).select(
        "k", F.round(op.arc(F.lit(46.0), F.lit(6.0), F.col("lat"), F.col("lon")), 6).alias("arc")).orderBy(F.asc_nulls_last("arc"), "k"), f"""
    SELECT k, round(CASE WHEN lat = 46 AND lon = 6 THEN 0 ELSE acos(greatest(-1, least(1, sin(radians(46)) * sin(radians(lat)) + cos(radians(46)) * cos(radians(lat)) * cos(radians(6 - lon))))) END, 6) AS arc FROM (SELECT {GEO} FROM {{supplier}})""")
add("fn_arc", lambda t: t.supplier.select(F.col("s_suppkey").alias("k"), F.round(op.arc((F.col("s_suppkey") * 37 % 170 - 85).cast("double"), (F.col("s_suppkey") * 91 % 360 - 180).cast("double"), (F.col("s_suppkey") * 53 % 170 - 85).cast("double"), (F.col("s_suppkey") * 17 % 360 - 180).cast("double")), 6).alias("arc")), """
    SELECT k, round(CASE WHEN a = c AND b = d THEN 0 ELSE acos(greatest(-1, least(1, sin(radians(a)) * sin(radians(c)) + cos(radians(a)) * cos(radians(c)) * cos(radians(b - d))))) END, 6) AS arc
    FROM (SELECT s_suppkey AS k, (s_suppkey * 37 % 170 - 85)::double AS a, (s_suppkey * 91 % 360 - 180)::double AS b, (s_suppkey * 53 % 170 - 85)::double AS c, (s_suppkey * 17 % 360 - 180)::double AS d FROM {supplier})""")
add("so_branchtree", lambda t: op.branch_order(t.branches.select(*[F.concat(c, F.lit("-of-2024")).alias(c) for c in ("branch", "parent")], "initial_revision")).select("branch", "level", F.array_join("key", "/").alias("key")), """
    WITH RECURSIVE b AS (SELECT branch || '-of-2024' AS branch, parent || '-of-2024' AS parent FROM {branches}),
      w AS (SELECT branch, 0 AS level, branch AS key FROM b WHERE parent IS NULL
      UNION ALL SELECT b.branch, w.level + 1, w.key || '/' || b.branch FROM w JOIN b ON b.parent = w.branch) SELECT branch, level, key FROM w""")
add("so_tail", lambda t: t.documents.select("doc_id", op.tail(F.col("text"), 2).alias("tail")), r"""
    SELECT doc_id, array_to_string(list_slice(l, greatest(len(l) - 2, 1), len(l)), chr(10)) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents})""")
add("so_logbuf", lambda t: t.ticks.filter("user_id = 3").select("t", "event_id", F.substring(F.concat_ws(" ", F.col("t").cast("string"), "event_type"), 1, 12).alias("line")).orderBy(F.desc("t"), F.desc("event_id")),
    "SELECT t, event_id, substring(t::varchar || ' ' || event_type, 1, 12) AS line FROM {ticks} WHERE user_id = 3 ORDER BY t DESC, event_id DESC")

# sets
add("set_unionall", lambda t: t.nested.select("path", "sha1", "size").unionByName(t.binds), "SELECT path, sha1, size FROM {nested} UNION ALL SELECT * FROM {binds}")
add("set_union", lambda t: op.content_hashes(t.dirents, t.chunks).select("hash").distinct(), """
    SELECT hash FROM {dirents} WHERE (flags & 128) = 0 AND hash IS NOT NULL UNION SELECT c.hash FROM {dirents} d JOIN {chunks} c ON c.path = d.path WHERE (flags & 128) = 0""")
add("set_union3", lambda t: t.dirents.filter("hash is not null").select("hash").union(t.chunks.select(F.concat("hash", F.lit("P")))).union(t.nested.select(F.concat("sha1", F.lit("C")))).distinct(),
    "SELECT hash FROM {dirents} WHERE hash IS NOT NULL UNION SELECT hash || 'P' FROM {chunks} UNION SELECT sha1 || 'C' FROM {nested}")
add("set_mergestats", lambda t: op.merged_statistics(t.stats.filter("publish_id < 10").select("publish_id", "files_added"), t.stats.filter("publish_id >= 15").select("publish_id", "files_added"), "publish_id"), """
    SELECT publish_id, files_added FROM {stats} WHERE publish_id < 10 UNION ALL SELECT publish_id - 15 + 9 + 1, files_added FROM {stats} WHERE publish_id >= 15""")
add("set_catcount", lambda t: t.dirents.filter(has(32)).agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths")), "SELECT count(*) AS n, count(DISTINCT path) AS paths FROM {dirents} WHERE (flags & 32) <> 0")
QUERIES, SQL = R.queries, R.sql
