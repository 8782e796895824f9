"""Queries: projections, lookups, filters and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.functions.paths import depth
from treelake.operators import entries as op
from treelake.plans.registry import Registry

R = Registry()
KINDS = ", ".join(f"(flags & {bit}) <> 0 AS {name}" for name, bit in op.BITS.items())
UNDER = "({p} = {m} OR {p} LIKE {m} || '/%')"

R.add("proj_dirent", lambda t: op.decode(t.dirents, world_readable=True), f"""
    SELECT path, catalog, {KINDS}, ((flags >> 8) & 7) + 1 AS hash_algorithm, (flags >> 11) & 7 AS compression, hardlinks % 4294967296 AS linkcount,
           hardlinks // 4294967296 AS hardlink_group, coalesce(mtimens, -1) AS mtimens, mode | CASE WHEN flags & 1 = 1 THEN 365 ELSE 292 END AS mode FROM {{dirents}}""")
R.add("proj_flags_enc", lambda t: op.encode_flags(op.decode(t.dirents)), "SELECT path, catalog, flags FROM {dirents}")
R.add("lk_path", lambda t: op.at_paths(t.dirents, ["/r1/n1"]), "SELECT * FROM {dirents} WHERE path = '/r1/n1'")
R.add("lk_rowid", lambda t: t.dirents.filter("rowid = 7"), "SELECT * FROM {dirents} WHERE rowid = 7")
R.add("lk_xattr", lambda t: t.events.select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).alias("value")), "SELECT event_id, json_extract_string(props, '$.k') AS value FROM {events}")
R.add("ls_dir", lambda t: op.children(t.dirents, "/r1"), "SELECT * FROM {dirents} WHERE parent = '/r1'")
R.add("ls_stat", lambda t: op.children(t.dirents, "/r1/n1").select("name", "mode", "size", "mtime", "hardlinks", "uid", "gid"), "SELECT name, mode, size, mtime, hardlinks, uid, gid FROM {dirents} WHERE parent = '/r1/n1'")

PROBES = "SELECT path FROM {places} UNION SELECT path || '/x' FROM {places} WHERE o % 3 = 0 UNION SELECT path FROM {urls} UNION SELECT '/r1/n1x' AS path"


def probes(t):
    more = t.places.filter("o % 3 = 0").select(F.concat("path", F.lit("/x")).alias("path"))
    return t.places.select("path").union(more).union(t.urls.select("path")).union(t.spark.sql("SELECT '/r1/n1x' AS path")).distinct()


LONGEST = f"""SELECT p.path, coalesce(max(m.path) FILTER (WHERE length(m.path) > 0), '') AS mount FROM ({PROBES}) p
    LEFT JOIN {{nested}} m ON p.path = m.path OR p.path LIKE m.path || '/%' GROUP BY p.path"""
R.add("lk_prefix", lambda t: op.longest_prefix(probes(t), t.nested), LONGEST)
R.add("lk_tree", lambda t: op.resolve(probes(t), t.nested, t.dirents), f"""
    SELECT x.path, x.mount AS catalog, d.path IS NOT NULL AS found, d.flags FROM ({LONGEST}) x LEFT JOIN {{dirents}} d ON d.path = x.path AND d.catalog = x.mount""")
R.add("lk_nested", lambda t: t.nested.select("path", "sha1", "size").unionByName(t.binds).filter(F.col("path").isin("/r1/n1", "/bind2")),
      "SELECT * FROM (SELECT path, sha1, size FROM {nested} UNION ALL SELECT * FROM {binds}) WHERE path IN ('/r1/n1', '/bind2')")
R.add("ls_skein", lambda t: op.skein("/r1/n1/c5", t.nested), """
    SELECT path, length(path) - length(replace(path, '/', '')) AS level FROM {nested} WHERE '/r1/n1/c5' LIKE path || '/%' OR path LIKE '/r1/n1/%'""")
R.add("flt_kind", lambda t: op.of_kind(t.dirents, 8).select("path", "symlink"), "SELECT path, symlink FROM {dirents} WHERE (flags & 8) <> 0")
R.add("flt_dirtab", lambda t: op.matching_globs(t.places.select(F.col("path")), ["/r*/n1/c*/o*", "/r2/*/*/o?5"], ["/r1/*7"]), """
    SELECT path FROM {places} WHERE (regexp_full_match(path, '/r[^/]*/n1/c[^/]*/o[^/]*/?') OR regexp_full_match(path, '/r2/[^/]*/[^/]*/o[^/]5/?')) AND NOT regexp_full_match(path, '/r1/.*7/?')""")
R.add("flt_glob", lambda t: op.matching_globs(t.urls, ["/??/*"], []), "SELECT page_id, path FROM {urls} WHERE regexp_full_match(path, '/[^/][^/]/[^/]*/?')")
RULES = "SELECT '/r1/n1' AS rule, false AS negated UNION ALL SELECT '/r2', false UNION ALL SELECT '/r2/n2', true UNION ALL SELECT '/r2', true UNION ALL SELECT '/r3/n3/c7', false"


def rules(t, both: bool = True):
    return t.spark.sql(RULES).filter("true" if both else "not (rule = '/r2' and negated)")


R.add("flt_relaxed", lambda t: op.matching_relaxed(t.dirents.select("path").distinct(), rules(t, False)), f"""
    WITH r AS (SELECT * FROM ({RULES}) WHERE NOT (rule = '/r2' AND negated)), p AS (SELECT DISTINCT path FROM {{dirents}})
    SELECT path FROM p WHERE EXISTS (SELECT 1 FROM r WHERE NOT negated AND (path = rule OR path LIKE rule || '/%' OR rule LIKE path || '/%'))
      AND NOT EXISTS (SELECT 1 FROM r WHERE negated AND (path = rule OR path LIKE rule || '/%'))""")
R.add("flt_contra", lambda t: op.contradictions(rules(t)), f"SELECT DISTINCT a.rule FROM ({RULES}) a JOIN ({RULES}) b ON a.rule = b.rule AND NOT a.negated AND b.negated")
R.add("flt_spectree", lambda t: op.matching_tree(t.dirents.select("path").distinct(), ["/r1/n1/*", "^/r2/n2/*", "!" + t.dirents.filter("catalog = '/r1/n1' and (flags & 35) = 1").agg(F.min("path")).first()[0], "/r3/n3"]), """
    SELECT DISTINCT path FROM {dirents} WHERE (path IN ('', '/r1', '/r2', '/r2/n2', '/r3', '/r3/n3', '/r1/n1') OR path LIKE '/r1/n1/%' OR (path LIKE '/r2/n2/%' AND path NOT LIKE '/r2/n2/%/%'))
      AND NOT EXISTS (SELECT 1 FROM (SELECT min(path) AS p FROM {dirents} WHERE catalog = '/r1/n1' AND (flags & 35) = 1) WHERE path = p OR starts_with(path, p || '/'))""")
R.add("flt_imageglob", lambda t: t.tags.filter(F.col("name").rlike(op.glob_regex("t1*5"))).select("name"), "SELECT name FROM {tags} WHERE regexp_full_match(name, 't1[^/]*5')")
R.add("flt_reach", lambda t: op.reportable(t.dirents.select("path").distinct(), "/r1/n1"), """
    SELECT DISTINCT path, path = '/r1/n1' OR path LIKE '/r1/n1/%' AS within, NOT (path IN ('', '/r1', '/r1/n1') OR path LIKE '/r1/n1/%') AS ignored FROM {dirents}""")
R.add("rng_chunk", lambda t: op.chunk_at(t.chunks, t.sizes.select("path", F.floor(F.col("size") / 2).cast("long").alias("pos"))), """
    SELECT path, pos, (SELECT max(off) FROM {chunks} c WHERE c.path = s.path AND off <= pos) AS off FROM (SELECT path, size // 2 AS pos FROM {sizes} WHERE n_chunks > 0) s""")
R.add("rng_read", lambda t: op.chunks_in(t.chunks, t.sizes.select("path", F.lit(30).alias("at"), F.lit(25).alias("len"))).select("path", "off", "size", "hash"),
      "SELECT path, off, size, hash FROM {chunks} WHERE off < 55 AND off + size > 30")
R.add("fn_pathlist", lambda t: t.urls.select("page_id", F.explode(op.ancestors(F.col("path"))).alias("ancestor")), """
    SELECT page_id, array_to_string(string_split(path, '/')[1:i], '/') AS ancestor FROM {urls}, range(1, 20) r(i) WHERE i <= len(string_split(path, '/'))""")
R.add("fn_parent", lambda t: t.urls.select("page_id", op.ancestors(F.col("path"))[depth(F.col("path")) - 1].alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name")),
      "SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '([^/]*)$', 1) AS name FROM {urls}")
QUERIES, SQL = R.queries, R.sql
