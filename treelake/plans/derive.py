"""The metadata model over the supplied tables: one SQL text per model table, run by Spark and by the checking engine.

regions, nations, customers and orders form a tree of paths; nations are nested partitions (catalogs), so a nation's
directory stands in its parent (as mount point) and in its own partition (as root). Line items are the chunks of orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Bits of an entry's flags.
DIR, MOUNT, FILE, LINK, SPECIAL, ROOT, CHUNKED, EXTERNAL, HIDDEN = 1, 2, 4, 8, 16, 32, 64, 128, 0x8000

#: Model tables by name; {x} stands for another table, model or supplied.
MODEL = {
    "chunks": """
        SELECT o, path, n, size, sum(size) OVER (PARTITION BY o ORDER BY n) - size AS off, hash FROM (
          SELECT l.o, f.path, l.n, l.size, l.hash FROM (
            SELECT l_orderkey AS o, cast(l_quantity AS bigint) AS size,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
                                      l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS n,
                   md5(concat(cast(l_partkey AS string), '-', cast(l_suppkey AS string))) AS hash
            FROM {lineitem}) l JOIN {places} f ON f.o = l.o) x""",
    "places": """
        SELECT o_orderkey AS o, concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)) AS mount,
               concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string), '/c', cast(c_custkey AS string)) AS dir,
               concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string), '/c', cast(c_custkey AS string), '/o', cast(o_orderkey AS string)) AS path,
               o_orderpriority AS priority, o_orderstatus AS status, EPOCH(o_orderdate) AS mtime, o_custkey AS cust
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "dirents": """
        SELECT catalog, path, parent, name, flags, mode, size, mtime, mtimens, hardlinks, hash, symlink, uid, gid,
               md5(path) AS md5path, row_number() OVER (PARTITION BY catalog ORDER BY path) AS rowid FROM (
          SELECT '' AS catalog, '' AS path, cast(NULL AS string) AS parent, '' AS name, 1 + 32 AS flags, 493 AS mode, cast(4096 AS bigint) AS size,
                 cast(0 AS bigint) AS mtime, cast(NULL AS int) AS mtimens, cast(1 AS bigint) AS hardlinks, cast(NULL AS string) AS hash, '' AS symlink, 0 AS uid, 0 AS gid
          UNION ALL
          SELECT '', concat('/r', cast(r_regionkey AS string)), '', concat('r', cast(r_regionkey AS string)), 1, 493, 4096, 0, NULL, 1, NULL, '', 0, 0 FROM {region}
          UNION ALL
          SELECT '', concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)), concat('/r', cast(n_regionkey AS string)),
                 concat('n', cast(n_nationkey AS string)), 1 + 2, 493, 4096, 0, NULL, 1, NULL, '', 0, 0 FROM {nation}
          UNION ALL
          SELECT concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)), concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)),
                 concat('/r', cast(n_regionkey AS string)), concat('n', cast(n_nationkey AS string)), 1 + 32, 493, 4096, 0, NULL, 1, NULL, '', 0, 0 FROM {nation}
          UNION ALL
          SELECT concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)),
                 concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string), '/c', cast(c_custkey AS string)),
                 concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)), concat('c', cast(c_custkey AS string)),
                 1, 493, 4096, 0, NULL, 1, NULL, '', cast(c_nationkey AS int), 0 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
          UNION ALL
          SELECT mount, path, dir, concat('o', cast(o AS string)),
                 CASE WHEN priority = '5-LOW' THEN 4 + 8 ELSE 4 + CASE WHEN priority = '3-MEDIUM' THEN 128 ELSE 0 END + CASE WHEN n_chunks >= 4 THEN 64 ELSE 0 END END,
                 420, CASE WHEN priority = '5-LOW' THEN 9 ELSE size END, mtime, CASE WHEN o % 2 = 0 THEN cast(o % 1000 AS int) END,
                 CASE WHEN priority = '4-NOT SPECIFIED' THEN (cust % 7 + 1) * 4294967296 + 2 ELSE 1 END,
                 CASE WHEN priority <> '5-LOW' THEN md5(concat('f', cast(o % 997 AS string))) END, CASE WHEN priority = '5-LOW' THEN '$(VAR)/lnk' ELSE '' END,
                 cast(cust % 10 AS int), cast(cust % 3 AS int)
          FROM {sizes}) x""",
    "sizes": """
        SELECT p.*, coalesce(s.size, 0) AS size, coalesce(s.n_chunks, 0) AS n_chunks FROM {places} p
        LEFT JOIN (SELECT l_orderkey AS so, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS size, count(*) AS n_chunks FROM {lineitem} GROUP BY l_orderkey) s ON s.so = p.o""",
    "nested": """
        SELECT concat('/r', cast(n_regionkey AS string), '/n', cast(n_nationkey AS string)) AS path,
               md5(concat('catalog', cast(n_nationkey AS string))) AS sha1, cast(1000 + n_nationkey AS bigint) AS size, '' AS parent_catalog FROM {nation}""",
    "binds": "SELECT concat('/bind', cast(r_regionkey AS string)) AS path, md5(concat('bind', cast(r_regionkey AS string))) AS sha1, cast(r_regionkey AS bigint) AS size FROM {region}",
    "tags": """
        SELECT concat('t', cast(o_orderkey AS string)) AS name, md5(concat('root', cast(o_orderkey % 500 AS string))) AS hash,
               cast(d.earlier + row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS int) AS revision, EPOCH(o_orderdate) AS timestamp, cast(floor(o_totalprice) AS bigint) AS size,
               CASE WHEN o_custkey % 4 = 0 THEN concat('b', cast(o_custkey % 20 AS string)) ELSE '' END AS branch, o_orderpriority AS description
        FROM {orders} JOIN (SELECT day, sum(n) OVER (ORDER BY day) - n AS earlier FROM (SELECT o_orderdate AS day, count(*) AS n FROM {orders} GROUP BY o_orderdate) x) d ON d.day = o_orderdate""",
    "branches": """
        SELECT '' AS branch, cast(NULL AS string) AS parent, cast(0 AS bigint) AS initial_revision
        UNION ALL SELECT concat('b', cast(n_nationkey AS string)), CASE WHEN n_nationkey < 5 THEN '' ELSE concat('b', cast(n_nationkey % 5 + CASE WHEN n_nationkey >= 10 THEN 5 ELSE 0 END AS string)) END,
               cast(n_nationkey * 3 AS bigint) FROM {nation}""",
    "refs": """
        SELECT hash, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS type, timestamp FROM (
          SELECT md5(concat('ref', cast(o_orderkey AS string))) AS hash, o_orderstatus AS status, EPOCH(o_orderdate) AS timestamp FROM {orders}) x""",
    "revisions": """
        SELECT md5(concat('rev', cast(o_orderkey AS string))) AS hash, cust, mtime, size, depth,
               md5('rev' || cast(lag(o_orderkey) OVER (PARTITION BY cust ORDER BY depth) AS string)) AS previous FROM (
          SELECT o_orderkey, o_custkey AS cust, EPOCH(o_orderdate) AS mtime, cast(floor(o_totalprice) AS bigint) AS size,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS depth FROM {orders}) x""",
    "objects": "SELECT doc_id, md5(text) AS hash, n_chars AS size, source, lang FROM {documents}",
    "cache": """
        SELECT md5(concat(cast(user_id AS string), event_type)) AS sha1, cast(floor(max(value) * 10) + 1 AS bigint) AS size,
               max(event_id) - CASE WHEN event_type = 'error' THEN 9007199254740992 ELSE 0 END AS acseq, concat('/u', cast(user_id AS string), '/', event_type) AS path,
               CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS type, CASE WHEN user_id % 11 = 0 THEN 1 WHEN user_id % 13 = 0 THEN 2 ELSE 0 END AS pinned
        FROM {events} GROUP BY user_id, event_type""",
    "ticks": "SELECT event_id, EPOCH(ts) AS t, user_id, event_type, cast(floor(value) AS bigint) AS amount FROM {events}",
    "old_tree": "SELECT * FROM {dirents} WHERE rowid % 17 <> 0 OR (flags & 1) <> 0",
    "new_tree": """
        SELECT catalog, path, parent, name, flags, CASE WHEN rowid % 13 = 0 THEN mode + 64 ELSE mode END AS mode, CASE WHEN rowid % 26 = 0 THEN size + 1 ELSE size END AS size,
               mtime, mtimens, hardlinks, CASE WHEN rowid % 26 = 0 THEN md5(path) ELSE hash END AS hash, symlink, uid, gid, md5path, rowid
        FROM {dirents} WHERE rowid % 19 <> 0 OR (flags & 1) <> 0""",
    "urls": "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?].*$', '') AS path FROM {pages}",
    "leases": """
        SELECT cast(event_id AS string) AS token, concat('repo', cast(user_id % 3 AS string)) AS repository,
               CASE WHEN event_id % 5 = 0 THEN concat('/u', cast(user_id AS string)) ELSE concat('/u', cast(user_id AS string), '/', event_type) END AS path,
               EPOCH(ts) * 1000 + 3600000 AS expiration FROM {events}""",
    "stats": """
        SELECT n_nationkey AS publish_id, concat('2024-0', cast(n_nationkey % 9 + 1 AS string), '-1', cast(n_nationkey % 10 AS string), ' 08:00:00') AS finish_time,
               CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat('2024-0', cast(n_nationkey % 9 + 1 AS string), '-1', cast(n_nationkey % 10 AS string), ' 07:00:00') END AS start_time,
               n_nationkey * 7 AS files_added, n_nationkey * 3 AS files_removed, n_nationkey % 2 AS success FROM {nation}""",
}
#: Names of the supplied tables.
SUPPLIED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table as a DataFrame."""
    if name in SUPPLIED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"\bEPOCH\(", "unix_timestamp(", MODEL[name])
    return spark.sql(sql, **{n: model(spark, sf_dir, n) for n in _names(sql)})


def checking_sql(sql: str) -> str:
    """SQL over {names} of model tables as one statement over the supplied tables."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in MODEL and n not in needed:
                need(MODEL[n])
                if n not in needed:
                    needed.append(n)

    need(sql)
    body = lambda s: re.sub(r"\bEPOCH\(([^()]*)\)", r"cast(floor(epoch(\1)) AS bigint)", re.sub(r"\{(\w+)\}", r"\1", s))
    parts = [f"{n} AS ({body(MODEL[n])})" for n in needed]
    said = body(sql).strip()
    recursive = re.match(r"(?is)WITH\s+RECURSIVE\s+(.*)", said)
    plain = None if recursive else re.match(r"(?is)WITH\s+(.*)", said)
    if recursive or plain:
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*parts, (recursive or plain)[1]])
    return (f"WITH {', '.join(parts)} " if parts else "") + said
