"""Queries: stateful operators, scalar functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.functions import text as fn
from treelake.operators import states as op
from treelake.operators import trees
from treelake.plans.registry import Registry
from treelake.sources import records

R = Registry()
add = R.add
c = F.col

# eviction and trackers
VICTIMS = """SELECT sha1, size, before FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY acseq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM {cache} WHERE pinned = 0)
    WHERE (SELECT sum(size) FROM {cache}) - before > %d"""
add("st_lru", lambda t: op.evicted(t.cache, 30000), VICTIMS % 30000)
add("tk_lru", lambda t: op.evicted(t.cache, 90000, 50).orderBy("before").select("sha1", "before"), f"SELECT sha1, before FROM ({VICTIMS % 90000})")
add("st_kvshrink", lambda t: op.evicted(t.cache.withColumn("pinned", (c("pinned") > 1).cast("int")), 10000), (VICTIMS % 10000).replace("pinned = 0", "pinned <= 1"))
add("st_refcount", lambda t: op.references(t.ticks.select("user_id", F.when(c("event_type") == "click", 2).when(c("event_type") == "view", 1).otherwise(-1).alias("change")), "user_id", "change"),
    "SELECT user_id, r AS \"references\" FROM (SELECT user_id, sum(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE -1 END)::bigint AS r FROM {ticks} GROUP BY user_id) WHERE r > 0")
add("st_inodetrack", lambda t: op.references(t.ticks.select("user_id", "event_type", F.when(c("event_id") % 3 == 0, -1).otherwise(1).alias("change")).groupBy("user_id", "event_type").agg(F.sum("change").alias("change")).select(F.concat_ws("/", c("user_id").cast("string"), "event_type").alias("inode"), "change"), "inode", "change"),
    "SELECT user_id || '/' || event_type AS inode, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END)::bigint AS \"references\" FROM {ticks} GROUP BY 1 HAVING sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) > 0")
add("st_dentry", lambda t: t.leases.filter("expiration > 1705000000000").select("token", "path"), "SELECT token, path FROM {leases} WHERE expiration > 1705000000000")
add("st_pagecache", lambda t: op.flushes(t.ticks.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"),
    "SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, false) AS flush FROM {ticks}")
add("st_lrumap", lambda t: op.latest_used(t.ticks, "user_id", "event_id", 25), "SELECT user_id, max(event_id) AS last FROM {ticks} GROUP BY user_id ORDER BY last DESC, user_id LIMIT 25")
add("lk_tier", lambda t: op.tiered(t.cache.filter("size % 2 = 0"), t.cache.filter("size % 3 = 0"), "sha1", "size"),
    "SELECT sha1, size, size % 2 <> 0 AS copied_up FROM {cache} WHERE size % 2 = 0 OR size % 3 = 0")
add("lk_inodemap", lambda t: t.urls.select("path").distinct().select("path", F.xxhash64("path").alias("inode")).join(t.urls.groupBy("path").agg(F.count("*").alias("n")), "path").select("path", "n"), "SELECT path, count(*) AS n FROM {urls} GROUP BY path")

# recorders and telemetry
KEPT = "(SELECT * FROM (SELECT *, t // {r} AS bin, max(t // {r}) OVER (PARTITION BY user_id ORDER BY event_id) AS newest FROM {{ticks}}) WHERE newest - bin < {b})"
add("st_recorder", lambda t: op.recorded(t.ticks, 3600, 7000), f"SELECT user_id, bin, count(*) AS n FROM {KEPT.format(r=3600, b=2)} GROUP BY ALL")
RECORDERS = [(60, 7200), (3600, 172800)]
add("st_multirec", lambda t: op.looked_back(t.ticks, RECORDERS, 86400).withColumn("back", F.lit(86400)).union(op.looked_back(t.ticks, RECORDERS, 3600).withColumn("back", F.lit(3600))), " UNION ALL ".join(
    f"SELECT k.user_id, count(*) AS n, {back} AS back FROM {KEPT.format(r=r, b=b)} k JOIN (SELECT user_id, max(t // {r}) AS top FROM {{ticks}} GROUP BY user_id) m ON m.user_id = k.user_id WHERE top - bin < {-(-back // r)} GROUP BY k.user_id"
    for back, r, b in ((86400, 3600, 48), (3600, 60, 120))))
add("st_cleanuprate", lambda t: op.rate(t.ticks, 86400), "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM {ticks}")
add("st_telemetry", lambda t: op.deltas(t.ticks.select("user_id", "event_type", "event_id", "amount"), ["user_id", "event_type"], "event_id", "amount"),
    "SELECT user_id, event_type, event_id, amount, amount - coalesce(lag(amount) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS delta FROM {ticks}")
add("st_notify_pub", lambda t: op.published(t.ticks.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), """
    SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM {ticks}) WHERE event_type IS DISTINCT FROM last""")
add("st_notify_sub", lambda t: op.subscribed(t.ticks.select("user_id", "event_id", "event_type"), "user_id", "event_id", 400), """
    SELECT user_id, event_id, event_type FROM {ticks} WHERE event_id > 400 OR event_id IN (SELECT max(event_id) FROM {ticks} WHERE event_id <= 400 GROUP BY user_id)""")
add("st_sub_rev", lambda t: op.rising(t.ticks.select("user_id", "event_id", "amount"), "user_id", "event_id", "amount"), """
    SELECT user_id, event_id, amount FROM (SELECT *, max(amount) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {ticks}) WHERE seen IS NULL OR amount > seen""")
add("st_backoff", lambda t: op.throttled(t.ticks, 40000, 2, 64), """
    WITH f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 40000 THEN 0 ELSE 1 END AS fresh FROM {ticks} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM f)
    SELECT event_id, least(2 * 2 ** least(row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) - 1, 40), 64)::bigint AS delay FROM g""")
add("st_statsdb", lambda t: t.stats.select("publish_id", "files_added", "success").unionByName(t.stats.agg((F.max("publish_id") + 1).alias("publish_id"), F.sum("files_added").alias("files_added"), F.lit(1).alias("success"))),
    "SELECT publish_id, files_added, success FROM {stats} UNION ALL SELECT max(publish_id) + 1, sum(files_added)::bigint, 1 FROM {stats}")
add("st_chunk_static", lambda t: trees.static_chunks(t.documents.select(c("doc_id").cast("string").alias("path"), c("text").cast("binary").alias("content")), 1000).select("path", "off", "size"), """
    SELECT doc_id::varchar AS path, off::bigint AS off, least(1000, strlen(text) - off)::bigint AS size FROM {documents}, LATERAL (SELECT unnest(range(0, greatest(strlen(text), 1)::bigint, 1000)) AS off)""")
add("st_chunk_cdc", lambda t: trees.content_chunks(t.documents.select(c("doc_id").cast("string").alias("path"), c("text").cast("binary").alias("content")), 256, 1024, 4096))
add("df_layers", lambda t: op.layered(t.dirents.filter("(flags & 2) = 0").select((c("rowid") % 3).alias("layer"), "path", c("name").alias("entry"), F.lit(False).alias("whiteout")).unionByName(
        t.spark.sql("SELECT 2L AS layer, '/r1/n1' AS path, 'w' AS entry, true AS whiteout UNION ALL SELECT 1L, '/r2', 'w', true"))), """
    SELECT path, name AS entry FROM {dirents} WHERE (flags & 2) = 0 AND NOT ((path = '/r1/n1' OR path LIKE '/r1/n1/%') AND rowid % 3 < 2) AND NOT ((path = '/r2' OR path LIKE '/r2/%') AND rowid % 3 < 1)""")
add("ag_chain", lambda t: t.region.select("r_regionkey", op.chain_ids(F.array(c("r_name"), F.lit("a"), F.lit("b"))).alias("chain")), "SELECT r_regionkey, sha256(sha256(sha256(' ' || r_name) || ' a') || ' b') AS chain FROM {region}")
add("ut_batch", lambda t: op.batches(t.places.select("mount", "path"), "mount", "path", 10), """
    SELECT mount, batch, string_agg(path, ' ' ORDER BY path) AS items FROM (SELECT mount, path, (row_number() OVER (PARTITION BY mount ORDER BY path) - 1) // 10 AS batch FROM {places}) GROUP BY ALL""")
add("snk_pack", lambda t: op.packed(t.objects.select("source", "doc_id", "size"), "source", "doc_id", "size"), "SELECT source, doc_id, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS \"offset\" FROM {objects}")

# functions
add("fn_md5path", lambda t: t.urls.select("page_id", F.md5("path").alias("digest"), F.substring(F.md5("path"), 1, 16).alias("high")), "SELECT page_id, md5(path) AS digest, substring(md5(path), 1, 16) AS high FROM {urls}")
add("fn_sha1", lambda t: t.documents.select("doc_id", F.sha1("text").alias("digest")), "SELECT doc_id, sha1(text) AS digest FROM {documents}")
add("fn_hexid", lambda t: t.nested.select("path", fn.digest_parts(F.concat("sha1", F.lit("-rmd160C"))).alias("p")).select("path", "p.hex", "p.algorithm", "p.suffix"), "SELECT path, sha1 AS hex, 'rmd160' AS algorithm, 'C' AS suffix FROM {nested}")
add("fn_caspath", lambda t: t.nested.select("path", fn.content_path(c("sha1")).alias("place")), "SELECT path, substring(sha1, 1, 2) || '/' || substring(sha1, 3) AS place FROM {nested}")
add("fn_prefix", lambda t: t.part.select("p_partkey", F.startswith(F.lower("p_name"), F.lit("p")).alias("starts"), F.endswith("p_name", F.lit("1")).alias("ends")), "SELECT p_partkey, starts_with(lower(p_name), 'p') AS starts, ends_with(p_name, '1') AS ends FROM {part}")
add("fn_split", lambda t: t.urls.select("page_id", F.array_join(F.split("path", "/", 3), "|").alias("parts")), "SELECT page_id, regexp_replace(regexp_replace(path, '/', '|'), '/', '|') AS parts FROM {urls}")
add("fn_trim", lambda t: t.part.select("p_partkey", F.upper(F.trim(F.concat(F.lit("  "), "p_brand"))).alias("up"), F.replace("p_type", F.lit("A"), F.lit("")).alias("less")), "SELECT p_partkey, upper(trim('  ' || p_brand)) AS up, replace(p_type, 'A', '') AS less FROM {part}")
add("fn_base64", lambda t: t.nested.select("path", fn.url_base64(F.unhex("sha1")).alias("b")), "SELECT path, translate(to_base64(unhex(sha1)), '+/', '-_') AS b FROM {nested}")
add("fn_parse", lambda t: t.events.select("event_id", F.concat("event_type", c("event_id").cast("string")).try_cast("long").alias("bad"), c("event_id").cast("string").try_cast("long").alias("good")), "SELECT event_id, try_cast(event_type || event_id AS bigint) AS bad, event_id AS good FROM {events}")
add("fn_fmt", lambda t: t.ticks.select("event_id", F.format_string("%d.%03d", c("t") % 1000, c("event_id") % 1000).alias("tv"), F.when(c("amount") > 10, "yes").otherwise("no").alias("flag"), F.lower(F.lpad(F.hex(c("user_id") % 256), 2, "0")).alias("byte")),
    "SELECT event_id, printf('%d.%03d', t % 1000, event_id % 1000) AS tv, CASE WHEN amount > 10 THEN 'yes' ELSE 'no' END AS flag, printf('%02x', user_id % 256) AS byte FROM {ticks}")
add("fn_time", lambda t: t.ticks.select("event_id", fn.iso_time(c("t")).alias("iso"), fn.from_iso(fn.iso_time(c("t"))).alias("back"), fn.from_iso(F.lit("2024-01-01")).alias("none")),
    "SELECT event_id, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, t AS back, 0 AS none FROM {ticks}")
add("fn_size", lambda t: t.orders.select("o_orderkey", fn.human_size(F.floor(c("o_totalprice") * c("o_orderkey")).cast("long")).alias("said")), """
    SELECT o_orderkey, CASE WHEN s > 1073741824 THEN printf('%.3f', s / 1073741824) || ' GiB' WHEN s > 1048576 THEN printf('%.3f', s / 1048576) || ' MiB' WHEN s > 1024 THEN printf('%.3f', s / 1024) || ' kiB' ELSE s || ' Byte' END AS said
    FROM (SELECT o_orderkey, floor(o_totalprice * o_orderkey)::bigint AS s FROM {orders})""")
add("fn_expand", lambda t: t.region.select("r_regionkey", fn.expanded(F.concat(F.lit("/$(NAME)/$(NONE:-def)/$(GONE)x$(open"), F.lit("")), F.create_map(F.lit("NAME"), c("r_name"))).alias("link")), "SELECT r_regionkey, '/' || r_name || '/def/x$(open' AS link FROM {region}")
add("fn_sanitize", lambda t: t.customer.select("c_custkey", c("c_name").rlike("^[A-Za-z0-9#]+$").alias("clean")), "SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9#]+') AS clean FROM {customer}")
add("fn_json", lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}")
add("fn_map", lambda t: t.events.select("event_id", F.array_join(F.array_sort(F.map_keys(F.from_json("props", "map<string,string>"))), ",").alias("keys")), "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM {events}")
add("fn_compress", lambda t: t.documents.select("doc_id", F.md5(fn.decompressed(fn.compressed(F.coalesce("text", F.lit("")).cast("binary")))).alias("digest")), "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM {documents}")
add("fn_inode", lambda t: t.dirents.groupBy("catalog", F.when(c("hardlinks") > 4294967295, c("hardlinks")).otherwise(-c("rowid")).alias("link")).agg((F.min("rowid") + 1000).alias("inode"), F.count("*").alias("n")).select("catalog", "inode", "n"),
    "SELECT catalog, min(rowid) + 1000 AS inode, count(*) AS n FROM {dirents} GROUP BY catalog, CASE WHEN hardlinks > 4294967295 THEN hardlinks ELSE -rowid END")
add("fn_imageparse", lambda t: t.region.select("r_regionkey", fn.image_parts(F.concat(F.lit("reg.example/lib/"), F.lower(F.replace("r_name", F.lit(" "), F.lit(""))))).alias("p")).select("r_regionkey", "p.scheme", "p.registry", "p.repository", "p.tag"),
    "SELECT r_regionkey, 'https' AS scheme, 'reg.example' AS registry, 'lib/' || lower(replace(r_name, ' ', '')) AS repository, 'latest' AS tag FROM {region}")
add("fn_outfmt", lambda t: t.region.select("r_regionkey", F.replace(F.replace(F.lit("$(scheme)://x/$(image)"), F.lit("$(scheme)"), F.lit("https")), F.lit("$(image)"), c("r_name")).alias("out")), "SELECT r_regionkey, 'https://x/' || r_name AS out FROM {region}")
add("fn_magic", lambda t: t.chunks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "size", "hash"))), lambda x: F.concat_ws(",", x["hash"], x["off"].cast("long").cast("string"), x["size"].cast("string"))), "\n").alias("chunk_list")),
    "SELECT path, string_agg(hash || ',' || off::bigint || ',' || size, chr(10) ORDER BY off, size, hash) AS chunk_list FROM {chunks} GROUP BY path")

# sources and sinks
add("src_manifest", lambda t: t.nested.select("path", records.letter_record(F.concat(F.lit("Cold\nZx\nC"), "sha1", F.lit("\nB"), c("size").cast("string"), F.lit("\nZy\n--\nXsign\n"))).alias("m")).select("path", c("m")["C"].alias("root"), c("m")["B"].cast("long").alias("size"), c("m")["Z"].alias("z"), F.try_element_at("m", F.lit("X")).alias("after")),
    "SELECT path, sha1 AS root, size, 'x|y' AS z, NULL::varchar AS after FROM {nested}")
add("src_keyval", lambda t: t.nested.select("path", records.key_values(F.concat(F.lit("a=0\na=b=c\nhash="), "sha1", F.lit("\n--\nafter=1\n"))).alias("m")).select("path", c("m")["a"].alias("a"), c("m")["hash"].alias("hash"), F.size("m").alias("n")), "SELECT path, 'b=c' AS a, sha1 AS hash, 2 AS n FROM {nested}")
add("src_idmap", lambda t: t.nested.select("path", records.id_rules(F.concat(F.lit("# ids\n* 99\n\n 1  5\n1 "), c("size").cast("string"), F.when(c("size") % 3 == 0, "\nx 7").otherwise(""))).alias("m")).select("path", "m.valid", "m.default", F.try_element_at("m.rules", F.lit(1).cast("long")).alias("one")),
    "SELECT path, size % 3 <> 0 AS valid, CASE WHEN size % 3 <> 0 THEN 99 END AS \"default\", CASE WHEN size % 3 <> 0 THEN size END AS one FROM {nested}")
add("src_graft", lambda t: t.nested.select("path", records.graft(F.concat(F.lit("size="), c("size").cast("string"), F.lit("\nchecksum="), "sha1", F.lit("\nchunk_offsets=0,5\nchunk_checksums=x"), F.when(c("size") % 2 == 0, ",y").otherwise(""), F.lit("\n"))).alias("g")).select("path", "g.size", "g.checksum", "g.n_chunks", "g.valid"),
    "SELECT path, size, sha1 AS checksum, 2 AS n_chunks, size % 2 = 0 AS valid FROM {nested}")
add("src_dirtab", lambda t: t.nested.select("path", records.rule(F.concat(F.when(c("size") % 3 == 0, "#").when(c("size") % 3 == 1, "! ").otherwise(" "), "path")).alias("r")).filter("r is not null").select("path", "r.negated", "r.pattern"),
    "SELECT path, size % 3 = 1 AS negated, path AS pattern FROM {nested} WHERE size % 3 <> 0")
add("src_overlay", lambda t: records.change_kind(t.dirents.filter("path <> ''").select(F.when(c("rowid") % 5 == 0, F.concat("parent", F.lit("/.wh."), "name")).when(c("rowid") % 7 == 0, F.concat("path", F.lit("/.wh..wh..opq"))).otherwise(c("path")).alias("path"))), """
    SELECT path, CASE WHEN rowid % 5 = 0 THEN 'remove' WHEN rowid % 7 = 0 THEN 'opaque' ELSE 'add' END AS kind FROM {dirents} WHERE path <> ''""")
add("src_registry", lambda t: t.region.select("r_regionkey", F.explode(F.from_json(F.concat(F.lit('{"layers":[{"digest":"'), "r_name", F.lit('","size":1},{"digest":"b","size":2}]}')), "layers array<struct<digest:string,size:long>>")["layers"]).alias("l")).select("r_regionkey", "l.digest", "l.size"),
    "SELECT r_regionkey, r_name AS digest, 1::bigint AS size FROM {region} UNION ALL SELECT r_regionkey, 'b', 2 FROM {region}")
add("snk_influx", lambda t: t.ticks.select("event_id", records.influx_line("m", {"user": c("user_id")}, {"v": c("amount"), "n": F.lit(1)}, c("t")).alias("line")), "SELECT event_id, 'm,user=' || user_id || ' v=' || amount || ',n=1 ' || t AS line FROM {ticks}")
add("snk_csv_trace", lambda t: t.ticks.select("event_id", records.csv_line(c("t"), c("event_type"), c("user_id")).alias("line")), "SELECT event_id, '\"' || t || '\",\"' || event_type || '\",\"' || user_id || '\"' AS line FROM {ticks}")
add("snk_json", lambda t: records.nested_json(t.ticks.groupBy("user_id", "event_type").agg(F.sum("amount").alias("value")).select(F.concat_ws(".", c("user_id").cast("string"), "event_type").alias("name"), "value")), """
    SELECT user_id::varchar AS namespace, '{{' || string_agg('"' || event_type || '":' || v, ',' ORDER BY event_type) || '}}' AS json FROM (SELECT user_id, event_type, sum(amount)::bigint AS v FROM {ticks} GROUP BY ALL) GROUP BY user_id""".replace("{{", "{").replace("}}", "}"))
add("snk_tabular", lambda t: t.nested.select(F.concat_ws("|", "path", c("size").cast("string"), "sha1").alias("line")).orderBy("line"), "SELECT path || '|' || size || '|' || sha1 AS line FROM {nested}")
add("snk_print_stats", lambda t: t.stats.select(F.concat_ws("|", c("publish_id").cast("string"), "finish_time", c("files_added").cast("string")).alias("line")), "SELECT publish_id || '|' || finish_time || '|' || files_added AS line FROM {stats}")
add("snk_object", lambda t: records.new_objects(t.chunks.select("hash"), t.chunks.filter("o % 2 = 0")), "SELECT DISTINCT hash FROM {chunks} WHERE hash NOT IN (SELECT hash FROM {chunks} WHERE o % 2 = 0)")
QUERIES, SQL = R.queries, R.sql
