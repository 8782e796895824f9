"""Publishing operators against plain versions and odd rows."""

from __future__ import annotations

import contextlib
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from treelake.operators import publishing as op
from treelake.sources import archives

LEASE = "seq long, t long, repository string, path string, action string, token string"


def replay(requests, lifetime):
    """The plain version: all leases of all repositories in one list."""
    held, asked, out = {}, {r[5]: r for r in requests if r[4] == "new"}, {}
    for seq, t, repository, path, action, token in sorted(requests, key=lambda r: (r[1], r[0])):
        if action == "new":
            left = [e - t for r, p, e in held.values() if r == repository and (p.startswith(path) or path.startswith(p)) and e > t]
            out[seq] = ("busy", max(left)) if left else ("granted", None)
            if not left:
                held[token] = (repository, path, t + lifetime)
        elif token in held and held[token][2] >= t:
            del held[token]
            out[seq] = ("done", None)
        else:
            out[seq] = ("invalid", None)
    return out


def test_leases_equal_a_plain_replay(spark):
    rng, rows, t = random.Random(3), [], 0
    paths = ["", "/a", "/ab", "/a/b", "/a/b/c", "/z", "/z/y", "/z/yy", "/q%_"]
    for seq in range(1500):
        t += rng.choice([0, 1, 5])
        action = rng.choice(["new", "new", "commit", "cancel"])
        token = str(seq) if action == "new" else str(max(seq - rng.randint(1, 6), 0))
        rows.append((seq, t, rng.choice(["r", "s"]), rng.choice(paths[1:] if seq % 40 else paths), action, token))
    found = op.replayed_leases(spark.createDataFrame(rows, LEASE), 30).collect()
    assert {r["seq"]: (r["outcome"], r["left"]) for r in found} == replay(rows, 30)
    assert {"busy", "granted", "done", "invalid"} == {r["outcome"] for r in found}


def test_lease_query_equals_a_plain_replay(spark, sf_dir):
    from treelake import plans
    from treelake.plans.publishing import lease_requests
    from treelake.plans.registry import Tables

    rows = [tuple(r) for r in lease_requests(Tables(spark, sf_dir)).collect()]
    found = plans.queries()["st_lease"](spark, sf_dir).collect()
    assert len(found) == len(rows) and {r["seq"]: (r["outcome"], r["left"]) for r in found} == replay(rows, 3_600_000)


def test_leases_without_requests(spark):
    assert op.replayed_leases(spark.createDataFrame([], LEASE), 5).count() == 0
    stray = spark.createDataFrame([(1, 0, "r", "/a", "commit", "none"), (2, 0, None, None, "new", "x")], LEASE)
    assert {r["outcome"] for r in op.replayed_leases(stray, 5).collect()} == {"invalid"}


def test_worktree_rules(spark):
    base = spark.createDataFrame([("/d", 1), ("/d/a", 4), ("/d/s", 1), ("/d/s/x", 4), ("/e", 1), ("/e/a", 4), ("/f", 4), ("/g", 1), ("/g/h", 4), ("/k", 4), ("/k2", 4)], "path string, flags int")
    rows = [("/d", "", 1, 1, 1, False, False), ("/d/s", "/d", 1, 2, 1, False, True), ("/d/s/y", "/d/s", 4, 9, 3, False, False), ("/d/s/z", "/d/s", 4, 9, 3, False, False),
            ("/e", "", 0, 3, 1, True, False), ("/f", "", 1, 4, 1, False, False), ("/g", "", 4, 5, 1, False, False), ("/k", "", 4, 6, 2, False, False), ("/no", "", 0, 7, 1, True, False)]
    overlay = spark.createDataFrame(rows, "path string, parent string, flags int, inode long, linkcount long, whiteout boolean, opaque boolean")
    found = {r["path"]: (r["action"], r["links"]) for r in op.worktree_changes(base, overlay).collect()}
    assert found == {"/d": ("touch", 1), "/d/s": ("replace", 1), "/d/s/x": ("remove", 1), "/d/s/y": ("add", 2), "/d/s/z": ("add", 2), "/e": ("remove", 1), "/e/a": ("remove", 1),
                     "/f": ("replace", 1), "/g": ("replace", 1), "/g/h": ("remove", 1), "/k": ("replace", 1)}


def test_partitions_are_written_and_read(spark, sf_dir, tmp_path):
    from treelake.plans.registry import Tables

    dirents = Tables(spark, sf_dir).dirents
    none = spark.createDataFrame([], "catalog string, digest string, revision long")
    headers = op.catalog_headers(dirents, none)
    op.write_catalogs(dirents, headers, str(tmp_path))
    one = headers.filter("catalog = '/r1/n1'").first()
    rows = op.read_catalog(spark, str(tmp_path), one["digest"])
    assert rows.count() == one["entries"] and one["revision"] == 1
    assert rows.exceptAll(dirents.filter("catalog = '/r1/n1'").select(rows.columns)).isEmpty()
    with pytest.raises(ValueError):
        op.read_catalog(spark, str(tmp_path), "0" * 32)


def test_objects_are_verified(spark, tmp_path):
    import hashlib

    digest = hashlib.sha1(b"good").hexdigest()
    for name, content in ((digest, b"good"), ("f" * 40, b"bad")):
        (tmp_path / name[:2]).mkdir()
        (tmp_path / name[:2] / name[2:]).write_bytes(content)
    assert {(r["hash"], r["ok"]) for r in op.fetched(spark, str(tmp_path)).collect()} == {(digest, True), ("f" * 40, False)}


def test_archive_removals(spark):
    entries = spark.createDataFrame([("a", 0, "/x"), ("a", 1, "/x"), ("a", 2, "/y")], "archive string, place long, path string")
    removed = spark.createDataFrame([("/y",), ("/z",)], "path string")
    found = archives.tar_changes(entries, removed).select(F.concat_ws(" ", "path", "action")).collect()
    assert sorted(r[0] for r in found) == ["/x add", "/y add", "/z remove"]


def test_archives_go_to_python_in_small_parts(spark):
    """Not by thousands in one Arrow batch, and each archive is read once."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name in ("./a/", "./", "b"):
            head = tarfile.TarInfo(name)
            head.type = tarfile.DIRTYPE if name.endswith("/") else tarfile.REGTYPE
            tar.addfile(head)
    found = archives.tar_entries(spark.createDataFrame([("x", buffer.getvalue())], "archive string, content binary"), "/r")
    assert sorted(map(tuple, found.select("place", "path", "kind", "target").collect())) == [(0, "/r/a", "directory", ""), (2, "/r/b", "file", "")]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain()
    assert "InPandas" not in plan.getvalue() and plan.getvalue().count("BatchEvalPython") == 1
