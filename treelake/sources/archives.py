"""Tar archives as entries: one row per member, from its header."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of members by the letter that the tar format gives them.
KINDS = {tarfile.DIRTYPE: "directory", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file"}


MEMBERS = "array<struct<place:bigint,path:string,kind:string,mode:int,size:bigint,mtime:bigint,target:string>>"


def tar_entries(archives: DataFrame, base: str = "") -> DataFrame:
    """archive, place, path, kind, mode, size, mtime, target of the members of archives (archive, content binary).

    Paths are put under base, without '.' and trailing slashes; the archive's own root gives no row; other kinds are
    special. Members come with their place, as a later one of the same path replaces an earlier one. Archives go to Python
    a hundred at a time, not in Arrow's batches of thousands; content that a function makes from a row stays in its worker.
    """

    def normal(name: str) -> str:
        return "/".join(p for p in name.split("/") if p not in ("", "."))

    def members(content: bytes) -> list[tuple]:
        out = []
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for place, m in enumerate(tar):
                if name := normal(m.name):
                    target = m.linkname if m.issym() else f"{base}/{normal(m.linkname)}" if m.islnk() else ""
                    out.append((place, f"{base}/{name}", KINDS.get(m.type, "special"), m.mode, m.size, int(m.mtime), target))
        return out

    # inline would first ask for the number of members, and so read every archive twice
    found = F.udf(members, MEMBERS, useArrow=False)
    return archives.select("archive", found("content").alias("members")).select("archive", F.inline_outer("members")).filter("place is not null")


def tar_changes(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """path, action of archive entries and of a list of paths to remove: the last member of a path counts; removals come first."""
    last = entries.groupBy("archive", "path").agg({"place": "max"}).select("path").distinct()
    gone = removed.select("path").distinct().join(last, "path", "left_anti")
    return last.selectExpr("path", "'add' AS action").unionByName(gone.selectExpr("path", "'remove' AS action"))
