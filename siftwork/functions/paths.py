"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column | str) -> Column:
    """The form ``./a/b``: forward slashes, no empty and no ``.`` segments, ``..`` taken back where it can be.

    Null stays null; an empty path becomes ``.``.
    """
    p = F.col(path) if isinstance(path, str) else path
    segments = F.filter(F.split(F.translate(p, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s))),
    )
    kept = F.when(F.contains(p, F.lit("..")), resolved).otherwise(segments)
    return F.when(p.isNotNull(), F.concat_ws("/", F.concat(F.array(F.lit(".")), kept)))


def _before(path: Column, mark: str) -> Column:
    """From the first occurrence of ``mark`` on, null without one."""
    at = F.instr(path, mark)
    return F.when(at > 0, F.substring(path, at, F.length(path)))


def project_relative(path: Column, root: str) -> Column:
    """``./rest`` of a path below ``root``; else from its first ``/src/`` on; else the path itself."""
    top = root.rstrip("/") + "/"
    from_src = _before(path, "/src/")
    return F.when(F.startswith(path, F.lit(top)), F.concat(F.lit("./"), F.substring(path, len(top) + 1, 1 << 30))).when(from_src.isNotNull(), F.concat(F.lit("."), from_src)).otherwise(path)


def lookup_key(path: Column, root: str) -> Column:
    """The key under which a path is looked up: absolute ones relative to the project, others with ``./`` in front."""
    return F.when(F.startswith(path, F.lit("/")), project_relative(path, root)).when(F.startswith(path, F.lit("./")), path).otherwise(F.concat(F.lit("./"), path))


def paths_match(a: Column, b: Column) -> Column:
    """Whether two paths name the same file: equal without ``./``, or equal from ``/src/`` on."""
    bare = lambda p: F.regexp_replace(p, r"^\./", "")
    tail = lambda p: _before(F.concat(F.lit("/"), bare(p)), "/src/")
    return (bare(a) == bare(b)) | F.coalesce(tail(a) == tail(b), F.lit(False))
