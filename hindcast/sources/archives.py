"""Archive members and registry payloads as rows: zip and tar contents, links in JSON."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsafe(name: str) -> bool:
    """Whether a member's name leaves the folder that it would be unpacked in."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) == 2 and parts[0][1] == ":")


def members(kind: str, content: bytes) -> list[tuple[str, bytes]]:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not unsafe(i.filename)]
            bad = [i.filename for i in z.infolist() if unsafe(i.filename)]
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            bad = [m.name for m in t.getmembers() if unsafe(m.name) or m.issym() or m.islnk()]
            found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and m.name not in bad]
    if bad:
        raise ValueError(f"archive member {bad[0]!r} leaves its folder")
    return found


def archive_members(archives: DataFrame, kind: str, name: str = "path", content: str = "content", only: bool = False) -> DataFrame:
    """(archive, member, content) of each member, from rows as the binaryFile source gives them.

    Names that leave the folder, and links, raise; only=True asks for exactly one member. An archive is read whole by one
    task, so archives should be of a size that a task can hold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["content"], strict=True):
                found = members(kind, data)
                if only and len(found) != 1:
                    raise ValueError(f"{archive} has {len(found)} members, not one")
                yield pd.DataFrame({"archive": archive, "member": [m for m, _ in found], "content": [c for _, c in found]})

    return archives.select(F.col(name).alias("archive"), F.col(content).alias("content")).mapInPandas(run, "archive string, member string, content binary")


def zipped(rows: DataFrame, archive: str, member: str, text: str) -> DataFrame:
    """(path, content): a zip for each archive name, with a member for each row."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in sorted(zip(pdf[member], pdf[text], strict=True)):
                z.writestr(zipfile.ZipInfo(name), body)
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    return rows.groupBy(archive).applyInPandas(pack, "path string, content binary")


def strings_in_json(payload: Column) -> Column:
    """Every string in a JSON text, keys too, at any depth."""
    return F.transform(F.regexp_extract_all(payload, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda x: F.regexp_replace(x, r"\\/", "/"))


def links_in_json(payload: Column) -> Column:
    """Distinct web and iRODS addresses among the strings, without closing punctuation, in order."""
    cleaned = F.transform(strings_in_json(payload), lambda x: F.regexp_replace(F.trim(x), r"[.,;)\]>]+\z", ""))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.rlike(r"^(https?|irods):/"))))
