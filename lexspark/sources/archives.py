"""Stored laws as files: an archive whose manifest orders its members, several files, or one.

Files are rows of Spark's ``binaryFile`` source (or any table with their content). An archive is read in Python, member by
member, in the task that has its row; files of one law are joined in Spark.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<COMBINED.FMX>\n', "\n</COMBINED.FMX>"
DECLARATION = r"<\?xml[^?]*\?>"


def ordered_members(names: list[str], manifest_name: str, manifest: str) -> list[str]:
    """The data files that the manifest names, in its order; all data files where it names none that is there."""
    old = not manifest_name.endswith(".doc.fmx.xml")
    fits = lambda n: (n.endswith(".xml") and not n.endswith(".doc.xml") if old else n.endswith(".fmx.xml")) and n != manifest_name
    there = set(names)
    return [n for n in re.findall(r'FILE="([^"]+)"', manifest) if fits(n) and n in there] or [n for n in names if fits(n) and not n.endswith(".doc.xml")]


def combined(content: bytes) -> str:
    """An archive's members as one document; ValueError without a manifest."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        manifest = next((n for end in (".doc.fmx.xml", ".doc.xml") for n in names if n.endswith(end)), None)
        if manifest is None:
            raise ValueError("no manifest in the archive")
        text = lambda n: archive.read(n).decode("utf-8", "replace")
        parts = (re.sub(DECLARATION, "", text(n), count=1).strip() for n in ordered_members(names, manifest, text(manifest)))
        return HEAD + "\n".join(parts) + TAIL


def unpacked(archives: DataFrame) -> DataFrame:
    """law, xml and error of ``archives`` (law, content); a broken archive, or one without a manifest, has only an error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for law, content in zip(part["law"], part["content"]):
                xml = error = None
                try:
                    xml = combined(content)
                except (zipfile.BadZipFile, ValueError, KeyError, NotImplementedError, RuntimeError, EOFError, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"law": [law], "xml": [xml], "error": [error]})

    return archives.select(F.col("law").cast("string").alias("law"), "content").mapInPandas(read, "law string, xml string, error string")


def without_declaration(xml: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(xml, f"(?s)^(.*?){DECLARATION}", "$1"), r"^\s+|\s+$", "")


def laws(files: DataFrame) -> DataFrame:
    """law, xml and error: of the ``files`` (law, name, content) of each law the first archive, else its XML files joined in
    the order of their names, else the one there is. Files without a law, name or content are left out, as are names that end
    neither in .zip nor in .xml; a law without others has no row."""
    known = files.where("law is not null and name is not null and content is not null").select(F.col("law").cast("string").alias("law"), "name", "content")
    first_zip = known.where("name like '%.zip'").groupBy("law").agg(F.min_by("content", "name").alias("content"))
    rest = known.where("name like '%.xml'").join(first_zip.select("law"), "law", "left_anti")
    listed = rest.groupBy("law").agg(F.array_sort(F.collect_list(F.struct("name", F.decode("content", "UTF-8").alias("xml")))).alias("files"))
    joined = F.concat(F.lit(HEAD), F.array_join(F.transform("files", lambda f: without_declaration(f["xml"])), "\n"), F.lit(TAIL))
    several = listed.select("law", F.when(F.size("files") > 1, joined).otherwise(F.get("files", F.lit(0))["xml"]).alias("xml"), F.lit(None).cast("string").alias("error"))
    return unpacked(first_zip).unionByName(several)
