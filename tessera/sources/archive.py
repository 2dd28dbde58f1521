"""An archive of fetched payloads as a data source: repositories, works by DOI and papers, decoded to page payloads.

An archive is a folder of JSON lines, plain or gzipped, in one folder a kind (`kind=repository` and so on), as Spark writes them.
Each file is a partition. Conditions on kind are taken by the source: other kinds' files are never opened. Folders without a scheme
or with that of files are read as such; all others through Arrow's file systems, for the stores that these know.
"""

from __future__ import annotations

import base64
import gzip
import html
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import IO
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

#: Characters of a title and of a first paragraph, of release notes, and how many authors are named.
TITLE_CHARS, FIRST_CHARS, RELEASE_CHARS, WORK_AUTHORS, PAPER_AUTHORS = 500, 800, 12_000, 8, 12
SCHEMA = "kind string, url string, title string, final_url string, first_paragraph string, content string"


def _plain(markup: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", markup)).split())


def _text(x: object) -> str:
    return x.strip() if isinstance(x, str) else ""


def _first(x: object) -> str:
    return _text(x[0] if isinstance(x, list) and x else x)


def repository(r: dict) -> tuple[str, str, str] | None:
    """Title, address and text of a repository's README (base64) and latest release; null where both are empty."""
    name, parts = f"{r.get('owner')}/{r.get('repo')}", []
    try:
        readme = base64.b64decode((r.get("readme") or {}).get("content") or "").decode("utf-8", "replace").strip()
    except ValueError:
        readme = ""
    release = r.get("release") or {}
    tag, notes = _text(release.get("tag_name")), _text(release.get("body"))
    parts += [f"# README\n\n{readme}"] if readme else []
    parts += [f"# Latest release ({tag})\n\n{notes[:RELEASE_CHARS]}"] if tag or notes else []
    return (name, f"https://github.com/{name}", "\n\n---\n\n".join(parts)) if parts else None


def work(r: dict) -> tuple[str, str, str] | None:
    """Title, address and text of a registered work: authors and its abstract, else where and when it appeared."""
    m = r.get("message") or {}
    title = _first(m.get("title")) or "Crossref work"
    names = [f"{_text(a.get('given'))} {_text(a.get('family'))}".strip() for a in (m.get("author") or [])[:WORK_AUTHORS] if isinstance(a, dict)]
    dates = (m.get("issued") or {}).get("date-parts") or []
    about = _plain(_text(m.get("abstract"))) or " - ".join(x for x in (_first(m.get("container-title")), str(dates[0]) if dates else "") if x)
    head = f"Authors: {', '.join(names)}\n\n" if names else ""
    return title, f"https://doi.org/{r.get('doi')}", f"# {title}\n\n{head}{about}".strip()


def paper(r: dict) -> tuple[str, str, str] | None:
    """Title, address and text of a paper: year, authors and abstract."""
    p = r.get("paper") or {}
    title = _text(p.get("title")) or "Semantic Scholar paper"
    names = [a["name"] for a in (p.get("authors") or [])[:PAPER_AUTHORS] if isinstance(a, dict) and a.get("name")]
    parts = [f"# {title}", f"Year: {p['year']}" if p.get("year") else "", f"Authors: {', '.join(names)}" if names else "", _text(p.get("abstract"))]
    return title, _text(p.get("url")) or f"https://www.semanticscholar.org/paper/{r.get('paper_id')}", "\n\n".join(x for x in parts if x)


KINDS = {"repository": repository, "doi": work, "paper": paper}


def payload(kind: str, record: dict, max_chars: int) -> tuple | None:
    """A row of the source, or null where a record has nothing usable."""
    found = KINDS[kind](record)
    if found is None:
        return None
    title, url, text = found
    text = text.strip()[:max_chars]
    return kind, record.get("url"), title[:TITLE_CHARS] or url, url, text.split("\n\n")[0].strip() or text[:FIRST_CHARS], text


class _File(InputPartition):
    def __init__(self, kind: str, path: str) -> None:
        self.kind, self.path = kind, path


class _Reader(DataSourceReader):
    def __init__(self, place: str, max_chars: int) -> None:
        self.place, self.max_chars, self.kinds = place, max_chars, set(KINDS)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= set(f.value)
            elif isinstance(f, IsNotNull) and f.attribute == ("kind",):
                continue  # no row is without one
            else:
                yield f

    def _local(self) -> str | None:
        """The folder's path where it is one of files."""
        place = re.sub("^file:(//)?", "", self.place)
        return None if "://" in place else unquote(place) if place != self.place else place

    def partitions(self) -> list[_File]:
        root, found = self._local(), []
        for kind in sorted(self.kinds):
            if root is not None:
                found += [_File(kind, str(p)) for p in sorted(Path(root, f"kind={kind}").rglob("*")) if p.is_file() and p.name[0] not in "_."]
            else:
                from pyarrow import fs

                system, top = fs.FileSystem.from_uri(self.place)
                infos = system.get_file_info(fs.FileSelector(f"{top}/kind={kind}", allow_not_found=True, recursive=True))
                found += [_File(kind, f.path) for f in sorted(infos, key=lambda f: f.path) if f.is_file and f.base_name[0] not in "_."]
        return found

    def _opened(self, path: str) -> IO[bytes]:
        if self._local() is not None:
            return open(path, "rb")
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.place)[0].open_input_stream(path, compression=None)

    def read(self, partition: _File) -> Iterator[tuple]:
        with self._opened(partition.path) as stream:
            for line in gzip.open(stream) if partition.path.endswith(".gz") else stream.read().splitlines():
                row = payload(partition.kind, json.loads(line), self.max_chars) if line.strip() else None
                if row:
                    yield row


class PayloadArchive(DataSource):
    """spark.read.format("payload_archive").option("max_chars", 4000).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "payload_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("max_chars", 4000)))


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadArchive)
