"""A batch directory that appears whole or not at all: ``format("quern_pages")`` (SNK-02, SNK-09, SRC-13).

    register(spark)
    pages.write.format("quern_pages").mode("append").option("job", "monday").save(path)
    spark.read.format("quern_pages").load(path)          # (name, url, content)

Tasks write into a folder of their own attempt below ``_staging``; their commit messages
name it and say how much it holds, however much that is.  The commit moves the folders of
the attempts that won below ``pages/<job>`` and only then writes the job's manifest, which
is the only thing that readers go by: a job that dies before has left nothing to read, and
``abort`` or the next commit of the job clears what it staged.  A job that was committed and
is run again (same ``job``) changes nothing.  Overwriting writes a manifest that hides all
before it.

``files`` says what a task writes: ``parts`` (JSON lines, the default) or ``pages`` (a file
a page, as people read them).  Any store that pyarrow knows will do; names are taken as
they are and must be distinct and without a slash.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, url string, content string"
#: Bytes of pages after which a task begins another part.
PART = 64 << 20


def _store(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, at.rstrip("/")


def _names(store, at: str) -> list[str]:
    from pyarrow import fs

    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def _read(store, at: str) -> bytes:
    with store.open_input_stream(at) as f:
        return f.read()


def _write(store, at: str, data: bytes) -> None:
    with store.open_output_stream(at) as f:
        f.write(data)


def manifests(path: str) -> list[dict]:
    """The manifests that count, oldest first."""
    store, at = _store(path)
    held = [json.loads(_read(store, f"{at}/manifests/{n}")) for n in _names(store, f"{at}/manifests") if n.endswith(".json")]
    held.sort(key=lambda m: (m["at"], m["job"]))
    last = max((k for k, m in enumerate(held) if m["hides"]), default=0)
    return held[last:]


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    pages: int
    size: int


class PagesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job, self.files = options.get("job") or uuid.uuid4().hex, options.get("files", "parts")
        if self.files not in ("parts", "pages") or "/" in self.job:
            raise ValueError("files is parts or pages, and a job's name has no slash")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, at = _store(self.path)
        folder = f"{self.job}/{self.run}-{uuid.uuid4().hex}"
        where = f"{at}/_staging/{folder}"
        store.create_dir(where, recursive=True)
        held, size, pages, whole = [], 0, 0, 0

        def flush() -> None:
            if held:
                _write(store, f"{where}/part-{pages:09d}.jsonl", b"".join(held))

        for row in iterator:
            if not row.name or "/" in row.name:
                raise ValueError(f"a page cannot be called {row.name!r}")
            if self.files == "pages":
                _write(store, f"{where}/{row.name}", (row.content or "").encode())
                line = json.dumps({"name": row.name, "url": row.url}).encode() + b"\n"
            else:
                line = json.dumps({"name": row.name, "url": row.url, "content": row.content}, ensure_ascii=False).encode() + b"\n"
            held.append(line)
            pages, size, whole = pages + 1, size + len(line), whole + len((row.content or "").encode())
            if size >= PART:
                flush()
                held, size = [], 0
        flush()
        return Staged(folder, pages, whole)

    def commit(self, messages: list[Staged | None]) -> None:
        store, at = _store(self.path)
        if f"{self.job}.json" in _names(store, f"{at}/manifests"):
            self._cleared(store, at)
            return
        won = [m for m in messages if m is not None and m.pages]
        target = f"{at}/pages/{self.job}"
        if _names(store, target):  # moved by a commit that died before its manifest
            store.delete_dir_contents(target)
        store.create_dir(target, recursive=True)
        for k, m in enumerate(won):
            store.move(f"{at}/_staging/{m.folder}", f"{target}/{k:06d}")
        said = {"job": self.job, "at": time.time_ns(), "hides": self.overwrite, "files": self.files, "pages": sum(m.pages for m in won), "size": sum(m.size for m in won), "parts": [f"pages/{self.job}/{k:06d}" for k in range(len(won))]}
        store.create_dir(f"{at}/manifests", recursive=True)
        _write(store, f"{at}/manifests/.{self.run}", json.dumps(said).encode())
        store.move(f"{at}/manifests/.{self.run}", f"{at}/manifests/{self.job}.json")
        self._cleared(store, at)

    def abort(self, messages: list[Staged | None]) -> None:
        self._cleared(*_store(self.path))

    def _cleared(self, store, at: str) -> None:
        if _names(store, f"{at}/_staging/{self.job}"):
            store.delete_dir(f"{at}/_staging/{self.job}")


@dataclass
class Part(InputPartition):
    folder: str
    files: str

    def __post_init__(self):
        super().__init__(None)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        return [Part(p, m["files"]) for m in manifests(self.path) for p in m["parts"]] or [Part("", "parts")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.folder:
            return
        store, at = _store(self.path)
        where = f"{at}/{partition.folder}"
        for name in _names(store, where):
            if not name.endswith(".jsonl"):
                continue
            for line in _read(store, f"{where}/{name}").split(b"\n"):
                if line:
                    x = json.loads(line)
                    content = _read(store, f"{where}/{x['name']}").decode() if partition.files == "pages" else x["content"]
                    yield x["name"], x["url"], content


class PagesSource(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return "quern_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        if bad := {"name", "url", "content"} - set(schema.names):
            raise ValueError(f"pages need columns {', '.join(sorted(bad))}")
        return PagesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)
