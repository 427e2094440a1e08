"""Artifacts as a data source: one file for each run, syntheses and graphs as YAML, graphs also as XML.

    spark.dataSource.register(ArtifactSource)
    df.write.format("artifact").option("kind", "synthesis").mode("append").save(folder)
    spark.read.format("artifact").option("kind", "graph").option("form", "xml").load(folder)

A task writes its files into a folder of its own under the target. Only when every task has ended
does the driver move them to their places, so a failed job leaves no artifact, and of a task that
was run twice one attempt's files are taken. What was not taken is removed when the job ends, or,
if tasks of a failed job went on after that, when the next one does; a folder has one writer at a
time. `append` adds
runs and replaces those that are there under the same id; `overwrite` leaves only the new ones.

The folder is a path, or a URI of a store that pyarrow opens; it must be one that all executors
share. A run's file is named by its id, percent-encoded. Reading takes some files a task; the option
`runs`, a JSON list of ids, opens only their files.

The option `folders`, a number, deals the files out to so many folders of the target, by a hash of
the runs' ids (`folder_of`), and tasks list those when they read: the driver never has a list of
all files, as it has of a target without folders. Rows that are dealt out to tasks in the same way
make few folders while they are written. `append` keeps to the folders that are there, and a number
that is not theirs is an error; `overwrite` may change it.

Defined results: fields that are null or empty and may be left out are, and are read as null, empty
or false again; unknown keys are passed over; a run without an id, or twice in one write, fails
the job; an empty table writes no file; XML has a graph's nodes and edges only.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.replies import resolved, tree

#: Where an artifact comes from; fields of both kinds.
ORIGIN = "schema_version string, study_id string, round_id string, question_id string, generated_at string, model string, prompt_version string, code_version string"
QUOTE = "source:string,text:string,status:string,snapped:boolean,inherited:boolean,node_id:string"
CLAIM = f"text:string,agreement_level:string,sources:array<string>,counterarguments:array<string>,support_level:string,evidence_grade:string,method:string,year:string,lineage:string,quotes:array<struct<{QUOTE}>>,node_refs:array<string>,citation:string"
SCHEMAS = {
    "synthesis": f"run_id string, {ORIGIN}, claims array<struct<{CLAIM}>>, areas_of_agreement array<string>, areas_of_disagreement array<string>, uncertainties array<string>, minority_reports array<struct<source_ids:array<string>,perspective:string>>, narrative string, narrative_statements array<struct<text:string,claim_refs:array<string>,expert_refs:array<string>>>, gaps array<struct<description:string,gap_type:string>>",
    "graph": f"run_id string, {ORIGIN}, nodes array<struct<id:string,claim:string,expert_id:string,quote:string,verification_status:string>>, edges array<struct<source:string,target:string,relation:string>>, node_annotations array<struct<node_id:string,annotation:string>>",
}
#: Fields that a file leaves out where they are null, false or empty.
LEFT_OUT = {"support_level", "evidence_grade", "method", "year", "lineage", "quotes", "node_refs", "citation", "status", "snapped", "inherited", "node_id", "gap_type", "gaps"}
FORMS = ("yaml", "xml")
#: Files of a reading task, more where there would be more tasks than TASKS; of a target without folders.
FILES_OF_TASK = 64
TASKS = 2048
PENDING = "_pending-"
#: Folders that a task deals its files to by their runs, so that the driver looks for runs that are there twice in one after the other; of a target without folders.
FOLDERS = 64
#: A folder of the target, and of how many.
DEALT = re.compile(r"(\d+)-of-(\d+)")


def shaped(value: Any, kind: T.DataType) -> Any:
    """What YAML gave, or a row's value, as the plain value of a type: missing lists are empty, missing flags false."""
    if isinstance(kind, T.StructType):
        got = value.asDict() if isinstance(value, Row) else value or {}
        return {f.name: shaped(got.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [shaped(v, kind.elementType) for v in value or []]
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return None if value is None else str(value)


def slim(value: Any) -> Any:
    """value without the fields that may be left out."""
    if isinstance(value, dict):
        return {k: slim(v) for k, v in value.items() if not (k in LEFT_OUT and (v is None or v is False or v == []))}
    return [slim(v) for v in value] if isinstance(value, list) else value


def yaml_of(artifact: dict) -> str:
    import yaml

    return yaml.dump(slim(artifact), Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=False, allow_unicode=True, width=1 << 20)


def of_yaml(text: str) -> dict:
    """A mapping; scalars are text as they stand, but for nulls and flags that aren't quoted."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

    Loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|false)$"), ["t", "f"])
    got = yaml.load(text, Loader=Loader)
    if not isinstance(got, dict):
        raise ValueError("it is no mapping")
    return got


def xml_of(artifact: dict) -> str:
    lines = ["<graph>"]
    named = {'"': "&quot;"}
    for n in artifact.get("nodes", []):
        quoted = f"<quote>{escape(n['quote'])}</quote>" if (n.get("quote") or "").strip() else ""
        lines.append(f'  <node id="{escape(n["id"] or "", named)}" type="claim"><text>{escape(n["claim"] or "")}</text>{quoted}<source>{escape(n["expert_id"] or "")}</source></node>')
    lines += [f'  <edge source="{escape(e["source"] or "", named)}" target="{escape(e["target"] or "", named)}" type="{escape(e["relation"] or "", named)}"/>' for e in artifact.get("edges", [])]
    return "\n".join([*lines, "</graph>"])


def of_xml(text: str) -> dict:
    root, whole = tree(text)
    if not whole:
        raise ValueError("the graph's tags do not match")

    def own(e, tag: str) -> str | None:
        found = [*e.filled(tag)]
        return found[-1].text() if found else None

    nodes = [{"id": resolved(n.attributes.get("id", "")), "claim": own(n, "text") or "", "expert_id": own(n, "source") or "", "quote": own(n, "quote")} for n in root.filled("node")]
    edges = [{k: resolved(e.attributes.get(a, "")) for k, a in (("source", "source"), ("target", "target"), ("relation", "type"))} for e in root.all("edge") if e.closed]
    return {"nodes": nodes, "edges": edges}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def entries(store: fs.FileSystem, folder: str, missing: bool = True) -> Iterator[tuple[str, fs.FileType]]:
    """What a folder has, which may be missing; one after the other where the store is of this machine, for others pyarrow has a list of all."""
    if not isinstance(store, fs.LocalFileSystem):
        for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=missing)):
            yield i.base_name, i.type
    elif not missing or os.path.isdir(folder):
        with os.scandir(folder) as found:
            for e in found:
                yield e.name, fs.FileType.File if e.is_file() else fs.FileType.Directory if e.is_dir() else fs.FileType.Unknown


def files(store: fs.FileSystem, folder: str, form: str) -> list[str]:
    return sorted(n for n, kind in entries(store, folder) if kind == fs.FileType.File and n.endswith(f".{form}"))


def folder_of(run_id: Column, folders: int) -> Column:
    """The number of a run's folder, as the writer has it."""
    return (F.crc32(run_id) % folders).cast("int")


def number_of(run_id: str, folders: int) -> int:
    return zlib.crc32(run_id.encode()) % folders


@dataclass
class Files(InputPartition):
    """Files of a folder of the target, or all that it has; the target's own folder is the empty one."""

    folder: str
    names: list[str] | None


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, which have their names already; the driver is not sent a list of them."""

    folder: str


class ArtifactSource(DataSource):
    """Options: path; kind `synthesis` (default) or `graph`; form `yaml` (default) or `xml`, of graphs; folders, of a write."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def settings(self) -> tuple[str, str, str]:
        kind, form, path = self.options.get("kind", "synthesis"), self.options.get("form", "yaml"), self.options.get("path")
        if kind not in SCHEMAS or form not in FORMS or (form == "xml" and kind != "graph") or not path:
            raise AnalysisException(f"artifact needs a path, a kind of {', '.join(SCHEMAS)} and a form that it has, not path={path}, kind={kind}, form={form}")
        return path.rstrip("/"), kind, form

    def schema(self) -> str:
        return SCHEMAS[self.settings()[1]]

    def reader(self, schema: T.StructType) -> ArtifactReader:
        return ArtifactReader(*self.settings(), schema, self.options.get("runs"))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArtifactWriter:
        folders = self.options.get("folders")
        if folders is not None and not (folders.isdecimal() and int(folders)):
            raise AnalysisException(f"artifact needs a number of folders, 1 or more, not {folders}")
        return ArtifactWriter(*self.settings(), schema, overwrite, folders and int(folders))


class ArtifactReader(DataSourceReader):
    def __init__(self, path: str, kind: str, form: str, schema: T.StructType, runs: str | None):
        self.path, self.kind, self.form, self.schema = path, kind, form, schema
        self.runs = None if runs is None else set(json.loads(runs))

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        names, folders = [], []
        for n, kind in entries(store, root, missing=False):
            if kind == fs.FileType.File and n.endswith(f".{self.form}") and self.wanted(n):
                names.append(n)
            elif kind == fs.FileType.Directory and (m := DEALT.fullmatch(n)) and (self.runs is None or any(number_of(r, int(m[2])) == int(m[1]) for r in self.runs)):
                folders.append(n)
        names.sort()
        step = max(FILES_OF_TASK, -(-len(names) // TASKS))
        return [Files("", names[i : i + step]) for i in range(0, len(names), step)] + [Files(f, None) for f in sorted(folders)] or [Files("", [])]

    def wanted(self, name: str) -> bool:
        return self.runs is None or self.run_of(name) in self.runs

    def run_of(self, name: str) -> str:
        return unquote(name.removesuffix(f".{self.form}"))

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = opened(self.path)
        folder = f"{root}/{partition.folder}".rstrip("/")
        names = partition.names if partition.names is not None else [n for n in files(store, folder, self.form) if self.wanted(n)]
        for name in names:
            path = f"{folder}/{name}"
            with store.open_input_stream(path) as f:
                text = f.read().decode()
            try:
                got = of_yaml(text) if self.form == "yaml" else of_xml(text)
            except Exception as e:
                raise ValueError(f"{path} is no {self.kind} in {self.form}: {e}") from e
            got = shaped(got, self.schema)
            yield tuple(self.run_of(name) if n == "run_id" else got[n] for n in self.schema.names)


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, form: str, schema: T.StructType, overwrite: bool, folders: int | None = None):
        self.path, self.kind, self.form, self.schema, self.overwrite = path, kind, form, schema, overwrite
        self.pending = f"{PENDING}{uuid.uuid4().hex}"
        if "run_id" not in schema.names:
            raise AnalysisException("artifact needs a column run_id")
        there = None if overwrite else self.folders_there()
        if None not in (folders, there) and folders != there:
            raise AnalysisException(f"{path} has its runs in {there or 'no'} folders, not in {folders}")
        #: 0: the runs are in the target itself.
        self.folders = folders if there is None else there

    def folders_there(self) -> int | None:
        """How many folders the target's runs are dealt out to; None if it has no runs."""
        store, root = opened(self.path)
        for n, kind in entries(store, root):
            if kind == fs.FileType.Directory and (m := DEALT.fullmatch(n)):
                return int(m[2])
            if kind == fs.FileType.File and n.endswith(tuple(f".{f}" for f in FORMS)):
                return 0
        return None

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        folder, names = f"{root}/{self.pending}/{uuid.uuid4().hex}", set()
        store.create_dir(folder)
        for row in iterator:
            got = dict(zip(self.schema.names, row, strict=True))
            if got["run_id"] is None:
                raise ValueError("an artifact has no run_id")
            name = f"{quote(str(got['run_id']), safe='')}.{self.form}"
            artifact = shaped(got, self.schema)
            artifact.pop("run_id")
            if name in names:
                raise ValueError("a run is there twice")
            names.add(name)
            part = f"{folder}/{number_of(str(got['run_id']), self.folders or FOLDERS)}"
            store.create_dir(part)
            with store.open_output_stream(f"{part}/{name}") as f:
                f.write((yaml_of(artifact) if self.form == "yaml" else xml_of(artifact)).encode())
        return Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root)
        parts = defaultdict(list)
        for m in messages:
            for number, _ in entries(store, m.folder) if m is not None else ():
                parts[int(number)].append(f"{m.folder}/{number}")
        for same in parts.values():
            names = [n for p in same for n in files(store, p, self.form)]
            if len(set(names)) < len(names):
                self.abort(messages)
                raise ValueError("a run is there twice")
        places, kept = set(), set()
        for number, same in sorted(parts.items()):
            place = f"{root}/{number:05d}-of-{self.folders:05d}" if self.folders else root
            if place not in places:
                store.create_dir(place)
                places.add(place)
            for p in same:
                for n in files(store, p, self.form):
                    store.move(f"{p}/{n}", f"{place}/{n}")
                    if self.overwrite:
                        kept.add(n)
            if self.overwrite and self.folders:
                self.drop(store, place, kept)
                kept.clear()
        if self.overwrite:
            for place in [root, *[f"{root}/{n}" for n, kind in entries(store, root) if kind == fs.FileType.Directory and DEALT.fullmatch(n)]]:
                if place == root or place not in places:
                    self.drop(store, place, kept if place == root else set())
        self.drop_pending()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.drop_pending()

    def drop(self, store: fs.FileSystem, place: str, kept: set[str]) -> None:
        """Remove a folder's files of this form but those that are kept, and a folder that is left empty, but for the target's own."""
        for n in files(store, place, self.form):
            if n not in kept:
                store.delete_file(f"{place}/{n}")
        if DEALT.fullmatch(place.rsplit("/", 1)[-1]) and next(entries(store, place), None) is None:
            store.delete_dir(place)

    def drop_pending(self) -> None:
        """Remove what tasks wrote and nobody took, of earlier failed jobs too."""
        store, root = opened(self.path)
        for n in [n for n, kind in entries(store, root) if kind == fs.FileType.Directory and n.startswith(PENDING)]:
            store.delete_dir(f"{root}/{n}")
