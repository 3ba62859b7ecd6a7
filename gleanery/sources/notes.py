"""Notes as Spark data sources: chunks of Markdown files, and entries of a vault of Markdown files with front matter.

``register(spark)`` makes ``spark.read.format("notes_markdown")`` and ``"notes_vault"`` known, for streams too. Folders are those that Arrow's file systems
open (local or mounted ones, HDFS, S3, GCS). Files are listed once per scan, and each partition reads some of them. Filters on ``file`` and
``modified`` are applied to the listing, so that files which they exclude are never opened (they are pushed if ``spark.sql.python.filterPushdown.enabled`` is set).
A stream's offset is the newest (modified, file) that it has seen: new and edited files come once each, deleted ones are not reported.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from gleanery.operators.guards import REDACTIONS

#: Signals of chunks (certainty, recency, teachingValue, priority), and what makes a text a legal one.
DOC_SIGNALS = [0.7, 0.65, 0.6, 0.55]
LEGAL_SIGNALS = [0.90, 0.72, 0.88, 0.85]
LEGAL = "normativ|ley|decreto|resoluci[oó]n|c[oó]digo|reglament|ordenanza|art[ií]culo"
#: Extensions of each source, folders that are passed over, characters of a chunk, lengths of names.
EXTENSIONS = {"notes_markdown": [".md", ".txt", ".rst"], "notes_vault": [".md"]}
IGNORED = ["node_modules"]
CHUNK_CHARS, LABEL_CHARS, SLUG_CHARS, LEGAL_CHARS = 4000, 30, 100, 500

CHUNKS = "file string, modified long, id string, source string, kind string, content string, certainty double, recency double, teachingValue double, priority double"
ENTRIES = (
    "file string, modified long, id string, title string, content string, project string, type string, sector string, source string, tags array<string>, created_at string, updated_at string, slug string, "
    "scope string, topic string, language string, severity string, risk_taxonomy string, confidence double, rule string, anti_pattern string, fix_pattern string, practice_prompt string, security_critical boolean"
)


@dataclass(frozen=True)
class Note:
    """A listed file: path, path in the folder, bytes, and milliseconds of its last change."""

    path: str
    file: str
    size: int
    modified: int


@dataclass
class Share(D.InputPartition):
    notes: list[Note]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(root: str, extensions: list[str]) -> list[Note]:
    """Files below ``root`` (or ``root`` itself), by path, without hidden folders."""
    system, top = opened(root)
    top = top.rstrip("/") or "/"
    one = system.get_file_info(top)
    found = [one] if one.is_file else system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        name = posixpath.basename(f.path) if one.is_file else posixpath.relpath(f.path, top)
        folders = name.split("/")[:-1]
        if f.is_file and posixpath.splitext(name)[1].lower() in extensions and not any(p.startswith(".") or p in IGNORED for p in folders):
            out.append(Note(f.path, name, f.size, f.mtime_ns // 1_000_000))
    return sorted(out, key=lambda n: n.file)


def redacted(text: str) -> str:
    """G-7, of a text."""
    for pattern, to in REDACTIONS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), text, flags=re.ASCII)
    return text


def slug(text: str, keep: str = "", default: str = "item") -> str:
    return re.sub(f"[^a-z0-9{keep}]+", "-", " ".join(text.split()).lower()).strip("-") or default


def headed(text: str) -> list[tuple[str, str]]:
    """(heading, content) of a text cut at its headings."""
    cut = re.split(r"^(#{1,6}\s+.+)$", "\n".join(text.splitlines()), flags=re.M)
    parts = [("", cut[0].strip())] if cut[0].strip() or len(cut) == 1 else []
    return parts + [(re.sub(r"^#{1,6}\s+", "", h).strip(), c.strip()) for h, c in zip(cut[1::2], cut[2::2], strict=True)]


def merged(parts: list[tuple[str, str]], most: int) -> list[tuple[str, str]]:
    """Neighbours together as long as they fit; the first heading names them."""
    out = parts[:1]
    for heading, content in parts[1:]:
        both = f"{out[-1][1]}\n\n## {heading}\n{content}"
        if len(both) <= most:
            out[-1] = (out[-1][0] or heading, both)
        else:
            out.append((heading, content))
    return out


def chunks_of(note: Note, text: str, options: dict[str, str]) -> Iterator[tuple]:
    """I-7: rows of CHUNKS."""
    text, most = text.strip(), int(options.get("maxchars", CHUNK_CHARS))
    if not text:
        return
    base = posixpath.basename(note.file)
    name = slug(posixpath.splitext(base)[0], default="document")
    signals = LEGAL_SIGNALS if re.search(LEGAL, f"{base} {text[:LEGAL_CHARS]}", re.I) else DOC_SIGNALS
    project = options.get("project", "")
    parts = merged(headed(text), most)
    for k, (heading, content) in enumerate(parts, 1):
        content = redacted(content)
        if len(content) > most:
            content = f"{content[:most]}\n/* content truncated */"
        label = slug(heading)[:LABEL_CHARS] if heading else f"part{k}"
        where = f"markdown://{project + '/' if project else ''}{note.file}{'#' + slug(heading) if heading else ''}"
        yield (note.file, note.modified, f"md-{name}-{label}" if len(parts) > 1 else f"md-{name}", where, "doc", f"[{base}{' — ' + heading if heading else ''}]\n{content}", *signals)


def scalar(x: str):
    """A value of front matter: quoted text, list, boolean, number or text."""
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        return x[1:-1]
    if x.startswith("[") and x.endswith("]"):
        return [scalar(y) for y in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", x[1:-1])]
    if x in ("true", "false"):
        return x == "true"
    return float(x) if re.fullmatch(r"-?\d+(\.\d+)?", x) else x


def fronted(raw: str) -> tuple[dict, str]:
    """Front matter between ``---`` lines (pairs, and lists of ``- item`` lines) and the text after it."""
    m = re.match(r"---[ \t]*\r?\n(.*?)^---[ \t]*\r?$\n?", raw, re.S | re.M)
    if not m:
        return {}, raw
    data, last = {}, None
    for line in m[1].splitlines():
        if item := re.match(r"\s*-\s+(.*)", line):
            if last is not None:
                data[last] = [*(data[last] if isinstance(data[last], list) else []), scalar(item[1])]
        elif pair := re.match(r"([A-Za-z_][\w.-]*)\s*:\s*(.*)", line):
            last, data[pair[1]] = pair[1], scalar(pair[2])
    return data, raw[m.end() :]


def entry_of(note: Note, raw: str, options: dict[str, str]) -> Iterator[tuple]:
    """I-17: the row of ENTRIES. The folders of a file are its project and its sector; what its front matter says goes before. A file without dates has
    that of its last change."""
    data, content = fronted(raw)
    text = lambda k: data[k].strip() if isinstance(data.get(k), str) else ""
    folders = note.file.split("/")[:-1]
    title = text("title") or posixpath.splitext(posixpath.basename(note.file))[0]
    sector = folders[1] if len(folders) > 1 else "memories"
    created = text("createdAt") or str(note.modified)
    name = slug(title, "_-", "note")
    name = re.sub("-+", "-", name)[:SLUG_CHARS]
    confidence = data.get("confidence")
    tags = [t.strip() for t in data["tags"] if isinstance(t, str) and t.strip()] if isinstance(data.get("tags"), list) else []
    more = lambda *keys: [text(k) or None for k in keys]
    yield (
        note.file, note.modified, text("id") or name, title, content.strip(), text("project") or (folders[0] if folders else options.get("project", "_default")), text("type") or text("memoryType") or sector, text("sector") or sector,
        text("source") or "obsidian", tags, created, text("updatedAt") or created, name, *more("scope", "topic", "language", "severity", "riskTaxonomy"),
        max(0.0, min(1.0, confidence)) if isinstance(confidence, float) else None, *more("rule", "antiPattern", "fixPattern", "practicePrompt"), data["securityCritical"] if isinstance(data.get("securityCritical"), bool) else None,
    )


class Reader:
    """What batches and streams share: listing, sharing out and parsing files."""

    def __init__(self, source: NoteSource):
        self.options = {k.lower(): v for k, v in source.options.items()}
        if "path" not in self.options:
            raise ValueError("notes need a path: .load(folder)")
        self.extensions, self.parse = EXTENSIONS[source.name()], source.parse

    def notes(self) -> list[Note]:
        return listed(self.options["path"], self.extensions)

    def shares(self, notes: list[Note]) -> list[Share]:
        """Files in partitions of about ``bytesperpartition`` each."""
        most, out, size = int(self.options.get("bytesperpartition", 16 << 20)), [], 0
        for n in notes:
            if not out or size + n.size > most:
                out.append(Share([]))
                size = 0
            out[-1].notes.append(n)
            size += n.size
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        system, _ = opened(self.options["path"])
        for n in partition.notes:
            with system.open_input_stream(n.path) as f:
                yield from self.parse(n, f.read().decode("utf-8", "replace").removeprefix("﻿"), self.options)


#: Filters that a listing can judge, on ``file`` and ``modified``.
_TESTS: dict[type, Callable] = {
    D.EqualTo: lambda x, v: x == v, D.In: lambda x, v: x in v, D.StringStartsWith: lambda x, v: x.startswith(v), D.StringEndsWith: lambda x, v: x.endswith(v), D.StringContains: lambda x, v: v in x,
    D.GreaterThan: lambda x, v: x > v, D.GreaterThanOrEqual: lambda x, v: x >= v, D.LessThan: lambda x, v: x < v, D.LessThanOrEqual: lambda x, v: x <= v,
}


class BatchReader(Reader, D.DataSourceReader):
    def __init__(self, source: NoteSource):
        super().__init__(source)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("file",), ("modified",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            elif not (isinstance(f, D.IsNotNull) and f.attribute in (("file",), ("modified",))):
                yield f

    def partitions(self):
        return self.shares([n for n in self.notes() if all(_TESTS[kind](getattr(n, c), v) for c, kind, v in self.tests)])


class StreamReader(Reader, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"modified": -1, "file": ""}

    def latestOffset(self) -> dict:
        newest = max(((n.modified, n.file) for n in self.notes()), default=(-1, ""))
        return {"modified": newest[0], "file": newest[1]}

    def partitions(self, start: dict, end: dict):
        at = lambda o: (o["modified"], o["file"])
        return self.shares([n for n in self.notes() if at(start) < (n.modified, n.file) <= at(end)])


class NoteSource(D.DataSource):
    """Options: path (of ``load``), project, maxChars, bytesPerPartition."""

    parse: Callable[[Note, str, dict[str, str]], Iterator[tuple]]

    def reader(self, schema):
        return BatchReader(self)

    def streamReader(self, schema):
        return StreamReader(self)


class MarkdownNotes(NoteSource):
    parse = staticmethod(chunks_of)

    @classmethod
    def name(cls) -> str:
        return "notes_markdown"

    def schema(self) -> str:
        return CHUNKS


class VaultNotes(NoteSource):
    parse = staticmethod(entry_of)

    @classmethod
    def name(cls) -> str:
        return "notes_vault"

    def schema(self) -> str:
        return ENTRIES


#: I-9: sources by name; more may be added before ``register``.
SOURCES: dict[str, type[D.DataSource]] = {s.name(): s for s in (MarkdownNotes, VaultNotes)}


def register(spark: SparkSession, *names: str) -> list[str]:
    """Makes the named sources (all without names) known to ``spark``; their names."""
    for name in names or SOURCES:
        spark.dataSource.register(SOURCES[name])
    return sorted(names or SOURCES)
