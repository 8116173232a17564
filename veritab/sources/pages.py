"""Pages of PDF files as a data source: ``spark.read.format("pdf_pages").load(folder)``.

A partition is a range of pages of one file, so a long file is read by many tasks. A page
that cannot be read is a row with its error, and so is a file with too many pages: nothing
is left out in silence. There is no renderer here; a page's text is what its content writes
in simple fonts. Extractors that need pictures get the file and the page's number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGES, PAGES_A_TASK = 500, 20
OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|Td|TD|Tm|ET)\b|\bT\*|'", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The PDF files of a folder (or the file itself), as paths to be opened again elsewhere."""
    system, at = opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".pdf"))
    root = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [root + n for n in names]


class Pdf:
    """The objects of a file, and its pages in order."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        self.objects = {int(n): body for n, _, body in OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)
        self.pages = self._tree()

    def _unpack(self, body: bytes) -> None:
        """Objects that are kept in a compressed stream."""
        inside, n, first = inflated(body), *(int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
        numbers = list(map(int, inside[:first].split()[: 2 * n]))
        starts = [*numbers[1::2], len(inside) - first]
        for i, name in enumerate(numbers[::2]):
            self.objects.setdefault(name, inside[first + starts[i] : first + starts[i + 1]])

    def _tree(self) -> list[int]:
        """Numbers of the page objects, by the page tree, or as they stand in the file where it has none."""
        root = next((int(m[1]) for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b))), None)
        found, seen, to_see = [], set(), [root] if root is not None else []
        while to_see:
            n = to_see.pop()
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            if (kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)) is not None:
                to_see += [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
            else:
                found.append(n)
        return found or sorted(n for n, b in self.objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))

    def text(self, page: int) -> str:
        body = self.objects.get(self.pages[page])
        if body is None:
            raise ValueError("the page's object is missing")
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = [self.objects[int(n)] for n in re.findall(rb"(\d+)\s+\d+\s+R", contents[1])] if contents else []
        return shown_text(b"\n".join(inflated(p) for p in parts))


def inflated(body: bytes) -> bytes:
    data = STREAM.search(body)
    if data is None:
        raise ValueError("no stream")
    return zlib.decompress(data[1]) if b"/FlateDecode" in body else data[1]


def shown_text(content: bytes) -> str:
    """The strings that a content stream shows, a line for each new place."""
    out: list[bytes] = []
    for m in SHOWN.finditer(content):
        token = m[0]
        if token.startswith(b"("):
            out.append(re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else ESCAPES.get(e[1], e[1]), token[1:-1], flags=re.S))
        elif token.startswith(b"<"):
            out.append(bytes.fromhex(token[1:-1].decode()))
        elif token not in (b"Tj", b"TJ") and out and out[-1] != b"\n":
            out.append(b"\n")
    return b"".join(out).decode("latin-1").strip("\n")


@dataclass
class PageRange(InputPartition):
    """Pages ``first`` to ``last`` - 1 of a file; ``error``: why the file has none."""

    path: str
    first: int = 0
    last: int = 0
    error: str | None = None


class PdfPages(DataSource):
    """Options: path; max_pages of a file (500); pages_per_task (20)."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "path string, page int, pages int, text string, failed boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.most, self.step = options["path"], int(options.get("max_pages", MAX_PAGES)), int(options.get("pages_per_task", PAGES_A_TASK))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files_of(self.path):
            try:
                n = len(loaded(path).pages)
                if n > self.most:
                    raise ValueError(f"{n} pages, at most {self.most} are read")
                out += [PageRange(path, k, min(k + self.step, n)) for k in range(0, n, self.step)] or [PageRange(path, error="no pages")]
            except Exception as e:  # noqa: BLE001  (whatever a file's bytes do, it becomes a row)
                out.append(PageRange(path, error=str(e)))
        return out

    def read(self, part: PageRange) -> Iterator[tuple]:
        if part.error is not None:
            yield part.path, None, None, None, True, part.error
            return
        pdf = loaded(part.path)
        for page in range(part.first, part.last):
            try:
                yield part.path, page, len(pdf.pages), pdf.text(page), False, None
            except Exception as e:  # noqa: BLE001
                yield part.path, page, len(pdf.pages), None, True, str(e) or type(e).__name__


def loaded(path: str) -> Pdf:
    system, at = opened(path)
    with system.open_input_stream(at) as f:
        return Pdf(f.read())
