"""Turns the bytes of one spreadsheet export into sheet rows.

This is the only Python that runs on the workers, since Spark has no reader for
the format. It does no more than unzip and read cells; finding the tables inside
the sheets is left to DataFrame operations.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa

BATCH_ROWS = 4096
#: A worker keeps the text table of a file; one that is larger makes the file unreadable.
MAX_STRING_BYTES = 256 << 20
#: The same for parts of a file that are read as a whole: its list of sheets and styles.
MAX_PART_BYTES = 64 << 20

ARROW_ROWS = pa.schema(
    [
        ("path", pa.string()),
        ("sheet_idx", pa.int32()),
        ("sheet_name", pa.string()),
        ("row_idx", pa.int32()),
        ("values", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)

_OFFICE_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
_DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36,
                    45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
_FORMAT_LITERALS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class _Parts:
    """Zip entries by part name: separators and letter case do not matter."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.names = {i.filename.replace("\\", "/").lstrip("/").lower(): i for i in self.zip.infolist()}

    def has(self, name: str) -> bool:
        return name.lower() in self.names

    def open(self, name: str):
        return self.zip.open(self.names[name.lower()])

    def tree(self, name: str) -> ET.Element:
        if self.names[name.lower()].file_size > MAX_PART_BYTES:
            raise ValueError(f"{name} is too large")
        with self.open(name) as part:
            return ET.parse(part).getroot()


def _shown_text(item: ET.Element) -> str:
    """Text of a string item, without its phonetic guides."""
    pieces = []
    for child in item:
        kind = _local(child.tag)
        if kind == "t":
            pieces.append(child.text or "")
        elif kind == "r":
            pieces.extend(t.text or "" for t in child if _local(t.tag) == "t")
    return "".join(pieces)


def _elements(part, name: str) -> Iterator[ET.Element]:
    """Elements of that local name, one at a time; what was read is forgotten."""
    above: list[ET.Element] = []
    for event, element in ET.iterparse(part, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag.endswith(name) and _local(element.tag) == name:
            yield element
            above[-1].clear()


def _shared_strings(parts: _Parts, most: int) -> list[str]:
    name = "xl/sharedStrings.xml"
    strings: list[str] = []
    held = 0
    if parts.has(name):
        with parts.open(name) as part:
            for element in _elements(part, "si"):
                strings.append(_shown_text(element))
                held += len(strings[-1]) + 64
                if held > most:
                    raise ValueError(f"the table of texts is larger than {most} bytes")
    return strings


def _date_styles(parts: _Parts) -> set[int]:
    """Indexes of cell styles that show a date or time."""
    if not parts.has("xl/styles.xml"):
        return set()
    root = parts.tree("xl/styles.xml")
    date_ids = set(_DATE_FORMAT_IDS)
    for fmt in (e for e in root.iter() if _local(e.tag) == "numFmt"):
        code = _FORMAT_LITERALS.sub("", fmt.get("formatCode", "")).lower()
        if "general" not in code and re.search(r"[dmyhs]", code):
            date_ids.add(int(fmt.get("numFmtId")))
    styles = next((e for e in root if _local(e.tag) == "cellXfs"), ())
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", "0")) in date_ids}


def _sheets(parts: _Parts) -> tuple[list[tuple[str, str]], bool]:
    """(sheet name, part name) in workbook order, and whether dates count from 1904."""
    book = parts.tree("xl/workbook.xml")
    targets = {}
    if parts.has("xl/_rels/workbook.xml.rels"):
        for rel in parts.tree("xl/_rels/workbook.xml.rels"):
            target = rel.get("Target", "").replace("\\", "/")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
            targets[rel.get("Id")] = full
    sheets = [
        (e.get("name", ""), targets.get(e.get(_OFFICE_REL), f"xl/worksheets/sheet{i}.xml"))
        for i, e in enumerate((e for e in book.iter() if _local(e.tag) == "sheet"), start=1)
    ]
    from_1904 = any(
        e.get("date1904") in ("1", "true") for e in book.iter() if _local(e.tag) == "workbookPr"
    )
    return sheets, from_1904


def _date_text(serial: float, from_1904: bool) -> str:
    """A date serial as text; one below a day is a time of day."""
    span = timedelta(days=int(serial), milliseconds=round((serial % 1) * 86_400_000))
    if from_1904:
        return str(datetime(1904, 1, 1) + span)
    if serial < 1:
        return str((datetime(1900, 1, 1) + span).time())
    if serial < 60:  # the 1900 calendar has a 29 February that never was
        span += timedelta(days=1)
    return str(datetime(1899, 12, 30) + span)


def _number_text(text: str) -> str:
    number = float(text)
    if number.is_integer() and abs(number) < 1e15:
        return str(int(number))
    return repr(number)


def _cell_text(cell: ET.Element, ns: str, strings: list[str], dates: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        item = cell.find(ns + "is")
        return None if item is None else _shown_text(item)
    raw = cell.findtext(ns + "v")
    if not raw or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "str":
        return raw
    if kind == "b":
        return "True" if raw.strip() in ("1", "true") else "False"
    if kind == "d":
        return raw.replace("T", " ")
    style = cell.get("s")
    if style is not None and int(style) in dates:
        return _date_text(float(raw), from_1904)
    return _number_text(raw)


def _column_index(letters: str) -> int:
    index = 0
    for char in letters.upper():
        index = index * 26 + ord(char) - 64
    return index - 1


def _grid(parts: _Parts, part_name: str, *cell_args) -> Iterator[tuple[int, list[str | None]]]:
    """Non-empty rows of a sheet, read as a stream."""
    row_idx = -1
    known: dict[str, int] = {}
    with parts.open(part_name) as part:
        for element in _elements(part, "row"):
            ns = element.tag[:-3]
            cell_tag = ns + "c"
            row_idx = int(element.get("r")) - 1 if element.get("r") else row_idx + 1
            values: list[str | None] = []
            for cell in element:
                if cell.tag != cell_tag:
                    continue
                letters = (cell.get("r") or "").rstrip("0123456789")
                if letters and letters not in known:
                    known[letters] = _column_index(letters)
                at = known.get(letters, len(values))
                while len(values) <= at:
                    values.append(None)
                values[at] = _cell_text(cell, ns, *cell_args) or None
            if any(values):
                yield row_idx, values


def unreadable(path: str, problem: Exception) -> dict:
    """The row that tells of a file that cannot be used."""
    nothing = dict.fromkeys(("sheet_idx", "sheet_name", "row_idx", "values"))
    return {"path": path, **nothing, "error": f"{type(problem).__name__}: {problem}"}


def sheet_rows(path: str, content, string_bytes: int = MAX_STRING_BYTES) -> Iterator[dict]:
    """Rows of all sheets of one file, given as bytes or as an open file that can be read
    anywhere; what fails ends up in ``error``."""

    def row(sheet_idx=None, sheet_name=None, row_idx=None, values=None, error=None) -> dict:
        return {"path": path, "sheet_idx": sheet_idx, "sheet_name": sheet_name,
                "row_idx": row_idx, "values": values, "error": error}

    try:
        parts = _Parts(io.BytesIO(content) if isinstance(content, bytes) else content)
        sheets, from_1904 = _sheets(parts)
        cell_args = (_shared_strings(parts, string_bytes), _date_styles(parts), from_1904)
    except Exception as problem:  # one bad file must not end the job
        yield unreadable(path, problem)
        return
    if not sheets:
        yield row(error="no sheets")
    for sheet_idx, (name, part_name) in enumerate(sheets):
        error = None
        try:
            for row_idx, values in _grid(parts, part_name, *cell_args):
                yield row(sheet_idx, name, row_idx, values)
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
        yield row(sheet_idx, name, error=error)


def in_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number."""
    pending: list[dict] = []
    for row in rows:
        pending.append(row)
        if len(pending) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(pending, schema=ARROW_ROWS)
            pending = []
    if pending:
        yield pa.RecordBatch.from_pylist(pending, schema=ARROW_ROWS)


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: batches of pieces (path, content, last) of files one after another
    in, bounded batches of rows out."""

    def rows() -> Iterator[dict]:
        held = io.BytesIO()
        for batch in batches:
            columns = (batch.column(c) for c in ("path", "content", "last"))
            for path, content, last in zip(*columns):
                piece = content.as_py()
                if piece is not None:
                    held.write(piece)
                if last.as_py():
                    yield from sheet_rows(path.as_py(), None if piece is None else held)
                    held = io.BytesIO()

    yield from in_batches(rows())
