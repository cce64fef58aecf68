"""Writes small spreadsheet files from sheet rows, for trial data and tests."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?")


def column_name(index: int) -> str:
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def encode(sheets: list[tuple[str, dict[int, list]]], shared: bool = True, odd_names: bool = False) -> bytes:
    """Bytes of a workbook from (sheet name, row number -> cell texts) pairs.

    Texts that look like numbers become number cells. ``shared`` picks shared or
    inline strings; ``odd_names`` writes backslashes and lower-case part names.
    """
    strings: dict[str, int] = {}

    def cell(row: int, column: int, value: str) -> str:
        ref = f"{column_name(column)}{row + 1}"
        if _NUMBER.fullmatch(value):
            return f'<c r="{ref}"><v>{value}</v></c>'
        if shared:
            return f'<c r="{ref}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    parts = {}
    for number, (_, rows) in enumerate(sheets, start=1):
        body = "".join(
            f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(rows[r]) if v is not None) + "</row>"
            for r in sorted(rows)
        )
        parts[f"xl/worksheets/sheet{number}.xml"] = (
            f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'
        )
    names = "".join(
        f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(sheets, start=1)
    )
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = (
        f'<Relationships xmlns="{_PACKAGE}">'
        + "".join(
            f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        + "</Relationships>"
    )
    if strings:
        items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">{items}</sst>'
    parts["[Content_Types].xml"] = (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            if odd_names:
                name = name.lower().replace("/", "\\")
            info = zipfile.ZipInfo(name)
            info.filename = name
            archive.writestr(info, text)
    return out.getvalue()


def encode_file(rows: pd.DataFrame) -> pd.DataFrame:
    """One workbook from the sheet rows of one path."""
    sheets = []
    for idx in sorted(rows["sheet_idx"].unique()):
        sheet = rows[rows["sheet_idx"] == idx]
        filled = sheet[sheet["row_idx"].notna()]
        sheets.append(
            (sheet["sheet_name"].iloc[0], {int(r): list(v) for r, v in zip(filled["row_idx"], filled["values"])})
        )
    path = rows["path"].iloc[0]
    by_path = sum(map(ord, path))
    content = encode(sheets, shared=by_path % 2 == 0, odd_names=by_path % 5 == 0)
    return pd.DataFrame({"path": [path], "content": [content]})
