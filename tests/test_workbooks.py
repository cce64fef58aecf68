"""Reading spreadsheet files: layouts, odd files, and files that cannot be used."""

import io
import subprocess
import sys
import zipfile

import pytest
from pyspark import cloudpickle

from platewise.operators.wells import wells_from_sheet_rows
from checks import plate_events
from platewise.sources import workbooks, xlsx_decode
from checks.xlsx_encode import encode

HEADER = ["Well", "Content", "Sample", "Cq", "I.C. Cq", "SQ", "Result"]
WELL = ["A01", "Unkn", "S", "20.5", "28", None, "Positive"]
INFO = {0: ["Run Started", "today"]}


@pytest.fixture(scope="module")
def load(spark):
    def load_files(**files):
        rows = [(f"file:/in/{name}.xlsx", bytearray(content)) for name, content in files.items()]
        return workbooks.decode_workbooks(spark.createDataFrame(rows, "path string, content binary"))

    return load_files


def book(results, info=INFO, swap=False, **how):
    sheets = [("R", dict(enumerate(results)))] + ([("I", info)] if info is not None else [])
    return encode(sheets[::-1] if swap else sheets, **how)


def parsed(sheet_rows):
    return wells_from_sheet_rows(sheet_rows).orderBy("row_idx").collect()


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("odd_names", [False, True])
def test_file_variants(load, swap, shared, odd_names):
    content = book([HEADER, WELL], swap=swap, shared=shared, odd_names=odd_names)
    (row,) = parsed(load(r1=content))
    assert (row.run_id, row.run_date, row.well, row.target_cq, row.ic_cq, row.sq) == ("r1", "today", "A01", 20.5, 28.0, None)


def test_title_rows_spacers_and_gaps(load):
    spacer = [None, *HEADER]
    sheet = {0: ["Title"], 3: spacer, 4: [None, *WELL], 7: [None, "A02", *WELL[1:]], 8: [None, None, "trailing"]}
    content = encode([("R", sheet), ("I", INFO)])
    assert [(r.well, r.replicate) for r in parsed(load(r1=content))] == [("A01", 1), ("A02", 2)]


def test_first_of_duplicate_headers_counts(load):
    content = book([["Well", "Cq", "Cq", "I.C. Cq", "IC Cq"], ["A01", "20", "99", "28", "99"]])
    (row,) = parsed(load(r1=content))
    assert (row.target_cq, row.ic_cq, row.content, row.result) == (20.0, 28.0, None, None)


def test_header_with_ic_and_cq_is_the_internal_control(load):
    (row,) = parsed(load(r1=book([[" WELL ", "Clinical Cq", "cq"], ["A01", "28", "20"]])))
    assert (row.ic_cq, row.target_cq) == (28.0, 20.0)


def test_words_for_missing_values(load):
    content = book([HEADER, ["A01", "Unkn", "N/A", "n/a", "NULL", None, "None"], ["nan", *WELL[1:]]])
    (row,) = parsed(load(r1=content))
    assert (row.sample_label, row.sample_type, row.target_cq, row.result) == (None, "Unknown", None, None)


def test_run_info(load):
    info = dict(enumerate([
        [" Lot Number ", "1"], ["Lot Number", " 2 "], ["Assay Name", None], [None, "x"], ["Extraction Lot Number", "001x"],
    ]))
    row = workbooks.run_info(load(r1=book([HEADER, WELL], info))).collect()[0]
    assert (row.run_date, row.assay_name, row.lot_number, row.extraction_lot) == ("", "", "2", "001x")


def test_tables_in_unusual_places_are_found(load):
    late = {i: ["x"] for i in range(31)} | {31: HEADER, 32: WELL}
    for sheets, roles in (
        ([("R", late), ("I", INFO)], (0, 1)),
        ([("I", INFO), ("R", late)], (1, 0)),
        ([("a", INFO), ("b", {0: ["x"]}), ("c", {0: HEADER, 1: WELL})], (2, 0)),
        ([("a", INFO), ("b", {0: ["x"]}), ("c", late)], (2, 0)),
        # where the usual places have one, it counts
        ([("a", late), ("b", {0: HEADER, 1: WELL}), ("c", late)], (1, 0)),
    ):
        rows = load(r1=encode(sheets))
        found = workbooks.sheet_roles(rows).collect()[0]
        assert (found.results_idx, found.run_info_idx) == roles
        (well,) = parsed(rows)
        assert (well.well, well.run_date) == ("A01", "today" if sheets[0][0] != "a" or roles[0] == 2 else "")


def test_runs_of_equal_names_are_told_apart(spark, tmp_path):
    from platewise.operators import plates

    for sub in ("", "x", "x/y"):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / "run 1.v2.XLSX").write_bytes(book([HEADER, WELL]))
    (tmp_path / "x" / "notes.txt").write_text("no workbook")
    for folder in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/*"):
        rows = workbooks.read_workbooks(spark, folder)
        wells = wells_from_sheet_rows(rows)
        ids = sorted(r.run_id for r in wells.collect())
        assert [i for i in ids if "/" in i] == ["x/run 1.v2", "x/y/run 1.v2"] and len(set(ids)) == 3
        assert plates.plate_layout(wells).count() == 24
        assert workbooks.structure_issues(workbooks.structure_facts(rows)).count() == 0


def issues(sheet_rows):
    facts = workbooks.structure_facts(sheet_rows)
    found = workbooks.structure_issues(facts)
    verdicts = {r.path: (r.data_rows, r.n_issues, r.passed) for r in workbooks.structure_report(facts).collect()}
    return {(r.run_id, r.severity, r.issue) for r in found.collect()}, verdicts


def test_structure_issues(load):
    found, verdicts = issues(
        load(
            good=book([HEADER, WELL]),
            lone=book([HEADER, WELL], info=None),
            bare=book([["Well", "Cq"], ["A01", "20"], ["A02", "21"]]),
            headless=book([["x", "y"]]),
            broken=b"no zip at all",
        )
    )
    missing = "Expected column '{}' not found in results sheet."
    assert {i for i in found if i[0] != "broken"} == {
        ("lone", "WARNING", "Run Information sheet not found; metadata will be blank."),
        ("bare", "CRITICAL", missing.format("ic_cq")),
        ("bare", "CRITICAL", missing.format("result")),
        ("headless", "CRITICAL", "Could not locate header row containing 'Well'."),
    }
    assert [i[2].startswith("Workbook cannot be read") for i in found if i[0] == "broken"] == [True]
    assert verdicts["file:/in/good.xlsx"] == (1, 0, True)
    assert verdicts["file:/in/bare.xlsx"] == (2, 2, False)


def test_a_run_id_used_twice_is_reported(spark):
    rows = [(f"file:/{d}/r1.xlsx", bytearray(book([HEADER, WELL]))) for d in "ab"]
    sheet_rows = workbooks.decode_workbooks(spark.createDataFrame(rows, "path string, content binary"))
    found, _ = issues(sheet_rows)
    assert found == {("r1", "CRITICAL", "Run id is used by more than one file.")}
    assert [r.replicate for r in parsed(sheet_rows)] == [1, 1]


def test_bad_files_do_not_stop_the_good_ones(load):
    cut = book([HEADER, WELL])[:-60]
    assert [r.run_id for r in parsed(load(good=book([HEADER, WELL]), cut=cut))] == ["good"]


def test_large_sheets_are_read(load):
    """Many long rows, whose unpacked size is a multiple of the file."""
    rows = [[f"A{i % 12 + 1:02d}", "Unkn", "S" * 2000, "20.5", "28", None, "Positive"] for i in range(3000)]
    assert workbooks.results_table(load(r1=book([HEADER, *rows]))).count() == 3000


def test_files_in_pieces_are_the_same_files(spark):
    """No content, none at all, junk around the size of a piece, and books of few and many pieces."""
    books = [book([HEADER, *[["A01", "Unkn", f"{i} of {n}", "20.5"] for i in range(n)]]) for n in (1, 50, 3000)]
    assert len(books[-1]) > workbooks.PIECE_BYTES * workbooks.MOST_PIECES
    junk = [b"x" * (workbooks.PIECE_BYTES + i) for i in (-1, 0, 1)]
    files = [(f"file:/in/{i}.xlsx", c) for i, c in enumerate([None, b"", *junk, *books, books[0]])] + [("file:/in/8.xlsx", books[1])]
    rows = [(path, c if c is None else bytearray(c)) for path, c in files]
    got = workbooks.decode_workbooks(spark.createDataFrame(rows, "path string, content binary").coalesce(1))
    want = [tuple(r.values()) for path, c in files for r in xlsx_decode.sheet_rows(path, c)]
    assert [tuple(r) for r in got.drop("run_id").collect()] == want and len(want) > 3100


def test_batches_of_files_are_small(spark, monkeypatch):
    """What the decoder gets at a time does not grow with the number of files."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            row = {"path": None, "sheet_idx": batch.nbytes >> 10, "sheet_name": None, "row_idx": None, "values": None, "error": None}
            yield pa.RecordBatch.from_pylist([row], schema=fields)

    fields = xlsx_decode.ARROW_ROWS
    monkeypatch.setattr(xlsx_decode, "decode_batches", sizes)
    for n in (500, 2000):
        files = spark.range(0, n, 1, 1).selectExpr("'file:/in/a.xlsx' path", "cast(repeat('x', 30000) as binary) content")
        kb = [r.sheet_idx for r in workbooks.decode_workbooks(files).select("sheet_idx").collect()]
        assert max(kb) < 12_000 and sum(kb) > n * 29


RAW_SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="B2" t="s"><v>0</v></c><c t="str"><f>A1</f><v>formula</v></c><c r="D2" t="b"><v>1</v></c></row>
<row><c><v>3.0</v></c><c><v>0.1</v></c><c t="e"><v>#N/A</v></c><c r="F3" s="1"><v>46094.375</v></c><c s="2"><v>0.5</v></c></row>
<row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="d"><v>2026-03-13T09:00:00</v></c><c t="s"><v>1</v></c></row>
</sheetData></worksheet>"""


def test_cell_types():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "[content_types].xml": "<Types/>",
        "xl\\workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl\\_rels\\workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="/xl/worksheets/odd.xml"/></Relationships>',
        "xl\\worksheets\\odd.xml": RAW_SHEET,
        "xl\\sharedstrings.xml": f"<sst {main}><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t/></si></sst>",
        "xl\\styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="hh:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    rows = list(xlsx_decode.sheet_rows("p", out.getvalue()))
    assert [(r["row_idx"], r["values"]) for r in rows] == [
        (1, [None, "rich", "formula", "True"]),
        (2, ["3", "0.1", None, None, None, "2026-03-13 09:00:00", "12:00:00"]),
        (3, ["inline", "2026-03-13 09:00:00", None]),
        (None, None),
    ]
    assert {r["error"] for r in rows} == {None}


@pytest.mark.parametrize("function", [xlsx_decode.decode_batches, plate_events.xlsx_encode.encode_file])
def test_workers_need_no_installed_package(function, tmp_path):
    code = "import sys, pickle; pickle.load(sys.stdin.buffer); assert 'platewise' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function), cwd=tmp_path, check=True)
