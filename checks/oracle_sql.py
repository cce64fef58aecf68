"""The catalogue's queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

_TYPES = [
    "Auto_Neg",
    "Lysis_1.25mL_Control",
    "Lysis_5mL_Control",
    "Manual_Neg",
    "Manual_Pos",
    "Unknown",
]

_CTES = {
    "numbered": r"""
        SELECT event_id // 96 AS run_no, CAST(event_id % 96 AS INTEGER) AS pos,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k,
               CAST(round(value * 100) AS BIGINT) AS cents, event_type,
               'run_' || lpad(CAST(event_id // 96 AS VARCHAR), 6, '0') AS run_id
        FROM events""",
    "called": r"""
        SELECT *, CASE WHEN pos >= 94 THEN 'Valid Ctrl' WHEN k < 3 THEN NULL WHEN k < 8 THEN 'Inhibition'
                       WHEN event_type = 'click' THEN 'Positive'
                       WHEN event_type = 'purchase' THEN ' positive ' ELSE 'Negative' END AS result
        FROM numbered""",
    "raw": r"""
        SELECT run_no, run_id, pos AS row_idx,
               CASE WHEN run_no % 10 = 9 AND pos = 1 THEN 'A01' WHEN run_no % 10 = 6 AND pos = 2 THEN 'A13'
                    WHEN run_no % 10 = 6 AND pos = 3 THEN 'a04'
                    ELSE chr(CAST(65 + pos // 12 AS INTEGER)) || lpad(CAST(pos % 12 + 1 AS VARCHAR), 2, '0') END AS well,
               CASE WHEN pos = 94 THEN 'Pos Ctrl' WHEN pos = 95 THEN ' neg ctrl ' ELSE 'Unkn' END AS content,
               CASE WHEN pos = 94 THEN 'Pos Control' WHEN pos = 95 THEN 'Neg Control' WHEN k = 10 THEN ''
                    WHEN k = 11 THEN NULL WHEN event_type = 'click' THEN 'Manual   Pos'
                    WHEN event_type = 'purchase' THEN 'Lysis 1.25  mL Control'
                    WHEN event_type = 'view' THEN 'Auto Neg' WHEN event_type = 'signup' THEN 'Manual Neg'
                    ELSE 'Lysis 5 ml Control' END AS sample_label,
               CASE WHEN pos = 95 OR result IS NULL THEN NULL WHEN result = 'Inhibition' THEN 'N/A'
                    WHEN pos = 94 OR result IN ('Positive', ' positive ')
                    THEN CAST(20e0 + (cents % 2000) / 100e0 AS VARCHAR) END AS target_text,
               CASE WHEN run_no % 10 = 7 AND pos > 1 THEN NULL WHEN run_no % 10 = 8 THEN 28e0
                    WHEN k = 99 THEN 36e0 ELSE 28e0 + (k - 50) / 100e0 END AS ic_cq,
               CAST(NULL AS DOUBLE) AS sq, result
        FROM called""",
    "labelled": r"""
        SELECT *, try_cast(target_text AS DOUBLE) AS target_cq,
               coalesce(regexp_replace(regexp_replace(trim(sample_label), '\s+', ' ', 'g'),
                                       '(?i)(\d+\.?\d*)\s*mL', '\1mL', 'g'), '') AS sample_label_clean,
               coalesce(lower(trim(content)) IN ('pos ctrl', 'neg ctrl'), false) AS is_control,
               coalesce(lower(trim(result)) = 'positive', false) AS is_positive
        FROM raw""",
    "clean": r"""
        SELECT *, CASE WHEN sample_label_clean = '' THEN 'Unknown'
                       ELSE replace(sample_label_clean, ' ', '_') END AS sample_type
        FROM labelled WHERE well IS NOT NULL""",
    "info": r"""
        SELECT DISTINCT run_id, '2024-01-01' AS run_date, '' AS assay_name,
               CASE WHEN run_no % 5 = 0 THEN 'lot_last' ELSE 'lot_' || (run_no % 5) END AS lot_number,
               CASE WHEN run_no % 4 = 0 THEN '' ELSE 'ext_' || run_no END AS extraction_lot, run_no
        FROM numbered""",
    "wells": r"""
        SELECT c.run_id, i.run_date, i.assay_name, i.lot_number, i.extraction_lot, c.well, c.content,
               c.sample_label, c.target_cq, c.ic_cq, c.sq, c.result, c.sample_type, c.sample_label_clean,
               CAST(row_number() OVER (PARTITION BY c.run_id, c.sample_type ORDER BY c.row_idx) AS INTEGER)
                   AS replicate,
               c.is_control, c.row_idx
        FROM clean c JOIN info i USING (run_id)""",
    "samples": "SELECT * FROM clean WHERE NOT is_control",
    "plotted": "SELECT * FROM samples WHERE target_cq IS NOT NULL",
    "ic_stats": r"""
        SELECT run_id, avg(ic_cq) AS m, stddev_samp(ic_cq) AS sd FROM samples GROUP BY run_id
        HAVING count(ic_cq) >= 3 AND stddev_samp(ic_cq) > 0""",
    "flags": r"""
        SELECT run_id, well, sample_type, 'Borderline: Target Cq > 35' AS flag_reason, 0 AS kind, row_idx
        FROM samples WHERE target_cq > 35
        UNION ALL
        SELECT run_id, well, sample_type,
               'IC extraction failure: I.C. Cq=' || printf('%.2f', round_even(round(ic_cq, 9), 2))
               || ' (plate mean=' || printf('%.2f', round_even(round(m, 9), 2))
               || ', SD=' || printf('%.2f', round_even(round(sd, 9), 2)) || ')', 1, row_idx
        FROM samples JOIN ic_stats USING (run_id) WHERE abs(ic_cq - m) > 2 * sd""",
    "flag_texts": r"""
        SELECT run_id, well, string_agg(flag_reason, '; ' ORDER BY kind, row_idx) AS qc_flag
        FROM flags GROUP BY run_id, well""",
    "annotated": r"""
        SELECT w.*, coalesce(f.qc_flag, '') AS qc_flag FROM wells w LEFT JOIN flag_texts f USING (run_id, well)""",
    "ic_failed": "SELECT DISTINCT run_id, well FROM flags WHERE contains(flag_reason, 'IC extraction')",
    "stats": r"""
        SELECT sample_type, count(well) AS n_wells, count(*) FILTER (is_positive) AS n_positive,
               count(*) FILTER (NOT is_positive) AS n_negative, count(target_cq) AS n_target_cq,
               round_even(round(avg(target_cq), 9), 3) AS mean_target_cq,
               round_even(round(stddev_samp(target_cq), 9), 3) AS sd_target_cq,
               round_even(round(min(target_cq), 9), 3) AS min_target_cq,
               round_even(round(max(target_cq), 9), 3) AS max_target_cq,
               round_even(round(avg(ic_cq), 9), 3) AS mean_ic_cq,
               round_even(round(stddev_samp(ic_cq), 9), 3) AS sd_ic_cq,
               round_even(round(100e0 * count(*) FILTER (is_positive) / count(well), 9), 1) AS positivity_rate_pct
        FROM samples GROUP BY sample_type""",
    "cv": r"""
        SELECT sample_type, count(*) AS n_runs, round_even(round(avg(m), 9), 3) AS mean_cq,
               round_even(round(stddev_samp(m), 9), 3) AS sd_cq,
               round_even(round(stddev_samp(m) * 100 / avg(m), 9), 1) AS cv_pct
        FROM (SELECT run_id, sample_type, avg(target_cq) AS m FROM plotted GROUP BY run_id, sample_type)
        GROUP BY sample_type HAVING count(*) >= 2""",
    "controls": r"""
        SELECT trim(content) AS ctrl_type, count(well) AS n_controls,
               count(*) FILTER (lower(trim(result)) = 'valid ctrl') AS n_valid,
               round_even(round(avg(target_cq), 9), 3) AS mean_target_cq,
               round_even(round(stddev_samp(target_cq), 9), 3) AS sd_target_cq,
               round_even(round(avg(ic_cq), 9), 3) AS mean_ic_cq,
               round_even(round(stddev_samp(ic_cq), 9), 3) AS sd_ic_cq
               FROM clean WHERE is_control GROUP BY 1""",
    "compared": r"""
        SELECT run_id, sample_type, count(*) FILTER (is_positive) AS n_positive, count(*) AS n_wells
        FROM samples GROUP BY run_id, sample_type""",
    "positioned": r"""
        SELECT *, nullif(regexp_extract(upper(trim(well)), '^([A-H])([0-9]+)', 1), '') AS plate_row,
               CAST(nullif(regexp_extract(upper(trim(well)), '^([A-H])([0-9]+)', 2), '') AS INTEGER) AS plate_col,
               coalesce(nullif(nullif(trim(sample_label), ''), 'nan'), trim(content), '') AS label,
               CASE lower(trim(result)) WHEN 'positive' THEN -1 WHEN 'negative' THEN 0
                    WHEN 'valid ctrl' THEN 1 WHEN 'inhibition' THEN 2 END AS result_code,
               CASE WHEN lower(trim(result)) IN ('positive', 'negative', 'valid ctrl', 'inhibition')
                    THEN lower(trim(result)) ELSE 'empty' END AS result_class
        FROM clean""",
    "placed": "SELECT * FROM positioned WHERE plate_row IS NOT NULL AND plate_col BETWEEN 1 AND 12",
    "winners": r"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, plate_row, plate_col
                                                    ORDER BY row_idx DESC) AS rn FROM placed) WHERE rn = 1""",
    "cq_winners": r"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, plate_row, plate_col
                                                    ORDER BY row_idx DESC) AS rn
                       FROM placed WHERE target_cq IS NOT NULL) WHERE rn = 1""",
    "scale": r"""
        SELECT r.run_id, min(c.target_cq) - 1 AS scale_min, max(c.target_cq) + 1 AS scale_max
        FROM (SELECT DISTINCT run_id FROM clean WHERE target_cq IS NOT NULL) r LEFT JOIN cq_winners c USING (run_id)
        GROUP BY r.run_id""",
    "band": r"""
        SELECT count(target_cq) AS n_wells, round(avg(target_cq), 9) AS grand_mean,
               round(stddev_samp(target_cq), 9) AS grand_sd,
               round(avg(target_cq) - 2 * stddev_samp(target_cq), 9) AS band_low,
               round(avg(target_cq) + 2 * stddev_samp(target_cq), 9) AS band_high,
               round(min(target_cq) - 0.5e0 * stddev_samp(target_cq), 9) AS label_level
        FROM plotted""",
    "quartiles": r"""
        SELECT sample_type, count(*) AS n, quantile_cont(target_cq, 0.25) AS q1,
               quantile_cont(target_cq, 0.5) AS median, quantile_cont(target_cq, 0.75) AS q3
        FROM plotted GROUP BY sample_type""",
    "issues": r"""
        SELECT 'file:/exports/' || run_id || '.xlsx' AS path, run_id, 'CRITICAL' AS severity,
               'Expected column ''result'' not found in results sheet.' AS issue
        FROM info WHERE run_no % 20 = 19""",
    # what the results sheets can hold: no empty label, no result column in some runs
    "exported": r"""
        SELECT * REPLACE (nullif(sample_label, '') AS sample_label,
                          CASE WHEN run_no % 20 = 19 THEN NULL ELSE result END AS result),
               CASE WHEN run_no % 3 = 0 THEN 1 ELSE 0 END AS shift
        FROM clean""",
    "cells": r"""
        SELECT run_no, CAST(run_no % 2 AS INTEGER) AS sheet_idx, 'Results' AS sheet_name,
               row_idx + shift + 1 AS row_idx, shift + place AS col_idx, value
        FROM (SELECT run_no, row_idx, shift, unnest([
                {'place': 0, 'value': well}, {'place': 1, 'value': content}, {'place': 2, 'value': sample_label},
                {'place': 3, 'value': CASE WHEN target_cq = floor(target_cq)
                                        THEN CAST(CAST(target_cq AS BIGINT) AS VARCHAR)
                                        WHEN target_cq IS NULL THEN target_text
                                        ELSE CAST(target_cq AS VARCHAR) END},
                {'place': 4, 'value': CASE WHEN ic_cq = floor(ic_cq) THEN CAST(CAST(ic_cq AS BIGINT) AS VARCHAR)
                                        ELSE CAST(ic_cq AS VARCHAR) END},
                {'place': CASE WHEN run_no % 4 = 1 THEN 5 ELSE 6 END, 'value': result}], recursive := true)
              FROM exported)
        UNION ALL
        SELECT run_no, CAST(run_no % 2 AS INTEGER), 'Results', shift, shift + place, value
        FROM (SELECT run_no, CASE WHEN run_no % 3 = 0 THEN 1 ELSE 0 END AS shift, unnest([
                {'place': 0, 'value': 'Well'}, {'place': 1, 'value': 'Content'}, {'place': 2, 'value': 'Sample'},
                {'place': 3, 'value': 'Cq'}, {'place': 4, 'value': 'I.C. Cq'},
                {'place': 5, 'value': CASE WHEN run_no % 4 <> 1 THEN 'SQ' END},
                {'place': CASE WHEN run_no % 4 = 1 THEN 5 ELSE 6 END,
                 'value': CASE WHEN run_no % 20 <> 19 THEN 'Result' END}], recursive := true)
              FROM info)
        UNION ALL
        SELECT run_no, CAST(run_no % 2 AS INTEGER), 'Results', 0, 1, 'Plate results' FROM info WHERE run_no % 3 = 0
        UNION ALL
        SELECT run_no, 1 - CAST(run_no % 2 AS INTEGER), 'Run Information',
               row_idx, col, value
        FROM (SELECT run_no, CAST(row_number() OVER (PARTITION BY run_no ORDER BY place) - 1 AS INTEGER) AS row_idx,
                     unnest([{'col': 0, 'value': key}, {'col': 1, 'value': value}], recursive := true)
              FROM (SELECT run_no, 1 AS place, 'Run Started' AS key, ' 2024-01-01 ' AS value FROM info
                    UNION ALL SELECT run_no, 2, 'Lot Number', 'lot_' || (run_no % 5) FROM info
                    UNION ALL SELECT run_no, 3, 'Lot Number', 'lot_last' FROM info WHERE run_no % 5 = 0
                    UNION ALL SELECT run_no, 4, 'Extraction Lot Number', 'ext_' || run_no FROM info
                              WHERE run_no % 4 <> 0))
    """,
}


def _sql(query: str) -> str:
    """Put in front the CTEs a query needs, in their order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in _CTES.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                visit(body)

    visit(query)
    parts = [f"{name} AS ({_CTES[name]})" for name in _CTES if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + query


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ( ").replace(")", " ) ").replace(",", " , ").split()
    return any(w in ("FROM", "JOIN") and words[i + 1] == name for i, w in enumerate(words[:-1]))


def _wide(expression: str, prefix: str = "") -> str:
    """One column per sample type, named without dots."""
    return ", ".join(
        f"{expression} FILTER (sample_type = '{t}') AS \"{prefix}{t.replace('.', '_')}\"" for t in _TYPES
    )


def _layout_columns() -> str:
    labels = [
        f"coalesce(max(label) FILTER (plate_col = {c}), '') AS label_{c:02d}" for c in range(1, 13)
    ]
    classes = [
        f"coalesce(max(result_class) FILTER (plate_col = {c}), 'empty') AS class_{c:02d}" for c in range(1, 13)
    ]
    return ", ".join(labels + classes)


# Columns of the written tables, in order of name; those that are doubles end in "#".
_WRITTEN = {
    "qc_flags": ("flags", "flag_reason run_id sample_type well"),
    "all_runs_combined": (
        "annotated",
        "assay_name content extraction_lot ic_cq# is_control lot_number qc_flag replicate result row_idx run_date"
        " run_id sample_label sample_label_clean sample_type sq# target_cq# well",
    ),
    "summary_statistics": (
        "stats",
        "max_target_cq# mean_ic_cq# mean_target_cq# min_target_cq# n_negative n_positive n_target_cq n_wells"
        " positivity_rate_pct# sample_type sd_ic_cq# sd_target_cq#",
    ),
    "run_comparison": ("compared", "n_positive n_wells run_id sample_type"),
    "control_statistics": (
        "controls", "ctrl_type mean_ic_cq# mean_target_cq# n_controls n_valid sd_ic_cq# sd_target_cq#"
    ),
    "interrun_cv": ("cv", "cv_pct# mean_cq# n_runs sample_type sd_cq#"),
}


def _written() -> str:
    """Rows and contents of every written table."""

    def digest(table: str, source: str, columns: str) -> str:
        shown = ", ".join(
            f"coalesce(CAST({f'CAST(round({c[:-1]} * 1000000) AS BIGINT)' if c.endswith('#') else c} AS VARCHAR), '~')"
            for c in columns.split()
        )
        return (
            f"SELECT '{table}' AS table_name, count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' ||"
            f" substr(md5(concat_ws('|', {shown})), 1, 8) AS BIGINT)), 0) AS BIGINT) AS content FROM {source}"
        )

    return " UNION ALL ".join(digest(t, *what) for t, what in _WRITTEN.items())


_PATH = "'file:/exports/' || run_id || '.xlsx' AS path"
_FLAG_COLUMNS = "run_id, well, sample_type, flag_reason"


def oracle_sql() -> dict[str, str]:
    wells = "SELECT * FROM wells"
    queries = {
        "workbook_cells": """
            SELECT 'file:/exports/run_' || lpad(CAST(run_no AS VARCHAR), 6, '0') || '.xlsx' AS path,
                   'run_' || lpad(CAST(run_no AS VARCHAR), 6, '0') AS run_id,
                   sheet_idx, sheet_name, row_idx, col_idx, value
            FROM cells WHERE value IS NOT NULL""",
        "sheet_roles": f"""
            SELECT {_PATH}, run_id, CAST(run_no % 2 AS INTEGER) AS results_idx,
                   CAST(1 - run_no % 2 AS INTEGER) AS run_info_idx FROM info""",
        "run_info": f"SELECT {_PATH}, run_id, run_date, assay_name, lot_number, extraction_lot FROM info",
        "run_info_entries": f"""
            SELECT {_PATH}, run_id, 'Run Started' AS key, run_date AS value FROM info
            UNION ALL SELECT {_PATH}, run_id, 'Lot Number', lot_number FROM info
            UNION ALL SELECT {_PATH}, run_id, 'Extraction Lot Number', extraction_lot FROM info
                      WHERE extraction_lot <> ''""",
        "results_table": f"""
            SELECT {_PATH}, run_id, row_idx, well, content, sample_label, target_cq, ic_cq, sq, result
            FROM exported""",
        "wells_from_workbooks": """
            SELECT w.* REPLACE (e.sample_label AS sample_label, e.result AS result)
            FROM wells w JOIN exported e USING (run_id, row_idx)""",
        "validate_structure": "SELECT * FROM issues",
        "structure_report": f"""
            SELECT {_PATH}, run_id, 2 AS n_sheets, count(*) AS data_rows,
                   CASE WHEN run_no % 20 = 19 THEN CAST(1 AS BIGINT) ELSE 0 END AS n_issues,
                   run_no % 20 <> 19 AS passed
            FROM exported GROUP BY run_id, run_no""",
        "load_runs": wells,
        "load_selected_runs": "SELECT * FROM wells WHERE run_id IN ('run_000000', 'run_000003', 'run_000021')",
        # a CSV file does not tell an empty text from an absent one
        "load_runs_csv": "SELECT * REPLACE (nullif(sample_label, '') AS sample_label) FROM wells",
        "load_parsed_runs": "SELECT * REPLACE (nullif(sample_label, '') AS sample_label) FROM wells",
        "write_outputs": _written(),
        "sample_type": "SELECT run_id, row_idx, sample_label, sample_type, sample_label_clean FROM clean",
        "is_control": "SELECT run_id, row_idx, content, is_control FROM clean",
        "numeric_coerce": "SELECT run_id, row_idx, target_cq, ic_cq, sq FROM clean",
        "drop_blank_wells": "SELECT run_id, row_idx, well FROM clean",
        "is_positive": "SELECT run_id, row_idx, result, is_positive FROM clean",
        "has_target_cq": "SELECT run_id, row_idx, target_cq IS NOT NULL AS has_target_cq FROM clean",
        "well_position": """
            SELECT run_id, row_idx, well, plate_row, plate_col,
                   coalesce(plate_row IS NOT NULL AND plate_col BETWEEN 1 AND 12, false) AS on_plate
            FROM positioned""",
        "off_plate_wells": """
            SELECT run_id, row_idx, well FROM positioned
            WHERE plate_row IS NULL OR plate_col NOT BETWEEN 1 AND 12""",
        "plate_accounting": """
            SELECT run_id, CAST(sum(n_rows) AS BIGINT) AS n_wells, CAST(sum(n_rows) FILTER (inside) AS BIGINT) AS n_claims,
                   count(*) FILTER (inside) AS n_places,
                   CAST(sum(n_rows - 1) FILTER (inside) AS BIGINT) AS n_hidden,
                   CAST(coalesce(sum(n_rows) FILTER (NOT inside), 0) AS BIGINT) AS n_off_plate, true AS balanced
            FROM (SELECT run_id, inside, CASE WHEN inside THEN plate_row END AS r, CASE WHEN inside THEN plate_col END AS c,
                         count(*) AS n_rows
                  FROM (SELECT *, coalesce(plate_row IS NOT NULL AND plate_col BETWEEN 1 AND 12, false) AS inside
                        FROM positioned)
                  GROUP BY ALL)
            GROUP BY run_id""",
        "plate_order": """
            SELECT run_id, row_idx, well, coalesce(plate_row, 'Z') AS order_row, coalesce(plate_col, 999) AS order_col
            FROM positioned""",
        "well_label": "SELECT run_id, row_idx, well, label FROM positioned",
        "result_code": "SELECT run_id, row_idx, result_code, result_class FROM positioned",
        "replicate_numbers": "SELECT run_id, row_idx, sample_type, replicate FROM wells",
        "attach_run_info": """
            SELECT run_id, row_idx, well, run_date, assay_name, lot_number, extraction_lot FROM wells""",
        "borderline_flags": f"SELECT {_FLAG_COLUMNS} FROM flags WHERE kind = 0",
        "ic_outlier_flags": f"SELECT {_FLAG_COLUMNS} FROM flags WHERE kind = 1",
        "qc_flags": f"SELECT {_FLAG_COLUMNS} FROM flags",
        "annotated_wells": "SELECT * FROM annotated",
        "ic_fail_lookup": """
            SELECT c.run_id, c.row_idx, c.well, f.well IS NOT NULL AS ic_failed
            FROM clean c LEFT JOIN ic_failed f USING (run_id, well)""",
        "flag_reason_counts": """
            SELECT flag_reason, n_flags, kind, run_id, row_idx
            FROM (SELECT flag_reason, kind, run_id, row_idx, count(*) OVER (PARTITION BY flag_reason) AS n_flags,
                         row_number() OVER (PARTITION BY flag_reason ORDER BY kind, run_id, row_idx) AS rn FROM flags)
            WHERE rn = 1""",
        "flags_display": """
            SELECT run_id AS "Run ID", well AS "Well", sample_type AS "Sample Type", flag_reason AS "Flag Reason"
            FROM flags""",
        "sample_type_stats": "SELECT * FROM stats",
        "control_stats": "SELECT * FROM controls",
        "key_metrics": """
            SELECT count(DISTINCT run_id) AS n_runs, count(*) FILTER (NOT is_control) AS n_samples,
                   count(*) FILTER (NOT is_control AND is_positive) AS n_positive,
                   count(DISTINCT sample_type) FILTER (NOT is_control) AS n_sample_types,
                   round_even(round(100e0 * count(*) FILTER (NOT is_control AND is_positive)
                                    / count(*) FILTER (NOT is_control), 9), 1) AS positivity_rate_pct,
                   (SELECT count(*) FROM flags) AS n_flags
            FROM clean""",
        "parse_summary": """
            SELECT run_id, count(*) AS n_wells, count(*) FILTER (is_control) AS n_controls,
                   count(DISTINCT sample_type) FILTER (NOT is_control) AS n_sample_types
            FROM clean GROUP BY run_id""",
        "grand_band": "SELECT * FROM band",
        "dimension_lists": """
            SELECT DISTINCT 'run' AS dimension, run_id AS value FROM clean
            UNION ALL SELECT DISTINCT 'sample_type', sample_type FROM samples
            UNION ALL SELECT DISTINCT 'plotted_run', run_id FROM plotted
            UNION ALL SELECT DISTINCT 'plotted_sample_type', sample_type FROM plotted""",
        "stats_display": """
            SELECT sample_type AS "Sample Type", n_wells AS "N Wells", n_positive AS "N Positive",
                   n_negative AS "N Negative", positivity_rate_pct AS "Positivity %",
                   mean_target_cq AS "Mean Target Cq", sd_target_cq AS "SD Target Cq",
                   mean_ic_cq AS "Mean I_C_ Cq", sd_ic_cq AS "SD I_C_ Cq"
            FROM stats""",
        "stats_text": """
            SELECT sample_type, n_positive || '/' || n_wells AS positive,
                   printf('%.1f', positivity_rate_pct) || '%' AS positivity,
                   coalesce(printf('%.3f', mean_target_cq), '—') AS mean_target_cq,
                   coalesce(printf('%.3f', sd_target_cq), '—') AS sd_target_cq
            FROM stats""",
        "run_detail": """
            SELECT w.run_id, run_date, assay_name, lot_number, extraction_lot, w.well, content, sample_label,
                   sample_type, replicate, target_cq, ic_cq, result,
                   CASE WHEN lower(trim(result)) IN ('positive', 'negative', 'inhibition')
                        THEN lower(trim(result)) END AS result_status,
                   CASE WHEN target_cq > 35 THEN 'borderline' END AS cq_status,
                   CASE WHEN f.well IS NOT NULL THEN 'ic_failure' END AS ic_status
            FROM wells w LEFT JOIN ic_failed f ON f.run_id = w.run_id AND f.well = w.well""",
        "run_detail_display": """
            SELECT w.run_id AS "Run ID", run_date AS "Run Date", assay_name AS "Assay Name",
                   lot_number AS "Lot Number", extraction_lot AS "Extraction Lot", w.well AS "Well",
                   content AS "Content", sample_label AS "Sample Label", sample_type AS "Sample Type",
                   replicate AS "Replicate", target_cq AS "Target Cq", ic_cq AS "I_C_ Cq", result AS "Result",
                   CASE WHEN lower(trim(result)) IN ('positive', 'negative', 'inhibition')
                        THEN lower(trim(result)) END AS result_status,
                   CASE WHEN target_cq > 35 THEN 'borderline' END AS cq_status,
                   CASE WHEN f.well IS NOT NULL THEN 'ic_failure' END AS ic_status
            FROM wells w LEFT JOIN ic_failed f ON f.run_id = w.run_id AND f.well = w.well""",
        "interrun_cv": "SELECT * FROM cv",
        "run_comparison_long": "SELECT * FROM compared",
        "run_positivity_long": """
            SELECT run_id, sample_type, round(100e0 * count(*) FILTER (is_positive) / count(*), 9) AS positivity_pct
            FROM samples WHERE (SELECT count(DISTINCT run_id) FROM clean) >= 2 GROUP BY run_id, sample_type""",
        "types_left_out": """
            SELECT run_id, row_idx, sample_type FROM samples
            WHERE sample_type NOT IN ('Auto_Neg', 'Lysis_1.25mL_Control', 'Lysis_5mL_Control', 'Manual_Neg',
                                      'Manual_Pos', 'Unknown')""",
        "run_comparison": f"""
            SELECT run_id, {_wide("CAST(sum(CAST(is_positive AS INTEGER))", "sum_").replace(") AS", ") AS BIGINT) AS")},
                   {_wide("CAST(sum(1)", "count_").replace(") AS", ") AS BIGINT) AS")}
            FROM samples GROUP BY run_id""",
        "run_positivity_matrix": f"""
            SELECT run_id, {_wide("round(avg(CASE WHEN is_positive THEN 100e0 ELSE 0e0 END)").replace(") AS", "), 9) AS")}
            FROM samples WHERE (SELECT count(DISTINCT run_id) FROM clean) >= 2 GROUP BY run_id""",
        "last_write_wins": """
            SELECT run_id, plate_row, plate_col, max(row_idx) AS row_idx, count(*) AS n_rows
            FROM placed GROUP BY run_id, plate_row, plate_col""",
        "plate_result_grid": "SELECT run_id, plate_row, plate_col, result_code, label FROM winners",
        "plate_cq_grid": """
            SELECT p.run_id, p.plate_row, p.plate_col, c.target_cq, c.label, p.is_positive, s.scale_min, s.scale_max
            FROM (SELECT run_id, plate_row, plate_col, bool_or(is_positive) AS is_positive
                  FROM placed GROUP BY run_id, plate_row, plate_col) p
            JOIN scale s USING (run_id)
            LEFT JOIN cq_winners c USING (run_id, plate_row, plate_col)
            WHERE c.target_cq IS NOT NULL OR p.is_positive""",
        "plate_cq_scale": "SELECT * FROM scale",
        "plate_layout": f"""
            SELECT r.run_id, l.plate_row, {_layout_columns()}
            FROM (SELECT DISTINCT run_id FROM clean) r
            CROSS JOIN (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H']) AS plate_row) l
            LEFT JOIN winners w ON w.run_id = r.run_id AND w.plate_row = l.plate_row
            GROUP BY r.run_id, l.plate_row""",
        "positivity_bar": """
            SELECT sample_type, n_positive, n_wells, positivity_rate_pct,
                   n_positive || '/' || n_wells || chr(10) || '(' || printf('%.1f', positivity_rate_pct) || '%)'
                       AS bar_label
            FROM stats""",
        "cq_scatter": """
            SELECT trim(result) AS result, target_cq, ic_cq FROM plotted
            WHERE ic_cq IS NOT NULL AND trim(result) IN ('Positive', 'Negative', 'Valid Ctrl', 'Unknown')""",
        "cq_by_plate_row": """
            SELECT p.run_id, p.well, plate_row,
                   round((ascii(plate_row) - 65) + (plate_col - 6.5e0) / 12e0 * 0.76e0, 9) AS x_pos, target_cq,
                   contains(lower(coalesce(qc_flag, '')), 'borderline') AS borderline
            FROM positioned p LEFT JOIN flag_texts f ON f.run_id = p.run_id AND f.well = p.well
            WHERE NOT is_control AND target_cq IS NOT NULL AND plate_row IS NOT NULL""",
        "cq_by_sample_type": """
            SELECT sample_type, run_id, well, row_idx, target_cq, grand_mean, band_low, band_high
            FROM plotted CROSS JOIN band""",
        "cq_box_stats": """
            SELECT sample_type, n, CASE WHEN n >= 2 THEN round(q1, 9) END AS q1,
                   CASE WHEN n >= 2 THEN round(median, 9) END AS median, CASE WHEN n >= 2 THEN round(q3, 9) END AS q3,
                   CASE WHEN n >= 2 THEN round(least(min(target_cq) FILTER (target_cq >= q1 - 1.5e0 * (q3 - q1)), q1), 9)
                        END AS whisker_low,
                   CASE WHEN n >= 2 THEN round(greatest(max(target_cq) FILTER (target_cq <= q3 + 1.5e0 * (q3 - q1)), q3), 9)
                        END AS whisker_high
            FROM plotted JOIN quartiles USING (sample_type) GROUP BY sample_type, n, q1, median, q3""",
        "cq_box_sketches": """
            SELECT sample_type, n, true AS q1_near, true AS median_near, true AS q3_near FROM quartiles""",
        "incremental_stats": "SELECT * FROM stats",
        "incremental_controls": "SELECT * FROM controls",
        "incremental_cv": "SELECT * FROM cv",
        "incremental_flags": f"SELECT {_FLAG_COLUMNS} FROM flags",
        "interrun_cv_bar": """
            SELECT sample_type, cv_pct, printf('%.1f', cv_pct) || '%' AS bar_label, 20e0 AS limit_pct,
                   cv_pct > 20 AS above_limit
            FROM cv""",
    }
    return {name: _sql(query) for name, query in queries.items()}
