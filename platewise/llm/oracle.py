"""Queries of this subpackage as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

import re

from platewise.llm import license_scan
from platewise.llm import quality_rules as q

_PLAIN = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality_rules() -> str:
    def value(rule: str) -> str:
        top, bottom = q.RULES[rule][0].split(" / ")
        return f"CASE WHEN {bottom} > 0 THEN {top} / {bottom}::DOUBLE ELSE 0 END"

    p = q.FALSE_REJECTION / len(q.RULES)
    candidates = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {step} AS step, {cutoff}::DOUBLE AS cutoff, lang, quality,"
        f" {value(rule)} > {cutoff} AS rejected FROM labelled"
        for rule, (_, cutoffs) in q.RULES.items()
        for step, cutoff in enumerate(cutoffs)
    )
    failed = ", ".join(
        f"CASE WHEN {value(rule)} > (SELECT c.cutoff FROM cutoffs c WHERE c.rule = '{rule}'"
        f" AND c.lang IS NOT DISTINCT FROM f.lang) THEN '{rule}' END"
        for rule in q.RULES
    )
    return rf"""
        WITH words AS (
            SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS ws
            FROM documents),
        windows AS (
            SELECT doc_id, s, array_to_string(ws[s + 1 : s + 5], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS s FROM words)),
        repeated AS (
            SELECT doc_id, count(DISTINCT s + o) AS n FROM (
                SELECT doc_id, s, unnest(range(5)) AS o FROM windows
                WHERE (doc_id, k) IN (SELECT (doc_id, k) FROM windows GROUP BY doc_id, k HAVING count(*) > 1))
            GROUP BY doc_id),
        lines AS (
            SELECT doc_id, count(*) AS n, count(DISTINCT line) AS n_distinct
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
            WHERE regexp_matches(line, {_PLAIN}) GROUP BY doc_id),
        figures AS (
            SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals,
                   coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.n_distinct, 0) AS n_dup_lines,
                   coalesce(r.n, 0) AS n_repeat_words,
                   len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed
            FROM words LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
        labelled AS (
            SELECT f.*, quality FROM figures f JOIN labels USING (doc_id)
            WHERE quality IN (0, 1) AND NOT base_failed),
        counted AS (
            SELECT lang, rule, step, cutoff, sum(quality) AS n,
                   count(*) FILTER (rejected AND quality = 1) AS good, count(*) FILTER (rejected AND quality = 0) AS bad
            FROM ({candidates}) GROUP BY lang, rule, step, cutoff),
        tested AS (
            SELECT *, CASE WHEN good > n * {p} THEN 1 ELSE list_sum(list_transform(range(good + 1), lambda j:
                       exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))
                   END <= {q.DELTA} / (greatest(1, (SELECT count(*) FROM (SELECT DISTINCT lang FROM labelled)))
                                       * {len(q.RULES)}) AS passed
            FROM counted),
        cutoffs AS (
            SELECT lang, rule, arg_max(cutoff, (bad - good) * 1000 - step) AS cutoff
            FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY step) AS certified FROM tested)
            WHERE certified AND bad > good GROUP BY lang, rule),
        judged AS (
            SELECT *, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules
            FROM figures f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND failed_rules = '' AS kept, failed_rules
        FROM judged"""


_SUBSTRING_DEDUP = f"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS ws FROM documents),
    windows AS (
        SELECT doc_id, s, array_to_string(ws[s + 1 : s + 35], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS s FROM words)),
    gone AS (
        SELECT DISTINCT doc_id, s + o AS i FROM (
            SELECT doc_id, s, unnest(range(35)) AS o FROM windows
            WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1))),
    kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n
        FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words)
        ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)"""

_DECONTAMINATION = f"""
    WITH items AS (
        SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
    phrases AS (
        SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s + 1 : s + least(len(ws), 10)], ' ') AS k
        FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS s FROM items WHERE len(ws) > 0)),
    words AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
    windows AS (
        SELECT doc_id, n, s, array_to_string(ws[s + 1 : s + n], ' ') AS k
        FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS s
              FROM words JOIN (SELECT DISTINCT n FROM phrases) ON len(ws) >= n)),
    found AS (
        SELECT doc_id, item_id, s, n FROM windows JOIN phrases USING (n, k)),
    hit AS (
        SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, s + unnest(range(n)) AS i FROM found) GROUP BY doc_id),
    listed AS (
        SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL)
        GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
    FROM words LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)"""


def _license_scan() -> str:
    """Words stand between blanks of their own, so matches need no look-around."""

    def pattern(body: str) -> str:
        wide = re.sub(r" (\?)?", lambda m: "(?:~~)?" if m[1] else "~~", body).replace("~", " ")
        return f" (?:{wide}) ".replace("'", "''")

    rules = [(level, n, label, confidence, pattern(body)) for n, (level, label, confidence, _, body) in enumerate(license_scan.rules())]
    rules += [(0, -1, label, 0.0, pattern(phrase)) for phrase, label in license_scan.BASE.items()]
    values = ", ".join(f"({a}, {b}, '{c}', {d}::DOUBLE, '{e}')" for a, b, c, d, e in rules)
    return f"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
        norms AS (
            SELECT doc_id, ' ' || array_to_string(ws, '  ') || ' ' AS norm FROM words
            WHERE regexp_matches(array_to_string(ws, ' '), '{"|".join(license_scan.gate_words())}')),
        rules(level, rule, label, confidence, pattern) AS (VALUES {values}),
        matched AS (
            SELECT doc_id, level, rule, label, confidence,
                   list_transform(regexp_split_to_array(norm, pattern), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS gaps,
                   list_transform(regexp_extract_all(norm, pattern), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS sizes
            FROM norms, rules WHERE regexp_matches(norm, pattern)),
        spans AS (
            SELECT doc_id, level, rule, label, confidence,
                   CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1 : i - 1]), 0) AS BIGINT) AS start,
                   CAST(list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS BIGINT) AS stop
            FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM matched)),
        base AS (SELECT * FROM spans WHERE level = 0),
        found AS (SELECT * FROM spans WHERE level > 0),
        kept AS (
            SELECT * FROM found d WHERE NOT EXISTS (
                SELECT 1 FROM found o
                WHERE o.doc_id = d.doc_id AND o.start <= d.start AND o.stop >= d.stop AND o.level <= d.level
                  AND ((o.start, o.stop) <> (d.start, d.stop) OR (o.level, o.rule) < (d.level, d.rule)))),
        based AS (
            SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM base GROUP BY doc_id),
        named AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM kept) GROUP BY doc_id),
        scored AS (SELECT doc_id, max(confidence) AS score FROM kept GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
               coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(score, 0) AS score
        FROM words LEFT JOIN based b USING (doc_id) LEFT JOIN named a USING (doc_id) LEFT JOIN scored USING (doc_id)"""


_LEXICAL_SEARCH = rf"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS term FROM documents),
    docs AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    counts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM docs),
    held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM held, counts GROUP BY term),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS term FROM benchmark),
    scores AS (
        SELECT a.item_id, h.doc_id,
            sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * d.n * c.docs) // c.length))))::BIGINT
                AS score
        FROM asked a JOIN held h USING (term) JOIN weights w USING (term) JOIN docs d USING (doc_id), counts c
        GROUP BY a.item_id, h.doc_id),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scores WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


_HARD_NEGATIVES = """
    WITH vectors AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
            list_inner_product(a.v, r.v)::BIGINT AS score
        FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id,
        (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
        s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scores s
        ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
    QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality_rules(),
        "op5_substring_dedup": _SUBSTRING_DEDUP,
        "op8_decontamination": _DECONTAMINATION,
        "op9_license_scan": _license_scan(),
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op13_lexical_search": _LEXICAL_SEARCH,
    }
