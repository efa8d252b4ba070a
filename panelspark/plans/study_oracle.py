"""SQL of the queries over studies, audits and lineage: planted faults are counted where they were planted."""

from __future__ import annotations

from ..operators.holdout import HAZARDS
from ..operators import markup
from ..operators.markup import ALLOWED_ATTRIBUTES, ALLOWED_ELEMENTS, BLOCKED_ELEMENTS
from ..operators.markup_reader import ATTRIBUTE, CLOSES, CONTROL, NAME, OPENS, QUOTED, REFERENCE, TOKEN, UNQUOTED
from .oracle import F, H, P, R, REPLAY, centre

BOUNDS = """b AS (SELECT vec_id, count(*) FILTER (WHERE v > 64)::INTEGER AS n, coalesce(sum(v) FILTER (WHERE v > 64), 0)::BIGINT AS s, min(x) FILTER (WHERE v > 64) AS x0, max(x) FILTER (WHERE v > 64) AS x1, min(y) FILTER (WHERE v > 64) AS y0, max(y) FILTER (WHERE v > 64) AS y1 FROM r GROUP BY vec_id)"""


def counted(source: str, faults: dict[str, str], ctes: str = "") -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in faults.items())
    return f"WITH {ctes + ', ' if ctes else ''}marked AS (SELECT list_filter([{cases}], lambda z: z IS NOT NULL) AS c FROM {source}) SELECT code, count(*) AS n FROM (SELECT unnest(CASE WHEN len(c) > 0 THEN c ELSE ['none'] END) AS code FROM marked) GROUP BY code"


def every(key: str, *ns: int) -> str:
    return "(" + " OR ".join(f"{key} % {n} = 0" for n in ns) + ")"


def spaced(pattern: str) -> str:
    """The pattern with \\s as Java has it, vertical tabs included."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[0] == "\\":
            out += two if two != r"\s" else r"\s\x0B" if inside else r"[\s\x0B]"
            i += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out += two[0]
        i += 1
    return out


def oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    e, p, c, v = (lambda *n, k=k: every(k, *n) for k in ("event_id", "p_partkey", "conv_id", "vec_id"))
    o["candidate_violations"] = counted("part", {"candidate-hash": p(19), "candidate-range": "abs(p_size % 13 - 6) > 5", "candidate-off-axis": p(17), "candidate-id": p(23)})
    o["datum_violations"] = counted("vv", {
        "schema-version": e(101), "authorizing": e(103), "rater-invalid": e(107), "context-invalid": e(109), "sizes-invalid": e(113), "trial-id": e(127), "preferred-id": e(131), "tie-flag": e(137),
        "feature-extent": e(139), "feature-components": e(149),
    }, F)
    o["adaptive_violations"] = counted("vv", {"trial-values": e(109), "trial-size": e(103), "trial-theme": e(107), "trial-id": e(101, 103, 107), "index-invalid": e(113), "response-time": e(127)}, F)
    conv = "cv AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS kinds, count(role) AS told, bool_or(role NOT IN ('user', 'assistant')) AS odd FROM conversations GROUP BY conv_id)"
    o["study_violations"] = counted("cv", {"trial-count": "n NOT BETWEEN 1 AND 32", "trial-unique": "kinds <> told", "trial-bound": "odd", "study-tampered": c(7)}, conv)
    o["base_studies"] = counted("cv", {"base-study": c(5, 11), "base-study-unusable": f"kinds < 2 OR {c(3)}"}, conv)
    o["manifest_violations"] = counted("part", {"case-identity": p(29), "case-condition": p(37, 41), "case-policies": p(31), "safety-wrapper": f"{p(22)} AND p_size % 11 = 0"})
    o["source_identities"] = "SELECT 'hash' AS side, hash AS value, count(*) AS n FROM (SELECT sha256((CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END)::VARCHAR) AS hash FROM part) GROUP BY hash HAVING count(*) > 1"
    o["missing_hazards"] = "SELECT kind FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(HAZARDS)) + ") z(i, kind) WHERE i NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)"
    o["training_violations"] = f"SELECT p_brand, concat_ws(',', CASE WHEN min(p_partkey) % 3 = 0 THEN 'training-bindings' END, CASE WHEN bool_or({p(97)}) THEN 'training-sources' END, CASE WHEN bool_or({p(89)}) THEN 'training-families' END, CASE WHEN bool_or({p(83)}) THEN 'training-groups' END) AS codes FROM part GROUP BY p_brand"
    o["audit_violations"] = counted("part", {
        "audit-schema": p(11), "audit-binding": p(13), "audit-sizes": p(29), "audit-request": p(31), "audit-path": p(19), "audit-hash": p(13, 17), "audit-view-box": f"{p(23)} AND p_size <> 1", "unsafe-source": p(47),
    })
    o["row_audit_mismatches"] = """SELECT CASE WHEN p_partkey % 50 = 0 THEN 'audit' ELSE concat_ws(',', CASE WHEN l_orderkey % 31 = 0 THEN 'source_sha256' END, CASE WHEN l_orderkey % 37 = 0 THEN 'rtl' END, CASE WHEN l_orderkey % 41 = 0 AND p_size % 3 = 0 THEN 'context' END) END AS differences, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
    o["trial_candidates"] = f"WITH {F} SELECT axis, a AS a_value, b AS b_value, count(*) AS n, count(*) FILTER (WHERE choice = 'A') AS a_wins FROM vv GROUP BY ALL"
    o["trial_displays"] = f"WITH {F} SELECT theme, size, round(a * 100)::BIGINT || ':' || theme || ':' || size AS a_image, round(b * 100)::BIGINT || ':' || theme || ':' || size AS b_image, count(*) AS n FROM vv GROUP BY ALL"
    o["participant_answers"] = f"""WITH {H}, said AS (SELECT l_partkey AS case_id, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'B' WHEN l_linestatus = 'O' THEN 'TIE' ELSE 'ABSTAIN' END AS choice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1)
        SELECT CASE WHEN t.case_id % 500 = 0 THEN 'unknown' ELSE baseline END AS baseline, choice, count(*) AS n FROM t JOIN said ON said.case_id = t.case_id GROUP BY ALL"""
    held = "regexp_extract(p_brand, '(\\d+)', 1)::INTEGER > 10"
    o["blinded_payload"] = f"SELECT p_partkey AS case_id, to_base64(encode('{{\"id\":\"' || sha256(p_partkey::VARCHAR) || '\",\"theme\":\"light\",\"size\":24}}')) AS payload FROM part WHERE {held}"
    o["ordered_pairs"] = f"WITH {P} SELECT k, source_no, axis, left_pct, row_number() OVER (ORDER BY source_no, axis, left_pct, k) AS position FROM p ORDER BY position"
    o["ordered_cases"] = f'SELECT p_partkey AS case_id, p_brand AS family, p_type AS "group" FROM part WHERE {held} ORDER BY case_id'
    o["geometry"] = f"WITH {R}, {BOUNDS} SELECT vec_id, -4 + x0 * 3.0::DOUBLE AS x, 2 + y0 * 1.5::DOUBLE AS y, (x1 - x0 + 1) * 3.0::DOUBLE AS width, (y1 - y0 + 1) * 1.5::DOUBLE AS height, x0 * 3.0::DOUBLE AS left, 24 - (x1 + 1) * 3.0::DOUBLE AS right, y0 * 1.5::DOUBLE AS top, 12 - (y1 + 1) * 1.5::DOUBLE AS bottom FROM b"
    side = lambda axis, lo, hi, olo, ohi, at: f"SELECT vec_id, '{axis}' AS axis, (vec_id % 13 - 6)::DOUBLE AS proposal, round((4 - {at}) / 8 * 100, 6) + 0 AS centroid_offset, round((7 - {hi} - {lo}) / 8::DOUBLE * 100, 6) + 0 AS bearing_imbalance, round(({hi} - {lo} + 1) / 8::DOUBLE * 100, 6) AS extent, round(({ohi} - {olo} + 1) / 8::DOUBLE * 100, 6) AS orthogonal_extent, (vec_id % 3)::INTEGER AS components FROM b JOIN k USING (vec_id) WHERE n > 0"
    o["source_features"] = f"WITH {R}, {BOUNDS}, k AS ({centre(64)}) {side('x', 'x0', 'x1', 'y0', 'y1', 'k.x')} UNION ALL {side('y', 'y0', 'y1', 'x0', 'x1', 'k.y')}"
    o["feature_violations"] = counted("(SELECT vec_id FROM b, range(2) WHERE n > 0)", {"feature-proposal": "abs(vec_id % 13 - 6) > 5", "feature-components": v(3)}, f"{R}, {BOUNDS}")
    at = lambda w: f"""SELECT vec_id, {w} AS size, count(*) FILTER (WHERE v > 64)::INTEGER AS painted_pixels, coalesce(sum(v) FILTER (WHERE v > 64), 0)::BIGINT AS alpha_sum, round(sum(v * (x + 0.5::DOUBLE)) FILTER (WHERE v > 64) / nullif(sum(v) FILTER (WHERE v > 64), 0) / {w} * 24, 4) AS x, round(sum(v * (y + 0.5::DOUBLE)) FILTER (WHERE v > 64) / nullif(sum(v) FILTER (WHERE v > 64), 0) / {w} * 24, 4) AS y
        FROM (SELECT vec_id, x // {8 // w} AS x, y // {8 // w} AS y, sum(v)::BIGINT // {(8 // w) ** 2} AS v FROM r GROUP BY ALL) GROUP BY vec_id"""  # noqa: E731
    o["size_measures"] = f"WITH {R} " + " UNION ALL ".join(map(at, (8, 4, 2)))
    why = {
        "no-painted-content": "n = 0", "no-optical-engine": v(41), "brand-artwork-manual-review": v(11), "text-baseline-unverified": f"{v(13)} AND NOT {v(11)}", "mask-geometry-unsupported": v(17), "filter-geometry-unsupported": v(19),
        "font-rendering-nondeterministic": v(23), "non-scaling-stroke-unsupported": v(29), "semantic-weight-ambiguous": v(31),
        "fix-svg-bounds-first": "n > 0 AND (abs(bx - 4) / 8 > 0.125 OR abs(by_ - 4) / 8 > 0.125 OR (abs(bx - 4) / 8 > 0.01 AND abs(x - bx) / 8 < 0.005) OR (abs(by_ - 4) / 8 > 0.01 AND abs(y - by_) / 8 < 0.005))",
    }
    decided = f"""{R}, {BOUNDS}, k AS ({centre(64)}), q AS (SELECT vec_id, n, s, k.x, k.y, (x0 + x1 + 1) / 2 AS bx, (y0 + y1 + 1) / 2 AS by_ FROM b JOIN k USING (vec_id)),
        z AS (SELECT *, (4 - x) / 8 * 100 AS dx, (4 - y) / 8 * 100 AS dy, concat_ws(',', {', '.join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in why.items())}) AS why FROM q), w AS (SELECT *, sqrt(dx * dx + dy * dy) AS far FROM z),
        dd AS (SELECT *, CASE WHEN why <> '' OR far > 5 THEN 'ABSTAIN' WHEN far < 0.1 THEN 'NO_CHANGE' ELSE 'REVIEW' END AS status, CASE WHEN why <> '' THEN why WHEN far > 5 THEN 'proposal-out-of-range' WHEN far < 0.1 THEN 'within-tolerance' END AS reason FROM w)"""
    o["decision_reasons"] = f"WITH {decided} SELECT vec_id, status, reason, CASE status WHEN 'REVIEW' THEN round(round(dx, 6), 4) + 0 WHEN 'NO_CHANGE' THEN 0 END AS dx, CASE status WHEN 'REVIEW' THEN round(round(dy, 6), 4) + 0 WHEN 'NO_CHANGE' THEN 0 END AS dy FROM dd"
    o["audit_digests"] = f"WITH {decided} SELECT vec_id, sha256(concat_ws('|', vec_id, n, s, status, coalesce(reason, 'null'))) AS digest FROM dd"
    o["audit_markdown"] = f"WITH {decided} SELECT '# Audit' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown FROM (SELECT '- **' || status || '**: ' || count(*) AS line FROM dd GROUP BY status)"
    o["apply_lineage"] = counted("part", {
        "audit-abstained": p(47), "verification-schema-unsupported": p(11), "verification-not-pass": p(13), "approval-lineage-mismatch": p(17, 19), "invalid-correction": p(23), "verification-source-mismatch": p(29), "verification-audit-mismatch": p(31),
        "candidate-hash-mismatch": p(37), "comparison-lineage-mismatch": p(53), "correction-digest-mismatch": p(41), "correction-out-of-range": f"{p(23)} OR abs(p_size % 15 - 7) > 5", "verification-evidence-missing": p(43), "postflight-clipping": p(59),
    })
    o["ideal_readiness"] = f"""WITH {F}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS n FROM vv),
        g AS (SELECT source_no, count(*) AS row_count, count(*) FILTER (WHERE choice <> 'ABSTAIN' AND n = 1) AS evidence_rows, count(DISTINCT user_id) FILTER (WHERE choice <> 'ABSTAIN' AND n = 1) AS rater_count, count(*) FILTER (WHERE choice = 'TIE' AND n = 1) AS tie_rows, count(*) FILTER (WHERE choice = 'ABSTAIN') AS abstain_rows,
          source_no % 7 = 0 AND count(DISTINCT event_id % 2) > 1 AS mixed FROM q GROUP BY source_no)
        SELECT * EXCLUDE (mixed), concat_ws(',', CASE WHEN mixed THEN 'provenance-mismatch' END, CASE WHEN rater_count < 3 THEN 'too-few-raters' END, CASE WHEN evidence_rows < 5 THEN 'too-few-rows' END) AS reasons FROM g"""
    o["replay_mismatches"] = f"WITH {REPLAY}, sh AS MATERIALIZED (SELECT rater, step, trial_id, rater || ':' || step AS k FROM rp) SELECT rater, step::INTEGER AS step, 'another' AS trial_id, trial_id AS expected FROM sh WHERE regexp_matches(sha256(k), '^0[0-4]')"
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    bare = "h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<!DOCTYPE[^>]*>', '', 'gi') AS h FROM pages)"
    q = lambda pattern: "'" + spaced(pattern).replace("'", "''") + "'"
    quoted = q(QUOTED)
    name_of = f"regexp_extract(t, {q(rf'^</?({NAME})')}, 1)"
    inside = f"regexp_replace(regexp_replace(t, {q(rf'^<{NAME}')}, ''), '/?>$', '')"
    pairs = f"regexp_extract_all({inside}, {q('(?s)' + ATTRIBUTE)})"
    # tokens of documents h (id, h) with their kinds, as the reader cuts them
    cut = f"""tk AS (SELECT id, unnest(toks) AS t, unnest(range(len(toks))) AS pos FROM (SELECT id, regexp_extract_all(h, {q('(?s)' + TOKEN)}) AS toks FROM h)),
        kd AS (SELECT *, CASE WHEN starts_with(t, '<!--') THEN 'comment' WHEN starts_with(t, '<![CDATA[') THEN 'section' WHEN starts_with(t, '<?') THEN 'instruction' WHEN t = '<' THEN 'stray' WHEN NOT starts_with(t, '<') THEN 'text'
          WHEN starts_with(t, '</') THEN 'close' WHEN ends_with(t, '/>') THEN 'empty' ELSE 'open' END AS k FROM tk),
        nm AS (SELECT *, {name_of} AS n, k IN ('open', 'empty') AS opens, CASE k WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END AS step FROM kd),
        dp AS (SELECT *, sum(step) OVER (PARTITION BY id ORDER BY pos) AS after, sum(opens::INT) OVER (PARTITION BY id ORDER BY pos) AS opened FROM nm),
        lv AS (SELECT *, after + (k = 'close')::INT AS level FROM dp), mt AS (SELECT *, lag(n) OVER (PARTITION BY id, level, k IN ('open', 'close') ORDER BY pos) AS partner FROM lv),
        own AS (SELECT *, CASE WHEN k = 'stray' THEN 'stray-less-than' WHEN k = 'comment' AND contains(substr(t, 5, length(t) - 7), '--') THEN 'bad-comment' WHEN k = 'close' AND NOT regexp_matches(t, {q(CLOSES)}) THEN 'bad-closing-tag'
          WHEN opens AND regexp_matches(regexp_replace(t, {quoted}, '""', 'g'), {q(UNQUOTED)}) THEN 'unquoted-attribute' WHEN opens AND NOT regexp_matches(t, {q('(?s)' + OPENS)}) THEN 'bad-tag'
          WHEN opens AND len({pairs}) > len(list_distinct(list_transform({pairs}, lambda a: regexp_extract(a, {q('^([^' + chr(92) + 's=]+)')}, 1)))) THEN 'duplicate-attribute'
          WHEN (opens OR k = 'text') AND contains(regexp_replace(t, {q(REFERENCE)}, '', 'g'), '&') THEN 'bad-reference' WHEN (k = 'text' AND contains(t, ']]>')) OR regexp_matches(t, {q(CONTROL)}) THEN 'bad-text'
          WHEN k = 'close' AND after < 0 THEN 'stray-close' WHEN k = 'close' AND partner IS DISTINCT FROM n THEN 'misnested' WHEN opens AND after - step = 0 AND opened > 1 THEN 'several-roots'
          WHEN after = 0 AND (k = 'section' OR (k = 'text' AND regexp_replace(t, '[ \\t\\r\\n]', '', 'g') <> '')) THEN 'content-outside-root' END AS broken FROM mt),
        br AS (SELECT id, count(*) AS tokens, count(*) FILTER (WHERE opens) AS elements, arg_min(broken, pos) FILTER (WHERE broken IS NOT NULL) AS early, min(pos) FILTER (WHERE broken IS NOT NULL) AS early_at, arg_max(after, pos) AS left_open FROM own GROUP BY id),
        brk AS (SELECT h.id, coalesce(tokens, 0) AS tokens, coalesce(elements, 0) AS elements, coalesce(early, CASE WHEN coalesce(elements, 0) = 0 THEN 'no-root' WHEN left_open > 0 THEN 'unclosed' END) AS code, early_at FROM h LEFT JOIN br USING (id))"""
    o["markup_breaks"] = f"""WITH {bare.replace('h AS', 'b AS', 1)}, h AS (SELECT page_id || '/served' AS id, h FROM b UNION ALL SELECT page_id || '/closed', regexp_replace(h, '<(br|hr|img|input|link|meta)\\b([^<>]*)>', '<\\1\\2/>', 'g') FROM b), {cut}
        SELECT id AS page, tokens::INT AS tokens, elements::INT AS elements, code, (CASE WHEN early_at IS NOT NULL THEN early_at WHEN code IS NOT NULL THEN tokens END)::INT AS at FROM brk"""
    # a document is a row, whatever its id; what forbids parsing comes first and alone
    first = f"""{bare.replace('h AS', 'b AS', 1)}, h0 AS MATERIALIZED (SELECT row_number() OVER () AS id, page_id, h FROM b),
        fl AS (SELECT *, list_filter([CASE WHEN strlen(h) > {markup.MAX_BYTES} THEN 'input-too-large' END, CASE WHEN regexp_matches(h, '(?i)<!DOCTYPE') THEN 'unsafe-doctype' END, CASE WHEN regexp_matches(h, '(?i)<!ENTITY') THEN 'unsafe-entity' END,
          CASE WHEN contains(regexp_replace(h, {q(markup.DECLARED)}, ''), '<?') THEN 'unsafe-processing-instruction' END, CASE WHEN len(regexp_extract_all(h, {q(markup.ELEMENT)})) > {markup.MAX_ELEMENTS} THEN 'too-many-elements' END], lambda c: c IS NOT NULL) AS early FROM h0),
        h AS (SELECT id, h FROM fl WHERE len(early) = 0)"""
    code = "CASE WHEN starts_with(p, '&#x') THEN try_cast('0x' || regexp_extract(p, 'x([0-9A-Fa-f]+)', 1) AS INTEGER) WHEN starts_with(p, '&#') THEN try_cast(regexp_extract(p, '#([0-9]+)', 1) AS INTEGER) END"
    valid = f"coalesce({code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343, false)"
    decoded = lambda v: f"coalesce(array_to_string(list_transform(regexp_extract_all({v}, '(?s)&(?:amp|lt|gt|quot|apos|#[0-9]{{1,7}}|#x[0-9A-Fa-f]{{1,6}});|[^&]+|&'), lambda p: CASE p WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN '''' ELSE CASE WHEN {valid} THEN chr(CASE WHEN {valid} THEN {code} ELSE 63 END) ELSE p END END), ''), '')"
    css = lambda v: f"regexp_matches({v}, {q(rf'\A\s*{markup.VALUE}\s*\z')})"
    fine = f"lower(regexp_extract(p, {q(r'\A\s*([A-Za-z-]+)\s*:')}, 1)) IN ({names(markup.STYLE_PROPERTIES)}) AND {css('regexp_extract(p, ' + q(r'(?s)\A[^:]*:(.*)\z') + ', 1)')}"
    safe = f"(len(list_filter(regexp_extract_all(value, {q(markup.DECLARATION)}), lambda p: trim(p, ' ') <> '' AND NOT ({fine}))) = 0 AND regexp_matches(regexp_replace(value, {q(markup.DECLARATION)}, '', 'g'), {q(r'\A[;\s]*\z')}))"
    o["markup_document_issues"] = f"""WITH {first}, {cut}, op AS (SELECT id, t, string_split(n, ':')[-1] AS name, after + (k = 'empty')::INT AS depth FROM dp WHERE opens),
        pr AS (SELECT id, unnest({pairs}) AS pair FROM op), sp AS (SELECT id, regexp_extract(pair, {q(r'\A([^\s=]+)')}, 1) AS full_name, contains(pair, '=') AS told, regexp_extract(pair, {q(r'(?s)\A[^=]*=\s*(.*)\z')}, 1) AS v FROM pr),
        raw AS (SELECT id, full_name, string_split(full_name, ':')[-1] AS name, CASE WHEN NOT told THEN '' WHEN v[1] IN ('"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END AS r FROM sp), ab AS (SELECT id, full_name, name, starts_with(lower(name), 'on') AS event, {decoded('r')} AS value FROM raw),
        ft AS (SELECT id, arg_min(t, pos) AS t FROM nm WHERE k IN ('open', 'close', 'empty') GROUP BY id), fp AS (SELECT id, list_filter({pairs}, lambda a: regexp_extract(a, {q(r'\A([^\s=]+)')}, 1) = 'viewBox')[1] AS pair FROM ft),
        fv AS (SELECT id, CASE WHEN contains(pair, '=') THEN regexp_extract(pair, {q(r'(?s)\A[^=]*=\s*(.*)\z')}, 1) END AS v FROM fp), fr AS (SELECT id, CASE WHEN v[1] IN ('"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END AS r FROM fv),
        fd AS (SELECT id, list_transform(string_split_regex(trim({decoded('r')}, ' '), {q(r'[\s,]+')}), lambda p: CASE WHEN regexp_matches(p, {q(rf'\A{markup.PLAIN_NUMBER}\z')}) THEN try_cast(p AS DOUBLE) END) AS box FROM fr)
        SELECT DISTINCT page_id, code FROM (
          SELECT id, unnest(early) AS code FROM fl UNION ALL SELECT id, 'not-well-formed' FROM brk WHERE code IS NOT NULL
          UNION ALL SELECT id, CASE WHEN name IN ({names(BLOCKED_ELEMENTS)}) THEN 'unsafe-element-' || name WHEN name NOT IN ({names(ALLOWED_ELEMENTS)}) THEN 'unsupported-element' END FROM op
          UNION ALL SELECT id, 'tree-too-deep' FROM op WHERE depth > {markup.MAX_DEPTH}
          UNION ALL SELECT id, unnest([CASE WHEN event THEN 'unsafe-event-attribute' END, CASE WHEN name = 'href' AND NOT regexp_matches(trim(value, ' '), {q(rf'\A#{markup.NAME}\z')}) THEN 'external-resource' END,
            CASE WHEN name = 'style' AND NOT {safe} THEN 'unsafe-style' END, CASE WHEN name IN ({names(markup.PAINTS)}) AND contains(value, '(') AND NOT {css('value')} THEN 'external-resource' END,
            CASE WHEN name <> 'href' AND NOT event AND full_name NOT IN ({names(ALLOWED_ATTRIBUTES)}) THEN 'unsupported-attribute' END]) FROM ab
          UNION ALL SELECT id, 'invalid-viewbox' FROM fd WHERE NOT coalesce(len(box) = 4 AND len(list_filter(box, lambda p: p IS NOT NULL AND isfinite(p))) = 4 AND box[3] > 0 AND box[4] > 0, false)) JOIN fl USING (id) WHERE code IS NOT NULL"""
    o["coloured_roots"] = f"WITH {bare} SELECT page_id, sha256(regexp_replace(h, '^(\\s*)<html', '\\1<html color=\"#123456\" fill=\"#123456\"')) AS sha256 FROM h"
    o["comparison_panels"] = f"SELECT p_partkey AS case_id, theme, size, sha256(p_partkey || ':source') AS source_image, sha256(concat_ws(':', p_partkey, p_size % 9 - 4, theme, size)) AS candidate_image FROM part, (VALUES ('light'), ('dark')) a(theme), (VALUES (16), (24)) b(size) WHERE {held} AND p_size % 11 <> 0 AND p_size % 9 <> 4"
    o["run_summary"] = f"WITH {P} SELECT '{{\"eligible_pairs\":' || count(*) FILTER (WHERE eligible) || ',\"eligible_family_count\":' || count(DISTINCT family_no) FILTER (WHERE eligible) || '}}' AS summary FROM p"
    return o
