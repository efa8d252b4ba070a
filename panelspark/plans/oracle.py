"""SQL that computes the same results independently, for DuckDB over the same tables."""

from __future__ import annotations

F = r"""
f AS (SELECT event_id, ts, user_id, event_type, k, k % 10 AS source_no, (k % 10) % 5 AS family_no, k % 10 AS group_no,
        CASE WHEN (k // 10) % 2 = 0 THEN 'x' ELSE 'y' END AS axis,
        CAST(-1.25 + 0.5 * (k // 20) AS DOUBLE) AS left_pct, CAST(-0.75 + 0.5 * (k // 20) AS DOUBLE) AS right_pct, (3 * (k % 10) - 15)::DOUBLE / 10 AS proposal_pct, event_id % 2 = 0 AS straight,
        CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'TIE' WHEN 'signup' THEN 'ABSTAIN' END AS choice,
        CASE WHEN (event_id // 2) % 2 = 0 THEN 16 ELSE 24 END AS size, CASE WHEN (event_id // 4) % 2 = 0 THEN 'light' ELSE 'dark' END AS theme
      FROM (SELECT *, regexp_extract(props, '"k"\s*:\s*(\d+)', 1)::INTEGER AS k FROM events)),
vv AS (SELECT *, CASE WHEN straight THEN left_pct ELSE right_pct END AS a, CASE WHEN straight THEN right_pct ELSE left_pct END AS b,
        CASE WHEN choice IN ('A', 'B') THEN CASE WHEN (choice = 'A') = straight THEN 'candidate1' ELSE 'candidate2' END ELSE lower(choice) END AS vote FROM f WHERE choice IS NOT NULL),
v AS (SELECT * FROM vv QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1)"""
P = F + """,
c AS (SELECT k, source_no, family_no, group_no, axis, left_pct, right_pct, proposal_pct, count(*) FILTER (WHERE vote = 'candidate1') AS candidate1, count(*) FILTER (WHERE vote = 'candidate2') AS candidate2,
        count(*) FILTER (WHERE vote = 'tie') AS tie, count(*) FILTER (WHERE vote = 'abstain') AS abstain FROM v GROUP BY ALL),
p AS (SELECT *, candidate1 + candidate2 AS decisive, candidate1 + candidate2 + tie + abstain AS total, candidate1 + candidate2 >= 3 AS eligible,
        CASE WHEN candidate1 + candidate2 >= 3 THEN round(candidate1 / (candidate1 + candidate2), 8) END AS target FROM c)"""
W = P + """,
w AS (SELECT *, CASE WHEN eligible THEN round(decisive / sum(decisive) FILTER (WHERE eligible) OVER (PARTITION BY source_no, axis), 10) ELSE 0 END AS weight FROM p)"""
# features of left less those of right
X = W + """,
x AS (SELECT *, -(left_pct / 5) * (left_pct / 5) + (right_pct / 5) * (right_pct / 5) AS x0, 2 * (left_pct / 5) * (proposal_pct / 5) - 2 * (right_pct / 5) * (proposal_pct / 5) AS x1, -abs(left_pct / 5) + abs(right_pct / 5) AS x2 FROM w)"""
B = X + """,
l AS (SELECT target, weight, 'zero' AS model, 1 / (1 + exp(-x0)) AS p FROM x WHERE eligible UNION ALL SELECT target, weight, 'centroid', 1 / (1 + exp(-(x0 + x1))) FROM x WHERE eligible)"""
LOSSES = """SELECT {keys} model, count(*) AS eligible_pairs, count(*) FILTER (WHERE target <> 0.5) AS winner_pairs,
  round(sum(CASE WHEN target <> 0.5 AND (p > 0.5) = (target > 0.5) THEN weight ELSE 0 END) / sum(weight) FILTER (WHERE target <> 0.5), {d}) AS winner_accuracy,
  round(sum(weight * -(target * ln(p) + (1 - target) * ln(1 - p))) / sum(weight), {d}) AS log_loss, round(sum(weight * (p - target) * (p - target)) / sum(weight), {d}) AS brier FROM {rows} GROUP BY ALL"""


def folds(mode: str, source: str = "w") -> str:
    """Greedy placement, unit by unit: a list of loads carried through a recursive query."""
    unit = "family_no::VARCHAR" if mode == "family" else "family_no || '/' || group_no"
    return f"""u_{mode} AS (SELECT unit, round(sum(weight), 9) AS weight FROM (SELECT {unit} AS unit, weight FROM {source} WHERE eligible) GROUP BY unit),
o_{mode} AS (SELECT *, row_number() OVER (ORDER BY weight DESC, sha256('panel:{mode}:' || unit)) AS i, count(*) OVER () AS n FROM u_{mode}),
g_{mode} AS (SELECT 0::BIGINT AS i, list_transform(range(least(5, (SELECT count(*) FROM u_{mode}))), lambda z: 0.0::DOUBLE) AS load, 0::BIGINT AS fold
  UNION ALL SELECT o.i, list_transform(range(len(g.load)), lambda j: CASE WHEN j + 1 = list_position(g.load, list_min(g.load)) THEN g.load[j + 1] + o.weight ELSE g.load[j + 1] END), list_position(g.load, list_min(g.load)) - 1
  FROM g_{mode} g JOIN o_{mode} o ON o.i = g.i + 1),
a_{mode} AS (SELECT o.unit, o.weight, g.fold::INTEGER AS fold, len(g.load)::INTEGER AS effective_folds, CASE WHEN o.n >= 5 THEN 'READY' ELSE 'LIMITED' END AS status FROM o_{mode} o JOIN g_{mode} g USING (i) WHERE len(g.load) >= 2)"""


def artifact_chain() -> str:
    shown = lambda *fields: " || ".join(f"coalesce(length(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields)
    whole = lambda f, n: f"round({f} * 1e{n})::BIGINT"
    kinds = {  # rows, the fields that stay, the one that is edited, and as what
        "votes": ("v", ["user_id", "k"], "vote", "CASE WHEN user_id % 50 = 7 THEN 'tie' ELSE vote END"),
        "pairs": ("p", ["k", "candidate1", "candidate2", "abstain"], "tie", "tie + (k % 10 = 3)::INT"),
        "weights": ("w", ["k"], whole("weight", 6), f"{whole('weight', 6)} + (k % 10 = 4)::INT"),
        "folds": ("a_family", ["unit"], "fold", "fold + (unit = '0')::INT"),
        "ranker": ("m", ["axis", whole("w0", 3), whole("w1", 3)], whole("w2", 3), f"{whole('w2', 3)} + (axis = 'x')::INT"),
        "losses": ("ll", ["model", "eligible_pairs", whole("winner_accuracy", 4)], "winner_pairs", "winner_pairs + (model = 'zero')::INT"),
    }
    digest = lambda t: "sha256(concat_ws('|', count(*), " + ", ".join(f"coalesce(sum(('0x' || substr(sha256({t}), {at}, 15))::BIGINT), 0)" for at in (1, 16, 31, 46)) + "))"
    each = " UNION ALL ".join(f"SELECT {i} AS level, '{kind}' AS kind, {digest(shown(*keep, a))} AS own, {digest(shown(*keep, b))} AS other FROM {rows}" for i, (kind, (rows, keep, a, b)) in enumerate(kinds.items()))
    edits = ", ".join(f"('{k}')" for k in [*kinds, "none"])
    link = lambda own: f"sha256({{below}} || '|' || z.kind || '|' || {own})"
    now = "CASE WHEN z.edit = z.kind THEN z.other ELSE z.own END"
    return f"""WITH RECURSIVE {B}, {folds('family')}, {descent("SELECT axis, x0, x1, x2, target, weight FROM x WHERE eligible", "axis")}, ll AS ({LOSSES.format(keys="", d=6, rows="l")}),
        d AS MATERIALIZED ({each}), z AS MATERIALIZED (SELECT d.*, e.edit FROM d, (VALUES {edits}) e(edit)),
        s AS (SELECT level, kind, edit, {link('z.own').format(below="''")} AS seal, {link(now).format(below="''")} AS found, own <> {now} AS bad FROM z WHERE level = 0
          UNION ALL SELECT z.level, z.kind, z.edit, {link('z.own').format(below='s.seal')}, {link(now).format(below='s.found')}, z.own <> {now} FROM s JOIN z ON z.edit = s.edit AND z.level = s.level + 1)
        SELECT edit, level::INTEGER AS level, kind, CASE WHEN bad THEN 'edited' WHEN seal <> found THEN 'rests-on-edited' ELSE 'whole' END AS status,
          max(kind) FILTER (WHERE bad) OVER (PARTITION BY edit) AS first_edited, seal FROM s"""


def descent(examples: str, keys: str) -> str:
    """1,500 steps of gradient descent; examples has keys, x0, x1, x2, target, weight."""
    on = " AND ".join(f"e.{k} = g.{k}" for k in keys.split(", "))
    gk = ", ".join(f"g.{k}" for k in keys.split(", "))
    step = lambda i: f"g.w{i} - 0.15 * (sum(e.weight * (1 / (1 + exp(-(g.w0 * e.x0 + g.w1 * e.x1 + g.w2 * e.x2))) - e.target) * e.x{i}) / sum(e.weight) + 0.01 * g.w{i})"
    return f"""e AS ({examples}),
ok AS (SELECT {keys} FROM e GROUP BY {keys} HAVING count(*) >= 5 AND (max(x0) - min(x0) >= 1e-12 OR max(x1) - min(x1) >= 1e-12 OR max(x2) - min(x2) >= 1e-12)),
g AS (SELECT {keys}, 0 AS it, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM ok
  UNION ALL SELECT {gk}, g.it + 1, {step(0)}, {step(1)}, {step(2)} FROM g JOIN e ON {on} WHERE g.it < 1500 GROUP BY {gk}, g.it, g.w0, g.w1, g.w2),
m AS (SELECT * FROM g WHERE it = 1500)"""


def held_out(mode: str) -> str:
    unit = "family_no::VARCHAR" if mode == "family" else "family_no || '/' || group_no"
    return f"SELECT '{mode}' AS mode, x.*, a.fold FROM x JOIN a_{mode} a ON a.unit = {unit} WHERE eligible"


OOF = "WITH RECURSIVE " + X.lstrip() + ",\n" + folds("family") + ",\n" + folds("group") + f""",
r AS ({held_out('family')} UNION ALL {held_out('group')}),
""" + descent("SELECT r.mode, h.fold AS held, r.axis, r.x0, r.x1, r.x2, r.target, r.weight FROM r JOIN (SELECT DISTINCT mode, fold FROM r) h ON h.mode = r.mode AND h.fold <> r.fold", "mode, held, axis") + """,
s AS (SELECT r.mode, r.target, r.weight, 1 / (1 + exp(-(m.w0 * x0 + m.w1 * x1 + m.w2 * x2))) AS learned, 1 / (1 + exp(-x0)) AS zero, 1 / (1 + exp(-(x0 + x1))) AS centroid FROM r LEFT JOIN m ON m.mode = r.mode AND m.held = r.fold AND m.axis = r.axis),
l AS (SELECT mode, target, weight, 'learned' AS model, learned AS p FROM s WHERE learned IS NOT NULL UNION ALL SELECT mode, target, weight, 'zero', zero FROM s WHERE learned IS NOT NULL UNION ALL SELECT mode, target, weight, 'centroid', centroid FROM s WHERE learned IS NOT NULL)
"""

# --- holdout
H0 = """
k AS (SELECT p_partkey AS case_id, p_brand AS family, p_type AS grp, regexp_extract(p_brand, '(\\d+)', 1)::INTEGER AS brand_no, p_size, p_size % 11 = 0 AS quiet,
        0.0::DOUBLE AS zero, CAST((p_size % 5 - 2) / 2 AS DOUBLE) AS centroid, CASE WHEN p_size % 11 <> 0 THEN CAST((p_size % 7 - 3) / 2 AS DOUBLE) END AS ensemble, CASE WHEN p_size % 11 <> 0 THEN CAST((p_size % 9 - 4) / 2 AS DOUBLE) END AS learned FROM part),
h AS (SELECT * FROM k WHERE brand_no > 10)"""
H = H0 + """,
t0 AS (SELECT case_id, family, grp, learned, b.baseline, CASE b.baseline WHEN 'zero' THEN zero WHEN 'centroid' THEN centroid ELSE ensemble END AS other FROM h, (VALUES ('zero'), ('centroid'), ('ensemble')) b(baseline)),
t1 AS (SELECT *, round(learned * 100)::BIGINT::VARCHAR AS l, round(other * 100)::BIGINT::VARCHAR AS o FROM t0 WHERE learned IS NOT NULL AND other IS NOT NULL AND learned <> other),
t2 AS (SELECT *, sha256('trial|' || array_to_string(list_sort([case_id || ':' || baseline, l, o]), '|')) AS trial_id FROM t1),
t AS (SELECT *, substr(sha256('panel:' || trial_id), 8, 1) IN ('1','3','5','7','9','b','d','f') AS flipped FROM t2),
lv AS (SELECT l_partkey AS case_id, l_suppkey AS rater, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'B' WHEN l_linestatus = 'O' THEN 'TIE' ELSE 'ABSTAIN' END AS choice
       FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1),
j AS (SELECT t.*, rater, CASE WHEN choice IN ('A', 'B') THEN CASE WHEN (choice = 'A') <> flipped THEN 'win' ELSE 'loss' END ELSE lower(choice) END AS result FROM t JOIN lv USING (case_id))"""
HH = H + """,
hh AS (SELECT baseline, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'tie') AS ties, count(*) FILTER (WHERE result = 'abstain') AS cannot_judge FROM j GROUP BY baseline),
fm AS (SELECT baseline, count(*) AS represented_families, round(round(avg(r), 8), 6) AS family_macro FROM (SELECT baseline, family, count(*) FILTER (WHERE result = 'win') / count(*) AS r FROM j WHERE result IN ('win', 'loss') GROUP BY baseline, family) GROUP BY baseline),
sv AS (SELECT baseline, count(*) FILTER (WHERE n >= 5) AS sources FROM (SELECT baseline, case_id, count(*) AS n FROM j WHERE result IN ('win', 'loss') GROUP BY ALL) GROUP BY baseline),
pc AS (SELECT policy, count(v) AS value_cases, count(*) - count(v) AS abstain_cases, round(round(count(v) / count(*), 8), 6) AS coverage FROM (SELECT 'zero' AS policy, zero AS v FROM h UNION ALL SELECT 'centroid', centroid FROM h UNION ALL SELECT 'ensemble', ensemble FROM h UNION ALL SELECT 'learned', learned FROM h) GROUP BY policy),
hz AS (SELECT p_partkey AS case_id, z.kind, CASE WHEN p_size <= 5 THEN 'VALUE' ELSE 'ABSTAIN' END AS status FROM part JOIN (VALUES (0, 'active-content'), (1, 'clipped'), (2, 'detached'), (3, 'empty'), (4, 'filtered'), (5, 'masked'), (6, 'text-only'), (7, 'unstable-signals')) z(i, kind) ON p_partkey = z.i)"""
WILSON = "({p} + 1.959963984540054 * 1.959963984540054 / (2 * {n}) - 1.959963984540054 * sqrt(({p} * (1 - {p}) + 1.959963984540054 * 1.959963984540054 / (4 * {n})) / {n})) / (1 + 1.959963984540054 * 1.959963984540054 / {n})"
GATES = HH + """,
ev AS (SELECT (SELECT count(DISTINCT case_id) FROM h) AS s, (SELECT count(DISTINCT family) FROM h) AS f, (SELECT count(DISTINCT family || '/' || grp) FROM h) AS g, (SELECT min(n) FROM (SELECT trial_id, count(DISTINCT rater) AS n FROM j GROUP BY trial_id)) AS r),
bb AS (SELECT b.baseline, wins + losses AS n, wins / (wins + losses) AS p, represented_families, family_macro, sources FROM (VALUES ('zero'), ('centroid'), ('ensemble')) b(baseline) LEFT JOIN hh USING (baseline) LEFT JOIN fm USING (baseline) LEFT JOIN sv USING (baseline)),
gt AS (SELECT 'at-least-40-holdout-sources' AS code, 'evidence' AS kind, coalesce(s >= 40, false) AS passed FROM ev UNION ALL SELECT 'at-least-6-holdout-families', 'evidence', coalesce(f >= 6, false) FROM ev
  UNION ALL SELECT 'at-least-8-holdout-groups', 'evidence', coalesce(g >= 8, false) FROM ev UNION ALL SELECT 'at-least-5-raters-per-distinct-pair', 'evidence', coalesce(r >= 5, false) FROM ev
  UNION ALL SELECT baseline || '-at-least-120-decisive-votes', 'evidence', coalesce(n >= 120, false) FROM bb UNION ALL SELECT baseline || '-at-least-40-sources-with-5-decisive-votes', 'evidence', coalesce(sources >= 40, false) FROM bb
  UNION ALL SELECT baseline || '-at-least-5-families', 'evidence', coalesce(represented_families >= 5, false) FROM bb UNION ALL SELECT baseline || '-win-rate-over-half', 'preference', coalesce(p > 0.5, false) FROM bb
  UNION ALL SELECT baseline || '-wilson-lower-over-half', 'preference', coalesce(""" + WILSON.format(p="p", n="n") + """ > 0.5, false) FROM bb UNION ALL SELECT baseline || '-family-macro-over-half', 'preference', coalesce(family_macro > 0.5, false) FROM bb
  UNION ALL SELECT 'learned-coverage-not-below-ensemble', 'preference', (SELECT coverage FROM pc WHERE policy = 'learned') >= (SELECT coverage FROM pc WHERE policy = 'ensemble')
  UNION ALL SELECT 'hazard-suite-pass', 'preference', (SELECT count(*) FROM hz WHERE status <> 'ABSTAIN') = 0)"""

# --- adaptive
CAND = F + ", cd AS (SELECT DISTINCT axis, left_pct AS value FROM v UNION SELECT DISTINCT axis, right_pct FROM v)"
PROB = lambda mu, tie, t: (f"1 / (1 + exp(-((abs({mu} - b) - abs({mu} - a)) - {tie}) / {t}))", f"1 / (1 + exp(-(-(abs({mu} - b) - abs({mu} - a)) - {tie}) / {t}))")


def like(mu: str, tie: str = "0.2::DOUBLE", t: str = "0.35::DOUBLE") -> str:
    pa, pb = PROB(mu, tie, t)
    return f"CASE choice WHEN 'A' THEN {pa} WHEN 'B' THEN {pb} WHEN 'TIE' THEN greatest(1e-12, 1 - {pa} - {pb}) END"


N = F + ", n AS (SELECT axis, a, b, choice, count(*) AS n FROM v WHERE choice <> 'ABSTAIN' GROUP BY ALL)"
GRID = ", gr AS (SELECT i::INTEGER AS i, i::DOUBLE / 10 - 5 AS mu FROM range(101) z(i))"
POST = N + GRID + f""",
lg AS (SELECT axis, i, mu, sum(n * ln({like('mu')})) AS l FROM n, gr GROUP BY ALL),
pe AS (SELECT *, exp(l - max(l) OVER (PARTITION BY axis)) AS e FROM lg),
po AS (SELECT axis, i, mu, e / sum(e) OVER (PARTITION BY axis) AS p FROM pe)"""
POOL = """,
pl0 AS (SELECT x.axis, x.value AS low, y.value AS high, s.size, t.theme FROM cd x JOIN cd y ON x.axis = y.axis AND x.value < y.value, (VALUES (16), (24)) s(size), (VALUES ('light'), ('dark')) t(theme)),
pl1 AS (SELECT *, sha256('adaptive|' || array_to_string(list_sort([axis || ':' || size || ':' || theme, round(low * 100)::BIGINT::VARCHAR, round(high * 100)::BIGINT::VARCHAR]), '|')) AS trial_id FROM pl0),
pl2 AS (SELECT *, substr(sha256('panel:' || trial_id), 8, 1) IN ('1','3','5','7','9','b','d','f') AS flip FROM pl1),
pl AS (SELECT trial_id, axis, size, theme, CASE WHEN flip THEN high ELSE low END AS a, CASE WHEN flip THEN low ELSE high END AS b, sha256('panel:acquisition:' || trial_id) AS tie_break FROM pl2)"""
#: The policy as a recursive query: a row is a rater's study after so many answers, with both posteriors as lists over the
#: grid and the places of the trials that were shown. Each round scores what a rater hasn't seen and applies the next answer.
REPLAY = f"""RECURSIVE {CAND}{POOL},
gm AS (SELECT list(-5 + i / 10::DOUBLE ORDER BY i) AS mu FROM range(101) r(i)),
lp AS (SELECT pl.*, row_number() OVER (ORDER BY trial_id) AS place, size || theme AS cond, mu,
  list_transform(mu, lambda m: 1 / (1 + exp(-(abs(m - b) - abs(m - a) - 0.2) / 0.35))) AS pa, list_transform(mu, lambda m: 1 / (1 + exp(-(abs(m - a) - abs(m - b) - 0.2) / 0.35))) AS pb FROM pl, gm),
lt AS (SELECT *, list_transform(range(1, 102), lambda i: greatest(1e-12, 1 - pa[i] - pb[i])) AS pt FROM lp),
q AS (SELECT *, list_transform(range(1, 102), lambda i: -(pa[i] * ln(pa[i]) + pb[i] * ln(pb[i]) + pt[i] * ln(pt[i]))) AS inside FROM lt),
cn AS (SELECT list(cond ORDER BY place) AS conds FROM q),
an AS (SELECT * FROM (SELECT 'u' || user_id AS rater, choice, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM v) WHERE n < 16),
rs AS (
  SELECT rater, 0::BIGINT AS n, list_transform(range(101), lambda i: 1 / 101::DOUBLE) AS px, list_transform(range(101), lambda i: 1 / 101::DOUBLE) AS py, []::BIGINT[] AS used, NULL::BIGINT AS place, NULL::VARCHAR AS choice FROM (SELECT DISTINCT rater FROM an)
  UNION ALL SELECT rater, n + 1,
    CASE WHEN axis = 'x' AND choice <> 'ABSTAIN' THEN list_transform(range(1, 102), lambda i: px[i] * seen[i] / list_dot_product(px, seen)) ELSE px END,
    CASE WHEN axis = 'y' AND choice <> 'ABSTAIN' THEN list_transform(range(1, 102), lambda i: py[i] * seen[i] / list_dot_product(py, seen)) ELSE py END,
    list_append(used, place), place, choice
  FROM (SELECT ch.*, q.axis, CASE WHEN choice = 'TIE' THEN pt WHEN choice = 'A' THEN CASE WHEN n = 15 THEN pb ELSE pa END WHEN choice = 'B' THEN CASE WHEN n = 15 THEN pa ELSE pb END ELSE px END AS seen
    FROM (SELECT rater, any_value(n) AS n, any_value(px) AS px, any_value(py) AS py, any_value(used) AS used, any_value(choice) AS choice,
        CASE WHEN any_value(n) = 15 THEN any_value(used)[1] ELSE first(place ORDER BY round(-(da * ln(da) + db * ln(db) + dt * ln(dt)) - di - often * 0.003 - abs((a + b) / 2 - mean) * 0.02, 12) DESC, tie_break) END AS place
      FROM (SELECT s.rater, s.n, s.px, s.py, s.used, an.choice, q.place, q.a, q.b, q.tie_break, list_dot_product(CASE q.axis WHEN 'x' THEN px ELSE py END, q.pa) AS da, list_dot_product(CASE q.axis WHEN 'x' THEN px ELSE py END, q.pb) AS db,
          list_dot_product(CASE q.axis WHEN 'x' THEN px ELSE py END, q.pt) AS dt, list_dot_product(CASE q.axis WHEN 'x' THEN px ELSE py END, q.inside) AS di, list_dot_product(CASE q.axis WHEN 'x' THEN px ELSE py END, q.mu) AS mean,
          len(list_filter(s.used, lambda u: conds[u] = q.cond)) AS often
        FROM rs s JOIN an ON an.rater = s.rater AND an.n = s.n, q, cn WHERE NOT list_contains(s.used, q.place)) GROUP BY rater) ch JOIN q ON q.place = ch.place)),
rp AS MATERIALIZED (SELECT rs.rater, rs.n - 1 AS step, CASE WHEN rs.n = 16 THEN sha256('repeat:panel:' || trial_id) ELSE trial_id END AS trial_id, CASE WHEN rs.n = 16 THEN trial_id END AS repeat_of, axis,
  CASE WHEN rs.n = 16 THEN b ELSE a END AS a, CASE WHEN rs.n = 16 THEN a ELSE b END AS b, rs.choice FROM rs JOIN q ON q.place = rs.place)"""
SEARCH = N + f""",
ls AS (SELECT axis, m, w, sum(-n * ln(greatest(1e-12, {like('(m * 0.05::DOUBLE - 5)', '(w * 0.05::DOUBLE)', '0.25::DOUBLE')}))) AS loss FROM n, range(201) z(m), range(31) y(w) GROUP BY ALL)"""
TERM = lambda q: f"CASE WHEN {q} > 0 THEN {q} * ln({q}) ELSE 0 END"

# --- rasters
R = """
r AS (SELECT vec_id, (i - 1)::INTEGER AS i, ((i - 1) % 8)::INTEGER AS x, ((i - 1) // 8)::INTEGER AS y, coalesce(least(255, floor(abs(embedding[i]::DOUBLE) * 510)), 0)::INTEGER AS v FROM embeddings, range(1, 65) z(i))"""


def hull(t: int) -> str:
    """A side of the hull leaves every other point on its left or between its ends; only ends of pixel rows can be corners."""
    return f"""WITH c AS (SELECT vec_id, x + 0.5::DOUBLE AS x, y + 0.5::DOUBLE AS y FROM (SELECT vec_id, min(x) AS x, y FROM r WHERE v > {t} GROUP BY vec_id, y UNION SELECT vec_id, max(x), y FROM r WHERE v > {t} GROUP BY vec_id, y)),
        pq AS (SELECT p.vec_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM c p JOIN c q ON p.vec_id = q.vec_id AND (p.x <> q.x OR p.y <> q.y)),
        t AS (SELECT pq.*, (qx - px) * (c.y - py) - (qy - py) * (c.x - px) AS turn, (c.x - px) * (c.x - qx) + (c.y - py) * (c.y - qy) AS beyond FROM pq JOIN c ON pq.vec_id = c.vec_id),
        s AS (SELECT vec_id, px * qy - qx * py AS z, px + qx AS sx, py + qy AS sy FROM t GROUP BY vec_id, px, py, qx, qy HAVING NOT bool_or(turn < 0 OR turn = 0 AND beyond > 0)),
        a AS (SELECT vec_id, sum(z) AS z, sum(sx * z) AS mx, sum(sy * z) AS my FROM s GROUP BY vec_id HAVING abs(sum(z)) >= 1e-9)
        SELECT e.vec_id, mx / (3 * z) AS x, my / (3 * z) AS y FROM embeddings e LEFT JOIN a ON a.vec_id = e.vec_id"""


def centre(t: int) -> str:
    return f"SELECT vec_id, sum(v * (x + 0.5::DOUBLE)) FILTER (WHERE v > {t}) / nullif(sum(v) FILTER (WHERE v > {t}), 0) AS x, sum(v * (y + 0.5::DOUBLE)) FILTER (WHERE v > {t}) / nullif(sum(v) FILTER (WHERE v > {t}), 0) AS y FROM r GROUP BY vec_id"


EDGE = R + """,
nb AS (SELECT c.vec_id, c.x, c.y, c.v, abs(c.v - coalesce(l.v, 0)) + abs(c.v - coalesce(q.v, 0)) + abs(c.v - coalesce(u.v, 0)) + abs(c.v - coalesce(d.v, 0)) AS e FROM r c
  LEFT JOIN r l ON l.vec_id = c.vec_id AND l.y = c.y AND l.x = c.x - 1 LEFT JOIN r q ON q.vec_id = c.vec_id AND q.y = c.y AND q.x = c.x + 1
  LEFT JOIN r u ON u.vec_id = c.vec_id AND u.x = c.x AND u.y = c.y - 1 LEFT JOIN r d ON d.vec_id = c.vec_id AND d.x = c.x AND d.y = c.y + 1 WHERE c.v > 1),
ec AS (SELECT vec_id, sum(e) AS edge_sum, sum(e * (x + 0.5::DOUBLE)) / nullif(sum(e), 0) AS x, sum(e * (y + 0.5::DOUBLE)) / nullif(sum(e), 0) AS y FROM nb GROUP BY vec_id)"""
SYM = """,
pf AS (SELECT vec_id, 'x' AS axis, x AS place, sum(CASE WHEN v > 1 THEN v ELSE 0 END) AS v FROM r GROUP BY ALL UNION ALL SELECT vec_id, 'y', y, sum(CASE WHEN v > 1 THEN v ELSE 0 END) FROM r GROUP BY ALL),
er AS (SELECT p.vec_id, p.axis, z.a, sum(abs(p.v - coalesce(q.v, 0))) AS e, sum(p.v) AS t FROM pf p CROSS JOIN range(1, 16) z(a) LEFT JOIN pf q ON q.vec_id = p.vec_id AND q.axis = p.axis AND q.place = z.a - p.place - 1 GROUP BY ALL),
sy AS (SELECT vec_id, axis, CASE WHEN t > 0 THEN a END AS axis2, CASE WHEN t > 0 THEN round(greatest(0, 1 - e / (2 * t)), 6) END AS score FROM er QUALIFY row_number() OVER (PARTITION BY vec_id, axis ORDER BY e, abs(a - 8), a) = 1)"""

ROUND6 = "round({}, 6) AS {}"


def oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["contract_violations"] = f"WITH {F} SELECT CASE WHEN choice IS NULL THEN 'choice-invalid' ELSE 'none' END AS code, count(*) AS n FROM f GROUP BY ALL"
    o["closed_schema"] = "SELECT (len(json_keys(props)) - CASE WHEN list_contains(json_keys(props), 'k') THEN 1 ELSE 0 END)::INTEGER AS unknown, CASE WHEN list_contains(json_keys(props), 'k') THEN 0 ELSE 1 END AS missing, count(*) AS n FROM events GROUP BY ALL"
    o["forbidden_keys"] = "SELECT z.name, count(*) FILTER (WHERE props LIKE '%\"' || z.name || '\":%') AS n FROM events, (VALUES ('k'), ('raterId'), ('approved'), ('accuracy')) z(name) GROUP BY z.name"
    o["content_ids"] = "SELECT sha256(coalesce(text, '')) AS content_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1"
    fd = lambda rel, a, b: f"SELECT '{a}->{b}' AS dependency, count(*) AS n_values, count(*) FILTER (WHERE n > 1) AS n_conflicts FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM {rel} GROUP BY {a})"
    part = "(SELECT p_brand AS family, p_type AS \"group\" FROM part)"
    o["fd_conflicts"] = f"WITH {F} " + " UNION ALL ".join([fd("f", "k", "source_no"), fd("f", "source_no", "k"), fd("f", "source_no", "family_no"), fd("f", "family_no", "source_no"), fd(part, "family", '"group"').replace("'family->\"group\"'", "'family->group'"), fd(part, '"group"', "family").replace("'\"group\"->family'", "'group->family'")])
    o["artifact_revalidation"] = f"WITH {P} SELECT s.side, count(*) FILTER (WHERE k % 10 = 3) AS n FROM p, (VALUES ('stored'), ('recomputed')) s(side) GROUP BY s.side HAVING count(*) FILTER (WHERE k % 10 = 3) > 0"
    o["artifact_chain"] = artifact_chain()
    o["exact_rounding"] = "SELECT p_partkey, round(p_retailprice / 7, 4) AS seventh, round(-p_retailprice / 3, 6) AS third FROM part"
    o["duplicate_votes"] = f"WITH {F} SELECT user_id, k, count(*) AS n_votes FROM vv GROUP BY ALL HAVING count(*) > 1"
    o["pair_votes"] = f"""WITH {P} SELECT k, source_no, family_no, group_no, axis, left_pct, right_pct, proposal_pct, candidate1, candidate2, tie, abstain, decisive, total,
        CASE WHEN NOT eligible THEN 'UNDERPOWERED' WHEN candidate1 <> candidate2 THEN 'WINNER' ELSE 'UNRESOLVED' END AS status, CASE WHEN eligible AND candidate1 > candidate2 THEN 'candidate1' WHEN eligible AND candidate1 < candidate2 THEN 'candidate2' END AS winner,
        CASE WHEN decisive > 0 THEN round(greatest(candidate1, candidate2) / decisive, 8) END AS majority_share, eligible, target FROM p"""
    o["sample_weights"] = f"WITH {W} SELECT k, source_no, axis, decisive, round(weight, 6) AS weight FROM w"
    o["weight_errors"] = f"WITH {W} SELECT count(*) AS n_errors FROM (SELECT sum(weight) AS s FROM w WHERE eligible GROUP BY source_no, axis) WHERE abs(s - 1) > 1e-8"
    stats = "SELECT sum(total)::BIGINT AS row_count, count(DISTINCT source_no) AS source_count, count(DISTINCT family_no) AS family_count, count(DISTINCT family_no || '/' || group_no) AS group_count, count(DISTINCT family_no) FILTER (WHERE eligible) AS eligible_family_count, count(DISTINCT family_no || '/' || group_no) FILTER (WHERE eligible) AS eligible_group_count, count(*) AS pair_count, count(*) FILTER (WHERE eligible) AS eligible_pairs, sum(tie)::BIGINT AS tie_votes, sum(abstain)::BIGINT AS abstain_votes FROM p"
    o["corpus_stats"] = f"WITH {P} {stats}"
    o["readiness_reasons"] = f"""WITH {P}, s AS ({stats}), q AS (SELECT array_to_string(list_filter([CASE WHEN eligible_family_count < 4 THEN 'fewer-than-4-eligible-families' END, CASE WHEN eligible_group_count < 4 THEN 'fewer-than-4-eligible-groups' END,
        CASE WHEN eligible_pairs < 20 THEN 'fewer-than-20-eligible-pairs' END, CASE WHEN eligible_family_count < 2 THEN 'family-holdout-unavailable' END, CASE WHEN eligible_group_count < 2 THEN 'group-holdout-unavailable' END], lambda z: z IS NOT NULL), ',') AS reasons FROM s)
        SELECT CASE WHEN reasons = '' OR reasons IS NULL THEN 'READY' ELSE 'UNDERPOWERED' END AS status, coalesce(reasons, '') AS reasons FROM q"""
    o["contributor_lists"] = f"WITH {P} SELECT (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source_no AS s FROM p WHERE eligible)) AS sources, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT family_no AS s FROM p WHERE eligible)) AS families, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT family_no || '/' || group_no AS s FROM p WHERE eligible)) AS groups"
    for name, cats in (("agreement_fourway", ("candidate1", "candidate2", "tie", "abstain")), ("agreement_decisive", ("candidate1", "candidate2"))):
        n, ch = " + ".join(cats), " + ".join(f"{c} * ({c} - 1) / 2" for c in cats)
        o[name] = f"""WITH {P}, a AS (SELECT sum(CASE WHEN {n} >= 2 THEN {ch} END) / sum(CASE WHEN {n} >= 2 THEN ({n}) * ({n} - 1) / 2 END) AS ob, {' + '.join(f'(sum({c}) / sum({n})) * (sum({c}) / sum({n}))' for c in cats)} AS ex, count(*) FILTER (WHERE {n} >= 2) AS rated_pairs FROM p)
        SELECT round(round(ob, 8), 6) AS observed, round(round(ex, 8), 6) AS expected, CASE WHEN ex <> 1 THEN round(round((ob - ex) / (1 - ex), 8), 6) END AS chance_corrected, rated_pairs FROM a"""
    for mode in ("family", "group"):
        o[f"fold_assignment_{mode}"] = f"WITH RECURSIVE {W}, {folds(mode)} SELECT unit, round(weight, 6) AS weight, fold, effective_folds, status FROM a_{mode}"
    o["pair_features"] = f"WITH {X} SELECT k, round(x0, 6) + 0 AS x0, round(x1, 6) + 0 AS x1, round(x2, 6) + 0 AS x2 FROM x"
    o["baseline_predictions"] = f"WITH {X} SELECT k, round(1 / (1 + exp(-x0)), 6) AS zero, round(1 / (1 + exp(-(x0 + x1))), 6) AS centroid FROM x"
    o["scored_losses"] = f"WITH {B} " + LOSSES.format(keys="", d=6, rows="l")
    o["risk_coverage"] = f"""WITH {B} SELECT model, threshold::DOUBLE AS threshold, round(sum(CASE WHEN greatest(p, 1 - p) >= threshold THEN weight ELSE 0 END) / sum(weight), 6) AS coverage,
        round(1 - sum(CASE WHEN greatest(p, 1 - p) >= threshold AND (p > 0.5) = (target > 0.5) THEN weight ELSE 0 END) / nullif(sum(CASE WHEN greatest(p, 1 - p) >= threshold THEN weight ELSE 0 END), 0), 6) AS risk FROM l, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) z(threshold) WHERE target <> 0.5 GROUP BY ALL"""
    o["ranker_weights"] = f"WITH RECURSIVE {X}, " + descent("SELECT axis, x0, x1, x2, target, weight FROM x WHERE eligible", "axis") + " SELECT axis, round(w0, 5) AS w0, round(w1, 5) AS w1, round(w2, 5) AS w2 FROM m"
    o["oof_metrics"] = OOF + LOSSES.format(keys="mode,", d=4, rows="l")
    o["promotion_flag"] = OOF + """, q AS (""" + LOSSES.format(keys="mode,", d=12, rows="l") + """), fam AS (SELECT * FROM q WHERE mode = 'family'),
        z AS (SELECT (SELECT winner_pairs FROM fam WHERE model = 'learned') >= 10 AND (SELECT count(learned) = count(*) FROM s WHERE mode = 'family') AND (SELECT winner_accuracy FROM fam WHERE model = 'learned') > (SELECT max(winner_accuracy) FROM fam WHERE model <> 'learned')
          AND (SELECT log_loss FROM fam WHERE model = 'learned') < (SELECT min(log_loss) FROM fam WHERE model <> 'learned') AND (SELECT count(DISTINCT family_no) FROM p WHERE eligible) >= 5 AS ok)
        SELECT coalesce(ok, false) AS recommended, CASE WHEN ok THEN 'PROMISING' ELSE 'BASELINE_NOT_BEATEN' END AS status FROM z"""
    over = lambda rel, variant: " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n, '{variant}' AS variant FROM {rel} WHERE {key} IN (SELECT {key} FROM k WHERE brand_no <= 10)" for kind, key in (("source", "case_id"), ("family", "family"), ("group", "family || '/' || grp")))
    o["training_overlap"] = f"WITH {H0} {over('h', 'disjoint')} UNION ALL {over('k', 'overlapping')}"
    o["output_contracts"] = "SELECT 'none' AS code, (4 * count(*))::BIGINT AS n FROM part"
    o["holdout_trials"] = f"WITH {H} SELECT case_id, baseline, learned AS learned_percent, other AS other_percent, trial_id, flipped FROM t"
    b36 = "CASE WHEN {n} // {p} > 0 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', (({n} // {p}) % 36)::INTEGER + 1, 1) ELSE '' END"
    o["blinded_trials"] = f"WITH {H}, q AS (SELECT trial_id, row_number() OVER (ORDER BY trial_id) AS n FROM t) SELECT 'q-' || {' || '.join(b36.format(n='n', p=36**e) for e in (5, 4, 3, 2, 1, 0))} AS participant_id, sha256('image|' || trial_id || '|A') AS image_a, sha256('image|' || trial_id || '|B') AS image_b FROM q"
    o["distinct_outputs"] = f"WITH {H} SELECT baseline, count(DISTINCT case_id) FILTER (WHERE learned <> other) AS distinct_cases, count(DISTINCT case_id) FILTER (WHERE learned = other) AS identical_cases FROM t0 WHERE learned IS NOT NULL AND other IS NOT NULL GROUP BY baseline"
    o["head_to_head"] = f"WITH {HH} SELECT *, wins + losses AS decisive, round(round(wins / nullif(wins + losses, 0), 8), 6) AS win_rate FROM hh"
    o["wilson_bounds"] = f"WITH {H}, q AS (SELECT baseline, family, count(*) FILTER (WHERE result = 'win') AS w, count(*) FILTER (WHERE result IN ('win', 'loss')) AS n FROM j GROUP BY ALL) SELECT baseline, family, n AS decisive, CASE WHEN n > 0 THEN round(round({WILSON.format(p='(w / n)', n='n')}, 8), 6) END AS wilson_lower FROM q"
    o["family_macro"] = f"WITH {HH} SELECT * FROM fm"
    o["sources_with_votes"] = f"WITH {HH} SELECT * FROM sv"
    o["policy_coverage"] = f"WITH {HH} SELECT * FROM pc"
    o["hazard_failures"] = f"WITH {HH} SELECT case_id, kind, status FROM hz WHERE status <> 'ABSTAIN'"
    o["promotion_gate"] = f"WITH {GATES} SELECT * FROM gt"
    o["gate_status"] = f"WITH {GATES} SELECT CASE WHEN NOT bool_and(passed) FILTER (WHERE kind = 'evidence') THEN 'UNDERPOWERED' WHEN NOT bool_and(passed) THEN 'BASELINE_NOT_BEATEN' ELSE 'PROMISING' END AS status, count(*) FILTER (WHERE NOT passed) AS failed FROM gt"
    o["region_rollup"] = f"WITH {H} SELECT r_name, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, round(count(*) FILTER (WHERE result = 'win') / nullif(count(*) FILTER (WHERE result IN ('win', 'loss')), 0), 6) AS win_rate FROM j JOIN supplier ON s_suppkey = rater JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE baseline = 'zero' GROUP BY r_name"
    o["missing_responses"] = f"WITH {F}, q AS (SELECT user_id, k, count(*) AS n FROM vv GROUP BY ALL) SELECT user_id, count(*) AS answered, 100 - count(*) AS missing, 0::BIGINT AS unknown, count(*) FILTER (WHERE n > 1) AS repeated FROM q GROUP BY user_id"
    o["candidate_grid"] = f"WITH {F} SELECT DISTINCT source_no, round(value, 6)::DOUBLE + 0 AS value FROM (SELECT DISTINCT source_no, proposal_pct FROM v), LATERAL (SELECT unnest([-1.0, -0.9, -0.6, -0.3, 0.0, 0.3, 0.6, 0.9, 1.0, proposal_pct]) AS value)"
    o["adjacent_trials"] = "WITH q AS (" + o["candidate_grid"] + "), a AS (SELECT source_no, value AS lower, lead(value) OVER (PARTITION BY source_no ORDER BY value) AS upper FROM q), i AS (SELECT *, sha256('fixed|' || array_to_string(list_sort([source_no::VARCHAR, round(lower * 1000000)::BIGINT::VARCHAR, round(upper * 1000000)::BIGINT::VARCHAR]), '|')) AS trial_id FROM a WHERE upper IS NOT NULL) SELECT *, substr(sha256('panel:' || trial_id), 8, 1) IN ('1','3','5','7','9','b','d','f') AS flipped FROM i"
    o["trial_pool"] = f"WITH {CAND}{POOL} SELECT * FROM pl"
    o["choice_likelihood"] = f"WITH {N} SELECT axis, a, b, choice, n, round({like('0.0::DOUBLE')}, 6) AS p FROM n"
    o["axis_posterior"] = f"WITH {POST} SELECT axis, i, round(p, 6) AS p FROM po"
    o["running_posterior"] = f"""WITH {F}{GRID}, st AS (SELECT *, row_number() OVER (PARTITION BY user_id, axis ORDER BY ts, event_id) AS step FROM v WHERE choice <> 'ABSTAIN'),
        cu AS (SELECT user_id, axis, step, mu, sum(ln({like('mu')})) OVER (PARTITION BY user_id, axis, i ORDER BY step) AS l FROM st, gr), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY user_id, axis, step)) AS e FROM cu), p AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id, axis, step) AS p FROM e)
        SELECT user_id, axis, step::INTEGER AS step, round(sum(p * mu), 5) AS mean, round(-sum({TERM('p')}), 5) AS entropy FROM p GROUP BY user_id, axis, step"""
    pa, pb = PROB("mu", "0.2::DOUBLE", "0.35::DOUBLE")
    o["information_topk"] = f"""WITH {POST}, cd AS (SELECT DISTINCT axis, left_pct AS value FROM v UNION SELECT DISTINCT axis, right_pct FROM v){POOL}, sn AS (SELECT size, theme, count(DISTINCT user_id) AS n FROM v GROUP BY ALL),
        q AS (SELECT pl.*, mu, p, {pa} AS pa, {pb} AS pb FROM pl JOIN po USING (axis)), q2 AS (SELECT *, greatest(1e-12, 1 - pa - pb) AS pt FROM q),
        s AS (SELECT trial_id, axis, size, theme, a, b, tie_break, sum(p * pa) AS ea, sum(p * pb) AS eb, sum(p * pt) AS et, sum(p * -({TERM('pa')} + {TERM('pb')} + {TERM('pt')})) AS inn, sum(p * mu) AS mean FROM q2 GROUP BY ALL),
        z AS (SELECT s.*, round(-({TERM('ea')} + {TERM('eb')} + {TERM('et')}) - inn - coalesce(n, 0) * 0.003::DOUBLE - abs((a + b) / 2 - mean) * 0.02::DOUBLE, 9) AS score FROM s LEFT JOIN sn USING (size, theme))
        SELECT axis, rank::INTEGER AS rank, trial_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY score DESC, tie_break) AS rank FROM z) WHERE rank <= 3"""
    o["condition_counts"] = f"WITH {F} SELECT event_id, user_id, size, theme, count(*) OVER (PARTITION BY user_id, size, theme ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v"
    o["ideal_point"] = f"WITH {SEARCH} SELECT axis, round(m * 0.05::DOUBLE - 5, 4) + 0 AS ideal_percent, round(w * 0.05::DOUBLE, 4) AS indifference_percent, round(loss, 4) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY round(loss, 8), abs(m - 100), m, w) AS r FROM ls) WHERE r = 1"
    o["ideal_interval"] = f"WITH {SEARCH}, q AS (SELECT *, exp(min(loss) OVER (PARTITION BY axis) - loss) AS e FROM ls), b AS (SELECT axis, m, sum(e) AS e FROM q GROUP BY ALL), c AS (SELECT *, sum(e) OVER (PARTITION BY axis ORDER BY m) AS c, sum(e) OVER (PARTITION BY axis) AS t FROM b) SELECT axis, round(min(m) FILTER (WHERE c >= 0.025::DOUBLE * t) * 0.05::DOUBLE - 5, 4) + 0 AS low, round(min(m) FILTER (WHERE c >= 0.975::DOUBLE * t) * 0.05::DOUBLE - 5, 4) + 0 AS high FROM c GROUP BY axis"
    o["adaptive_replay"] = f"WITH {REPLAY} SELECT rater, step::INTEGER AS step, trial_id, repeat_of, axis, a, b, choice FROM rp"
    o["sequence_check"] = "SELECT conv_id, count(*) AS length, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous, count(*) >= 5 AS long_enough, arg_max(role, turn) IS NOT DISTINCT FROM arg_min(role, turn) AS closed FROM conversations GROUP BY conv_id"
    o["repeat_reliability"] = f"WITH {F}, q AS (SELECT vote, first_value(vote) OVER w AS f, row_number() OVER w AS r FROM vv WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)) SELECT count(*) AS repeats, count(*) FILTER (WHERE vote = f) AS consistent, round(count(*) FILTER (WHERE vote = f) / nullif(count(*), 0), 6) AS rate FROM q WHERE r > 1"
    o["raster_bounds"] = f"""WITH {R}, q AS (SELECT vec_id, count(*) FILTER (WHERE v > 64)::INTEGER AS painted_pixels, coalesce(sum(v) FILTER (WHERE v > 64), 0)::BIGINT AS alpha_sum, min(x) FILTER (WHERE v > 64) AS min_x, max(x) FILTER (WHERE v > 64) AS max_x, min(y) FILTER (WHERE v > 64) AS min_y, max(y) FILTER (WHERE v > 64) AS max_y FROM r GROUP BY vec_id)
        SELECT *, concat_ws(',', CASE WHEN min_x = 0 THEN 'left' END, CASE WHEN max_x = 7 THEN 'right' END, CASE WHEN min_y = 0 THEN 'top' END, CASE WHEN max_y = 7 THEN 'bottom' END) AS touches FROM q"""
    o["alpha_centroid"] = f"WITH {R}, q AS ({centre(1)}) SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM q"
    o["edge_centroid"] = f"WITH {EDGE} SELECT vec_id, edge_sum::BIGINT AS edge_sum, round(x, 6) AS x, round(y, 6) AS y FROM ec"
    o["profiles"] = f"WITH {R}{SYM} SELECT c.vec_id, c.place, c.v::BIGINT AS column_alpha, w.v::BIGINT AS row_alpha FROM pf c JOIN pf w ON c.vec_id = w.vec_id AND c.place = w.place AND c.axis = 'x' AND w.axis = 'y'"
    o["symmetry_axis"] = f"WITH {R}{SYM} SELECT vec_id, axis, axis2::INTEGER AS axis2, score FROM sy"
    o["component_count"] = f"""WITH RECURSIVE {R}, o AS (SELECT vec_id, i, x, y FROM r WHERE v > 64), c AS (SELECT vec_id, i AS root, i, x, y FROM o UNION SELECT c.vec_id, c.root, o.i, o.x, o.y FROM c JOIN o ON o.vec_id = c.vec_id AND abs(o.x - c.x) + abs(o.y - c.y) = 1),
        m AS (SELECT vec_id, i, min(root) AS root FROM c GROUP BY vec_id, i), s AS (SELECT vec_id, root, count(*) AS n FROM m GROUP BY vec_id, root) SELECT e.vec_id, count(s.root) FILTER (WHERE s.n >= 2)::INTEGER AS components FROM embeddings e LEFT JOIN s ON s.vec_id = e.vec_id GROUP BY e.vec_id"""
    o["signal_consensus"] = f"""WITH {EDGE}{SYM}, a AS ({centre(1)}), q AS (SELECT a.vec_id, (4 - a.x) / 8 * 100 AS va, (4 - ec.x) / 8 * 100 AS ve, (4 - sy.axis2 / 2) / 8 * 100 AS vs FROM a JOIN ec USING (vec_id) JOIN sy ON sy.vec_id = a.vec_id AND sy.axis = 'x'),
        c AS (SELECT *, list_sort([va, ve, vs])[2] AS m, abs(va - vs) AS wide, greatest(va, ve, vs) - least(va, ve, vs) AS sp FROM q WHERE va IS NOT NULL AND ve IS NOT NULL AND vs IS NOT NULL),
        b AS (SELECT *, CASE WHEN wide > 2 THEN 'conflict' WHEN sp <= 0.5 THEN 'strong' ELSE 'mixed' END AS band FROM c)
        SELECT vec_id, CASE WHEN band = 'conflict' THEN 'ABSTAIN' WHEN abs(m) < 0.1 THEN 'NO_CHANGE' ELSE 'REVIEW' END AS status, band, 3 AS n, round(round(m, 6), 4) + 0 AS consensus FROM b"""
    st = [f"s{t} AS ({centre(t)})" for t in (1, 32, 64)]
    o["size_stability"] = f"WITH {R}, {', '.join(st)}, q AS (SELECT s1.vec_id, list_filter([(4 - s1.x) / 8 * 100, (4 - s32.x) / 8 * 100, (4 - s64.x) / 8 * 100], lambda z: z IS NOT NULL) AS v FROM s1 JOIN s32 USING (vec_id) JOIN s64 USING (vec_id)) SELECT vec_id, round(list_max(v) - list_min(v), 6) AS spread, list_max(v) - list_min(v) <= 3 AS stable FROM q"
    o["decision_codes"] = f"""WITH {R}, c AS ({centre(64)}), b AS (SELECT vec_id, count(*) FILTER (WHERE v > 64) AS n, min(x) FILTER (WHERE v > 64) AS x0, max(x) FILTER (WHERE v > 64) AS x1, min(y) FILTER (WHERE v > 64) AS y0, max(y) FILTER (WHERE v > 64) AS y1 FROM r GROUP BY vec_id),
        q AS (SELECT vec_id, n, c.x, c.y, (x0 + x1 + 1) / 2 AS bx, (y0 + y1 + 1) / 2 AS by_ FROM b JOIN c USING (vec_id)), z AS (SELECT *, (4 - x) / 8 * 100 AS dx, (4 - y) / 8 * 100 AS dy, concat_ws(',', CASE WHEN n = 0 THEN 'no-painted-content' END,
          CASE WHEN abs(bx - 4) / 8 > 0.125 OR abs(by_ - 4) / 8 > 0.125 OR (abs(bx - 4) / 8 > 0.01 AND abs(x - bx) / 8 < 0.005) OR (abs(by_ - 4) / 8 > 0.01 AND abs(y - by_) / 8 < 0.005) THEN 'fix-bounds-first' END) AS why FROM q),
        s AS (SELECT *, sqrt(dx * dx + dy * dy) AS far FROM z), t AS (SELECT *, CASE WHEN why <> '' THEN 'ABSTAIN' WHEN far > 5 THEN 'ABSTAIN' WHEN far < 0.1 THEN 'NO_CHANGE' ELSE 'REVIEW' END AS status FROM s)
        SELECT vec_id, status, CASE WHEN why <> '' THEN why WHEN far > 5 THEN 'proposal-out-of-range' WHEN far < 0.1 THEN 'within-tolerance' END AS reason, CASE status WHEN 'REVIEW' THEN round(round(dx, 6), 4) + 0 WHEN 'NO_CHANGE' THEN 0 END AS dx, CASE status WHEN 'REVIEW' THEN round(round(dy, 6), 4) + 0 WHEN 'NO_CHANGE' THEN 0 END AS dy FROM t"""
    o["decision_pixels"] = f"WITH {P} SELECT k, z.size, round(proposal_pct / 100 * z.size, 4) + 0 AS dx, round(left_pct / 100 * z.size, 4) + 0 AS dy FROM p, (VALUES (16), (24)) z(size)"
    o["hull_centroid"] = f"WITH {R}, h AS ({hull(64)}) SELECT vec_id, round(x, 6) AS hull_x, round(y, 6) AS hull_y FROM h"
    every = " UNION ALL ".join(f"SELECT ac.vec_id, '{axis}' AS axis, {size} AS size, ac.{axis} AS a, ec.{axis} AS e, h{size}.{axis} AS h, sy.axis2 / 2 AS s FROM ac JOIN ec USING (vec_id) JOIN h{size} USING (vec_id) JOIN sy ON sy.vec_id = ac.vec_id AND sy.axis = '{axis}'" for axis in "xy" for size in (1, 2))
    o["ensemble_decision"] = f"""WITH {EDGE}{SYM}, ac AS ({centre(1)}), h1 AS ({hull(1)}), h2 AS ({hull(64)}), u AS ({every}),
        v AS (SELECT vec_id, axis, size, list_sort(list_filter([(4 - a) / 8 * 100, (4 - e) / 8 * 100, (4 - h) / 8 * 100, (4 - s) / 8 * 100], lambda z: z IS NOT NULL)) AS v, list_filter([(4 - a) / 8 * 100, (4 - h) / 8 * 100, (4 - s) / 8 * 100], lambda z: z IS NOT NULL) AS st FROM u),
        w AS (SELECT vec_id, axis, size, v[-1] - v[1] AS sp, CASE WHEN len(st) >= 2 THEN list_max(st) - list_min(st) ELSE v[-1] - v[1] END AS wide, CASE WHEN len(v) >= 3 THEN round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 6) END AS m FROM v),
        g AS (SELECT vec_id, bool_or(size = 1 AND m IS NULL) AS few, bool_or(size = 1 AND wide > 2) AS split, coalesce(bool_and(sp <= 0.5) FILTER (WHERE size = 1), false) AS strong, max(m) FILTER (WHERE size = 1 AND axis = 'x') AS dx, max(m) FILTER (WHERE size = 1 AND axis = 'y') AS dy,
          coalesce(round(max(m) FILTER (WHERE axis = 'x') - min(m) FILTER (WHERE axis = 'x'), 6) > 3, true) OR coalesce(round(max(m) FILTER (WHERE axis = 'y') - min(m) FILTER (WHERE axis = 'y'), 6) > 3, true) AS shaky FROM w GROUP BY vec_id),
        f AS (SELECT *, sqrt(dx * dx + dy * dy) AS far, few OR coalesce(split, false) OR shaky AS conflict FROM g),
        y AS (SELECT *, CASE WHEN few THEN 'insufficient-signals' WHEN conflict THEN 'signals-disagree' WHEN far > 5 THEN 'proposal-out-of-range' END AS why FROM f),
        x AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'ABSTAIN' WHEN far < 0.1 THEN 'NO_CHANGE' ELSE 'REVIEW' END AS status FROM y)
        SELECT vec_id, status, CASE WHEN status = 'NO_CHANGE' THEN 'within-tolerance' ELSE why END AS reason, CASE WHEN conflict THEN 'conflict' WHEN strong THEN 'strong' ELSE 'mixed' END AS band, CASE status WHEN 'REVIEW' THEN dx + 0 WHEN 'NO_CHANGE' THEN 0 END AS dx, CASE status WHEN 'REVIEW' THEN dy + 0 WHEN 'NO_CHANGE' THEN 0 END AS dy FROM x"""
    o["clipping_retention"] = f"WITH {R}, q AS (SELECT vec_id, sum(v) FILTER (WHERE v > 1) AS b, coalesce(sum(v) FILTER (WHERE v > 1 AND x < 7), 0) AS a FROM r GROUP BY vec_id), s AS (SELECT vec_id, CASE WHEN b > 0 THEN a / b ELSE 1 END AS share, a < coalesce(b, 0) AS lost FROM q) SELECT vec_id, round(share, 6) AS retained, concat_ws(',', CASE WHEN lost THEN 'right' END, CASE WHEN share < 0.95 THEN 'raster-loss' END) AS sides FROM s"
    # area of an edge's piece right of it in each pixel of a row, in closed form: g is the integral of a value held between 0 and 1
    g = lambda u: f"CASE WHEN {u} <= 0 THEN 0 WHEN {u} >= 1 THEN {u} - 0.5 ELSE {u} * {u} / 2 END"
    from .facts import CORNERS

    corners = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(CORNERS))
    o["outline_measures"] = f"""WITH p AS (SELECT vec_id, k, 12 + 6 * dx * far AS x, 12 + 6 * dy * far AS y FROM (SELECT vec_id, k, dx, dy, least(1, 4 * abs(CASE WHEN isnan(v) THEN 0 ELSE v END)) + 0.1 AS far
          FROM (SELECT vec_id, k, dx, dy, coalesce(embedding[k + 1]::DOUBLE, 0) AS v FROM embeddings, (VALUES {corners}) c(k, dx, dy)))),
        e AS (SELECT a.vec_id, size, a.x * size / 24 AS x1, a.y * size / 24 AS y1, b.x * size / 24 AS x2, b.y * size / 24 AS y2 FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.k = (a.k + 1) % {len(CORNERS)}, (VALUES (16), (24)) z(size) WHERE a.y <> b.y),
        w AS (SELECT *, unnest(range(greatest(0, floor(least(y1, y2)))::INT, least(size, ceil(greatest(y1, y2)))::INT)) AS r FROM e),
        s AS (SELECT *, greatest(r, least(r + 1, y1)) AS ya, greatest(r, least(r + 1, y2)) AS yb, (x2 - x1) / (y2 - y1) AS m FROM w), t AS (SELECT vec_id, size, r, yb - ya AS dy, x1 + (ya - y1) * m AS xa, x1 + (yb - y1) * m AS xb, unnest(range(0, size)) AS c FROM s),
        i AS (SELECT vec_id, size, r, c, sum(CASE WHEN abs(xb - xa) < 1e-7 THEN greatest(0, least(1, c + 1 - (xa + xb) / 2)) * dy ELSE (({g("(c + 1 - xa)")}) - ({g("(c + 1 - xb)")})) / (xb - xa) * dy END) AS v FROM t GROUP BY ALL),
        a AS (SELECT vec_id, size, r, c, floor(round(least(1, abs(v)), 9) * 255 + 0.5)::BIGINT AS alpha, 24 / size AS q FROM i)
        SELECT vec_id, size, count(*) AS painted_pixels, sum(alpha)::BIGINT AS alpha_sum, round(min(c) * q, 6) + 0 AS min_x, round(min(r) * q, 6) + 0 AS min_y, round((max(c) + 1) * q, 6) + 0 AS max_x, round((max(r) + 1) * q, 6) + 0 AS max_y,
          round(sum(alpha * (c + 0.5)) / sum(alpha) * q, 6) + 0 AS x, round(sum(alpha * (r + 0.5)) / sum(alpha) * q, 6) + 0 AS y,
          concat_ws(',', CASE WHEN min(c) = 0 THEN 'left' END, CASE WHEN max(c) = size - 1 THEN 'right' END, CASE WHEN min(r) = 0 THEN 'top' END, CASE WHEN max(r) = size - 1 THEN 'bottom' END) AS touches FROM a WHERE alpha > 1 GROUP BY vec_id, size, q"""
    o["axis_review"] = f"WITH {H0} SELECT CASE WHEN abs(learned) < 1e-9 THEN 'ZERO' WHEN abs(learned - ensemble) < 1e-9 THEN 'ACCEPT_PROPOSAL' ELSE 'OVERRIDE' END AS action, count(*) AS n FROM k WHERE learned IS NOT NULL GROUP BY 1"
    o["verification_status"] = """WITH q AS (SELECT p_size % 10 = 0 AS clip, abs(p_size % 13 - 6) > 5 AS far, p_size % 3 <> 0 AS ok, CASE WHEN p_size % 4 <> 0 THEN p_size % 5 <> 0 END AS bound FROM part),
        s AS (SELECT concat_ws(',', CASE WHEN clip THEN 'post-correction-clipping' END, CASE WHEN far THEN 'correction-out-of-range' END, CASE WHEN ok AND NOT bound THEN 'comparison-binding-mismatch' END) AS f, concat_ws(',', CASE WHEN ok AND bound IS NULL THEN 'comparison-required' END, CASE WHEN NOT ok THEN 'review-approval-required' END) AS b FROM q)
        SELECT CASE WHEN f <> '' THEN 'FAIL' WHEN b <> '' THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status, concat_ws(',', nullif(f, ''), nullif(b, '')) AS codes, count(*) AS n FROM s GROUP BY ALL"""
    o["apply_gate"] = "SELECT concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'verified' END, CASE WHEN o_orderkey % 7 = 0 THEN 'audit-bound' END, CASE WHEN o_custkey % 5 = 0 THEN 'comparison-bound' END) AS codes, count(*) AS n FROM orders GROUP BY 1"
    flags = {"unsafe-doctype": "regexp_matches(h, '<!DOCTYPE', 'i')", "unsafe-entity": "regexp_matches(h, '<!ENTITY', 'i')", "unsafe-processing-instruction": "contains(regexp_replace(h, '^\\x{FEFF}?\\s*<\\?xml\\s[^?]*\\?>', '', 'i'), '<?')", "too-many-elements": "len(regexp_extract_all(h, '<[A-Za-z_][\\w:.-]*(?:\\s|/?>)')) > 10000", "input-too-large": "octet_length(encode(h)) > 2097152"}
    o["markup_issues"] = "WITH q AS (SELECT coalesce(html, '') AS h FROM pages) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER (WHERE {r}) AS n FROM q" for c, r in flags.items()) + ") WHERE n > 0"
    from ..operators.markup import ALLOWED_ELEMENTS, BLOCKED_ELEMENTS

    sql_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
    o["markup_elements"] = f"WITH q AS (SELECT unnest(regexp_extract_all(coalesce(html, ''), '<([A-Za-z_][\\w:.-]*)(?:\\s|/?>)', 1)) AS name FROM pages) SELECT name, CASE WHEN name IN ({sql_list(BLOCKED_ELEMENTS)}) THEN 'blocked' WHEN name IN ({sql_list(ALLOWED_ELEMENTS)}) THEN 'allowed' ELSE 'unsupported' END AS listed, count(*) AS n FROM q GROUP BY ALL"
    o["vote_rate_windows"] = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
    return o
