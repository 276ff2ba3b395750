"""DuckDB SQL for the case-history queries, written apart from the Spark expressions."""

from __future__ import annotations

from .queries import TIES
from .tables import CATEGORICAL, MODELS, NUMERIC, WEEK_MAX

BASE = """base AS (SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS date_decision,
  CAST(floor((CAST(o_orderdate AS DATE) - DATE '1995-01-01') / 7.0) AS INT) AS WEEK_NUM,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS MONTH,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS target FROM orders)"""
LINES = """lines AS (SELECT l_orderkey AS case_id, CAST(l_linenumber - 1 AS BIGINT) AS num_group1,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS quantityA, l_extendedprice AS priceA,
  CASE WHEN l_discount <= 0.08 THEN l_discount END AS discountP, nullif(l_returnflag, 'N') AS flagM,
  l_linestatus AS statusL, CAST(l_shipdate AS DATE) AS ship FROM lineitem)"""
HISTORY = f"{BASE}, {LINES}, h AS (SELECT l.*, CAST(l.ship - b.date_decision AS DOUBLE) AS shippedD FROM lines l JOIN base b USING (case_id))"
# Columns of the given tables, the key first; of nested ones footers state no nulls.
COLUMNS = {
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id label",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "pages": "page_id url html",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}
NESTED = {"embeddings": 1}


def stored_table(name: str) -> str:
    """What footers know of a table, counted."""
    columns = COLUMNS[name].split()
    missing = ", ".join(f"1 - count({c}) / CAST(count(*) AS DOUBLE)" for c in columns)
    return f"SELECT '{name}' AS source, count(*) AS n_rows, {len(columns) + NESTED.get(name, 0)} AS n_columns, {len(columns)} AS known_null_columns, round(greatest({missing}), 6) AS max_missing, CAST(min({columns[0]}) AS BIGINT) AS least_key, CAST(max({columns[0]}) AS BIGINT) AS greatest_key FROM {name}"


def first_cut(name: str, source: str, features: list[str], bins: int = 32) -> str:
    """CTEs that end in one of (name, gain): the best cut of all rows of source by each feature, missing values on either side."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS name, CAST({f} AS DOUBLE) AS x, CAST(target AS DOUBLE) AS y FROM {source}" for f in features)
    shares = ", ".join(str(k / bins) for k in range(1, bins))
    side = lambda g, h: f"power({g} / 1073741824.0, 2) / ({h} / 1073741824.0 + 1)"
    return f"""{name}_l AS MATERIALIZED ({long}),
{name}_e AS (SELECT name, list_distinct(quantile_cont(x, [{shares}])) AS e FROM {name}_l WHERE x IS NOT NULL GROUP BY name),
{name}_p AS (SELECT avg(CAST(target AS DOUBLE)) AS p FROM {source}),
{name}_b AS (SELECT name, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(e, lambda c: c < x)) END AS b, CAST(round((p - y) * 1073741824) AS BIGINT) AS g, CAST(round(p * (1 - p) * 1073741824) AS BIGINT) AS h FROM {name}_l JOIN {name}_e USING (name), {name}_p),
{name}_s AS (SELECT name, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {name}_b GROUP BY ALL),
{name}_w AS (SELECT name, b, sum(CASE WHEN b >= 0 THEN g END) OVER w AS lg, sum(CASE WHEN b >= 0 THEN h END) OVER w AS lh, sum(CASE WHEN b >= 0 THEN n END) OVER w AS ln, sum(CASE WHEN b < 0 THEN g ELSE 0 END) OVER a AS mg, sum(CASE WHEN b < 0 THEN h ELSE 0 END) OVER a AS mh, sum(CASE WHEN b < 0 THEN n ELSE 0 END) OVER a AS mn, sum(g) OVER a AS tg, sum(h) OVER a AS th, sum(n) OVER a AS tn FROM {name}_s WINDOW w AS (PARTITION BY name ORDER BY b), a AS (PARTITION BY name)),
{name}_c AS (SELECT name, lg + k * mg AS lg, lh + k * mh AS lh, ln + k * mn AS ln, tg, th, tn FROM {name}_w, (VALUES (0), (1)) v(k) WHERE b >= 0),
{name} AS (SELECT name, greatest(max({side('lg', 'lh')} + {side('(tg - lg)', '(th - lh)')} - {side('tg', 'th')}), 0) AS gain FROM {name}_c WHERE ln >= 20 AND tn - ln >= 20 GROUP BY name)"""


def parzen(name: str, of: str) -> str:
    """CTE of candidates of a number, whose trials are on a unit scale in column of: u (unit scale) and ln (log density ratio)."""
    u = lambda k: f"((CAST('0x' || substr(md5('42:25:{name}:' || c || ':{k}'), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))"
    sig = lambda x: f"(1 / (1 + exp(-({x}))))"
    kernel = lambda w: f"{sig(f'(pt - m) / {w}')} * (1 - {sig(f'(pt - m) / {w}')}) / {w} / ({sig(f'(1 - m) / {w}')} - {sig(f'-m / {w}')})"
    dense = lambda side: f"(1 + list_sum(list_transform({side}, lambda m: {kernel(f'w_{side}')}))) / (len({side}) + 1)"
    return f"""{name}_t AS (SELECT list({of} ORDER BY slot) FILTER (WHERE good) AS g, list({of} ORDER BY slot) FILTER (WHERE NOT good) AS r FROM tr),
{name}_c AS (SELECT c, g, r, 0.5 / sqrt(len(g) + 1) AS w_g, 0.5 / sqrt(len(r) + 1) AS w_r, {u(1)} AS u1, g[CAST(floor({u(0)} * (len(g) + 1)) AS INT) + 1] AS mid FROM cand, {name}_t),
{name}_q AS (SELECT *, {sig('-mid / w_g')} + u1 * ({sig('(1 - mid) / w_g')} - {sig('-mid / w_g')}) AS q FROM {name}_c),
{name}_a AS (SELECT *, CASE WHEN mid IS NULL THEN u1 ELSE greatest(0, least(1, mid + w_g * ln(q / (1 - q)))) END AS pt FROM {name}_q),
{name} AS (SELECT c, pt AS u, ln({dense('g')}) - ln({dense('r')}) AS gain FROM {name}_a)"""


FEATURES = ["rows__count", "quantityA__mean", "quantityA__sum", "priceA__max", "shippedD__mean"]
FIRST = WEEK_MAX - 39
FOLD = f"CAST((WEEK_NUM - {FIRST}) // 8 + 1 AS INT)"
PRED = f"{BASE}, p AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, case_id, WEEK_NUM, target, {FOLD} AS fold, round(((case_id * {a}) % 997) / 1250.0 + CAST({c} AS DOUBLE) * target, 6) AS prediction FROM base WHERE WEEK_NUM BETWEEN {FIRST} AND {WEEK_MAX}" for m, (a, c) in MODELS.items()
) + ")"


def auc(source: str, keys: str, name: str) -> str:
    """CTE of n_rows, positives and auc by mid-ranks."""
    return f"""{name} AS (SELECT {keys}, count(*) AS n_rows, sum(target) AS positives,
  CASE WHEN sum(target) > 0 AND sum(1 - target) > 0 THEN (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY prediction) + (count(*) OVER (PARTITION BY {keys}, prediction) - 1) / 2.0 AS rk FROM {source}) GROUP BY {keys})"""


def stability(weekly: str, keys: str, name: str) -> str:
    """CTE of the stability parts from a CTE with auc by keys and WEEK_NUM."""
    return f"""{name}_f AS (SELECT {keys}, regr_slope(2 * auc - 1, WEEK_NUM) AS s, regr_intercept(2 * auc - 1, WEEK_NUM) AS i FROM {weekly} WHERE auc IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {keys}, count(*) AS weeks, avg(2 * auc - 1) AS mean_gini, any_value(s) AS slope, stddev_pop(2 * auc - 1 - s * WEEK_NUM - i) AS residual_std,
  avg(2 * auc - 1) + 88 * least(0, any_value(s)) - 0.5 * stddev_pop(2 * auc - 1 - s * WEEK_NUM - i) AS stability
  FROM {weekly} JOIN {name}_f USING ({keys}) WHERE auc IS NOT NULL GROUP BY {keys})"""


def precision(source: str, keys: str, name: str) -> str:
    return f"""{name}_c AS (SELECT {keys}, prediction, sum(target) AS pos, sum(sum(target)) OVER w AS tp, sum(count(*)) OVER w AS seen, sum(sum(target)) OVER (PARTITION BY {keys}) AS total
  FROM {source} GROUP BY {keys}, prediction WINDOW w AS (PARTITION BY {keys} ORDER BY prediction DESC)),
{name} AS (SELECT {keys}, sum(pos * tp / seen) / any_value(total) AS average_precision FROM {name}_c GROUP BY {keys})"""


def suite(source: str, keys: str, brier: str) -> str:
    """WITH-less CTEs ending in ``suite``."""
    q = "greatest(least(prediction, 1 - 1e-7), 1e-7)"
    return f"""{auc(source, f'{keys}, WEEK_NUM', 'wk')}, {stability('wk', keys, 'st')}, {auc(source, keys, 'au')}, {precision(source, keys, 'ap')},
lo AS (SELECT {keys}, avg(({brier} - target) ** 2) AS brier, avg(-ln(CASE WHEN target = 1 THEN {q} ELSE 1 - {q} END)) AS log_loss FROM p GROUP BY {keys}),
suite AS (SELECT {keys}, weeks, round(mean_gini, 6) AS mean_gini, round(slope, 6) AS slope, round(residual_std, 6) AS residual_std, round(stability, 6) AS stability, n_rows, positives, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss
  FROM st JOIN au USING ({keys}) JOIN ap USING ({keys}) JOIN lo USING ({keys}))"""


def blended() -> str:
    names, leader = list(MODELS), "m1"
    weights = [(m, m, 1.0) for m in names]
    for m in names[1:]:
        for w in (50, 75, 90):
            weights += [(f"{leader}_{w}_{m}", leader, w / 100), (f"{leader}_{w}_{m}", m, 1 - w / 100)]
    weights += [("equal_all", m, 0.25) for m in names] + [("equal_without_control", m, 1 / 3) for m in names if m != "m2"]
    rows = ", ".join(f"('{c}', '{m}', CAST({w!r} AS DOUBLE))" for c, m, w in weights)
    return f"""{PRED}, w(candidate, model, weight) AS (VALUES {rows}),
b AS (SELECT candidate, case_id, fold, WEEK_NUM, target, round(sum(weight * prediction), 9) AS prediction FROM p JOIN w USING (model) GROUP BY ALL)"""


def evaluated() -> str:
    return f"""{blended()}, {auc('b', 'candidate, fold, WEEK_NUM', 'wk')}, {stability('wk', 'candidate, fold', 'st')},
br AS (SELECT candidate, fold, avg((prediction - target) ** 2) AS brier FROM b GROUP BY ALL), ev AS (SELECT * FROM st JOIN br USING (candidate, fold))"""


def reliability(bin_of: str) -> str:
    return f"""WITH {PRED}, q AS (SELECT model, list_distinct(quantile_cont(prediction, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM p GROUP BY model),
e AS (SELECT model, list_filter(edges, lambda x: x > list_min(edges) AND x < list_max(edges)) AS inner_edges FROM q)
SELECT model, CAST({bin_of} AS INT) AS bin, count(*) AS n_rows, round(avg(prediction), 6) AS mean_prediction, round(avg(target), 6) AS observed_rate FROM p JOIN e USING (model) GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    order = ", ".join(f"{c} NULLS FIRST" for c in ["num_group1", *TIES])
    back = ", ".join(f"{c} DESC NULLS LAST" for c in ["num_group1", *TIES])
    pick = lambda c: f"round({c}, 4)"
    n_unique = lambda c: f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"
    numeric = ", ".join(f'round(min({c}), 7) AS "{c}__min", round(max({c}), 7) AS "{c}__max", round(avg({c}), 7) AS "{c}__mean", round(stddev_samp({c}), 7) AS "{c}__std", round(coalesce(sum({c}), 0), 7) AS "{c}__sum"' for c in NUMERIC)
    ratio = lambda c: f"round(CAST(CAST({n_unique(c)} / nullif(count({c}), 0) AS FLOAT) AS DOUBLE), 4)"
    missing = "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in TIES) + f") / {len(TIES)}.0"
    sub = lambda g, cond: f"""{g} AS (SELECT case_id, count(*) AS "{g}__rows__count", round(avg(priceA), 7) AS "{g}__priceA__mean", round(coalesce(sum(priceA), 0), 7) AS "{g}__priceA__sum", {n_unique('flagM')} AS "{g}__flagM__n_unique", round(first(priceA ORDER BY {back}), 4) AS "{g}__priceA__last" FROM h WHERE {cond} GROUP BY case_id)"""
    people = """o AS (SELECT o_orderkey AS case_id, nullif(o_orderpriority, '5-LOW') AS priorityM, CASE WHEN year(o_orderdate) <> 1997 THEN o_orderstatus END AS statusM, CASE WHEN o_totalprice > 20000 THEN o_totalprice END AS amountA, year(o_orderdate) AS y FROM orders),
tr AS (SELECT * FROM o WHERE y < 1999), re AS (SELECT * REPLACE (CASE WHEN case_id % 5 = 0 THEN 'new' ELSE priorityM END AS priorityM) FROM o WHERE y >= 1999)"""
    share = lambda c: f"s_{c} AS (SELECT coalesce({c}, '__missing__') AS k, count(*) / (SELECT count(*) FROM tr) AS s FROM tr GROUP BY 1)"
    code = lambda c: f"c_{c} AS (SELECT k, row_number() OVER (ORDER BY k) AS s FROM (SELECT DISTINCT coalesce({c}, '__missing__') AS k FROM tr))"
    ranking = "r AS (SELECT 'f_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, p_brand AS block, CAST((p_partkey * 7) % 50 AS DOUBLE) AS target_gain, CAST((p_partkey * 11) % 40 AS DOUBLE) AS drift_gain FROM part), sc AS (SELECT *, round(target_gain / (SELECT max(target_gain) FROM r) * greatest(0, 1 - 0.35 * drift_gain / (SELECT max(drift_gain) FROM r)), 6) AS score FROM r)"
    chosen = "i AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, target_gain DESC, name) AS ib FROM sc), o AS (SELECT *, row_number() OVER (ORDER BY ib > 3, CASE WHEN ib <= 3 THEN block END, score DESC, target_gain DESC, name) AS place FROM i)"
    mean = f"{PRED}, mp AS (SELECT case_id, WEEK_NUM, target, fold, round(avg(prediction), 9) AS prediction FROM p GROUP BY ALL)"
    blocks = f"""{HISTORY}, hl AS (SELECT case_id, count(*) AS lines, round(coalesce(sum(quantityA), 0), 4) AS quantity FROM h GROUP BY case_id),
fb AS (SELECT b.*, hl.lines, hl.quantity, o_orderstatus AS status, round(o_totalprice, 4) AS price FROM base b LEFT JOIN hl USING (case_id) JOIN orders ON o_orderkey = b.case_id)"""
    profile = "pr AS (SELECT WEEK_NUM, count(*) AS n_rows, count(DISTINCT target) = 2 AS eligible, min(date_decision) AS date_min, max(date_decision) AS date_max FROM base GROUP BY 1)"
    pairs = [(a, b) for k, a in enumerate([*MODELS, "flat"]) for b in [*MODELS, "flat"][k + 1 :]]
    score = lambda m: "0.5" if m == "flat" else f"max(CASE WHEN model = '{m}' THEN prediction END)"
    fixed = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.25, 0.5)
    bad = """CASE WHEN case_id % 97 = 0 THEN NULL WHEN case_id % 97 = 1 THEN CAST('NaN' AS DOUBLE) WHEN case_id % 97 = 2 THEN 1.5 ELSE prediction END"""
    weeks = "WEEK_NUM BETWEEN 302 AND 340"
    clip = "greatest(least(prediction, 1 - 1e-7), 1e-7)"
    deep = """d AS (SELECT o_custkey AS case_id, o_orderkey AS num_group1, CAST(l_linenumber AS BIGINT) AS num_group2, l_quantity AS quantityA, l_returnflag AS flagM FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
    return {
        "decision_calendar": f"""WITH {BASE} SELECT case_id, WEEK_NUM, MONTH, target, year(date_decision) AS "date_decision__year", month(date_decision) AS "date_decision__month", day(date_decision) AS "date_decision__day", isodow(date_decision) AS "date_decision__weekday", dayofyear(date_decision) AS "date_decision__ordinal_day" FROM base""",
        "depth_zero_first": """WITH f AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1), v AS (SELECT o_custkey AS case_id, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS a, nullif(o_orderstatus, 'O') AS s FROM f)
SELECT case_id, a AS "amountA__value", s AS "statusM__value", CAST((a IS NULL) AS INT) + CAST((s IS NULL) AS INT) AS "row__missing_count", CAST((CAST((a IS NULL) AS INT) + CAST((s IS NULL) AS INT)) / 2.0 AS FLOAT) AS "row__missing_fraction" FROM v""",
        "case_history_numeric": f"""WITH {HISTORY} SELECT case_id, count(*) AS "rows__count", max(num_group1) AS "num_group1__max", {n_unique('num_group1')} AS "num_group1__n_unique", {numeric} FROM h GROUP BY case_id""",
        "case_history_dates": f"""WITH {HISTORY} SELECT case_id, round(min(shippedD), 2) AS "shippedD__min", round(max(shippedD), 2) AS "shippedD__max", round(CAST(CAST(avg(shippedD) AS FLOAT) AS DOUBLE), 2) AS "shippedD__mean", round(CAST(CAST(stddev_samp(shippedD) AS FLOAT) AS DOUBLE), 2) AS "shippedD__std" FROM h GROUP BY case_id""",
        "case_history_categorical": f"""WITH {HISTORY} SELECT case_id, {', '.join(f'count({c}) AS "{c}__non_null_count", {n_unique(c)} AS "{c}__n_unique", {ratio(c)} AS "{c}__diversity_ratio"' for c in CATEGORICAL)} FROM h GROUP BY case_id""",
        "case_history_ordered": f"""WITH {HISTORY}, a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {order}) = 1), z AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {back}) = 1)
SELECT a.case_id, {', '.join(f'{pick("a." + c)} AS "{c}__first", {pick("z." + c)} AS "{c}__last"' if c not in CATEGORICAL else f'a.{c} AS "{c}__first", z.{c} AS "{c}__last"' for c in TIES)} FROM a JOIN z USING (case_id)""",
        "case_history_stored_order": f"""WITH r AS (SELECT l_orderkey AS case_id, l_linenumber // 3 AS g, row_number() OVER () AS pos, l_quantity AS q, l_extendedprice AS p, nullif(l_returnflag, 'N') AS f FROM lineitem),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY g, pos) = 1), z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY g DESC, pos DESC) = 1)
SELECT a.case_id, round(a.q, 4) AS "quantityA__first", round(z.q, 4) AS "quantityA__last", round(a.p, 4) AS "priceA__first", round(z.p, 4) AS "priceA__last", a.f AS "flagM__first", z.f AS "flagM__last" FROM a JOIN z USING (case_id)""",
        "case_history_missingness": f"""WITH {HISTORY} SELECT case_id, round(CAST(CAST(avg({missing}) AS FLOAT) AS DOUBLE), 4) AS "row_missing_fraction__mean", round(CAST(CAST(max({missing}) AS FLOAT) AS DOUBLE), 4) AS "row_missing_fraction__max" FROM h GROUP BY case_id""",
        "recency_counts": f"""WITH {HISTORY} SELECT case_id, {', '.join(f'count(*) FILTER (shippedD BETWEEN -{w} AND 0) AS "shippedD__count_last_{w}d"' for w in (30, 180, 365, 730, 1825))} FROM h GROUP BY case_id""",
        "person_subgroups": f"""WITH {HISTORY}, {sub('all', 'true').replace('all AS', '"all" AS', 1)}, {sub('applicant', 'num_group1 = 0')}, {sub('related', 'num_group1 > 0')} SELECT * FROM "all" LEFT JOIN applicant USING (case_id) LEFT JOIN related USING (case_id)""",
        "depth_two_history": f"""WITH {deep}, a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY num_group1, num_group2, quantityA, flagM) = 1), z AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY num_group1 DESC, num_group2 DESC, quantityA DESC, flagM DESC) = 1),
g AS (SELECT case_id, count(*) AS "rows__count", max(num_group1) AS "num_group1__max", count(DISTINCT num_group1) AS "num_group1__n_unique", max(num_group2) AS "num_group2__max", count(DISTINCT num_group2) AS "num_group2__n_unique", round(sum(quantityA), 4) AS "quantityA__sum" FROM d GROUP BY case_id)
SELECT g.*, a.quantityA AS "quantityA__first", z.quantityA AS "quantityA__last", a.flagM AS "flagM__first", z.flagM AS "flagM__last" FROM g JOIN a USING (case_id) JOIN z USING (case_id)""",
        "union_relaxed": """SELECT statusL, count(*) AS n, round(sum(tax), 4) AS tax, round(sum(amount), 4) AS amount FROM (SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) AS statusL, l_tax AS tax, NULL AS amount FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_returnflag, NULL, l_quantity FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY statusL""",
        "feature_assembly": f"""WITH {HISTORY}, g AS (SELECT case_id, count(*) AS "rows__count", round(coalesce(sum(quantityA), 0), 4) AS "quantityA__sum" FROM h GROUP BY case_id)
SELECT b.case_id, b.WEEK_NUM, b.target, g."rows__count", g."quantityA__sum", o_orderstatus AS "statusM" FROM base b JOIN orders ON o_orderkey = b.case_id LEFT JOIN g ON g.case_id = b.case_id""",
        "population_guard_join": f"""WITH {BASE} SELECT WEEK_NUM, count(*) AS n, count(DISTINCT case_id) AS cases FROM lineitem JOIN base ON l_orderkey = case_id WHERE l_tax > 0 GROUP BY WEEK_NUM""",
        "block_contract": """SELECT * FROM (VALUES ('case_id_first', true), ('case_id_not_null', true), ('case_id_unique', true), ('target_only_in_base', true)) v("check", passed)""",
        "deterministic_sample": f"""WITH {BASE} SELECT case_id, WEEK_NUM FROM base ORDER BY (case_id * 1103515245 + 42) % 2147483647, case_id LIMIT 500""",
        "case_partitions": f"""WITH {BASE}, k AS (SELECT case_id, (row_number() OVER (ORDER BY case_id) - 1) // 1000 AS part FROM base) SELECT part, min(case_id) AS least, max(case_id) AS greatest, count(*) AS n_cases FROM k GROUP BY part""",
        "week_profile": f"""WITH {BASE} SELECT WEEK_NUM, count(*) AS n_rows, sum(target) AS positives, sum(1 - target) AS negatives, round(avg(target), 6) AS positive_rate, CAST(min(date_decision) AS VARCHAR) AS date_min, CAST(max(date_decision) AS VARCHAR) AS date_max, count(DISTINCT target) = 2 AS eligible FROM base GROUP BY WEEK_NUM""",
        "base_summary": f"""WITH {BASE} SELECT count(*) AS n_rows, count(DISTINCT case_id) AS cases, min(WEEK_NUM) AS week_min, max(WEEK_NUM) AS week_max, count(DISTINCT WEEK_NUM) AS weeks, CAST(min(date_decision) AS VARCHAR) AS date_min, CAST(max(date_decision) AS VARCHAR) AS date_max, round(avg(target), 6) AS positive_rate FROM base""",
        "base_violations": f"""WITH {BASE}, v AS (SELECT case_id AS c, CASE WHEN case_id % 100 = 1 THEN NULL WHEN case_id % 100 = 2 THEN 7 ELSE case_id END AS k FROM base)
SELECT 'empty' AS "check", 0 AS violations UNION ALL SELECT 'case_id_null', count(*) FROM v WHERE k IS NULL UNION ALL SELECT 'case_id_repeated', count(k) - count(DISTINCT k) FROM v UNION ALL SELECT 'week_not_whole', count(*) FROM v WHERE c % 50 = 0 UNION ALL SELECT 'date_invalid', count(*) FROM v WHERE c % 70 = 0 UNION ALL SELECT 'target_not_binary', count(*) FROM v WHERE c % 90 IN (0, 1)""",
        "date_reversals": f"""WITH {BASE}, m AS (SELECT xor(WEEK_NUM, 3) AS w, min(date_decision) AS a FROM base GROUP BY 1) SELECT count(*) FILTER (a < b) AS reversals FROM (SELECT a, lag(a) OVER (ORDER BY w) AS b FROM m)""",
        "split_overlap": f"""WITH {BASE} SELECT (SELECT count(*) FROM base WHERE WEEK_NUM BETWEEN 190 AND 200) AS overlap, 0 AS reversals, 0 AS reversals_max, (SELECT max(date_decision) FROM base WHERE WEEK_NUM <= 200) < (SELECT min(date_decision) FROM base WHERE WEEK_NUM BETWEEN 190 AND 250) AS ordered""",
        "holdout_candidates": f"""WITH {BASE}, {profile}, n AS (SELECT *, row_number() OVER (ORDER BY WEEK_NUM DESC) AS e, count(*) OVER () AS weeks FROM pr), c AS (SELECT f.fraction, ceil(round(f.fraction * n.weeks, 9)) AS size, n.* FROM n, (VALUES (0.15::DOUBLE), (0.20), (0.25), (0.30)) f(fraction)),
a AS (SELECT fraction, CAST(max(size) AS BIGINT) AS holdout_weeks, min(CASE WHEN e <= size THEN WEEK_NUM END) AS holdout_start, sum(CASE WHEN e > size THEN n_rows ELSE 0 END) AS train_rows, sum(CASE WHEN e <= size THEN n_rows ELSE 0 END) AS holdout_rows, count(*) FILTER (e > size) AS train_weeks, count(*) FILTER (e <= size AND eligible) AS metric_weeks FROM c GROUP BY fraction)
SELECT *, train_weeks >= 20 AND metric_weeks >= 8 AS eligible FROM a QUALIFY row_number() OVER (PARTITION BY holdout_weeks ORDER BY fraction) = 1""",
        "expanding_folds": f"""WITH {BASE}, w AS (SELECT min(WEEK_NUM) AS a, max(WEEK_NUM) AS z FROM base) SELECT CAST(k + 1 AS INT) AS fold, a AS train_min, CAST(z - 40 + 8 * k AS INT) AS train_max, CAST(z - 39 + 8 * k AS INT) AS validation_min, CAST(z - 32 + 8 * k AS INT) AS validation_max FROM w, range(5) t(k)""",
        "fold_assignment": f"""WITH {BASE} SELECT {FOLD} AS fold, WEEK_NUM, count(*) AS n FROM base WHERE WEEK_NUM BETWEEN {FIRST} AND {WEEK_MAX} GROUP BY ALL""",
        "frequency_encode": f"""WITH {people}, {share('priorityM')}, {share('statusM')} SELECT case_id, round(CAST(CAST(coalesce(a.s, 0) AS FLOAT) AS DOUBLE), 2) AS "priorityM", round(CAST(CAST(coalesce(b.s, 0) AS FLOAT) AS DOUBLE), 2) AS "statusM", round(CAST(CAST(amountA AS FLOAT) AS DOUBLE), 2) AS "amountA" FROM re LEFT JOIN s_priorityM a ON a.k = coalesce(priorityM, '__missing__') LEFT JOIN s_statusM b ON b.k = coalesce(statusM, '__missing__')""",
        "category_codes": f"""WITH {people}, {code('priorityM')}, {code('statusM')} SELECT case_id, coalesce(a.s, 0) AS "priorityM", coalesce(b.s, 0) AS "statusM" FROM re LEFT JOIN c_priorityM a ON a.k = coalesce(priorityM, '__missing__') LEFT JOIN c_statusM b ON b.k = coalesce(statusM, '__missing__')""",
        "standardize_linear": f"""WITH {people}, m AS (SELECT median(amountA) AS md FROM tr), f AS (SELECT avg(coalesce(amountA, md)) AS mu, stddev_pop(coalesce(amountA, md)) AS sd FROM tr, m) SELECT case_id, round((coalesce(amountA, md) - mu) / sd, 4) AS "amountA", CAST(0 AS DOUBLE) AS "constantA" FROM re, m, f""",
        "structural_screen": f"""WITH {LINES} {' UNION ALL '.join(f"SELECT '{n}' AS feature, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_fraction, count(DISTINCT {c}) + max(CAST(({c} IS NULL) AS INT)) AS n_unique, {r} AS reason FROM lines" for n, c, r in (('quantityA', 'quantityA', 'NULL'), ('priceA', 'priceA', 'NULL'), ('flagM', 'flagM', 'NULL'), ('emptyA', 'nullif(1, 1)', "'missing'"), ('sameM', "'x'", "'constant'")))}""",
        "drift_scores": f"WITH {ranking} SELECT name, block, score FROM sc",
        "block_floor_select": f"""WITH {ranking}, {chosen} SELECT name, block, score, place FROM o WHERE place <= 150""",
        "block_floor_tight": f"""WITH {ranking}, {chosen} SELECT name, block, score, place FROM o WHERE place <= 40""",
        "feature_accounting": f"""WITH {ranking} SELECT block AS family, CASE WHEN target_gain > 40 THEN 'selected' WHEN target_gain < 5 THEN 'missing' WHEN target_gain < 10 THEN 'constant' ELSE 'eligible' END AS decision, count(*) AS features FROM r GROUP BY ALL""",
        "weekly_gini": f"WITH {PRED}, {auc('p', 'model, WEEK_NUM', 'wk')} SELECT model, WEEK_NUM, n_rows, positives, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM wk",
        "weekly_diagnostics": f"WITH {PRED}, {auc('p', 'model, WEEK_NUM', 'wk')}, s AS (SELECT model, WEEK_NUM, avg(target) AS r, avg(prediction) AS m FROM p GROUP BY ALL) SELECT model, WEEK_NUM, n_rows, positives, round(r, 6) AS positive_rate, round(m, 6) AS mean_prediction, round(2 * auc - 1, 6) AS gini FROM wk JOIN s USING (model, WEEK_NUM)",
        "weekly_violations": f"""WITH {PRED}, {auc('p', 'model, WEEK_NUM', 'wk')}, o AS (SELECT model, CASE WHEN WEEK_NUM % 10 = 5 THEN WEEK_NUM + 1 ELSE WEEK_NUM END AS w, CASE WHEN WEEK_NUM % 7 = 0 THEN 1.5 WHEN WEEK_NUM % 11 = 0 THEN NULL ELSE 2 * auc - 1 END AS g FROM wk)
SELECT model, 'missing' AS "check", count(*) FILTER (g IS NULL) AS violations FROM o GROUP BY model UNION ALL SELECT model, 'repeated_weeks', count(*) - count(DISTINCT w) FROM o GROUP BY model UNION ALL SELECT model, 'out_of_range', count(*) FILTER (abs(g) > 1) FROM o GROUP BY model UNION ALL SELECT model, 'too_few_weeks', 0 FROM o GROUP BY model""",
        "penalty_parts": f"""WITH {PRED}, {auc('p', 'model, fold, WEEK_NUM', 'wk')}, {stability('wk', 'model, fold', 'st')} SELECT model, fold, weeks, round(mean_gini, 6) AS mean_gini, round(88 * least(0, slope), 6) AS trend_penalty, round(-0.5 * residual_std, 6) AS residual_penalty, round(stability, 6) AS stability FROM st""",
        "stability_score": f"WITH {PRED}, {auc('p', 'model, WEEK_NUM', 'wk')}, {stability('wk', 'model', 'st')} SELECT model, weeks, round(mean_gini, 6) AS mean_gini, round(slope, 6) AS slope, round(residual_std, 6) AS residual_std, round(stability, 6) AS stability FROM st",
        "review_identities": f"""WITH {PRED}, {auc('p', 'model, fold, WEEK_NUM', 'wk')}, f AS (SELECT model, fold, sum(n_rows) + CASE WHEN model = 'm3' AND fold = 2 THEN 1 ELSE 0 END AS n_rows, sum(positives) AS positives FROM wk GROUP BY model, fold), w AS (SELECT model, count(*) AS n, sum(target) AS y FROM p GROUP BY 1),
s AS (SELECT model, sum(n_rows) - any_value(n) AS rows_off, sum(positives) - any_value(y) AS positives_off FROM f JOIN w USING (model) GROUP BY 1)
SELECT model || ': n_rows is the sum of folds' AS identity, CAST(rows_off AS DOUBLE) AS residual, 0 AS missing, rows_off = 0 AS holds FROM s UNION ALL SELECT model || ': positives is the sum of folds', CAST(positives_off AS DOUBLE), 0, positives_off = 0 FROM s
UNION ALL SELECT model || ': ' || m || ' is the mean of folds', 0.0, 0, true FROM s, (VALUES ('stability'), ('mean_gini')) v(m) UNION ALL SELECT model || '/' || fold || ': stability adds up', 0.0, 0, true FROM f""",
        "release_policy": f"""WITH {PRED}, {auc('p', 'model, WEEK_NUM', 'wk')}, {stability('wk', 'model', 'st')}, c AS (SELECT 'leader''s Gini' AS "check", mean_gini >= 0.2 AND mean_gini <= 1 AS passed, mean_gini AS value FROM st WHERE model = 'm1' UNION ALL SELECT 'control''s Gini', mean_gini <= 1, mean_gini FROM st WHERE model = 'm2'
UNION ALL SELECT 'weakest Gini', mean_gini >= 0.9, mean_gini FROM st WHERE model = 'm4' UNION ALL SELECT 'leader''s rows', count(*) >= 1, count(*) FROM p WHERE model = 'm1' UNION ALL SELECT 'unknown model', false, NULL)
SELECT "check", passed, round(value, 6) AS value FROM c UNION ALL SELECT 'verdict', bool_and(passed), count(*) FILTER (WHERE passed) FROM c""",
        "evidence_faults": f"""WITH {PRED}, {auc('p', 'model, fold, WEEK_NUM', 'wk')}, {stability('wk', 'model, fold', 'st')}, n AS (SELECT sum(n_rows) AS whole, sum(n_rows) FILTER (WHERE fold = 2) AS second, sum(positives) AS y FROM wk WHERE model = 'm1')
SELECT 'm2' AS model, 3 AS fold, 'stability' AS metric, round(stability, 6) AS actual, round(stability + 0.01, 6) AS expected FROM st WHERE model = 'm2' AND fold = 3 UNION ALL SELECT 'm4', 0, 'positives', y, y - 1 FROM n
UNION ALL SELECT 'm1', 0, 'n_rows', whole + 2, whole FROM n UNION ALL SELECT 'm1', 2, 'n_rows', second + 2, second FROM n UNION ALL SELECT NULL, 310, 'population', 4, 4""",
        "parzen_ratios": f"""WITH b AS (SELECT CAST(substr(p_brand, 7) AS INT) AS k, round(avg(p_retailprice), 6) AS value, avg(p_size) AS size, round(max(p_retailprice), 2) AS price FROM part GROUP BY p_brand),
tr AS (SELECT k - 1 AS slot, (size - 1) / 49.0 AS s, (ln(price) - ln(900)) / (ln(3000) - ln(900)) AS l, 'k' || (k % 5 + 1) AS kind, row_number() OVER (ORDER BY value DESC, k) <= 7 AS good FROM b), cand AS (SELECT unnest(range(64)) AS c),
{parzen('size', 's')}, {parzen('price', 'l')},
kw AS (SELECT v, (count(*) FILTER (WHERE good AND kind = v) + 1) / 12.0 AS wg, (count(*) FILTER (WHERE NOT good AND kind = v) + 1) / 23.0 AS wr FROM tr, (VALUES ('k1'), ('k2'), ('k3'), ('k4'), ('k5')) v(v) GROUP BY v), ks AS (SELECT v, ln(wg / wr) AS gain, sum(wg) OVER (ORDER BY v) AS upto, sum(wg) OVER (ORDER BY v) - wg AS low FROM kw),
ku AS (SELECT c, (CAST('0x' || substr(md5('42:25:kind:' || c || ':0'), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u FROM cand)
SELECT size.c AS candidate, round(1 + 49 * size.u, 5) AS size, round(exp(ln(900) + price.u * (ln(3000) - ln(900))), 5) AS price, v AS kind, round(size.gain + price.gain + ks.gain, 5) AS log_ratio FROM size JOIN price USING (c) JOIN ku USING (c) JOIN ks ON ku.u > low AND ku.u <= upto""",
        "verified_predictions": f"WITH {PRED} SELECT model, fold, count(*) AS n, round(avg(prediction), 6) AS mean_prediction, sum(target) AS positives FROM p GROUP BY ALL",
        "key_parity": f"""WITH {BASE}, k AS (SELECT case_id, CASE WHEN WEEK_NUM < 200 THEN 'train' ELSE 'test' END AS split, case_id IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM base)
SELECT split, 'lines_depth1' AS block, count(*) FILTER (WHERE in_base AND NOT in_lines) AS missing, count(*) FILTER (WHERE in_lines AND NOT in_base) AS extra, 0 AS nulls FROM (SELECT *, has_lines AND NOT (split = 'train' AND case_id % 13 = 0) AS in_lines, NOT (split = 'test' AND case_id % 17 = 0) AS in_base FROM k) GROUP BY split
UNION ALL SELECT split, 'orders_depth0', count(*) FILTER (WHERE in_base AND NOT in_orders), count(*) FILTER (WHERE in_orders AND NOT in_base), count(*) FILTER (WHERE NOT in_orders) FROM (SELECT *, NOT (split = 'test' AND case_id % 19 = 0) AS in_orders, NOT (split = 'test' AND case_id % 17 = 0) AS in_base FROM k) GROUP BY split""",
        "first_cut_screen": f"""WITH {HISTORY}, a AS (SELECT case_id, count(*) AS rows__count, avg(quantityA) AS quantityA__mean, coalesce(sum(quantityA), 0) AS quantityA__sum, max(priceA) AS priceA__max, CAST(avg(shippedD) AS FLOAT) AS shippedD__mean FROM h GROUP BY case_id),
f AS MATERIALIZED (SELECT b.WEEK_NUM, b.target, a.* FROM base b LEFT JOIN a USING (case_id) WHERE WEEK_NUM BETWEEN 0 AND 339), tr AS (SELECT * FROM f WHERE WEEK_NUM < 250), bo AS (SELECT * EXCLUDE (target), CASE WHEN WEEK_NUM < 250 THEN 0 ELSE 1 END AS target FROM f),
{first_cut('t', 'tr', FEATURES)}, {first_cut('d', 'bo', FEATURES)}, m AS (SELECT name, t.gain AS target_gain, d.gain AS drift_gain, t.gain / max(t.gain) OVER () AS ts, d.gain / max(d.gain) OVER () AS ds FROM t JOIN d USING (name))
SELECT name, round(target_gain, 4) AS target_gain, round(drift_gain, 4) AS drift_gain, round(ts * greatest(0, 1 - 0.35 * ds), 4) AS score FROM m""",
        "sharded_source": f"""WITH {BASE}, l AS (SELECT l_linenumber % 3 AS k, l_linenumber - 1 AS g, l_quantity AS q, l_extendedprice AS p, nullif(l_returnflag, 'N') AS f FROM lineitem JOIN base ON l_orderkey = case_id WHERE WEEK_NUM < 200)
SELECT CASE WHEN k < 2 THEN f END AS flagM, count(*) AS n, round(sum(CASE WHEN k = 0 THEN CAST(q AS INT) WHEN k = 1 THEN q END), 2) AS quantity, round(sum(CASE WHEN k = 2 THEN p END), 2) AS price, CAST(max(g) AS BIGINT) AS last FROM l GROUP BY 1""",
        "built_catalog": """SELECT 'train' AS split, 'base' AS family, 0 AS depth, count(*) AS rows, 0 AS null_case_ids, count(DISTINCT o_orderkey) AS unique_cases, 1 AS max_rows_per_case, 5 AS n_columns, 1 AS row_groups FROM orders
UNION ALL SELECT 'train', 'lines', 1, (SELECT count(*) FROM lineitem), 0, count(*), max(n), 8, 3 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
        "written_block": f"WITH {HISTORY}, a AS (SELECT case_id, coalesce(sum(quantityA), 0) AS q FROM h GROUP BY 1) SELECT count(*) AS n_rows, round(sum(q), 2) AS quantity, min(case_id) AS first, max(case_id) AS last, 0 AS overlaps FROM a",
        "member_cases": """SELECT 'segment' AS chosen, count(*) AS n, count(DISTINCT o_custkey) AS cases, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT 'list', count(*), count(DISTINCT o_custkey), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey BETWEEN 1 AND 59""",
        "bag_comparison": "SELECT 'dealt' AS other, true AS same UNION ALL SELECT 'twice', false UNION ALL SELECT 'changed', NOT bool_or(o_orderkey = 7) FROM orders",
        "weekly_stream": f"WITH {BASE} SELECT CAST(CAST(date_trunc('week', date_decision) AS DATE) AS VARCHAR) AS week_start, count(*) AS n_rows, sum(target) AS positives FROM base GROUP BY date_trunc('week', date_decision) HAVING date_trunc('week', date_decision) + INTERVAL 14 DAY <= (SELECT max(date_decision) FROM base)",
        "reloaded_scores": f"WITH {BASE} SELECT count(*) AS n_rows, 0 AS changed, 0 AS outside FROM base WHERE WEEK_NUM BETWEEN 250 AND {WEEK_MAX}",
        "footer_catalog": " UNION ALL ".join(map(stored_table, COLUMNS)),
        "probability_metrics": f"WITH {PRED}, {suite('p', 'model', 'prediction')} SELECT * FROM suite",
        "clipped_metrics": f"WITH {PRED}, pc AS (SELECT * REPLACE (greatest(least(prediction, 1 - 1e-7), 1e-7) AS prediction) FROM p), {suite('pc', 'model', 'greatest(least(prediction, 1 - 1e-7), 1e-7)')} SELECT * FROM suite",
        "average_precision": f"WITH {PRED}, {precision('p', 'model, fold', 'ap')} SELECT model, fold, round(average_precision, 6) AS average_precision FROM ap",
        "reliability_quantile": reliability("len(list_filter(inner_edges, lambda x: prediction >= x))"),
        "reliability_qcut": reliability("len(list_filter(inner_edges, lambda x: prediction > x))"),
        "reliability_fixed": reliability(" + ".join(f"CAST(prediction >= CAST({e} AS DOUBLE) AS INT)" for e in fixed)),
        "blend_candidates": f"WITH {blended()} SELECT candidate, fold, count(*) AS n, round(avg(prediction), 6) AS mean_prediction, round(max(prediction), 6) AS max_prediction FROM b GROUP BY ALL",
        "candidate_ranking": f"""WITH {evaluated()}, s AS (SELECT candidate, avg(stability) AS mean_stability, min(stability) AS worst_stability, stddev_pop(stability) AS std_stability, avg(mean_gini) AS mean_gini, avg(slope) AS slope, avg(residual_std) AS residual_std, avg(brier) AS brier FROM ev GROUP BY candidate)
SELECT candidate, round(mean_stability, 6) AS mean_stability, round(worst_stability, 6) AS worst_stability, round(std_stability, 6) AS std_stability, round(mean_gini, 6) AS mean_gini, round(slope, 6) AS slope, round(residual_std, 6) AS residual_std, round(brier, 6) AS brier, row_number() OVER (ORDER BY mean_stability DESC, worst_stability DESC, mean_gini DESC, slope DESC, residual_std, brier, candidate <> 'm1', candidate) AS place FROM s""",
        "pooled_candidates": f"""WITH {blended()}, {auc('b', 'candidate', 'au')}, {precision('b', 'candidate', 'ap')}, lo AS (SELECT candidate, avg((prediction - target) ** 2) AS brier, avg(-ln(CASE WHEN target = 1 THEN {clip} ELSE 1 - {clip} END)) AS log_loss FROM b GROUP BY candidate)
SELECT candidate, n_rows, positives, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM au JOIN ap USING (candidate) JOIN lo USING (candidate)""",
        "prequential_choice": f"""WITH {evaluated()}, b4 AS (SELECT x.candidate, x.fold, x.stability, avg(y.stability) AS m1, min(y.stability) AS m2, avg(y.mean_gini) AS m3, avg(y.slope) AS m4, avg(y.residual_std) AS m5, avg(y.brier) AS m6 FROM ev x JOIN ev y ON x.candidate = y.candidate AND y.fold < x.fold GROUP BY ALL)
SELECT fold, candidate, round(m1, 6) AS past_mean, round(stability, 6) AS stability FROM b4 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY m1 DESC, m2 DESC, m3 DESC, m4 DESC, m5, m6, candidate <> 'm1', candidate) = 1""",
        "ablation_delta": f"""WITH {PRED}, pp AS (SELECT model AS condition, * EXCLUDE (model) FROM p UNION ALL SELECT model, * EXCLUDE (model) REPLACE (0 AS fold) FROM p), {auc('pp', 'condition, fold, WEEK_NUM', 'wk')}, {stability('wk', 'condition, fold', 'st')}, {auc('pp', 'condition, fold', 'au')}, m AS (SELECT condition, fold, stability, auc FROM st JOIN au USING (condition, fold))
SELECT m.condition, m.fold, round(m.stability, 6) AS stability, round(m.auc, 6) AS auc, round(m.stability - c.stability, 6) AS delta_stability, round(m.auc - c.auc, 6) AS delta_auc FROM m JOIN m c ON c.fold = m.fold AND c.condition = 'm1'""",
        "evidence_review": f"""WITH {PRED}, {auc('p', 'model, fold, WEEK_NUM', 'wk')}, {stability('wk', 'model, fold', 'st')} SELECT model, fold, round(mean_gini, 6) AS mean_gini, round(88 * least(0, slope), 6) AS trend_penalty, round(-0.5 * residual_std, 6) AS residual_penalty, round(stability, 6) AS stability FROM st QUALIFY row_number() OVER (PARTITION BY model ORDER BY stability, fold) = 1""",
        "prediction_correlation": f"""WITH {PRED}, w AS (SELECT case_id, {', '.join(f'{score(m)} AS {m}' for m in [*MODELS, 'flat'])} FROM p GROUP BY case_id) {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {'max(CAST(NULL AS DOUBLE))' if b == 'flat' else f'round(corr({a}, {b}), 6)'} AS correlation FROM w" for a, b in pairs)}""",
        "prediction_violations": f"""WITH {mean}, v AS (SELECT CASE WHEN case_id % 89 = 0 THEN 1 ELSE case_id END AS k, WEEK_NUM, target, {bad} AS x FROM mp)
SELECT 'null_values' AS "check", count(*) AS violations FROM v WHERE x IS NULL UNION ALL SELECT 'repeated_cases', count(*) - count(DISTINCT k) FROM v UNION ALL SELECT 'target_not_binary', 0 UNION ALL SELECT 'not_finite', count(*) FROM v WHERE isnan(x) UNION ALL SELECT 'out_of_range', count(*) FROM v WHERE x > 1 UNION ALL SELECT 'one_class_weeks', count(*) FROM (SELECT WEEK_NUM FROM v GROUP BY 1 HAVING count(DISTINCT target) <> 2) UNION ALL SELECT 'odd_weeks', count(DISTINCT WEEK_NUM) FROM v WHERE NOT ({weeks}) UNION ALL SELECT 'missing_weeks', 39 - count(DISTINCT WEEK_NUM) FROM v WHERE {weeks}""",
        "alignment_violations": f"""WITH {PRED}, a AS (SELECT DISTINCT case_id FROM p) SELECT 'm2' AS model, case_id, 'changed' AS problem FROM a WHERE case_id % 70 = 0
UNION ALL SELECT 'm3', case_id, 'missing' FROM a WHERE case_id % 60 = 0 AND case_id <> 0 UNION ALL SELECT 'm3', -case_id, 'extra' FROM a WHERE case_id % 60 = 0 AND case_id <> 0""",
        "metric_verification": """SELECT * FROM (VALUES ('m2', 'brier', false), ('m4', 'brier', true), ('m4', 'log_loss', true)) v(model, metric, missing)""",
        "sample_order": f"""WITH {mean} SELECT case_id, -case_id AS ordinal, round(prediction, 6) AS prediction FROM mp ORDER BY ordinal""",
        "catalog_profile": f"""WITH {BASE}, {LINES}, c AS (SELECT case_id, count(*) AS n FROM lines GROUP BY 1)
SELECT (SELECT count(*) FROM lines) AS n_rows, 8 AS n_columns, 0 AS null_keys, count(*) AS unique_keys, max(n) AS max_rows_per_key, (SELECT round(greatest({', '.join(f'1 - count({c}) / count(*)' for c in TIES[:-1])}), 6) FROM lines) AS max_missing_fraction, 'lines' AS file FROM c
UNION ALL SELECT count(*), 5, 0, count(DISTINCT case_id), 1, 0.0, 'base' FROM base""",
        "table_summary": """SELECT 'train' AS split, 'base' AS family, 0 AS depth, 1 AS files, (SELECT count(*) FROM orders) AS rows, 0 AS bytes, 1 AS schemas UNION ALL SELECT 'train', 'lines', 1, 2, (SELECT count(*) FROM lineitem), 0, 2""",
        "catalog_contract": """SELECT * FROM (VALUES ('contract', false, '4 files'), ('error', false, 'test: target present'), ('warning', true, 'lines_1: train_lines_1_1.parquet differs physically from train_lines_1_0.parquet')) v("check", passed, detail)""",
        "schema_diff": """WITH c AS (SELECT table_name AS t, substr(column_name, 3) AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS kind FROM information_schema.columns),
a AS (SELECT name, kind FROM c WHERE t = 'customer' AND name <> 'acctbal'), b AS (SELECT name, CASE WHEN name = 'nationkey' THEN 'string' ELSE kind END AS kind FROM c WHERE t = 'supplier' AND name <> 'acctbal')
SELECT name, CASE WHEN a.kind IS NULL THEN 'missing_left' WHEN b.kind IS NULL THEN 'missing_right' ELSE 'type:' || a.kind || '/' || b.kind END AS difference FROM a FULL JOIN b USING (name) WHERE a.kind IS DISTINCT FROM b.kind""",
        "feature_index": """SELECT * FROM (VALUES ('MONTH', 'base', 'int', false), ('WEEK_NUM', 'base', 'int', false), ('lines', 'lines_depth1', 'bigint', false), ('quantity', 'lines_depth1', 'double', false), ('price', 'orders_depth0', 'double', false), ('status', 'orders_depth0', 'string', true)) v(name, block, kind, categorical)""",
        "block_totals": """SELECT 'base' AS block, count(*) AS n_rows, 2 AS feature_columns, 0 AS categorical_columns FROM orders UNION ALL SELECT 'lines_depth1', (SELECT count(DISTINCT l_orderkey) FROM lineitem), 2, 0 UNION ALL SELECT 'orders_depth0', (SELECT count(*) FROM orders), 2, 1""",
        "fold_frame": f"""WITH {blocks} SELECT case_id, target, WEEK_NUM, MONTH, lines, quantity, price, status, CASE WHEN WEEK_NUM <= {WEEK_MAX - 8} THEN 'train' ELSE 'validation' END AS side FROM fb WHERE WEEK_NUM BETWEEN 0 AND {WEEK_MAX}""",
        "fold_sample": f"""WITH {BASE}, s AS (SELECT *, CASE WHEN WEEK_NUM < {FIRST} THEN 'train' ELSE 'validation' END AS side FROM base WHERE WEEK_NUM BETWEEN 0 AND {FIRST + 7}), k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY (case_id * 1103515245 + CASE side WHEN 'train' THEN 42 ELSE 43 END) % 2147483647, case_id) AS n FROM s)
SELECT case_id, target, WEEK_NUM, side FROM k WHERE n <= CASE side WHEN 'train' THEN 300 ELSE 200 END""",
        "frame_violations": f"""WITH {BASE} SELECT 'empty' AS "check", 0 AS violations UNION ALL SELECT 'case_id_null', 0 UNION ALL SELECT 'case_id_repeated', 0 UNION ALL SELECT 'week_outside', count(*) FROM base WHERE WEEK_NUM NOT BETWEEN 10 AND 300 UNION ALL SELECT 'target_not_binary', count(*) FROM base WHERE case_id % 90 = 0 UNION ALL SELECT 'one_class', 0""",
        "batch_scores": f"""WITH {blocks} SELECT case_id, round(1 / (1 + coalesce(lines, 0) + coalesce(quantity, 0) / 50), 9) AS prediction, CAST((row_number() OVER (ORDER BY case_id) - 1) // 1000 AS INT) AS part FROM fb""",
        "inference_frame": f"""WITH {blocks} SELECT case_id, lines, quantity, price, status FROM fb""",
        "evaluation_report": f"""WITH {mean}, x AS (SELECT 1 AS k, * FROM mp), {suite('x', 'k', 'prediction').replace('FROM p GROUP BY', 'FROM x GROUP BY')}, {auc('mp', 'WEEK_NUM', 'we')},
q AS (SELECT list_distinct(quantile_cont(prediction, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM mp), e AS (SELECT list_filter(edges, lambda x: x > list_min(edges) AND x < list_max(edges)) AS inner_edges FROM q),
bins AS (SELECT CAST(len(list_filter(inner_edges, lambda x: prediction > x)) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS n_rows, round(avg(prediction), 6) AS mean_prediction, round(avg(target), 6) AS observed_rate FROM mp, e GROUP BY 1),
wide AS (SELECT * EXCLUDE (k), (SELECT avg(target) FROM mp) AS positive_rate FROM suite),
parts AS (SELECT 'whole' AS section, 0 AS key, metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM wide) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'week', WEEK_NUM, metric, value FROM (UNPIVOT (SELECT WEEK_NUM, CAST(n_rows AS DOUBLE) AS n_rows, CAST(positives AS DOUBLE) AS positives, 2 * auc - 1 AS gini FROM we) ON n_rows, positives, gini INTO NAME metric VALUE value)
UNION ALL SELECT 'bin', bin, metric, value FROM (UNPIVOT bins ON n_rows, mean_prediction, observed_rate INTO NAME metric VALUE value))
SELECT section, key, metric, round(value, 6) AS value FROM parts""",
    }
