"""ANSI SQL for the registered queries, over the same tables, for comparison.

Fragments are common table expressions that later ones build on.
"""

from __future__ import annotations

import math

from riskflow import contract as C
from riskflow.plans.survey_view import STEPS


def _num(x: float) -> str:
    """A literal that is read as double, not as decimal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def _survey() -> str:
    source, ctes = "customer", []
    for name, step in zip(("r", "b", "survey"), STEPS):
        ctes.append(f"{name} AS (SELECT {', '.join(step)} FROM {source})")
        source = name
    return "WITH " + ",\n".join(ctes)


SURVEY = _survey()
FEATURES = C.FEATURES
_LIST = ", ".join(FEATURES)

_TRAIN_CODES = """
CASE WHEN gender = 'Male' THEN 1 ELSE 0 END AS gender,
CASE WHEN family_history = 'Yes' THEN 1 ELSE 0 END AS family_history,
CASE sleep_duration WHEN 'Less than 5 hours' THEN 0 WHEN '5-6 hours' THEN 1
  WHEN '7-8 hours' THEN 2 ELSE 3 END AS sleep_duration"""

ENC = f"""{SURVEY},
codes AS (SELECT id, age, cgpa, academic_pressure, study_satisfaction, financial_stress,
  depression, {_TRAIN_CODES} FROM survey),
enc AS (SELECT id, depression,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)} FROM codes)"""

FILLED = f"""{ENC},
filled AS (SELECT id, depression,
  {', '.join(f'coalesce({c}, avg({c}) OVER ()) AS {c}' for c in FEATURES)} FROM enc)"""


def _logit(params: dict, zero_std_one: bool = False) -> str:
    total = _num(params["intercept"])
    for name, m, s, w in zip(FEATURES, params["means"], params["stds"], params["coefficients"]):
        total = f"({total} + ({name} - {_num(m)}) / {_num(s)} * {_num(w)})"
    return total


def _probability(params: dict) -> str:
    return f"1e0 / (1e0 + exp(-{_logit(params)}))"


P_SQL = _probability(C.STORED_PARAMETERS)
SCORED = f"""{FILLED},
prob AS (SELECT *, {P_SQL} AS p FROM filled),
scored AS (SELECT id, CAST(id % 5 AS INTEGER) AS fold, depression AS label,
  round(p, 9) AS score, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM prob)"""


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 AS {name}"


def _hash(seed: str, *keys: str, start: int = 1) -> str:
    text = " || ':' || ".join([f"'{seed}'", *keys])
    return f"CAST('0x' || substr(md5({text}), {start}, 13) AS BIGINT)"


def _uniform(seed: str, *keys: str, start: int = 1) -> str:
    return f"((CAST({_hash(seed, *keys, start=start)} AS DOUBLE) + 0.5e0) / {_num(2.0**52)})"


def _normal(seed: str, *keys: str) -> str:
    u1, u2 = _uniform(seed, *keys), _uniform(seed, *keys, start=14)
    return f"(sqrt(-2e0 * ln({u1})) * cos({_num(2 * math.pi)} * {u2}))"


def _poisson(u: str) -> str:
    term = total = math.exp(-1.0)
    arms = [f"WHEN {u} < {_num(total)} THEN 0"]
    for value in range(1, 18):
        term /= value
        total += term
        arms.append(f"WHEN {u} < {_num(total)} THEN {value}")
    return "CASE " + " ".join(arms) + " ELSE 18 END"


def _z(c: str, spread: str) -> str:
    s = f"{spread}({c}) OVER ()"
    return f"CASE WHEN {s} = 0 THEN 0e0 ELSE ({c} - avg({c}) OVER ()) / ({s}) END"


def _binary(source: str, by: str) -> str:
    """Positive-class metrics per group, unrounded."""
    return f"""
SELECT {by}, tp + tn + fp + fn AS samples,
  (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall)
    ELSE 0e0 END AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END AS recall
  FROM (SELECT {by}, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
      count(*) FILTER (label = 0 AND prediction = 0) AS tn,
      count(*) FILTER (label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (label = 1 AND prediction = 0) AS fn
    FROM {source} GROUP BY {by}))"""


def _weighted(source: str, by: str) -> str:
    """Support-weighted metrics per group, unrounded."""
    return f"""
SELECT {by}, CAST(sum(s) AS BIGINT) AS samples, sum(t) / CAST(sum(s) AS DOUBLE) AS accuracy,
  sum(s * pr) / sum(s) AS precision, sum(s * re) / sum(s) AS recall,
  sum(s * CASE WHEN pr + re > 0 THEN 2e0 * pr * re / (pr + re) ELSE 0e0 END) / sum(s) AS f1
FROM (SELECT *, CASE WHEN p > 0 THEN t / CAST(p AS DOUBLE) ELSE 0e0 END AS pr,
    CASE WHEN s > 0 THEN t / CAST(s AS DOUBLE) ELSE 0e0 END AS re
  FROM (SELECT {by}, c, count(*) FILTER (label = c) AS s, count(*) FILTER (prediction = c) AS p,
      count(*) FILTER (label = c AND prediction = c) AS t
    FROM {source}, (VALUES (0), (1)) AS classes(c) GROUP BY {by}, c)
  WHERE s + p > 0)
GROUP BY {by}"""


def _auc(source: str, by: str) -> str:
    """Mann-Whitney form with average ranks, per group, unrounded."""
    return f"""
SELECT {by}, (sum(CASE WHEN label = 1 THEN mid END) - np * (np + 1) / 2e0) / (np * nn) AS auc
FROM (SELECT *, CAST(sum(label) OVER (PARTITION BY {by}) AS DOUBLE) AS np,
    CAST(sum(1 - label) OVER (PARTITION BY {by}) AS DOUBLE) AS nn,
    rank() OVER (PARTITION BY {by} ORDER BY score)
      + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2e0 AS mid
  FROM {source})
GROUP BY {by}, np, nn"""


_M = ["accuracy", "precision", "recall", "f1", "auc"]


def _report(per_fold: str, spread: str) -> str:
    """Fold rows and their AVG and STD rows; ``per_fold`` is the body of a CTE chain."""
    def row(name: str, samples: str, fn: str) -> str:
        cells = ", ".join(_r(f"{fn}({m})" if fn else m, m) for m in _M)
        return f"SELECT {name} AS fold, {samples} AS samples, {cells} FROM per_fold"

    nothing = "CAST(NULL AS DOUBLE)"
    return f"""{per_fold}
{row("'Fold ' || (fold + 1)", 'CAST(samples AS DOUBLE)', '')}
UNION ALL {row("'AVG'", nothing, 'avg')}
UNION ALL {row("'STD'", nothing, spread)}"""


def _per_fold(ctes: str, source: str, counts: str, mixed: bool = False) -> str:
    f1 = "w.f1" if mixed else "m.f1"
    extra = f", w AS ({_weighted(source, 'fold')})" if mixed else ""
    join = " JOIN w USING (fold)" if mixed else ""
    return f"""{ctes}, m AS ({counts}), a AS ({_auc(source, 'fold')}){extra},
per_fold AS (SELECT fold, m.samples, m.accuracy, m.precision, m.recall, {f1} AS f1, a.auc
  FROM m JOIN a USING (fold){join})"""


def _cut_folds(rank: str, size: str, k: int = 5) -> str:
    return "CAST(" + " + ".join(f"CAST({rank} > ({size} * {i}) // {k} AS INTEGER)"
                                for i in range(1, k)) + " AS INTEGER)"


MESSY = f"""{SURVEY},
messy AS (SELECT id, depression,
  CASE WHEN id % 10 = 0 THEN 'abc' ELSE CAST(CAST(age AS INTEGER) AS VARCHAR) END AS age_text,
  CASE WHEN id % 13 = 0 THEN 'n/a' ELSE CAST(CAST(academic_pressure AS INTEGER) AS VARCHAR) END
    AS ap_text,
  CASE WHEN id % 9 = 0 THEN 'True' WHEN id % 9 = 1 THEN 'yes' WHEN id % 9 = 2 THEN 'YES'
    WHEN id % 9 = 3 THEN '1.7' ELSE CAST(depression AS VARCHAR) END AS label_text FROM survey)"""

_LENIENT_P = _probability(C.FALLBACK_PARAMETERS)

_KNN_GRID = "floor(({d}) * 1e9 + 0.5)"
_VECTOR_GAP = "list_sum(list_transform(list_zip(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), " \
              "lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

_LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

_ANSWER_P = _probability(C.STORED_PARAMETERS)
SERVED = f"""{SURVEY},
served AS (SELECT id, age, cgpa, academic_pressure, study_satisfaction, financial_stress,
  CASE WHEN gender = 'Male' THEN 1e0 ELSE 0e0 END AS gender,
  CASE WHEN family_history = 'Yes' THEN 1e0 ELSE 0e0 END AS family_history,
  CASE sleep_duration WHEN 'Less than 5 hours' THEN 0e0 WHEN '5-6 hours' THEN 1e0
    WHEN '7-8 hours' THEN 2e0 WHEN 'More than 8 hours' THEN 3e0 ELSE 1e0 END AS sleep_duration
  FROM survey),
checked AS (SELECT *, {_ANSWER_P} AS p, nullif(concat_ws('; ',
  {', '.join(f"CASE WHEN {c} IS NULL THEN 'no number in {c}' END" for c in C.NUMERIC_FEATURES)}),
  '') AS error FROM served)"""


def _answer(expr: str, name: str) -> str:
    return f"CASE WHEN error IS NULL THEN {expr} END AS {name}"


ANSWERS = f"""{SERVED}
SELECT id, {_answer('round(p, 6) + 0e0', 'probability')},
  {_answer('floor(p * 100)', 'percent')},
  {_answer(f"CASE WHEN p >= 0.5 THEN '{C.STATUS_HIGH}' ELSE '{C.STATUS_SAFE}' END", 'status')},
  {_answer('round(academic_pressure / 5e0, 6) + 0e0', 'ap')},
  {_answer('round(financial_stress / 5e0, 6) + 0e0', 'fs')},
  {_answer('round((3e0 - sleep_duration) / 3e0, 6) + 0e0', 'sd')},
  {_answer('round((5e0 - study_satisfaction) / 4e0, 6) + 0e0', 'ss')}, error
FROM checked"""

_BOOT_U = _uniform("42", "replicate", "id")
BOOT = f"""{SCORED},
drawn AS (SELECT replicate, id, label, prediction, {_poisson('u')} AS weight
  FROM (SELECT CAST(replicate AS INTEGER) AS replicate, id, label, prediction, {_BOOT_U} AS u
    FROM scored, range(1, {C.REPLICATES + 1}) AS reps(replicate))),
cells AS (SELECT replicate,
  sum(CASE WHEN label = 1 AND prediction = 1 THEN weight ELSE 0 END) AS tp,
  sum(CASE WHEN label = 0 AND prediction = 0 THEN weight ELSE 0 END) AS tn,
  sum(CASE WHEN label = 0 AND prediction = 1 THEN weight ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND prediction = 0 THEN weight ELSE 0 END) AS fn
  FROM drawn GROUP BY replicate),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END AS recall FROM cells),
reps AS (SELECT replicate, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy,
  CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall)
    ELSE 0e0 END AS f1, precision, recall FROM rates)"""

_BOOT_METRICS = ["accuracy", "f1", "precision", "recall"]
_RELIABILITY = f"""{BOOT},
raw AS (SELECT greatest(0e0, least(1e0, avg(accuracy) * 0.6e0 + avg(f1) * 0.4e0
  - stddev_samp(accuracy) * 2e0)) AS score FROM reps)
SELECT round(score, 6) + 0e0 AS score, CASE {' '.join(
    f"WHEN score > {_num(b)} THEN '{name}'" for b, name in C.RELIABILITY_TIERS)}
  ELSE '{C.RELIABILITY_LOWEST}' END AS tier FROM raw"""

_KNN_Z = f"""{FILLED},
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY age, id) % 5 AS INTEGER) AS fold
  FROM filled),
z AS (SELECT id, fold, depression AS label,
  {', '.join(f'{_z(c, "stddev_samp")} AS {c}' for c in FEATURES)} FROM ranked),
near AS (SELECT q.id, q.fold, q.label, b.label AS vote, row_number() OVER (PARTITION BY q.id
  ORDER BY {_KNN_GRID.format(d=' + '.join(f'(q.{c} - b.{c}) * (q.{c} - b.{c})' for c in FEATURES))},
    b.id) AS rk FROM z q JOIN z b ON q.fold <> b.fold),
voted AS (SELECT id, fold, label, avg(CAST(vote AS DOUBLE)) AS score,
  CASE WHEN avg(CAST(vote AS DOUBLE)) > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM near WHERE rk <= 5 GROUP BY id, fold, label)"""

_KNN_JOIN = f"""WITH pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS base_id, {_VECTOR_GAP} AS d2
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id),
ranked AS (SELECT query_id, base_id, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY {_KNN_GRID.format(d='d2')}, base_id) AS INTEGER) AS rank, d2 FROM pairs)
SELECT query_id, base_id, rank, {_r('sqrt(d2)', 'distance')} FROM ranked WHERE rank <= 5"""

_KNN_VOTE = f"""WITH pairs AS (
  SELECT q.vec_id AS vec_id, b.label AS vote, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY {_KNN_GRID.format(d=_VECTOR_GAP)}, b.vec_id) AS rk
  FROM embeddings q JOIN embeddings b ON q.vec_id % 2 <> b.vec_id % 2),
counts AS (SELECT vec_id, vote, count(*) AS n FROM pairs WHERE rk <= 5 GROUP BY vec_id, vote),
best AS (SELECT vec_id, vote, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, vote) AS r
  FROM counts)
SELECT vec_id, CAST(max(vote) FILTER (r = 1) AS DOUBLE) AS prediction, {_r(
    'coalesce(any_value(share), 0e0)', 'score')}
FROM best LEFT JOIN (SELECT vec_id, count(*) FILTER (vote = 1) / 5e0 AS share FROM pairs
  WHERE rk <= 5 GROUP BY vec_id) USING (vec_id) GROUP BY vec_id"""

_ROC = f"""{SCORED},
steps AS (SELECT fold, score, count(*) FILTER (label = 1) AS pos,
  count(*) FILTER (label = 0) AS neg FROM scored GROUP BY fold, score),
cum AS (SELECT fold, score AS threshold,
  sum(neg) OVER w / CAST(sum(neg) OVER (PARTITION BY fold) AS DOUBLE) AS fpr,
  sum(pos) OVER w / CAST(sum(pos) OVER (PARTITION BY fold) AS DOUBLE) AS tpr
  FROM steps WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
SELECT fold, {_r('threshold', 'threshold')}, {_r('fpr', 'fpr')}, {_r('tpr', 'tpr')} FROM cum
UNION ALL SELECT DISTINCT fold, CAST('inf' AS DOUBLE), 0e0, 0e0 FROM scored"""

_BINNED = f"""{SCORED},
bins AS (SELECT fold, label, least(floor(score * 1000), 999) AS score FROM scored)
SELECT fold, {_r('auc', 'auc')} FROM ({_auc('bins', 'fold')})"""

_FILL_MEDIAN = f"""{ENC}, med AS (SELECT {', '.join(
    f'quantile_disc({c}, 0.5) AS {c}' for c in FEATURES)} FROM enc)
SELECT id, {', '.join(_r(f'coalesce(enc.{c}, med.{c})', c) for c in FEATURES)} FROM enc, med"""

_BAD = "(coalesce(age_text = 'abc', false) OR coalesce(ap_text = 'n/a', false))"
_JITTER = C.JITTER_COLUMNS


def _long(ctes: str, source: str, cols: list[str], cells: list[str]) -> str:
    return ctes + "\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, {', '.join(cell.format(c=c) for cell in cells)} FROM {source}"
        for c in cols
    )


def _rounded_metrics(body: str, ctes: str = SCORED) -> str:
    cells = ", ".join(_r(m, m) for m in _M[:4])
    return f"{ctes} SELECT fold, samples, {cells} FROM ({body})"


def _optimal(folds: str) -> str:
    """Rows each fold's model learns from, and the mean gradient at its optimum."""
    names = ", ".join(f"('{c}')" for c in [*FEATURES, "intercept"])
    return f"""{folds} SELECT CAST(f AS INTEGER) AS fold, feature,
  (SELECT count(*) FROM folds WHERE fold <> f) AS rows, 0e0 AS gradient
FROM range(5) k(f), (VALUES {names}) n(feature)"""


# Newton steps of the calibrating sigmoid over 4,096 bins of the margins' range.
_PLATT = f"""{FILLED.replace("WITH ", "WITH RECURSIVE ", 1)},
scored AS (SELECT depression, round(ln(p / (1 - p)), 9) AS m FROM (SELECT depression, {P_SQL} AS p FROM filled)),
span AS (SELECT min(m) AS low, (max(m) - min(m)) / 4096e0 AS width FROM scored),
bins AS (SELECT avg(m) AS m, count(*) FILTER (depression = 0) AS neg, count(*) FILTER (depression = 1) AS pos
  FROM scored, span GROUP BY least(floor((m - low) / width), 4095)),
total AS (SELECT sum(neg)::DOUBLE AS n, sum(pos)::DOUBLE AS p FROM bins),
aims AS (SELECT m, neg + pos AS c, pos * (p + 1) / (p + 2) + neg / (n + 2) AS aim FROM bins, total),
newton AS (SELECT 0 AS turn, 0e0 AS a, ln((p + 1) / (n + 1)) AS b FROM total
  UNION ALL
  SELECT turn + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
    b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT turn, a, b, sum(m * (c * q - aim)) AS ga, sum(c * q - aim) AS gb, sum(m * m * c * q * (1 - q)) AS haa,
      sum(m * c * q * (1 - q)) AS hab, sum(c * q * (1 - q)) AS hbb
    FROM (SELECT *, 1e0 / (1e0 + exp(-(a * m + b))) AS q FROM newton, aims WHERE turn < 25) GROUP BY turn, a, b))
SELECT (SELECT count(*) FROM bins) AS bins, n::BIGINT AS negatives, p::BIGINT AS positives,
  {_r('a', 'slope')}, {_r('b', 'intercept')} FROM newton, total WHERE turn = 25"""


_LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_BY_FOLD = f"""WITH lines AS (SELECT {_LINE_KEYS}, CAST(l_orderkey % 5 AS INTEGER) AS fold,
  CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS l_quantity,
  CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS l_extendedprice FROM lineitem),
cells AS (SELECT fold, 'l_quantity' AS feature, l_quantity AS x FROM lines
  UNION ALL SELECT fold, 'l_extendedprice', l_extendedprice FROM lines),
held AS (SELECT h.fold, feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, stddev_pop(x) AS std_pop
  FROM (SELECT DISTINCT fold FROM lines) h JOIN cells c ON c.fold <> h.fold GROUP BY h.fold, feature),
q AS (SELECT fold, mean AS qm, std AS qs FROM held WHERE feature = 'l_quantity'),
e AS (SELECT fold, mean AS em, std AS es FROM held WHERE feature = 'l_extendedprice')"""

ORACLES: dict[str, str] = {
    "fold_moments": f"""{_BY_FOLD} SELECT fold, feature, n, {_r('mean', 'mean')}, {_r('std', 'std')},
  {_r('std_pop', 'std_pop')} FROM held""",
    "fold_approx_median": f"""{_BY_FOLD} SELECT fold, feature, n AS rows, true AS within FROM held""",
    "fill_mean_by_fold": f"""{_BY_FOLD} SELECT {_LINE_KEYS}, fold, {_r('coalesce(l_quantity, qm)', 'l_quantity')},
  {_r('coalesce(l_extendedprice, em)', 'l_extendedprice')} FROM lines JOIN q USING (fold) JOIN e USING (fold)""",
    "standardize_by_fold": f"""{_BY_FOLD} SELECT {_LINE_KEYS}, fold, {_r('(l_quantity - qm) / qs', 'l_quantity')},
  {_r('(l_extendedprice - em) / es', 'l_extendedprice')} FROM lines JOIN q USING (fold) JOIN e USING (fold)""",
    "platt_fit": _PLATT,
    "logreg_gradients": _optimal(
        f"{SURVEY}, folds AS (SELECT CAST({_hash('42', 'id')} % 5 AS INTEGER) AS fold FROM survey)"
    ),
    "logreg_balanced_gradients": _optimal(f"""{SURVEY}, t AS (SELECT id, depression,
  row_number() OVER (ORDER BY {_hash('42:flip', 'id')}, id) AS rn, count(*) OVER () AS n FROM survey),
noisy AS (SELECT id, CASE WHEN rn <= floor(n * 0.015e0) THEN 1 - depression ELSE depression END AS flipped FROM t),
ranked AS (SELECT row_number() OVER (PARTITION BY flipped ORDER BY {_hash('42', 'id')}, id) AS rn,
  count(*) OVER (PARTITION BY flipped) AS n FROM noisy),
folds AS (SELECT {_cut_folds('rn', 'n')} AS fold FROM ranked)"""),
    "survey_encoded": f"{SURVEY} SELECT id, {_TRAIN_CODES}, depression FROM survey",
    "survey_encoded_bilingual": f"""{SURVEY},
t AS (SELECT id, CASE WHEN id % 3 = 0 THEN CASE gender WHEN 'Male' THEN 'Nam'
    WHEN 'Female' THEN 'Nữ' END ELSE gender END AS gender,
  CASE WHEN id % 4 = 0 THEN CASE family_history WHEN 'Yes' THEN 'Có' ELSE 'Không' END
    ELSE family_history END AS family_history, sleep_duration FROM survey)
SELECT id, CASE WHEN gender IN ('Male', 'Nam') THEN 1 ELSE 0 END AS gender,
  CASE WHEN family_history IN ('Yes', 'Có') THEN 1 ELSE 0 END AS family_history,
  CASE sleep_duration WHEN 'Less than 5 hours' THEN 0 WHEN '5-6 hours' THEN 1
    WHEN '7-8 hours' THEN 2 WHEN 'More than 8 hours' THEN 3 ELSE 1 END AS sleep_duration FROM t""",
    "survey_token_encode": f"""{SURVEY},
t AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(gender) WHEN id % 7 = 0 THEN '1' ELSE gender END
    AS gender,
  CASE WHEN id % 5 = 0 THEN '1' WHEN id % 6 = 0 THEN 'CÓ' ELSE family_history END AS family_history,
  CASE WHEN id % 4 = 0 THEN upper(sleep_duration) WHEN id % 9 = 0 THEN 'Dưới 5 tiếng'
    WHEN id % 11 = 0 THEN 'trên 8 tiếng' ELSE sleep_duration END AS sleep_duration FROM survey)
SELECT id, CASE WHEN lower(gender) IN ('nam', 'male') THEN 1e0 ELSE 0e0 END AS gender,
  CASE WHEN lower(family_history) IN ('có', 'yes', '1') THEN 1e0 ELSE 0e0 END AS family_history,
  CASE WHEN lower(sleep_duration) LIKE '%dưới 5%' OR lower(sleep_duration) LIKE '%less than 5%'
      THEN 0e0
    WHEN lower(sleep_duration) LIKE '%5-6%' THEN 1e0
    WHEN lower(sleep_duration) LIKE '%7-8%' THEN 2e0
    WHEN lower(sleep_duration) LIKE '%trên 8%' OR lower(sleep_duration) LIKE '%more than 8%'
      THEN 3e0 ELSE 1e0 END AS sleep_duration FROM t""",
    "survey_serving_encode": f"{SERVED} SELECT id, gender, family_history, sleep_duration FROM served",
    "risk_components": f"""{FILLED} SELECT id, {_r('academic_pressure / 5e0', 'ap')},
  {_r('financial_stress / 5e0', 'fs')}, {_r('(3e0 - sleep_duration) / 3e0', 'sd')},
  {_r('(5e0 - study_satisfaction) / 4e0', 'ss')} FROM filled""",
    "csv_roundtrip_semicolon": f"{SURVEY} SELECT id, {_LIST}, depression FROM survey",
    "csv_mixed_headers": f"""{SURVEY} SELECT id, age, CASE WHEN id % 3 < 2 THEN cgpa END AS cgpa,
  academic_pressure, study_satisfaction, financial_stress, sleep_duration,
  CASE WHEN id % 3 < 2 THEN gender END AS gender, family_history, depression FROM survey""",
    "csv_roundtrip_inferred": f"""{SURVEY} SELECT id, age AS "Age", cgpa AS "CGPA",
  gender AS "Gender", depression AS "Depression" FROM survey""",
    "lenient_load": f"""{MESSY},
typed AS (SELECT id, coalesce(TRY_CAST(age_text AS DOUBLE), 20e0) AS age, 3e0 AS cgpa,
  coalesce(TRY_CAST(ap_text AS DOUBLE), 3e0) AS academic_pressure, 3e0 AS study_satisfaction,
  3e0 AS financial_stress, 1e0 AS gender, 0e0 AS family_history, 2e0 AS sleep_duration,
  CASE WHEN label_text IN ('1', 'Yes', 'yes', 'True') THEN 1 ELSE 0 END AS depression FROM messy),
p AS (SELECT *, {_LENIENT_P} AS p FROM typed)
SELECT id, age, cgpa, academic_pressure, gender, family_history, sleep_duration, depression,
  {_r('p', 'probability')}, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM p""",
    "bad_row_counts": f"""{MESSY} SELECT CASE WHEN {_BAD} THEN 'bad' ELSE 'good' END AS kind,
  sum(TRY_CAST(age_text AS DOUBLE)) AS age_sum, count(*) AS "rows" FROM messy
  GROUP BY CASE WHEN {_BAD} THEN 'bad' ELSE 'good' END""",
    "bad_row_total": f"""{MESSY} SELECT {_BAD} AS is_bad, count(*) AS "rows"
  FROM messy GROUP BY {_BAD}""",
    "label_parse": f"""{MESSY} SELECT id, CASE WHEN label_text IN ('1', 'Yes', 'yes', 'True')
  THEN 1 ELSE 0 END AS label FROM messy""",
    "coerce_label": f"""{MESSY} SELECT id,
  CAST(trunc(coalesce(TRY_CAST(label_text AS DOUBLE), 0e0)) AS INTEGER) AS label FROM messy""",
    "coerce_numeric": f"""{MESSY} SELECT id, TRY_CAST(age_text AS DOUBLE) AS age,
  coalesce(TRY_CAST(age_text AS DOUBLE), 20e0) AS age_default,
  CAST(id AS DOUBLE) AS id_double FROM messy""",
    "fill_mean": f"{FILLED} SELECT id, {', '.join(_r(c, c) for c in FEATURES)} FROM filled",
    "fill_median": _FILL_MEDIAN,
    "feature_stats": _long(ENC, "enc", FEATURES, [
        "round(avg({c}), 6) + 0e0 AS mean", "round(stddev_samp({c}), 6) + 0e0 AS std",
        "round(stddev_pop({c}), 6) + 0e0 AS std_pop", "count({c}) AS count"]),
    "exact_medians": _long("", "lineitem",
                           ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                           ["quantile_disc({c}, 0.5) AS value"]),
    "standardize_sample": f"""{FILLED} SELECT id, {', '.join(
        _r(_z(c, 'stddev_samp'), c) for c in FEATURES)} FROM filled""",
    "standardize_pop": f"""{FILLED} SELECT id, {', '.join(
        _r(_z(c, 'stddev_pop'), c) for c in FEATURES)} FROM filled""",
    "standardize_lineitem": f"""SELECT {_LINE_KEY}, {', '.join(
        _r(_z(c, 'stddev_samp'), c + '_z')
        for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} FROM lineitem""",
    "standardize_constant": f"""{SURVEY} SELECT id, 4e0 AS same, 0e0 AS same_zero,
  1e0 AS same_one FROM survey""",
    "scaler_export": _long(FILLED, "filled", FEATURES, [
        "round(avg({c}), 6) + 0e0 AS mean", "round(stddev_samp({c}), 6) + 0e0 AS std"]),
    "neighbor_params": _long(FILLED, "filled", FEATURES, [
        "'KNN' AS model", "5 AS knn_k", "'euclidean' AS metric",
        "round(avg({c}), 6) + 0e0 AS mean", "round(stddev_samp({c}), 6) + 0e0 AS std"]),
    "score_params": f"{FILLED} SELECT id, {_r(P_SQL, 'probability')} FROM filled",
    "score_fallback": f"{FILLED} SELECT id, {_r(_LENIENT_P, 'probability')} FROM filled",
    "score_details": f"""{FILLED}, prob AS (SELECT id, {P_SQL} AS p FROM filled)
SELECT id, {_r('p', 'probability')}, CAST(floor(p * 100) AS INTEGER) AS percent,
  CASE WHEN p >= 0.5 THEN '{C.STATUS_HIGH}' ELSE '{C.STATUS_SAFE}' END AS status,
  CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM prob""",
    "score_requests": ANSWERS,
    "stream_score": ANSWERS,
    "stream_score_once": ANSWERS,
    "global_rank_lineitem": f"""SELECT l_quantity, {_LINE_KEY},
  row_number() OVER (ORDER BY l_quantity, {_LINE_KEY}) AS rank FROM lineitem""",
    "global_rank_text": """SELECT source, 'doc-' || doc_id AS name,
  row_number() OVER (ORDER BY source NULLS FIRST, 'doc-' || doc_id) AS rank FROM documents""",
    "global_rank_bigint": f"""SELECT 9007199254740992 + l_orderkey AS key, {_LINE_KEY},
  row_number() OVER (ORDER BY 9007199254740992 + l_orderkey, {_LINE_KEY}) AS rank FROM lineitem""",
    "running_sum_events": """
SELECT event_id, CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY value DESC, event_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_cents,
  CAST(sum(cents) OVER (PARTITION BY event_type) AS BIGINT) AS total_cents
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
    "random_folds": f"""{SURVEY} SELECT id, CAST({_hash('42', 'id')} % 5 AS INTEGER) AS fold
  FROM survey""",
    "ordered_folds": f"""{FILLED} SELECT id,
  CAST(row_number() OVER (ORDER BY age, id) % 5 AS INTEGER) AS fold FROM filled""",
    "ordered_folds_lineitem": f"""SELECT {_LINE_KEY}, CAST(row_number() OVER (
  ORDER BY l_quantity, {_LINE_KEY}) % 5 AS INTEGER) AS fold FROM lineitem""",
    "stratified_folds": f"""{SURVEY}, t AS (SELECT id, depression,
  row_number() OVER (PARTITION BY depression ORDER BY {_hash('42', 'id')}, id) AS rn,
  count(*) OVER (PARTITION BY depression) AS n FROM survey)
SELECT id, depression, {_cut_folds('rn', 'n')} AS fold FROM t""",
    "ordered_folds_text_id": f"""{SURVEY} SELECT CAST(id AS VARCHAR) AS id, CAST(row_number() OVER (
  ORDER BY age NULLS FIRST, CAST(id AS VARCHAR)) % 5 AS INTEGER) AS fold FROM survey""",
    "stratified_folds_many": f"""WITH t AS (SELECT o_orderkey, o_custkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY {_hash('42', 'o_orderkey')}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, {_cut_folds('rn', 'n')} AS fold FROM t""",
    "class_weights_many": f"""SELECT o_orderkey, {_r(
        'count(*) OVER () * 1e0 / ((SELECT count(DISTINCT o_custkey) FROM orders)'
        ' * count(*) OVER (PARTITION BY o_custkey))', 'weight')} FROM orders""",
    "stratified_folds_toxic": f"""WITH t AS (SELECT doc_id, toxic,
  row_number() OVER (PARTITION BY toxic ORDER BY {_hash('42', 'doc_id')}, doc_id) AS rn,
  count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, {_cut_folds('rn', 'n')} AS fold FROM t""",
    "gaussian_jitter": f"""{FILLED} SELECT id, {', '.join(
        _r(f"{c} + (stddev_samp({c}) OVER ()) * 0.35e0 * {_normal(f'42:{c}', 'id')}", c)
        for c in _JITTER)} FROM filled""",
    "flip_labels": f"""{SURVEY}, t AS (SELECT id, depression,
  row_number() OVER (ORDER BY {_hash('42:flip', 'id')}, id) AS rn,
  count(*) OVER () AS n FROM survey)
SELECT id, depression, CASE WHEN rn <= floor(n * 0.015e0) THEN 1 - depression
  ELSE depression END AS flipped FROM t""",
    "class_weights": f"""{SURVEY} SELECT id, {_r(
        'count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY depression))', 'weight')}
  FROM survey""",
    "class_weights_toxic": f"""SELECT doc_id, toxic, {_r(
        'count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY toxic))', 'weight')} FROM labels""",
    "knn_join": _KNN_JOIN,
    "knn_join_blocked": _KNN_JOIN,
    "knn_classify": _KNN_VOTE,
    "cv_knn": _report(_per_fold(_KNN_Z, "voted", _weighted("voted", "fold")), "stddev_pop"),
    "confusion": f"""{SCORED} SELECT fold,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM scored GROUP BY fold""",
    "binary_metrics": _rounded_metrics(_binary("scored", "fold")),
    "weighted_metrics": _rounded_metrics(_weighted("scored", "fold")),
    "auc_exact": f"{SCORED} SELECT fold, {_r('auc', 'auc')} FROM ({_auc('scored', 'fold')})",
    "auc_overall": f"""{SCORED}, one AS (SELECT *, 0 AS g FROM scored)
SELECT {_r('auc', 'auc')} FROM ({_auc('one', 'g')})""",
    "auc_binned": _BINNED,
    "auc_lineitem": f"""WITH t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_quantity AS score, l_linenumber AS line FROM lineitem)
SELECT line, {_r('auc', 'auc')} FROM ({_auc('t', 'line')})""",
    "roc_curve": _ROC,
    "fold_report_params": _report(
        _per_fold(SCORED, "scored", _binary("scored", "fold")), "stddev_samp"),
    "fold_report_weighted": _report(
        _per_fold(SCORED, "scored", _weighted("scored", "fold")), "stddev_pop"),
    "fold_report_mixed": _report(
        _per_fold(SCORED, "scored", _binary("scored", "fold"), mixed=True), "stddev_samp"),
    "bootstrap_weights": f"""{BOOT} SELECT replicate, count(*) AS "rows",
  CAST(sum(weight) AS BIGINT) AS draws, max(weight) AS most
  FROM drawn WHERE weight > 0 GROUP BY replicate""",
    "bootstrap_metrics": f"""{BOOT} SELECT replicate, {', '.join(
        _r(m, m) for m in _BOOT_METRICS)} FROM reps""",
    "bootstrap_report": BOOT + "\n" + "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, {_r(f'avg({m})', 'mean')}, {_r(f'stddev_samp({m})', 'std')} "
        "FROM reps" for m in _BOOT_METRICS),
    "reliability_score": _RELIABILITY,
}
