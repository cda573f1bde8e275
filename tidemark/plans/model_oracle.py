"""The SQL the modelling jobs are checked against."""

from __future__ import annotations

from tidemark.config import STANDIN_WORDS, scoring_config, training_config
from tidemark.plans.check_sql import compose, flag
from tidemark.plans.model_registry import HORIZON, LABEL, PARAMS
from tidemark.schema import CATEGORICAL, IMPUTED, KEYS, NUMERIC

# Categories the stand-in tables hold; the smallest of each column is the baseline.
CATEGORIES = {
    "cust_level": range(8),
    "cust_type": (-1, 1, 2, 3, 4),
    "cust_group_type": range(4),
    "is_office_weixin": range(2),
    "sex": range(2),
    "age_group": range(2, 6),
    "prd_comp_grade_level": range(4),
}
SEED = PARAMS.seed
_KEYS = ", ".join((*KEYS, LABEL))
_DUMMIES = {f"{n}_{v}": f"(case when {n} = {v} then 1 else 0 end)" for n in CATEGORICAL for v in list(CATEGORIES[n])[1:]}


def _codes(name: str, codes: dict[str, int]) -> str:
    cases = " ".join(f"when '{word}' then {code}" for word, code in codes.items())
    return f"cast(case {name} {cases} end as bigint) as {name}"


def _six(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def _list(values) -> str:
    return ", ".join(values)


def _scaled(name: str) -> str:
    return f"case when lo_{name} = hi_{name} then {name} - lo_{name} else ({name} - mean_{name}) / dev_{name} end"


_FEATURES = [*_DUMMIES, *NUMERIC]
_VECTOR = _list([f"cast({_DUMMIES[n]} as double)" for n in _DUMMIES] + [f"coalesce({_scaled(n)}, 0.0)" for n in NUMERIC])

PARTS = {
    "later_label": f"""
        select c.cust_id, {flag("executed", "executed_date", HORIZON)}
        from cohort c left join label_lines on label_lines.cust_id = c.cust_id group by c.cust_id, c.create_date""",
    "model_rows": f"""
        select features.* exclude (sex, age_group), {_codes("sex", STANDIN_WORDS.sex_codes)},
               {_codes("age_group", STANDIN_WORDS.age_group_codes)}, cast({LABEL} as bigint) as {LABEL}
        from features join later_label using (cust_id)""",
    "filled": f"""
        select {_KEYS}, {_list(CATEGORICAL)},
               {_list(f"coalesce(cast({n} as double), avg(cast({n} as double)) over ()) as {n}" if n in IMPUTED
                      else f"cast({n} as double) as {n}" for n in NUMERIC)}
        from model_rows""",
    "stats": f"""
        select {_list(f"avg({n}) as mean_{n}, stddev_pop({n}) as dev_{n}, min({n}) as lo_{n}, max({n}) as hi_{n}"
                      for n in NUMERIC)} from filled""",
    "scaled_rows": "select * from filled cross join stats",
    "vectors": f"select cust_id, {LABEL}, [{_VECTOR}] as x from scaled_rows",
    "minority": f"select cust_id as id, x from vectors where {LABEL} = 1",
    "wanted": f"""
        select cast(floor(cast({PARAMS.over_ratio} as double) * (count(*) filter (where {LABEL} = 0))) as bigint)
               - count(*) filter (where {LABEL} = 1) as rows, count(*) filter (where {LABEL} = 1) as bases
        from vectors""",
    "near": f"""
        select a.id, b.id as other, b.x as y,
               row_number() over (partition by a.id order by list_sum(list_transform(list_zip(a.x, b.x),
                   lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.id) - 1 as place
        from minority a join minority b on b.id <> a.id
        qualify place < {PARAMS.neighbors}""",
    "bases": f"""
        select id, x, (select rows // bases from wanted) + case when row_number() over (
                   order by md5(id || '|{SEED}'), id) <= (select rows % bases from wanted) then 1 else 0 end as copies
        from minority where (select rows from wanted) > 0""",
    "draws": f"""
        select id, x, md5(id || '|' || copy || '|{SEED}') as digest
        from (select id, x, unnest(range(1, copies + 1)) as copy from bases)""",
    "drawn": """
        select d.id, list_transform(list_zip(d.x, n.y), lambda p:
                   p[1] + cast(concat('0x', substr(digest, 9, 8)) as bigint) / 4294967296.0 * (p[2] - p[1])) as x
        from draws d
        join near n on n.id = d.id
         and n.place = cast(concat('0x', substr(digest, 1, 8)) as bigint) % (select least(5, bases - 1) from wanted)""",
    "grown": f"""
        select cust_id, {LABEL}, x, 0 as is_synthetic from vectors
        union all select id, 1, x, 1 from drawn""",
    "fixed_scores": f"select cust_id, {LABEL}, (pv % 97) / 97.0 as score from model_rows",
    "sweep": f"""
        select cust_id, {LABEL}, score, threshold, cast(score > threshold as bigint) as predicted
        from fixed_scores cross join (values (cast(0.5 as double)), (0.4), (0.3)) t(threshold)""",
    "cells": f"""
        select threshold, count(*) filter (where {LABEL} = 0 and predicted = 0) as tn,
               count(*) filter (where {LABEL} = 0 and predicted = 1) as fp,
               count(*) filter (where {LABEL} = 1 and predicted = 0) as fn,
               count(*) filter (where {LABEL} = 1 and predicted = 1) as tp
        from sweep group by threshold""",
    "per_class": """
        select threshold, '0' as class, tn as hit, fn as wrong, fp as missed from cells
        union all select threshold, '1', tp, fp, fn from cells""",
    "class_scores": """
        select threshold, class, coalesce(hit / nullif(hit + wrong, 0), 0) as p,
               coalesce(hit / nullif(hit + missed, 0), 0) as r,
               coalesce(2 * hit / nullif(2 * hit + wrong + missed, 0), 0) as f, hit + missed as n from per_class""",
    "report": """
        select threshold, class, p, r, f, n from class_scores
        union all select threshold, 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp),
                         (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp from cells
        union all select threshold, 'macro avg', avg(p), avg(r), avg(f), sum(n) from class_scores group by threshold
        union all select threshold, 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n), sum(n)
                  from class_scores group by threshold""",
}

_DUMMY_SELECT = _list(f"cast({sql} as bigint) as \"{name}\"" for name, sql in _DUMMIES.items())
_SCALED_SELECT = _list(f"{_six(_scaled(n))} as {n}" for n in NUMERIC)
_SQL = {
    "label_distribution": f"""
        select count(*) filter (where {LABEL} = 0) as negatives, count(*) filter (where {LABEL} = 1) as positives,
               round(count(*) filter (where {LABEL} = 0) / count(*) filter (where {LABEL} = 1), 4) as negatives_per_positive
        from model_rows""",
    "encode_ordinals": "select cust_id, sex, age_group from model_rows",
    "mean_impute": f"select cust_id, {_list(f'{_six(n)} as {n}' for n in IMPUTED)} from filled",
    "one_hot_drop_first": f"select {_KEYS}, {_DUMMY_SELECT} from model_rows",
    "standardize": f"select {_KEYS}, {_SCALED_SELECT} from scaled_rows",
    "design_matrix": f"select {_KEYS}, {_DUMMY_SELECT}, {_SCALED_SELECT} from scaled_rows",
    "smote_oversample": f"""
        select cust_id, {LABEL}, cast(is_synthetic as bigint) as is_synthetic,
               {_list(f'{_six(f"x[{i}]")} as "{n}"' for i, n in enumerate(_FEATURES, start=1))} from grown""",
    "undersample_to_ratio": f"""
        select cust_id, {LABEL} from model_rows
        qualify {LABEL} = 1 or row_number() over (partition by {LABEL} order by md5(cust_id || '|{SEED}'), cust_id)
                <= floor(sum({LABEL}) over () / cast({PARAMS.under_ratio} as double))""",
    "train_test_split": f"""
        select cust_id, cast(cast(concat('0x', substr(md5(cust_id || '|{SEED}'), 1, 8)) as bigint) % 100
               < {PARAMS.test_percent} as bigint) as is_test from model_rows""",
    "rf_fit_predict": f"""
        select cust_id, {LABEL}, cast(1 as bigint) as score_in_range, cast(1 as bigint) as class_follows_score from model_rows
        where cast(concat('0x', substr(md5(cust_id || '|{SEED}'), 1, 8)) as bigint) % 100 < {PARAMS.test_percent}""",
    "threshold_sweep": f"select cust_id, {LABEL}, score, threshold, predicted from sweep",
    "confusion_matrix": """
        select threshold, cast(0 as bigint) as actual, tn as predicted_0, fp as predicted_1 from cells
        union all select threshold, 1, fn, tp from cells""",
    "classification_report": f"""
        select threshold, class, {_six('p')} as precision, {_six('r')} as recall, {_six('f')} as f1_score,
               cast(n as bigint) as support from report""",
    "auc": f"""
        select 'rank' as method, round(avg(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end), 6) as auc
        from (select score from fixed_scores where {LABEL} = 1) p cross join (select score from fixed_scores where {LABEL} = 0) n
        union all
        select 'hard', round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) from cells where threshold = 0.5""",
}


_LATER = {
    "score_later_day": f"""
        select cust_id, {LABEL}, cast(1 as bigint) as score_in_range, cast(1 as bigint) as class_follows_score from model_rows""",
    "evaluate_later_day": f"""
        select threshold, cast(actual as bigint) as actual, count(cust_id) as support, cast(1 as bigint) as recall_agrees,
               cast(1 as bigint) as auc_in_range
        from (values (cast(0.5 as double)), (0.4), (0.3)) t(threshold) cross join (values (0), (1)) a(actual)
        left join model_rows on {LABEL} = actual group by threshold, actual""",
}
# Categories that the held-out fifth may lack are no inputs: the inputs follow from the training rows.
_IMPORTANCES = f"""
    with seen as ({{train}}), inputs as (
        {" union all ".join(
            f"select '{n}_' || v as feature from (select distinct {n} as v from seen where {n} is not null) "
            f"where v > (select min({n}) from seen)" for n in CATEGORICAL)}
        union all select unnest([{_list(f"'{n}'" for n in NUMERIC)}]))
    select feature, cast(1 as bigint) as ranking_sound from inputs"""


def model_sql() -> dict[str, str]:
    training, later = training_config(), scoring_config()
    sql = {name: compose(text, training, PARTS) for name, text in _SQL.items()}
    sql |= {name: compose(text, later, PARTS) for name, text in _LATER.items()}
    train = compose(
        f"""select * from model_rows
            where cast(concat('0x', substr(md5(cust_id || '|{SEED}'), 1, 8)) as bigint) % 100 >= {PARAMS.test_percent}""",
        training,
        PARTS,
    )
    return sql | {"feature_importance_rank": _IMPORTANCES.replace("{train}", train)}
