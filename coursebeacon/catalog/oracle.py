"""SQL counterparts of the registered queries.

They state each result in the plainest way (fan-out joins, row-wise threshold tests) so that they
check the staged Spark plans independently.
"""

from types import SimpleNamespace

from coursebeacon.operators.warning import ADVICE, DEFAULT_ADVICE

# Written out, not imported: a wrong constant in the library shows up as a difference.
WEEKS = 20
METRICS = ["total_clicks", "n_submitted", "mean_score", "completion", "active_weeks"]
WEIGHTS = {"mean_score": 0.3, "completion": 0.25, "n_submitted": 0.2, "total_clicks": 0.15, "active_weeks": 0.1}
FULL_SCALE = {"mean_score": 100.0, "completion": 1.0, "n_submitted": 10.0, "total_clicks": 20000.0, "active_weeks": 20.0}
BLEND_WEIGHTS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
TERM_STAGES = [("early", 0, 6), ("middle", 7, 12), ("late", 13, 19)]
SLIDERS = {"total_clicks": 10, "n_submitted": -20, "mean_score": 5, "completion": 15, "active_weeks": -10}
CORRELATION = ("mean_score", "learning_index")
FLOOR, LOG_FP_COST = 0.75, 2.5
SCENARIO_SEED = 7


def _records(names: str, *rows: tuple) -> list[SimpleNamespace]:
    return [SimpleNamespace(**dict(zip(names.split(), row))) for row in rows]


SCENARIOS = _records(
    "name click_factor submit_delta score_delta completion_delta active_weeks_delta fraction",
    ("baseline", 0.0, 0, 0.0, 0.0, 0, 0.3),
    ("exam_season", 0.25, 1, 2.5, 0.05, 1, 0.3),
    ("holiday", -0.3, -1, -2.0, -0.08, -1, 0.15),
    ("early_intervention", 0.15, 1, 1.5, 0.1, 1, 0.3),
    ("late_dropout", -0.5, -2, -5.0, -0.2, -2, 0.15),
)
PRESETS = _records(
    "name click_factor submit_delta score_delta completion_delta week_delta",
    ("exam_season", 1.25, 1, 3, 5, 1),
    ("holiday", 0.7, -1, -2, -8, -1),
    ("intervention", 1.15, 1, 2, 10, 1),
    ("drop_risk", 0.5, -2, -5, -20, -2),
)
VARIANTS = _records(
    "name mode strategy parameter",
    ("pass_f1", "pass", "f1", None),
    ("pass_cost", "pass", "cost", 2.5),
    ("pass_precision", "pass", "precision_floor", 0.75),
    ("risk_f1", "risk", "f1", None),
    ("risk_cost", "risk", "cost", 2.5),
)

W = range(WEEKS)


def d(x) -> str:
    return f"cast({x} as double)"


def r(x, digits=6) -> str:
    return f"round({x}, {digits})"


def r9(x) -> str:
    """For values of single rows: both engines compute them alike, only ties of a coarser rounding differ."""
    return r(x, 9)


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("#", str(k)) for k in W)


RAW = f"""
student_info as materialized (
  select id_student, code_module, code_presentation,
    case when total >= 400000 and ok then 'Distinction' when ok then 'Pass'
         when status = 'P' then 'Withdrawn' else 'Fail' end as final_result
  from (select o_custkey as id_student, substr(o_orderpriority, 1, 1) as code_module,
          cast(year(o_orderdate) as varchar) as code_presentation, o_orderstatus as status,
          o_totalprice as total,
          (o_orderstatus = 'F' and o_custkey % 4 <> 0) or (o_orderstatus = 'O' and o_custkey % 4 = 3) as ok,
          row_number() over (partition by o_custkey, substr(o_orderpriority, 1, 1), year(o_orderdate)
                             order by o_orderkey) as rn
        from orders) x where rn = 1
  union all
  select 1000000000 + s_suppkey, cast(1 + s_nationkey % 5 as varchar), '2000', 'Withdrawn' from supplier),
student_vle as materialized (
  select o_custkey as id_student, substr(o_orderpriority, 1, 1) as code_module,
    cast(year(o_orderdate) as varchar) as code_presentation, l_partkey as id_site,
    (dayofyear(l_shipdate) - 1) % 210 - 25 + 3 * cast(substr(o_orderpriority, 1, 1) as int) as date,
    cast(l_quantity as bigint) * (1 + o_custkey % 4) as sum_click
  from lineitem join orders on l_orderkey = o_orderkey),
assessments as materialized (
  select p_partkey as id_assessment, cast(1 + p_partkey % 5 as varchar) as code_module,
    cast(1995 + p_partkey % 6 as varchar) as code_presentation, p_size as weight from part),
student_assessment as materialized (
  select l_partkey as id_assessment, o_custkey as id_student,
    case when l_returnflag <> 'R' then round(l_discount * 1000) end as score
  from lineitem join orders on l_orderkey = o_orderkey),
enrol as materialized (
  select distinct id_student, code_module, code_presentation, final_result,
    cast(id_student as varchar) || '_' || code_module || '_' || code_presentation as student_uid,
    case when final_result in ('Pass', 'Distinction') then 1 else 0 end as label
  from student_info),
known_vle as (select * from student_vle where id_student in (select id_student from student_info)),
calendar as materialized (
  select code_module, code_presentation, min(date) as min_date from known_vle group by all),
course_totals as materialized (
  select code_module, code_presentation, cast(count(*) as bigint) as n_assessments
  from assessments group by all)"""

WEEKLY = """
weekly as materialized (
  select e.student_uid, cast(floor((v.date - c.min_date) / cast(7 as double)) as integer) as week_idx,
    cast(sum(v.sum_click) as bigint) as sum_click
  from known_vle v join enrol e on v.id_student = e.id_student
  join calendar c on v.code_module = c.code_module and v.code_presentation = c.code_presentation
  group by all),
scores as materialized (
  select e.student_uid, cast(count(s.score) as bigint) as n_submitted, avg(s.score) as mean_score
  from student_assessment s join enrol e on s.id_student = e.id_student group by all)"""

WEEKLY_STRICT = """
weekly as materialized (
  select e.student_uid, cast(floor((v.date - c.min_date) / cast(7 as double)) as integer) as week_idx,
    cast(sum(v.sum_click) as bigint) as sum_click
  from known_vle v join enrol e on v.id_student = e.id_student
    and v.code_module = e.code_module and v.code_presentation = e.code_presentation
  join calendar c on v.code_module = c.code_module and v.code_presentation = c.code_presentation
  group by all),
scores as materialized (
  select e.student_uid, cast(count(s.score) as bigint) as n_submitted, avg(s.score) as mean_score
  from student_assessment s join assessments a on s.id_assessment = a.id_assessment
  join enrol e on s.id_student = e.id_student
    and a.code_module = e.code_module and a.code_presentation = e.code_presentation group by all)"""

FEATURES = f"""
clicks as materialized (
  select student_uid, cast(sum(sum_click) as bigint) as total_clicks,
    cast(count(distinct case when sum_click > 0 then week_idx end) as bigint) as active_weeks,
    {_each("coalesce(sum(case when week_idx = # then sum_click end), 0) as w#")}
  from weekly group by student_uid),
features as materialized (
  select e.*, c.student_uid is not null as has_clicks,
    {_each("cast(coalesce(c.w#, 0) as double) as w#")},
    coalesce(s.n_submitted, 0) as n_submitted, coalesce(s.mean_score, 0) as mean_score,
    coalesce(c.total_clicks, 0) as total_clicks, coalesce(c.active_weeks, 0) as active_weeks,
    coalesce(t.n_assessments, 0) as n_assessments,
    case when t.n_assessments > 0
         then least({d(1)}, {d("coalesce(s.n_submitted, 0)")} / {d("t.n_assessments")}) end as completion
  from (select student_uid from clicks union select student_uid from scores) k
  join enrol e on k.student_uid = e.student_uid
  left join clicks c on c.student_uid = e.student_uid
  left join scores s on s.student_uid = e.student_uid
  left join course_totals t on t.code_module = e.code_module and t.code_presentation = e.code_presentation)"""


def share(metric: str, value: str) -> str:
    return f"coalesce({d(value)} / {d(FULL_SCALE[metric])}, {d(0)})"


def index_sql(columns: dict[str, str] | None = None) -> str:
    columns = columns or {}
    return d(100) + " * (" + " + ".join(
        f"{d(w)} * {share(m, columns.get(m, m))}" for m, w in WEIGHTS.items()) + ")"


def fallback_sql(values: dict[str, str]) -> str:
    parts = []
    for m, w in WEIGHTS.items():
        s = share(m, values[m])
        parts.append(f"{d(w)} * " + (f"least({s}, {d(1)})" if m == "total_clicks" else s))
    return f"{d(1)} / ({d(1)} + exp({d(-3.5)} * (({' + '.join(parts)}) - {d(0.5)})))"


def hash_sql(key: str, seed, bound: str) -> str:
    return f"substr(md5({key} || '|{seed}'), 1, 8) < '{bound}'"


def fraction_bound(fraction: float) -> str:
    return format(int(round(fraction * 2**32)), "08x")


def spread(k: str) -> str:
    return f"case when hi{k} - lo{k} = 0 then {d(1)} else hi{k} - lo{k} end"


LEARNERS = f"""
learners as materialized (
  select *, {index_sql()} as learning_index, {fallback_sql({m: m for m in METRICS})} as prob_pass
  from features)"""

SCALED = f"""
dataset as materialized (
  select *, case when {hash_sql("student_uid", 42, fraction_bound(0.2))} then 'test' else 'train' end as split
  from features where has_clicks),
ranges as materialized (
  select {_each("min(w#) as lo#, case when max(w#) = 0 then 1.0 else max(w#) end as hi#")} from dataset),
scaled as materialized (
  select student_uid, id_student, code_module, code_presentation, final_result, label, split, n_submitted,
    mean_score, total_clicks, active_weeks, n_assessments, completion,
    {", ".join(f"(w{k} - lo{k}) / ({spread(str(k))}) as w{k}" for k in W)}
  from dataset, ranges)"""


def _prefix(t: int) -> str:
    return "(" + " + ".join(f"w{k}" for k in range(t + 1)) + f") / {d(t + 1)}"


PROXY = f"""
means as materialized (
  select student_uid, label, unnest([{", ".join(str(t) for t in W)}]) as week,
    unnest([{", ".join(_prefix(t) for t in W)}]) as m
  from scaled where split = 'test'),
proxy as materialized (
  select student_uid, label, week,
    (m - lo) / case when hi - lo = 0 then {d(1)} else hi - lo end as score
  from means join (select week, min(m) as lo, max(m) as hi from means group by week) using (week))"""


def histogram_ctes(source: str, groups: str, score: str = "score") -> str:
    """(groups, mode, p, pos, neg) in both modes, then running sums and per-group metrics."""
    return f"""
points as materialized (
  select {groups}, {score} as score, coalesce(label, 0) as label from {source}),
hist as materialized (
  select {groups}, 'pass' as mode, score as p, sum(label) as pos, sum(1 - label) as neg
  from points group by all
  union all
  select {groups}, 'risk' as mode, 1 - score as p, sum(1 - label) as pos, sum(label) as neg
  from points group by all),
running as materialized (
  select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg from hist
  window w as (partition by {groups}, mode order by p desc rows unbounded preceding)),
totals as materialized (
  select {groups}, mode, sum(pos) as positives, sum(neg) as negatives,
    sum(pos * (p - 1) * (p - 1) + neg * p * p) / {d("(sum(pos) + sum(neg))")} as brier
  from hist group by all),
areas as materialized (
  select {groups}, mode,
    coalesce(sum({d("pos")} * cum_pos / (cum_pos + cum_neg)) / nullif({d("sum(pos)")}, 0), 0) as auc_pr,
    sum({d("neg")} * (cum_pos - pos / {d(2)})) / nullif({d("sum(pos)")} * {d("sum(neg)")}, 0) as auc_roc
  from running group by all)"""


SWEEP = f"""
grid as (select cast(i as integer) as theta_idx, {d("i")} * {d("0.01")} as theta from range(101) t(i)),
counts as materialized (
  select t.week, t.mode, g.theta_idx, g.theta, t.positives,
    coalesce(sum(h.pos) filter (h.p >= g.theta), 0) as tp,
    coalesce(sum(h.neg) filter (h.p >= g.theta), 0) as fp
  from totals t cross join grid g join hist h on h.week = t.week and h.mode = t.mode
  group by t.week, t.mode, g.theta_idx, g.theta, t.positives),
sweep as materialized (
  select *, coalesce(tp / nullif({d("(tp + fp)")}, 0), 0) as precision,
    coalesce(tp / nullif({d("positives")}, 0), 0) as recall,
    coalesce(2 * tp / nullif({d("(positives + tp + fp)")}, 0), 0) as f1
  from counts)"""


def chosen(strategy: str, parameter: float | None, mode: str) -> str:
    """One sweep row per week, as a subquery."""
    if strategy == "f1":
        return f"""(select * from sweep where mode = '{mode}'
          qualify row_number() over (partition by week order by f1 desc, theta_idx) = 1)"""
    if strategy == "cost":
        return f"""(select * from sweep where mode = '{mode}'
          qualify row_number() over (partition by week order by tp - {d(parameter)} * fp desc, theta_idx) = 1)"""
    return f"""(select * from sweep where mode = '{mode}'
          and (precision >= {d(parameter)} or theta_idx = 50)
          qualify row_number() over (partition by week order by
            case when precision >= {d(parameter)} then 0 else 1 end,
            case when precision >= {d(parameter)} then recall end desc nulls last, theta_idx) = 1)"""


METRIC_COLUMNS = ["auc_pr", "auc_roc", "f1", "precision", "recall", "brier", "theta_t"]


def _variant(v, i: int, parameter) -> str:
    return f"""select '{v.name}' as variant, {i} as ordinal, c.mode, c.week, a.auc_pr, a.auc_roc, c.f1,
      c.precision, c.recall, t.brier, c.theta as theta_t, cast(c.tp + c.fp as bigint) as warn_count,
      cast(c.tp as bigint) as tp, cast(c.fp as bigint) as fp
    from {chosen(v.strategy, parameter, v.mode)} c
    join areas a on a.week = c.week and a.mode = c.mode
    join totals t on t.week = c.week and t.mode = c.mode"""


METRICS_LOG = "metrics as materialized (" + " union all ".join(
    _variant(v, i, v.parameter) for i, v in enumerate(VARIANTS)) + ")"

DATASET = [RAW, WEEKLY, FEATURES]
LEARNER = [*DATASET, LEARNERS]
TEST = [*DATASET, SCALED]
SCORED = [*TEST, PROXY, histogram_ctes("proxy", "week")]
SWEPT = [*SCORED, SWEEP]
LOGGED = [*SWEPT, METRICS_LOG]


def q(ctes: list[str], body: str) -> str:
    return "with " + ",".join(c.strip() for c in ctes) + "\n" + body.strip()


def rounded(columns, digits=6) -> str:
    return ", ".join(f"{r(c, digits)} as {c}" for c in columns)


def _metrics_of(mode: str, strategy: str, parameter) -> str:
    return f"""select c.week, {r("a.auc_pr")} as auc_pr, {r("a.auc_roc")} as auc_roc, {r("c.f1")} as f1,
      {r("c.precision")} as precision, {r("c.recall")} as recall, {r("t.brier")} as brier,
      {r("c.theta")} as theta_t, cast(c.tp + c.fp as bigint) as warn_count,
      cast(c.tp as bigint) as tp, cast(c.fp as bigint) as fp
    from {chosen(strategy, parameter, mode)} c
    join areas a on a.week = c.week and a.mode = c.mode
    join totals t on t.week = c.week and t.mode = c.mode"""


def _at_risk(columns: dict[str, str], theta: str = d(0.94)) -> str:
    return f"""(coalesce({columns["index"]} < 50, false) or coalesce(1 - prob_pass >= {theta}, false))"""


SLIDER = {m: f"{d(m)} * ({d(1)} + {d(SLIDERS[m])} / {d(100)})" for m in METRICS}
SIM = f"""
sim as materialized (select *, {", ".join(f"{SLIDER[m]} as sim_{m}" for m in METRICS)} from learners),
simx as materialized (select *, {index_sql({m: f"sim_{m}" for m in METRICS})} as sim_learning_index from sim)"""

MARKED = f"""
marked as materialized (select *, {_at_risk({"index": "learning_index"})} as at_risk from learners),
class_means as materialized (select {", ".join(f"avg({m}) as avg_{m}" for m in METRICS)} from marked)"""


def _impact(m: str) -> str:
    dev = f"(({d(m)} - avg_{m}) / nullif(avg_{m}, 0) * {d(100)})"
    return dev


EXPLAINED = "explained as materialized (" + " union all ".join(
    f"""select student_uid, '{m}' as factor, {i} as position, {d(m)} as value, avg_{m} as class_mean,
      {_impact(m)} as deviation_pct, {d(WEIGHTS[m])} as weight, {_impact(m)} * {d(WEIGHTS[m])} as impact
    from marked, class_means where at_risk""" for i, m in enumerate(METRICS)) + ")"


def _scenario_sql(s, aggregate: bool) -> str:
    inside = hash_sql("student_uid", f"{SCENARIO_SEED}-{s.name}", fraction_bound(s.fraction))

    def pick(m, expr):
        return f"case when {inside} then {expr} else {d(m)} end"

    f = d(1.0 + s.click_factor)
    cols = {
        "total_clicks": pick("total_clicks", f"greatest({d(0)}, total_clicks * {f})"),
        "n_submitted": pick("n_submitted", f"greatest({d(0)}, least(n_submitted + {d(s.submit_delta)}, {d(10)}))"),
        "mean_score": pick("mean_score", f"greatest({d(0)}, least(mean_score + {d(s.score_delta)}, {d(100)}))"),
        "completion": pick("completion", f"case when completion is not null then greatest({d(0)}, "
                                         f"least(completion + {d(s.completion_delta)}, {d(1)})) end"),
        "active_weeks": pick("active_weeks", f"greatest({d(0)}, least(active_weeks + {d(s.active_weeks_delta)}, {d(20)}))"),
    }
    weeks = {f"w{k}": pick(f"w{k}", f"greatest({d(0)}, least(greatest({d(0)}, w{k} * {f}), {d(1)}))") for k in W}
    if aggregate:
        return f"""select '{s.name}' as scenario, {r(f"avg({cols['total_clicks']})")} as mean_click,
          {r(f"avg({cols['mean_score']})")} as mean_score, {r(f"avg({cols['completion']})")} as mean_completion,
          {r(f"avg({cols['n_submitted']})")} as mean_submits, {r(f"avg({cols['active_weeks']})")} as mean_weeks
        from scaled where split = 'test'"""
    total_weeks = " + ".join(weeks[f"w{k}"] for k in W)
    return f"""select student_uid, {inside} as in_cohort,
      {", ".join(f"{r9(e)} as {m}" for m, e in cols.items())}, {r9(total_weeks)} as scaled_clicks
    from scaled where split = 'test'"""


def _preset_inputs(p) -> dict[str, str]:
    up = p.submit_delta > 0
    submits = f"(n_submitted + {d(p.submit_delta)})"
    weeks = f"(active_weeks + {d(p.week_delta)})"
    score = f"(mean_score + {d(p.score_delta)})"
    done = f"(coalesce(completion, 0) * {d(100)} + {d(p.completion_delta)})"
    raw = {
        "total_clicks": f"total_clicks * {d(p.click_factor)}",
        "n_submitted": submits if up else f"greatest({submits}, 0)",
        "mean_score": f"least({score}, 100)" if up else f"greatest({score}, 0)",
        "completion": f"least({done}, 100)" if up else f"greatest({done}, 0)",
        "active_weeks": f"least({weeks}, 20)" if up else f"greatest({weeks}, 0)",
    }
    return {m: f"cast(floor({e}) as bigint)" for m, e in raw.items()}


REQUESTS = "requests as materialized (" + " union all ".join(
    f"""select student_uid, {", ".join(METRICS)}, '{p.name}' as preset,
      {", ".join(f"{e} as in_{m}" for m, e in _preset_inputs(p).items())}
    from scaled where split = 'test'""" for p in PRESETS) + ")"

_given = {m: (f"({d('in_completion')} / 100)" if m == "completion" else f"in_{m}") for m in METRICS}

PREDICTED = f"""
predicted as materialized (
  select l.*, case when l.prob_pass >= 0.5 then 1 else 0 end as predicted_label,
    {d("total_clicks")} / ({d("total_clicks")} + {d(2000)}) as prob_b
  from learners l)"""


def _stage_case() -> str:
    whens = " ".join(f"when week between {a} and {b} then '{n}'" for n, a, b in TERM_STAGES)
    return f"case {whens} end"


def statements() -> dict[str, str]:
    out: dict[str, str] = {}

    # calendar, weekly activity
    out["course_calendar"] = q([RAW], "select code_module, code_presentation, cast(min_date as integer) as min_date from calendar")
    out["week_index"] = q([RAW], f"""
      select v.code_module, v.code_presentation,
        cast(floor((v.date - c.min_date) / {d(7)}) as integer) as week_idx,
        cast(count(*) as bigint) as n_rows, cast(sum(v.sum_click) as bigint) as sum_click
      from known_vle v join calendar c using (code_module, code_presentation) group by all""")
    out["weekly_clicks"] = q([RAW, WEEKLY], "select student_uid, week_idx, sum_click from weekly")
    out["weekly_clicks_strict"] = q([RAW, WEEKLY_STRICT], "select student_uid, week_idx, sum_click from weekly")
    out["weekly_matrix"] = q([RAW, WEEKLY], f"""
      select student_uid, {_each("cast(coalesce(sum(case when week_idx = # then sum_click end), 0) as bigint) as w#_clicks")}
      from weekly group by student_uid""")
    out["active_weeks"] = q([RAW, WEEKLY], """
      select student_uid, cast(count(distinct week_idx) as bigint) as active_weeks
      from weekly where sum_click > 0 group by student_uid""")

    # enrolments, assessments, features
    out["label_enrolment"] = q([RAW], """
      select student_uid, id_student, code_module, code_presentation, final_result, cast(label as integer) as label from enrol""")
    out["distinct_learners"] = q([RAW], "select distinct id_student from student_info")
    out["assessment_features"] = q([RAW, WEEKLY], f"select student_uid, n_submitted, {r9('mean_score')} as mean_score from scores")
    out["course_totals"] = q([RAW], "select code_module, code_presentation, n_assessments from course_totals")
    feature = f"""select student_uid, cast(label as integer) as label, has_clicks, n_submitted,
      {r9("mean_score")} as mean_score, total_clicks, active_weeks, n_assessments, {r9("completion")} as completion
      from features"""
    out["feature_table"] = q(DATASET, feature)
    out["feature_table_strict"] = q([RAW, WEEKLY_STRICT, FEATURES], feature)
    out["model_dataset"] = q(DATASET, f"""
      select student_uid, cast(label as integer) as label, final_result, {_each("w# as w#_clicks")}, n_submitted,
        {r9("mean_score")} as mean_score, total_clicks, active_weeks, n_assessments
      from features where has_clicks""")

    # scaling and split
    out["click_scaler"] = q(TEST, " union all ".join(
        f"select {k} as week, {d(f'lo{k}')} as min, {d(f'hi{k}')} as max from ranges" for k in W))
    out["scaled_weekly"] = q(TEST, " union all ".join(
        f"select student_uid, {k} as week, w{k} as scaled from scaled" for k in W))
    out["split_sizes"] = q(TEST, "select split, cast(count(*) as bigint) as n_rows from scaled group by split")
    out["split_members"] = q(TEST, "select student_uid, split from scaled")
    out["exact_split"] = q(TEST, f"""
      select student_uid, cast(label as integer) as label,
        case when row_number() over (partition by label order by substr(md5(student_uid || '|42'), 1, 8), student_uid)
             <= round(count(*) over (partition by label) * {d(0.2)}) then 'test' else 'train' end as split
      from scaled""")
    out["real_labels"] = q(TEST, """
      select distinct student_uid, cast(label as integer) as label, final_result from scaled where split = 'test'""")
    out["aligned_labels"] = q(TEST, """
      select s.student_uid, cast(coalesce(t.label, 0) as integer) as label
      from scaled s left join (select student_uid, label from scaled where split = 'test') t using (student_uid)""")
    out["masked_prefix"] = q(TEST, f"""
      select student_uid, {", ".join((f"w{k}" if k <= 9 else d(0)) + f" as w{k}_clicks" for k in W)}
      from scaled where split = 'test'""")

    # index, risk, class view
    out["learning_index"] = q(LEARNER, f"select student_uid, {r9('learning_index')} as learning_index from learners")
    out["fallback_probability"] = q(LEARNER, f"""
      select student_uid, {r9("prob_pass")} as prob_pass, {r9("1 - prob_pass")} as prob_risk from learners""")
    risk_list = f"""student_uid, {r9("mean_score")} as mean_score, {r9("completion")} as completion, n_submitted,
      total_clicks, active_weeks, {r9("learning_index")} as learning_index"""
    out["at_risk"] = q(LEARNER, f"select {risk_list} from learners where learning_index < 50")
    out["at_risk_predicted"] = q([*LEARNER, MARKED], f"""
      select {risk_list}, {r9("1 - prob_pass")} as prob_risk from marked where at_risk""")
    out["at_risk_top"] = q([*LEARNER, MARKED], f"""
      select {risk_list}, {r9("1 - prob_pass")} as prob_risk from marked where at_risk
      order by 1 - marked.prob_pass desc nulls last, marked.learning_index desc, student_uid limit 100""")
    out["warning_kpis"] = q([*LEARNER, MARKED], f"""
      select {r("avg(learning_index)")} as mean_index,
        {r(f"count(*) filter (at_risk) / {d('count(*)')} * 100")} as at_risk_pct,
        {r(f"(1 - count(*) filter (at_risk) / {d('count(*)')}) * 100")} as predicted_pass_pct from marked""")
    out["class_kpis"] = q(LEARNER, f"""
      select cast(count(*) as bigint) as n_learners, {r("avg(label) * 100")} as pass_rate,
        {r("avg(mean_score)")} as mean_score from learners""")
    out["explain_at_risk"] = q([*LEARNER, MARKED, EXPLAINED], f"""
      select student_uid, factor, {rounded(["value", "class_mean", "deviation_pct", "weight", "impact"], 9)} from explained""")
    advice_case = "case factor " + " ".join(f"when '{k}' then '{v}'" for k, v in ADVICE.items()) + f" else '{DEFAULT_ADVICE}' end"
    out["advice"] = q([*LEARNER, MARKED, EXPLAINED], f"""
      select student_uid, factor, {r9("impact")} as impact, {advice_case} as advice from explained
      where impact is not null
      qualify row_number() over (partition by student_uid order by impact, position) = 1""")
    out["label_metric_means"] = q([*LEARNER, SIM], f"""
      select cast(label as integer) as label, {r("avg(learning_index)")} as real_mean,
        {r("avg(sim_learning_index)")} as simulated_mean,
        {r("avg(sim_learning_index) - avg(learning_index)")} as gap from simx group by label""")
    out["class_averages"] = q([*LEARNER, SIM], " union all ".join(
        f"select '{m}' as metric, {r(f'avg({m})')} as real_mean, {r(f'avg(sim_{m})')} as simulated_mean from simx"
        for m in METRICS))
    out["confusion"] = q([*LEARNER, PREDICTED], """
      select cast(label as integer) as label, cast(count(*) filter (predicted_label = 0) as bigint) as predicted_fail,
        cast(count(*) filter (predicted_label = 1) as bigint) as predicted_pass from predicted group by label""")
    out["confusion_rates"] = q([*LEARNER, PREDICTED], f"""
      select code_module, cast(sum(label * predicted_label) as bigint) as tp,
        cast(sum((1 - label) * predicted_label) as bigint) as fp,
        cast(sum(label * (1 - predicted_label)) as bigint) as fn,
        cast(sum((1 - label) * (1 - predicted_label)) as bigint) as tn,
        {r(f"coalesce(sum(label * predicted_label) / nullif({d('sum(predicted_label)')}, 0), 0)")} as precision,
        {r(f"coalesce(sum(label * predicted_label) / nullif({d('sum(label)')}, 0), 0)")} as recall,
        {r(f"coalesce(2 * sum(label * predicted_label) / nullif({d('(sum(label) + sum(predicted_label))')}, 0), 0)")} as f1,
        {r("avg(case when label = predicted_label then 1.0 else 0.0 end)")} as accuracy
      from predicted group by code_module""")
    out["index_histogram"] = q(LEARNER, f"""
      select cast(label as integer) as label,
        cast(least(floor((learning_index - lo) / ((hi - lo) / {d(30)})), 29) as integer) as bin,
        cast(count(*) as bigint) as n,
        {r9(f"any_value(lo + least(floor((learning_index - lo) / ((hi - lo) / {d(30)})), 29) * ((hi - lo) / {d(30)}))")} as bin_start
      from learners, (select min(learning_index) as lo, max(learning_index) as hi from learners) x group by label, bin""")
    out["index_quartiles"] = q(LEARNER, "select cast(label as integer) as label, cast(count(*) as bigint) as n, " + ", ".join(
        f"round(quantile_cont(learning_index, {p}), 6) as q{int(p * 100)}" for p in (0, 0.25, 0.5, 0.75, 1))
        + " from learners group by label")
    out["metric_correlation"] = q(LEARNER, f"""
      select cast(label as integer) as label, cast(count(*) as bigint) as n,
        {r(f"corr({CORRELATION[0]}, {CORRELATION[1]})")} as correlation from learners group by label""")
    out["class_weights"] = q(TEST, f"""
      select cast(label as integer) as label, cast(count(*) as bigint) as n,
        {r(f"sum(count(*)) over () / ({d(2)} * count(*))")} as weight from scaled where split = 'train' group by label""")
    out["predictions_joined"] = q([*LEARNER, PREDICTED], f"""
      select student_uid, case when has_clicks then cast(predicted_label as integer) end as predicted_label,
        {r9("case when has_clicks then prob_pass end")} as prob_pass,
        {r9("1 - coalesce(case when has_clicks then prob_pass end, 0.5)")} as prob_risk from predicted""")

    # weekly evaluation
    out["proxy_scores"] = q([*TEST, PROXY], f"select student_uid, week, {r('score', 9)} as score from proxy")
    out["average_precision_weekly"] = q(SCORED, f"select mode, week, {r('auc_pr')} as auc_pr from areas")
    out["roc_auc_weekly"] = q(SCORED, f"select mode, week, {r('auc_roc')} as auc_roc from areas")
    out["brier_weekly"] = q(SCORED, f"""
      select mode, week, cast(positives as bigint) as positives, cast(negatives as bigint) as negatives,
        {r("brier")} as brier from totals""")
    edges = f"""
edges as materialized (
  select {d("o_orderkey % 101")} * {d("0.01")} as score, cast(o_custkey % 2 as integer) as label,
    cast(o_orderkey % 3 as integer) as week from orders)"""
    out["threshold_grid_edges"] = q([edges, histogram_ctes("edges", "week"), SWEEP], f"""
      select mode, week, theta_idx, theta, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
        {rounded(["precision", "recall", "f1"])} from sweep""")
    checks = "cast(count(*) as bigint) as n_rows, 0::bigint as n_missing, 0::bigint as n_outside, true as above_chance"
    for name in ("train_gbt", "train_sequence", "train_aggregate"):
        out[name] = q(TEST, f"select {checks} from scaled where split = 'test'")
    out["train_baselines"] = q(TEST, " union all ".join(
        f"select '{name}' as run, {checks} from scaled where split = 'test'"
        for name in ("logistic_regression", "random_forest", "boosting")))
    out["tune"] = """
      select cast(row_number() over (order by reg_param, elastic_net) - 1 as integer) as ordinal, reg_param, elastic_net,
        true as above_chance
      from (values (0.0::double), (0.01), (0.1)) r(reg_param) cross join (values (0.0::double), (0.5)) e(elastic_net)"""
    share = f"""
share as materialized (
  select week, score as x, coalesce(label, 0) as y from proxy
  qualify row_number() over (partition by week, coalesce(label, 0)
                             order by substr(md5(student_uid || '|calibration-42'), 1, 8), student_uid)
    <= round(count(*) over (partition by week, coalesce(label, 0)) * {d(0.3)})),
share_points as materialized (select week, x, count(*) as n, sum(y) as s from share group by week, x),
cumulated as materialized (
  select week, x, row_number() over w as i, sum(n) over w as n, sum(s) over w as s
  from share_points window w as (partition by week order by x rows unbounded preceding)),
newton(week, step, a, b) as (
  select week, 0, {d(0)}, ln(sum(s) / {d("(sum(n) - sum(s))")}) from share_points group by week having sum(s) > 0 and sum(s) < sum(n)
  union all
  select week, step + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  from (select week, step, a, b, sum((n * q - s) * x) + a as g0, sum(n * q - s) as g1, sum(n * q * (1 - q) * x * x) + 1 as h00,
          sum(n * q * (1 - q) * x) as h01, sum(n * q * (1 - q)) as h11
        from (select w.*, x, n, s, 1 / (1 + exp(-(a * x + b))) as q from newton w join share_points p using (week) where step < 12) t
        group by week, step, a, b) g),
platt as (select week, a, b from newton where step = 12),
hull(week, i, n, s) as (
  select distinct week, 0::bigint, 0::hugeint, 0::hugeint from cumulated
  union all
  select week, best.i, best.n, best.s from (
    select h.week, arg_min({{'i': c.i, 'n': c.n, 's': c.s, 'i0': h.i}}, ({d("(c.s - h.s)")} / {d("(c.n - h.n)")}, -c.i)) as best
    from hull h join cumulated c on c.week = h.week and c.i > h.i group by h.week, h.i) z),
levels as (
  select week, i, lag(i) over w as i0, (s - lag(s) over w) / {d("(n - lag(n) over w)")} as fitted
  from hull window w as (partition by week order by i))"""
    recursive = lambda ctes, body: q(ctes, body).replace("with", "with recursive", 1)
    out["calibration_share"] = recursive([*SCORED, share], """
      select week, cast(sum(s) as bigint) as n_pos, cast(sum(n) - sum(s) as bigint) as n_neg from share_points group by week""")
    out["calibrate_platt"] = recursive([*SCORED, share], """
      select week, round(a, 5) as slope, round(b, 5) as intercept from platt""")
    out["calibrate_isotonic"] = recursive([*SCORED, share], """
      select c.week, round(c.x, 9) as score, round(l.fitted, 6) as fitted
      from cumulated c join levels l on l.week = c.week and c.i > l.i0 and c.i <= l.i""")
    calibrated = """
calibrated as materialized (
  select student_uid, week, label, case when a is null then score else 1 / (1 + exp(-(a * score + b))) end as score
  from proxy left join platt using (week)
  left join (select week as enough from proxy group by week having least(sum(label), count(*) - sum(label)) >= 5) e on enough = week)"""
    out["weekly_metrics_platt"] = recursive([*TEST, PROXY, share, calibrated, histogram_ctes("calibrated", "week")], f"""
      select week, {rounded(["auc_pr", "auc_roc", "brier"])} from areas join totals using (week, mode) where mode = 'pass'""")
    out["weekly_metrics_model"] = "select cast(i as integer) as week, true as in_range, true as adds_up from range(20) t(i)"
    out["raw_csv_features"] = out["feature_table"]
    out["incremental_clicks"] = out["weekly_clicks"]
    out["early_warning_report"] = q([*LEARNER, SCALED, PROXY, histogram_ctes("proxy", "week"), SWEEP, METRICS_LOG], f"""
      select student_uid, {r9("learning_index")} as learning_index, {r9("1 - prob_pass")} as prob_risk
      from learners where coalesce(learning_index < 50, false) or 1 - prob_pass >=
        (select theta_t from metrics where variant = 'risk_f1' order by week desc limit 1)""")
    out["predictions_round_trip"] = q(LEARNER, f"""
      select student_uid, cast(case when prob_pass >= 0.5 then 1 else 0 end as integer) as predicted_label,
        {r9("prob_pass")} as prob_pass from learners""")
    out["log_round_trip"] = q(LOGGED, """
      select run, cast(count(*) as bigint) as n, cast(sum(warn_count) as bigint) as warned,
        (select round(theta_t, 6) from metrics where variant = 'risk_cost' order by week desc limit 1) as theta
      from (select 'first' as run, * from metrics where variant = 'pass_f1'
            union all select 'second' as run, * from metrics where variant = 'risk_cost') x group by run""")
    out["rebuild_consistency"] = q(TEST, """
      select cast(count(*) as bigint) as n_predictions, 0::bigint as difference from scaled where split = 'test'""")
    passed = "case when prob_pass >= 0.5 then 1 else 0 end"
    out["memoised_scan"] = q(LEARNER, f"""
      select {d("seconds")} as seconds, cast(count(*) as bigint) as n, cast(sum({passed}) as bigint) as n_pass, n_reads
      from learners, (values (0.0, 1, 1), (5.0, 1, 1), (10.0, 0, 2)) v(seconds, least_label, n_reads)
      where {passed} >= least_label group by seconds, n_reads""")
    out["live_view"] = q(TEST, _scenario_sql(next(s for s in SCENARIOS if s.name == "exam_season"), aggregate=True).replace(
        "select ", f"select cycle, cast(cycle + 1 as bigint) as n_snapshots, cast(count(*) as bigint) as rows, ", 1).replace(
        "from scaled where", """from scaled, (values (0, '0', '4'), (1, '5', 'a'), (2, 'b', 'f')) v(cycle, low, high)
        where substr(md5(student_uid), 1, 1) between low and high and""") + " group by cycle")
    out["live_view"] = f"select cycle, n_snapshots, scenario, rows, mean_score from ({out['live_view']}) x"
    out["status_documents"] = q(TEST, f"""
      select 'exam_season' as scenario, {d(0.3)} as affected_fraction, cast(count(*) as bigint) as rows
      from scaled where split = 'test'""")
    out["source_file_times"] = "select 3::bigint as n_files, true as passed, true as readable"
    out["backfilled_columns"] = q(LEARNER, f"""
      select student_uid, {d("total_clicks")} as total_clicks, {d("null")} as mean_score, {d(0.5)} as completion from learners""")
    out["learner_lookup"] = q(TEST, f"""
      select student_uid, label, total_clicks, {r9("w0")} as w0 from scaled
      where student_uid in (select min(student_uid) from scaled union all select max(student_uid) from scaled)""")
    out["conditional_labels"] = q(TEST, """
      select 'joined' as view, s.student_uid, cast(t.label as integer) as label
      from scaled s left join (select student_uid, label from scaled where split = 'test') t using (student_uid)
      union all select 'none' as view, student_uid, 0 from scaled
      union all select 'kept' as view, student_uid, cast(1 - label as integer) from scaled""")
    out["threshold_sweep"] = q(SWEPT, f"""
      select mode, week, theta_idx, theta, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
        {rounded(["precision", "recall", "f1"])} from sweep""")
    for key, strategy, parameter in (("threshold_f1", "f1", None), ("threshold_precision_floor", "precision_floor", FLOOR),
                                     ("threshold_cost", "cost", LOG_FP_COST)):
        out[key] = q(SWEPT, " union all ".join(
            f"""select mode, week, theta, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
              {rounded(["precision", "recall", "f1"])} from {chosen(strategy, parameter, mode)} c"""
            for mode in ("pass", "risk")))
    out["weekly_metrics_pass"] = q(SWEPT, _metrics_of("pass", "f1", None))
    out["weekly_metrics_risk"] = q(SWEPT, _metrics_of("risk", "f1", None))
    full = f"variant, cast(ordinal as integer) as ordinal, mode, week, {rounded(METRIC_COLUMNS)}, warn_count, tp, fp"
    out["variant_comparison"] = q(LOGGED, f"select {full} from metrics")
    out["last_week_comparison"] = q(LOGGED, f"""
      select {full} from metrics qualify row_number() over (partition by variant order by metrics.week desc) = 1""")
    best = " union all ".join(
        f"""(select '{label}' as criterion, variant, {r(d(column))} as value from metrics where week = {WEEKS - 1}
             order by metrics.{column} {way}, ordinal limit 1)"""
        for label, column, way in (("highest_auc_pr", "auc_pr", "desc"), ("highest_precision", "precision", "desc"),
                                   ("highest_f1", "f1", "desc"), ("fewest_fp", "fp", "asc")))
    out["best_variants"] = q(LOGGED, best)
    out["calibration_guard"] = q(SCORED, """
      select mode, week, least(positives, negatives) >= 5 as calibratable from totals""")
    out["reliability_curve"] = q(SCORED, f"""
      select week, cast(least(floor(p * 10), 9) as integer) as bin, cast(sum(pos + neg) as bigint) as n,
        {r(f"sum(p * (pos + neg)) / {d('sum(pos + neg)')}")} as mean_score,
        {r(f"sum(pos) / {d('sum(pos + neg)')}")} as observed_rate
      from hist where mode = 'risk' group by all""")

    # logs
    out["latest_per_week"] = q(LOGGED, f"""
      select {full} from metrics qualify row_number() over (partition by week order by metrics.ordinal desc) = 1""")
    out["latest_threshold"] = q(LOGGED, """
      select week, theta_t, variant from metrics order by week desc, ordinal desc limit 1""")
    out["max_tp_fp"] = q(LOGGED, "select week, max(tp) as tp, max(fp) as fp from metrics group by week")
    stage_sql = f"""(select variant, {_stage_case()} as stage, * exclude (variant) from metrics
      union all select variant, 'all' as stage, * exclude (variant) from metrics) s"""
    out["stage_means"] = q(LOGGED, f"""
      select variant, stage, {", ".join(f"{r(f'avg({m})')} as {m}" for m in ("auc_pr", "auc_roc", "f1", "precision", "recall"))}
      from {stage_sql} group by variant, stage""")
    out["metric_series"] = q(LOGGED, " union all ".join(
        f"select week, variant, '{c}' as series, {r(d(c))} as value from metrics"
        for c in ("auc_pr", "auc_roc", "f1", "brier", "theta_t", "warn_count", "tp", "fp")))
    out["numbered_weeks"] = q(LOGGED, """
      select variant, cast(row_number() over (partition by variant order by metrics.week) - 1 as integer) as week, tp, fp from metrics""")

    # what-if
    out["whatif_class"] = q([*LEARNER, SIM], f"""
      select student_uid, {", ".join(f"{r9(f'sim_{m}')} as sim_{m}" for m in METRICS)},
        {r9("learning_index")} as learning_index, {r9("sim_learning_index")} as sim_learning_index from simx""")
    out["simulated_pass_rate"] = q(LEARNER, f"""
      select {r("avg(label) * 100")} as pass_rate, {r(f"avg(label) * 100 + {(SLIDERS["mean_score"] + SLIDERS["completion"]) / 2}")} as simulated_pass_rate,
        {r(f"abs({d((SLIDERS["mean_score"] + SLIDERS["completion"]) / 2)})")} as twin_gap from learners""")
    for s in SCENARIOS:
        out[f"scenario_{s.name}"] = q(TEST, _scenario_sql(s, aggregate=False))
    out["snapshot_means"] = q(TEST, " union all ".join(_scenario_sql(s, aggregate=True) for s in SCENARIOS))
    out["student_presets"] = q([*TEST, REQUESTS], f"""
      select student_uid, preset, {", ".join(f"in_{m}" for m in METRICS)} from requests""")
    simulated = fallback_sql(_given)
    given = ", ".join(f"{r9(d('in_' + m))} as {m}" for m in METRICS)
    out["history_round_trip"] = q([*TEST, REQUESTS], f"""
      select student_uid as id_student, {given}, {r9("round_even(p, 4)")} as prob_pass, {r9("round_even(1 - p, 4)")} as prob_risk
      from (select *, {simulated} as p from requests) x""")
    out["history_csv_round_trip"] = q([*TEST, REQUESTS], f"""
      select student_uid || ',x' as id_student, {given}, {r9("p")} as prob_pass, cast(null as double) as prob_risk
      from (select *, {simulated} as p from requests) x""")
    out["learner_whatif"] = q([*TEST, REQUESTS], f"""
      select student_uid, preset, {r9("p")} as prob_pass, case when p > 0.5 then 1 else 0 end as predicted_label,
        {r9("1 - p")} as prob_risk, 1 - p >= 0.94 as alert
      from (select *, {simulated} as p from requests) x""")
    rows = []
    for m in METRICS:
        real = f"(coalesce({d(m)}, 0) / {d(FULL_SCALE[m])})"
        sim = f"({d(_given[m])} / {d(FULL_SCALE[m])})"
        rows.append(f"""select student_uid, preset, '{m}' as metric, {r9(f"{real} * 100")} as real_pct,
          {r9(f"{sim} * 100")} as simulated_pct, {r9(f"({sim} - {real}) * 100")} as delta_pct from requests""")
    out["twin_delta"] = q([*TEST, REQUESTS], " union all ".join(rows))
    out["weekly_trend"] = q(TEST, " union all ".join(
        f"""select student_uid, {k + 1} as week, w{k} as real_clicks,
          w{k} * (total_clicks * {d(1.25)} / greatest({d('total_clicks')}, 1)) as simulated_clicks
        from scaled where split = 'test'""" for k in W))
    out["learner_profile"] = q(TEST, " union all ".join(
        [f"select student_uid, '{m}' as series, 0 as week, coalesce({d(m)}, 0) as value from scaled" for m in METRICS]
        + [f"select student_uid, 'weekly_clicks' as series, {k + 1} as week, w{k} as value from scaled" for k in W]))

    # blending
    blend_ctes = [*LEARNER, PREDICTED, f"""
    tried as materialized (
      select label, ordinal, weight, weight * prob_pass + ({d(1)} - weight) * prob_b as score
      from predicted, (select cast(unnest([{", ".join(str(i) for i in range(len(BLEND_WEIGHTS)))}]) as integer) as ordinal,
                         cast(unnest([{", ".join(str(w) for w in BLEND_WEIGHTS)}]) as double) as weight) w)""",
        histogram_ctes("tried", "ordinal, weight"), f"""
    blended as materialized (
      select ordinal, weight, a.auc_pr, a.auc_roc, f1, 0.6 * auc_pr + 0.4 * coalesce(auc_roc, 0) as model_score
      from areas a join (
        select ordinal, coalesce(2 * sum(label * (score >= 0.5)::int)
            / nullif({d("(sum(label) + sum((score >= 0.5)::int))")}, 0), 0) as f1
        from tried group by ordinal) f using (ordinal) where mode = 'pass')"""]
    out["blend_search"] = q(blend_ctes, f"""
      select ordinal, weight, {rounded(["auc_pr", "auc_roc", "f1", "model_score"])} from blended""")
    out["blend_predictions"] = q(blend_ctes, f"""
      select student_uid, case when p >= 0.5 then 1 else 0 end as predicted_label, {r9("p")} as prob_pass
      from (select student_uid, weight * prob_pass + ({d(1)} - weight) * prob_b as p
            from predicted, (select weight from blended order by model_score desc, ordinal limit 1) b) x""")
    out.update(_stream_statements())
    return out


def _stream_statements() -> dict[str, str]:
    """The batch results the streams must end up with."""
    weekly = """
    events_weekly as materialized (
      select user_id, event_type, time_bucket(interval '7 days', ts, timestamp '1970-01-01 00:00:00') as start,
        count(*) as n, sum(value) as total from events group by all)"""
    exam = next(s for s in SCENARIOS if s.name == "exam_season")
    theta = chosen("f1", None, "risk")
    series = """
    learner_week as materialized (
      select v.id_student, cast(floor((v.date - c.min_date) / cast(7 as double)) as integer) as wk, sum(v.sum_click) as s
      from known_vle v join calendar c using (code_module, code_presentation) group by all),
    learner_series as materialized (
      select l.id_student, g.t, coalesce(sum(w.s) filter (where w.wk = g.t), 0) as s,
        cast(coalesce(sum(w.s) filter (where w.wk between 0 and g.t), 0) as double) / (g.t + 1) as mean
      from (select distinct id_student from learner_week) l, (select cast(i as integer) as t from range(20) r(i)) g
      left join learner_week w on w.id_student = l.id_student group by l.id_student, g.t),
    last_weeks as (
      select id_student, coalesce(max(wk) filter (where wk between 0 and 19), -1) as last_week from learner_week group by id_student),
    bounds as (select t, min(mean) as low, max(mean) as high from learner_series group by t)"""
    weekly_events = q([weekly], f"""
      select user_id, event_type, strftime(start, '%Y-%m-%d') as week_start, cast(n as bigint) as n_events,
        {r("total")} as total_value from events_weekly""")
    alerts = q(SWEPT, f"""
      select student_uid, week, {r9("1 - score")} as prob_risk, theta as theta_t,
        1 - score >= theta as alert
      from proxy join {theta} c using (week)""")
    return {
        "stream_event_windows": weekly_events,
        "stream_compacted": weekly_events,
        "stream_running_alerts": alerts,
        "stream_learner_state": q([*SWEPT, series], f"""
          select x.id_student, weeks, last_week, {r9("risk")} as prob_risk, risk >= theta as at_risk
          from (select l.id_student, l.last_week, 1.0 - (s.mean - low) / (case when high = low then 1 else high - low end) as risk, theta
                from last_weeks l left join learner_series s on s.id_student = l.id_student and s.t = l.last_week
                left join bounds b on b.t = l.last_week left join {theta} c on c.week = l.last_week) x
          join (select id_student, string_agg(cast(s as varchar), ',' order by t) as weeks
                from learner_series group by id_student) y on x.id_student = y.id_student"""),
        "stream_weekly": weekly_events,
        "stream_rescore": q([*TEST], f"""
          select student_uid, case when p > 0.5 then 1 else 0 end as predicted_label, {r9("p")} as prob_pass
          from (select student_uid, {fallback_sql({m: m for m in METRICS})} as p from scaled where split = 'test') x"""),
        "stream_snapshot": q(TEST, _scenario_sql(exam, aggregate=True)),
        "stream_status": q(TEST, f"""
          select '{exam.name}' as scenario, {d(exam.fraction)} as affected_fraction, cast(count(*) as bigint) as rows
          from scaled where split = 'test'"""),
        "stream_alerts": alerts,
        "stream_learner_weeks": q([RAW], f"""
          select v.id_student, cast(floor((v.date - c.min_date) / {d(7)}) as integer) as week_idx,
            cast(sum(v.sum_click) as bigint) as sum_click
          from known_vle v join calendar c using (code_module, code_presentation) group by all"""),
    }
