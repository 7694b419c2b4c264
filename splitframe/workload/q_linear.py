"""Linear models: steps unrolled in SQL, scores, baselines, whole runs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..operators.metrics import accuracy, curve_table
from ..operators.prep import hashed_train_test_split, recode_label_pm1
from ..plans.linear import PRIME, ROUNDS, LinearModel, draw_keys, lr_fit, svm_fit
from ..plans.runs import RunOptions, resume_linear, run_linear
from ..spec import Party
from .fixtures import FEATURES_A, SQL_A_SCALED, SQL_E, scaled_a, table, wide_e
from .registry import query, rnd, scratch, sql_rnd

SIGMOID = "1.0E0 / (1.0E0 + exp(-({z})))"


def _z(prefix: str = "w_") -> str:
    return " + ".join(f"{c} * {prefix}{c}" for c in FEATURES_A)


def steps_sql(steps: list[tuple[float, float, str]], residual: str, source: str = "s") -> str:
    """CTEs w0, w1, ...: gradient steps as (shrink, rate, row filter) from zero weights."""
    out = ["w0 as (select " + ", ".join(f"0.0E0 as w_{c}" for c in FEATURES_A) + ")"]
    for t, (shrink, rate, rows) in enumerate(steps, start=1):
        sums = ", ".join(f"{shrink!r} * any_value(w_{c}) - {rate!r} / count(*) * sum({c} * r) as w_{c}" for c in FEATURES_A)
        inner = f"select *, {residual.format(z=_z())} as r from {source}, w{t - 1} where {rows}"
        out.append(f"w{t} as (select {sums} from ({inner}))")
    return ", ".join(out)


def _weights(t: int) -> str:
    return " union all ".join(f"select '{c}' as feature, {sql_rnd(f'w_{c}')} as weight from w{t}" for c in FEATURES_A)


def lr_steps_sql(n: int, lr: float, act: str = SIGMOID, lambda_: float = 0.0) -> str:
    steps = [(1.0 - lambda_, lr / t, "true") for t in range(1, n + 1)]
    return f"with {SQL_A_SCALED}, {steps_sql(steps, f'({act}) - y')} {_weights(n)}"


LR_TWO_STEPS = lr_steps_sql(2, 0.1)


def _weight_rows(spark, model):
    return model.weight_table(spark).select("feature", rnd("weight").alias("weight"))


@query("lr_fit", lr_steps_sql(3, 0.1, lambda_=0.01))
def _(spark, sf):
    return _weight_rows(spark, lr_fit(scaled_a(spark, sf), FEATURES_A, n_epochs=3, lambda_=0.01))


_THIRDS = [(1.0, 0.1 / e, f"batch = {b}") for e in (1, 2) for b in range(3)]


@query(
    "lr_fit_batches",
    f"""with {SQL_A_SCALED},
    b as (select *, (row_number() over (order by id) - 1) // (count(*) over () // 3 + 1) as batch from s),
    {steps_sql(_THIRDS, f'({SIGMOID}) - y', 'b')} {_weights(6)}""",
)
def _(spark, sf):
    data = scaled_a(spark, sf)
    size = data.count() // 3 + 1
    return _weight_rows(spark, lr_fit(data, FEATURES_A, n_epochs=2, batch_size=size, order_by=["id"]))


@query("xt_residual", f"with {SQL_A_SCALED} " + " union all ".join(f"select '{c}' as feature, {sql_rnd(f'sum({c} * (0.5E0 - y)) / count(*)')} as v from s" for c in FEATURES_A))
def _(spark, sf):
    from ..plans.linear import residual_sums

    model = LinearModel(FEATURES_A, "logistic", None, 0.0, np.zeros((5, 1)))
    sums, rows = residual_sums(scaled_a(spark, sf), model, "y")
    values = [(f, float(sums[i, 0] / rows)) for i, f in enumerate(FEATURES_A)]
    return spark.createDataFrame(values, "feature string, v double").select("feature", rnd("v").alias("v"))


_SOFT_STEPS = f"""with {SQL_E}, n as (select count(distinct i) as n from e), c as (select distinct y as c from e),
w1 as (select j, c, -(0.1E0 / any_value(n.n)) * sum(v * (1.0E0 / (select count(*) from c) - case when y = c then 1 else 0 end)) as w from e, c, n group by j, c),
z as (select i, y, w1.c, sum(v * w) as z from e join w1 using (j) group by i, y, w1.c),
p as (select i, y, c, exp(z) / sum(exp(z)) over (partition by i) as p from z),
g as (select e.j, p.c, sum(e.v * (p.p - case when p.y = p.c then 1 else 0 end)) as g from e join p on e.i = p.i group by e.j, p.c)
select 'x' || w1.j as feature, cast(w1.c as integer) as cls, {sql_rnd('w - 0.05E0 / n.n * g')} as weight from w1 join g on w1.j = g.j and w1.c = g.c, n"""


@query("lr_fit_multiclass", _SOFT_STEPS)
def _(spark, sf):
    names = [f"x{j}" for j in range(64)]
    model = lr_fit(wide_e(spark, sf), names, "label", classes=10, n_epochs=2)
    table_ = model.weight_table(spark)
    return table_.select("feature", "cls", rnd("weight").alias("weight"))


@query("lr_fit_array", _SOFT_STEPS)
def _(spark, sf):
    model = lr_fit(table(spark, sf, "embeddings"), [f"x{j}" for j in range(64)], "label", classes=10, n_epochs=2, values="embedding")
    return model.weight_table(spark).select("feature", "cls", rnd("weight").alias("weight"))


# Fixed weights for scoring queries.
WEIGHTS = {"c0": -0.8, "c1": 0.3, "p0": 1.7, "p1": -0.25, "p2": 0.9}


def _model(objective="logistic", split_col=2):
    return LinearModel(FEATURES_A, objective, None, 0.0, np.array([[WEIGHTS[c]] for c in FEATURES_A]), split_col)


def _dot(columns):
    return " + ".join(f"{c} * {WEIGHTS[c]!r}E0" for c in columns)


@query(
    "lr_score_split",
    f"""with {SQL_A_SCALED} select id, {sql_rnd(_dot(FEATURES_A[:2]))} as z_company, {sql_rnd(_dot(FEATURES_A[2:]))} as z_partner,
    {sql_rnd(_dot(FEATURES_A))} as z from s""",
)
def _(spark, sf):
    scored = _model().score_split(scaled_a(spark, sf))
    return scored.select("id", *[rnd(c).alias(c) for c in ("z_company", "z_partner", "z")])


@query(
    "lr_predict",
    f"""with {SQL_A_SCALED} select id, {sql_rnd(SIGMOID.format(z=_dot(FEATURES_A)))} as probability,
    case when {_dot(FEATURES_A)} > 0 then 1.0E0 else 0.0E0 end as prediction from s""",
)
def _(spark, sf):
    return _model().predict(scaled_a(spark, sf)).select("id", rnd("probability").alias("probability"), "prediction")


def _split_sql(seed: str) -> str:
    test = f"('0x' || substr(sha256(concat_ws('|', '{seed}', id)), 1, 8))::bigint < 1073741824"
    return f"tr as (select * from s where not ({test})), te as (select * from s where {test})"




@query(
    "lr_validate",
    f"""with {SQL_A_SCALED}, {_split_sql('hold')}, {steps_sql([(1.0, 0.5 / t, 'true') for t in (1, 2, 3)], f'({SIGMOID}) - y', 'tr')}
    select 'validation' as series, cast(t as integer) as step, accuracy from (""" + " union all ".join(
        f"select {t} as t, (select {sql_rnd(f'avg(case when (({_z()}) > 0) = (y = 1) then 1.0E0 else 0.0E0 end)')} from te, w{t + 1}) as accuracy" for t in (0, 2)
    ) + ")",
)
def _(spark, sf):
    train, test = hashed_train_test_split(scaled_a(spark, sf), "id", "hold")
    model = lr_fit(train, FEATURES_A, n_epochs=3, lr=0.5, validation=test, val_steps=2)
    points = curve_table(spark, model.curve)
    return points.select("series", "step", rnd("accuracy").alias("accuracy"))


@query("weights_split", f"select case when feature like 'c%' then 'company' else 'partner' end as party, feature, weight from ({LR_TWO_STEPS})")
def _(spark, sf):
    company, partner = lr_fit(scaled_a(spark, sf), FEATURES_A, n_epochs=2).weights_split(spark, 2)
    both = company.withColumn("party", F.lit("company")).unionByName(partner.withColumn("party", F.lit("partner")))
    return both.select("party", "feature", rnd("weight").alias("weight"))


# --- SVM -----------------------------------------------------------------------------------------------

_PM = SQL_A_SCALED + ", m as (select id, c0, c1, p0, p1, p2, case when y = 0 then -1.0E0 else y end as y from s)"
_HINGE = "case when y * ({z}) < 1 then -y else 0.0E0 end"


def _pm(spark, sf):
    return scaled_a(spark, sf).withColumn("y", recode_label_pm1(F.col("y")))


def _svm_steps(n: int, lam: float):
    return [(1.0 - 1.0 / t, 1.0 / (lam * t), "true") for t in range(1, n + 1)]


@query("svm_fit", f"with {_PM}, {steps_sql(_svm_steps(3, 0.5), _HINGE, 'm')} {_weights(3)}")
def _(spark, sf):
    return _weight_rows(spark, svm_fit(_pm(spark, sf), FEATURES_A, lambda_=0.5, n_steps=3, batch_size=None))


@query("hinge_sum", f"with {_PM} " + " union all ".join(f"select '{c}' as feature, {sql_rnd(f'sum(case when y * ({_dot(FEATURES_A)}) < 1 then y * {c} else 0 end)')} as v from m" for c in FEATURES_A))
def _(spark, sf):
    from ..plans.linear import residual_sums

    sums, _ = residual_sums(_pm(spark, sf), _model("hinge"), "y")
    rows = [(f, float(-sums[i, 0])) for i, f in enumerate(FEATURES_A)]
    return spark.createDataFrame(rows, "feature string, v double").select("feature", rnd("v").alias("v"))


@query("svm_predict", f"with {_PM} select id, cast(sign({_dot(FEATURES_A)}) as double) as prediction from m")
def _(spark, sf):
    return _model("hinge").predict(_pm(spark, sf)).select("id", "prediction")


def _drawn_sql(steps: int, size: int, seed: int) -> str:
    """CTE b: the rows of each step's batch, by the same permutations of the row numbers."""
    keys = ", ".join(f"({t}, {r}, {a}, {b}, {c})" for t in range(steps) for r, (a, b, c) in enumerate(draw_keys(seed, t)))
    out = [
        f"k as (select * from (values {keys}) as k(step, round, shift, times, plus))",
        "n as (select count(*) as n from m)",
        "p0 as (select m.*, step, x from (select *, row_number() over (order by id) - 1 as x from m) as m, (select distinct step from k))",
    ]
    coin = f"(greatest(x, other) % {PRIME} * times + plus) % {PRIME} < {PRIME // 2}"
    for r in range(ROUNDS):
        pairs = f"select p.*, times, plus, (shift % n - x + n) % n as other from p{r} as p join k on p.step = k.step and k.round = {r}, n"
        out.append(f"p{r + 1} as (select * exclude (x, times, plus, other), case when {coin} then other else x end as x from ({pairs}))")
    return ", ".join([*out, f"b as (select * from p{ROUNDS} where x < {size})"])


_DRAWN_STEPS = [(shrink, rate, f"step = {t}") for t, (shrink, rate, _) in enumerate(_svm_steps(10, 0.5))]


@query("svm_fit_sampled", f"with {_PM}, {_drawn_sql(10, 64, 3)}, {steps_sql(_DRAWN_STEPS, _HINGE, 'b')} {_weights(10)}")
def _(spark, sf):
    model = svm_fit(_pm(spark, sf), FEATURES_A, lambda_=0.5, n_steps=10, batch_size=64, seed=3)
    return _weight_rows(spark, model)


# --- baselines and whole runs ------------------------------------------------------------------------------


# Fixed value: the keyed test rows, a quarter of 32 bits.
_HELD = "('0x' || substr(sha256(concat_ws('|', 'hold', id)), 1, 8))::bigint < 1073741824"


def newton_sql(steps: int = 9) -> str:
    """CTEs of Newton steps from zero weights; each solves six equations by elimination."""
    n = len(FEATURES_A) + 1
    parts = [f"x as materialized (select id, y, unnest([{', '.join(FEATURES_A)}, 1.0E0]) as v, unnest(range({n})) as i from s where not ({_HELD}))"]
    parts.append(f"w0 as (select i, 0.0E0 as w from range({n}) as t(i))")
    for t in range(steps):
        parts.append(f"z{t} as materialized (select x.id, 1.0E0 / (1.0E0 + exp(-sum(v * w))) as p from x join w{t} using (i) group by x.id)")
        parts.append(
            f"""h{t}_0 as materialized (select a.i, b.i as j, sum(a.v * b.v * p * (1 - p)) as m from x a join x b using (id) join z{t} using (id) group by 1, 2
            union all select i, {n}, sum(v * (y - p)) from x join z{t} using (id) group by 1)"""
        )
        for k in range(n):
            parts.append(
                f"""h{t}_{k + 1} as materialized (select c.i, c.j, case when c.i = {k} then c.m / p.m else c.m - l.m * r.m / p.m end as m
                from h{t}_{k} c join h{t}_{k} r on r.i = {k} and r.j = c.j join h{t}_{k} l on l.j = {k} and l.i = c.i, (select m from h{t}_{k} where i = {k} and j = {k}) p)"""
            )
        parts.append(f"w{t + 1} as materialized (select i, w + m as w from w{t} join h{t}_{n} using (i) where j = {n})")
    margin = " + ".join([f"{f} * (select w from w{steps} where i = {i})" for i, f in enumerate(FEATURES_A)] + [f"(select w from w{steps} where i = {n - 1})"])
    return f"""with {SQL_A_SCALED}, {', '.join(parts)}
    select avg(case when (y = 1) = ({margin} > 0) then 1.0E0 else 0.0E0 end) as accuracy, 0.0E0 as gradient from s where {_HELD}"""


@query("baseline_lr", newton_sql())
def _(spark, sf):
    from ..plans.baselines import baseline_lr

    train, test = hashed_train_test_split(scaled_a(spark, sf), "id", "hold")
    scored = baseline_lr(train, test, FEATURES_A, certify=True)
    return scored.agg(accuracy(F.col("y"), F.col("prediction")).alias("accuracy"), rnd(F.max("gradient"), 9).alias("gradient"))


@query("baseline_svm")
def _(spark, sf):
    from ..plans.baselines import baseline_svm

    train, test = hashed_train_test_split(scaled_a(spark, sf), "id", "hold")
    return baseline_svm(train, test, FEATURES_A, max_iter=10).agg(accuracy(F.col("y"), F.col("prediction")).alias("accuracy"))


def scaled_parties(spark, sf):
    both = scaled_a(spark, sf)
    return Party.of(both.select("id", "c0", "c1")), Party.of(both.select("id", "p0", "p1", "p2", "y"))


@query("lr_end_to_end", LR_TWO_STEPS)
def _(spark, sf):
    company, partner = scaled_parties(spark, sf)
    return _weight_rows(spark, run_linear(company, partner, RunOptions(seed="run", n_epochs=2, batch_size=None, unique_ids=True)).model)


@query("lr_continued", lr_steps_sql(3, 0.1))
def _(spark, sf):
    company, partner = scaled_parties(spark, sf)
    options = RunOptions(seed="run", n_epochs=1, unique_ids=True, run_dir=scratch(spark))
    run_linear(company, partner, options)
    result = run_linear(company, partner, replace(options, n_epochs=3))
    result.remove()
    return _weight_rows(spark, result.model)


@query("lr_resume", lr_steps_sql(3, 0.1))
def _(spark, sf):
    company, partner = scaled_parties(spark, sf)
    stored = {side: f"{scratch(spark)}/{side}" for side in ("company", "partner")}
    run_linear(company, partner, RunOptions(seed="run", n_epochs=1, unique_ids=True, shares_to=stored))
    return _weight_rows(spark, resume_linear(spark, stored, ["c0", "c1"], RunOptions(n_epochs=3)).model)
