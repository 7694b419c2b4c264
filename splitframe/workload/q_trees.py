"""Gradient sums, splits and boosted trees.

The SQL side never sees bins: it compares raw values with cut points and sums on both sides.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import splits
from ..operators.binning import array_edges, bin_label, quantile_edges
from ..plans.boosting import GBTModel, TreeNode, gbt_fit
from ..plans.runs import RunOptions, resume_trees, run_trees
from .fixtures import FEATURES_A, FEATURES_D, SQL_A, SQL_C, SQL_D, SQL_E, joined, parties, stored, table, wide_e
from .q_bins import COMPANY_COLS, PARTNER_COLS, edges_a_sql, edges_sql
from .registry import query, rnd, scratch, sql_rnd

K = 20
LOGISTIC_GH = ("1.0E0 / (1.0E0 + exp(-score)) - y", "1.0E0 / (1.0E0 + exp(-score)) * (1.0E0 - 1.0E0 / (1.0E0 + exp(-score)))")
PIECEWISE_GH = (
    "greatest(0.0E0, least(1.0E0, score + 0.5E0)) - y",
    "greatest(0.0E0, least(1.0E0, score + 0.5E0)) * (1.0E0 - greatest(0.0E0, least(1.0E0, score + 0.5E0)))",
)
SQUARED_GH = ("2.0E0 * (score - y) / count(*) over ()", "2.0E0 / count(*) over ()")


def level_sql(tag: str, rows: str, features: list[str], lam: float, first: int) -> str:
    """CTEs for one level: candidates c, best cut b per node, rows r one level down.

    ``rows`` has id, features, g, h, node. Nodes from ``first`` up are open.
    """
    long = " union all ".join(f"select node, '{f}' as feature, {i} as fi, {f} as x, g, h from {rows} where node >= {first}" for i, f in enumerate(features))
    value = "case b.feature " + " ".join(f"when '{f}' then r.{f}" for f in features) + " end"
    return f"""
    l{tag} as ({long}),
    c{tag} as (select l.node, l.feature, l.fi, ed.edge_idx as k, ed.edge,
        sum(case when x <= edge then g else 0 end) as gl, sum(case when x <= edge then h else 0 end) as hl,
        sum(case when x <= edge then 0 else g end) as gr, sum(case when x <= edge then 0 else h end) as hr,
        count(case when x <= edge then 1 end) as nl, count(case when x <= edge then null else 1 end) as nr
        from l{tag} l join ed on ed.feature = l.feature group by all),
    q{tag} as (select *, 0.5E0 * (gl * gl / (hl + {lam!r}) + gr * gr / (hr + {lam!r}) - (gl + gr) * (gl + gr) / (hl + hr + {lam!r})) - {lam!r} as gain
        from c{tag} where nl > 0 and nr > 0),
    b{tag} as (select * from (select *, row_number() over (partition by node order by round(gain, 6) desc, fi, k) as rank from q{tag}) where rank = 1),
    r{tag} as (select r.id, {', '.join('r.' + f for f in features)}, r.y, r.score, r.g, r.h,
        case when b.gain is null or round(b.gain, 6) <= 0 then r.node when {value} <= b.edge then 2 * r.node else 2 * r.node + 1 end as node
        from {rows} r left join b{tag} b on b.node = r.node)"""


def boost_sql(base: str, edges: str, features: list[str], rounds: int, depth: int, lam: float, gh: tuple[str, str], source: str = "j") -> str:
    """CTEs of a whole boosting run. Per round t: node table n<t> and scored rows s<t+1>."""
    cols = ", ".join(features)
    parts = [base, edges, f"s0 as (select id, {cols}, y, 0.0E0 as score from {source})"]
    for t in range(rounds):
        parts.append(f"g{t} as (select *, {gh[0]} as g, {gh[1]} as h, 1 as node from s{t})")
        rows = f"g{t}"
        for d in range(depth):
            parts.append(level_sql(f"{t}_{d}", rows, features, lam, 2**d))
            rows = f"r{t}_{d}"
        parts.append(f"w{t} as (select node, -sum(g) / (sum(h) + {lam!r}) as weight, count(*) as n from {rows} group by node)")
        cuts = " union all ".join(
            f"select {t} as tree, node, feature, k as bin, edge, gain, null as weight from b{t}_{d} where round(gain, 6) > 0" for d in range(depth)
        )
        parts.append(f"n{t} as ({cuts} union all select {t}, node, null, null, null, null, weight from w{t})")
        parts.append(f"s{t + 1} as (select r.id, {', '.join('r.' + f for f in features)}, r.y, r.score + w.weight as score from {rows} r join w{t} w on w.node = r.node)")
    return "with " + ", ".join(parts)


def nodes_sql(rounds: int, scale: int = 4) -> str:
    all_nodes = " union all ".join(f"select * from n{t}" for t in range(rounds))
    return f"""select cast(tree as integer) as tree, cast(node as bigint) as node, feature, cast(bin as integer) as bin, edge,
    {sql_rnd('gain', scale)} as gain, {sql_rnd('weight')} as weight from ({all_nodes})"""


def node_rows(spark, model, scale: int = 4):
    return model.node_table(spark).select("tree", "node", "feature", "bin", "edge", rnd("gain", scale).alias("gain"), rnd("weight").alias("weight"))


def binned_a(spark, sf, k=K):
    company, partner = stored(spark, sf, "a")
    edges = quantile_edges(company.df, COMPANY_COLS, k).merge(quantile_edges(partner.df, PARTNER_COLS, k))
    return bin_label(company.df.join(partner.df, "id"), edges), edges


def first_gh(df):
    """Gradients at score 0, everything in the root."""
    g, h = scores.grad_hess_logistic(F.col("y"), F.lit(0.0))
    return df.select(F.lit(1).alias("node"), g.alias("g"), h.alias("h"), *[f"{f}_bin" for f in FEATURES_A], "id")


_BINS = [f"{f}_bin" for f in FEATURES_A]
_ROOT = boost_sql(SQL_A, edges_a_sql(K), FEATURES_A, 1, 1, 1.0, LOGISTIC_GH)


@query("gh_total", f"with {SQL_A} select {sql_rnd('sum(0.5E0 - y)')} as g, {sql_rnd('count(*) * 0.25E0')} as h, count(*) as n from j")
def _(spark, sf):
    df, _ = binned_a(spark, sf)
    return splits.gh_total(first_gh(df), ["node"]).select(rnd("g").alias("g"), rnd("h").alias("h"), "n")


@query(
    "gh_histogram",
    f"""{_ROOT}, x as (select l.feature, l.fi, l.x, l.g, l.h, coalesce(min(case when x <= edge then edge_idx end), {K}) as bin
        from (select row_number() over () as rn, * from l0_0) l join ed on ed.feature = l.feature group by l.rn, l.feature, l.fi, l.x, l.g, l.h)
    select cast(fi as integer) as feature, cast(bin as integer) as bin, {sql_rnd('sum(g)')} as g, {sql_rnd('sum(h)')} as h, count(*) as n from x group by 1, 2""",
)
def _(spark, sf):
    df, _ = binned_a(spark, sf)
    return splits.gh_histogram(first_gh(df), _BINS).select("feature", "bin", rnd("g").alias("g"), rnd("h").alias("h"), "n")


# The engine's candidates include empty bins, which repeat the cut before them: keep the first.
_DISTINCT_CUTS = "(select *, row_number() over (partition by feature, nl order by k) as again from q0_0)"


@query(
    "split_prefix_sums",
    f"""{_ROOT} select cast(fi as integer) as feature, cast(k as integer) as bin, {sql_rnd('gl')} as g_l, {sql_rnd('hl')} as h_l,
    {sql_rnd('gr')} as g_r, {sql_rnd('hr')} as h_r, nl as n_l, nr as n_r from {_DISTINCT_CUTS} where again = 1""",
)
def _(spark, sf):
    df, _ = binned_a(spark, sf)
    p = splits.split_prefix_sums(splits.gh_histogram(first_gh(df), _BINS))
    return p.select("feature", "bin", *[rnd(c).alias(c) for c in ("g_l", "h_l", "g_r", "h_r")], "n_l", "n_r")


@query("split_gain", f"{_ROOT} select cast(fi as integer) as feature, cast(k as integer) as bin, {sql_rnd('gain')} as gain from {_DISTINCT_CUTS} where again = 1")
def _(spark, sf):
    df, _ = binned_a(spark, sf)
    p = splits.split_prefix_sums(splits.gh_histogram(first_gh(df), _BINS))
    gain = splits.split_gain(F.col("g_l"), F.col("h_l"), F.col("g_r"), F.col("h_r"), 1.0)
    return p.select("feature", "bin", rnd(gain).alias("gain"))


def stump(spark, sf):
    """Join, bin, histogram, best split: one tree node from two raw tables."""
    df, edges = binned_a(spark, sf)
    best = splits.best_split(splits.split_prefix_sums(splits.gh_histogram(first_gh(df), _BINS)), 1.0)
    cut = edges.table(spark).where(F.col("feature").isin(FEATURES_A))
    name = F.element_at(F.array(*map(F.lit, FEATURES_A)), F.col("feature") + 1)
    best = best.select(name.alias("feature"), F.col("bin").alias("edge_idx"), rnd("gain").alias("gain"), "n_l", "n_r")
    return best.join(cut, ["feature", "edge_idx"])


@query("best_split", f"{_ROOT} select feature, edge_idx, edge, {sql_rnd('gain')} as gain, nl as n_l, nr as n_r from (select *, k as edge_idx from b0_0)")
def _(spark, sf):
    return stump(spark, sf)


@query("split_or_leaf", f"{_ROOT} select feature, gain > 0 as by_gain, false as at_depth from b0_0")
def _(spark, sf):
    df, _ = binned_a(spark, sf)
    best = splits.best_split(splits.split_prefix_sums(splits.gh_histogram(first_gh(df), _BINS)), 1.0)
    name = F.element_at(F.array(*map(F.lit, FEATURES_A)), F.col("feature") + 1).alias("feature")
    open_ = splits.split_or_leaf(best, 0, 3).select(name, F.col("is_split").alias("by_gain"))
    end = splits.split_or_leaf(best, 3, 3).select(name, F.col("is_split").alias("at_depth"))
    return open_.join(end, "feature")


_TREE = boost_sql(SQL_A, edges_a_sql(K), FEATURES_A, 1, 2, 1.0, LOGISTIC_GH)


@query("tree_route", f"{_TREE} select cast(node as bigint) as node, count(*) as n, count(*) as equal_routes from r0_1 group by node")
def _(spark, sf):
    df, edges = binned_a(spark, sf)
    model = gbt_fit(df, FEATURES_A, edges, n_estimators=1, max_depth=2, lambda_=1.0)
    inner = [n for n in model.nodes if not n.is_leaf]
    by_level = {d: [vars(n) for n in inner if n.node.bit_length() == d] for d in (1, 2)}
    routed = df.withColumn("node", F.lit(1).cast("bigint"))
    for d in (1, 2):
        routed = splits.tree_route(routed, by_level[d], column="edge")
    both = routed.select("node", model.leaf_of(0, by="bin").alias("trained"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node") == F.col("trained")).alias("equal_routes"))


@query("leaf_weight", f"{_TREE} select cast(node as bigint) as node, {sql_rnd('weight')} as weight, n from w0")
def _(spark, sf):
    df, edges = binned_a(spark, sf)
    model = gbt_fit(df, FEATURES_A, edges, n_estimators=1, max_depth=2, lambda_=1.0)
    g, h = scores.grad_hess_logistic(F.col("y"), F.lit(0.0))
    rows = df.select(model.leaf_of(0, by="bin").cast("bigint").alias("node"), g.alias("g"), h.alias("h"))
    sums = splits.gh_total(rows, ["node"])
    return sums.select("node", rnd(splits.leaf_weight(F.col("g"), F.col("h"), 1.0)).alias("weight"), "n")


@query("tree_fit", f"{_TREE} {nodes_sql(1)}")
def _(spark, sf):
    df, edges = binned_a(spark, sf)
    return node_rows(spark, gbt_fit(df, FEATURES_A, edges, n_estimators=1, max_depth=2, lambda_=1.0))


_FOREST = boost_sql(SQL_A, edges_a_sql(K), FEATURES_A, 2, 2, 1.0, LOGISTIC_GH)


def forest(spark, sf, **options):
    df, edges = binned_a(spark, sf)
    return gbt_fit(df, FEATURES_A, edges, **({"n_estimators": 2, "max_depth": 2, "lambda_": 1.0} | options)), df


@query("gbt_fit", f"{_FOREST} {nodes_sql(2)}")
def _(spark, sf):
    return node_rows(spark, forest(spark, sf)[0])


@query("gbt_score", f"{_FOREST} select id, {sql_rnd('score')} as score from s2")
def _(spark, sf):
    model, df = forest(spark, sf)
    return model.score(df).select("id", rnd("score").alias("score"))


@query("gbt_predict", f"{_FOREST} select id, {sql_rnd('1.0E0 / (1.0E0 + exp(-score))')} as probability, case when score > 0 then 1.0E0 else 0.0E0 end as prediction from s2")
def _(spark, sf):
    model, df = forest(spark, sf)
    return model.predict(df).select("id", rnd("probability").alias("probability"), "prediction")


@query(
    "gbt_curve",
    _FOREST
    + " union all ".join(
        f""" select '{s}' as series, cast({t} as integer) as step, {sql_rnd('-sum(y * ln(1.0E0 / (1.0E0 + exp(-score)) + 1e-12))', 4)} as loss,
        {sql_rnd('avg(case when (score > 0) = (y = 1) then 1.0E0 else 0.0E0 end)')} as accuracy from s{t + 1}"""
        for t in (0, 1)
        for s in ("train", "validation")
    ),
)
def _(spark, sf):
    df, edges = binned_a(spark, sf)
    model = gbt_fit(df, FEATURES_A, edges, n_estimators=2, max_depth=2, lambda_=1.0, curve=True, validation=joined(spark, sf))
    return model.curve_table(spark).select("series", "step", rnd("loss", 4).alias("loss"), rnd("accuracy").alias("accuracy"))


@query("gbt_objective_piecewise", boost_sql(SQL_A, edges_a_sql(K), FEATURES_A, 2, 1, 1.0, PIECEWISE_GH) + nodes_sql(2))
def _(spark, sf):
    return node_rows(spark, forest(spark, sf, max_depth=1, share_y=True)[0])


_EDGES_D = f"ed as ({edges_sql('co', ['c0'], K)} union all {edges_sql('pa', ['p0', 'p1', 'p2'], K)})"


@query("gbt_objective_squared", boost_sql(SQL_D, _EDGES_D, FEATURES_D, 2, 1, 0.001, SQUARED_GH) + nodes_sql(2, 2).replace(sql_rnd("weight"), sql_rnd("weight", 3)))
def _(spark, sf):
    company, partner = stored(spark, sf, "d")
    edges = quantile_edges(company.df, ["c0"], K).merge(quantile_edges(partner.df, ["p0", "p1", "p2"], K))
    df = bin_label(company.df.join(partner.df, "id"), edges)
    model = gbt_fit(df, FEATURES_D, edges, n_estimators=2, max_depth=1, lambda_=0.001, mission="regression")
    nodes = model.node_table(spark)
    return nodes.select("tree", "node", "feature", "bin", "edge", rnd("gain", 2).alias("gain"), rnd("weight", 3).alias("weight"))


_SOFTMAX = f"""with {SQL_E},
ed as (select j, cast(k as integer) as k, edge from (select j, unnest(range(4)) as k,
       unnest(list_transform(quantile_cont(v, [0.2E0, 0.4E0, 0.6E0, 0.8E0]), lambda x: cast(round_even(x, 3) as double))) as edge from e group by j)),
cl as (select distinct y as cls from e),
p as (select 1.0E0 / count(*) as p from cl),
x as (select cls, j, v, p - case when y = cls then 1 else 0 end as g, p * (1 - p) as h from e, cl, p),
c as (select cls, x.j, k, edge, sum(case when v <= edge then g else 0 end) as gl, sum(case when v <= edge then h else 0 end) as hl,
      sum(case when v <= edge then 0 else g end) as gr, sum(case when v <= edge then 0 else h end) as hr,
      count(case when v <= edge then 1 end) as nl, count(case when v <= edge then null else 1 end) as nr from x join ed on ed.j = x.j group by all),
q as (select *, 0.5E0 * (gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1)) - 1 as gain from c where nl > 0 and nr > 0),
b as (select * from (select *, row_number() over (partition by cls order by round(gain, 6) desc, j, k) as rank from q) where rank = 1)
select cls, 1 as node, 'x' || j as feature, k as bin, edge, {sql_rnd('gain', 4)} as gain, cast(null as double) as weight from b where round(gain, 6) > 0
union all select cls, 2, null, null, null, null, {sql_rnd('-gl / (hl + 1)')} from b where round(gain, 6) > 0
union all select cls, 3, null, null, null, null, {sql_rnd('-gr / (hr + 1)')} from b where round(gain, 6) > 0
union all select cls, 1, null, null, null, null, {sql_rnd('-(gl + gr) / (hl + hr + 1)')} from b where round(gain, 6) <= 0"""


@query("gbt_objective_softmax", f"select cls, cast(node as bigint) as node, feature, bin, edge, gain, weight from ({_SOFTMAX})")
def _(spark, sf):
    names = [f"x{j}" for j in range(64)]
    wide = wide_e(spark, sf)
    edges = quantile_edges(wide, names, 4)
    model = gbt_fit(bin_label(wide, edges), names, edges, "label", n_estimators=1, max_depth=1, lambda_=1.0, classes=10)
    return model.node_table(spark).select("cls", "node", "feature", "bin", "edge", rnd("gain", 4).alias("gain"), rnd("weight").alias("weight"))


@query("gbt_fit_array", f"select cls, cast(node as bigint) as node, feature, bin, edge, gain, weight from ({_SOFTMAX})")
def _(spark, sf):
    """As above from the array column itself, without named columns or stored bins."""
    rows = table(spark, sf, "embeddings")
    edges = array_edges(rows, "embedding", 4)
    model = gbt_fit(rows, edges.features, edges, "label", n_estimators=1, max_depth=1, lambda_=1.0, classes=10, values="embedding")
    return model.node_table(spark).select("cls", "node", "feature", "bin", "edge", rnd("gain", 4).alias("gain"), rnd("weight").alias("weight"))


@query("gbt_label_at_company", boost_sql(SQL_C, f"ed as ({edges_sql('co', ['c0', 'c1'], 8)} union all {edges_sql('pa', ['p0', 'p1'], 8)})", ["c0", "c1", "p0", "p1"], 1, 2, 1e-05, LOGISTIC_GH) + nodes_sql(1))
def _(spark, sf):
    company, partner = stored(spark, sf, "c")
    edges = quantile_edges(company.df, ["c0", "c1"], 8).merge(quantile_edges(partner.df, ["p0", "p1"], 8))
    df = bin_label(company.df.join(partner.df, "id"), edges)
    return node_rows(spark, gbt_fit(df, ["c0", "c1", "p0", "p1"], edges, n_estimators=1, max_depth=2))


@query("gbt_end_to_end", f"{_FOREST} {nodes_sql(2)}")
def _(spark, sf):
    company, partner = parties(spark, sf, "a")
    options = RunOptions(seed="run", reg_coef=1.0, k_quantiles=K, n_estimators=2, max_depth=2, unique_ids=True, curve=False)
    return node_rows(spark, run_trees(company, partner, options).model)


@query("gbt_resume", f"{_FOREST} {nodes_sql(2)}")
def _(spark, sf):
    company, partner = parties(spark, sf, "a")
    place = scratch(spark)
    stored = {side: f"{place}/{side}" for side in ("company", "partner")}
    first = RunOptions(seed="run", reg_coef=1.0, k_quantiles=K, n_estimators=1, max_depth=1, unique_ids=True, curve=False, shares_to=stored, bins_to=f"{place}/bins")
    run_trees(company, partner, first)
    options = RunOptions(reg_coef=1.0, n_estimators=2, max_depth=2, curve=False)
    return node_rows(spark, resume_trees(spark, stored, f"{place}/bins", ["c0", "c1"], options).model)


@query("gbt_continued", f"{_FOREST} {nodes_sql(2)}")
def _(spark, sf):
    company, partner = parties(spark, sf, "a")
    options = RunOptions(seed="run", reg_coef=1.0, k_quantiles=K, max_depth=2, unique_ids=True, curve=False, run_dir=scratch(spark))
    run_trees(company, partner, replace(options, n_estimators=1))
    result = run_trees(company, partner, replace(options, n_estimators=2))
    result.remove()
    return node_rows(spark, result.model)


# Depth 7 from order lines: 128 ends, levels through stored nodes, siblings by subtraction.
_DEEP = boost_sql(SQL_A, edges_a_sql(K), FEATURES_A, 1, 7, 1.0, LOGISTIC_GH)


@query("tree_fit_deep", f"{_DEEP} {nodes_sql(1)}")
def _(spark, sf):
    return node_rows(spark, forest(spark, sf, n_estimators=1, max_depth=7)[0])


@query("tree_route_deep", f"{_DEEP} select cast(node as bigint) as node, count(*) as n from r0_6 group by node")
def _(spark, sf):
    model, df = forest(spark, sf, n_estimators=1, max_depth=7)
    routed = df.withColumn("node", F.lit(1).cast("bigint"))
    for depth in range(1, 8):
        level = [vars(n) for n in model.nodes if not n.is_leaf and n.node.bit_length() == depth]
        routed = splits.tree_route(routed, level, column="edge")
    return routed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


_CHAIN = 40
_CHAINED = {"c0": 0.5, "p0": 0.25, "p1": 0.125}


def chain(tree: int, feature: str, cuts, step: float) -> list[TreeNode]:
    """One node a level: rows at most the cut end, the others go on to the right."""
    nodes = []
    for i, cut in enumerate(cuts):
        nodes += [TreeNode(tree, 0, 2 ** (i + 1) - 1, feature, i, cut, 0.0, None), TreeNode(tree, 0, 2 ** (i + 2) - 2, None, None, None, None, i * step)]
    return nodes + [TreeNode(tree, 0, 2 ** (len(cuts) + 1) - 1, None, None, None, None, len(cuts) * step)]


@query(
    "gbt_score_deep",
    f"""with {SQL_A}, {edges_a_sql(_CHAIN)} select id, {' + '.join(
        f"{w!r}E0 * (select count(*) from ed where ed.feature = '{f}' and ed.edge < j.{f})" for f, w in _CHAINED.items())} as score from j""",
)
def _(spark, sf):
    company, partner = stored(spark, sf, "a")
    edges = quantile_edges(company.df, COMPANY_COLS, _CHAIN).merge(quantile_edges(partner.df, PARTNER_COLS, _CHAIN))
    nodes = [n for t, (f, w) in enumerate(_CHAINED.items()) for n in chain(t, f, edges.cuts[f], w)]
    model = GBTModel(list(_CHAINED), edges, scores.LOGISTIC, None, 1.0, _CHAIN, nodes)
    return model.score(company.df.join(partner.df, "id")).select("id", "score")
