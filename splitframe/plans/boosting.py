"""Histogram-based gradient-boosted trees, grown level by level."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators.binning import Edges
from ..operators.metrics import accuracy, cross_entropy_sum, mse
from ..operators.prep import label_classes
from ..operators.splits import best_split, split_or_leaf, split_prefix_sums
from ..session import materialise
from .packed import NodeArrays, Packing, dense_histogram, forest_scores, pack_bins, pack_values, routed
from .store import RunStore

# Default size of a forest.
N_ESTIMATORS = 3
MAX_DEPTH = 3
LAMBDA = 1e-5

INLINE_LEAVES = 64
# Rows store the node they are in every so many levels; levels since are walked.
STORED_LEVELS = 6
# Rows equal in label and bins become one where that leaves at most one row of so many.
GROUPED = 4


@dataclass(frozen=True)
class TreeNode:
    """One row of the tree table; children of node n are 2n and 2n + 1, the root is 1."""

    tree: int
    cls: int
    node: int
    feature: str | None
    bin: int | None
    edge: float | None
    gain: float | None
    weight: float | None

    @property
    def is_leaf(self) -> bool:
        return self.feature is None


NODE_SCHEMA = "tree int, cls int, node bigint, feature string, bin int, edge double, gain double, weight double"


@dataclass
class GBTModel:
    """Trained forest: bounded by trees x 2^depth nodes, so it is kept on the driver."""

    features: list[str]
    edges: Edges
    objective: str
    classes: list | None
    lambda_: float
    max_depth: int
    nodes: list[TreeNode] = field(default_factory=list)
    curve: list[tuple[str, int, float, float]] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.classes) if self.classes else 1

    @property
    def trees(self) -> int:
        return 1 + max((n.tree for n in self.nodes), default=-1)

    # -- scoring --------------------------------------------------------------------------

    def _tree(self, tree: int, cls: int) -> dict[int, TreeNode]:
        return {n.node: n for n in self.nodes if n.tree == tree and n.cls == cls}

    def tree_score(self, tree: int, cls: int = 0, by: str = "value", suffix: str = "_bin") -> Column:
        """Weight of the leaf a row reaches, as one nested CASE."""
        return F.expr(case_tree(self._tree(tree, cls), lambda n: scores.sql_number(n.weight), by, suffix))

    def leaf_of(self, tree: int, cls: int = 0, by: str = "value", suffix: str = "_bin") -> Column:
        """Heap number of the leaf a row reaches."""
        return F.expr(case_tree(self._tree(tree, cls), lambda n: str(n.node), by, suffix))

    def class_scores(self, by: str = "value", suffix: str = "_bin", trees: range | None = None) -> list[Column]:
        """Sum of leaf weights per class over the trees."""
        trees = trees if trees is not None else range(self.trees)
        chosen = [n for n in self.nodes if n.tree in trees]
        if sum(n.is_leaf for n in chosen) > INLINE_LEAVES * self.width:
            return self._vectorised(trees, by, suffix)
        out = []
        for c in range(self.width):
            total = F.lit(0.0)
            for t in trees:
                total = total + self.tree_score(t, c, by, suffix)
            out.append(total)
        return out

    def packed_scores(self, packing: Packing, trees: range) -> list[Column]:
        """As ``class_scores``, for packed bins and trees of a bounded number of leaves."""
        slot = {f: i for i, f in enumerate(self.features)}
        test = lambda n: packing.at_most("_bins", slot[n.feature], n.bin)
        leaf = lambda n: scores.sql_number(n.weight)
        return [sum((F.expr(case_tree(self._tree(t, c), leaf, at_most=test)) for t in trees), F.lit(0.0)) for c in range(self.width)]

    def _vectorised(self, trees: range, by: str, suffix: str) -> list[Column]:
        """For forests beyond what generated code takes: Arrow batches through the nodes that exist."""
        columns = [F.col(f if by == "value" else f + suffix).cast("double") for f in self.features]
        return self._walked(columns, trees, by, wide=False)

    def array_scores(self, values: str, trees: range | None = None) -> list[Column]:
        """As ``class_scores``, from one array column of raw values in the order of ``features``."""
        return self._walked([F.col(values)], trees if trees is not None else range(self.trees), "value", wide=True)

    def _walked(self, columns: list[Column], trees: range, by: str, wide: bool) -> list[Column]:
        slot = {f: i for i, f in enumerate(self.features)}
        flat = [(c, NodeArrays.of(self._tree(t, c).values(), slot, by)) for t in trees for c in range(self.width)]
        result = forest_scores(columns, flat, self.width, wide)
        return [result[c] for c in range(self.width)]

    def score(self, df: DataFrame, by: str = "value", out: str = "score", values: str | None = None) -> DataFrame:
        """Add the raw score (an array with several classes); ``values`` names an array column of all features."""
        s = self.array_scores(values) if values else self.class_scores(by)
        return df.withColumn(out, s[0] if self.width == 1 else F.array(*s))

    def predict(self, df: DataFrame, by: str = "value", out: str = "prediction", values: str | None = None) -> DataFrame:
        """Add probability and label, or the value itself for regression."""
        scored = self.score(df, by, "_score", values)
        p = scores.activation(self.objective, F.col("_score"))
        if self.objective == scores.SQUARED:
            return scored.withColumn(out, p).drop("_score")
        label = scores.to_int_labels(p, several=self.width > 1)
        if self.classes:
            label = F.element_at(F.array(*map(F.lit, self.classes)), label + 1)
        return scored.withColumn("probability", p).withColumn(out, label).drop("_score")

    # -- tables ---------------------------------------------------------------------------

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(vars(n).values()) for n in self.nodes]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def curve_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.curve, "series string, step int, loss double, accuracy double")


def case_tree(tree: dict[int, TreeNode], leaf, by: str = "value", suffix: str = "_bin", at_most=None) -> str:
    """Nested CASE over a tree; ``leaf`` renders the end nodes. Null goes right.

    ``at_most`` renders the test of a node otherwise than by a column of values or of bins.
    """

    def test(n: TreeNode) -> str:
        if at_most:
            return at_most(n)
        return f"`{n.feature}` <= {scores.sql_number(n.edge)}" if by == "value" else f"`{n.feature}{suffix}` <= {n.bin}"

    def render(node: int) -> str:
        n = tree[node]
        return leaf(n) if n.is_leaf else f"CASE WHEN {test(n)} THEN {render(2 * node)} ELSE {render(2 * node + 1)} END"

    return render(1)


def _gradients(model: GBTModel, score: list[Column], y: Column, rows: int) -> list[tuple[Column, Column]]:
    """Gradient and hessian columns, one pair per class."""
    if model.objective == scores.LOGISTIC:
        return [scores.grad_hess_logistic(y, score[0])]
    if model.objective == scores.PIECEWISE:
        return [scores.grad_hess_approx(y, score[0])]
    if model.objective == scores.SQUARED:
        return [scores.grad_hess_mse(y, score[0], rows)]
    one = F.lit(1.0)
    return [(p - F.when(y == c, 1.0).otherwise(0.0), p * (one - p)) for c, p in zip(model.classes, _softmax_columns(score))]


def _softmax_columns(score: list[Column]) -> list[Column]:
    top = F.greatest(*score)
    e = [F.exp(s - top) for s in score]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def tree_fit(
    model: GBTModel, frame: DataFrame, packing: Packing, gh: list[tuple[Column, Column]], tree: int, gamma: float | None = None
) -> list[TreeNode]:
    """Grow one tree (one per class) on packed bins (``_bins``, ``_at``), one pass a level.

    A row that stands for several has their number in ``_n``, and ``gh`` for all of them.

    A level measures the root, or the smaller child of every split; the larger child's histogram
    is its parent's, which the level above has stored, less its sibling's. Rows walk
    from the node stored in ``_at``, at first the root, which is written anew every few levels. What
    comes back is one row a node, with the sums on both sides, from which leaf weights follow.
    """
    width, spark = model.width, frame.sparkSession
    slot_of = {f: i for i, f in enumerate(model.features)}
    # cls -> node -> TreeNode; an open node is a placeholder leaf without a weight.
    grown: list[dict[int, TreeNode]] = [{1: TreeNode(tree, c, 1, None, None, None, None, None)} for c in range(width)]
    sums: dict[tuple[int, int], tuple[float, float]] = {}
    copies = [F.col("_n").cast("double")] if "_n" in frame.columns else []
    gradients = F.array(*[F.coalesce(x, F.lit(0.0)) for pair in gh for x in pair], *copies).alias("gh")
    by = ("cls", "node")
    # Nodes to measure, and the sibling that gets the rest of its parent.
    measured: list[tuple[int, int, int | None]] = [(c, 1, None) for c in range(width)]
    histogram: DataFrame | None = None
    for depth in range(model.max_depth):
        if not measured:
            break
        arrays = [NodeArrays.of(g.values(), slot_of) for g in grown]
        if depth and depth % STORED_LEVELS == 0:
            frame = materialise(routed(frame, packing, arrays), "assigned")
        slots: list[dict[int, int]] = [{} for _ in range(width)]
        for i, (c, node, _) in enumerate(measured):
            slots[c][node] = i
        parts = dense_histogram(frame.select("_bins", "_at", gradients), packing, arrays, slots)
        names = spark.createDataFrame([(i, *m) for i, m in enumerate(measured)], "slot bigint, cls int, node bigint, sibling bigint")
        cells = _with_siblings(parts, names, histogram)
        if depth + 1 < model.max_depth:
            histogram = cells = materialise(cells, "histogram")
        best = split_or_leaf(best_split(split_prefix_sums(cells, by), model.lambda_, gamma, by), depth, model.max_depth)
        measured = []
        for b in best.collect():
            c, node = b["cls"], b["node"]
            sums[c, node] = (b["g_l"] + b["g_r"], b["h_l"] + b["h_r"])
            if not b["is_split"]:
                continue
            name = model.features[b["feature"]]
            grown[c][node] = TreeNode(tree, c, node, name, b["bin"], model.edges.cuts[name][b["bin"]], b["gain"], None)
            for child, side in ((2 * node, "l"), (2 * node + 1, "r")):
                sums[c, child] = (b[f"g_{side}"], b[f"h_{side}"])
                grown[c][child] = TreeNode(tree, c, child, None, None, None, None, None)
            smaller = 2 * node + (b["n_r"] < b["n_l"])
            measured.append((c, smaller, smaller ^ 1))
        if depth == 0 and len(sums) < width:
            _root_sums(frame, gh, sums)
    if len(sums) < width:
        _root_sums(frame, gh, sums)

    def finish(n: TreeNode) -> TreeNode:
        if not n.is_leaf:
            return n
        g, h = sums[n.cls, n.node]
        total = h + model.lambda_
        return replace(n, weight=0.0 if total == 0 else -g / total)

    return [finish(n) for per in grown for _, n in sorted(per.items())]


def _with_siblings(parts: DataFrame, names: DataFrame, above: DataFrame | None) -> DataFrame:
    """Histogram of the measured nodes and of their siblings, which get what is left of the parent.

    ``parts``: partial sums by slot; ``names``: slot, cls, node and sibling, one row a node;
    ``above``: the level above. One aggregate adds parts to their node and takes them off the
    parent's cells.
    """
    own = F.struct("node", F.lit(1).alias("sign"))
    rest = F.struct(F.col("sibling").alias("node"), F.lit(-1).alias("sign"))
    to = F.explode(F.when(F.col("sibling").isNull(), F.array(own)).otherwise(F.array(own, rest))).alias("to")
    signed = parts.join(F.broadcast(names), "slot").select("cls", "feature", "bin", "g", "h", "n", to)
    cells = signed.select("cls", "to.node", "feature", "bin", *[(F.col(c) * F.col("to.sign")).alias(c) for c in ("g", "h", "n")])
    if above is not None:
        parents = names.select("cls", F.shiftright("node", 1).alias("node"), "sibling")
        given = above.join(F.broadcast(parents), ["cls", "node"])
        cells = cells.unionByName(given.select("cls", F.col("sibling").alias("node"), "feature", "bin", "g", "h", "n"))
    return cells.groupBy("cls", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).where("n > 0")


def _root_sums(frame: DataFrame, gh: list[tuple[Column, Column]], sums: dict) -> None:
    """Totals of roots that have no possible cut."""
    total = [F.sum(x).alias(f"{name}{c}") for c, pair in enumerate(gh) for name, x in zip("gh", pair)]
    r = frame.agg(*total).first()
    for c in range(len(gh)):
        if r[f"g{c}"] is None:
            raise ValueError("no rows to train on")
        sums.setdefault((c, 1), (r[f"g{c}"], r[f"h{c}"]))


def _evaluate(model: GBTModel, score: list[Column], y: Column, copies: Column | None = None) -> tuple[Column, Column]:
    """Loss and accuracy aggregates at the given score."""
    if model.objective == scores.SQUARED:
        return mse(y, score[0], copies), F.lit(None).cast("double")
    if model.objective == scores.SOFTMAX:
        p = _softmax_columns(score)
        own = F.lit(0.0)
        for c, pc in zip(model.classes, p):
            own = own + F.when(y == c, pc).otherwise(0.0)
        chosen = scores.to_int_labels(F.array(*p), several=True)
        return cross_entropy_sum(F.lit(1.0), own, copies), accuracy(F.array_position(F.array(*map(F.lit, model.classes)), y) - 1, chosen, copies)
    p = scores.activation(model.objective, score[0])
    return cross_entropy_sum(y, p, copies), accuracy(y, scores.to_int_labels(p), copies)


def _grouped(frame: DataFrame, store: RunStore | None) -> tuple[DataFrame, int]:
    """Packed rows for all rounds to read, and the number of rows they stand for.

    Bins are few, so rows of a large table are often equal in label and bins, and then in score and
    gradients whatever the trees. Each kind becomes one row with its number (``_n``) if an estimate
    says that they are few; it decides how long rounds take, not what they find.
    """

    def counted() -> list[int]:
        return list(frame.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("_y", "_bins"))).first())

    rows, kinds = store.note("kinds", counted) if store else counted()
    if kinds * GROUPED > rows:
        return frame, rows
    one = frame.groupBy("_y", "_bins").agg(F.count(F.lit(1)).alias("_n"))
    return store.tables("grouped", make=lambda: [one])[0] if store else materialise(one, "grouped"), rows


def gbt_fit(
    df: DataFrame,
    features: list[str],
    edges: Edges,
    label: str = "y",
    n_estimators: int = N_ESTIMATORS,
    lambda_: float = LAMBDA,
    max_depth: int = MAX_DEPTH,
    gamma: float | None = None,
    mission: str = "classification",
    classes: list | int | None = None,
    share_y: bool = False,
    validation: DataFrame | None = None,
    curve: bool = False,
    write: bool = True,
    values: str | None = None,
    store: RunStore | None = None,
) -> GBTModel:
    """Boost ``n_estimators`` rounds from score 0, without shrinkage or sampling.

    ``df`` has the label and ``<feature>_bin`` columns (see ``bin_label``). ``classes`` makes
    it multi-class with one tree per class and round: pass the class list, or the number of
    classes to read it from the data. ``validation`` has raw feature values. With ``write``
    the few columns needed are written once and every level reads them back, rows that are equal
    in them as one if they are many (``_grouped``). ``values`` names an
    array column of raw values, in ``df`` and ``validation``, which is read instead of named
    columns, however many features there are; bins are then found while rows are packed. With a
    ``store`` the binned rows and each round's trees are kept, and boosting goes on after the last one.
    """
    if isinstance(classes, int):
        classes = label_classes(df, label, classes) if classes > 1 else None
    width = len(classes) if classes else 1
    model = GBTModel(list(features), edges, scores.pick_objective(mission, width, share_y), classes, lambda_, max_depth)
    finished = store.steps()[:n_estimators] if store else []
    model.nodes += [TreeNode(**node) for state in finished for node in state["nodes"]]
    model.curve += [tuple(point) for state in finished for point in state["curve"]]
    if finished and len(finished) == n_estimators:
        return model
    packing = Packing(len(features), 1 + max(len(edges.cuts[f]) for f in features))
    if values:
        frame = pack_values(df, values, [edges.cuts[f] for f in features], {"_y": F.col(label)}, packing)
    else:
        frame = pack_bins(df, [F.col(f"`{f}_bin`") for f in features], {"_y": F.col(label)}, packing)
    if write:
        frame = store.tables("binned", make=lambda packed=frame: [packed])[0] if store else materialise(frame, "binned")
        frame, rows = _grouped(frame, store)
    else:
        rows = frame.count() if model.objective == scores.SQUARED else 0
    copies = [F.col("_n")] if "_n" in frame.columns else []
    # The root a class. Not null: null arrays take Spark 30 microseconds a row to hand to Python, others one.
    start = F.array(*[F.lit(1).cast("bigint")] * width).alias("_at")
    if curve and write and validation is not None and n_estimators - len(finished) > 1:
        # Every round reads it.
        validation = materialise(validation.select(label, *([values] if values else features)), "validation")
    held: list[str] = []
    inlined = list(range(len(finished)))

    def current() -> list[Column]:
        base = [F.col(h) for h in held] if held else [F.lit(0.0)] * width
        fresh = model.packed_scores(packing, range(inlined[0], model.trees)) if inlined else [F.lit(0.0)] * width
        return [a + b for a, b in zip(base, fresh)]

    for tree in range(len(finished), n_estimators):
        leaves = sum(n.is_leaf for n in model.nodes if n.tree in inlined)
        if leaves > INLINE_LEAVES * width:
            # Keep the expression small: store the running score with the bins.
            names = [f"_s{c}" for c in range(width)]
            frame = frame.select("_y", "_bins", *copies, *[s.alias(n) for s, n in zip(current(), names)])
            frame, held, inlined = materialise(frame, "scored"), names, []
        gh = _gradients(model, current(), F.col("_y"), rows)
        if copies:
            gh = [(g * copies[0], h * copies[0]) for g, h in gh]
        grown = tree_fit(model, frame.select("*", start), packing, gh, tree, gamma)
        points = len(model.curve)
        model.nodes += grown
        inlined.append(tree)
        if curve:
            _add_point(model, "train", tree, frame.agg(*_named(_evaluate(model, current(), F.col("_y"), *copies))))
            if validation is not None:
                raw = model.array_scores(values) if values else model.class_scores("value")
                points = validation.select(F.col(label).alias("_y"), *[x.alias(f"_r{c}") for c, x in enumerate(raw)])
                points = points.agg(*_named(_evaluate(model, [F.col(f"_r{c}") for c in range(width)], F.col("_y"))))
                _add_point(model, "validation", tree, points)
        if store:
            store.add_step(tree, {"nodes": [asdict(n) for n in grown], "curve": model.curve[points:]})
    return model


def _named(pair: tuple[Column, Column]) -> list[Column]:
    return [pair[0].alias("loss"), pair[1].alias("accuracy")]


def _add_point(model: GBTModel, series: str, step: int, point: DataFrame) -> None:
    r = point.first()
    model.curve.append((series, step, r["loss"], r["accuracy"]))
