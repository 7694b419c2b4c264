"""Whole runs: align, share, train, validate, save."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import AbstractContextManager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import psi_join
from ..operators.binning import Edges, bin_label, quantile_edges
from ..operators.prep import find_label_party, merged_columns
from ..operators.shares import ROW_ID, psi_shares, share_reconstruct
from ..session import materialise, writing_to
from ..spec import COMPANY, LABEL, PARTNER, Party, TableSpec
from . import boosting, linear
from .store import RunStore


@dataclass
class RunResult:
    model: linear.LinearModel | boosting.GBTModel
    label_party: str
    train: DataFrame
    company_share: DataFrame | None = None
    partner_share: DataFrame | None = None
    company_features: list[str] = field(default_factory=list)
    store: RunStore | None = None

    def remove(self) -> None:
        """Delete all that a run with ``run_dir`` wrote; the tables of this result cannot be read any more."""
        if self.store:
            self.store.remove()


@dataclass(frozen=True)
class RunOptions:
    """Options of a run; defaults are fixed values of the usual command-line runs.

    The exception is ``batch_size``, usually 1024: a step is a job, and a large table has too many
    batches of that size to take one after another. ``None`` takes one step per epoch.
    ``seed`` has no default, as who knows it can undo shares: it is needed where any are made.
    ``bins_to`` also stores the cut points, in a folder named like it with ``_edges`` added.
    ``run_dir``, a folder that all executors share, keeps what a run finishes, so that the same run
    goes on from there when it is started again, and ``RunResult.remove`` can delete it all. It holds
    the shares of both parties, so it is for whoever may see the aligned table.
    """

    share_y: bool = False
    through_shares: bool = True
    seed: int | str | None = None
    unique_ids: bool = False
    skew: str = "aqe"
    reg_coef: float = 0.0
    n_epochs: int = 10
    batch_size: int | None = None
    val_steps: int = 1
    lr: float = 0.1
    k_quantiles: int = 20
    n_estimators: int = 2
    max_depth: int = 2
    classes: list | int | None = None
    mission: str = "classification"
    curve: bool = True
    write_parties: bool = True
    shares_to: dict[str, str] | None = None
    bins_to: str | None = None
    model_to: dict[str, str] | None = None
    run_dir: str | None = None


#: Options that may differ when a run goes on: where things are stored, how long it trains, and secrets.
_FREE = ("seed", "n_epochs", "n_estimators", "skew", "shares_to", "bins_to", "model_to", "run_dir")


def _store(kind: str, company: Party, partner: Party, opt: RunOptions) -> RunStore | None:
    if not opt.run_dir:
        return None
    settings = {k: v for k, v in asdict(opt).items() if k not in _FREE}
    columns = {side: [*party.spec.features, *party.spec.public] for side, party in ((COMPANY, company), (PARTNER, partner))}
    return RunStore(company.df.sparkSession, opt.run_dir, {"kind": kind, "id": company.spec.id, **columns, **settings})


def _written(store: RunStore | None) -> AbstractContextManager:
    return writing_to(store.work if store else None)


def _seed(opt: RunOptions) -> int | str:
    if opt.seed is None:
        raise ValueError("shares need a secret seed: pass RunOptions(seed=...)")
    return opt.seed


def _aligned(company: DataFrame, partner: DataFrame, on: str, public: tuple[str, ...], opt: RunOptions, store: RunStore | None) -> tuple:
    """The training table, by way of shares or straight from the join."""
    if not opt.through_shares:
        joined = lambda: [psi_join(company, partner, on, opt.skew)]
        return (store.tables("aligned", make=joined) if store else joined())[0], None, None
    made = lambda: psi_shares(company, partner, _seed(opt), on, opt.unique_ids, public, opt.skew)
    ours, theirs = store.tables("company_share", "partner_share", make=made) if store else made()
    if opt.shares_to:
        from ..sources.stores import scan_shares, sink_holder, sink_shares

        sink_holder(company.sparkSession, find_label_party(company, partner), opt.shares_to["company"])
        sink_shares(ours, theirs, opt.shares_to["company"], opt.shares_to["partner"])
        ours, theirs = scan_shares(company.sparkSession, opt.shares_to["company"], opt.shares_to["partner"])
    return share_reconstruct(ours, theirs, keep=public), ours, theirs


def _with_own_names(company: Party, partner: Party) -> tuple[Party, Party]:
    """Both parties with the id under company's name, and no other column name in common."""
    id = company.spec.id
    right = partner.df.withColumnRenamed(partner.spec.id, id) if partner.spec.id != id else partner.df
    columns = lambda party: [c for c in party.spec.columns if c != party.spec.id]
    names = {(side, x): out for side, x, out in merged_columns([id, *columns(company)], [id, *columns(partner)], id)}

    def renamed(df: DataFrame, party: Party, side: str) -> Party:
        out = {x: names[side, x] for x in columns(party)}
        spec = TableSpec(id, tuple(out[f] for f in party.spec.features), tuple(out[f] for f in party.spec.public), out.get(party.spec.label))
        return Party(df.select(id, *[F.col(x).alias(y) for x, y in out.items()]), spec)

    return renamed(company.df, company, COMPANY), renamed(right, partner, PARTNER)


def run_linear(company: Party, partner: Party, options: RunOptions = RunOptions(), validation: DataFrame | None = None) -> RunResult:
    """Align two tables, share them and fit a logistic regression."""
    holder = find_label_party(company.df, partner.df)
    company, partner = _with_own_names(company, partner)
    store = _store("linear", company, partner, options)
    with _written(store):
        table, ours, theirs = _aligned(company.table(), partner.table(), company.spec.id, (), options, store)
        order = ROW_ID if options.through_shares else company.spec.id
        model = _fit_linear(table, company.spec.features, partner.spec.features, order, options, validation, store)
    return RunResult(model, holder, table, ours, theirs, list(company.spec.features), store)


def _fit_linear(table: DataFrame, ours: Sequence[str], theirs: Sequence[str], order: str, options: RunOptions, validation: DataFrame | None, store: RunStore | None = None) -> linear.LinearModel:
    model = linear.lr_fit(
        table,
        [*ours, *theirs],
        LABEL,
        options.classes,
        options.reg_coef,
        options.lr,
        options.n_epochs,
        options.batch_size,
        [order],
        options.share_y,
        len(ours),
        validation,
        options.val_steps,
        store=store,
    )
    if options.model_to:
        from ..sources.stores import save_linear

        save_linear(table.sparkSession, model, options.model_to)
    return model


def run_trees(company: Party, partner: Party, options: RunOptions = RunOptions(), validation: DataFrame | None = None) -> RunResult:
    """Bin each party's whole table, align, share and boost trees; labels of bins stay public.

    ``write_parties`` stores both tables as Parquet before the quantile passes read them; it is
    wasted on inputs that are plain Parquet already.
    """
    holder = find_label_party(company.df, partner.df)
    company, partner = _with_own_names(company, partner)
    store = _store("trees", company, partner, options)
    with _written(store):
        tables = [party.table() for party in (company, partner)]
        if options.write_parties:
            given = tables
            tables = store.tables("company", "partner", make=lambda: given) if store else [materialise(t, "party") for t in given]

        def searched() -> list:
            found = [quantile_edges(t, list(p.spec.features), options.k_quantiles) for t, p in zip(tables, (company, partner))]
            return [[[f, list(map(float, cuts))] for f, cuts in side.cuts.items()] for side in found]

        cuts = [Edges({f: tuple(c) for f, c in side}) for side in (store.note("edges", searched) if store else searched())]
        edges, sides = cuts[0].merge(cuts[1]), [bin_label(t, c) for t, c in zip(tables, cuts)]
        features = [*company.spec.features, *partner.spec.features]
        public = tuple(f"{f}_bin" for f in features)
        table, ours, theirs = _aligned(sides[0], sides[1], company.spec.id, public, options, store)
        if options.bins_to:
            from ..sources.stores import sink_bins, sink_edges

            # Shares carry the bins beside the row id: no need to put both sides together for them.
            carrier = ours if options.through_shares else table
            sink_bins(carrier, ROW_ID if options.through_shares else company.spec.id, features, options.bins_to)
            sink_edges(table.sparkSession, edges, f"{options.bins_to}_edges")
        model = _fit_trees(table, features, list(company.spec.features), edges, options, validation, store)
    return RunResult(model, holder, table, ours, theirs, list(company.spec.features), store)


def _fit_trees(table: DataFrame, features: list[str], own: list[str], edges: Edges, options: RunOptions, validation: DataFrame | None, store: RunStore | None = None) -> boosting.GBTModel:
    model = boosting.gbt_fit(
        table,
        features,
        edges,
        LABEL,
        options.n_estimators,
        options.reg_coef,
        options.max_depth,
        mission=options.mission,
        classes=options.classes,
        share_y=options.share_y,
        validation=validation,
        curve=options.curve,
        store=store,
    )
    if options.model_to:
        from ..sources.stores import save_trees

        save_trees(table.sparkSession, model, own, options.model_to, _seed(options))
    return model


def resume_linear(
    spark: SparkSession, shares: dict[str, str], company_features: list[str], options: RunOptions = RunOptions(), validation: DataFrame | None = None
) -> RunResult:
    """Fit on shares that an earlier run stored (``shares_to``), without aligning again.

    ``company_features`` are the names in the stored tables; all others but the row id and the
    label are partner's.
    """
    ours, theirs = _stored(spark, shares)
    partner_features = [c for c in ours.columns if c not in {ROW_ID, LABEL, *company_features}]
    table = share_reconstruct(ours, theirs)
    model = _fit_linear(table, company_features, partner_features, ROW_ID, options, validation)
    return RunResult(model, _holder(spark, shares), table, ours, theirs, list(company_features))


def resume_trees(
    spark: SparkSession, shares: dict[str, str], bins: str, company_features: list[str], options: RunOptions = RunOptions(), validation: DataFrame | None = None
) -> RunResult:
    """Boost trees on stored shares, bins and cut points (``shares_to``, ``bins_to``).

    Of the shares only the label is put together; bins join by row id, so rows without bins, which
    a run does not write, take no part.
    """
    from ..sources.stores import scan_edges

    ours, theirs = _stored(spark, shares)
    edges = scan_edges(spark, f"{bins}_edges")
    features = [*company_features, *[f for f in edges.features if f not in company_features]]
    table = share_reconstruct(ours, theirs, [LABEL]).join(spark.read.parquet(bins), ROW_ID)
    model = _fit_trees(table, features, list(company_features), edges, options, validation)
    return RunResult(model, _holder(spark, shares), table, ours, theirs, list(company_features))


def _holder(spark: SparkSession, shares: dict[str, str]) -> str:
    from ..sources.stores import scan_holder

    return scan_holder(spark, shares["company"])


def _stored(spark: SparkSession, shares: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    from ..sources.stores import scan_shares

    return scan_shares(spark, shares["company"], shares["partner"])
