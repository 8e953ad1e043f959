"""The whole comparison: representations by model families, cross-validated, blended, submitted."""

from __future__ import annotations

import time
from collections.abc import Collection, Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from labelloom.operators import blend, checks, features as ft, metrics, submit
from labelloom.operators.adapter import apply_adapter, fit_adapter
from labelloom.operators.groups import group_table, with_group_key
from labelloom.operators.linear import fit_linear_svm, fit_logistic, score_linear
from labelloom.operators.mlp import SHARDS, fit_mlp, score_multi
from labelloom.operators.splits import assign_rows, split_groups
from labelloom.sources.sinks import write_table
from labelloom.staging import scratch, stage

LOGISTIC = "logistic_regression"
SVM = "linear_svm"
MLP = "multilayer_perceptron"
FAMILIES = (LOGISTIC, SVM, MLP)


@dataclass(frozen=True)
class Linear:
    """Regularisation: ``c`` with exceptions by label, and the labels with balanced classes."""

    c: float
    by_label: Mapping[str, float] = field(default_factory=dict)
    balanced: frozenset[str] = frozenset()

    def costs(self, label_cols: Sequence[str]) -> dict[str, float]:
        return {label: self.by_label.get(label, self.c) for label in label_cols}


def linear_settings(rare: Collection[str] = (), softer: Collection[str] = ()) -> dict[tuple[str, str], Linear]:
    """The settings of each linear model per representation.

    The SVM on words balances the classes of ``rare`` labels; the logistic model on characters fits ``softer`` labels half as closely.
    """
    # 4 and 4 for the logistic models, 0.5 and 0.2 for the SVMs, 2 for softer labels.
    return {
        (ft.WORD_TFIDF.name, LOGISTIC): Linear(4.0),
        (ft.WORD_TFIDF.name, SVM): Linear(0.5, balanced=frozenset(rare)),
        (ft.CHAR_NGRAMS.name, LOGISTIC): Linear(4.0, dict.fromkeys(softer, 2.0)),
        (ft.CHAR_NGRAMS.name, SVM): Linear(0.2),
    }


@dataclass(frozen=True)
class Settings:
    """What to fit and how."""

    id_col: str
    text_col: str
    label_cols: tuple[str, ...]
    representations: tuple[ft.Representation, ...] = ft.REPRESENTATIONS
    families: tuple[str, ...] = FAMILIES
    linear: Mapping[tuple[str, str], Linear] = field(default_factory=linear_settings)
    components: int = 192
    epochs: int = 40
    shards: int = SHARDS
    folds_at_once: int = 3
    tolerance: float = 1e-4
    threshold: float = 0.5
    seed: int = 42

    def candidates(self) -> list[str]:
        return [candidate_key(r, family) for r in self.representations for family in self.families]

    def wanted(self, keys: Sequence[str] | None) -> list[str]:
        """The given candidates, or all; an unknown one is an error."""
        unknown = sorted(set(keys or ()) - set(self.candidates()))
        if unknown:
            raise ValueError(f"Unknown candidates: {unknown}")
        return self.candidates() if keys is None else list(keys)


def candidate_key(representation: ft.Representation, family: str) -> str:
    return f"{representation.name}__{family}"


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold a table that the passes of a fit read many times."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def fit_family(
    train: DataFrame,
    targets: Mapping[str, DataFrame],
    encoder: ft.Encoder,
    rows: int,
    representation: ft.Representation,
    family: str,
    settings: Settings,
    seed_offset: int,
    truth: bool,
    at_once: int = 1,
) -> tuple[dict[str, DataFrame], dict]:
    """Fit one candidate on encoded rows; its scores of every target, written, and its record. ``at_once`` fits share the cores."""
    key, labels, id_col = candidate_key(representation, family), settings.label_cols, settings.id_col
    record = {"model_input_features": encoder.size, "adapter": None, "explained_variance": None,
              "mlp_epochs_completed": None, "mlp_final_loss": None, "mlp_reached_epoch_budget": None}
    if family == MLP:
        adapter = fit_adapter(
            train, encoder.size, rows, settings.components, seed=settings.seed + seed_offset
        )
        with _kept(apply_adapter(train, adapter, [id_col, *labels], rows)) as dense:
            network = fit_mlp(
                dense, labels, id_col, adapter.components,
                max_epochs=settings.epochs, seed=settings.seed + seed_offset, shards=settings.shards,
            )
        record.update(
            model_input_features=adapter.components,
            adapter=f"truncated SVD {adapter.components} and standard scaling",
            explained_variance=adapter.explained_variance,
            mlp_epochs_completed=network.epochs,
            mlp_final_loss=network.final_loss,
            mlp_reached_epoch_budget=network.reached_epoch_budget,
        )

        def score(target):
            keep = [id_col, *(labels if truth else ())]
            return score_multi(apply_adapter(target, adapter, keep, target.count()), network, [id_col], key, truth)
    else:
        chosen = settings.linear[representation.name, family]
        fit = fit_logistic if family == LOGISTIC else fit_linear_svm
        model = fit(
            train, labels, encoder.size, chosen.costs(labels), chosen.balanced & set(labels),
            tolerance=settings.tolerance, rows=rows, at_once=at_once,
        )

        def score(target):
            return score_linear(target, model, [id_col], key, truth)

    return {name: stage(score(target), f"scores_{key}", keep=True) for name, target in targets.items()}, record


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


@dataclass(frozen=True)
class CrossValidation:
    """Out-of-fold scores, the fold table, and what follows from them."""

    oof_scores: DataFrame
    fold_results: DataFrame
    summary: DataFrame
    per_label: DataFrame
    best: str


def fold_record_schema() -> str:
    return (
        "fold int, candidate string, representation string, model_family string, training_rows bigint, "
        "validation_rows bigint, feature_count bigint, model_input_features bigint, model_input_adapter string, "
        "adapter_explained_variance_ratio double, mlp_epochs_completed int, mlp_final_loss double, "
        "mlp_reached_epoch_budget boolean, feature_seconds double, model_seconds double"
    )


def cross_validate(rows: DataFrame, folds: Sequence[int], settings: Settings) -> CrossValidation:
    """Fit every candidate on each fold's other rows and score the fold.

    ``rows`` has id, text, labels and ``fold``, and is best written beforehand. The terms are
    counted once for all folds; each fold's vocabulary is the total less the fold. A fold's rows are
    encoded once per representation and shared by the families. Folds depend on nothing of each other, so
    ``settings.folds_at_once`` of them are fitted at a time: their passes are many small jobs, which then fill the cluster.
    """
    with scratch(rows.sparkSession):
        return _cross_validate(rows, folds, settings)


def _cross_validate(rows: DataFrame, folds: Sequence[int], settings: Settings) -> CrossValidation:
    labels, id_col = list(settings.label_cols), settings.id_col
    base = rows.select(id_col, settings.text_col, "fold", *labels)
    sizes = {row["fold"]: row["count"] for row in base.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    scores, records = [], []
    at_once = max(1, min(settings.folds_at_once, len(folds)))
    for representation in settings.representations:
        # Written, as the counts and the encoding of every fold read it.
        folded = stage(base.withColumn(settings.text_col, ft.folded_text(settings.text_col, representation)), "folded")
        counts = ft.fold_term_counts(folded, representation, "fold", folds, settings.text_col)

        def fit_fold(fold: int, representation=representation, folded=folded, counts=counts) -> list[tuple[DataFrame, tuple]]:
            started = time.perf_counter()
            train_rows = total - sizes[fold]
            vocab = ft.vocabulary(
                ft.training_counts(counts, fold), train_rows, representation.min_df, representation.max_df,
                representation.max_features, written=True,
            )
            encoder = ft.fit_encoder(vocab, representation, train_rows)
            found = []
            unmade = ft.encode_text(folded, settings.text_col, representation, encoder, [id_col, "fold", *labels], unmade=True)
            with _kept(unmade.packed(apart="fold")) as encoded:
                encoded.count()
                feature_seconds = time.perf_counter() - started
                train, valid = encoded.where(F.col("apart") != fold), encoded.where(F.col("apart") == fold)
                for number, family in enumerate(settings.families):
                    started = time.perf_counter()
                    made, record = fit_family(
                        train, {"valid": valid}, encoder, train_rows, representation, family, settings,
                        (fold + 1) * 100 + number * 10, truth=True, at_once=at_once,
                    )
                    found.append((
                        made["valid"].withColumn("fold", F.lit(fold)),
                        (fold, candidate_key(representation, family), representation.name, family, train_rows,
                         sizes[fold], encoder.size, record["model_input_features"], record["adapter"],
                         record["explained_variance"], record["mlp_epochs_completed"], record["mlp_final_loss"],
                         record["mlp_reached_epoch_budget"], feature_seconds, time.perf_counter() - started),
                    ))
            return found

        with ThreadPool(at_once) as pool:
            for table, record in sum(pool.map(fit_fold, folds), []):
                scores.append(table)
                records.append(record)
    oof = _union(scores)
    return summarise(base, oof, rows.sparkSession.createDataFrame(records, fold_record_schema()), settings)


def summarise(base: DataFrame, oof: DataFrame, records: DataFrame, settings: Settings) -> CrossValidation:
    """Check that every row was scored once by each candidate, and measure."""
    id_col = settings.id_col
    per_row = len(settings.candidates()) * len(settings.label_cols)
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    cells = oof.groupBy(id_col).agg(F.count_if(finite).alias("cells"))
    complete = cells.where(F.col("cells") == per_row).select(id_col)
    checks.require(
        checks.check_coverage(base, complete, id_col), ["missing", "repeated", "unexpected"],
        "Every row needs one finite score per candidate and label",
    )
    by_fold = metrics.all_metrics(oof, id_col, ["fold", "candidate"], settings.threshold)
    fold_results = stage(records.join(by_fold, ["fold", "candidate"]), "fold_results", keep=True)
    overall = metrics.all_metrics(oof, id_col, ["candidate"], settings.threshold)
    ranked = metrics.rank_candidates(metrics.fold_summary(fold_results, overall, "model_seconds"))
    summary = stage(ranked, "summary", keep=True)
    best = summary.where("position = 1").first()["candidate"]
    per_label = metrics.per_label_table(oof, ["candidate"], settings.threshold)
    return CrossValidation(oof, fold_results, summary, per_label, best)


def fit_and_score(
    train: DataFrame,
    targets: Mapping[str, DataFrame],
    settings: Settings,
    keys: Sequence[str] | None = None,
    seed_offset: int = 700,
    truth: bool = True,
) -> dict[str, DataFrame]:
    """Fit the candidates (all, or the given keys) once on ``train`` and score every target table.

    Representations that no wanted candidate uses are not built.
    """
    with scratch(train.sparkSession):
        return _fit_and_score(train, targets, settings, settings.wanted(keys), seed_offset, truth)


def _fit_and_score(
    train: DataFrame, targets: Mapping[str, DataFrame], settings: Settings, wanted: Sequence[str], seed_offset: int, truth: bool
) -> dict[str, DataFrame]:
    labels, id_col, text_col = list(settings.label_cols), settings.id_col, settings.text_col
    rows = train.count()
    keep = [id_col, *(labels if truth else ())]
    scores: dict[str, list[DataFrame]] = {name: [] for name in targets}
    for representation in settings.representations:
        families = [f for f in settings.families if candidate_key(representation, f) in wanted]
        if not families:
            continue
        text = ft.folded_text(text_col, representation).alias(text_col)
        # Written, as the vocabulary and the encoder read it.
        folded = stage(train.select(id_col, *labels, text), "folded")
        vocab = ft.vocabulary(
            ft.text_term_counts(folded, text_col, representation), rows, representation.min_df, representation.max_df,
            representation.max_features,
        )
        encoder = ft.fit_encoder(vocab, representation, rows)
        # Encoded once for all families. A single linear fit reads its rows once and keeps them itself.
        once = len(families) == 1 and families[0] != MLP

        def encoded_rows(table: DataFrame, columns: Sequence[str], held: ExitStack, representation=representation, encoder=encoder, once=once):
            made = ft.encode_text(table, text_col, representation, encoder, columns, unmade=True)
            return made if once else held.enter_context(_kept(made.packed()))

        with ExitStack() as held:
            encoded_targets = {name: encoded_rows(target.select(*keep, text), keep, held) for name, target in targets.items()}
            encoded = encoded_rows(folded, [id_col, *labels], held)
            for family in families:
                number = FAMILIES.index(family)
                made, _ = fit_family(
                    encoded, encoded_targets, encoder, rows, representation, family, settings,
                    seed_offset + number * 10, truth,
                )
                for name, table in made.items():
                    scores[name].append(table)
    whole = {name: _union(tables) for name, tables in scores.items()}
    for name, table in whole.items():
        found = {row["candidate"] for row in table.select("candidate").distinct().collect()}
        if found != set(wanted):
            raise RuntimeError(f"Scores of {name} lack {sorted(set(wanted) - found)}")
    return whole


def refit_and_score(
    labelled: DataFrame, unlabelled: DataFrame, keys: Sequence[str], settings: Settings
) -> DataFrame:
    """Refit only the given candidates on all labelled rows and score the unlabelled ones."""
    return fit_and_score(
        labelled, {"test": unlabelled}, settings, keys=keys, seed_offset=900, truth=False
    )["test"]


def prepare_tables(
    labelled: DataFrame, settings: Settings, unlabelled: DataFrame | None = None, template: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The tables with null texts as empty ones, written, once they hold what the rest of the plan relies on.

    Ids must be present and unique in each table, labels 0 or 1, and the template must have the ids of the
    unlabelled rows. Anything else is an error that names the counts.
    """
    id_col, text_col, labels = settings.id_col, settings.text_col, list(settings.label_cols)
    given = {"labelled": labelled, "unlabelled": unlabelled, "template": template}
    given = {name: df for name, df in given.items() if df is not None}
    needed = {"labelled": [id_col, text_col, *labels], "unlabelled": [id_col, text_col], "template": [id_col]}
    for name, df in given.items():
        checks.require_columns(df, needed[name])
        checks.require(checks.check_ids(df, id_col), ["null_ids", "repeated_id_rows"], f"Unusable ids in {name}")
    checks.require(checks.check_labels(labelled, labels), [f"invalid_{c}" for c in labels], "Labels other than 0 and 1")
    if unlabelled is not None and template is not None:
        checks.require(
            checks.check_reconcile(unlabelled, template, id_col), ["row_difference", "only_left", "only_right"],
            "The template does not have the ids of the unlabelled rows",
        )
    return {name: stage(df if name == "template" else checks.clean_text(df, text_col), name) for name, df in given.items()}


def split_rows(
    rows: DataFrame, k: int, settings: Settings, meta_fraction: float | None = None, audit_fraction: float = 0.5
) -> DataFrame:
    """Rows with ``partition`` and ``fold``, whole duplicate groups together, written and checked."""
    with scratch(rows.sparkSession):
        return _split_rows(rows, k, settings, meta_fraction, audit_fraction)


def _split_rows(rows: DataFrame, k: int, settings: Settings, meta_fraction: float | None, audit_fraction: float) -> DataFrame:
    labels, id_col = list(settings.label_cols), settings.id_col
    rows = checks.clean_text(rows, settings.text_col)
    checks.require(checks.check_ids(rows, id_col), ["null_ids", "repeated_id_rows"], "Unusable ids")
    checks.require(checks.check_labels(rows, labels), [f"invalid_{c}" for c in labels], "Labels other than 0 and 1")
    keyed = stage(with_group_key(rows.select(id_col, settings.text_col, *labels), settings.text_col), "keyed")
    groups = stage(group_table(keyed, id_col, labels), "groups")
    plan = split_groups(groups, k, settings.seed, labels, meta_fraction, audit_fraction)
    split = stage(assign_rows(keyed, plan, ["partition", "fold"], id_col), "split", keep=True)
    part = F.concat_ws("/", "partition", F.col("fold").cast("string"))
    checks.require(
        checks.check_no_group_crosses(split.withColumn("_part", part), "group_key", "_part"),
        ["crossing_groups"], "Duplicate groups in two parts",
    )
    checks.require(
        checks.check_coverage(keyed, split.where("partition IS NOT NULL"), id_col),
        ["missing", "repeated", "unexpected"], "Rows without exactly one part",
    )
    for part_col, table in (("fold", split.where("partition = 'dev'")), ("partition", split)):
        outcomes = checks.check_both_outcomes(table, part_col, labels)
        # The other rows matter only where they are trained on: for folds, not for partitions.
        ok = "has_both" if part_col == "fold" else "positives > 0 AND negatives > 0"
        lacking = outcomes.where(f"NOT ({ok})").select(part_col, "label").collect()
        if lacking:
            raise ValueError(f"Parts without both outcomes: {[tuple(row) for row in lacking]}")
    return split


@dataclass(frozen=True)
class Blend:
    """Learned weights, the audit, the table of results, and whether the blend may be used."""

    weights: DataFrame
    optimisation_auc: float
    audit: DataFrame
    audit_per_label: DataFrame
    results: DataFrame
    accepted: bool


def learn_blend(
    split: DataFrame, best: str, settings: Settings, mode: str = "global", draws: int = 384
) -> Blend:
    """Fit on dev rows, learn rank weights on ``meta_opt`` and audit them once on ``meta_audit``."""
    id_col, labels, keys = settings.id_col, list(settings.label_cols), settings.candidates()
    parts = {name: split.where(F.col("partition") == name) for name in ("dev", "meta_opt", "meta_audit")}
    scored = fit_and_score(
        parts["dev"], {name: parts[name] for name in ("meta_opt", "meta_audit")}, settings
    )
    pool = blend.pool_table(
        split.sparkSession, blend.weight_pool(len(keys), draws, settings.seed + 303)
    )
    ranks = blend.fractional_ranks(scored["meta_opt"], id_col)
    found = stage(blend.search_weights(ranks, id_col, keys, pool, mode), "found_weights")
    weights = stage(blend.blend_weights_table(found, keys, labels), "weights")
    checks.require(blend.check_weights(weights), ["labels_off_one"], "Weights must sum to one")
    blended = blend.apply_weights(scored["meta_audit"], weights, id_col, keep=["truth"])
    per_label = stage(
        metrics.rank_auc_only(blended.withColumn("candidate", F.lit("rank_blend"))), "blend_audit"
    )
    single = metrics.all_metrics(
        scored["meta_audit"].where(F.col("candidate") == best), id_col, threshold=settings.threshold
    )
    audit = stage(blend.audit_blend(per_label, single), "audit")
    optimisation_auc = found.agg(F.avg("roc_auc")).first()[0]
    results = stage(blend.blend_results(audit, optimisation_auc, single), "blend_results")
    return Blend(
        weights, optimisation_auc, audit, stage(blend.audit_per_label(blended), "audit_per_label"), results,
        bool(audit.first()["accepted"]),
    )


def submission_tables(
    labelled: DataFrame,
    unlabelled: DataFrame,
    template: DataFrame,
    best: str,
    settings: Settings,
    weights: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Checked prediction tables in template order: the best candidate, and the blend if weights are given."""
    id_col, labels = settings.id_col, list(settings.label_cols)
    scores = refit_and_score(labelled, unlabelled, settings.candidates() if weights is not None else [best], settings)
    tables = {"best_single": scores.where(F.col("candidate") == best)}
    if weights is not None:
        tables["rank_blend"] = blend.apply_weights(scores, weights, id_col)
    aligned = {}
    for name, table in tables.items():
        aligned[name] = submit.align_to_template(table, template, id_col, labels)
        checks.require(
            submit.check_submission(aligned[name], template, id_col, labels),
            ["missing_scores", "non_finite_scores", "out_of_range_scores", "row_difference"],
            f"Unusable submission {name}",
        )
    return aligned


def write_submissions(tables: Mapping[str, DataFrame], folder: str, id_col: str, label_cols: Sequence[str]) -> dict[str, str]:
    """Write every prediction table as headered CSV below ``folder``; returns the paths."""
    paths = {name: f"{folder}/submission_{name}" for name in tables}
    for name, table in tables.items():
        write_table(table.select(id_col, *label_cols), paths[name])
    return paths
