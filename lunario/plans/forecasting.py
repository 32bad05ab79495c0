"""Forecast of every input file with every model available for it.

Observations are cleaned and brought to one panel, whose fold rows are written once
to the shared folder, in buckets by file and series; each model then runs over all
files and series of its metric group in one job that reads its rows from there
without another exchange.
"""

from pyspark.sql import functions as F

from lunario.fixed import (
    AR_LAGS,
    AVAILABLE_MODELS,
    DECOMPOSED_GRID,
    HOLDOUT_MONTHS,
    ROLLING,
    TREE_GRID,
    TREND_SEASON_GRID,
    TREND_SEASON_PANEL_GRID,
)
from lunario.functions.calendar import default_horizon, month_label
from lunario.functions.text import round_half_even
from lunario.operators import panel, registry
from lunario.operators.intervals import with_bounds
from lunario.operators.models import records
from lunario.operators.models.autoregression import decomposed_ar
from lunario.operators.models.trees import panel_trees
from lunario.operators.models.trend_season import trend_season
from lunario.operators.scoring import ensemble_mean, stack_models
from lunario.plans.control import allowed_sets, control_rows, controlled, forecast_until, in_range
from lunario.session import bucketed, written
from lunario.sources.delimited import month_panel, split_rejects
from lunario.sources.names import with_file_metadata
from lunario.sources.versions import replace

KEYS = ("file_id", "series")

MODEL_JOBS = {
    # this model learns from every month of its training window
    "NP": lambda rows, grid, group: trend_season(
        panel.fill_missing(rows, (*KEYS, "fold_id")), grid, AR_LAGS if group == "abc" else 0, KEYS
    ),
    "LSTM": lambda rows, grid, group: decomposed_ar(rows, grid, KEYS),
    "XGBoost": lambda rows, grid, group: panel_trees(rows, grid, KEYS),
}


def default_grid(group, scope, model):
    if model == "NP":
        return TREND_SEASON_PANEL_GRID if (group, scope) == ("abc", "atributo") else TREND_SEASON_GRID
    return {"LSTM": DECOMPOSED_GRID, "XGBoost": TREE_GRID}[model]


def planned_jobs(grids=None, models=None):
    """(model, group, grid, scopes) per job.

    Scopes that share model, group and grid run as one job.
    """
    jobs = []
    for group, scope, model in AVAILABLE_MODELS:
        if models and model not in models:
            continue
        grid = (grids or {}).get(model) or default_grid(group, scope, model)
        same = [j for j in jobs if j[:3] == (model, group, grid)]
        if same:
            same[0][3].append(scope)
        else:
            jobs.append((model, group, grid, [scope]))
    return jobs


def cleaned_panel(obs, controls=None):
    """(panel, rejects): one row per file, series and month of usable files.

    ``until`` is the last month to forecast where the control table (see
    ``control``) or the file's name have one.
    Files with one national series keep their first value column. Rejects are
    unreadable cells, files whose name or metric is unknown and further columns
    of national files, columns out of the asked range and months far from all others
    of their series, with a reason.
    """
    accepted, rejected = split_rejects(obs)
    known = controlled(registry.with_metric_group(with_file_metadata(accepted)), controls)
    unknown = known.where("metric_group is null").withColumn(
        "reason", F.when(F.col("metric").isNull(), "bad_name").otherwise("unknown_metric")
    )
    usable = known.where("metric_group is not null and (scope = 'atributo' or col_pos = 1)")
    beyond = known.where("metric_group is not null and scope = 'estatal' and col_pos > 1").withColumn(
        "reason", F.lit("not_first_column")
    )
    outside = usable.where(~in_range()).withColumn("reason", F.lit("out_of_range"))
    usable = usable.where(in_range()).withColumn("until", forecast_until())
    # a national file whose value column has no header is named by its metric
    named = F.when((F.col("scope") == "estatal") & (F.col("series") == ""), F.col("metric")).otherwise(F.col("series"))
    usable = usable.withColumn("series", named)
    fields = ["metric_group", "scope", "until"]
    # dealt by series before the windows: islands, months, folds and buckets then share one exchange
    buckets = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    months = panel.far_months(month_panel(usable, [*fields, *KEYS]).repartition(buckets, *KEYS), KEYS)
    far = months.where("reason is not null").select(
        *KEYS, month_label(F.col("ds")).alias("fecha_raw"), F.col("y").cast("string").alias("raw"), "ds", "y", "reason"
    )
    rejects = rejected
    for more in (unknown, beyond, outside):
        rejects = rejects.unionByName(more.select(*rejected.columns))
    return months.where("reason is null").drop("reason"), rejects.unionByName(far, allowMissingColumns=True)


def forecast_all(obs, **options):
    """The forecasts of ``forecast_with_rejects`` alone."""
    return forecast_with_rejects(obs, **options)[0]


def forecast_with_rejects(
    obs, end=None, rolling=None, holdout=HOLDOUT_MONTHS, grids=None, models=None, controls=None
):
    """(forecast rows of all files, series and available models, rejects of the cleaning).

    ``end`` is the last month to forecast as a date column that may use
    ``last_ds``; by default December of the third year after the last month.
    ``controls`` is a table of parameters by file, which go before all others.
    ``rolling`` (train, val, step) tunes national series, the last ``holdout``
    months tune the others. ``grids`` replaces the parameter grid of a model.
    """
    rolling = rolling or (ROLLING["train"], ROLLING["val"], ROLLING["step"])
    end = default_horizon(F.col("last_ds")) if end is None else end
    by_rolling, by_holdout = panel.rolling_folds(*rolling), panel.holdout_folds(holdout)

    def scheme(t, n):
        return F.when(F.col("scope") == "estatal", by_rolling(t, n)).otherwise(by_holdout(t, n))

    controls = None if controls is None else control_rows(controls)
    usable, rejects = cleaned_panel(obs, controls)
    jobs = planned_jobs(grids, models)
    if not jobs:
        raise ValueError(f"no model is available among {models}")
    rows = fold_rows(usable, scheme, end)

    def run(job):
        model, group, grid, scopes = job
        part = rows.where((F.col("metric_group") == group) & F.col("scope").isin(scopes)).drop("metric_group", "scope")
        found = allowed_sets(MODEL_JOBS[model](part, grid, group), controls)
        chosen = with_bounds(records.choose(found, KEYS))
        return records.forecast_rows(chosen, KEYS).withColumn("model", F.lit(model))

    return stack_models(*map(run, jobs)), rejects


def fold_rows(usable, scheme, end):
    """Fold rows of every series, written in buckets by file and series."""
    months = panel.extend_months(usable, F.coalesce("until", end), KEYS).drop("until")
    return bucketed(panel.assign_folds(months, scheme, final=True), "fold_rows", KEYS)


def publish(forecasts):
    """Forecasts with their mean over models, rounded values and file metadata."""
    mean = ensemble_mean(forecasts, KEYS).drop("n_models").withColumn("model", F.lit("Ensemble"))
    every = stack_models(forecasts, mean)
    named = with_file_metadata(every)
    return named.select(
        "metric", "scope", "attribute", "file_id", "series", "model", "ds", "yhat",
        round_half_even(F.col("yhat")).alias("valor"),
        "lower", "upper", "mape", "status",
    )


def publish_rejects(rejects):
    """What the cleaning left out, and why."""
    return rejects.select("file_id", "series", "col_pos", "fecha_raw", "raw", "reason")


def run_forecast(obs, target, **options):
    """Run all models and replace the forecasts and rejects under ``target`` together (see ``versions``)."""
    forecasts, rejects = forecast_with_rejects(obs, **options)
    # the mean over models reads the forecasts a second time
    found = written(forecasts, "forecasts")
    replace({"forecasts": publish(found), "rejects": publish_rejects(rejects)}, target)
