"""Names, markers, registries and parameter grids.

These are stated as they must be for results to agree with the inputs users
already have (file names, month names, metric names, model availability).
"""

# Spanish month names, short and full, to month number.
MONTH_NAMES = {
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6,
    "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}

# Cell texts that stand for "no value"; the first marks a confidential cell.
MISSING_MARKERS = ["'-", "", "NA", "-", "N/A"]

# Header texts (trimmed, lower case) that name the date column.
DATE_HEADERS = ["fecha", "date", "ds"]

# Metric name (trimmed, lower case) to metric group.
METRIC_GROUPS = {
    "parados": "abc",
    "afiliados": "abc",
    "demandantes": "abc",
    "contratos": "de",
    "p. contratadas": "de",
    "personas contratadas": "de",
}

# (metric group, scope, model) triples that can be run.
AVAILABLE_MODELS = [
    ("abc", "estatal", "NP"),
    ("abc", "estatal", "LSTM"),
    ("abc", "atributo", "NP"),
    ("abc", "atributo", "LSTM"),
    ("de", "estatal", "NP"),
    ("de", "estatal", "XGBoost"),
    ("de", "atributo", "NP"),
    ("de", "atributo", "XGBoost"),
]

MODEL_DISPLAY = {
    "NP": "NeuralProphet",
    "LSTM": "LSTM",
    "XGBoost": "XGBoost",
    "Ensemble": "Ensemble",
}

# Files with more value columns than this need a column range.
WIDE_GATE = 53

# Months kept back for comparing parameter sets when a file has many series.
HOLDOUT_MONTHS = 12

# Months of a series that lie further than this from its others, in a group of at most
# that many, are mistyped.
FAR_MONTHS = 120
FAR_GROUP = 12

# Missing training values: gaps of up to so many months are interpolated, longer ones and
# those at the ends take the mean of the values within so many months.
FILL_GAP = 10
FILL_WINDOW = 10

# Rolling-origin window for one national series, in months.
ROLLING = {"train": 96, "val": 36, "step": 12}

# Smallest denominator of a percentage error (float64 machine epsilon).
EPSILON = 2.220446049250313e-16

# Titles of the error table: mean over the series of an attribute, and one national series.
ERROR_TITLE_MEAN = "MAPE esperado 1 año promedio "
ERROR_TITLE = "MAPE esperado 3 años"

# Parameter grids.
TREE_GRID = {
    "colsample_bytree": [0.4, 0.7, 1.0],
    "learning_rate": [0.01, 0.1, 0.5],
    "max_depth": [3, 5, 10],
    "n_estimators": [500, 1000, 2000],
}
TREE_PENALTIES = {"reg_lambda": 0.0, "reg_alpha": 10000.0, "gamma": 10000.0}
TREND_SEASON_GRID = {"growth": ["linear"], "n_changepoints": [10], "seasonality_mode": ["additive"]}
TREND_SEASON_GRID_FULL = {
    "growth": ["linear", "discontinuous"],
    "n_changepoints": [10, 20, 50],
    "seasonality_mode": ["additive", "multiplicative"],
}
TREND_SEASON_PANEL_GRID = {"growth": ["linear"], "n_changepoints": [1], "seasonality_mode": ["additive"]}
TREND_SEASON_PANEL_GRID_FULL = {
    "growth": ["linear", "discontinuous"],
    "n_changepoints": [1, 10, 20],
    "seasonality_mode": ["additive", "multiplicative"],
}
AR_LAGS = 2
DECOMPOSED_GRID = {"lags": [2, 6, 12, 18]}

# Trend + calendar-month grid of the closed-form model.
TREND_MONTH_GRID = {"growth": ["linear", "flat"], "seasonality_mode": ["additive", "multiplicative"]}
