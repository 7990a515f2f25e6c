"""Parameters of the feature build and the forecast tournament.

Defaults are the reference behaviour; bindings to other tables override the
column roles only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's for equal results.
# ---------------------------------------------------------------------------
TARGET_LAGS = (1, 2, 3, 5, 7, 14)
ROLLING_WINDOWS = (3, 7, 14)
EMA_SPANS = (3, 7)
CHANGE_LAGS = (2, 3, 7)  # lag1 - lag2 ("<t>_change"), lag1 - lag3, lag1 - lag7
WEATHER_CHANGE_LAGS = (1, 3)
RECENCY_HALF_LIFE_DAYS = 75
N_SPLITS = 5
RIDGE_ALPHAS = (0.5, 1.0, 3.0, 10.0, 30.0, 100.0)
MIN_HISTORY_ROWS = 23
HORIZONS = (("day1", 1), ("day2", 2), ("day3", 3))
ANCHOR_STRENGTHS = {"day1": 0.70, "day2": 0.55, "day3": 0.40}
FORECAST_SLOTS = (7, 15, 23)
RANGE_EDGES = (20, 40, 60, 80, 100)  # closed on the left: [20, 40) ...
CANDIDATE_ORDER = ("RandomForest", "Ridge", "boosted_trees")
HOLDOUT_FRACTION = 0.2
HOLDOUT_SEED = 42
KELVIN_OFFSET = 273.15
CITY_CENTRE = (24.8607, 67.0011)
RAIN_KEYS = {"current": "1h", "forecast": "3h"}

# AQI bands, closed on the right: (upper bound, label, colour); None = above 300.
AQI_BANDS = (
    (50, "Good", "#34d399"),
    (100, "Moderate", "#fbbf24"),
    (150, "Unhealthy for Sensitive Groups", "#fb923c"),
    (200, "Unhealthy", "#fb7185"),
    (300, "Very Unhealthy", "#c084fc"),
    (None, "Hazardous", "#64748b"),
)

# Health guidance, closed on the right: (upper bound, level, text).
GUIDANCE = (
    (50, "success", "Air quality is good. Outdoor activity is fine for most people."),
    (100, "info", "Acceptable air quality. Sensitive individuals should watch symptoms."),
    (150, "warning", "Sensitive groups should limit prolonged outdoor exposure."),
    (None, "error", "Limit outdoor activity. Consider a mask if you must go outside."),
)

# Pollutant limits (ug/m3) and bar colours below 60 % / below 100 % / above.
POLLUTANT_LIMITS = (("pm25", 60), ("pm10", 100), ("ozone", 100))
LIMIT_COLOURS = ("#34d399", "#fbbf24", "#fb7185")

# Random-forest search grid of the reference (24 points), in MLlib parameter names.
# max_depth None -> 30; max_features 0.7 -> "0.7".
REFERENCE_RF_GRID = {
    "numTrees": (200, 300),
    "maxDepth": (8, 12, 30),
    "minInstancesPerNode": (1, 2),
    "featureSubsetStrategy": ("sqrt", "0.7"),
}

# Weekday names in Monday=0 order; the legacy codes are their alphabetical rank.
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# ---------------------------------------------------------------------------


# Boosted-tree settings (our own, four as the third candidate's search has): fits stop ``patience`` trees after the best.
GBT_SETTINGS = tuple({"maxIter": 300, "maxDepth": d, "stepSize": r, "minInstancesPerNode": 5, "patience": 25}
                     for d, r in ((3, 0.1), (4, 0.05), (4, 0.1), (6, 0.05)))


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles of a raw reading table.

    ``fill_cols`` are interpolated in time and are model inputs as is;
    ``lag_change_cols`` get lag 1 and first difference (pollutants);
    ``delta_cols`` get 1- and 3-step differences (weather).
    """

    key: str = "series_key"
    time: str = "ts"
    date: str = "date"
    target: str = "aqi"
    fill_cols: tuple = ("temperature", "humidity", "pressure", "wind_speed", "rain",
                        "pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide",
                        "sulphur_dioxide", "ozone")
    lag_change_cols: tuple = ("pm2_5", "pm10", "ozone", "nitrogen_dioxide")
    delta_cols: tuple = ("temperature", "humidity", "wind_speed", "pressure")
    lags: tuple = TARGET_LAGS
    windows: tuple = ROLLING_WINDOWS
    spans: tuple = EMA_SPANS

    def feature_cols(self) -> list[str]:
        t = self.target
        cols = list(self.fill_cols)
        cols += ["month", "day", "day_of_week", "is_weekend",
                 "month_sin", "month_cos", "dow_sin", "dow_cos"]
        cols += [f"{t}_lag_{k}" for k in self.lags]
        for w in self.windows:
            cols += [f"{t}_rolling_mean_{w}", f"{t}_rolling_std_{w}"]
        cols += [f"{t}_ema_{s}" for s in self.spans]
        cols += [f"{t}_change", f"{t}_change_3", f"{t}_change_7"]
        cols += [f"{c}_lag_1" for c in self.lag_change_cols]
        cols += [f"{c}_change_1" for c in self.lag_change_cols]
        cols += [f"{c}_change_1" for c in self.delta_cols]
        cols += [f"{c}_change_3" for c in self.delta_cols]
        return cols


# Binding of the driver's lineitem table: y = price, x4 is a sparse sensor.
LINEITEM_SPEC = FeatureSpec(
    target="y",
    fill_cols=("x1", "x2", "x3", "x4"),
    lag_change_cols=("x1", "x4"),
    delta_cols=("x2", "x3"),
)


@dataclass(frozen=True)
class ForecastSpec:
    features: FeatureSpec = field(default_factory=lambda: LINEITEM_SPEC)
    horizons: tuple = HORIZONS
    n_splits: int = N_SPLITS
    # daily rows a series needs before it is trained on
    min_history_days: int = MIN_HISTORY_ROWS
    half_life_days: float = RECENCY_HALF_LIFE_DAYS
    alphas: tuple = RIDGE_ALPHAS
    candidates: tuple = CANDIDATE_ORDER
    seed: int = 42
    # None: tree fits see every row; a number: a hash sample of so many rows, on which every row is still scored
    fit_rows: int | None = None
    # the forest's point is chosen by mean fold MAE on the target, the boosted trees' setting by pooled MAE on levels
    rf_grid: tuple = field(default_factory=lambda: grid_points(REFERENCE_RF_GRID))
    gbt_grid: tuple = GBT_SETTINGS


def grid_points(grid: dict) -> tuple:
    """Expand {param: values} into a tuple of parameter dicts (product order)."""
    from itertools import product
    names = list(grid)
    return tuple(dict(zip(names, combo)) for combo in product(*(grid[n] for n in names)))


# What the registered tournament searches: the reference's 24 forests, as the random_forest query does, and all
# boosted-tree settings.
TOURNAMENT_SPEC = ForecastSpec()
