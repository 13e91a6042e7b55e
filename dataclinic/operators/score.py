"""Trajectory scoring (family G): one Column per rubric over trajectory rows.

``enrich`` adds the per-episode context every rubric needs -- parsed command,
the last five commands, the previous accuracy, running counts of validates /
applies / budget -- with the chunked sequence primitives (no episode is ever
windowed whole).  Rubrics are then plain ``when`` expressions (codegen).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_to

from ..functions.expr import clip
from ..functions.sequence import DEFAULT_CHUNK, sequence_features
from . import traj

LOOKBACK = 5
# Fixed values from the reference rubrics ---------------------------------------------------------
ACC_UP, ACC_DOWN = 2.5, 3.0
HIT_BONUS, EFF_BONUS, STRETCH_MULT, STRETCH_CAP, MISS_PENALTY = 0.35, 0.30, 3.0, 0.15, -0.40
PRESERVATION = ((0.92, 0.05), (0.85, 0.02), (0.75, -0.05), (0.50, -0.20))
PRESERVATION_FLOOR = -0.50
FORMAT_OK, FORMAT_BAD = 0.10, -0.10
REWARD_MIN, REWARD_MAX = -1.0, 1.0


def enrich(df: DataFrame, episode: str = "episode_id", step: str = "step", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    d = traj.parse(df)
    cost = F.when(F.col("cmd").isin(traj.DOUBLE_COST), 2).otherwise(1)
    lags = {f"prev{i}": ("cmd", i) for i in range(1, LOOKBACK + 1)}
    lags["prev_accuracy"] = ("accuracy", 1)
    sums = {
        "validates_before": ((F.col("cmd") == "validate"), False),
        "applies_before": ((F.col("cmd") == "apply"), False),
        "budget_used": (cost, True),
        "session_id": (F.col("cmd").isin(traj.SESSION_QUERIES), True),
    }
    d = sequence_features(d, [episode], step, lags, sums, LOOKBACK, chunk)
    d = d.withColumn("prev_accuracy", F.coalesce(F.col("prev_accuracy"), F.col("baseline")))
    return d.withColumn("budget_remaining", F.col("budget_total") - F.col("budget_used"))


def _any_prev(pred, n) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(pred(F.col(f"prev{i}")), F.lit(False)) for i in range(1, n + 1)])


def is_submit() -> Column:
    return F.lower(F.trim(F.col("action"))) == "submit"


def accuracy_rubric() -> Column:
    """G1."""
    cur, prev = F.col("accuracy"), F.col("prev_accuracy")
    imp = cur - prev
    base = F.when(imp > 0, imp * ACC_UP).when(imp < 0, imp * ACC_DOWN).otherwise(F.lit(0.0))
    used, total = F.col("budget_used"), F.col("budget_total")
    hit = (HIT_BONUS + EFF_BONUS * F.greatest(F.lit(0.0), 1.0 - used / F.greatest(total, F.lit(1)))
           + F.least((cur - F.col("target")) * STRETCH_MULT, F.lit(STRETCH_CAP)))
    rng = F.col("target") - F.col("baseline")
    progress = F.when(rng > 0, F.least(F.greatest((cur - F.col("baseline")) / rng, F.lit(0.0)), F.lit(1.0))) \
        .otherwise(F.lit(0.0))
    term = F.when(cur >= F.col("target"), hit).otherwise(MISS_PENALTY * (1.0 - progress))
    return round_to(F.when(is_submit(), base + term).otherwise(base), 4)


def process_rubric() -> Column:
    """Workflow rules over the last five commands (see module docs of the survey)."""
    c = F.col("cmd")
    is_q = c.startswith("query_")
    r = F.lit(0.0)
    r = r + F.when(is_q & _any_prev(lambda p: p.isin("inspect_dataset", "inspect_model"), 3), 0.02).otherwise(0.0)
    same = _any_prev(lambda p: p == c, 3)
    apply3 = _any_prev(lambda p: p == "apply", 3)
    r = r + F.when(is_q & same & ~apply3, -0.05).otherwise(0.0)
    r = r + F.when(c == "apply", F.when(_any_prev(lambda p: p.startswith("query_"), 4), 0.05).otherwise(-0.08)) \
        .otherwise(0.0)
    r = r + F.when((c == "validate") & apply3, 0.04).otherwise(0.0)
    r = r + F.when((c == "validate") & F.coalesce(F.col("prev1") == "validate", F.lit(False)), -0.08).otherwise(0.0)
    loop = ((c == "validate") & F.col("prev2").isNotNull() & _any_prev(lambda p: p == "apply", 2)
            & (F.coalesce(F.col("prev3") == "validate", F.lit(False)) | F.coalesce(F.col("prev4") == "validate", F.lit(False))))
    r = r + F.when(loop, 0.06).otherwise(0.0)
    r = r + F.when(c == "reject", 0.01).otherwise(0.0)
    r = r + F.when(c == "submit", F.when(F.col("validates_before") == 0, -0.15)
                   .when(F.col("applies_before") == 0, -0.05).otherwise(0.0)).otherwise(0.0)
    return round_to(r, 4)


def preservation_rubric() -> Column:
    """G3."""
    pct = F.col("rows") / F.greatest(F.col("original_rows"), F.lit(1))
    e = None
    for thr, val in PRESERVATION:
        e = F.when(pct >= thr, F.lit(val)) if e is None else e.when(pct >= thr, F.lit(val))
    return round_to(e.otherwise(F.lit(PRESERVATION_FLOOR)), 4)


def efficiency_rubric() -> Column:
    """G4 (submit only)."""
    total = F.col("budget_total")
    remaining = F.greatest(F.col("budget_remaining"), F.lit(0))
    used = F.greatest(total - remaining, F.lit(1))
    gain = F.col("accuracy") - F.col("baseline")
    r = (F.when(gain <= 0, -0.10 * used / F.greatest(total, F.lit(1)))
         .when(F.col("accuracy") < F.col("target"), F.least(gain / used * 1.5, F.lit(0.10)))
         .otherwise(F.least(gain / used * 3.0, F.lit(0.25))))
    return F.when(is_submit(), round_to(r, 4)).otherwise(F.lit(0.0))


def step_rubric() -> Column:
    """G5 (apply only); the reference's '< 0.80' branch is unreachable after '< 0.85'."""
    d = F.col("quality_after") - F.col("quality_before")
    r = (F.when(d > 0, clip(d * 0.50, 0.0, 0.12)).when(d < 0, clip(d * 0.60, -0.25, 0.0)).otherwise(F.lit(-0.02)))
    pct = F.col("rows") / F.greatest(F.col("original_rows"), F.lit(1))
    r = r + F.when(pct >= 0.95, 0.02).when(pct >= 0.90, 0.01).when(pct < 0.85, -0.08).otherwise(0.0)
    return F.when(F.col("action").startswith("apply"), clip(r, -0.30, 0.15)).otherwise(F.lit(0.0))


def format_reward() -> Column:
    """G8."""
    return F.when(F.col("valid_format"), F.lit(FORMAT_OK)).otherwise(F.lit(FORMAT_BAD))


RUBRICS = {
    "accuracy": accuracy_rubric,
    "process": process_rubric,
    "preservation": preservation_rubric,
    "efficiency": efficiency_rubric,
}


def register(name: str, builder) -> None:
    """Add a rubric (a function returning a Column over enriched rows)."""
    RUBRICS[name] = builder


# Adjustments added outside the clamp, by event.
ADJUSTMENTS = {"reject": 0.01, "undo": -0.03, "empty_undo": -0.05, "analyst": 0.02, "episode_timeout": -0.10,
               "truth_changed": -1.0, "data_loss": -0.40, "truncated": -0.02}


def adjustments(events: DataFrame, event: str = "event", keys=("episode_id", "step")) -> DataFrame:
    """Sum of the adjustments of each step's events (rows of key and event name);
    unknown events count 0.  Join on the keys and pass as ``penalty`` to ``total``."""
    value = F.lit(0.0)
    for name, v in ADJUSTMENTS.items():
        value = F.when(F.col(event) == name, F.lit(v)).otherwise(value)
    return events.groupBy(*keys).agg(F.sum(value).alias("adjustment"))


def total(cols=None, penalty: Column | None = None) -> Column:
    """Sum of rubric columns clipped to [-1, 1], rounded to 4; penalties outside the clamp."""
    names = list(cols or RUBRICS)
    s = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    t = round_to(clip(s, REWARD_MIN, REWARD_MAX), 4)
    return t + penalty if penalty is not None else t


def score(enriched: DataFrame) -> DataFrame:
    """All registered rubrics as columns plus their clamped total."""
    d = enriched.withColumns({n: b() for n, b in RUBRICS.items()})
    return d.withColumn("total", total(list(RUBRICS)))


def breakdown(scored: DataFrame, keys=("episode_id", "step")) -> DataFrame:
    """One row per (key, rubric, value)."""
    arr = F.array(*[F.struct(F.lit(n).alias("rubric"), F.col(n).cast("double").alias("value")) for n in RUBRICS])
    return scored.select(*keys, F.explode(arr).alias("r")).select(*keys, "r.rubric", "r.value")
