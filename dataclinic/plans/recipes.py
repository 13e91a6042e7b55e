"""the reference's four task recipes, re-aimed at any table's feature list.

Fixed values from the reference (fractions and order per task):
  tutorial: missing 20% on the first feature
  easy:     missing 15% on the first two features; class imbalance 0.60
  medium:   missing 12% on the first three; duplicates 5%; imbalance 0.55; type errors 4% on the first
  hard:     missing 10% on the first four; duplicates 5%; imbalance 0.50; type errors 3% on the first;
            outliers 3% on the second; cross-column 2% on (third, fourth)
"""

from __future__ import annotations

TASKS = ("task_0_tutorial", "task_1_easy", "task_2_medium", "task_3_hard")


def task_recipe(task: str, features: list[str], label: str = "target") -> list:
    f = list(features)
    if task == "task_0_tutorial":
        return [("missing", dict(cols=f[:1], frac=0.20))]
    if task == "task_1_easy":
        return [("missing", dict(cols=f[:2], frac=0.15)),
                ("imbalance", dict(label=label, ratio=0.60))]
    if task == "task_2_medium":
        return [("missing", dict(cols=f[:3], frac=0.12)),
                ("duplicates", dict(frac=0.05)),
                ("imbalance", dict(label=label, ratio=0.55)),
                ("type_errors", dict(col=f[0], frac=0.04))]
    if task == "task_3_hard":
        return [("missing", dict(cols=f[:4], frac=0.10)),
                ("duplicates", dict(frac=0.05)),
                ("imbalance", dict(label=label, ratio=0.50)),
                ("type_errors", dict(col=f[0], frac=0.03)),
                ("outliers", dict(col=f[1], frac=0.03)),
                ("cross_column", dict(a=f[2], b=f[3], frac=0.02))]
    raise ValueError(f"unknown task {task}")
