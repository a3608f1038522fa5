"""Column contract of the feature table and the label conventions."""

from __future__ import annotations

# Names and order every trained head relies on.
BLOCKS = ["alpha_1", "alpha_2", "alpha_3", "pi_1", "pi_2", "pi_3",
          "pihat_12", "pihat_13", "pihat_23"]
MOMENTS = ["mean", "variance", "se"]
CLASSES = ["A", "B", "C"]
CONTROL = "D"
FIXED_RATES = [5e-7, 2.5e-6, 5e-5, 2.5e-4]
APPRECIABLE = 2.5e-4

STATISTICS = [f"{b}_{m}" for b in BLOCKS for m in MOMENTS]
FEATURES = ["g", *STATISTICS]


def _pick(blocks=BLOCKS, moments=MOMENTS) -> list[str]:
    return ["g"] + [f"{b}_{m}" for b in BLOCKS for m in MOMENTS if b in blocks and m in moments]


CHANNELS = {
    "full": _pick(),
    "richness": _pick([b for b in BLOCKS if b.startswith("alpha")]),
    "private": _pick([b for b in BLOCKS if b.startswith("pi_")]),
    "pairwise": _pick([b for b in BLOCKS if b.startswith("pihat")]),
    "asymmetric": _pick([b for b in BLOCKS if not b.startswith("alpha")]),
}
MOMENT_SETS = {
    "mean_only": _pick(moments=["mean"]),
    "mean_var": _pick(moments=["mean", "variance"]),
    "mean_se": _pick(moments=["mean", "se"]),
    "var_only": _pick(moments=["variance"]),
    "full": _pick(),
}


def validate_populations(pop_order, present=None) -> list[str]:
    """The feature contract needs exactly three distinct populations, given explicitly."""
    order = list(pop_order)
    if present is not None and sorted(order) != sorted(present):
        raise ValueError(f"pop_order {order} does not match populations {sorted(present)}")
    if len(order) != 3 or len(set(order)) != 3:
        raise ValueError(f"exactly three distinct populations are needed, got {order}")
    return order


def feature_subset(features, columns, extra=()):
    """Keep a channel or moment set by name or list, plus label columns."""
    if isinstance(columns, str):
        columns = CHANNELS.get(columns) or MOMENT_SETS[columns]
    return features.select(*extra, *columns)
