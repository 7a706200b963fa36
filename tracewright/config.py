"""Gates and constants of chart digitisation, each with its default; operators take them as parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import date

# The normalised range, length units in millimetres, and the day on which the sheets changed units.
NORM = 1000.0
BAVARIAN_FOOT_MM = 291.859
BAVARIAN_ZOLL_MM = BAVARIAN_FOOT_MM / 12.0
UNIT_SWITCH = date(1872, 4, 1)


@dataclass(frozen=True)
class Gates:
    """Quality gates; a profile replaces some of them."""

    iou_duplicate: float = 0.8
    panel_confidence: float = 0.5
    least_plot_share: float = 0.25
    row_overlap: float = 0.5
    crop_margin: float = 0.12
    edge_inward: float = 0.05
    mad_cut: float = 3.5
    mad_scale: float = 1.4826
    fit_rounds: int = 5
    least_ticks: int = 3
    least_r2: float = 0.995
    most_residual: float = 0.02
    scale_stickiness: float = 0.05
    magnitude_gap: float = 1.5
    donor_slope: float = 0.03
    anchor_span: float = 0.05
    alpha: float = 0.69
    viable_coverage: float = 0.985
    tie_margin: float = 0.05
    separation_share: float = 0.015
    separation_least: float = 3.0
    separation_samples: int = 64
    slices: int = 100
    match_iou: float = 0.2
    sliver: float = 0.3
    month_days: float = 0.5
    reselect_budget: int = 1


ANNUAL = Gates()
GENERIC = Gates(viable_coverage=0.90)


def dump(gates: Gates) -> str:
    """The gates a run was made with, as its manifest keeps them."""
    return json.dumps(asdict(gates), sort_keys=True)
