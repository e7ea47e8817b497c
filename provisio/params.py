"""Parameters of a reserving run and the fixed values of the method.

The constants in the "fixed values" block must stay equal to the method's
published values for results to agree; they are listed plainly, in natural
order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# ---------------------------------------------------------------------------
# Fixed values (method constants; must equal the reference behaviour)
# ---------------------------------------------------------------------------
TARGET_BRANCHES = [
    "AUTOMOBILE",
    "AUTRES DOMMAGES AUX BIENS",
    "CAUTION",
    "DOMMAGES CORPORELS",
    "INCENDIE & MULTIRISQUES",
    "RESPONSABILITE CIVILE",
    "RISQUE AGRICOLE",
    "SANTE",
    "TRANSPORT",
    "VOYAGE",
]
DEFAULT_DATE_EVAL = date(2025, 12, 31)
DEFAULT_FRAIS_GENERAUX = 2_500_000.0
DEFAULT_LOSS_RATIO = 0.65
TAUX_PREC_MIN = 0.72
FG_LOADING = 0.5                 # rate = max(floor, LR + 0.5 * FG_share / PE)
IBNR_LOSS_RATIO = 0.72           # default market loss ratio of the IBNR model
IBNR_LF_EXPIRED = 0.05           # lag factor of an expired contract
IBNR_LF_BASE = 0.95              # LF = 0.95 - 0.90 * maturity
IBNR_LF_SLOPE = 0.90
NULL_EXERCICE = "NR"
TOTAL_ROW = "TOTAL"
TOTAL_COL = "Total"
AUTO_BRANCH = "AUTOMOBILE"
AUTO_RC = "AUTO RC"
AUTO_AR = "AUTO AR"
BODILY_BRANCH = "DOMMAGES CORPORELS"
HEALTH_BRANCH = "SANTE"
HIDDEN_CU_BRANCHES = ["SANTE", "DOMMAGES CORPORELS"]
MANUAL_PSAP_BRANCHES = ["SANTE"]
# platform share per underwriting year: (year, platform, off-platform)
PLATFORM_SHARE_DEFAULTS = [
    ("2022", 0.0, 1.0),
    ("2023", 0.65, 0.35),
    ("2024", 0.78, 0.22),
    ("2025", 0.67, 0.33),
]
PLATFORM_SHARE_OTHER_YEAR = (0.0, 1.0)     # parameter layer default
PLATFORM_SHARE_MISSING_CALC = (0.0, 0.0)   # calculation layer default
# guarantee share per channel: (type, platform, off-platform)
GUARANTEE_SHARE_DEFAULTS = [
    ("AUTO RC", 0.87, 0.82),
    ("AUTO AR", 0.13, 0.18),
]
PARQUET_COMPRESSION = "zstd"
PARQUET_ROW_GROUP_ROWS = 100_000


@dataclass(frozen=True)
class ReservingParams:
    """Scalar and dimension parameters of one evaluation."""

    date_eval: date = DEFAULT_DATE_EVAL
    frais_generaux: float = DEFAULT_FRAIS_GENERAUX
    taux_min: float = TAUX_PREC_MIN
    mapping: dict = field(default_factory=dict)          # observed -> target branch
    loss_ratios: dict = field(default_factory=dict)      # branch -> LR (rate step)
    loss_ratios_split: dict = field(default_factory=dict)  # branch -> LR (CU step)
    platform_shares: list = field(default_factory=lambda: list(PLATFORM_SHARE_DEFAULTS))
    guarantee_shares: list = field(default_factory=lambda: list(GUARANTEE_SHARE_DEFAULTS))
    psap_overrides: list = field(default_factory=list)   # [(Branche, Exercice, amount)]
    exact_amounts: bool = False                          # premiums and claims summed as decimals

    def ibnr_loss_ratio(self) -> float:
        return float(self.loss_ratios_split.get(BODILY_BRANCH, IBNR_LOSS_RATIO))
