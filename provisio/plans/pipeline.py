"""End-to-end reserving run (OP-R12).

Two scans in total: the policy rows are aggregated once into per-cell
measures (``PolicyStage``), the claim rows once into per-cell sums
(``ClaimsStage``).  Both per-cell frames are stored in the session's
shared folder; every table of the run is then a small plan over those
tables, so an executor lost late in the run never replays a
full scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.operators import claims as claims_ops
from provisio.operators import premium, reserves
from provisio.operators.mapping import map_policies
from provisio.operators.recap import recap_matrix, stored_with_years, years_of
from provisio.params import ReservingParams
from provisio.plans.report import matrix_cells, render
from provisio.session import materialize
from provisio.sources.production import require_columns

# columns the computation reads (OP-S14); the landing contract is wider
POLICY_REQUIRED = ["Police", "Branche", "Exercice", "Effet", "Echeance", "PN_ACC"]


class PolicyStage:
    """Nothing runs before a result is asked for; the per-cell table is stored
    when it is first needed."""

    def __init__(self, policies_raw: DataFrame, params: ReservingParams, checkpoint: bool = True):
        require_columns(policies_raw, POLICY_REQUIRED, "production")
        self.params = params
        self.checkpoint = checkpoint
        self.mapped = map_policies(policies_raw, params.mapping)

    @cached_property
    def _stored(self) -> tuple[DataFrame, list[str]]:
        agg = premium.policy_cells(self.mapped, self.params.date_eval, self.params.ibnr_loss_ratio(), self.params.exact_amounts)
        return stored_with_years(agg) if self.checkpoint else (agg, years_of(agg))

    @property
    def cells(self) -> DataFrame:
        return self._stored[0]

    @property
    def years(self) -> list[str]:
        return self._stored[1]

    @property
    def last(self) -> str | None:
        """The last year: the lexicographic maximum, as the method."""
        return self.years[-1] if self.years else None

    @cached_property
    def pe(self) -> DataFrame:
        return self.cells.select("Branche", "Exercice", "PE")

    @cached_property
    def taux(self) -> DataFrame:
        p = self.params
        return premium.taux_prec(self.cells, p.loss_ratios, p.frais_generaux, self.last, p.taux_min)

    @cached_property
    def rated(self) -> DataFrame:
        p = self.params
        return premium.rated_cells(self.cells, p.loss_ratios, p.frais_generaux, self.last, p.taux_min)

    @cached_property
    def prec(self) -> DataFrame:
        return self.rated.select("Branche", "Exercice", "PE", "PREC")

    @cached_property
    def pa(self) -> DataFrame:
        return premium.pa_cells(self.prec)

    @cached_property
    def pa_split(self) -> DataFrame:
        p = self.params
        return premium.pa_split(self.pa, p.platform_shares, p.guarantee_shares)

    @cached_property
    def cu(self) -> DataFrame:
        return reserves.cu_cells(self.pa_split, self.params.loss_ratios_split)

    @cached_property
    def ibnr(self) -> DataFrame:
        return reserves.ibnr_by_exercice(self.cells)


class ClaimsStage:
    """``claims_raw`` holds text rows with their year slot; with
    ``prepared=True`` it is already normalised and mapped (e.g. the output of
    ``read_claims_files``)."""

    def __init__(self, claims_raw: DataFrame, params: ReservingParams, checkpoint: bool = True,
                 prepared: bool = False):
        self.params = params
        self.rows = claims_raw if prepared else claims_ops.map_claims(claims_raw, params.mapping)
        self.checkpoint = checkpoint

    @cached_property
    def _stored(self) -> tuple[DataFrame, list[str]]:
        agg = claims_ops.claims_agg(self.rows, self.params.exact_amounts)
        return stored_with_years(agg) if self.checkpoint else (agg, years_of(agg))

    @property
    def cells(self) -> DataFrame:
        return self._stored[0]

    @property
    def years(self) -> list[str]:
        return self._stored[1]


def build_stages(policies_raw: DataFrame, claims_raw: DataFrame, params: ReservingParams,
                 checkpoint: bool = True, claims_prepared: bool = False) -> tuple[PolicyStage, ClaimsStage]:
    """Both scans are independent: submit them as concurrent jobs (two driver
    threads) so the policy and the claims aggregation share the executors."""
    from concurrent.futures import ThreadPoolExecutor

    def ready(stage):
        stage.years  # noqa: B018 - stores the cells and gathers their years in this thread
        return stage

    with ThreadPoolExecutor(max_workers=2) as pool:
        fp = pool.submit(lambda: ready(PolicyStage(policies_raw, params, checkpoint)))
        fc = pool.submit(lambda: ready(ClaimsStage(claims_raw, params, checkpoint, claims_prepared)))
        return fp.result(), fc.result()


def psap_overrides(policy: PolicyStage, claims: ClaimsStage) -> DataFrame:
    corp = reserves.psap_corporels(claims.cells, policy.ibnr, policy.years)
    return reserves.assemble_overrides(policy.cells.sparkSession, policy.params.psap_overrides, corp, policy.years)


def psap(policy: PolicyStage, claims: ClaimsStage) -> DataFrame:
    return reserves.psap_cells(policy.cu, claims.cells, psap_overrides(policy, claims), policy.years)


def reserving_report(policy: PolicyStage, claims: ClaimsStage, comments: dict[str, str] | None = None) -> DataFrame:
    """OP-R12 / OP-S5: every section of the report in one plan: the policy
    cells with their rates and the claims cells are read once each, every cell
    gives its rows of all sections, and one aggregate gathers them."""
    p, years = policy.params, policy.years
    rows = matrix_cells(policy.rated, claims.cells, reserves.manual_overrides(p.psap_overrides, years), years,
                        p.platform_shares, p.guarantee_shares, p.loss_ratios_split)
    return render(rows, {"Taux PREC": policy.taux}, comments)


class ReservingPipeline:
    """Runs every step of the method and returns the presented tables."""

    def __init__(self, policies_raw: DataFrame, claims_raw: DataFrame, params: ReservingParams,
                 claims_prepared: bool = False):
        self.params = params
        self.policy, self.claims = build_stages(policies_raw, claims_raw, params, claims_prepared=claims_prepared)

    def psap_overrides(self) -> DataFrame:
        return psap_overrides(self.policy, self.claims)

    @cached_property
    def psap(self) -> DataFrame:
        """Stored: the presented table, its total and the caller read it."""
        return materialize(psap(self.policy, self.claims))

    def report(self, comments: dict[str, str] | None = None) -> DataFrame:
        return reserving_report(self.policy, self.claims, comments)

    def run(self) -> dict[str, DataFrame]:
        pol, clm, years = self.policy, self.claims, self.policy.years
        cyears = clm.years
        cu = pol.cu
        return {
            "PE": recap_matrix(pol.pe, "PE", years),
            "Taux PREC": pol.taux,
            "PREC": recap_matrix(pol.prec, "PREC", years),
            "Anomalies dates": premium.date_anomalies(pol.mapped),
            "PA": recap_matrix(pol.pa, "PA", years),
            "PA split": recap_matrix(pol.pa_split, "PA", years),
            "CU": reserves.hide_branches(recap_matrix(cu, "CU", years)),
            "CU agrege": reserves.hide_branches(recap_matrix(reserves.cu_aggregated(cu), "CU", years, part="_merged")),
            "Sinistres": clm.cells.orderBy("Branche", "Exercice"),
            "Sinistres nombre": recap_matrix(clm.cells, "Nombre_Sinistres", cyears),
            "Sinistres cout": recap_matrix(clm.cells, "Cout_Total", cyears),
            "Reglements": recap_matrix(clm.cells, "Total_Reglement", cyears),
            "SAP": recap_matrix(clm.cells, "SAP", cyears),
            "IBNR": pol.ibnr,
            "PSAP": recap_matrix(self.psap, "PSAP", years, part="_merged"),
        }
