"""Every query of the library by name, and the SQL that gives the same rows."""

from . import queries
from .oracles import ORACLES

FLAGSHIP = "sa_snapshot"
NAMES = (
    "sa_snapshot sa_subwindow sa_idle_advance sa_running sa_count_mode eh_exact_count eh_exact_sum eh_last_window eh_last_n eh_idle_advance eh_approx eh_approx_advance "
    "fd_at_last fd_at_now fd_rate fd_running sdd_quantiles sdd_subwindow sdd_collapsed sdd_count sdd_idle_advance scm_total scm_idle_advance scm_status scm_cells scm_estimate_plain "
    "scm_exact scm_conservative shll_registers shll_count shll_subwindow shll_idle_advance shll_ring distinct_exact hk_topk hk_estimate topk_exact "
    "topk_decayed dr_sample dd_ph dd_cusum dd_ph_latch dd_cusum_latch dd_state dd_state_cusum dd_state_latch dd_state_cusum_latch "
    "adwin_drift adwin_state parameters stream_sa stream_dd stream_dd_cusum stream_fd stream_adwin stream_eh stream_hk stream_shll"
).split()
QUERIES = {name: getattr(queries, name) for name in NAMES}

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
