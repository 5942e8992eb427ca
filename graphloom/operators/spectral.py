"""Spectral summaries, all derived in SQL from the eigenvalue arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Diffusion times of the heat-kernel traces.
HEAT_TIMES = (0.5, 1.0, 2.0, 5.0)


def _sum(a: str, of: str = "x") -> str:
    return f"aggregate({a}, 0D, (acc, x) -> acc + {of})"


def _mean(a: str) -> str:
    return f"{_sum(a)} / size({a})"


def _std(a: str) -> str:
    # Two passes: squares of the deviations, so equal values give exactly zero.
    return (f"sqrt(transform(array({_mean(a)}), mu -> {_sum(a, '(x - mu) * (x - mu)')} / size({a}))[0])")


def gap_column(df: DataFrame) -> DataFrame:
    """Second smallest Laplacian eigenvalue; 0 below two vertices."""
    return df.withColumn("spectral_gap", F.expr("coalesce(get(lap, 1), if(lap is null, null, 0D))"))


def basic_expressions() -> dict[str, str]:
    return {
        "spec_lap_fiedler": "coalesce(get(lap, 1), if(lap is null, null, 0D))",
        "spec_lap_mode2": "coalesce(get(lap, 2), if(lap is null, null, 0D))",
        "spec_lap_max": "element_at(lap, -1)",
        "spec_lap_mean": _mean("lap"),
        "spec_lap_std": _std("lap"),
        "spec_lap_energy_norm": f"{_sum('lap', 'abs(x)')} / n",
        "spec_adj_max": "element_at(adj, -1)",
        "spec_adj_min": "adj[0]",
        "spec_adj_gap": "if(size(adj) > 1, element_at(adj, -1) - element_at(adj, -2), 0D)",
        "spec_adj_energy_norm": f"{_sum('adj', 'abs(x)')} / n",
        "spec_adj_spread": "element_at(adj, -1) - adj[0]",
    }


def rich_expressions() -> dict[str, str]:
    exprs = {
        "spec_nlap_min_nonzero": "coalesce(get(nlap, 1), if(nlap is null, null, 0D))",
        "spec_nlap_max": "element_at(nlap, -1)",
        "spec_nlap_mean": _mean("nlap"),
        "spec_nlap_std": _std("nlap"),
        "spec_nlap_frac_low": "cast(size(filter(nlap, x -> x < 0.5D)) as double) / size(nlap)",
        "spec_nlap_frac_high": "cast(size(filter(nlap, x -> x > 1.5D)) as double) / size(nlap)",
    }
    for t in HEAT_TIMES:
        exprs[f"spec_heat_t{str(t).replace('.', '_')}"] = f"{_sum('lap', f'exp(-{t}D * x)')} / n"
    return exprs


def basic_columns() -> dict[str, Column]:
    return {name: F.expr(e) for name, e in basic_expressions().items()}


def rich_columns() -> dict[str, Column]:
    return {name: F.expr(e) for name, e in rich_expressions().items()}


def summaries(with_spectra: DataFrame) -> DataFrame:
    """All `spec_*` columns; the arrays are dropped."""
    return with_spectra.withColumns({**basic_columns(), **rich_columns()}).drop("lap", "adj", "nlap")


def full_columns(with_spectra: DataFrame, n: int) -> DataFrame:
    """The whole Laplacian and adjacency spectra as columns, for graphs of one size."""
    same = with_spectra.where(F.col("n") == n)
    lap = [F.element_at("lap", i + 1).alias(f"lap_ev{i}") for i in range(n)]
    adj = [F.element_at("adj", i + 1).alias(f"adj_ev{i}") for i in range(n)]
    return same.select("graph_id", *lap, *adj)
