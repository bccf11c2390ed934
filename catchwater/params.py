"""Parameters of an analysis, with the defaults that results are stated for."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    resolution_m: float = 30.0
    padding: float = 0.10
    flow_percentile: float = 99.0
    max_slope_deg: float = 15.0
    min_distance_m: float = 100.0
    max_candidates: int = 5
    min_catchment_km2: float = 0.005
    weights: dict[str, float] = field(default_factory=lambda: {"catchment": 0.35, "flow": 0.25, "slope": 0.20, "relief": 0.10, "depression": 0.10})
    runoff_coefficient: float = 0.35
    retention: float = 0.80
    depth_m: float = 3.0
    steep_depth_m: float = 2.0
    steep_deg: float = 5.0
    depression_m: float = 0.1
    buffers_m: dict[str, float] = field(default_factory=lambda: {"building": 100.0, "road": 50.0, "waterway": 30.0, "water_body": 30.0, "power_line": 75.0})
    max_area_km2: float = 25.0
    max_cells: int = 2500
    cap_by: str = "seq"  # or "rank": keep the best instead of the first
    start_year: int = 2015
    fallback_seeds: int = 50
    densify_m: float = 10.0
    method: str = "linear"  # of interpolation, or "nearest"
    rain_source: str = "Open-Meteo Historical Weather API"
