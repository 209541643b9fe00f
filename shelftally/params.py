"""Job parameters. The defaults are part of the published semantics."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The snapshot's "present": open-ended serial runs end here, and two-digit
    # entry years above its last two digits belong to the previous century.
    now_year: int = 2026
    # Counts in 1..threshold-1 are never published on their own.
    threshold: int = 10

    compare_top_k: int = 15
    material_types: int = 10
    agencies_per_org: int = 12
    namespaces_per_org: int = 12
    namespace_min_share: float = 0.001
    genres_per_org: int = 12
    hosts_per_org: int = 15
    closest_pairs: int = 15
    probe_min_share: float = 0.0002
    probe_top: int = 40

    # Inclusive windows of plausible years, one per measure.
    publication_years: tuple[int, int] = (1450, 2030)
    serial_active_from: int = 1500
    serial_start_years: tuple[int, int] = (1700, 2025)
    archive_years: tuple[int, int] = (100, 2025)
    entered_from: int = 1966
