"""Grey binning as SQL expressions over an intensity i and its region's extrema mn and mx."""

from __future__ import annotations


def level(depth: int) -> str:
    """depth > 0: matlab levels 1..depth; depth < 0: radiomics, |depth| equal bins over the region's range; 0: identity."""
    if depth > 0:
        return f"cast(greatest(least(floor({depth}e0 / nullif(mx, 0e0) * i + 1e0), {depth}e0), 1e0) as bigint)"
    if depth < 0:
        return f"CASE WHEN i = 0e0 THEN 0 ELSE cast(least(floor((i - mn) / nullif((mx - mn) / {-depth}e0, 0e0)) + 1e0, {-depth}e0) as bigint) END"
    return "cast(i as bigint)"


def grayscale(n: int, low: str = "mn") -> str:
    """Bin floor((i - low) / (mx - low) * n), not folded; 0 is the identity."""
    return f"cast(coalesce(floor((i - {low}) / nullif(mx - {low}, 0e0) * {n}e0), 0e0) as bigint)" if n else "cast(i as bigint)"


def folded(n: int) -> str:
    """Histogram bin 0..n-1 over the region's range, the maximum in the last bin."""
    return f"cast(least(coalesce(floor((i - mn) / nullif(mx - mn, 0e0) * {n}e0), 0e0), {n - 1}e0) as bigint)"
