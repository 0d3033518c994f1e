"""The ranked text report of the disposal analysis, from its small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

RULE = "=" * 80
#: Percentiles above which a finding is called so: fixed values.
LEVELS = ((75, "significantly higher than most peers"), (50, "above median"), (-1, "below median"))


def level(percentile: float) -> str:
    return next(text for least, text in LEVELS if percentile > least)


def ranking(rows: Sequence, measure: str = "total_value", key: str = "name") -> list[tuple[int, str, float]]:
    """Places (from 1) by a measure, largest first, ties by key."""
    ordered = sorted(rows, key=lambda r: (-r[measure], str(r[key])))
    return [(n + 1, r[key], r[measure]) for n, r in enumerate(ordered)]


def render(title: str, focal: str, summary: Sequence, comparison: Sequence, months: Sequence, watched: Sequence[str] = (), top: int = 5) -> str:
    """The report: ranking, comparison with the peers, peak months, findings.

    ``summary`` has name, total_value, total_shares and transactions of each entity; ``comparison``
    has measure, focal_value, peer_median, percentile and pct_over_median; ``months`` has month,
    value, shares and n of the focal one. All are small; a section without rows is left out.
    """
    lines = [RULE, title, RULE]
    if summary:
        lines += ["", "RANKING BY TOTAL VALUE", RULE]
        for place, name, value in ranking(summary):
            lines.append(f"{place:>4}. {name}: ${value / 1e6:,.2f}M" + (" <" if name == focal else ""))
    if comparison:
        lines += ["", f"STATISTICAL COMPARISON: {focal} vs PEER MEDIAN", RULE]
        for r in comparison:
            over = "n/a" if r["pct_over_median"] is None else f"{r['pct_over_median']:+.1f}%"
            lines += [f"{r['measure']}:", f"  {focal}: {r['focal_value']:,.2f}", f"  Peer median: {r['peer_median']:,.2f}", f"  vs median: {over}", f"  Percentile: {r['percentile']:.0f}th"]
    if months:
        lines += ["", "PEAK MONTHS (by value)", RULE]
        for r in sorted(months, key=lambda r: (-r["value"], r["month"]))[:top]:
            lines.append(f"  {r['month']}: ${r['value'] / 1e6:.2f}M ({r['shares'] / 1e3:.1f}K shares, {r['n']} txns)")
    lines += ["", "KEY FINDINGS", RULE]
    for r in comparison:
        lines.append(f"{focal} ranked in the {r['percentile']:.0f}th percentile for {r['measure']} - {level(r['percentile'])}.")
    for r in sorted((r for r in summary if r["name"] in watched), key=lambda r: r["name"]):
        lines.append(f"  - {r['name']}: ${r['total_value'] / 1e6:.2f}M ({r['transactions']} transactions)")
    return "\n".join([*lines, "", RULE, "END OF REPORT", RULE])
