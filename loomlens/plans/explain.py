"""What each rule means, and the manifest of reports."""

from __future__ import annotations

RULES = {
    "unused-file": "A file that no entry module or test reaches by requires.",
    "unused-export": "A key of the returned table that no module reads and no whole use of the module may read.",
    "unused-local": "A local whose name is read nowhere in its file.",
    "unused-type": "A type of the file, not exported, that no annotation names.",
    "circular-dependency": "Files that require each other, with one closed walk over real requires.",
    "boundary-violation": "A require from one zone into another that its configuration does not allow.",
    "high-complexity": "A function over both complexity limits.",
    "high-cyclomatic-complexity": "A function with too many branches.",
    "high-cognitive-complexity": "A function whose branches are nested too deeply.",
    "high-crap": "A complex function that no test reaches (an estimate from requires, not measured coverage).",
    "large-function": "A function of too many lines.",
    "clone": "Runs of equal tokens in several places; literals count as equal.",
    "feature-flag": "Names, attributes, settings and environment variables that switch behaviour.",
    "hotspot": "Complex files that change often: decayed commits times density.",
    "refactor-target": "Files worth changing first: priority by effort.",
}
#: Names, ranges and reading of the metrics. The numbers are those of the formulas.
METRICS = {
    "cyclomatic": ("Cyclomatic complexity", "[1, inf)", "One, and one more for each branch, loop, and, or and conditional expression. Nested functions count for themselves.", "to 10 simple, to 20 moderate, to 50 high, above very high; limit 20"),
    "cognitive": ("Cognitive complexity", "[0, inf)", "Breaks in the flow, each weighted by how deeply it is nested.", "to 7 easy, to 15 moderate, above hard; limit 15"),
    "complexity_density": ("Complexity density", "[0, inf)", "Cyclomatic complexity of a file by its lines.", "below 0.3 low, to 1.0 moderate, above dense"),
    "maintainability_index": ("Maintainability index", "[0, 100]", "100 less density * 30 (less in files under 50 lines), dead ratio * 20 and up to 15 for requires.", "below 40 poor, to 70 moderate, above good"),
    "unit_size": ("Unit size", "bins of lines", "15, 30 and 60 lines end low, medium and high; above is very high.", "functions over 60 lines are findings"),
    "unit_interfacing": ("Unit interfacing", "bins of parameters", "2, 4 and 6 parameters end low, medium and high; above is very high.", "few parameters are better"),
    "crap": ("Change risk", "[0, inf)", "cc^2 * (1 - coverage)^3 + cc, with coverage estimated from requires of tests: 85, 40 or 0 percent.", "below 30 acceptable, to 99 moderate, above high"),
    "hotspot_score": ("Hotspot score", "[0, 100]", "Commits, decayed by half in 90 days, times density, both by the project's largest.", "higher is riskier, within the project"),
    "target_priority": ("Target priority", "[0, 100]", "density to 30, hotspot to 25, dead ratio to 20, fan-in to 15 and fan-out to 10, the last two by their 95th percentile.", "sorted by efficiency: priority by effort of 1, 2 or 3"),
}
LIMITS = {
    "health": "Hints where to look, no proof of a defect. Coverage is estimated from requires, not measured; unresolved requires lower it.",
    "dead-code": "Candidates only: unresolved requires and indirect access to keys are not fully known. Check before deleting.",
    "dupes": "Equal runs of tokens; strings and numbers count as equal, white space and comments do not count.",
}
REPORTS = ("list", "health", "dead-code", "dupes", "audit", "inspect", "trace", "flags", "suppressions", "viz")


def explain_rule(name: str) -> dict:
    plain = name.rpartition("/")[2].replace("_", "-")
    for rule, text in RULES.items():
        if rule == plain or plain.endswith(rule) or rule.endswith(plain):
            return {"id": rule, "description": text}
    return {"error": f"unknown rule {name}", "known": list(RULES)}


def meta(report: str) -> dict:
    """What a report's fields mean: its rules, limits and, for health, the metrics."""
    out: dict = {"rules": RULES, "limitations": LIMITS.get(report, LIMITS["health"])}
    if report in ("health", "inspect", "audit", "schema"):
        out["metrics"] = {k: dict(zip(("name", "range", "description", "interpretation"), v, strict=True)) for k, v in METRICS.items()}
    if report == "dupes":
        out["defaults"] = {"min_tokens": 30, "min_lines": 5, "min_occurrences": 2}
    return out


def manifest() -> dict:
    return {"schema_version": 1, "reports": list(REPORTS), "rules": list(RULES), "format": "one JSON document a report; one array a section"}
