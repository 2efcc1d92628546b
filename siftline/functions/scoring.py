"""Scalar functions over findings: uncertainty, severity, CVSS, verdicts, fusion. All are columns, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import fixed


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lookup(key: Column, values: dict, otherwise=None) -> Column:
    """values[key], or `otherwise`."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def normal_cwe(cwe: Column) -> Column:
    """CWE-n for `n`, `cwe-n` and `CWE-n`; empty for null and empty."""
    up = F.upper(F.trim(F.coalesce(cwe, F.lit(""))))
    return F.when((up == "") | up.startswith("CWE-"), up).otherwise(F.concat(F.lit("CWE-"), up))


def flow_length(flow: Column) -> Column:
    return F.coalesce(F.when(flow.isNotNull(), F.size(flow)), F.lit(0))


def crosses_files(flow: Column) -> Column:
    """At least two steps in more than one file."""
    return F.coalesce((F.size(flow) >= 2) & (F.size(F.array_distinct(F.transform(flow, lambda s: s["file_path"]))) > 1), F.lit(False))


def flow_source(flow: Column) -> Column:
    return F.try_element_at(flow, F.lit(1))


def flow_sink(flow: Column) -> Column:
    return F.try_element_at(flow, F.lit(-1))


def confidence_uncertainty(confidence: Column) -> Column:
    return clamp(1 - confidence)


def complexity_uncertainty(length: Column, crosses: Column, depth: Column | None = None) -> Column:
    """Mean of (steps - 1) / 4 and depth / 5, each from 0 to 1; without a graph a flow across files counts as depth 2."""
    guess = F.when(crosses, 2).otherwise(0)
    return clamp((clamp((length - 1) / 4) + clamp((guess if depth is None else F.coalesce(depth, guess)) / 5)) / 2)


def novelty_uncertainty(cwe: Column) -> Column:
    known = normal_cwe(cwe)
    return F.when(known == "", 1.0).when(known.isin(fixed.COMMON_CWES), 0.15).otherwise(0.85)


def conflict_uncertainty(tools: Column, verdicts: Column) -> Column:
    """0 for one tool, 0.5 without verdicts, 0.1 if all agree, 1 for safe against vulnerable, else 0.5."""
    said = F.array_distinct(F.map_values(verdicts))
    safe = F.arrays_overlap(said, F.array(F.lit("safe"), F.lit("false_positive")))
    bad = F.arrays_overlap(said, F.array(F.lit("vulnerable"), F.lit("confirmed"), F.lit("likely")))
    none = verdicts.isNull() | (F.size(verdicts) == 0)
    return F.when(tools.isNull() | (F.size(tools) == 0), 0.0).when(none, 0.5).when(F.size(said) <= 1, 0.1).when(safe & bad, 1.0).otherwise(0.5)


def severity_adjustment(severity: Column) -> Column:
    return lookup(severity, fixed.SEVERITY_ADJUSTMENT, 0.0)


def uncertainty_total(confidence: Column, complexity: Column, novelty: Column, conflict: Column, adjustment: Column) -> Column:
    w = fixed.UNCERTAINTY_WEIGHTS
    return clamp(confidence * w["confidence"] + complexity * w["complexity"] + novelty * w["novelty"] + conflict * w["conflict"] + adjustment)


def cvss_severity(score: Column) -> Column:
    """Label of a score with one decimal; `none` for 0."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").otherwise("none")


def cvss_base(av: Column, ac: Column, pr: Column, ui: Column, scope: Column, c: Column, i: Column, a: Column) -> Column:
    """CVSS v3.1 base score; unknown words count as the most exposed value, unknown impacts as none."""
    low = [F.lower(x) for x in (av, ac, pr, ui, scope, c, i, a)]
    changed = low[4] == "changed"
    t = fixed.CVSS
    p = F.when(changed, lookup(low[2], t["pr_changed"], 0.85)).otherwise(lookup(low[2], t["pr"], 0.85))
    ease = 8.22 * lookup(low[0], t["av"], 0.85) * lookup(low[1], t["ac"], 0.77) * p * lookup(low[3], t["ui"], 0.85)
    iss = 1 - (1 - lookup(low[5], t["impact"], 0.0)) * (1 - lookup(low[6], t["impact"], 0.0)) * (1 - lookup(low[7], t["impact"], 0.0))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    whole = F.least(F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    return F.when((iss <= 0) | (impact <= 0), 0.0).otherwise(F.ceil(whole * 10) / 10)


def cvss_vector(av: Column, ac: Column, pr: Column, ui: Column, scope: Column, c: Column, i: Column, a: Column) -> Column:
    named = zip(("AV", "AC", "PR", "UI", "S", "C", "I", "A"), (av, ac, pr, ui, scope, c, i, a), strict=True)
    return F.concat_ws("/", F.lit("CVSS:3.1"), *[F.concat(F.lit(f"{k}:"), F.upper(F.substring(x, 1, 1))) for k, x in named])


def cvss_metrics(cwe: Column) -> list[Column]:
    """The eight metric words that a CWE has by default."""
    return [lookup(cwe, {c: words[k] for c, words in fixed.CVSS_BY_CWE.items()}, fixed.CVSS_OTHERWISE[k]) for k in range(8)]


def owasp_category(cwe: Column) -> Column:
    return lookup(normal_cwe(cwe), {f"CWE-{n}": name for name, numbers in fixed.OWASP.items() for n in numbers})


def cwe_category(cwe: Column) -> Column:
    return lookup(normal_cwe(cwe), {f"CWE-{n}": name for name, numbers in fixed.CATEGORIES.items() for n in numbers}, "default")


def prompt_tier(total: Column) -> Column:
    return F.when(total < 0.3, "minimal").when(total < 0.6, "standard").otherwise("full")


def complexity_score(length: Column, crosses: Column, snippet_lines: Column, cwe: Column, severity: Column, total: Column, ambiguous: Column) -> Column:
    size = F.when(snippet_lines > 200, 0.3).when(snippet_lines > 50, 0.1).otherwise(0.0)
    rare = F.when((F.upper(cwe) != "") & ~F.upper(cwe).isin(fixed.ROUTINE_CWES), 0.2).otherwise(0.0)
    flow = F.when(crosses, 0.4).otherwise(0.0) + F.when(length > 3, 0.2).otherwise(0.0)
    return flow + size + rare + lookup(severity, fixed.COMPLEXITY_BY_SEVERITY, 0.0) + total * 0.15 + F.when(ambiguous, 0.2).otherwise(0.0)


def sast_verdict(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "confirmed").when(confidence >= 0.8, "likely").otherwise("potential")


def graph_verdict(classes: Column) -> Column:
    """Verdict of a prediction set that isn't ambiguous."""
    low = F.transform(classes, F.lower)
    return F.when(F.size(classes) != 1, "unknown").when(F.array_contains(low, "vulnerable"), "likely").when(F.array_contains(low, "safe"), "safe").otherwise("unknown")


def consensus(exploitable: Column, confidence: Column, coverage: Column, feasible: Column) -> Column:
    """struct(verdict, confidence) of an attacker and a defender, by the first rule that holds."""
    limit = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    rule = lambda v, x: F.struct(F.lit(v).alias("verdict"), x.cast("double").alias("confidence"))
    return (
        F.when(exploitable & (coverage < 0.5), rule("confirmed", F.least(F.greatest(confidence, 1 - coverage), F.lit(1.0))))
        .when(~exploitable & (coverage > 0.7), rule("safe", F.least(F.greatest(coverage, 1 - confidence), F.lit(1.0))))
        .when(~feasible & ~exploitable, rule("safe", F.lit(0.8)))
        .when(exploitable & (coverage >= 0.5), rule("likely", limit(0.5 + 0.3 * (confidence - coverage), 0.3, 0.85)))
        .when(~exploitable & (coverage <= 0.7), rule("potential", limit(0.4 + 0.2 * (1 - coverage), 0.2, 0.6)))
        .otherwise(rule("likely", F.lit(0.5)))
    )


def fuse(sast: Column, graph: Column, llm: Column, w_sast: Column, w_graph: Column, w_llm: Column) -> Column:
    """Weighted mean of the scores that are there; a null stage has no weight. The first score alone if no weight is left."""
    weight = w_sast + F.when(graph.isNotNull(), w_graph).otherwise(0.0) + F.when(llm.isNotNull(), w_llm).otherwise(0.0)
    total = sast * w_sast + F.coalesce(graph * w_graph, F.lit(0.0)) + F.coalesce(llm * w_llm, F.lit(0.0))
    return F.when(weight == 0, sast).otherwise(clamp(total / F.nullif(weight, F.lit(0.0))))


def classify(score: Column, exploitable: Column, coverage: Column) -> Column:
    """Tier of a fused score; a clear attacker or defender overrides it."""
    return F.when(exploitable & (coverage < 0.3), "confirmed").when(~exploitable & (coverage > 0.8), "safe").when(score >= 0.85, "confirmed").when(score >= 0.5, "likely").when(score > 0, "potential").otherwise("unknown")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def heuristic_risk(path: Column, control: Column, fan_out: Column, sanitised: Column, calls: Column) -> Column:
    """Risk from the five graph features; 0.5 if there are none."""
    score = 0.25 * F.coalesce(path, F.lit(0.5)) + 0.2 * F.coalesce(control, F.lit(0.5)) + 0.15 * F.coalesce(fan_out, F.lit(0.5)) + 0.25 * (1 - F.coalesce(sanitised, F.lit(0.0))) + 0.15 * F.coalesce(calls, F.lit(0.5))
    return F.when(F.coalesce(path, control, fan_out, sanitised, calls).isNull(), 0.5).otherwise(clamp(score))


def finding_id(rule: Column, file_path: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rule, file_path, line.cast("string")), 256), 1, 16)


def file_language(path: Column, wide: bool = False, known: dict[str, str] | None = None) -> Column:
    """Language of a path by its extension; null if unknown, or with `wide` python."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return lookup(ext, fixed.LANGUAGE_BY_EXTENSION | fixed.MORE_EXTENSIONS, "python") if wide else lookup(ext, known or fixed.LANGUAGE_BY_EXTENSION)


def scannable(path: Column, known: dict[str, str] | None = None) -> Column:
    """Whether a path is scanned: a known extension, and no skipped directory, suffix or file."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    language = file_language(path, known=known)
    skip = F.arrays_overlap(parts, F.array(*map(F.lit, fixed.SKIPPED_DIRECTORIES))) | F.lower(name).isin(fixed.SKIPPED_FILES)
    for suffix in fixed.SKIPPED_SUFFIXES:
        skip = skip | name.endswith(suffix)
    script = language.isin("javascript", "typescript") & F.arrays_overlap(parts, F.array(*map(F.lit, fixed.SKIPPED_FOR_SCRIPTS)))
    return language.isNotNull() & ~skip & ~script
