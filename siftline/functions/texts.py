"""Texts that are put together for people and providers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.scoring import lookup


def percent(x: Column) -> Column:
    """Whole per cent, halves up; sums that are a half but for rounding errors count as one."""
    return F.concat(F.round(F.round(x * 100, 6)).cast("int").cast("string"), F.lit("%"))


def fusion_explanation(cwe: Column, message: Column, sast: Column, graph: Column, llm: Column, fused: Column, verdict: Column) -> Column:
    """A line a stage that ran, and the outcome."""
    return F.concat_ws("\n", F.concat_ws(": ", cwe, message), F.concat(F.lit("SAST confidence: "), percent(sast)), F.when(graph.isNotNull(), F.concat(F.lit("Graph structural risk: "), percent(graph))), F.when(llm.isNotNull(), F.concat(F.lit("LLM consensus confidence: "), percent(llm))), F.concat(F.lit("Fused score: "), F.format_string("%.2f", F.floor(F.round(fused * 100, 4) + 0.5) / 100), F.lit(" -> Verdict: "), verdict))


def consensus_explanation(verdict: Column, exploitable: Column, coverage: Column, reasoning: Column, most: int = 200) -> Column:
    """What both sides say, the reasoning cut to `most` characters; null without a verdict."""
    said = F.concat_ws("\n", F.concat(F.lit("Verdict: "), verdict), F.concat(F.lit("Attacker: "), F.when(exploitable, "exploitable").otherwise("not exploitable")), F.concat(F.lit("Defender: coverage "), percent(coverage)), F.when(F.length(reasoning) > most, F.concat(F.substring(reasoning, 1, most), F.lit("..."))).otherwise(reasoning))
    return F.when(verdict.isNotNull(), said)


#: How an attack gets in and what it needs, as clauses.
FROM_VECTOR = {"network": " over the network", "adjacent": " over a neighbouring network", "local": " on the machine itself", "physical": " by hand at the machine"}
WITH_PRIVILEGES = {"none": " by anyone", "low": " by any user", "high": " by an administrator"}
#: The sentences of a narrative in order, each with the condition under which it stands.
NARRATIVE = [
    ("exploitable", "{name} at {place} can be exploited{vector}{privileges}."),
    ("not exploitable", "{name} at {place} is suspected, but no way to exploit it is known."),
    ("step", "{step}."),
    ("exploitable and payload", "There is a payload for it."),
    ("defence", "{defence}."),
    ("not defence and bare", "Nothing on the path defends it."),
    ("score", "It scores {score} of 10 in CVSS 3.1, which is {severity}."),
]


def evidence_narrative(cwe: Column, name: Column, place: Column, exploitable: Column, vector: Column, privileges: Column, steps: Column, payload: Column, defences: Column, coverage: Column, base: Column, severity: Column) -> Column:
    """What was found, in the sentences of NARRATIVE: whether it can be exploited and how, the first step of evidence, the first defence or, at a
    coverage under .2, that there is none, and the score. Null where there is no verdict; `name` may be null."""
    values = {
        "name": F.coalesce(name, cwe), "place": place, "vector": lookup(vector, FROM_VECTOR, ""), "privileges": lookup(privileges, WITH_PRIVILEGES, ""), "step": F.try_element_at(steps, F.lit(1)),
        "defence": F.try_element_at(defences, F.lit(1)), "score": F.format_string("%.1f", base), "severity": F.lower(severity),
    }
    holds = {"exploitable": F.coalesce(exploitable, F.lit(False)), "payload": payload.isNotNull(), "bare": F.coalesce(coverage < 0.2, F.lit(False))} | {k: values[k].isNotNull() for k in ("step", "defence", "score")}
    sentences = []
    for condition, sentence in NARRATIVE:
        stands = F.lit(True)
        for part in condition.split(" and "):
            stands = stands & (~holds[part.removeprefix("not ")] if part.startswith("not ") else holds[part])
        pieces = [values[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"[{}]", sentence)) if x]
        sentences.append(F.when(stands, F.concat(*pieces)))
    return F.when(exploitable.isNotNull(), F.concat_ws(" ", *sentences))


def flow_text(flow: Column) -> Column:
    """Numbered steps, or a note that there are none."""
    return F.coalesce(F.array_join(F.transform(flow, lambda x, i: F.concat(F.lit("  "), i + 1, F.lit(". "), x["file_path"], F.lit(":"), x["line"])), "\n"), F.lit("No taint path"))


def batch_prompt(blocks: Column) -> Column:
    """Numbered blocks of several findings."""
    return F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("### Finding "), i + 1, F.lit("\n"), b)), "\n\n")


def retrieval_text(description: Column, hits: Column, most: int = 3, size: int = 200) -> Column:
    """A description and the first hits, each cut to `size` characters."""
    return F.concat_ws("\n", description, F.array_join(F.transform(F.slice(hits, 1, most), lambda h: F.concat(F.lit("- "), F.substring(h, 1, size))), "\n"))
