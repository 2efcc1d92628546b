"""Detection on source text: a rule catalogue matched against calls in lines, and the cases in which a match is suppressed."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftline import fixed
from siftline.functions import calls as source_calls

CALL = r"([\w$.]+)\s*\("
CALLED = "file string, language string, line_no int, end_line int, call string, code string, text string, closed boolean, arguments array<struct<kind:string,text:string>>, near string, wide string, head string"
#: Characters of results that a task holds at once, beside those of a file.
HELD = 4 << 20
#: Edges that a task hands on at once, of as many files as have them.
EDGES_HELD = 50_000


def rules(spark: SparkSession) -> DataFrame:
    """(language, rule, cwe_id, severity, seq, function): a row for each function of the catalogue."""
    every = fixed.RULES | {lang: fixed.RULES[other] for lang, other in fixed.SAME_RULES.items()}
    rows = [(lang, name, f"CWE-{cwe}", severity, k, f) for lang, group in every.items() for k, (name, cwe, severity, functions) in enumerate(group) for f in functions]
    return spark.createDataFrame(rows, "language string, rule string, cwe_id string, severity string, seq int, function string")


def _named() -> dict[str, re.Pattern]:
    """For each language what the name of a call must have to match any function of its catalogue."""
    out = {}
    for language in [*fixed.RULES, *fixed.SAME_RULES]:
        functions = [f for *_, group in fixed.RULES[fixed.SAME_RULES.get(language, language)] for f in group]
        tails, dotted = sorted({re.escape(f.rsplit(".", 1)[-1]) for f in functions}), sorted({re.escape(f) for f in functions if "." in f})
        out[language] = re.compile(rf"(?:^|\.)(?:{'|'.join(tails)})$" + (f"|{'|'.join(dotted)}" if dotted else ""))
    return out


def called(files: DataFrame, text: str = "text") -> DataFrame:
    """files(file, language, text) -> (file, language, line_no, end_line, call, code, text, closed, arguments, near, wide, head): the calls whose
    name a catalogue's function may match, in Arrow batches of whole files.

    line_no is the line that a call begins on and code that line; text is the call with its arguments, over as many lines as it takes,
    without comments; near are the lines from five before to two behind, wide from ten before to one behind, head the file's first five.
    Null texts and languages without a catalogue have no calls.
    """
    named, schema = _named(), to_arrow_schema(StructType.fromDDL(CALLED))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file, language, source in zip(*batch.columns, strict=True):
                language, source = language.as_py(), source.as_py()
                if language not in named or source is None:
                    continue
                lines, ends, plain = source.split("\n"), None, source_calls.without_comments(source, language)
                cut = lambda a, b, lines=lines: "\n".join(lines[max(a, 0) : b])
                for c in source_calls.calls(plain, language):
                    if not named[language].search(c.name):
                        continue
                    ends = ends or list(accumulate(len(x) + 1 for x in lines))
                    at, last = bisect_right(ends, c.begin), bisect_right(ends, c.end - 1)
                    rows.append({
                        "file": file.as_py(), "language": language, "line_no": at + 1, "end_line": last + 1, "call": c.name, "code": lines[at], "text": plain[c.begin : c.end], "closed": c.closed,
                        "arguments": [{"kind": source_calls.kind(a), "text": a} for a in c.arguments], "near": cut(at - 5, at + 3), "wide": cut(at - 10, at + 2), "head": cut(0, 5),
                    })
                    held += sum(len(rows[-1][k]) for k in ("code", "text", "near", "wide", "head")) + 256
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(F.col("file").cast("string"), F.col("language").cast("string"), F.col(text).alias("text")).mapInArrow(scan, CALLED)


def explode_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with line_no from 1 and code instead of the text."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "code")).withColumn("line_no", F.col("line_no") + 1)


def call_names(code: Column) -> Column:
    """Dotted names of all calls in a line."""
    return F.regexp_extract_all(code, F.lit(CALL), F.lit(1))


def rule_match(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """called() -> its columns with (rule, cwe_id, severity, seq), a row a call and rule that has a function which the call matches.

    A call matches a function if it is it, or ends in it after a dot; a dotted function also if it stands in the call, or if both have the
    same last name and its module stands in the call. Methods of regular expressions match only a function that they are or hold. Calls
    meet the fixed catalogue of their language.
    """
    name, f, low = F.col("call"), F.col("function"), F.lower("call")
    owner = F.lower(F.try_element_at(F.split(name, r"\."), F.lit(-2)))
    pattern = F.contains(name, F.lit(".")) & (owner.isin(fixed.PATTERN_OBJECTS) | owner.rlike(r"^/|(re|regexp|_pattern)$"))
    after_dot = name.endswith(F.concat(F.lit("."), f))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    module = F.lower(F.regexp_extract(f, r"^(.*)\.[^.]*$", 1))
    same = F.contains(name, F.lit(".")) & (last(name) == last(f)) & ~pattern & ~((last(f) == "exec") & F.contains(low, F.lit("executor"))) & F.contains(low, module)
    hit = (name == f) | (after_dot & ~pattern) | (~after_dot & F.contains(f, F.lit(".")) & (F.contains(low, f) | same))
    functions = F.broadcast(catalogue)
    return found.join(functions, (found["language"] == functions["language"]) & hit).drop(functions["language"]).drop("function").distinct()


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def suppressions(call: Column, text: Column, arguments: Column, near: Column, wide: Column, head: Column) -> dict[str, Column]:
    """For each kind of rule whether a call is safe: by its name, its text with all arguments, the arguments and what they are, and the lines around
    it, as in called()."""
    low, empty = F.lower(text), F.size(arguments) == 0
    of = lambda k, field: F.coalesce(F.try_element_at(arguments, F.lit(k))[field], F.lit(""))
    first, first_kind = of(1, "text"), of(1, "kind")
    literal = first_kind.isin("string", "strings", "format")
    last, dotted = F.element_at(F.split(call, r"\."), -1), F.contains(call, F.lit("."))
    name = F.lower(call)
    user = _any(text, fixed.USER_SOURCES)
    changed = F.contains(text, F.lit("+")) | F.contains(text, F.lit(".format("))
    ddl = _any(F.upper(first), fixed.DDL)
    mixed = changed | (F.contains(text, F.lit("%")) & ~F.contains(text, F.lit("(%s)"))) | F.contains(text, F.lit("${"))
    marked = F.contains(first, F.lit("?")) | F.contains(first, F.lit("%s"))
    bound = marked & of(2, "kind").isin("tuple", "list", "dictionary", "identifier")
    anchored = _any(low, fixed.ANCHORS) & ~_any(low, fixed.PATH_USER_HINTS)
    all_plain = F.forall(arguments, lambda a: a["kind"].isin("string", "format", "identifier"))
    plain = first_kind.isin("string", "format") & ~F.contains(first, F.lit("${")) & ~F.contains(first, F.lit("%")) & (~F.contains(name, F.lit("join")) | all_plain)
    joined = F.contains(name, F.lit("concat")) & F.contains(name, F.lit("path"))
    strong = _any(near, fixed.STRONG_PATH_MITIGATIONS)
    weak = F.size(F.filter(F.array(*map(F.lit, fixed.WEAK_PATH_MITIGATIONS)), lambda w: F.contains(near, w))) >= 2
    named = (first_kind == "identifier") & F.lower(first).isin(fixed.REDIRECT_NAMES)
    shell = F.exists(arguments, lambda a: (a["kind"] == "keyword") & F.contains(a["text"], F.lit("shell")) & F.contains(a["text"], F.lit("True")))
    address = (first_kind == "identifier") & F.lower(first).isin(fixed.URL_NAMES)
    secret = F.exists(arguments, lambda a: (
        ((a["kind"] == "identifier") & F.lower(a["text"]).isin(fixed.SECRET_ARGUMENTS))
        | ((a["kind"] == "member") & _any(F.lower(a["text"]), fixed.LOGGED_USER_DATA))
        | (a["kind"].isin("format", "strings", "template", "other") & _any(F.lower(a["text"]), fixed.SECRET_ARGUMENTS))
    ))
    return {
        "sql": empty | _any(name, fixed.NO_SQL_NAMES) | (literal & ((ddl & ~mixed) | ((marked | first.rlike(r":\w+")) & ~changed) | bound)),
        "command": (first_kind == "list") & ~shell & ~_any(call, ["os.system", "os.popen"]),
        "eval": F.contains(call, F.lit("literal_eval")) | ~last.isin("eval", "exec", "compile", "__import__") | dotted,
        "path": (dotted & (last == "open")) | anchored | joined | plain | strong | weak,
        "deserialization": call.startswith("json.") | F.contains(call, F.lit("safe_load")),
        "redirect": ~_any(low, fixed.REDIRECT_SOURCES) & ~named,
        "ssrf": ~user & ~_any(text, fixed.URL_USER_NAMES) & (call.endswith(".test") | (name == "test") | _any(low, fixed.SAME_ORIGIN) | ~address | ~_any(F.lower(wide), fixed.USER_SOURCES)),
        "nosql": ~F.contains(text, F.lit("$where")) | ~_any(text, fixed.QUERY_INTERPOLATION),
        "crypto": _any(low, fixed.STRONG_ALGORITHMS) | ~_any(low, fixed.WEAK_ALGORITHMS),
        "innerhtml": F.contains(low, F.lit("module.exports")) | (_any(text, fixed.PAGE_WRITES) & _any(F.lower(head), fixed.MODULE_HEADS)),
        "template": ~user & ~_any(text, fixed.TEMPLATE_USER_DATA),
        "log": ~secret,
        "cookie": ~_any(low, fixed.LOOSE_COOKIES),
        "xxe": ~_any(low, fixed.EXTERNAL_ENTITIES),
        "merge": ~F.contains(text, F.lit("__proto__")) & ~(_any(text, fixed.PROTOTYPES) & (_any(text, fixed.MERGE_SOURCES) | _any(text, fixed.MERGED_USER_DATA))),
    }


def matches(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """files(file, language, text) -> (file, language, line_no, code, call, rule, cwe_id, severity, safe): what the catalogue's rules match, with
    whether the suppression of its kind leaves it out. Of calls of one name on a line one that isn't safe counts; a call that nothing
    closes is never safe, as its arguments aren't known."""
    x = rule_match(called(files), catalogue)
    kinds = suppressions(*map(F.col, ("call", "text", "arguments", "near", "wide", "head")))
    safe = F.lit(False)
    for cwe, kind in fixed.KIND_BY_CWE.items():
        safe = safe | ((F.col("cwe_id") == cwe) & kinds[kind])
    for rule, kind in fixed.KIND_BY_RULE.items():
        safe = safe | ((F.col("rule") == rule) & kinds[kind])
    return x.groupBy("file", "language", "line_no", "code", "call", "rule", "cwe_id", "severity").agg(F.bool_and(F.col("closed") & safe).alias("safe"))


def secret_lines(files: DataFrame) -> DataFrame:
    """files(file, language, text) -> (file, language, line_no, code, rule, cwe_id, severity) of strings given to names like secrets'."""
    x = explode_lines(files.where(F.col("language").isin(fixed.SECRET_LANGUAGES)).select("file", "language", "text"))
    x = x.where(F.col("code").rlike("(?i)" + "|".join(fixed.SECRET_NAMES))).where(hardcoded_secret(F.col("code")).isNotNull())
    return x.select("file", "language", "line_no", "code", F.lit("hardcoded_secret").alias("rule"), F.lit("CWE-798").alias("cwe_id"), F.lit("high").alias("severity"))


def detect(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Findings of files(file, language, text): (file, language, line_no, code, rule, cwe_id, severity), of the catalogue and of secrets."""
    columns = ["file", "language", "line_no", "code", "rule", "cwe_id", "severity"]
    return matches(files, catalogue).where("not safe").select(*columns).distinct().unionByName(secret_lines(files).select(*columns))


def clearly_safe(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file): files without any finding, and those of languages that aren't scanned."""
    return files.select("file").distinct().join(found.select("file").distinct(), "file", "left_anti")


def hardcoded_secret(code: Column, names: list[str] = fixed.SECRET_NAMES, any_case: bool = True) -> Column:
    """struct(name, value) of a string given to a name like a secret's: at least four characters, more than two distinct, no placeholder; else null.
    The last string counts, so a fallback after `or` does. Names count in any case, or only as they are given."""
    words = "|".join(names)
    m = rf"""{"(?i)" if any_case else ""}((?:[\w.'\"\[\]-]*(?:{words})[\w'\"\]]*))\s*[:=]\s*(?:.*(?:\bor\b|\|\|)\s*)?["'`]([^"'`]*)["'`]"""
    name, value = F.regexp_extract(code, m, 1), F.regexp_extract(code, m, 2)
    fine = (F.length(value) >= 4) & (F.size(F.array_distinct(F.split(value, ""))) > 2) & ~F.lower(value).isin(fixed.PLACEHOLDERS)
    return F.when((name != "") & fine, F.struct(F.lower(name).alias("name"), value.alias("value")))


def context_windows(files: DataFrame, pattern: str, before: int, after: int, text: str = "text") -> DataFrame:
    """(file, line_no, context): the lines around each line that matches. They are cut from the file's own lines within its row, so nothing is
    joined and no row carries its file."""
    lines = files.where(F.col(text).rlike(pattern)).select("file", F.split(text, "\n", -1).alias("lines"))
    at = F.filter(F.transform("lines", lambda c, k: F.when(c.rlike(pattern), k + 1)), lambda k: k.isNotNull())
    start = lambda k: F.greatest(k - before, F.lit(1))
    parts = F.transform(at, lambda k: F.struct(k.alias("line_no"), F.array_join(F.slice("lines", start(k), k + after - start(k) + 1), "\n").alias("context")))
    return lines.select("file", F.explode(parts).alias("p")).select("file", "p.*")


def code_slice(files: DataFrame, points: DataFrame, around: int = 20, most: int = 200) -> DataFrame:
    """points(id, file, line) -> (id, slice): numbered lines around the line, which is marked."""
    x = points.join(files.select("file", F.split("text", "\n", -1).alias("lines")), "file")
    start = F.greatest(F.col("line") - around, F.lit(1))
    size = F.least(F.least(F.col("line") + around, F.size("lines")) - start + 1, F.lit(most))
    numbered = F.transform(F.slice("lines", start, F.greatest(size, F.lit(0))), lambda c, k: F.concat(F.lpad((start + k).cast("string"), 4, " "), F.when(start + k == F.col("line"), " >> ").otherwise("    "), c))
    return x.select("id", F.array_join(numbered, "\n").alias("slice"))


def code_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank or a comment, with `idx` from 0 in their file, `stripped` and `indent`."""
    from pyspark.sql import Window

    x = lines.withColumn("stripped", F.trim(F.regexp_replace("code", r"\t|\r", " "))).where((F.col("stripped") != "") & ~F.col("stripped").rlike(r"^(#|//|/\*|\*)"))
    x = x.withColumn("indent", F.length(F.regexp_extract("code", r"^([ \t]*)", 1)))
    return x.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)


def branch_edges(lines: DataFrame) -> DataFrame:
    """(file, src, dst, type): each line to the next, typed by what it begins with."""
    from pyspark.sql import Window

    kind = F.when(F.col("stripped").rlike(r"^(if|elif|else|for|while|try|except|switch|case)\b"), "cfg_branch").when(F.col("stripped").rlike(r"^(return|break|continue|raise|throw)\b"), "cfg_return").otherwise("cfg")
    return lines.select("file", F.col("idx").alias("src"), F.lead("idx").over(Window.partitionBy("file").orderBy("idx")).alias("dst"), kind.alias("type")).where("dst IS NOT NULL")


def indent_edges(lines: DataFrame) -> DataFrame:
    """(file, src, dst): each line from the nearest line before it that is indented less.

    A file's indents are one row, as its text was, and are read once with a stack of the lines whose indents still count.
    """
    per_file = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("idx", "indent"))).alias("s"))

    def parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[tuple] = []
            for file, idx, indent in b.itertuples(index=False):
                open_lines: list[tuple] = []
                for at, depth in zip(idx.tolist(), indent.tolist(), strict=True):
                    while open_lines and open_lines[-1][1] >= depth:
                        open_lines.pop()
                    if open_lines:
                        found.append((file, open_lines[-1][0], at))
                    open_lines.append((at, depth))
                if len(found) >= EDGES_HELD:
                    yield pd.DataFrame(found, columns=["file", "src", "dst"])
                    found = []
            yield pd.DataFrame(found, columns=["file", "src", "dst"])

    return per_file.select("file", F.col("s.idx").alias("idx"), F.col("s.indent").alias("indent")).mapInPandas(parents, "file string, src int, dst int")


def def_use_edges(lines: DataFrame, distance: int = 8) -> DataFrame:
    """(file, src, dst, var): a use from the latest definition before it, if that is at most `distance` lines away. Definitions are
    sent to the next lines only, so files are joined by equal lines."""
    names = F.array_distinct(F.regexp_extract_all("stripped", F.lit(r"\b([a-zA-Z_]\w*)\s*=(?!=)"), F.lit(1)))
    defs = lines.select("file", F.col("idx").alias("src"), F.explode(names).alias("var")).where(~F.col("var").isin(fixed.KEYWORDS))
    sent = defs.select("file", "src", "var", F.explode(F.sequence(F.col("src"), F.col("src") + distance)).alias("idx"))
    latest = sent.groupBy("file", "idx", "var").agg(F.max("src").alias("src")).where("src < idx")
    return latest.join(lines.select("file", "idx", "stripped"), ["file", "idx"]).where(F.contains("stripped", F.col("var"))).select("file", "src", F.col("idx").alias("dst"), "var")
