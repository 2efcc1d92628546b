import random

import pytest
from pyspark.sql import functions as F

from siftline import fixed
from siftline.functions import calls, texts
from siftline.operators import detection as det
from siftline.operators import reports
from siftline.sources import sarif

FILES = "file string, language string, text string"


def found(spark, *files):
    rows = [(f"f{k}", language, text) for k, (language, text) in enumerate(files)]
    return {(r.file, r.line_no, r.cwe_id) for r in det.detect(spark.createDataFrame(rows, FILES), det.rules(spark)).collect()}


def padded(before, lines, after, code):
    """code with `before` lines of text before it, of which the given ones come first, and `after` behind it."""
    return "\n".join([*lines, *["x = 1"] * (before - len(lines)), code, *["x = 1"] * after])


def test_paths_are_safe_near_a_mitigation(spark):
    strong, weak = "base = os.path.realpath(root)", "ok = p.startswith(root) and basename(p)"
    near, far, behind, beyond = padded(5, [strong], 0, "open(path)"), padded(6, [strong], 0, "open(path)"), "open(path)\nx = 1\n" + weak, "open(path)\nx = 1\nx = 2\n" + weak
    assert found(spark, *[("python", t) for t in (near, far, behind, beyond, "open(path)\nok = p.startswith(root)")]) == {("f1", 7, "CWE-22"), ("f3", 1, "CWE-22"), ("f4", 1, "CWE-22")}


def test_addresses_are_unsafe_near_user_data(spark):
    source = "const t = req.query.target"
    ten, eleven, one, two = padded(10, [source], 0, "fetch(url)"), padded(11, [source], 0, "fetch(url)"), f"fetch(url)\n{source}", f"fetch(url)\nx = 1\n{source}"
    assert found(spark, *[("javascript", t) for t in (ten, eleven, one, two, "fetch(new URL(x))", f"{source}\nfetch('http://a.example')")]) == {("f0", 11, "CWE-918"), ("f2", 1, "CWE-918")}


def test_modules_write_no_pages(spark):
    write = "document.write(x)"
    assert found(spark, ("javascript", padded(4, ["module.exports = {}"], 0, write)), ("javascript", "\n" * 5 + f"module.exports = {{}}\n{write}"), ("javascript", f"export default {{}}\n\n\n\n\n\n\n{write}")) == {("f1", 7, "CWE-79")}


def test_joined_paths_are_safe_if_all_parts_are_plain(spark):
    assert found(spark, ("python", 'os.path.join("a", name)\nos.path.join("a", x.y)\nsend_file("a.txt")')) == {("f0", 2, "CWE-22")}


def test_secrets_are_findings(spark):
    code = ['api_key = "k12-secret"', 'password = "changeme"', 'secret = "aaaa"', "const db_pass = process.env.P || 'hunter-22'", 'x = os.environ.get("A") or "no-name"', 'token = "abcdef"', "password = read()"]
    assert found(spark, ("python", "\n".join(code)), ("typescript", code[0]), ("java", code[0]), (None, code[0])) == {("f0", 1, "CWE-798"), ("f0", 4, "CWE-798"), ("f1", 1, "CWE-798")}


def test_files_without_findings(spark):
    files = spark.createDataFrame([("a", "python", "eval(x)"), ("b", "python", "x = 1"), ("c", None, "eval(x)"), ("d", "c", "strcpy(a, b)"), ("e", "python", None)], FILES)
    assert sorted(r.file for r in det.clearly_safe(files, det.detect(files, det.rules(spark))).collect()) == ["b", "c", "e"]


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1, 2), (5, 5)])
def test_context_windows(spark, before, after):
    lines = [f"hit {k}" if k % 3 == 0 else f"line {k}" for k in range(1, 12)]
    got = {r.line_no: r.context for r in det.context_windows(spark.createDataFrame([("f", "\n".join(lines)), ("g", "none"), ("h", None)], "file string, text string"), "^hit|\nhit", before, after).collect()}
    assert got == {k: "\n".join(lines[max(0, k - 1 - before) : k + after]) for k in (3, 6, 9)} or got == {}
    got = {r.line_no: r.context for r in det.context_windows(spark.createDataFrame([("f", "\n".join(lines))], "file string, text string"), "hit", before, after).collect()}
    assert got == {k: "\n".join(lines[max(0, k - 1 - before) : k + after]) for k in (3, 6, 9)}


def test_places_follow_the_order(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 101).alias("k")).repartition(7)
    got = [(r.place, r.k, r.id) for r in reports.placed(rows, F.desc("k"), F.col("id")).collect()]
    want = sorted(((i * 7919 % 101, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert sorted(got) == [(n + 1, k, i) for n, (k, i) in enumerate(want)]
    assert reports.placed(rows.limit(0), F.col("id")).count() == 0


def test_groups_make_documents_of_bounded_size(spark):
    rows = [(k, "hot" if k % 3 else f"g#{k % 2}", f"r{k % 4}", "CWE-89", "high", 0.9, "a.py", k, None) for k in range(300)]
    findings = spark.createDataFrame(rows, "id long, grp string, rule_id string, cwe_id string, severity string, confidence double, file_path string, line int, taint_flow array<struct<file_path:string,line:int>>")
    docs = sarif.documents(findings, "grp", most=40)
    back = sarif.scan(docs).withColumn("grp", sarif.group_of(F.col("doc")))
    sizes = [r["count"] for r in back.groupBy("doc").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 80 and back.count() == 300
    assert {(r.grp, r.line) for r in back.collect()} == {(r[1], r[7]) for r in rows}


def test_narratives(spark):
    c = F.col
    rows = [("CWE-89", "SQL Injection", "a.py:3", True, "network", "none", ["step one"], "p", None, 0.1, 9.8, "critical"), ("CWE-22", None, "b.py:9", False, "local", "low", [], None, ["a guard"], 0.9, 0.0, "none"), ("CWE-1", None, "c:1", None, None, None, None, None, None, None, 1.0, "low")]
    df = spark.createDataFrame(rows, "cwe string, name string, place string, ex boolean, av string, pr string, steps array<string>, payload string, defences array<string>, cov double, base double, sev string")
    got = [r[0] for r in df.select(texts.evidence_narrative(*[c(x) for x in df.columns])).collect()]
    assert got == [
        "SQL Injection at a.py:3 can be exploited over the network by anyone. step one. There is a payload for it. Nothing on the path defends it. It scores 9.8 of 10 in CVSS 3.1, which is critical.",
        "CWE-22 at b.py:9 is suspected, but no way to exploit it is known. a guard. It scores 0.0 of 10 in CVSS 3.1, which is none.",
        None,
    ]


def test_every_rule_has_plain_functions():
    assert all(isinstance(f, str) and " " not in f for group in fixed.RULES.values() for *_, functions in group for f in functions)
    assert all(len(words) == 8 for words in [*fixed.CVSS_BY_CWE.values(), fixed.CVSS_OTHERWISE])


def plain_calls(text, language):
    """A scanner character by character: (name, begin, end) of closed calls, without strings and comments."""
    out, stack, at, clean = [], [], 0, []
    quotes = {"python": ['"""', "'''", '"', "'"], "javascript": ["`", '"', "'"], "go": ["`", '"', "'"], "java": ['"', "'"]}[language]
    while at < len(text):
        quote = next((q for q in quotes if text.startswith(q, at)), None)
        if quote:
            k = at + len(quote)
            while k < len(text) and not text.startswith(quote, k) and (quote in ('"""', "'''", "`") or text[k] != "\n"):
                k += 2 if text[k] == "\\" else 1
            if text.startswith(quote, k):
                clean.append("\0" * (k + len(quote) - at))
                at = k + len(quote)
                continue
        end = None
        if language == "python" and text[at] == "#" or language != "python" and text.startswith("//", at):
            end = text.find("\n", at) if "\n" in text[at:] else len(text)
        elif language != "python" and text.startswith("/*", at) and "*/" in text[at + 2 :]:
            end = text.index("*/", at + 2) + 2
        if end is not None:
            clean.append("".join(c if c == "\n" else " " for c in text[at:end]))
            at = end
            continue
        clean.append(text[at])
        at += 1
    code = "".join(clean)
    for k, c in enumerate(code):
        if c in "([{":
            begin = k
            while begin and code[begin - 1].isspace():
                begin -= 1
            stop = begin
            while begin and (code[begin - 1].isalnum() or code[begin - 1] in "_$."):
                begin -= 1
            stack.append((c, code[begin:stop] if c == "(" else "", begin))
        elif c in ")]}":
            match = {")": "(", "]": "[", "}": "{"}[c]
            if any(x[0] == match for x in stack):
                while stack[-1][0] != match:
                    stack.pop()
                _, name, begin = stack.pop()
                if name and not name[0].isdigit():
                    out.append((name, begin, k + 1))
    return sorted(out)


@pytest.mark.parametrize("language", ["python", "javascript", "java", "go"])
def test_calls_are_a_plain_scanners(language):
    rng = random.Random(7)
    pieces = ["f(", "a.b(", "return" if language == "java" else "x", ",", ")", ")", "]", "[", "{", "}", "\n", " ", "'a)'", '"b(\\""', "'", '"', "# c(\n" if language == "python" else "// c(\n", "/* d( */", "`t(`", '"""e(\n"""', "+", ";"]
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        plain = calls.without_comments(text, language)
        assert len(plain) == len(text)
        got = sorted((c.name, c.begin, c.end) for c in calls.calls(plain, language) if c.closed)
        assert got == plain_calls(text, language), text


def test_arguments_and_their_kinds():
    text = 'f(\n  "a, (b)",  # c, d)\n  x, [1, (2)], (3,), {"k": 1}, k = [4], a.b, g(h(1), 2), "p" "q", f"{z}", None, [1] + [2],\n)'
    got = [c for c in calls.calls(calls.without_comments(text, "python"), "python") if c.name == "f"][0]
    assert [calls.kind(a) for a in got.arguments] == ["string", "identifier", "list", "tuple", "dictionary", "keyword", "member", "other", "strings", "format", "constant", "other"]
    assert got.closed and text[got.begin : got.end] == text


def test_calls_over_several_lines(spark):
    python = 'cursor.execute(\n    "SELECT " + x)\nrequests.get(\n  request.args["u"])\nprint(\n  password\n)\ncursor.execute(\n  "SELECT ?",\n  (x,),\n)\nprint(\n  "password"\n)\ndef open(path):\n  pass\n# eval(x)\ns = "eval(x)"\ncursor.execute('
    script = "res.redirect(req.headers.referer)\nnodeFetch(req.query.url)\nx = /eval(/.exec(y)\nthis.requestsPool.get(u)\nnew DOMParser({noent: true})\nfetch(`http://a/${req.query.u}`)\nlogger.child.info.call(1)"
    got = found(spark, ("python", python), ("javascript", script), ("python", 'redirect(request.values["next"])\nJSON.parse.execute(x)'))
    assert got == {("f0", 1, "CWE-89"), ("f0", 3, "CWE-918"), ("f0", 5, "CWE-532"), ("f0", 19, "CWE-89"), ("f1", 1, "CWE-601"), ("f1", 2, "CWE-918"), ("f1", 5, "CWE-611"), ("f1", 6, "CWE-918"), ("f2", 1, "CWE-601")}


def test_names_meet_functions_as_whole_parts(spark):
    names = ["execute", "db.execute", "executor", "regex.exec", "a.re.exec", "child_process.exec", "my_child_process.run.exec", "file.open", "open", "shelve.open", "my.pickle.load", "x.load", "self.requests_session.get", "os.system.call", "core.eval"]
    rows = spark.createDataFrame([("f", lang, "\n".join(f"{n}(x)" for n in names)) for lang in ("python", "javascript")], FILES)
    hit = {(r.language, r.call) for r in det.rule_match(det.called(rows), det.rules(spark)).collect()}
    python = {"execute", "db.execute", "file.open", "open", "shelve.open", "my.pickle.load", "self.requests_session.get", "os.system.call", "regex.exec", "a.re.exec", "child_process.exec", "my_child_process.run.exec"}
    # exec is a function of both; methods of pattern objects aren't it
    assert {c for lang, c in hit if lang == "python"} == python - {"regex.exec", "a.re.exec"}
    assert {c for lang, c in hit if lang == "javascript"} == {"execute", "db.execute", "self.requests_session.get", "child_process.exec", "my_child_process.run.exec"}


def test_indents_by_a_stack(spark):
    rng = random.Random(8)
    files = {"rising": list(range(10_000)), "flat": [4] * 50, "any": [rng.randrange(6) for _ in range(300)], "one": [3], "falling": [3, 2, 1, 0]}
    rows = [(f, k, d) for f, ds in files.items() for k, d in enumerate(ds)]
    got = det.indent_edges(spark.createDataFrame(rows, "file string, idx int, indent int").repartition(5)).collect()
    want = {(f, max((j for j in range(k) if ds[j] < d), default=None), k) for f, ds in files.items() if f != "rising" for k, d in enumerate(ds)}
    want = {w for w in want if w[1] is not None} | {("rising", k - 1, k) for k in range(1, 10_000)}
    assert {(r.file, r.src, r.dst) for r in got} == want and len(got) == len(want)
