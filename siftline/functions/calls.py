"""Calls in source text: where each begins and ends, its name and its arguments, over any number of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_NAME = r"[A-Za-z_$][\w$]*"
_QUOTED = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_TRIPLE = r'"""(?s:\\.|.)*?"""|' + r"'''(?s:\\.|.)*?'''"
_BACKTICK = r"`(?s:\\.|[^`\\])*`"
_PATTERN = r"(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
_HASH, _SLASHES = r"#[^\n]*", r"//[^\n]*|/\*(?s:.)*?\*/"
_BRACKET = {")": "(", "]": "[", "}": "{"}
_BLANK = re.compile(r"[^\n]")
#: Words before a name that make it a definition; words that may stand before a call where types also stand before definitions.
_DEFINES = {"def", "function", "func", "class"}
_TYPED, _BEFORE_CALLS = {"java", "c", "cpp"}, {"return", "new", "throw", "else", "case", "do", "sizeof", "delete", "assert"}


class Call(NamedTuple):
    name: str
    begin: int
    end: int
    closed: bool
    arguments: list[str]


def _patterns(language: str) -> tuple[re.Pattern, re.Pattern]:
    python, script = language == "python", language in ("javascript", "typescript")
    strings = "|".join([*([_TRIPLE] if python else []), *([_BACKTICK] if script or language == "go" else []), _QUOTED])
    comments, slashed = (_HASH if python else _SLASHES), (f"|(?P<pattern>{_PATTERN})" if script else "")
    whole = rf"(?P<comment>{comments})|(?P<string>{strings}){slashed}"
    call = rf"(?:(?P<before>{_NAME})[ \t]+)?(?P<name>(?:\.\s*)?{_NAME}(?:\s*\.\s*{_NAME})*)\s*\("
    return re.compile(whole), re.compile(rf"(?P<string>{strings}){slashed}|(?P<call>{call})|(?P<mark>[()\[\]{{}},])")


_BY_LANGUAGE = {x: _patterns(x) for x in ("python", "javascript", "typescript", "java", "c", "cpp", "go")}


def without_comments(text: str, language: str) -> str:
    """text with every character of a comment but line ends replaced by a space, so that places stay."""
    return _BY_LANGUAGE[language][0].sub(lambda m: _BLANK.sub(" ", m[0]) if m["comment"] else m[0], text)


def calls(text: str, language: str) -> Iterator[Call]:
    """The calls of a text without comments, inner ones before outer ones. Strings, and what templates hold, are no code. A bracket closes the
    nearest open one of its kind; a call that nothing closes has `closed` false and ends with its line. A method of a pattern literal is named after a slash."""
    stack: list[tuple[str, str, int, int, list[int]]] = []  # bracket, name, begin, first place inside, places of commas
    pattern_end = -1
    for m in _BY_LANGUAGE[language][1].finditer(text):
        mark = m["mark"]
        if m.groupdict().get("pattern"):
            pattern_end = m.end()
        if m["call"]:
            before = m["before"]
            defined = before in _DEFINES or (before is not None and language in _TYPED and before not in _BEFORE_CALLS)
            name = ("/" if m.start("name") == pattern_end else "") + re.sub(r"\s+", "", m["name"])
            stack.append(("(", "" if defined else name, m.start("name"), m.end(), []))
        elif mark == "," and stack:
            stack[-1][4].append(m.start())
        elif mark in ("(", "[", "{"):
            stack.append((mark, "", m.start(), m.end(), []))
        elif mark in _BRACKET:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == _BRACKET[mark]), None)
            if at is None:
                continue
            for open_call in stack[at + 1 :]:
                if open_call[1]:
                    yield _open(text, open_call)
            _, name, begin, inside, commas = stack[at]
            del stack[at:]
            if name:
                yield Call(name, begin, m.end(), True, _split(text, inside, m.start(), commas))
    for open_call in stack:
        if open_call[1]:
            yield _open(text, open_call)


def _open(text: str, x: tuple) -> Call:
    end = text.find("\n", x[3])
    end = len(text) if end < 0 else end
    return Call(x[1], x[2], end, False, _split(text, x[3], end, [c for c in x[4] if c < end]))


def _split(text: str, begin: int, end: int, commas: list[int]) -> list[str]:
    edges = [begin - 1, *commas, end]
    parts = [text[a + 1 : b].strip() for a, b in zip(edges, edges[1:])]
    return [p for p in parts if p]


_STRING = re.compile(rf"(?:{_TRIPLE}|{_QUOTED})")
_KINDS = [
    ("string", re.compile(rf"[rRbBuU]{{0,2}}(?:{_TRIPLE}|{_QUOTED})")),
    ("format", re.compile(rf"[rR]?[fF][rR]?(?:{_TRIPLE}|{_QUOTED})")),
    ("strings", re.compile(rf"(?:[rRbBuUfF]{{0,2}}(?:{_TRIPLE}|{_QUOTED})\s*)+")),
    ("template", re.compile(_BACKTICK)),
    ("constant", re.compile(r"true|false|null|undefined|None|True|False|nil|[\d.][\w.]*")),
    ("identifier", re.compile(_NAME)),
    ("keyword", re.compile(rf"{_NAME}\s*=(?!=)(?s:.)*")),
    ("member", re.compile(rf"{_NAME}(?:\s*\.\s*{_NAME})+")),
]
_COLLECTION = {"[": "list", "(": "tuple", "{": "dictionary"}


def kind(argument: str) -> str:
    """What an argument is: string, format (string), strings (joined by standing side by side), template, constant, identifier, keyword, member, list,
    tuple, dictionary, or other."""
    for name, pattern in _KINDS:
        if pattern.fullmatch(argument):
            return name
    if argument[:1] in _COLLECTION and argument[-1:] in _BRACKET:
        plain, depth = _STRING.sub("", argument), 0
        for k, c in enumerate(plain):
            depth += (c in "([{") - (c in ")]}")
            if not depth:
                return _COLLECTION[argument[0]] if k == len(plain) - 1 else "other"
    return "other"
