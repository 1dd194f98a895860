"""Lexing of source text.

A file is lexed into spans: comments, literals, directives. What is left is
code, which the other modules work on as a *skeleton*, the code with every
literal replaced by one mark and every comment removed.

Every file is cut into chunks of a few KiB at line ends. Which state a chunk
begins in depends on all that stands before it, so each chunk is lexed from
every state that it might begin in, which gives a map from start states to end
states. These maps compose associatively (:func:`compose`); their prefix
products (:func:`prefixes`) give the true start state of every chunk. A run
from another state joins the run from code as soon as both are in code at the
same place, so that a map costs little more than one scan. The chunks of a huge
file are lexed by several tasks (:mod:`siltstone.llm.stages`); the result is
that of one scan from the start (:func:`lex`), whatever the cuts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

#: Characters of a chunk, about; a chunk ends with a line.
CHUNK = 1 << 12
#: Lines longer than this are cut within, in the languages of ``TORN``: minified scripts and data.
LONG_LINE = 1 << 16
TORN = frozenset(("js", "ts", "json"))

EXTENSIONS = {
    "py": "py", "pyi": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "mts": "ts",
    "java": "java", "kt": "kt", "kts": "kt", "go": "go", "php": "php", "c": "c", "h": "c", "json": "json",
    "yaml": "yaml", "yml": "yaml", "graphql": "graphql", "gql": "graphql",
    "env": "ini", "properties": "ini", "ini": "ini", "toml": "ini", "cfg": "ini", "conf": "ini",
}


def language_of(path: str | None) -> str | None:
    """Language of a path's extension, or None."""
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if path and "." in path else None


DQ = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
SQ = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
TQ = r'"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""'
TSQ = r"'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''"
BLOCK = r"/\*.*?\*/"
SLASH = r"//[^\n]*"
BEFORE_REGEX = r"(?:(?<=[(,=:\[!&|?{};*%~^<>\n])|(?<=[(,=:\[!&|?{};*%~^<>] )|(?<=[^+]\+)|(?<=[^+]\+ )|(?<=[^-]-)|(?<=[^-]- )|(?<=\breturn )|(?<=\A))"
REGEX_BODY = r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])"
JS_REGEX = BEFORE_REGEX + r"/(?![/*])" + REGEX_BODY + r"+/[dgimsuvy]*"
#: A regular expression in a line that the chunk's end tears.
JS_TORN = BEFORE_REGEX + r"/(?![/*])(?=[^\n]*\Z)" + REGEX_BODY + r"*+(?:\[(?:[^\]\\\n]|\\.)*)?\Z"
TEMPLATE = r"`[^`\\$]*(?:(?:\\.|\$(?!\{)|\$\{[^`{}\"'/]*\})[^`\\$]*)*`"
KT_DQ = r'"[^"\\\n$]*(?:(?:\\.|\$(?!\{)|\$\{(?:[^{}\n"]|"[^"\n]*"|\{[^{}\n]*\})*\})[^"\\\n$]*)*"'


class Spec(NamedTuple):
    """How one language lexes. ``opens``: constructs that may run on over lines, group name -> (state, kind)."""

    master: re.Pattern
    opens: dict[str, tuple[str, str]]
    start: str
    #: Where a span may begin; found much faster than the alternatives of ``master``.
    hint: re.Pattern


def _spec(hint: str, parts: dict[str, str], opens: dict | None = None, start: str = "C") -> Spec:
    return Spec(re.compile("|".join(f"(?P<{name}>{p})" for name, p in parts.items()), re.S | re.M), opens or {}, start, re.compile(hint))


BAD = r"[\"']"
CHAR = r"'(?:[^'\\\n]|\\[^\n'][0-9a-fA-F]*|\\')'"
#: Parts are tried in order. Kinds: l line comment, b block comment, s string, t text of several lines, r regular
#: expression, p directive, h text outside of the code, x a literal that doesn't end.
SPECS = {
    "py": _spec("[\"'#]", {"l": r"#[^\n]*", "t": rf"{TQ}|{TSQ}", "D": '"""', "S": "\'\'\'", "s": rf"{DQ}|{SQ}", "x": BAD}, {"D": ("D", "t"), "S": ("S", "t")}),
    "js": _spec("[\"'`/]", {"l": SLASH, "b": BLOCK, "B": r"/\*", "s": rf"{DQ}|{SQ}|{TEMPLATE}", "T": "`", "r": JS_REGEX, "Q": JS_TORN, "x": BAD}, {"B": ("B", "b"), "T": ("`", "s")}),
    "java": _spec("[\"'/]", {"l": SLASH, "b": BLOCK, "B": r"/\*", "t": TQ, "D": '"""', "s": rf"{DQ}|{CHAR}", "x": BAD}, {"B": ("B", "b"), "D": ("D", "t")}),
    "kt": _spec("[\"'/]", {"l": SLASH, "B": r"/\*", "t": r'""".*?"""+', "D": '"""', "s": rf"{KT_DQ}|{CHAR}", "x": BAD}, {"B": ("B1", "b"), "D": ("E", "t")}),
    "go": _spec("[\"'`/]", {"l": SLASH, "b": BLOCK, "B": r"/\*", "s": rf"{DQ}|{CHAR}", "t": "`[^`]*`", "R": "`", "x": BAD}, {"B": ("B", "b"), "R": ("R", "t")}),
    "php": _spec(
        r"[\"'/#]|\?>|<<<",
        {"H": r"\?>", "l": r"(?://|#(?!\[))(?:(?!\?>)[^\n])*", "b": BLOCK, "B": r"/\*", "W": r"<<<[ \t]*(?P<q>[\"']?)(?P<w>[A-Za-z_]\w*)(?P=q)\r?\n", "s": r'"[^"\\]*(?:\\.[^"\\]*)*"' + "|" + r"'[^'\\]*(?:\\.[^'\\]*)*'", "M": '"', "N": "'"},
        {"H": ("H", "h"), "B": ("B", "b"), "M": ("M", "s"), "N": ("N", "s"), "W": ("W:", "t")}, "H",
    ),
    "c": _spec("[\"'/#]", {"l": SLASH, "b": BLOCK, "B": r"/\*", "p": r"#(?:(?!//|/\*)[^\\\n]|\\\n|\\.)*", "s": rf"{DQ}|{SQ}", "x": BAD}, {"B": ("B", "b")}),
    "ini": _spec("[#;]", {"l": r"(?:(?<=\s)|(?<=\A))[#;][^\n]*"}),
    "json": _spec('"', {"s": DQ, "x": '"'}),
    "graphql": _spec('["#]', {"l": r"#[^\n]*", "t": TQ, "D": '"""', "s": DQ, "x": '"'}, {"D": ("D", "t")}),
}
SPECS["ts"] = SPECS["js"]
LANGUAGES = frozenset((*SPECS, "yaml"))
#: How what was begun before ends: state -> (pattern up to and with the end, kind).
CLOSES = {
    s: (re.compile(p, re.S), k)
    for s, p, k in (
        ("D", r'[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""', "t"), ("S", r"[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''", "t"), ("E", r'.*?"""+', "t"), ("R", "[^`]*`", "t"),
        ("H", r".*?<\?(?:php\b|=)?", "h"), ("M", r'[^"\\]*(?:\\.[^"\\]*)*"', "s"), ("N", r"[^'\\]*(?:\\.[^'\\]*)*'", "s"),
        ("Y", r'[^"\\]*(?:\\.[^"\\]*)*"', "s"), ("Z", r"[^']*(?:''[^']*)*'(?!')", "s"),
    )
}
BODY = {'"': re.compile(r'[^"\\\n]*(?:\\.[^"\\\n]*)*', re.S), "'": re.compile(r"[^'\\\n]*(?:\\.[^'\\\n]*)*", re.S)}
REGEX_REST = re.compile(REGEX_BODY + r"*(?P<end>/[dgimsuvy]*)?", re.S)
CLASS_REST = re.compile(r"(?:[^\]\\\n]|\\.)*\]?", re.S)
STACK = re.compile(r"\\.|\$\{|[`{}\"']", re.S)
NESTED = re.compile(r"/\*|\*/")


def _template(text: str, pos: int, end: int, state: str) -> tuple[int, str]:
    """End of a template literal from ``pos`` on, or -1 and the stack of what is open: templates, braces, torn strings.

    A string in an expression that doesn't end with its line is skipped to the line's end.
    """
    stack = list(state)
    if stack[-1] in BODY:
        p = BODY[stack[-1]].match(text, pos, end).end()
        if p >= end:
            return -1, state
        pos = p + (text[p] == stack.pop())
    while stack:
        m = STACK.search(text, pos, end)
        if m is None:
            return -1, "".join(stack)
        t, pos, top = m[0], m.end(), stack[-1]
        if top == "`":
            if t == "`":
                stack.pop()
            elif t == "${":
                stack.append("}")
        elif t == "`":
            stack.append("`")
        elif t in BODY:
            p = BODY[t].match(text, pos, end).end()
            if p >= end:
                return -1, "".join(stack) + t
            pos = p + (text[p] == t)
        elif t in ("{", "${"):
            stack.append("}")
        elif t == "}":
            stack.pop()
    return pos, ""


def _resume(lang: str, state: str, text: str, pos: int, end: int, final: bool) -> tuple[str, int, str]:
    """(kind, end, state) of what is open in ``state`` at ``pos``; end is -1 if it runs on, in which case the state says as what."""
    s = state[0]
    if s == "B":
        if lang != "kt":
            e = text.find("*/", pos, end)
            return "b", e + 2 if e >= 0 else -1, state
        depth = int(state[1:])
        for m in NESTED.finditer(text, pos, end):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return "b", m.end(), ""
        return "b", -1, f"B{depth}"
    if s == "W":
        m = re.compile(rf"(?:.*?\n)??[ \t]*{state[2:]}\b", re.S).match(text, pos, end)
        return "t", m.end() if m else -1, state
    if s in "`":
        e, left = _template(text, pos, end, state)
        return "s", e, left
    if s in CLOSES:
        close, kind = CLOSES[s]
        m = close.match(text, pos, end)
        return kind, m.end() if m else -1, state
    if s == "L":
        e = text.find("\n", pos, end)
        return "l", e if e >= 0 else end if final else -1, state
    if s in "dq":
        quote = '"' if s == "d" else "'"
        e = BODY[quote].match(text, pos, end).end()
        if e < end and text[e] == quote:
            return "s", e + 1, ""
        return ("x", e, "") if e < end or final else ("s", -1, state)
    if s == "k":
        pos = CLASS_REST.match(text, pos, end).end()
    m = REGEX_REST.match(text, pos, end)
    if m["end"] or m.end() < end and text[m.end()] == "\n" or final:
        return "r", m.end(), ""
    return "r", -1, "k" if m.end() < end else "r"


class Run(NamedTuple):
    """One scan of a chunk: its spans and the state at its end."""

    spans: list[tuple[str, int, int]]
    end: str


def scan(lang: str, text: str, at: int, end: int, state: str, final: bool, other: Run | None = None) -> Run:
    """Lex ``text[at:end]`` from ``state``; ``final`` says that the text ends there. ``other`` is the run from code, which is joined where both meet."""
    if lang == "yaml":
        return _scan_yaml(text, at, end, state, final)
    spec, pos, spans = SPECS[lang], at, []
    add = spans.append
    if state != "C":
        kind, pos, left = _resume(lang, state, text, at, end, final)
        if pos < 0:
            return Run([(kind, at, end)] if end > at else [], left)
        add((kind, at, pos))
        if other is not None and pos < end:
            i = bisect_left(other.spans, pos, key=lambda x: x[2])
            if i == len(other.spans) or other.spans[i][1] >= pos or other.spans[i][2] == pos:
                return Run(spans + [x for x in other.spans[i:] if x[1] >= pos], other.end)
    hint, match, opens = spec.hint.search, spec.master.match, spec.opens
    torn = lang in TORN and not final and end > at and text[end - 1] != "\n"
    while True:
        where = hint(text, pos, end)
        if where is None:
            break
        m = match(text, where.start(), end)
        if m is None:
            pos = where.start() + 1
            continue
        kind, a, b = m.lastgroup, *m.span()
        if kind in opens:
            to, kind = opens[kind]
            kind, b, left = _resume(lang, to + m["w"] if to == "W:" else to, text, b, end, final)
            if b < 0:
                add((kind, a, end))
                return Run(spans, left)
        elif kind == "Q":
            if not torn:
                pos = a + 1
                continue
            add(("r", a, end))
            body = REGEX_REST.match(text, a + 1, end).end()
            return Run(spans, "k" if body < end else "r")
        elif kind == "x":
            e = text.find("\n", a, end)
            if e < 0 and torn:
                add(("s", a, end))
                return Run(spans, "d" if text[a] == '"' else "q")
            b = end if e < 0 else e
        add((kind, a, b))
        pos = b
    if torn and spans and spans[-1][0] == "l" and spans[-1][2] == end:
        return Run(spans, "L")
    return Run(spans, "C")


YAML_TOKEN = re.compile(r"(?:(?<=\s)|(?<=\A))#[^\n]*|(?:(?<=[\"']):|[\[{,:?-][ \t]+|[\[{,]|^[ \t]*)(?:[&!][^\s\"']*[ \t]+)*(?P<q>[\"'])", re.M)
YAML_BLOCK = re.compile(r"(?:^|[:\-?][ \t]+)(?:[&!][\w./!-]*[ \t]+)*[|>][+-]?\d?[+-]?[ \t]*(?:[ \t]#[^\n]*)?\r?$")
YAML_LINE = re.compile(r"^([ ]*)((?:[-?][ ]+)*)")


def _scan_yaml(text: str, at: int, end: int, state: str, final: bool) -> Run:
    """YAML line by line: comments, quoted scalars (over lines: Y, Z), block scalars (K and the indent of their parent), which hold neither."""
    spans: list[tuple[str, int, int]] = []
    pos = at
    block = int(state[1:]) if state[0] == "K" else -1
    if state[0] in "YZ":
        close, kind = CLOSES[state[0]]
        m = close.match(text, pos, end)
        if m is None:
            return Run([(kind, at, end)] if end > at else [], state)
        pos = m.end()
        spans.append((kind, at, pos))
    while pos < end:
        nl = text.find("\n", pos, end)
        stop = end if nl < 0 else nl
        line = text[pos:stop]
        if block >= 0:
            body = line.lstrip(" ")
            if not body.strip() or len(line) - len(body) > block:
                pos = stop + 1
                continue
            block = -1
        p = behind = pos
        while m := YAML_TOKEN.search(text, p, stop):
            if m["q"] is None:
                spans.append(("l", m.start(), m.end()))
                p = m.end()
                break
            q = m.start("q")
            s = "Y" if m["q"] == '"' else "Z"
            close = CLOSES[s][0].match(text, q + 1, end)
            if close is None:
                spans.append(("s", q, end))
                return Run(spans, s)
            spans.append(("s", q, close.end()))
            p = behind = close.end()
            if p > stop:
                nl = text.find("\n", p, end)
                stop = end if nl < 0 else nl
        begun = text.rfind("\n", 0, pos) + 1
        if YAML_BLOCK.search(text[behind:stop]):
            block = len(YAML_LINE.match(text[begun:stop])[1])
        pos = stop + 1
    return Run(spans, f"K{block}" if block >= 0 else "C")


def lex(lang: str, text: str, state: str | None = None) -> tuple[list[tuple[str, int, int]], str]:
    """Spans of a whole text by one scan, and the state at its end."""
    return tuple(scan(lang, text, 0, len(text), start_of(lang) if state is None else state, True))


def start_of(lang: str) -> str:
    return SPECS[lang].start if lang in SPECS else "C"


#: States that a chunk of a language may begin in, and what the text must hold for that.
POSSIBLE = {
    "py": (("D", '"""'), ("S", "'''")), "java": (("B", "/*"), ("D", '"""')), "go": (("B", "/*"), ("R", "`")), "c": (("B", "/*"),), "graphql": (("D", '"""'),), "kt": (("E", '"""'),),
    "php": (("H", "?>"), ("B", "/*"), ("M", '"'), ("N", "'")), "yaml": (("Y", '"'), ("Z", "'")), "json": (), "ini": (), "js": (("B", "/*"), ("`", "`"), ("`}", "${"), ("`}}", "${"), ("`}`", "${")),
}
POSSIBLE["ts"] = POSSIBLE["js"]
HEREDOC = re.compile(r"<<<[ \t]*[\"']?([A-Za-z_]\w*)")
#: What a line that the chunk's border tears may be in.
IN_LINE = {"json": ("d",), "js": ("L", "d", "q", "r", "k"), "ts": ("L", "d", "q", "r", "k")}


def states_of(lang: str, text: str) -> list[str]:
    """The states that a chunk of ``text`` may begin in; deeper nested templates than three are found on demand."""
    out = ["C"] + [s for s, sign in POSSIBLE[lang] if sign in text]
    if lang == "php":
        out += sorted({"W:" + w for w in HEREDOC.findall(text)})
        if "H" not in out:
            out.append("H")
    elif lang == "kt":
        deepest = depth = 0
        for m in NESTED.finditer(text):
            depth = max(0, depth + (1 if m[0] == "/*" else -1))
            deepest = max(deepest, depth)
        out += [f"B{d}" for d in range(1, deepest + 1)]
    elif lang == "yaml":
        out += sorted({f"K{len(line) - len(line.lstrip(' '))}" for line in text.split("\n") if "|" in line or ">" in line})
    return out


def borders(lang: str, text: str, size: int = CHUNK) -> list[int]:
    """Ends of the chunks: line ends without a backslash; in a long line of a torn language behind a separator."""
    out, pos, n = [], 0, len(text)
    while n - pos > size:
        cut = text.find("\n", pos + size - 1) + 1
        while cut and text[max(0, cut - 3) : cut - 1].rstrip("\r").endswith("\\"):
            cut = text.find("\n", cut) + 1
        cut = cut or n
        if lang in TORN and cut - pos > size + LONG_LINE:
            ends = [e for e in (text.find(c, pos + size + LONG_LINE - 1, cut) for c in ";,{") if e >= 0]
            if ends and text[min(ends) - 1] != "\\":
                cut = min(ends) + 1
        out.append(cut)
        pos = cut
    if pos < n or not out:
        out.append(n)
    return out


def runs_of(lang: str, text: str, at: int, end: int, states: list[str], final: bool) -> dict[str, Run]:
    """A run of the chunk from each state; the one from code is joined by the others."""
    code = scan(lang, text, at, end, "C", final)
    out = {"C": code}
    for s in states if at == 0 or text[at - 1] == "\n" else [*states, *IN_LINE.get(lang, ())]:
        if s != "C":
            out[s] = scan(lang, text, at, end, s, final, code)
    return out


def map_of(runs: dict[str, Run]) -> dict[str, str]:
    """From every state that a chunk may begin in to the state at its end."""
    return {s: r.end for s, r in runs.items()}


def compose(first: dict[str, str], then: dict[str, str]) -> dict[str, str]:
    """The map of two neighbouring chunks; associative. What a map doesn't know has no entry."""
    return {s: then[e] for s, e in first.items() if e in then}


def prefixes(maps: list[dict[str, str]]) -> list[dict[str, str] | None]:
    """The product of all maps before each one, by pairs of pairs; None before the first."""
    if len(maps) < 2:
        return [None] * len(maps)
    pairs = [compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
    above = prefixes(pairs + ([maps[-1]] if len(maps) % 2 else []))
    out: list[dict[str, str] | None] = []
    for i, m in enumerate(maps):
        before = above[i // 2]
        out.append(before if i % 2 == 0 else maps[i - 1] if before is None else compose(before, maps[i - 1]))
    return out


class Piece(NamedTuple):
    """A chunk lexed from its true start state."""

    at: int
    end: int
    start: str
    run: Run


def pieces_of(lang: str, text: str, size: int = CHUNK, start: str | None = None, base: int = 0, final: bool = True, states: list[str] | None = None) -> list[Piece]:
    """The chunks of ``text[base:]`` with their true states: maps of all chunks, their prefix products, then the runs that these choose."""
    start = start_of(lang) if start is None else start
    ends = [e for e in borders(lang, text[base:] if base else text, size)]
    ends = [e + base for e in ends]
    if len(ends) == 1:
        return [Piece(base, ends[0], start, scan(lang, text, base, ends[0], start, final))]
    states = states_of(lang, text) if states is None else states
    starts = [base, *ends[:-1]]
    every = [runs_of(lang, text, a, b, states, final and b == ends[-1]) for a, b in zip(starts, ends, strict=True)]
    out: list[Piece] = []
    for a, b, runs, before in zip(starts, ends, every, prefixes([map_of(r) for r in every]), strict=True):
        state = start if before is None else before.get(start) or (out[-1].run.end if out else start)
        run = runs.get(state) or scan(lang, text, a, b, state, final and b == ends[-1], runs["C"])
        out.append(Piece(a, b, state, run))
    return out


def join_pieces(pieces: list[Piece]) -> tuple[list[tuple[str, int, int]], str]:
    """Spans of a text from those of its chunks; one that runs over a border becomes whole, of the kind that its end says."""
    out: list[tuple[str, int, int]] = []
    open_state = "C"
    for p in pieces:
        spans = p.run.spans
        if spans and open_state not in ("C",) and open_state[0] != "K" and out and out[-1][2] == p.at == spans[0][1]:
            out[-1] = (spans[0][0], out[-1][1], spans[0][2])
            spans = spans[1:]
        out += spans
        open_state = p.run.end
    return out, open_state


class Lexed(NamedTuple):
    """A file as the operators see it; ``notes`` are what was said of each chunk."""

    lang: str
    text: str
    spans: list[tuple[str, int, int]]
    end: str
    notes: list


Note = Callable[[str, str, Piece, bool], object]


def lexed(lang: str, text: str, note: Note | None = None, size: int = CHUNK) -> Lexed:
    """Lex a file by its chunks; ``note(lang, text, piece, last)`` is said of each."""
    pieces = pieces_of(lang, text, size)
    spans, end = join_pieces(pieces)
    notes = [note(lang, text, p, p.end == len(text)) for p in pieces] if note else []
    return Lexed(lang, text, spans, end, notes)


SNIFF = [
    (re.compile(p, re.M), lang)
    for p, lang in (
        (r"\A\s*<\?php", "php"),
        (r"^package [\w.]+;", "java"),
        (r"^package \w+[ \t]*\r?$(?=[\s\S]*^(?:func |import|type |var ))", "go"),
        (r"^package [\w.]+[ \t]*\r?$", "kt"),
        (r"^#include\b", "c"),
        (r"^(?:import logging|from [\w.]+ import |def \w+\(.*:[ \t]*\r?$|class \w+(?:\(\w*\))?:[ \t]*\r?$)", "py"),
        (r"^(?:import type |import \{|export (?:abstract )?(?:class|interface|enum|type) |@\w+\(.*\)\s*\r?\nexport )", "ts"),
        (r"^(?:const \w+ = require\(|module\.exports|(?:async )?function \w+\()", "js"),
        (r"\A\s*[\[{]\s*(?:\"|[\]}\[{\d])", "json"),
        (r"^(?:type|input|enum|interface) \w+[^\n]*\{[ \t]*\r?$(?=\n\s+\w+(?:\([^)]*\))?:? )", "graphql"),
        (r"^[\w-]+:(?: [\"'\w]|[ \t]*\r?$)", "yaml"),
    )
]


OWN = {lang: p for p, lang in SNIFF}
OWN["ts"] = re.compile(OWN["ts"].pattern + "|" + OWN["js"].pattern, re.M)


def sniff(lang: str | None, text: str) -> str | None:
    """The language to lex ``text`` in: that of its extension, unless its lines speak for another."""
    own = OWN.get(lang)
    if own is not None and own.search(text):
        return lang
    for p, found in SNIFF:
        if p.search(text):
            if lang == found or {lang, found} == {"js", "ts"} or lang in ("js", "ts", "java", "c") and found in ("graphql", "yaml"):
                return lang
            if found == "json" and lang is not None and lang != "yaml":
                return lang
            return found
    return lang


def skeleton(text: str, spans: list[tuple[str, int, int]], at: int = 0, end: int | None = None, continued: bool = False) -> str:
    """The code of ``text[at:end]``: each literal becomes ``"``, each comment a blank (or its line ends), directives vanish.

    ``continued`` says that the first span began in the chunk before. A template
    right behind a name or bracket belongs to what stands before it.
    """
    out, pos = [], at
    for kind, a, b in spans:
        out.append(text[pos:a])
        if continued and a == at:
            out.append("\n" if kind == "b" and "\n" in text[a:b] else "")
        elif kind == "h":
            out.append(";")
        elif kind in "strx":
            if not (text[a] == "`" and a and (text[a - 1].isalnum() or text[a - 1] in "_$)]")):
                out.append('"')
        elif kind == "b":
            out.append("\n" if "\n" in text[a:b] else " ")
        continued = False
        pos = b
    out.append(text[pos:end])
    return "".join(out)
