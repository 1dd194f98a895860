"""Functions and methods of a file with their enclosing type and documentation comment."""

from __future__ import annotations

import re
from bisect import bisect_left

from . import prose

NOT_NAMES = frozenset("if for while switch catch return function new else do try with typeof await yield throw synchronized foreach elseif match when sizeof super this case in of instanceof".split())
BALANCED = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
GENERIC = r"(?:<(?:[^<>;{}()]++|<(?:[^<>;{}()]++|<[^<>;{}()]*+>)*+>)*+>)"
JS_MODS = r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|export|default|declare)[ \t]+)*"
JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*"
AT = r"(?:@[\w.:]+(?:" + BALANCED + r")?[ \t]*)*"
RET = r"(?:[ \t]*:[ \t]*[^\n;{}=]*?(?:\{[^{}\n]*\}[^\n;{}=]*?)?)?"

#: Declarations by language: the name, the signature and what follows it (a brace, ``=``, ``=>`` or ``;``).
DECLARATIONS = {
    "py": [re.compile(rf"^(?P<i>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?:\[[^\]\n]*\])?(?P<s>{BALANCED})[^:\n]*(?::|->[^\n]*?:(?=[ \t]*(?:\n|$|[\"'#])))(?P<b>)", re.M)],
    "js": [
        re.compile(rf"^[ \t]*{JS_MODS}function[ \t]*\*?[ \t]*(?P<n>[\w$]+)[ \t]*{GENERIC}?[ \t]*(?P<s>{BALANCED}){RET}\s*(?P<b>[{{;])", re.M),
        re.compile(rf"^[ \t]*{JS_MODS}(?:const|let|var)[ \t]+(?P<n>[\w$]+)(?:[ \t]*:[^=\n]+)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*[\w$]*[ \t]*{GENERIC}?(?P<s>{BALANCED}){RET}\s*(?P<b>\{{)|{GENERIC}?(?P<s2>{BALANCED}|[\w$]+){RET}[ \t]*(?P<b2>=>))", re.M),
        re.compile(rf"^[ \t]*+{AT}{JS_MODS}\*?[ \t]*+(?P<n>#?[A-Za-z_$\u0080-\uffff][\w$]*+)\??[ \t]*+{GENERIC}?[ \t]*+(?P<s>{BALANCED}){RET}\s*+(?P<b>\{{)", re.M),
        re.compile(rf"^[ \t]*+{AT}{JS_MODS}(?P<n>#?[A-Za-z_$\u0080-\uffff][\w$]*+)[?!]?(?:[ \t]*:[^=\n;{{}}]+(?:=>[^=\n;{{}}]+)?)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*[\w$]*[ \t]*{GENERIC}?(?P<s>{BALANCED}){RET}\s*(?P<b>\{{)|{GENERIC}?(?P<s2>{BALANCED}|[\w$]+){RET}[ \t]*(?P<b2>=>))", re.M),
    ],
    "java": [re.compile(rf"^[ \t]*{AT}{JAVA_MODS}(?:{GENERIC}[ \t]*)?(?:(?!return\b|new\b|throw\b|else\b|record\b)[\w.]+{GENERIC}?(?:\[\])*[ \t]+)?(?P<n>\w+)[ \t]*(?P<s>{BALANCED})[ \t]*(?:throws[ \t]+[\w., \t]+)?\s*(?P<b>[{{;])", re.M)],
    "kt": [re.compile(rf"^[ \t]*{AT}(?:[a-z]+[ \t]+)*?fun[ \t]+(?:{GENERIC}[ \t]*)?(?:[\w<>?, ]+\.)?(?P<n>`[^`\n]+`|\w+)[ \t]*(?P<s>{BALANCED})(?:[ \t]*:[ \t]*[^\n{{=]+?)?[ \t]*(?P<b>\{{|=|\n|$)", re.M)],
    "go": [re.compile(rf"^func[ \t]*(?:\([ \t]*(?:\w+[ \t]+)?\*?[ \t]*(?P<o>\w+)[^()]*\)[ \t]*)?(?P<n>\w+)[ \t]*(?:\[[^\]\n]*\])?(?P<s>{BALANCED})[^\n{{]*?(?P<b>\{{)", re.M)],
    "php": [
        re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)*function[ \t]*&?[ \t]*(?P<n>\w+)[ \t]*(?P<s>{BALANCED})(?:[ \t]*:[ \t]*[?\w\\|&]+)?\s*(?P<b>[{{;])", re.M | re.I),
        re.compile(rf"^[ \t]*\$(?P<n>\w+)[ \t]*=[ \t]*(?:static[ \t]+)?(?:function|fn)[ \t]*&?[ \t]*(?P<s>{BALANCED})[^\n;{{]*?(?P<b>\{{|=>)", re.M),
    ],
    "c": [re.compile(rf"^(?![ \t]*(?:return|else|typedef|goto|case)\b)[ \t]*(?:[A-Za-z_]\w*\b(?:\s+(?=[A-Za-z_])|\s*\*[\s*]*)){{1,8}}?(?P<n>[A-Za-z_]\w*+)[ \t]*(?P<s>{BALANCED})\s*(?P<b>[{{;])", re.M)],
}
DECLARATIONS["ts"] = DECLARATIONS["js"]
TYPES = {
    "py": re.compile(r"^([ \t]*)class[ \t]+(\w+)", re.M),
    "js": re.compile(r"\bclass[ \t]+([\w$]+)[^{};()]*\{"), "ts": re.compile(r"\b(?:class|interface)[ \t]+([\w$]+)[^{};]*\{"),
    "java": re.compile(r"\b(?:class|interface|enum|record)[ \t]+(\w+)[^{};]*\{"), "kt": re.compile(r"\b(?:class|interface|object)[ \t]+(\w+)[^{};=]*\{"),
    "php": re.compile(r"\b(?:class|interface|trait|enum)[ \t]+(\w+)[^{};]*\{", re.I),
}
PYTHON_HEAD = re.compile(r"[ \t]*(class|def|async[ \t]+def)[ \t]+(\w+)")
#: Round brackets in round brackets that ``BALANCED`` follows; deeper ones are filled before.
DEEPEST = 4
ANNOTATION_LINE = re.compile(r"^[ \t]*(?:@[\w.:]+|#\[)")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with comments blanked and literals filled, at the same offsets."""
    out, pos = [], 0
    for kind, a, b in spans:
        out.append(text[pos:a])
        inside = text[a:b]
        if kind in "lbh":
            out.append(re.sub(r"[^\n]", " ", inside) if "\n" in inside else " " * (b - a))
        elif kind in "stx" and b - a >= 2:
            out.append('"' + "_" * (b - a - 2) + '"')
        else:
            out.append("_" * (b - a))
        pos = b
    out.append(text[pos:])
    return "".join(out)


class Braces:
    """The curly brackets of a file, as a forest."""

    def __init__(self, code: str) -> None:
        self.starts: list[int] = []
        self.ends: dict[int, int] = {}
        self.outer: dict[int, int | None] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", code):
            at = m.start()
            if m[0] == "{":
                self.outer[at] = stack[-1] if stack else None
                self.starts.append(at)
                stack.append(at)
            elif stack:
                self.ends[stack.pop()] = at
        self.size = len(code)

    def around(self, pos: int) -> int | None:
        """The innermost bracket that is open at ``pos``."""
        i = bisect_left(self.starts, pos)
        at = self.starts[i - 1] if i else None
        while at is not None and self.ends.get(at, self.size) <= pos:
            at = self.outer[at]
        return at


def _flat(code: str) -> str:
    """Code in which round brackets deeper than the patterns can follow, within one statement list, are filled."""
    stack, deep = [], []
    for m in re.finditer(r"[(){}]", code):
        t = m[0]
        if t == "{":
            stack.append(0)
        elif t == "}":
            if len(stack) > 1:
                stack.pop()
        else:
            if not stack:
                stack.append(0)
            if t == "(":
                stack[-1] += 1
            if stack[-1] > DEEPEST:
                deep.append(m.start())
            if t == ")" and stack[-1] > 0:
                stack[-1] -= 1
    if not deep:
        return code
    out, pos = [], 0
    for at in deep:
        out += [code[pos:at], "_"]
        pos = at + 1
    return "".join(out) + code[pos:]


def _python_owners(code: str) -> dict[int, str]:
    """Start of the line of each ``def`` -> the class around it, by the indents of lines outside of brackets."""
    out: dict[int, str] = {}
    classes: list[tuple[int, str]] = []
    depth = pos = 0
    for line in code.split("\n"):
        if line.strip():
            if depth <= 0:
                indent = len(line) - len(line.lstrip())
                if indent:
                    indent = len(line[:indent].expandtabs())
                while classes and classes[-1][0] >= indent:
                    classes.pop()
                m = PYTHON_HEAD.match(line)
                if m and m[1] == "class":
                    classes.append((indent, m[2]))
                elif m and classes:
                    out[pos] = classes[-1][1]
            for c in line:
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
        pos += len(line) + 1
    return out


def signature(s: str) -> str:
    """Normalised parameter list: types or names without blanks, defaults and modifiers, so that overloads can be told apart."""
    inner = re.sub(r"\s+", " ", s.strip()[1:-1] if s.startswith("(") else s)
    parts = [re.sub(r"=.*$", "", p).strip() for p in re.split(r",(?![^<(\[]*[>)\]])", inner)]
    parts = [re.sub(r"^(?:final|const|readonly|private|public|protected|val|var)\s+", "", p) for p in parts if p and p not in ("self", "cls", "void", "this")]
    return ",".join(re.sub(r"\s+", " ", re.sub(r"@\w+(?:\([^()]*\))?\s*", "", p)) for p in parts)


def comment_above(text: str, code: str, spans: list[tuple[str, int, int]], start: int, ends: dict[int, int]) -> str | None:
    """The comment that ends on the line before ``start``, over annotation lines; None if there is none.

    ``ends`` maps the line start after a comment that fills its lines to the index of its span.
    """
    while True:
        i = ends.get(start)
        if i is not None:
            break
        if start == 0:
            return None
        above = code.rfind("\n", 0, start - 1) + 1
        line = code[above : start - 1]
        if ANNOTATION_LINE.match(line):
            start = above
        elif line.rstrip().endswith((")", "]")) and not ANNOTATION_LINE.match(line):
            # The last line of an annotation over several lines.
            # It holds no semicolon.
            m = re.search(r"(?:^|\n)([ \t]*(?:@[\w.:]+\(|#\[)(?:[^;{}]|\{[^{}]*\})*)\Z", code[code.rfind(";", 0, start - 1) + 1 : start - 1])
            if not m or m[1].count("(") != m[1].count(")"):
                return None
            start = start - 1 - len(m[1])
        else:
            return None
    kind, a, b = spans[i]
    out = [text[a:b]]
    if kind == "l":
        first = text.rfind("\n", 0, a) + 1
        while (j := ends.get(first)) is not None and spans[j][0] == "l" and first > 0:
            out.append(text[spans[j][1] : spans[j][2]])
            first = text.rfind("\n", 0, spans[j][1]) + 1
    return "\n".join(reversed(out))


CONTINUED = re.compile(r"(?:[-+*/%=<>&|^?:,.!~]|\b(?:return|in|of|instanceof|typeof|new|await|else|as|is))$")
CONTINUES = re.compile(r"\s*(?:[.?:+*/%=<>&|^,)\]}]|-(?!-)|(?:in|instanceof|as|is|else)\b)")


def _expression_end(lang: str, code: str, at: int) -> int:
    """End of the expression from ``at`` on: a separator outside of brackets, or a line end where neither line runs on."""
    depth = 0
    for m in re.compile(r"[()\[\]{};,\n]").finditer(code, at):
        t, p = m[0], m.start()
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
            if depth < 0:
                return p
        elif depth == 0 and t in ";,":
            return p
        elif depth == 0 and t == "\n" and lang != "php":
            line = code[max(at, code.rfind("\n", at, p) + 1) : p].rstrip()
            if line.strip() and not CONTINUED.search(line) and not CONTINUES.match(code, p):
                return p
    return len(code)


def _block_end(code: str, at: int, indent: int) -> int:
    """End of the Python block whose header ends at ``at`` and stands at ``indent``."""
    end = pos = at
    depth = 0
    while pos < len(code):
        nl = code.find("\n", pos)
        line = code[pos : nl if nl >= 0 else len(code)]
        if line.strip():
            wide = line.expandtabs()
            if pos > at and depth <= 0 and len(wide) - len(wide.lstrip()) <= indent:
                break
            depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
            end = pos + len(line.rstrip())
        pos += len(line) + 1
    return end


def _definition_end(lang: str, code: str, follows: str, at: int, end: int, indent: int, braces: Braces | None) -> int:
    """End of a definition whose declaration ends at ``end`` with ``follows`` at ``at``."""
    if lang == "py":
        return _block_end(code, end, indent)
    if follows in ("=", "=>"):
        start = re.compile(r"\s*").match(code, end).end()
        if follows == "=>" and code[start : start + 1] == "{":
            follows, at = "{", start
        else:
            return start + len(code[start : _expression_end(lang, code, start)].rstrip())
    return braces.ends.get(at, len(code) - 1) + 1 if follows == "{" and braces else end


def extract(lang: str, text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Functions of a file: owner, name, signature, whether they have a body, documentation text (or None), offsets of the whole definition."""
    if lang not in DECLARATIONS:
        return []
    code = masked(text, spans)
    ends: dict[int, int] = {}
    strings: dict[int, tuple[int, int]] = {}
    for i, (kind, a, b) in enumerate(spans):
        if kind in "lb":
            line = text.rfind("\n", 0, a) + 1
            if not text[line:a].strip() or kind == "b" and not code[line:a].strip():
                nl = text.find("\n", b)
                if nl >= 0 and not text[b:nl].strip():
                    ends[nl + 1] = i
        elif kind in "st":
            strings[a] = (a, b)
    owners: dict[int, str] = {}
    levels: dict[int, str] = {}
    braces: Braces | None = None
    if lang == "py":
        levels = _python_owners(code)
    else:
        braces = Braces(code)
        if lang in TYPES:
            owners = {m.end() - 1: m[1] for m in TYPES[lang].finditer(code)}
    flat = _flat(code)
    out, seen = [], set()
    for k, pattern in enumerate(DECLARATIONS[lang]):
        if k >= 2 and not owners:  # methods and fields stand in classes only
            break
        for m in pattern.finditer(flat):
            name = m["n"].strip("`#")
            if name in NOT_NAMES or m.start("n") in seen:
                continue
            g = m.groupdict()
            follows = m["b"] if m["b"] is not None else g.get("b2") or ""
            at = code.rfind("\n", 0, m.start("n")) + 1
            start = m.start() if code[m.start() : m.start() + 1] != "\n" else at
            owner = ""
            if lang == "py":
                indent = len(m["i"].expandtabs())
                owner = levels.get(m.start(), "")
            elif lang == "go":
                owner = g.get("o") or ""
            else:
                within = around = braces.around(m.start("n"))
                while within is not None and within not in owners:
                    within = braces.outer[within]
                if within is not None:
                    owner = owners[within]
                # A method, or a field that holds a function, stands directly in the body of its class.
                if k >= 2 and lang in ("js", "ts") and (within is None or within != around) or lang == "java" and within is None:
                    continue
            seen.add(m.start("n"))
            body = follows in ("{", "=", "=>") or lang == "py"
            doc = comment_above(text, code, spans, start, ends)
            docs = [prose.comment_text(doc)] if doc else []
            if lang == "py":
                after = re.compile(r"\s*(?:[rRuU]?)(?=\")").match(code, m.end())
                if after and after.end() in strings:
                    a, b = strings[after.end()]
                    docs.insert(0, prose.comment_text(re.sub(r"^(?:\"\"\"|'''|[\"'])|(?:\"\"\"|'''|[\"'])$", "", text[a:b])))
            useful = [d for d in docs if not prose.is_trivial(d, name)]
            at_follows = m.start("b") if m["b"] is not None else m.start("b2")
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            last = _definition_end(lang, code, follows, at_follows, m.end(), indent if lang == "py" else 0, braces)
            out.append({"from": first, "to": last, "owner": owner, "name": name, "signature": signature(code[slice(*m.span("s" if g["s"] else "s2"))] if g["s"] or g.get("s2") else ""), "body": body, "doc": useful[0] if useful else None})
    return out
