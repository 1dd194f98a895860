"""Local grammars over token classes.

The skeleton of a file (:func:`siltstone.llm.lexing.skeleton`) is mapped to a
string of token classes, one letter each: ``n`` a name, ``0`` a number, ``"`` a
literal, a letter for each group of keywords, operators as they are. Balanced
brackets are reduced to one letter (``p`` round, ``q`` square, ``b`` curly)
after their content was held against the grammar of the language. What cannot
be reduced is the bracket summary of a chunk (:func:`note`); summaries of
neighbouring chunks join by concatenation and further reduction (:func:`join`),
which is associative. Grammars are local: each looks at one balanced list of
statements.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from functools import lru_cache

from . import lexing

WORDS = {
    "js": {"d": "let var", "k": "const", "F": "function", "C": "class", "R": "return throw", "I": "if while for switch catch with", "E": "else do try finally", "u": "new typeof void delete await yield", "o": "in instanceof of extends", "M": "import", "X": "export", "c": "case", "D": "default", "B": "break continue debugger", "m": "async get set static", "f": "from", "a": "as"},
    "java": {"P": "package", "M": "import", "C": "class interface enum @interface record", "m": "public private protected static final abstract native transient volatile strictfp sealed default synchronized", "R": "return throw assert", "I": "if while for switch catch", "E": "else do try finally", "u": "new", "c": "case", "B": "break continue yield", "o": "extends implements throws instanceof permits", "Z": "const goto"},
    "kt": {"P": "package", "M": "import", "C": "class interface object", "F": "fun constructor", "d": "val var typealias", "a": "get set", "m": "suspend private public protected internal data enum sealed abstract open override inline const companion lateinit operator infix tailrec vararg annotation final noinline crossinline reified expect actual external value", "R": "return throw", "I": "if while for when catch", "E": "else do try finally", "o": "is in as by", "B": "break continue"},
    "go": {"P": "package", "M": "import", "F": "func", "T": "type", "U": "struct interface", "d": "var const", "R": "return", "I": "if switch select", "L": "for", "E": "else", "c": "case", "D": "default", "r": "range", "y": "map chan", "g": "go defer", "B": "break continue goto fallthrough"},
    "php": {"N": "namespace use", "C": "class interface trait enum", "F": "function fn", "m": "public private protected static final abstract readonly var", "d": "const", "R": "return throw echo print yield include require include_once require_once", "I": "if while for foreach switch catch match elseif declare", "E": "else do try finally", "u": "new clone", "c": "case", "D": "default", "o": "extends implements instanceof as insteadof and or xor", "B": "break continue global goto"},
    "c": {"t": "int long short char float double void unsigned signed _Bool size_t", "v": "const static extern register volatile inline restrict auto typedef", "U": "struct union enum", "R": "return", "I": "if while for switch", "E": "else do", "c": "case", "D": "default", "B": "break continue goto", "u": "sizeof"},
    "graphql": {"K": "type input interface", "T": "enum union scalar schema directive extend", "Q": "query mutation subscription fragment", "o": "implements on"},
    "py": {}, "json": {}, "yaml": {},
}
WORDS["ts"] = WORDS["js"] | {"m": "async get set static public private protected readonly abstract override declare accessor", "o": "in instanceof of extends implements is keyof infer satisfies asserts", "T": "type interface namespace enum module global"}
TABLES = {lang: {w: c for c, ws in groups.items() for w in ws.split()} for lang, groups in WORDS.items()}
WORD = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$]*|\d(?:[\w.]|(?<=[eE])[+-])*")
PHP_WORD = re.compile(r"\\?[A-Za-z_$\u0080-\uffff][\w$]*(?:\\[A-Za-z_]\w*)*|\d(?:[\w.]|(?<=[eE])[+-])*")
#: Languages that are judged without bracket summaries; settings of the kind ``ini`` are all taken as valid.
UNBRACKETED = ("py", "json", "yaml", "ini")
#: Languages in which the end of a line may end a statement.
LINED = {"js", "ts", "kt", "go", "graphql"}
CONFLICT = re.compile(r"<{4}|\|{3}|>{7}|={4}")


def classes(lang: str, code: str) -> str:
    """Token classes of a skeleton."""
    get = TABLES[lang].get
    s = (PHP_WORD if lang == "php" else WORD).sub(lambda m: get(w := m[0]) or ("0" if w[0] <= "9" else "n"), code)
    if lang in LINED:
        return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v\ufeff]+", "", s))
    return re.sub(r"[\s\ufeff]+", "", s)


BRACKET = re.compile(r"([()\[\]{}])")
PAIR = {"(": ")", "[": "]", "{": "}"}
#: Stands for a group that breaks the grammar.
BROKEN = "\x00"
LETTER = {"(": "p", "[": "q", "{": "b"}
#: Groups up to this length are remembered, at most ``KEPT`` of them.
SHORT, KEPT = 200, 1 << 15


def _group(lang: str, kind: str, inside: str) -> str:
    """The letter of a balanced group, or ``BROKEN`` if its content breaks the grammar."""
    return _short_group(lang, kind, inside) if len(inside) <= SHORT else _short_group.__wrapped__(lang, kind, inside)


@lru_cache(maxsize=KEPT)
def _short_group(lang: str, kind: str, inside: str) -> str:
    return BROKEN if _broken(lang, kind, inside) else "e" if kind == "{" and _elements(lang, inside) else LETTER[kind]


def _elements(lang: str, s: str) -> bool:
    """Whether the content of curly brackets can only be elements (of an array, an enum), no statements or fields."""
    if lang == "graphql":
        return bool(re.fullmatch(r"[\nnTKQo@p,]+", s))
    if lang == "php":
        return s != "" and not re.search("[;bC]|=>|^\"", s)
    return lang in ("java", "c") and s != "" and not re.search("[;bC]|->", s)


def summary(lang: str, s: str) -> str:
    """Reduce all balanced groups in one pass. A text whose grammar is broken gives ``BROKEN``."""
    if BROKEN in s:
        return BROKEN
    frames: list[list[str]] = [[]]
    for i, part in enumerate(BRACKET.split(s)):
        if i % 2 == 0:
            if part:
                frames[-1].append(part)
        elif part in PAIR:
            frames.append([part])
        elif len(frames) == 1:
            frames[0].append(part)
        else:
            opened, *inside = frames.pop()
            letter = _group(lang, opened, "".join(inside)) if PAIR[opened] == part else BROKEN
            if letter == BROKEN:
                return BROKEN
            frames[-1].append(letter)
    return "".join(x for f in frames for x in f)


def note(lang: str, text: str, piece: lexing.Piece, last: bool) -> str:
    """The bracket summary of a chunk; nothing for the languages that have none."""
    if lang in UNBRACKETED:
        return ""
    return summary(lang, classes(lang, lexing.skeleton(text, piece.run.spans, piece.at, piece.end, piece.start not in ("C", lexing.start_of(lang)) or piece.start == "H" and piece.at > 0)))


def join(lang: str, notes: list[str]) -> str:
    """The summary of neighbouring chunks out of theirs."""
    while len(notes) > 1:
        notes = [summary(lang, "".join(notes[i : i + 8])) for i in range(0, len(notes), 8)]
    s = notes[0] if notes else ""
    return re.sub(r"\n+", "\n", s) if lang in LINED else s


LITERALS = re.compile(r'[0"][n0"]|n"|n0')
#: Keywords that stand as names: after a dot, before the colon of a key.
AS_NAME = re.compile(r"(?<=[.#])[A-Zacdfkmou]|(?:(?<=[,;\n])|^)[A-Zadfkmou](?=\??:)")
JS_JOIN = re.compile(r"(?<=[=+*/%&|^?:,.(!~<-])\n|\n(?=[.?:&|+*/,=)]|=>|o)")
JS_VALUE = re.compile(r"(?<=[=(,:?&|+!])b|(?<=[Ru])b|(?<==>)b")
JS_STATEMENT = re.compile(r'R[=*/%&|^?.,>]|[n0"q][n0"]|p[n0"]|"p|[n0"]b|[=*/%&|^<,~?:.]$|(?:^|[^+])\+$|(?:^|[^-])-$|^[kdFCuo]$|^kn$|#(?!n)|[`\\]|^[=*/%&|^<>?,]|^\.(?!\.\.)')
JS_EXPRESSION = re.compile(r'[n0"q][n0"]|p[n0"]|"p|[=*/%&|^~]$|[`\\]')
JS_IMPORT = re.compile(r'M(?:"|(?:n|b|\*an)(?:,(?:b|\*an))?f")(?:nb)?')
TS_IMPORT = re.compile(r'M(?:"|[nT]?(?:[nTfm]|b|\*an)(?:,(?:b|\*an))?f"|[nT]?n=.+)(?:nb)?')
JS_EXPORT = re.compile(r'X(?:\*(?:an)?f"|b(?:f")?|D.+|[kdCYZm].+|[YZ])(?:nb)?')
TS_EXPORT = re.compile(r'X(?:T?\*(?:an)?f"|T?b(?:f")?|D.+|[kdCYZmT=].+|[YZ]|an)(?:nb)?')
TYPE = r"(?::[^;\n={}]*?(?:b[^;\n={}]*?)?)?"
FUNCTIONS = {"js": re.compile(r"m?F\*?[nm]?pb"), "ts": re.compile(rf"m?F\*?[nm]?(?:<[^;\n]*?>)?p{TYPE}(?:b|(?=[;\n]|$))")}
NAMELESS = re.compile(r"(?:^|(?<=[;\n]))m?F\*?pb")
CLASSES = {"js": re.compile(r"C[n]?(?:o[n.]+p?)?b"), "ts": re.compile(r"C[n]?(?:<[^;\n]*?>)?(?:o[n.,]+(?:<[^;\n]*?>)?p?)*b")}
SIGNATURES = re.compile(rf'(?:^|(?<=[;\n,b]))m+n\??(?:<[^;\n]*?>)?p{TYPE}(?=[;\n]|$)')
GENERIC_ARROW = re.compile(r"(?<=[=(,:?])<[^=;()\n]*>(?=p)")
METHODS = {"js": re.compile(r'(?:^|(?<=[;\n,b]))m*\*?(?:n|#n|"|0|q)pb'), "ts": re.compile(rf'(?:^|(?<=[;\n,b]))m*\*?(?:n|#n|"|0|q)\??(?:<[^;\n]*?>)?p{TYPE}b')}


def _js(lang: str, kind: str, s: str) -> bool:
    """JavaScript and TypeScript: values don't follow each other, operators don't stand alone, imports and exports are whole."""
    s = AS_NAME.sub("n", s)
    if lang == "ts":
        s = GENERIC_ARROW.sub("", re.sub(r"@n(?:\.n)*p?\n?", "", s))
    if ":=" in s or "@" in s or lang == "js" and kind == "(" and re.search(r"(?:^|,)[nbq]\??:", s.replace("\n", "")):
        return True
    if kind != "{":
        s = re.sub(r"[dk\n]|m(?=[npbqF])|(?<=[^n])m(?==)", "", s)
        s = CLASSES[lang].sub("n", FUNCTIONS[lang].sub("n", s))
        return any(bool(JS_EXPRESSION.search(re.sub(r"[oaTm]", "+", re.sub(r"[fm](?=[,:)=.?]|$)", "n", t)))) for t in re.split("[,;]", s) if t)
    s = JS_JOIN.sub("", s)
    if NAMELESS.search(s):
        return True
    s = CLASSES[lang].sub("Z", FUNCTIONS[lang].sub("Y", s))
    if lang == "ts":
        s = SIGNATURES.sub(";", s)
    s = METHODS[lang].sub(";", s)
    s = JS_VALUE.sub("n", s)
    s = re.sub(r"(?<=[=(,:?&|+!Ru])[YZ]", "n", s)
    return any(_js_statement(lang, t) for t in re.split(r"[;\n]|,(?![^;\n]*f\")", s) if t)


@lru_cache(maxsize=1 << 16)
def _js_statement(lang: str, t: str) -> bool:
    ts = lang == "ts"
    if t[0] == "M" and t[1:2] not in ("p", "."):
        return not (TS_IMPORT if ts else JS_IMPORT).fullmatch(t)
    if t[0] == "X":
        if not (TS_EXPORT if ts else JS_EXPORT).fullmatch(t):
            return True
        if re.match(r"XT?[*b]", t):
            return False
        t = re.sub(r"^X[D=]?", "", t)
    while True:
        u = re.sub(r"^(?:Ip|IuP?p|E|[YZb]|c[^:]*:|D:|m(?=[mnkdCYZbpq*#\"0T]))", "", t)
        if u == t:
            break
        t = u
    if not t or t == "b":
        return False
    if ts:
        if re.match(r"T[nm](?:\.n)+b", t):
            t = re.sub(r"^T[nm](?:\.n)+b", "", t)
        elif re.match(r"T[nm]", t):
            t = re.sub(r"^T[nm](?:<[^=]*?>)?(?:o[n.]+(?:<.*?>)?)*b|^T[nm](?:<[^=]*?>)?(?==)", "n", t)
        elif re.match(r'T"b', t):
            t = t[3:]
        t = re.sub(r"(?<=[n>pqb])!(?=[.;,)=:]|$)", "", t)
        t = re.sub(r"(?<=:)[^=]*(?==(?!>)|$)", "n", t) if re.match(r"[kd]?(?:n|#n|\")[?!]?:", t) else t
    t = re.sub(r"(?<=[,:=(<|&?R+])[mTf](?![Fnpmu*])|^[mfT](?=[=:;,.?!+(]|$)|^[f](?=p)", "n", t)
    t = re.sub(r"[oa](?=[nbqpu\"0YZr!~+-])", "+", t)
    t = t.replace("u", "").replace("f", "n").replace("T", "n")
    return bool(JS_STATEMENT.search(t))


ANNOTATIONS = re.compile(r"@(?:n:)?n(?:\.n)*p?\n?")
VALUE = re.compile(r"(?<=[=(,?q])b|(?<=->)b|(?<=u)b")


def _java(kind: str, s: str) -> bool:
    """Java: statements end with a semicolon or a block, fields and methods have a type."""
    if re.search(r"[#\\`$Z]", s):
        return True
    s = ANNOTATIONS.sub("", s.replace("@C", "C"))
    if "@" in s:
        return True
    if re.search(r"pe|Ee|->e", s):
        return True
    s = VALUE.sub("n", s.replace("e", "b"))
    if kind != "{":
        return bool(re.search(r'[0"][n0"]|[=*/%&|^,]$|(?:^|[^+])\+$|nnn', re.sub(r"<[^;()]*?>", "", s.replace("m", "").replace("o", "&"))))
    if re.search(r'[n0"pq](?:[RPM]|I(?!p[^b]*->)|B)(?!:)', re.sub(r"(?:Ip|E|uI)+", "", s)):
        return True
    s = re.sub(r"(?:^|(?<=[;b]))c[^;:b]*?->", ";", s)
    *_, tail = parts = re.split("[;b]", s)
    if tail and (";" in s or re.search(r"nn|[RBEP]|^I|m[nC]", tail)) or re.search(r"I(?!p)|=(?:;|$)", s):
        return True
    return any(_java_statement(t) for t in parts if t)


@lru_cache(maxsize=1 << 16)
def _java_statement(t: str) -> bool:
    t = re.sub(r"^(?:c[^:>]*(?::|->)|m(?::|->)|n:(?!:)|Ip|E|m)+", "", t)
    t = re.sub(r"<[^;=()]*?>", "", re.sub(r"u", "", t.replace("o", "&") if not t.startswith("C") else ""))
    return bool(re.search(r'[0"][n0"]|"p|[.=*/%&|^]$|nnn|n"|n0|:n=', t))


def _kt(kind: str, s: str) -> bool:
    """Kotlin: declarations begin with their keyword, so that a type is never followed by a name."""
    if re.search(r"[#\\$]", s):
        return True
    s = re.sub(r"(?<=[.?:])[a-zA-Z](?=[.(p<])", "n", ANNOTATIONS.sub("", s)).replace("a", "n")
    for t in re.split(r"[;\n]", s):
        t = re.sub(r"<[^=;()]*?>", "", t)
        if kind == "{" and re.search(r'^m+nn|^m*n\??q?np(?:b|$)|Rnnp|nnn=|^(?:m|C|F|d)$|^m*d(?:[=:]|$)|[=:,]$|^n"|^n0', t) or re.search(r'Rnnp|[0"][0"]', t):
            return True
    return False


def _go(kind: str, s: str) -> bool:
    """Go: a type stands after its name; statements end with their line."""
    if re.search(r"[#@\\?$`]|=>|===", s):
        return True
    if kind == "{":
        for t in re.split(r"[;\n]", re.sub(r"(?<=[=+*/%&|^,.(<-])\n", "", s)):
            if re.search(r'nn.*:=|:=:?=|^d=|[0"][n0"]|[=/%&|^]$|^[IL]$', t):
                return True
        if any(h.count(";") == 1 for h in re.findall(r"(?:^|(?<=[\n;]))L([^b\n]*)b", s)):
            return True
    return False


def _php(kind: str, s: str) -> bool:
    """PHP: statements end with a semicolon or a block."""
    if re.search("pe|Ee", s := s.replace("Ipe", "Ipb") if "=>" in s else s):
        return True
    s = VALUE.sub("n", s.replace("e", "b").replace("#q", "").replace("\\b", ""))
    if "#" in s or "`" in s:
        return True
    s = re.sub(r"(?<=[=(,>R.?:])Ipb", "n", re.sub(r"F&?p(?::\??[n|]+)?=>", "", s))
    s = re.sub(r"F&?p(?:np)?(?::\??[n|]+)?b", "n", s) if kind == "{" else s
    if kind != "{":
        return bool(re.search(r'[0"][n0"]|"p|[=*/%|^.+-]$', s.replace("o", "+")))
    if re.search(r'[n0"pq](?:[RIBN]|[Cm](?=[mnF]))', re.sub(r"(?:Ip:?|E|c[^:;]*:|D:|=I)+", "", s)):
        return True
    return any(re.search(r'[0"][n0"]|n"|n0|"p|[.=*/%|^]$|nnn', re.sub(r"^(?:Ip|E|m|R|c[^:]*:|D:)+", "", t).replace("o", "+").replace("u", "")) for t in re.split("[;b]", s) if t)


def _c(kind: str, s: str) -> bool:
    """C: statements end with a semicolon or a block; at most one name of a type before a declared name."""
    if re.search(r"[@`$\\]", s):
        return True
    if re.search(r"[nI]pe|Ee|tn[n]|R(?=[=;]|$)[=]", s):
        return True
    s = VALUE.sub("n", re.sub(r"Un?b", "t", s.replace("e", "b").replace("v", "t")))
    if kind != "{":
        return bool(re.search(r'[0"][n0]|[=/%|^.]$|nnn', s))
    if re.search(r'[n0"pq](?:[RIB]|t(?=[tn*]))', re.sub(r"(?:Ip|E|c[^:]*:|D:|Un|t\**)+", "", s)):
        return True
    *_, tail = parts = re.split("[;b]", s)
    if tail and (";" in s or re.search(r"nn|[RBE]|^I|tn", tail)) or re.search(r"I(?!p)|=(?:;|$)", s):
        return True
    for t in parts:
        t = re.sub(r"^(?:Ip|E|c[^:]*:|D:|R|u)+|Un", "", re.sub(r"t+\**", "", t))
        if t and re.search(r'[0"][n0]|n["0]|"p|0p|[=/%|^.]$|(?:^|[^+])\+$|nnn|=[^;]*nn', t):
            return True
    return False


def _graphql(kind: str, s: str) -> bool:
    if kind == "{":
        return any(re.search(r":$|::|[=#]$|!!", t) for t in re.sub(r'"\n?', "", s).split("\n") if t)
    return False


LOCAL = {"java": _java, "kt": _kt, "go": _go, "php": _php, "c": _c, "graphql": _graphql}


def _broken(lang: str, kind: str, s: str) -> bool:
    """Whether the content of a balanced group of brackets breaks the grammar; ``kind`` is its opening bracket."""
    if lang in UNBRACKETED:
        return False
    if CONFLICT.search(s):
        return True
    return _js(lang, kind, s) if lang in ("js", "ts") else LOCAL[lang](kind, s)


JAVA_TOP = re.compile(r"(?:P[nm](?:\.[A-Za-z])*;|Mm?[nm](?:\.[A-Za-z])*(?:\.\*)?;|;|[mn!-]*C[n](?:<[^;b]*?>)?p?(?:o[^;b]*)?b)*\Z")
KT_TOP = re.compile(r"m*a(?:p(?::[^=]*)?(?:=.*|b))?|P[nm](?:\.n)*|M[nm](?:\.n)*(?:\.\*)?(?:on)?|m*(?:C|F|d).+|b|E.*|[.?=:].*|.*[=:]")
GO_TOP = re.compile(r'M(?:"|p|n"|\.")|Fp?n(?:q|<.*>)?p.*|T(?:p|n.+)|d(?:p|n.*)', re.S)
PHP_TOP = re.compile(
    r"(?:;|Nm?F?d?n(?:b|(?:on)?(?:,n)*;|b;)|m*C\??n(?::\??n)?(?:on(?:,n)*)*b|m*F&?n?p(?::\??[n|&]+)?b|(?:Ip|E)+b|I?[^;bCNI]*(?:b[^;bCNI]*)*;)*\Z"
)
C_TOP = re.compile(r"(?:;|[^;b=\".:]*p(?:np)?b|t*Un?b?[^;b]*;|t*Un?b[^;b]*(?:=[^;]*)?;|[^;b=\".:]*(?:=[^;]*)?;)*\Z")
GRAPHQL_TOP = re.compile(r"[TK]+[nTKQo].*|T+(?:@.*|b)|Q.*|b|[=|&@:!,].*|[qp].*|n(?:[|&].*)?(?=$)")


def top_broken(lang: str, s: str) -> bool:
    """Whether the summary of a whole file breaks the grammar of its language."""
    if re.search(r"[()\[\]{}]", s) or s == BROKEN or CONFLICT.search(s):
        return True
    if lang in UNBRACKETED or not s.strip("\n;"):
        return False
    if lang in ("js", "ts"):
        return _js(lang, "{", s.partition("\n")[2] if s.startswith("#!") else s)
    if lang == "java":
        t = ANNOTATIONS.sub("", s.replace("@C", "C").replace("e", "b"))
        return "@" in t or "Z" in t or not JAVA_TOP.match(t)
    if lang == "kt":
        t = re.sub(r"(?<=F)a|a(?![p\n;])", "n", ANNOTATIONS.sub("", re.sub(r"(?<=[.?])[A-Za-z]", "n", s)))
        return "@" in t or any(not KT_TOP.fullmatch(x) or re.search(r"^m*d[=:]|^m*[CFd]$|[=:,.]$|^m*F[n.]+$|^m*dn$", x) for x in re.split(r"[;\n]", re.sub(r"(?<=[=:,.])\n", "", t)) if x)
    if lang == "go":
        parts = [x for x in re.split(r"[;\n]", re.sub(r"(?<=[=+*/%&|^,.])\n", "", s)) if x]
        return parts[0] != "Pn" or any(not GO_TOP.fullmatch(x) or re.search(r"^Tn$|^d(?:n$|=)|[=,.:]$|[#@?$]", x) for x in parts[1:])
    if lang == "php":
        if re.search("pe|Ee", s):
            return True
        s = s.replace("e", "b").replace("#q", "").replace("\\b", "")
        s = re.sub(r"(?<=[=(,>R.?:])Ipb", "n", re.sub(r"F&?p(?::\??[n|]+)?=>", "", s))
        return not PHP_TOP.match(s) or _php("{", s)
    if lang == "c":
        if re.search(r"[nI]pe|tnn|=;", s):
            return True
        s = s.replace("e", "b").replace("v", "t")
        return bool(re.search(r"[@`$\\#]|nnn|=[^;]*nn", s)) or not C_TOP.match(s)
    s = re.sub(r'(?:^|(?<=[\nbe]))"\n?', "", s)
    if re.search(r"(?:^|(?<=[\nbe]))T*K[^\ne]*e", s):
        return True
    s = s.replace("e", "b")
    return any(x and (not GRAPHQL_TOP.fullmatch(x) or re.search(r"[=|@:&]$|^[TK]+$", x)) for x in re.split(r"\n|(?<=b)", s))


YAML_KEY = re.compile(r"(?:\"|[^\s\[\]{},#&*!|>'\"%@`?:-](?:[^:#]|:(?=\S)|(?<=\S)#)*?|[?:-](?=\S)(?:[^:#]|:(?=\S))*?|<<|[&!*][^\s:]+[ ]+(?:\"|[^:#\s][^:#]*?))\s*:(?:\s+|$)")


def _yaml_broken(code: str) -> bool:
    """Block structure line by line: keys, entries, plain text that runs on, block scalars."""
    levels: list[tuple[int, str]] = []  # indent and kind (m mapping, s sequence) of the open collections
    scalar = plain = -1  # indent of an open block scalar's or plain scalar's parent
    flow = 0
    seen = ""  # what stood before: a key (k), a key with its value (v), something else (x)
    for raw in code.split("\n"):
        line = raw.rstrip()
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if scalar >= 0:
            if not body or indent > scalar:
                continue
            scalar = -1
        if not body or body[0] == "%":
            continue
        if body in ("---", "...") or body.startswith("--- "):
            levels, plain, seen = [], -1, ""
            continue
        if flow:
            flow += len(re.findall(r"[\[{]", body)) - len(re.findall(r"[\]}]", body))
            continue
        if body[0] == "\t":
            return True
        if re.match(r"[?:](?:\s|$)", body):
            seen = "x"
            continue
        while m := re.match(r"-(?:\s+|$)", body):
            levels = [x for x in levels if x[0] <= indent]
            if not levels or levels[-1][0] < indent or levels[-1][1] == "m" and seen != "":
                if levels and levels[-1][0] == indent and seen == "v":
                    return True
                levels.append((indent, "s"))
            indent += m.end()
            body, plain, seen = body[m.end() :], indent - 1, "x"
        if not body:
            continue
        key = YAML_KEY.match(body)
        if key:
            while levels and (levels[-1][0] > indent or levels[-1] == (indent, "s") and (indent, "m") in levels):
                levels.pop()
            if levels and levels[-1] == (indent, "s"):
                return True
            if not levels or levels[-1][0] < indent:
                if seen == "v" or not levels and seen:
                    return True
                levels.append((indent, "m"))
            value = re.sub(r"^(?:[&!][^\s]*\s*)+", "", body[key.end() :])
            seen = "v" if value else "k"
            plain = indent if value else -1
            if re.match(r"[|>][+-]?\d?[+-]?\s*$", value):
                scalar, seen = indent, "v"
            elif value[:1] in ("[", "{"):
                flow = len(re.findall(r"[\[{]", value)) - len(re.findall(r"[\]}]", value))
                if flow < 0:
                    return True
            elif re.search(r":\s|:$", value) or value[:1] in ("@", "`", "%") or value.startswith('"') and re.match(r'"\s*[^\s#,]', value):
                return True
            continue
        if body[:1] in ("[", "{"):
            flow = len(re.findall(r"[\[{]", body)) - len(re.findall(r"[\]}]", body))
            seen = "x"
            if flow < 0:
                return True
            continue
        if re.match(r"[|>][+-]?\d?[+-]?$", body):
            scalar, seen = max(0, indent - 1) if plain < 0 else plain, "v"
            continue
        if plain >= 0 and indent > (plain if levels else -1):
            continue  # plain text runs on, or is an entry's text
        if seen == "k" and levels and indent > levels[-1][0]:
            plain, seen = levels[-1][0], "v"  # the value of the key above
            continue
        if levels or body[:1] in ("@", "`", "}", "]", ","):
            return True
        seen = "x"
    return bool(flow)


def _json_broken(text: str) -> bool:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(text.removeprefix("\ufeff"), parse_constant=refuse)
    except (ValueError, RecursionError):
        return True
    return False


def exact_broken(lang: str, text: str) -> bool:
    """The exact check that follows the grammar where one is at hand: Python's own parser, strict JSON."""
    if lang == "json":
        return _json_broken(text)
    if lang == "py":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text.removeprefix("\ufeff"))
            except (SyntaxError, ValueError, MemoryError, RecursionError):
                return True
    return False


def broken(x: lexing.Lexed) -> bool:
    """Whether a whole file, with the bracket summaries of its chunks, breaks the grammar of its language."""
    if not x.text.strip():
        return False
    if x.end[0] not in "CHK" or any(k == "x" for k, _, _ in x.spans):
        return True
    if x.lang == "yaml":
        return _yaml_broken(lexing.skeleton(x.text, x.spans))
    return top_broken(x.lang, join(x.lang, x.notes)) or exact_broken(x.lang, x.text)
