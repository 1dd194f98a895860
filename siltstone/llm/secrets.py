"""Credentials in source code and provider settings (problem 4).

Settings files are read into key paths with the offsets of their values; code
is lexed, and literals, joined literals and comments are taken with the name
they stand under. A value is a credential if its shape says so (tokens of known
issuers, private keys, passwords in addresses), or if its key is sensitive and
the value is usable: no filler, mask, reference, field name or message.
Redactions are spliced into the original bytes at the values' offsets; nothing
else changes.

Nulls: rows without content, or without apiKey, have no credential and keep
their null. Empty texts have none. Repeated rows are each searched; an empty
table gives no rows. Lines end at line feeds.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexing
from .stages import lexed_files, run_batches

#: Shapes of tokens by their issuers, and of private keys. Fixed values.
STRONG = re.compile(
    r"(?<![A-Za-z0-9])(?:sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{18,}|A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w-]{30,}|xox[baprs]-[\w-]{10,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|(?<![_-])(?:SG\.[\w-]{16,}+\.[\w-]{16,}|eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}))"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?:.*?-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----)?", re.S)
ADDRESS = re.compile(r"(?<![\w+.-])[\w+.-]++://(?P<user>[^\s/:@\"'`<>]*+):(?P<v>[^\s/@\"'`]++)@[\w.\[$-]")
WORDS = r"(?:pass(?:word|wd|phrase|code)?|pwd|secrets?|token|api[_-]?key|apikey|access[_-]?(?:key|token)|auth[_-]?token|client[_-]?secret|private[_-]?key|credentials?)"
QUERY = re.compile(rf"[?&](?:\w*{WORDS}|key|sig(?:nature)?|auth)=(?P<v>[^&\s\"'#`]+)", re.I)
SETTING = re.compile(r"(?:^|[;\s?])(?:password|pwd|accountkey|sharedaccesskey)=(?P<v>[^;\s\"']+)", re.I)
PAIR = re.compile(rf"(?:{WORDS}|(?<![\w$])(?:key|authorization|pw))[\"'\\]*+\s*+[:=]\s*+[\"'\\]*+(?:(?:bearer|token|basic)\s+)?(?P<v>[^\s\"'\\,;)}}]+)", re.I)
SAID = re.compile(rf"\b{WORDS}\s+(?:is\s+)?(?P<v>(?=[^\s\"'`]*\d)(?=[^\s\"'`]*[A-Za-z])[^\s\"'`,;:()=]{{8,}})", re.I)
#: ``key ...: user / value`` in a comment.
TOLD = re.compile(rf"\b(?:{WORDS}|key|login)\b[^\n:=]{{0,40}}:\s*[\w.@-]+\s*/\s*(?P<v>(?=[^\s\"'`]*\d)(?=[^\s\"'`]*[A-Za-z])[^\s\"'`,;:()=/]{{8,}})", re.I)
HEADER = re.compile(r"^(?:Bearer|Token|Basic)\s+(?P<v>[A-Za-z0-9+/=._~-]{12,})$", re.I)
SENSITIVE = re.compile(rf"(?:^|[^a-z]){WORDS}(?:\d|$|[^a-z])|(?:^|_)(?:auth|authorization|auth_header|signing_key|sign_key|encryption_key|totp_seed|otp_seed|seed|pin|pw|key)$", re.I)
HARMLESS = re.compile(r"(?:field|hint|name|label|url|uri|len|length|min|max|count|type|param|column|policy|regex|pattern|help|message|msg|id|hash|digest|checksum|path|file|public|expir\w*|ttl|limit|prefix|header_name|endpoint|ref)$", re.I)
#: What stands for a credential without being one. Fixed values.
POINTER = re.compile(r"\$\{|\$\(|^\$\w|^%\w+%$|\{\{|^<.*>$|<[\w -]+>|process\.env|os\.environ|getenv|^(?:vault|env|file|secret|ssm|arn|op|kms|keyring|aws-sm|gcp-sm|azure-kv)[:/]", re.I)
FILLER = re.compile(
    r"^$|\*{3,}|x{4,}|\.{3}|…|^(.)\1*$|change.?me|your[_-]?|placeholder|example|dummy|redacted|not[_-]needed|masked|replace|insert|^(?:todo|tbd|none|null|nil|undefined|n/a|ollama|test|sample|secret|password|passwd|pass|token|true|false|default|empty|string|local|user|admin|root|changeit|foo|bar|bearer|basic|required|optional|invalid|missing|expired|hidden|set in pipeline|from vault)$",
    re.I,
)
WORD_VALUE = re.compile(r"^[A-Za-z]+(?:[_.-][A-Za-z]+)*$")
#: What every match of ``QUERY``, ``SETTING``, ``PAIR`` and ``SAID`` holds.
SIGN = re.compile(r"pass|pwd|secret|token|key|credential|auth|sig|pw", re.I)
NAMED = re.compile(r"(?:(?<![\w$.-])[\d.-]*+([A-Za-z_$][\w$.-]*+)[\"'\]]*\s*(?::\s*[\w<>\[\]?.| ]+)?\s*(?:=>|:=|===?|!==?|[:=])|[\[(,{]\s*([A-Za-z_]\w*)\s*=)\s*(?:new\s+\w+\(|\(|\w{1,2}(?=$)|@)?\s*$")
PUT = re.compile(r"(?:set\w*|put\w*|add\w*|define|append|header|env)\s*\(\s*[\"']([\w.$-]+)[\"']\s*,\s*$", re.I)
CALL = re.compile(r"(?:connect|login|log_in|sign_?in|authenticate|auth|set_?password|setBasicAuth|basic_?auth)\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[\w.]+)\s*,\s*$", re.I)
JOINED = re.compile(r"[\s+.&\\(),]*")
#: What stands in where a reference has no value.
DEFAULT = re.compile(r"(?:\|\||\?\?|:-|\bor\b|,)\s*[\"']?([^\s\"'}\])]+)")
SCHEME = re.compile(r"^(?:bearer|basic|token)\s+", re.I)
DIGIT = re.compile(r"\d")
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|(.))", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "\n": ""}


def unescape(s: str) -> str:
    """The text that a literal stands for."""
    if "\\" not in s:
        return s
    return ESCAPE.sub(lambda m: chr(int(h, 16)) if (h := m[1] or m[2] or m[3]) and int(h, 16) < 0x110000 else PLAIN.get(m[4] or "", m[4] or ""), s)


def decoded(v: str) -> str | None:
    """The text behind Base64 or hex, or None."""
    try:
        if len(v) >= 24 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v) and len(v) % 4 == 0:
            out = base64.b64decode(v, validate=True).decode("ascii")
        elif len(v) >= 40 and len(v) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", v):
            out = bytes.fromhex(v).decode("ascii")
        else:
            return None
    except (ValueError, binascii.Error):
        return None
    return out if out.isprintable() else None


def strong(v: str) -> bool:
    """Whether ``v`` holds a token of a known shape that is no filler."""
    m = STRONG.search(v)
    if m and not FILLER.search(m[0]) and len(set(m[0])) > 8:
        return True
    p = PEM.search(v)
    return bool(p and len(p[0]) > 100 and not re.search(r"\.{3}|<|\*{3}|xxxx", p[0]))


def usable(v: str, least: int = 6) -> bool:
    """Whether ``v`` could be used as a credential where a sensitive key says that it is one."""
    v = SCHEME.sub("", v.strip().strip("\"'` ").strip())
    default = DEFAULT.search(v)
    if POINTER.search(v):
        return bool(default and usable(default[1], 12))
    if FILLER.search(v) or len(v) < least:
        return False
    if strong(v):
        return True
    if re.search(r"\s", v) or re.match(r"(?:https?|data|sha\d+)[:-]", v) or re.search(r"[(){}<>]", v):
        return False
    words = SENSITIVE.search(v) or re.search(WORDS, v, re.I)
    if WORD_VALUE.match(v) and (words or "_" in v or len(v) < 10):
        return False
    return bool(re.search(r"\d", v) or re.search(r"[^\w.-]", v) and len(v) >= 8 or re.search(r"[a-z][A-Z]", v) and len(v) >= 10 and not words)


def sensitive(name: str) -> bool:
    """Whether a name or key says that its value is a credential."""
    flat = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_")
    last = flat.rpartition(".")[2]
    return bool(SENSITIVE.search(last)) and not HARMLESS.search(last)


Found = tuple[int, int, str]


def _behind_dollar(text: str, at: int) -> bool:
    """Whether the word around ``at`` is a variable of a shell."""
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return at > 0 and text[at - 1] == "$"


def _inside(text: str, base: int, said: bool) -> Iterator[Found]:
    """Credentials within a longer text: tokens, keys, addresses, pairs. Offsets are those of the raw text."""
    # Each test before a pattern is a part that all its matches hold.
    if len(text) >= 12:
        for m in STRONG.finditer(text):
            if strong(m[0]):
                yield base + m.start(), base + m.end(), "token"
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if strong(m[0]):
                yield base + m.start(), base + m.end(), "private_key"
    if "://" in text:
        for m in ADDRESS.finditer(text):
            if usable(m["v"], 4) and m["v"].lower() not in ("password", "pass"):
                yield base + m.start("v"), base + m.end("v"), "address"
    if not DIGIT.search(text) or not SIGN.search(text):
        return
    for p in (QUERY, SETTING, PAIR) if "=" in text else (PAIR,) if ":" in text else ():
        for m in p.finditer(text):
            if DIGIT.search(m["v"]) and usable(m["v"]) and not (p is PAIR and _behind_dollar(text, m.start())):
                yield base + m.start("v"), base + m.end("v"), "pair"
    for p in (SAID, TOLD) if said else ():
        for m in p.finditer(text):
            if usable(m["v"], 8):
                yield base + m.start("v"), base + m.end("v"), "said"


FLOW = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{},]|(?<=[\"']):|:(?=[\s,\[\]{}]|$)|\s#[^\n]*|(?:[^\s,\[\]{}:]|:(?![\s,\[\]{}]|$))+(?:[ \t]+(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$))(?:[^\s,\[\]{}:]|:(?![\s,\[\]{}]|$))*)*", re.S)


def _flow(text: str, at: int, names: str) -> tuple[list[tuple[str, int, int, str]], int]:
    """(key path, from, to, value) of the scalars of a YAML flow collection that opens at ``at``, and its end; no end gives no scalars."""
    out: list[tuple[str, int, int, str]] = []
    stack: list[tuple[str, bool]] = []  # path of each open collection, whether it is a mapping
    key, last = names, None  # the scalar that may turn out to be a key
    for m in FLOW.finditer(text, at):
        t = m[0]
        if t == ":":
            if last:
                key = f"{stack[-1][0]}.{last[3]}".lstrip(".")
                last = None
        elif t in "[{":
            stack.append((key, t == "{"))
        elif t in "]},":
            if last:
                out.append(last)
                last = None
            if t != ",":
                key = stack.pop()[0]
                if not stack:
                    return out, m.end()
            key = stack[-1][0]
        elif not t[0].isspace():
            quoted = t[0] in "\"'" and len(t) >= 2
            last = (key, m.start() + quoted, m.end() - quoted, t[1:-1] if quoted else t)
    return [], at


INI_LINE = re.compile(r"^[ \t]*(?:(?P<section>\[\[?[^\]\n]*\]\]?)|(?:export[ \t]+)?(?P<key>[\w.\"'-]+)[ \t]*[:=][ \t]*(?P<value>[^\s][^\n]*?)[ \t]*\r?$)", re.M)
#: An entry of a list, or a flow collection on a line of its own, without a key.
ITEM_LINE = re.compile(r"^([ ]*)((?:-[ ]+)+(?![&*!|>%@`#-])|(?=[\[{]))(\S.*)$")
PAIR_LINE = re.compile(r"^([ ]*)((?:-[ ]+)*)(?!-[ ])(\"[^\"\n]*\"|'[^'\n]*'|[^\s#:\"'{\[][^:\n]*?)[ ]*:(?:[ ]+|$)(.*)$")


def config_values(lang: str, text: str) -> Iterator[tuple[str, int, int, str]]:
    """(key path, from, to, value) of every scalar in a YAML or JSON text."""
    path: list[tuple[int, str]] = []
    if lang == "ini":
        section = ""
        for m in INI_LINE.finditer(text):
            if m["section"]:
                section = m["section"].strip("[] \"'") + "."
            elif m["key"] and m["value"]:
                a, b = m.span("value")
                if m["value"][0] in "\"'" and m["value"].find(m["value"][0], 1) > 0:
                    a, b = a + 1, a + m["value"].find(m["value"][0], 1)
                yield section + m["key"].strip("\"'"), a, b, text[a:b]
        return
    if lang == "yaml":
        pos = after = 0
        unclosed = False
        block: tuple[int, int, str] | None = None  # indent, start, path
        for line in text.split("\n"):
            if pos < after:  # within a flow collection over several lines
                pos += len(line) + 1
                continue
            raw, indent = line.rstrip("\r"), len(line) - len(line.lstrip(" "))
            if block and raw.strip() and indent <= block[0]:
                yield block[2], block[1], pos - 1, text[block[1] : pos - 1]
                block = None
            m = None if block else PAIR_LINE.match(raw)
            if m:
                level = len(m[1]) + len(m[2])
                while path and path[-1][0] >= level:
                    path.pop()
                path.append((level, m[3].strip("\"'")))
                names, value = ".".join(k for _, k in path), m[4].rstrip()
                a = pos + m.start(4)
            elif item := None if block else ITEM_LINE.match(raw):
                # An entry without a key stands under the key of its list.
                while path and path[-1][0] > len(item[1]):
                    path.pop()
                names, value = ".".join(k for _, k in path), item[3].rstrip()
                a = pos + item.start(3)
            else:
                value = ""
            if value:
                flow = _flow(text[:pos + len(line)] if unclosed else text, a, names) if value[0] in "[{" and not value.startswith("{{") else None
                unclosed = unclosed or flow is not None and flow[1] == a
                if flow is not None and flow[1] > a:
                    yield from flow[0]
                    after = flow[1]
                elif re.match(r"[|>][+-]?\d?\s*$", value):
                    block = (indent, pos + len(line) + 1, names)
                elif value[0] in "\"'":
                    end = value.find(value[0], 1)
                    yield names, a + 1, a + (end if end > 0 else len(value)), value[1 : end if end > 0 else None]
                else:
                    value = re.split(r"\s#", value)[0].rstrip()
                    yield names, a, a + len(value), value
            pos += len(line) + 1
        if block and block[1] < len(text):
            yield block[2], block[1], len(text), text[block[1] :]
        return
    stack: list[str] = []
    key = ""
    for m in re.finditer(r'"((?:[^"\\\n]|\\.)*)"(\s*:)?|[\[{]|[\]}]', text):
        if m[0] in "[{":
            stack.append(key)
        elif m[0] in "]}":
            if stack:
                stack.pop()
        elif m[2]:
            key = m[1]
        else:
            yield ".".join([*filter(None, stack), key]), m.start(1), m.end(1), unescape(m[1])


def _by_name(text: str, spans: list[tuple[str, int, int]], i: int) -> bool:
    """Whether the literal ``i`` stands under a sensitive name, or as the password of a call.

    The name stands in the same line, behind the literal before the last one.
    """
    at = spans[i][1]
    left = max(text.rfind("\n", spans[i - 1][2] if i else 0, at) + 1, spans[i - 2][2] if i > 1 else 0)
    before = re.sub(r"\b[fbrFBR]$", "", text[left:at].rpartition("\n")[2])
    name = NAMED.search(before)
    if name and sensitive(name[1] or name[2]):
        return True
    put = PUT.search(before)
    return bool(put and sensitive(put[1]) or CALL.search(before))


BRACKET = re.compile(r"[\];]")


class _Joins:
    """Whether the list that a literal stands in is joined to one string; known for all up to the same bracket."""

    def __init__(self, text: str) -> None:
        self.text, self.upto, self.joined = text, -1, False

    def at(self, pos: int) -> bool:
        if pos >= self.upto:
            m = BRACKET.search(self.text, pos)
            self.upto = m.start() if m else len(self.text)
            self.joined = bool(m and m[0] == "]" and re.compile(r"\]\s*\.\s*join\(").match(self.text, self.upto))
        return self.joined


def find(lang: str, text: str, spans: list[tuple[str, int, int]]) -> list[list[tuple[int, int, str]]]:
    """Credentials of a text in order, each as its pieces (from, to, kind)."""
    out: list[list[Found]] = []
    if lang in ("yaml", "json", "ini"):
        for names, a, b, value in config_values(lang, text):
            inner = list(_inside(text[a:b], a, False))
            plain = decoded(value)
            if sensitive(names) and "\n" not in value and usable(value) or plain and strong(plain):
                out.append([(a, b, "key")])
            else:
                out += [[x] for x in inner]
        out += [[x] for k, a, b in spans if k in "lb" for x in _inside(text[a:b], a, True)]
    else:
        i = 0
        joins = _Joins(text)
        while i < len(spans):
            kind, a, b = spans[i]
            if kind in "lbp":
                j = i + 1
                out += [[x] for x in _inside(text[a:b], a, kind != "p")]
                if kind == "p" and (m := re.match(r"#[ \t]*define[ \t]+(\w+)[ \t]+\"([^\"\n]*)\"", text[a:b])) and sensitive(m[1]) and usable(m[2]):
                    out.append([(a + m.start(2), a + m.end(2), "named")])
                i = j
                continue
            if kind not in "st":
                i += 1
                continue
            # Joined literals are one value.
            j = i + 1
            while j < len(spans) and spans[j][0] in "st" and (mid := text[spans[j - 1][2] : spans[j][1]]) is not None and JOINED.fullmatch(mid) and "(" not in mid and ")" not in mid and ("," not in mid or joins.at(spans[j][2])):
                if mid.strip() == "" and "\n" not in mid and lang not in ("c", "py"):
                    break
                j += 1
            pieces = []
            for _, p, q in spans[i:j]:
                quote = 3 if text[p : p + 3] in ('"""', "'''") and q - p >= 6 else 1
                p += len(re.match(r"[A-Za-z]*", text[p : p + 3])[0])
                pieces.append((p + quote, q - quote))
            raw = "".join(text[p:q] for p, q in pieces)
            if len(raw) >= 4:
                value = unescape(raw)
                plain = decoded(value)
                whole = usable(value, 6) and _by_name(text, spans, i) or plain and strong(plain) or (m := HEADER.match(value)) and usable(m["v"], 12) and re.search(r"\d", m["v"])
                if whole:
                    out.append([(p, q, "named") for p, q in pieces])
                elif j - i == 1 and value == raw:
                    out += [[x] for x in _inside(raw, pieces[0][0], False)]
                elif next(_inside(value, 0, False), None):
                    # Pieces or escapes hide the value's place: one literal is searched as it stands, more become one.
                    within = list(_inside(raw, pieces[0][0], False)) if j - i == 1 else []
                    if within:
                        out += [[x] for x in within]
                    else:
                        out.append([(p, q, "pieces") for p, q in pieces])
            i = j
    kept: list[list[Found]] = []
    for c in sorted(out, key=lambda c: (c[0][0], -c[-1][1])):
        if not kept or c[0][0] >= kept[-1][-1][1]:
            kept.append(c)
    return kept


MARK = "REDACTED"


def redact(text: str, found: list[list[Found]]) -> str:
    """``text`` with each credential replaced: its first piece by a mark, the others by nothing."""
    out, pos = [], 0
    for pieces in found:
        for i, (a, b, _) in enumerate(pieces):
            out += [text[pos:a], MARK if i == 0 else ""]
            pos = b
    return "".join(out) + text[pos:]


def _file(file_id: int, repo: str, x: lexing.Lexed) -> list[tuple]:
    out, pos, line, size = [], 0, 1, 0
    for c in find(x.lang, x.text, x.spans):
        a, b = c[0][0], c[-1][1]
        before = x.text[pos:a]
        line, size, pos = line + before.count("\n"), size + len(before.encode("utf-8", "replace")), a
        out.append((file_id, repo, line, size, size + len(x.text[a:b].encode("utf-8", "replace")), c[0][2]))
    return out


def _redacted(file_id: int, x: lexing.Lexed) -> list[tuple]:
    found = find(x.lang, x.text, x.spans)
    return [(file_id, redact(x.text, found), len(found))] if found else []


def find_in_files(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, line_no, from_byte, to_byte, kind) of every credential in the files."""
    return lexed_files(source_files, ["file_id", "repo"], _file, "file_id bigint, repo string, line_no int, from_byte bigint, to_byte bigint, kind string")


def redact_files(source_files: DataFrame) -> DataFrame:
    """(file_id, content, redactions) of every file of a known language in which a credential was replaced."""
    return lexed_files(source_files, ["file_id"], _redacted, "file_id bigint, content string, redactions int")


def key_usable(value: str | None) -> bool:
    """Whether an apiKey holds or contains a usable value."""
    if not value:
        return False
    v = value.strip().strip("\"'` \n").strip()
    return strong(v) or bool((p := decoded(v)) and usable(re.sub(r"^\w+:", "", p), 8)) or usable(v, 12) and bool(re.search(r"\d", v))


def key_place(value: str | None) -> tuple[int, int] | None:
    """Offsets of the credential within an apiKey, without quotes, references and scheme around it; None if there is none."""
    if not value or not key_usable(value):
        return None
    v = value.strip().strip("\"'` \n").strip()
    a = value.index(v)
    for p in (STRONG, PEM):
        if (m := p.search(v)) and strong(m[0]):
            return a + m.start(), a + m.end()
    if POINTER.search(v) and not decoded(v) and (m := DEFAULT.search(v)):
        return a + m.start(1), a + m.end(1)
    m = SCHEME.match(v)
    return a + (m.end() if m else 0), a + len(v)


def redact_key(value: str | None) -> str | None:
    """An apiKey with only its credential replaced."""
    place = key_place(value)
    return value[: place[0]] + MARK + value[place[1] :] if place else value


def find_in_configs(ai_configs: DataFrame) -> DataFrame:
    """(config_id, found, apiKey): whether the apiKey is usable, and the redacted apiKey."""
    work = lambda i, v: [(i, key_usable(v), redact_key(v))]
    return run_batches(ai_configs.select("config_id", "apiKey"), work, "config_id bigint, found boolean, apiKey string")


def redacted(source_files: DataFrame, ai_configs: DataFrame) -> DataFrame:
    """(record, record_id, content, redactions) of the files and apiKeys in which a credential was replaced."""
    files = redact_files(source_files).where("redactions > 0").select(F.lit("file").alias("record"), F.col("file_id").alias("record_id"), "content", "redactions")
    configs = find_in_configs(ai_configs).where("found").select(F.lit("config").alias("record"), F.col("config_id").alias("record_id"), F.col("apiKey").alias("content"), F.lit(1).alias("redactions"))
    return files.unionByName(configs)


def found(source_files: DataFrame, ai_configs: DataFrame) -> DataFrame:
    """(record, record_id, line_no), one row per line on which a credential begins."""
    files = find_in_files(source_files).select(F.lit("file").alias("record"), F.col("file_id").alias("record_id"), "line_no").distinct()
    configs = find_in_configs(ai_configs).where("found").select(F.lit("config").alias("record"), F.col("config_id").alias("record_id"), F.lit(0).cast("int").alias("line_no"))
    return files.unionByName(configs)
