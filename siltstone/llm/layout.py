"""Layout of a file against its canonical formatting, and the marks of origin in its comments.

A file is lexed and re-emitted in canonical form: one statement to a line, no
optional blanks. What the original layout is next to that tells how the file
came to be: a minified file expands extremely, a generated one repeats a few
statement shapes perfectly, a data blob is mostly literals.
"""

from __future__ import annotations

import re

import xxhash

PIECE = re.compile(r"[;{}\n]")
#: Statements that many unrelated files share.
HEADERS = ("import", "package", "#include", "from", "use", "namespace")
NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$]*")
NUMBER = re.compile(r"\b\d[\w.]*")

#: Comments by which tools mark their output. In several languages; fixed wordings of common tools.
GENERATED = re.compile(
    r"@generated\b|\bcode generated by\b|<auto-?generated\b|\b(?:was|is|been) (?:automatically|auto-?) ?generated (?:by|from|with)\b|\bthis (?:file|code) (?:was|is|has been) (?:auto-?|automatically )?generated\b"
    r"|\bauto-?generated (?:file|code)\b|\bautogenerated\b\s*[-:,]|\boutput of [\w.-]+; source of truth|\bgenerated by [\w.-]+(?: [\w.-]+)?[.;]? *(?:do not|don't) (?:edit|modify)"
    r"|automatisch (?:erzeugt|generiert)|(?:generado|gerado) automaticamente|generado automáticamente|généré automatiquement|automatisch gegenereerd|automatically gegenereerd|сгенерирован автоматически|автоматически сгенерирован|создан автоматически"
    r"|自動生成されたもの|自動生成ファイル|自动生成|자동으로 생성",
    re.I,
)
#: Notes by which third parties mark their files: a project named as owner, or a stated origin with a version.
THIRD_PARTY = re.compile(
    r"\bthis file is part of [\w.-]+|\(c\) (?:\d{4}(?:-\d{4})?,? )?the [\w.-]+ (?:contributors|authors|developers|project)|copyright (?:\(c\) )?(?:\d{4}(?:-\d{4})?,? )?the [\w.-]+ (?:contributors|authors|developers|project)"
    r"|@license [\w.@/-]+ v?\d+\.\d+|\b(?:taken|copied|vendored|imported) from [\w.@/-]+ v?\d+\.\d+|\breleased under the [\w.-]+ licen[cs]e|\blicensed under the (?:apache|mit|bsd)|see upstream for changes",
    re.I,
)
#: Folders into which packages of third parties are copied.
VENDOR_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|third[_-]party|thirdparty|vendor|site-packages|external/[\w.-]+-\d+(?:\.\d+)+)/", re.I)


#: A comment without any of these is not matched against the patterns above.
HINTS = ("generat", "erzeugt", "generiert", "generado", "gerado", "généré", "gegenereerd", "генер", "создан авт", "自動", "自动", "자동", "source of truth")
ORIGIN_HINTS = ("this file is part of", "(c)", "copyright", "@license", "taken from", "copied from", "vendored from", "imported from", "released under", "licensed under", "upstream")


def squeeze(code: str) -> str:
    """Code without blanks; its lines stay."""
    return code.replace(" ", "").replace("\t", "").replace("\r", "")


def canonical(squeezed: str) -> list[str]:
    """The canonical formatting of squeezed code, line by line: one statement or block head to a line, nothing else on it."""
    return [x for x in PIECE.split(squeezed) if len(x) > 1]


def units(squeezed: str) -> list[tuple[int, int]]:
    """Canonical code in pieces that survive reformatting and local changes: (hash, weight in statements).

    Pieces end after a statement whose length says so, on average every fourth,
    so that an insertion changes only its own piece.
    """
    out, held = [], []
    for line in canonical(squeezed):
        if len(line) < 4 or line.startswith(HEADERS):
            continue
        held.append(line)
        if len(line) & 3 == 0 and len(held) >= 3:
            out.append(held)
            held = []
    if held:
        if len(held) >= 3 or not out:
            out.append(held)
        else:
            out[-1] += held
    return [(xxhash.xxh64_intdigest("\n".join(h).encode("utf-8", "replace")) - (1 << 63), len(h)) for h in out]


def features(path: str, text: str, spans: list, code: str, squeezed: str) -> dict:
    """Figures of one file for :func:`kind_of`."""
    comments = "\n".join([text[a:b] for k, a, b in spans if k in "lb"]).lower()
    literal = sum([b - a for k, a, b in spans if k in "str"])
    strings = sum([k in "st" for k, _, _ in spans])
    named = NAME.sub("n", squeezed)
    shape = NUMBER.sub("0", named)
    numbers = shape.count("0")
    number_len = len(named) - len(shape) + numbers
    shape = shape.replace("-0", "0")
    # Separators between values belong to the data.
    commas = shape.count('",') + shape.count("0,")
    body = len(squeezed) - squeezed.count("\n") + literal
    shapes: dict[str, int] = {}
    n = 0
    for x in shape.split("\n"):
        if len(x) > 3:
            shapes[x] = shapes.get(x, 0) + 1
            n += 1
    code_lines = sum([x != "" for x in shape.split("\n")])
    return {
        # Lines of the canonical formatting against those of the original.
        "expansion": len(canonical(shape)) / max(1, code_lines), "blank_share": (code.count(" ") + code.count("\t")) / max(1, len(code)), "data_share": (literal + number_len + commas) / max(1, body), "values": numbers + strings, "body": body,
        "uniformity": 1 - len(shapes) / n if n else 0.0, "shapes": len(shapes), "n": n, "calls": sum([c for x, c in shapes.items() if "(" in x and "{" in x]) / max(1, n),
        "marked": any(h in comments for h in HINTS) and bool(GENERATED.search(comments)) or "@Generated(" in code,
        "third": any(h in comments for h in ORIGIN_HINTS) and bool(THIRD_PARTY.search(comments)), "vendor_path": bool(VENDOR_PATH.search(path or "")),
    }


def kind_of(f: dict) -> str | None:
    """What the layout says of a file: minified, generated, data, third party (by its own marks) or None.

    Thresholds: a minified file has at least five statements to a line and under
    6 % blanks. Generated code repeats at most five statement shapes over and
    over, or says that it is generated. A data blob is at least half literals
    in uniform lines, or one literal that outweighs all else.
    """
    if f["expansion"] >= 5 and f["blank_share"] < 0.06 and f["body"] >= 100:
        return "minified"
    if f["vendor_path"] or f["third"]:
        return "third_party"
    if f["data_share"] >= 0.5 and f["values"] >= 40 and f["uniformity"] >= 0.8 or f["data_share"] >= 0.9 and f["body"] >= 1200:
        return "data"
    if f["shapes"] <= 5 and f["n"] >= 8 and (f["uniformity"] >= 0.85 or f["uniformity"] >= 0.7 and f["calls"] >= 0.9):
        return "generated"
    return "generated" if f["marked"] else None
