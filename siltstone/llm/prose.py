"""What counts as prose in comments, literals and descriptions."""

from __future__ import annotations

import re

CJK = re.compile(r"[ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾟ]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: A passage counts from so many words on, in Korean, Japanese and Chinese from so many letters on.
LEAST_WORDS, LEAST_LETTERS = 4, 8
#: ``LEAST_WORDS`` words, one after another; stops at the last of them.
FOUR_WORDS = re.compile(rf"(?:[^\W\d_]++(?:['’-][^\W\d_]++)*+[\W\d_]++){{{LEAST_WORDS - 1}}}[^\W\d_]")

MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|//+[/!]?|#+(?!\[)|\*(?!\*)|\"\"\"|'''|--+)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
TAG_LINE = re.compile(r"^[ \t]*(?:\{@[^}]*\}|[@\\][A-Za-z]\w*\b[^\n]*|:(?:param|return|returns|rtype|raises|type|arg|keyword|yields?)\b[^\n]*)[ \t]*$", re.M)
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|\{@\w+ ?|\*\*|__|&(?:[a-z]+|#\d+);")


def comment_text(raw: str) -> str:
    """Text of a comment or docstring without its marks."""
    return MARKS.sub("", raw.replace("\r", "")).strip()


def without_tags(text: str) -> str:
    """Text without tag lines and markup."""
    return MARKUP.sub(" ", TAG_LINE.sub("", text.replace("\r", ""))).strip()


def is_passage(text: str) -> bool:
    """Whether ``text`` is long enough to be a passage."""
    if text.isascii() or not CJK.search(text):
        return FOUR_WORDS.search(text) is not None
    return len(CJK.findall(text)) >= LEAST_LETTERS or sum(1 for w in WORD.findall(text) if not CJK.match(w)) >= LEAST_WORDS


SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
FILLERS = {"a", "an", "the", "of", "this", "is", "method", "function"}
CODE = re.compile(r"[;{}]\s*$|^\s*(?:return|if|for|while|const|let|var|def|func|fun|import)\b[^.]*[()=;]|^[\w.$>-]+\([^()]*\)[;.]?$|^\s*[\w.$]+\s*(?:=|:=|\+=)\s*\S+$")


def words_of_name(name: str) -> set[str]:
    return {w.lower() for w in SPLIT_NAME.findall(name)}


def is_code(text: str) -> bool:
    """Whether all lines of ``text`` are statements put into a comment."""
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and all(CODE.search(x) for x in lines)


def is_trivial(text: str | None, name: str | None) -> bool:
    """Whether a documentation says nothing: without tag lines it is no passage, only repeats the name, or is code."""
    if not text:
        return True
    plain = without_tags(text)
    if not is_passage(plain) or is_code(plain):
        return True
    said = {w.lower() for w in SPLIT_NAME.findall(plain)} - FILLERS
    return said <= words_of_name(name or "") | FILLERS
