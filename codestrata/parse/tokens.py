"""A tokenizer for many languages: names, numbers, strings, operators and line ends."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, op or newline
    text: str
    line: int
    start: int
    end: int


_OPERATORS = ["<<=", ">>=", "...", "..<", "&&=", "||=", "??=", "===", "!==", "<=>", "?->", "&&", "||", "??", "?.", "?:", "=>", "->", "::", "!!", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "..", ":=", "<-", "|>"]
_COMMENTS = {"slash": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "hash": r"\#[^\n]*", "php": r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)", "ruby": r"\#[^\n]*|^=begin\b.*?(?:^=end\b[^\n]*|\Z)"}
_DOUBLE = r'"(?:\\.|[^"\\])*(?:"|\Z)'
_LINE_DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\])*(?:'|\Z)"
_CHAR = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'
_BACKTICK = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_STRINGS = {
    "go": [r"`[^`]*(?:`|\Z)", _LINE_DOUBLE, _CHAR],
    "javascript": [_BACKTICK, _LINE_DOUBLE, r"'(?:\\.|[^'\\\n])*'?", r"(?<=[=(,:;!&|?{}\[\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*", r"(?<=return )/(?![/*])(?:\\.|[^/\\\n])+/[a-z]*"],
    "java": [_TRIPLE, _LINE_DOUBLE, _CHAR],
    "csharp": [_TRIPLE, r'[$@]{0,2}@[$@]{0,1}"(?:""|[^"])*"', r"\$?" + _LINE_DOUBLE, _CHAR],
    "c_cpp": [r'R"\((?:.|\n)*?\)"', _LINE_DOUBLE, _CHAR, r"^[ \t]*\#[^\n]*(?:\\\n[^\n]*)*"],
    "php": [_DOUBLE, _SINGLE, r"<<<\s*['\"]?(?P<doc>\w+)['\"]?\n.*?\n\s*(?P=doc)\b"],
    "ruby": [_DOUBLE, _SINGLE, _BACKTICK, r"%[qQwWiI]?[\[({<|!].*?[\])}>|!]", r"(?<=[=(,~\s])/(?![\s/=])(?:\\.|[^/\\\n])+/[a-z]*", r"<<[~-]?['\"]?(?P<doc>[A-Z_]+)['\"]?[^\n]*\n.*?\n\s*(?P=doc)\b"],
    "rust": [r'b?r(?P<h>\#*)".*?"(?P=h)', r"b?" + _DOUBLE, r"b?" + _CHAR],
    "kotlin": [_TRIPLE, _LINE_DOUBLE, _CHAR],
    "swift": [_TRIPLE, r'(?P<h>\#*)"(?:\\.|[^"\\\n])*"(?P=h)'],
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_COMMENT_STYLE = {"php": "php", "ruby": "ruby"}


@lru_cache(maxsize=None)
def _pattern(language: str) -> re.Pattern[str]:
    operators = "|".join(re.escape(o) for o in _OPERATORS)
    strings = "|".join(_STRINGS[language])
    name = r"[@$]{0,2}[^\W\d]\w*[?!]?(?<![?!](?==))" if language == "ruby" else r"[$@#]?[^\W\d][\w$]*" if language in ("javascript", "typescript", "php", "csharp") else r"[^\W\d]\w*"
    lifetime = r"|(?P<lifetime>'[^\W\d]\w*\b(?!'))" if language == "rust" else ""
    return re.compile(
        rf"(?P<comment>{_COMMENTS[_COMMENT_STYLE.get(language, 'slash')]})|(?P<string>{strings}){lifetime}|(?P<number>\d[\w.]*(?<!\.)(?:(?<=[eE])[+-]\d+)?)|(?P<name>{name})|(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<op>{operators}|.)",
        re.S | re.M,
    )


def tokenize(language: str, text: str) -> list[Token]:
    """The tokens of a text; comments and blanks are left out, line ends are kept."""
    out: list[Token] = []
    line = 1
    for m in _pattern(language).finditer(text):
        kind = m.lastgroup or "op"
        if m.group("string") is not None:
            kind = "string"
        value = m.group()
        if kind not in ("comment", "space", "lifetime"):
            if kind == "number" and ".." in value:  # a range of numbers
                cut = value.index("..")
                for k, v, at in (("number", value[:cut], 0), ("op", "..", cut), ("number", value[cut + 2 :], cut + 2)):
                    if v:
                        out.append(Token(k, v, line, m.start() + at, m.start() + at + len(v)))
            else:
                out.append(Token(kind, value, line, m.start(), m.end()))
        line += value.count("\n")
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def brackets(tokens: list[Token]) -> dict[int, int]:
    """The closing index of each opening bracket; unclosed ones close at the end, stray ones are ignored."""
    pairs: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            for depth in range(len(stack) - 1, -1, -1):
                if _OPEN[tokens[stack[depth]].text] == t.text:
                    for left in stack[depth + 1 :]:
                        pairs[left] = i
                    pairs[stack[depth]] = i
                    del stack[depth:]
                    break
    for left in stack:
        pairs[left] = len(tokens)
    return pairs
