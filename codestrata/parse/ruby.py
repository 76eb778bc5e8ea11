"""Functions and control flow of Ruby, whose statements end in words."""

from __future__ import annotations

from codestrata.parse.braces import Function, Node, cut, deepen
from codestrata.parse.tokens import Token, brackets, tokenize

_ALWAYS = {"def", "class", "module", "begin", "case"}
_SOMETIMES = {"if": "Branch", "unless": "Branch", "while": "Loop", "until": "Loop"}
_BEFORE = {"=", "(", "then", "else", "do", "{", "|", "return", "and", "or", "not", "&&", "||", "=>", "->", ",", "[", "+=", "||=", "!", "<<", "ensure", "begin", ";"}
_OPERATORS = {"&&", "||", "and", "or"}


class Ruby:
    """The statements of one Ruby text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens: list[Token] = tokenize("ruby", text)
        self.brackets = brackets(self.tokens)
        self.ends: dict[int, int] = {}
        self.blocks: set[int] = set()
        self._match()

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> str:
        """The keyword at ``i``; empty for symbols, members and keys of that name."""
        if not 0 <= i < len(self.tokens) or self.tokens[i].kind != "name" or self.at(i - 1) in (".", "?.", ":", "::", "&.") or (self.at(i - 1) == "def" and i > 0):
            return ""
        follows = self.at(i + 1) == ":" and self.at(i + 2) != ":" and self.tokens[i].end == self.tokens[i + 1].start
        return "" if follows and self.at(i) != "else" else self.at(i)

    def starts(self, i: int) -> bool:
        """Whether a statement or a value begins at ``i``."""
        return i == 0 or self.tokens[i - 1].kind == "newline" or self.at(i - 1) in _BEFORE

    def _match(self) -> None:
        stack: list[int] = []
        header = False  # a loop whose own ``do`` is still to come
        for i, t in enumerate(self.tokens):
            if t.kind == "newline" or t.text == ";":
                header = False
            word = self.word(i)
            if not word:
                continue
            if word in _ALWAYS:
                if word == "def" and self._endless(i) >= 0:
                    continue
                if word == "class" and self.at(i + 1) == "<<" or word != "class" or self.starts(i):
                    stack.append(i)
            elif word in _SOMETIMES or word == "for":
                if self.starts(i):
                    stack.append(i)
                    header = word in ("while", "until", "for")
            elif word == "do":
                if header:
                    header = False
                else:
                    stack.append(i)
                    self.blocks.add(i)
            elif word == "end" and stack:
                self.ends[stack.pop()] = i
        for left in stack:
            self.ends[left] = len(self.tokens)
        for i, t in enumerate(self.tokens):
            if t.text == "{" and t.kind == "op" and self._is_block(i):
                self.blocks.add(i)
                self.ends[i] = self.brackets.get(i, len(self.tokens))

    def _endless(self, i: int) -> int:
        """The equals sign before the one expression that a method is, else -1; a setter's name has none."""
        k = i + (4 if self.at(i + 2) == "." else 2)
        if self.at(k) == "(":
            k = self.brackets.get(k, k) + 1
        return k if self.at(k) == "=" and self.tokens[k].start > self.tokens[k - 1].end else -1

    def _is_block(self, i: int) -> bool:
        if i == 0:
            return False
        before = self.tokens[i - 1]
        return before.text in (")", "]", "lambda", "proc", "->") or (before.kind == "name" and self.word(i - 1) not in ("return", "puts", "and", "or", "not", "in", "if", "unless", "when"))

    def statement_end(self, i: int, end: int) -> int:
        while i < end:
            if i in self.ends:
                i = self.ends[i]
            elif self.tokens[i].kind == "op" and self.at(i) in ("(", "[", "{"):
                i = self.brackets.get(i, i)
            elif self.tokens[i].kind == "newline":
                if self.at(i - 1) not in ("&&", "||", ",", ".", "+", "=", "|", "and", "or", "\\") and self.at(i + 1) not in (".", "&."):
                    return i
            elif self.at(i) == ";":
                return i
            i += 1
        return end

    def parts(self, i: int, end: int, words: set[str]) -> list[int]:
        """Where clauses with these words begin at the level of ``i``."""
        found = []
        while i < end:
            if i in self.ends:
                i = self.ends[i]
            elif self.tokens[i].kind == "op" and self.at(i) in ("(", "[", "{"):
                i = self.brackets.get(i, i)
            elif self.word(i) in words:
                found.append(i)
            i += 1
        return found

    def walk(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        """Nodes of statements from ``i`` to ``end``."""
        while i < end:
            if self.tokens[i].kind == "newline" or self.at(i) in (";", "then"):
                i += 1
                continue
            stop = self.statement_end(i, end)
            modifiers = [m for m in self.parts(i, stop, set(_SOMETIMES) | {"rescue"}) if m > i and not self.starts(m)]
            if modifiers and modifiers[-1] not in self.ends:
                self.modified(i, modifiers, stop, depth, out)
            else:
                self.value(i, stop, depth, out)
            i = max(stop, i + 1)

    def modified(self, i: int, modifiers: list[int], stop: int, depth: int, out: list[Node]) -> None:
        last = modifiers[-1]
        kind = _SOMETIMES.get(self.at(last))
        if kind:
            out.append((kind, depth))
        inner = depth + 1 if kind else depth
        self.value(last + 1, stop, inner, out)
        if modifiers[:-1]:
            self.modified(i, modifiers[:-1], last, inner, out)
        else:
            self.value(i, last, inner, out)

    def value(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        """Nodes of the tokens of one statement; those of an expression that turns out to be a condition lie one level deeper."""
        mark, outer = len(out), []
        while i < end:
            if i in self.ends:
                self.construct(i, min(self.ends[i], end), depth, out)
                i = self.ends[i] + 1
                continue
            t = self.tokens[i]
            if self.at(i) in _OPERATORS and (t.kind == "op" or self.word(i)):
                out.append(("Operator", depth))
            elif t.kind == "op" and t.text == "?" and any(self.at(k) == ":" for k in range(i + 1, end)):
                deepen(out, mark, ("Branch", depth))
                self.value(i + 1, end, depth + 1, out)
                return
            if t.kind == "op" and t.text in ("(", "[", "{"):
                outer.append(mark)
                mark = len(out)
            elif t.kind == "op" and t.text in (")", "]", "}"):
                mark = outer.pop() if outer else mark
            elif t.kind == "op" and self.at(i) in ("=", "+=", "-=", "*=", "/=", "||=", "&&=", ",", ":", "=>") or self.at(i) == "return":
                mark = len(out)
            i += 1

    def construct(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        word = self.at(i)
        if i in self.blocks:
            out.append(("Closure", depth))
            self.body(i + 1, end, depth + 1, out)
        elif word in ("if", "unless"):
            out.append(("Branch", depth))
            clauses = [c for c in self.parts(i + 1, end, {"elsif", "else"})]
            bounds = [i, *clauses, end]
            level = depth + 1
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if self.at(a) == "elsif":
                    out.append(("Branch", level))
                    level += 1
                self.walk(a + 1, b, level, out)
        elif word in ("while", "until", "for"):
            out.append(("Loop", depth))
            self.walk(i + 1, end, depth + 1, out)
        elif word == "case":
            out.append(("Nesting", depth))
            clauses = self.parts(i + 1, end, {"when", "in", "else"})
            clauses = [c for c in clauses if self.at(c) != "in" or self.starts(c)]
            bounds = [i, *clauses, end]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                is_when = self.at(a) == "when"
                if is_when:
                    out.append(("Branch", depth + 1))
                self.walk(a + 1, b, depth + 2 if is_when else depth + 1, out)
        elif word == "begin":
            out.append(("Nesting", depth))
            self.body(i + 1, end, depth + 1, out)
        else:
            self.body(i + 1, end, depth, out)

    def body(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        """Statements with clauses for errors."""
        clauses = [c for c in self.parts(i, end, {"rescue", "ensure", "else"}) if self.starts(c)]
        bounds = [i, *clauses, end]
        for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            rescue = n > 0 and self.at(a) == "rescue"
            if rescue:
                out.append(("Branch", depth))
            self.walk(a + (n > 0), b, depth + 1 if rescue else depth, out)

    def functions(self) -> list[Function]:
        out = []
        for i, t in enumerate(self.tokens):
            if t.kind == "name" and self.word(i) == "def" and (sign := self._endless(i)) >= 0:
                out.append(self._one_expression(i, sign))
                continue
            if i not in self.ends:
                continue
            is_block = i in self.blocks
            if self.at(i) != "def" and not is_block:
                continue
            end = min(self.ends[i], len(self.tokens) - 1)
            nodes: list[Node] = []
            if is_block:
                name, params, start = "<block>", self._block_params(i), i + 1
                nodes.append(("Closure", 0))
                self.body(start, self.ends[i], 1, nodes)
            else:
                name, params, start = self._header(i)
                self.body(start, self.ends[i], 0, nodes)
            text = self.text[self.tokens[i].start : self.tokens[end].end]
            inside = self.text[self.tokens[min(start, end)].start : self.tokens[end].start]
            out.append(Function(name, self.tokens[i].line, self.tokens[end].line, params, text.count("\n") + 1, cut(inside.rstrip()), nodes))
        return out

    def _one_expression(self, i: int, sign: int) -> Function:
        stop = self.statement_end(sign + 1, len(self.tokens))
        last = self.tokens[max(sign, stop - 1)]
        name, params, _ = self._header(i)
        nodes: list[Node] = []
        self.walk(sign + 1, stop, 0, nodes)
        first, has_params = self.tokens[i], self.at(sign - 1) == ")"
        return Function(name, first.line, last.line, params if has_params else 0, last.line - first.line + 1, cut(self.text[self.tokens[sign].end : last.end].strip()), nodes)

    def _block_params(self, i: int) -> int:
        """Every child of the parameters, the bars among them."""
        k = i + 1
        if self.at(k) != "|":
            return 0
        stop = k + 1
        while stop < len(self.tokens) and self.at(stop) != "|":
            stop += 1
        return 2 + len(self._split(k + 1, stop))

    def _split(self, i: int, end: int) -> list[int]:
        found, fresh = [], True
        while i < end:
            if self.at(i) == ",":
                fresh = True
            elif fresh and self.tokens[i].kind != "newline":
                found.append(i)
                fresh = False
            i = self.brackets.get(i, i) + 1 if self.at(i) in ("(", "[", "{") else i + 1
        return found

    def _header(self, i: int) -> tuple[str, int, int]:
        """Name, number of parameters and where the body begins."""
        k = i + 1
        name = self.at(k)
        if self.at(k + 1) == ".":
            name, k = self.at(k + 2), k + 2
        if self.tokens[k].kind == "op":
            while k + 1 < len(self.tokens) and self.tokens[k + 1].kind == "op" and self.at(k + 1) not in ("(", ";"):
                name, k = name + self.at(k + 1), k + 1
        elif self.at(k + 1) == "=" and self.at(k + 2) == "(" and self.tokens[k].end == self.tokens[k + 1].start:
            name, k = name + "=", k + 1
        k += 1
        if self.at(k) == "(":
            stop = self.brackets.get(k, k)
            return name, len(self._split(k + 1, stop)), stop + 1
        stop = k
        while stop < len(self.tokens) and self.tokens[stop].kind != "newline" and self.at(stop) != ";":
            stop += 1
        return name, len(self._split(k, stop)), stop


def functions(text: str) -> list[Function]:
    return Ruby(text).functions()
