"""Functions and control flow of languages with braces, by one scanner and a table of rules each."""

from __future__ import annotations

from dataclasses import dataclass, field

from codestrata.parse.tokens import Token, brackets, tokenize

Node = tuple[str, int]


@dataclass
class Function:
    """A function: its place, parameters and control-flow nodes (type, depth)."""

    name: str
    start_line: int
    end_line: int
    params: int
    loc: int
    snippet: str
    nodes: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class Rules:
    """What the statements of a language count as."""

    parens: bool = True  # conditions stand in parentheses
    loops: frozenset[str] = frozenset(("for", "while", "do"))
    branches: frozenset[str] = frozenset(("if",))
    switches: frozenset[str] = frozenset(("switch",))
    case_nests: bool = True  # statements of a case lie within it
    default_counts: bool = True
    arms: str = ""  # the arrow of match arms
    catches: frozenset[str] = frozenset(("catch",))
    ternary: bool = True
    operators: frozenset[str] = frozenset(("&&", "||"))
    jumps: frozenset[str] = frozenset()  # words that count as branches by themselves
    closures: bool = False  # closures within a function count
    closure_is_root: bool = False  # and a closure's own row counts itself
    loc: str = "body"  # body, whole or none


RULES = {
    "go": Rules(parens=False, loops=frozenset(("for",)), switches=frozenset(("switch", "select")), ternary=False, catches=frozenset(), loc="whole"),
    "javascript": Rules(default_counts=False, operators=frozenset(("&&", "||", "??", "??=", "&&=", "||=")), loc="none"),
    "typescript": Rules(default_counts=False, operators=frozenset(("&&", "||", "??", "??=", "&&=", "||="))),
    "java": Rules(case_nests=False, loc="none"),
    "csharp": Rules(loops=frozenset(("for", "foreach", "while", "do")), case_nests=False, default_counts=False, operators=frozenset(("&&", "||", "??"))),
    "c_cpp": Rules(jumps=frozenset(("goto",)), closures=True),
    "php": Rules(loops=frozenset(("for", "foreach", "while", "do")), operators=frozenset(("&&", "||", "and", "or", "xor", "??")), closures=True, closure_is_root=True),
    "rust": Rules(parens=False, loops=frozenset(("for", "while", "loop")), switches=frozenset(("match",)), arms="=>", catches=frozenset(), ternary=False, closures=True, closure_is_root=True),
    "kotlin": Rules(switches=frozenset(("when",)), arms="->", ternary=False, closures=True, closure_is_root=True),
    "swift": Rules(parens=False, loops=frozenset(("for", "while", "repeat")), branches=frozenset(("if", "guard")), operators=frozenset(("&&", "||", "??")), closures=True, closure_is_root=True),
}
ANONYMOUS = {"go": "<anonymous>", "javascript": "<anonymous>", "typescript": "<anonymous>", "php": "<anonymous>", "java": "<lambda>", "csharp": "<lambda>", "c_cpp": "<lambda>", "kotlin": "<lambda>", "rust": "<closure>", "swift": "<closure>"}
_NOT_NAMES = frozenset("if for while switch catch return new throw else do try function fn func fun typeof await yield sizeof using lock foreach when match unless guard in of is as case default delegate instanceof import super this static_assert alignof decltype".split())


#: What ends an expression to its left, so that it isn't part of a condition that follows.
_EXPRESSION_STARTS = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ".=", "??=", "&&=", "||=", ":=", ":", ",", ";", "=>", "<-"))
_STATEMENT_WORDS = frozenset("return throw yield case echo print else in".split())


def deepen(out: list[Node], mark: int, branch: Node) -> None:
    """A conditional expression over the nodes from ``mark`` on, which lie in its condition."""
    out[mark:] = [branch, *((kind, depth + 1) for kind, depth in out[mark:])]


_TYPE_PREFIXES = frozenset("keyof unique readonly infer asserts typeof abstract new".split())
_BEFORE_ARROW = frozenset(("", "=", "(", ",", "[", "{", "}", ";", ":", "=>", "?", "&&", "||", "??", "&&=", "||=", "??=", "return", "default", "yield", "else", "do", "of", "in"))


@dataclass
class _Found:
    """A function header: name, its first token, parameter tokens and the body's tokens with their bounds."""

    name: str
    start: int
    params: tuple[int, int] | None
    body: tuple[int, int]
    end: int
    closure: bool = False
    bare_params: int | None = None


class Scanner:
    """The statements of one source text."""

    def __init__(self, language: str, text: str) -> None:
        self.language, self.text, self.rules = language, text, RULES[language]
        self.tokens: list[Token] = tokenize(language, text)
        if language not in ("swift", "kotlin", "go"):  # where line ends mean nothing
            self.tokens = [t for t in self.tokens if t.kind != "newline"]
        self.pairs = brackets(self.tokens)
        self.openers = {close: left for left, close in self.pairs.items()}
        self.angles = self._angles()
        self.arrows, self.type_arrows = self._typed_arrows() if language == "typescript" else ({}, set())
        self.found = sorted(self._functions(), key=lambda f: f.start)
        self.closures = {f.start: f for f in self.found if f.closure}

    # --- small helpers ----------------------------------------------------------------------

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return self.kind(i) == "name"

    def skip_lines(self, i: int, end: int | None = None) -> int:
        end = len(self.tokens) if end is None else end
        while i < end and self.kind(i) == "newline":
            i += 1
        return i

    def previous(self, i: int) -> int:
        i -= 1
        while i >= 0 and self.kind(i) == "newline":
            i -= 1
        return i

    def close(self, i: int) -> int:
        return self.pairs.get(i, i)

    def open(self, i: int) -> int:
        return self.openers.get(i, i)

    def brace_after(self, i: int, end: int) -> int:
        """The next opening brace outside of other brackets, or ``end``."""
        while i < end:
            if self.at(i) == "{" and self.kind(i) == "op":
                return i
            i = self.close(i) + 1 if self.at(i) in ("(", "[") and self.kind(i) == "op" else i + 1
        return end

    def segments(self, start: int, end: int) -> list[tuple[int, int]]:
        """Non-empty parts between commas outside of brackets; angle brackets count as brackets where types stand."""
        parts, begin, i, angle = [], start, start, 0
        while i < end:
            t = self.at(i)
            if t in ("(", "[", "{") and self.kind(i) == "op":
                i = self.close(i)
            elif t == "<" and self.language not in ("go",):
                angle += 1
            elif t == ">" and angle and self.at(i - 1) != "-":
                angle -= 1
            elif t == "," and not angle:
                parts.append((begin, i))
                begin = i + 1
            i += 1
        parts.append((begin, end))
        return [(a, b) for a, b in parts if self.skip_lines(a, b) < b]

    # --- statements -------------------------------------------------------------------------

    def is_word(self, i: int, words: frozenset[str]) -> bool:
        """Whether one of the words stands at ``i`` as a keyword, not as a member or key."""
        member = (".", "?.", "::", "->", "?->") if self.language in ("php", "c_cpp") else (".", "?.", "::")
        return self.is_name(i) and self.at(i) in words and self.at(self.previous(i)) not in member and self.at(i + 1) != ":"

    def header_end(self, i: int, end: int) -> int:
        """Where the body of the construct at ``i`` begins."""
        k = self.skip_lines(i + 1, end)
        if not self.rules.parens:
            return self.brace_after(k, end)
        while self.is_name(k) and self.at(k) in ("constexpr", "await"):
            k += 1
        return self.close(k) + 1 if self.at(k) == "(" else k

    def statement_end(self, i: int, end: int) -> int:
        """The index after the statement that begins at ``i``."""
        i = self.skip_lines(i, end)
        if i >= end:
            return end
        r, word = self.rules, self.at(i)
        if word == "{":
            return min(end, self.close(i) + 1)
        if self.is_word(i, r.branches):
            k = self.statement_end(self.header_end(i, end), end)
            after = self.skip_lines(k, end)
            while self.at(after) == "elseif":
                k = self.statement_end(self.header_end(after, end), end)
                after = self.skip_lines(k, end)
            return self.statement_end(after + 1, end) if self.at(after) == "else" and after < end else k
        if word in ("do", "repeat") and self.is_word(i, r.loops):
            k = self.statement_end(i + 1, end)
            after = self.skip_lines(k, end)
            if self.at(after) == "while":
                k = self.header_end(after, end) if r.parens else self.line_end(after, end)
            return k
        if self.is_word(i, r.loops) or self.is_word(i, r.switches) or word in ("synchronized", "using", "lock", "fixed"):
            return self.statement_end(self.header_end(i, end), end)
        if word == "try" and self.kind(i) == "name" and self.at(self.skip_lines(i + 1)) == "{":
            k = self.statement_end(i + 1, end)
            after = self.skip_lines(k, end)
            while self.at(after) in ("catch", "finally"):
                body = self.brace_after(after, end)
                k = min(end, self.close(body) + 1)
                after = self.skip_lines(k, end)
            return k
        return self.line_end(i, end)

    def line_end(self, i: int, end: int) -> int:
        """The index after a simple statement: a semicolon, or a line end where these count."""
        by_line = self.language in ("swift", "kotlin", "go")
        while i < end:
            t = self.at(i)
            if self.kind(i) == "op" and t in ("(", "[", "{"):
                i = self.close(i)
            elif t == ";" and self.kind(i) == "op":
                return i + 1
            elif by_line and self.kind(i) == "newline" and self.at(self.skip_lines(i)) not in (".", "?.", "?:", "&&", "||", "??"):
                return i + 1
            elif by_line and t == "else" and self.kind(i) == "name":
                return i
            i += 1
        return end

    def walk(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        """Nodes of the tokens from ``i`` to ``end``; those of an expression that turns out to be a condition lie one level deeper."""
        r, mark = self.rules, len(out)
        while i < end:
            closure = self.closures.get(i)
            if closure is not None and closure.end <= end:
                inner = depth
                if r.closures:
                    out.append(("Closure", depth))
                    inner += 1
                self.walk(*closure.body, inner, out)
                i = closure.end
                continue
            t = self.tokens[i]
            if t.kind == "name":
                step = self.word(i, end, depth, out)
                if step is not None:
                    if t.text not in r.operators:
                        mark = len(out)
                    i = step
                    continue
                if t.text in _STATEMENT_WORDS:
                    mark = len(out)
            elif t.kind == "newline":
                if self.language == "swift" and self.at(self.skip_lines(i)) not in (*r.operators, "?", ".", "?."):
                    mark = len(out)
            elif t.kind == "op":
                if t.text in ("(", "[", "{"):
                    close = min(end, self.close(i))
                    self.walk(i + 1, close, depth, out)
                    i = close + 1
                    if (t.text == "{" and self.at(i) not in (*r.operators, "?")) or (t.text == "(" and self.kind(i) in ("name", "number", "string") and self.at(i) not in r.operators):
                        mark = len(out)  # a block ended, or the head of a statement
                    continue
                if t.text in r.operators:
                    out.append(("Operator", depth))
                if t.text in _EXPRESSION_STARTS:
                    mark = len(out)
                elif t.text == "?:" and self.language == "php":
                    deepen(out, mark, ("Branch", depth))
                    stop = self.expression_end(i + 1, end)
                    self.walk(i + 1, stop, depth + 1, out)
                    i = stop
                    continue
                elif t.text == "?" and self.is_ternary(i, end):
                    deepen(out, mark, ("Branch", depth))
                    stop = self.expression_end(i + 1, end)
                    self.walk(i + 1, stop, depth + 1, out)
                    i = stop
                    continue
                elif t.text == "?" and self.language == "rust":
                    out.append(("Branch", depth))
                elif t.text == "?:" and self.language == "kotlin":
                    out.append(("Branch", depth))
                elif t.text in (".", "?.") and self.language == "kotlin" and self.at(i + 1) in ("let", "run", "apply", "also"):
                    out.append(("Branch", depth))
                    call = i + 2
                    if self.at(call) == "(":
                        call = self.close(call) + 1
                    if self.at(call) == "{":
                        call = self.close(call) + 1
                    self.walk(i + 2, min(call, end), depth + 1, out)
                    i = max(call, i + 2)
                    continue
            i += 1

    def is_ternary(self, i: int, end: int) -> bool:
        if not self.rules.ternary:
            return False
        if self.language == "swift" and self.tokens[i].start == self.tokens[i - 1].end:
            return False
        k, depth = i + 1, 0
        if self.at(k) in (":", ",", ")", ".", ">", "=", ";", "[", "]") and not (self.at(k) == "[" and self.language in ("javascript", "php", "swift", "typescript")):
            return False
        while k < end:
            t = self.at(k)
            if self.kind(k) == "op":
                if t in ("(", "[", "{"):
                    k = self.close(k)
                elif t == "?" and self.at(k + 1) not in (":", ",", ")", ">", "="):
                    depth += 1
                elif t == ":":
                    if not depth:
                        return True
                    depth -= 1
                elif t in (";", ")", "]", "}"):
                    return False
            k += 1
        return False

    def expression_end(self, i: int, end: int) -> int:
        while i < end:
            t = self.at(i)
            if self.kind(i) == "op":
                if t in ("(", "[", "{"):
                    i = self.close(i)
                elif t in (";", ",", ")", "]", "}"):
                    return i
            elif self.kind(i) == "newline" and self.language == "swift":
                return i
            i += 1
        return end

    def word(self, i: int, end: int, depth: int, out: list[Node]) -> int | None:
        """Handle a keyword; the index to go on from, or None if it is no construct."""
        r, word = self.rules, self.at(i)
        if word in r.operators:
            out.append(("Operator", depth))
            return i + 1
        if word in r.jumps:
            out.append(("Branch", depth))
            return i + 1
        if self.is_word(i, r.branches):
            return self.branch(i, end, depth, out)
        if self.is_word(i, r.loops) and self.opens(i):
            out.append(("Loop", depth))
            stop = self.statement_end(i, end)
            self.walk(i + 1, stop, depth + 1, out) if word not in ("do", "repeat") else self.tail_loop(i, stop, depth, out)
            return max(stop, i + 1)
        if self.is_word(i, r.switches) and self.opens(i):
            return self.switch(i, end, depth, out)
        if self.is_word(i, r.catches):
            out.append(("Branch", depth))
            body = self.brace_after(i + 1, end)
            stop = min(end, self.close(body) + 1)
            self.walk(i + 1, stop, depth + 1, out)
            return max(stop, i + 1)
        return None

    def opens(self, i: int) -> bool:
        """Whether a keyword is followed by what it needs, so that it isn't a plain name."""
        k = self.skip_lines(i + 1)
        if self.at(i) in ("do", "loop", "repeat", "select"):
            return self.at(k) == "{" or self.at(i) == "do"
        if self.language == "kotlin" and self.at(i) == "when":
            return self.at(k) in ("(", "{")
        return not self.rules.parens or self.at(k) in ("(", "await", "constexpr")

    def tail_loop(self, i: int, stop: int, depth: int, out: list[Node]) -> None:
        """A loop with its condition at the end; the closing ``while`` isn't another one."""
        body = self.statement_end(i + 1, stop)
        self.walk(i + 1, body, depth + 1, out)
        after = self.skip_lines(body, stop)
        self.walk(after + 1 if self.at(after) == "while" else after, stop, depth + 1, out)

    def branch(self, i: int, end: int, depth: int, out: list[Node]) -> int:
        out.append(("Branch", depth))
        if self.at(i) == "guard":
            body = self.brace_after(i + 1, end)
            stop = min(end, self.close(body) + 1)
            self.walk(i + 1, stop, depth + 1, out)
            return max(stop, i + 1)
        body = self.header_end(i, end)
        self.walk(i + 1, min(body, end), depth + 1, out)
        k = self.statement_end(body, end)
        self.walk(body, k, depth + 1, out)
        after = self.skip_lines(k, end)
        while after < end and self.at(after) == "elseif":
            out.append(("Branch", depth + 1))
            body = self.header_end(after, end)
            self.walk(after + 1, body, depth + 2, out)
            k = self.statement_end(body, end)
            self.walk(body, k, depth + 2, out)
            after = self.skip_lines(k, end)
        if after < end and self.at(after) == "else" and self.is_name(after):
            stop = self.statement_end(after + 1, end)
            if self.language == "php" and self.at(after + 1) == "if":
                stop = self.statement_end(after + 1, end)
            self.walk(after + 1, stop, depth + 1, out)
            return max(stop, after + 1)
        return max(k, i + 1)

    def switch(self, i: int, end: int, depth: int, out: list[Node]) -> int:
        out.append(("Nesting", depth))
        body = self.brace_after(i + 1, end)
        stop = min(end, self.close(body))
        self.walk(i + 1, body, depth + 1, out)
        if self.rules.arms:
            self.arms(body + 1, stop, depth + 1, out)
        else:
            self.cases(body + 1, stop, depth + 1, out)
        return stop + 1

    def labels(self, i: int, end: int) -> list[int]:
        """Where cases begin in a switch body."""
        found = []
        while i < end:
            if self.kind(i) == "op" and self.at(i) in ("(", "[", "{"):
                i = self.close(i)
            elif self.is_name(i) and (self.at(i) == "case" or self.at(i) == "default" and self.at(i + 1) in (":", "->", "=>")):
                found.append(i)
            i += 1
        return found

    def cases(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        starts = self.labels(i, end)
        if starts:
            self.walk(i, starts[0], depth, out)
        for a, b in zip(starts, [*starts[1:], end], strict=True):
            counts = self.at(a) == "case" or self.rules.default_counts
            if counts:
                out.append(("Branch", depth))
            self.walk(a + 1, b, depth + 1 if counts and self.rules.case_nests else depth, out)

    def arms(self, i: int, end: int, depth: int, out: list[Node]) -> None:
        """Arms of match and when: a pattern, an arrow and an expression or block each."""
        while True:
            i = self.skip_lines(i, end)
            while i < end and self.at(i) == ",":
                i = self.skip_lines(i + 1, end)
            arrow = i
            while arrow < end and self.at(arrow) != self.rules.arms:
                arrow = self.close(arrow) + 1 if self.kind(arrow) == "op" and self.at(arrow) in ("(", "[", "{") else arrow + 1
            if arrow >= end:
                return
            out.append(("Branch", depth))
            if self.language == "rust":
                guard = next((k for k in range(i, arrow) if self.at(k) == "if" and self.is_name(k)), arrow)
                bars = sum(self.at(k) == "|" for k in range(i, guard))
                out.extend(("Branch", depth + 1 + n) for n in range(bars))
                self.walk(guard + 1, arrow, depth + 1, out)
            else:
                self.walk(i, arrow, depth + 1, out)
            k = self.skip_lines(arrow + 1, end)
            if self.at(k) == "{":
                stop = self.close(k) + 1
            elif self.language == "rust":
                stop = k
                while stop < end and self.at(stop) != ",":
                    stop = self.close(stop) + 1 if self.kind(stop) == "op" and self.at(stop) in ("(", "[", "{") else stop + 1
            else:
                stop = self.statement_end(k, end)
            stop = min(max(stop, arrow + 1), end)
            self.walk(arrow + 1, stop, depth + 1, out)
            i = stop

    # --- functions --------------------------------------------------------------------------

    def _functions(self) -> list[_Found]:
        finder = {
            "go": self._go, "javascript": self._script, "typescript": self._script, "java": self._java, "csharp": self._csharp,
            "c_cpp": self._c, "php": self._php, "rust": self._rust, "kotlin": self._kotlin, "swift": self._swift,
        }[self.language]
        return [f for i in range(len(self.tokens)) if (f := finder(i)) is not None]

    def _bounds(self, brace: int) -> tuple[tuple[int, int], int]:
        stop = self.close(brace)
        return (brace + 1, stop), min(stop + 1, len(self.tokens))

    def _anonymous(self) -> str:
        return ANONYMOUS[self.language]

    def _go(self, i: int) -> _Found | None:
        if self.at(i) != "func" or not self.is_name(i):
            return None
        k, receiver = i + 1, ""
        if self.at(k) == "(" and self.is_name(self.close(k) + 1) and self.at(self.close(k) + 2) in ("(", "["):
            inside = [self.at(n) for n in range(k + 1, self.close(k)) if self.kind(n) != "newline"]
            kind = inside[1:] if len(inside) > 1 and inside[0] != "*" else inside
            bare = "".join(kind).split("[")[0]
            receiver = f"({bare})."
            k = self.close(k) + 1
        named = self.is_name(k)
        name = receiver + self.at(k) if named else self._anonymous()
        k += named
        if named and self.at(k) == "[":
            k = self.close(k) + 1
        if self.at(k) != "(":
            return None
        params = (k + 1, self.close(k))
        brace = self._go_body(self.close(k) + 1)
        if brace is None:
            return None
        body, end = self._bounds(brace)
        return _Found(name, i, params, body, end, closure=not named)

    def _go_body(self, k: int) -> int | None:
        """The body after a result type; a line end before it means that there is none."""
        while k < len(self.tokens) and self.kind(k) != "newline":
            t = self.at(k)
            if t == "{":
                if self.at(k - 1) in ("interface", "struct"):
                    k = self.close(k) + 1
                    continue
                return k
            if t in (",", ")", ";", "=", ":=") and self.kind(k) == "op":
                return None
            k = self.close(k) + 1 if t in ("(", "[") else k + 1
        return None

    def _arrow_body(self, k: int) -> tuple[tuple[int, int], int]:
        """The body after an arrow: a block or one expression."""
        k = self.skip_lines(k)
        if self.at(k) == "{":
            return self._bounds(k)
        stop = self.expression_end(k, len(self.tokens))
        return (k, stop), stop

    def _after_type(self, k: int) -> int:
        """Past a result type in TypeScript, to a brace, arrow or end of the statement."""
        return self._type_end(k + 1) if self.at(k) == ":" and self.language == "typescript" else k

    def _type_end(self, k: int) -> int:
        """Past the TypeScript type that begins at ``k``, of any length."""
        tests = choices = 0  # conditional types before their question mark, before their colon
        while True:
            while self.at(k) in ("|", "&") or (self.is_name(k) and self.at(k) in _TYPE_PREFIXES and (self.kind(k + 1) in ("name", "string", "number") or self.at(k + 1) in ("(", "[", "{", "<"))):
                k += 1
            if self.at(k) == "<":  # a function type with parameters of its own
                k = self._generic(k)
            if self.at(k) == "(" and self._is_function_type(k):
                k = self.close(k) + 1
                if self.at(k) != "=>":
                    return k
                k += 1
                continue
            if self.kind(k) == "op" and self.at(k) in ("(", "[", "{"):
                k = self.close(k) + 1
            elif self.kind(k) in ("string", "number"):
                k += 1
            elif self.at(k) == "-" and self.kind(k + 1) == "number":
                k += 2
            elif self.is_name(k):
                k = self.close(k + 1) + 1 if self.at(k) == "import" and self.at(k + 1) == "(" else k + 1
                while self.at(k) == "." and self.is_name(k + 1):
                    k += 2
                k = self._generic(k)
            else:
                return k
            while self.at(k) == "[" and self.kind(k) == "op":
                k = self.close(k) + 1
            if self.is_name(k) and self.at(k) == "extends":
                tests += 1
            elif self.at(k) == "?" and tests:
                tests, choices = tests - 1, choices + 1
            elif self.at(k) == ":" and choices:
                choices -= 1
            elif self.at(k) not in ("|", "&") and not (self.is_name(k) and self.at(k) == "is"):
                return k
            k += 1

    def _is_function_type(self, k: int) -> bool:
        """Whether the parenthesis at ``k`` of a type holds parameters, by their first one."""
        if self.at(k + 1) in (")", "..."):
            return True
        after = self.close(k + 1) + 1 if self.is_name(k + 1) or self.at(k + 1) in ("[", "{") else 0
        return self.at(after) in (":", "?:", ",", "?", "=") or (after == self.close(k) and self.at(after + 1) == "=>") if after else False

    def _typed_arrows(self) -> tuple[dict[int, int], set[int]]:
        """The parameters' closing parenthesis of each arrow after a result type, and the arrows within such types."""
        found, within = {}, set()
        generics = {end - 1: left for left, end in self.angles.items()}
        for close, left in sorted(self.openers.items()):
            if self.at(close) != ")" or self.at(close + 1) != ":":
                continue
            before = generics.get(left - 1, left) - 1
            before -= self.at(before) == "async"
            arrow = self._type_end(close + 2)
            if self.at(arrow) == "{" and self.is_name(before):  # of a function or method
                within.update(k for k in range(close + 2, arrow) if self.at(k) == "=>")
            if arrow == close + 2 or self.at(arrow) != "=>" or self.at(before) not in _BEFORE_ARROW or (self.at(before) == "?" and not self._has_else(arrow + 1)):
                continue
            found[arrow] = close
            within.update(k for k in range(close + 2, arrow) if self.at(k) == "=>")
        return found, within

    def _has_else(self, k: int) -> bool:
        """Whether the expression at ``k`` is followed by the colon of a ternary around it."""
        depth = 0
        while k < len(self.tokens) and self.at(k) not in (";", ",", ")", "]", "}"):
            depth += (self.at(k) == "?") - (self.at(k) == ":")
            if depth < 0:
                return True
            k = self.close(k) + 1 if self.at(k) in ("(", "[", "{") else k + 1
        return False

    def _assigned_name(self, i: int) -> str:
        """The name that a function expression at ``i`` is given by a declaration, key or member."""
        k = i - 1
        if self.at(k) == "async":
            k -= 1
        if self.at(k) == ":" and self.language == "javascript" and (self.is_name(k - 1) or self.kind(k - 1) == "string"):
            return self.at(k - 1).strip("'\"")
        if self.at(k) != "=":
            return self._anonymous()
        k -= 1
        if self.language == "typescript":
            back = k
            while back > 0 and self.at(back) not in (":", ";", "{", "}", "const", "let", "var"):
                back = self.open(back) - 1 if self.at(back) in (")", "]") else back - 1
            if self.at(back) == ":" and self.at(back - 2) in ("const", "let", "var"):
                k = back - 1
        if self.is_name(k) and (self.at(k - 1) in ("const", "let", "var", ",") or (self.language == "javascript" and self.at(k - 1) == ".")):
            return self.at(k)
        return self._anonymous()

    def _script(self, i: int) -> _Found | None:
        t = self.at(i)
        if t == "function" and self.is_name(i):
            k = i + 1
            if self.at(k) == "*":
                k += 1
            named = self.is_name(k)
            name = self.at(k) if named else self._assigned_name(i)
            k += named
            k = self._generic(k)
            if self.at(k) != "(":
                return None
            brace = self._after_type(self.close(k) + 1)
            if self.at(brace) != "{":
                return None
            body, end = self._bounds(brace)
            return _Found(name, i, (k + 1, self.close(k)), body, end)
        if t == "=>" and self.kind(i) == "op":
            if i in self.type_arrows:
                return None
            k = self.arrows.get(i, i - 1)
            if self.at(k) == ")":
                left = self.open(k)
                start, params, bare = left, (left + 1, k), None
                if self.at(left - 1) == ">":
                    back = left - 1
                    while back > 0 and self.at(back) != "<":
                        back -= 1
                    start = back
            elif self.is_name(k):
                start, params, bare = k, None, 1
            else:
                return None
            if i not in self.arrows and self.at(start - 1) == ":" and self.language == "typescript" and self.at(start - 2) != "?" and self._is_type_place(start - 1):
                return None
            body, end = self._arrow_body(i + 1)
            return _Found(self._assigned_name(start), start - (self.at(start - 1) == "async"), params, body, end, bare_params=bare)
        if self.is_name(i) and t not in _NOT_NAMES and self.at(i - 1) not in ("function", "new", ".", "?.", "*" if self.at(i - 2) == "function" else "\0"):
            k = self._generic(i + 1)
            if self.at(k) != "(":
                return None
            brace = self._after_type(self.close(k) + 1)
            if self.at(brace) != "{" or self.at(self.close(k) + 1) not in ("{", ":"):
                return None
            body, end = self._bounds(brace)
            return _Found(t, i, (k + 1, self.close(k)), body, end)
        return None

    def _is_type_place(self, colon: int) -> bool:
        """Whether a colon begins the type of a declaration rather than a key's value."""
        return self.is_name(colon - 1) and self.at(colon - 2) in ("(", ",", "const", "let", "var", "private", "public", "protected", "readonly", ";", "{") and self.at(self.open(colon - 2)) != "{"

    def _generic(self, k: int) -> int:
        """Past type parameters in angle brackets."""
        return self.angles.get(k, k)

    def _angles(self) -> dict[int, int]:
        """The index after each pair of angle brackets, by its opening one; other brackets between them are balanced."""
        ends: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in (";", ")", "]", "}") or (t.text == "{" and self.language != "typescript"):
                while stack and self.at(stack[-1]) == "<":
                    stack.pop()
            if t.text in ("<", "(", "[", "{"):
                stack.append(i)
            elif t.text == ">" and stack and self.at(stack[-1]) == "<":
                ends[stack.pop()] = i + 1
            elif i in self.openers:
                while stack and stack[-1] >= self.openers[i]:
                    stack.pop()
        return ends

    def _java(self, i: int) -> _Found | None:
        if self.at(i) == "->" and self.kind(i) == "op":
            return self._lambda(i)
        if not self.is_name(i) or self.at(i) in _NOT_NAMES or self.at(i - 1) in ("new", ".", "->"):
            return None
        if self.at(i + 1) == "{" and self.at(i - 1) in ("public", "private", "protected", "{", "}", ";") and self._is_record(i):
            body, end = self._bounds(i + 1)
            return _Found(self.at(i), self._line_start(i), (i + 1, i + 1), body, end)
        if self.at(i + 1) != "(" or self.at(i - 1) in ("record", "=", "(", ",", "return", "+", "&&", "||", "!"):
            return None
        k = self.close(i + 1) + 1
        if self.at(k) == "throws":
            while k < len(self.tokens) and self.at(k) not in ("{", ";"):
                k += 1
        if self.at(k) != "{" or not (self.is_name(i - 1) or self.at(i - 1) in (">", "]", "}", "{", ";", ")")):
            return None
        body, end = self._bounds(k)
        return _Found(self.at(i), self._line_start(i), (i + 2, self.close(i + 1)), body, end)

    def _is_record(self, i: int) -> bool:
        """Whether the braces around ``i`` are those of a record of the same name."""
        depth, k = 0, i - 1
        while k >= 0:
            if self.at(k) == "}":
                depth += 1
            elif self.at(k) == "{":
                if not depth:
                    break
                depth -= 1
            k -= 1
        while k >= 0 and self.at(k) not in (";", "}"):
            if self.at(k) == "record":
                return self.at(k + 1) == self.at(i)
            k = self.open(k) - 1 if self.at(k) == ")" else k - 1
        return False

    def _line_start(self, i: int) -> int:
        """The first token of the declaration that holds ``i``, modifiers and attributes included."""
        k = i
        while k > 0 and (self.is_name(k - 1) or self.at(k - 1) in ("<", ">", "]", "[", ",", ".", "*", "&", "?", "::", "@", ")", "(", "~") and self.at(k - 1) != ";"):
            if self.at(k - 1) == ")":
                left = self.open(k - 1)
                if not self.at(left - 1) or self.at(left - 2) != "@":
                    break
                k = left
                continue
            if self.at(k - 1) in ("(", ","):
                break
            k -= 1
        return k

    def _lambda(self, i: int) -> _Found | None:
        k = i - 1
        if self.at(k) == ")":
            left = self.open(k)
            start, params, bare = left, (left + 1, k), None
        elif self.is_name(k) and self.at(k - 1) not in ("case", ",") and self.at(k) != "default":
            start, params, bare = k, None, 1 if self.language == "csharp" else 0
        else:
            return None
        if self.language == "java" and self._in_case(start):
            return None
        body, end = self._arrow_body(i + 1)
        return _Found("<lambda>", start, params, body, end, closure=self.rules.closures, bare_params=bare)

    def _in_case(self, i: int) -> bool:
        """Whether an arrow belongs to a switch label."""
        k = i
        while k >= 0 and self.at(k) not in (";", "{", "}", "(", "="):
            if self.at(k) in ("case", "default") and self.is_name(k):
                return True
            k = self.open(k) - 1 if self.at(k) in (")", "]") else k - 1
        return False

    def _csharp(self, i: int) -> _Found | None:
        if self.at(i) == "delegate" and self.at(i + 1) in ("(", "{"):
            brace = i + 1 if self.at(i + 1) == "{" else self.close(i + 1) + 1
            if self.at(brace) != "{":
                return None
            body, end = self._bounds(brace)
            return _Found("<lambda>", i, (i + 2, self.close(i + 1)) if self.at(i + 1) == "(" else None, body, end, bare_params=0)
        if self.at(i) == "=>" and self.kind(i) == "op":
            k = i - 1
            if self.at(k) == ")":
                name = self._before_generic(self.open(k) - 1)
                if self.is_name(name) and self.at(name) not in _NOT_NAMES and self._is_type_end(name - 1):
                    return None  # an expression-bodied member, found by its name
                if self.at(self.open(k) - 1) == "]" or self._in_switch_arm(i):
                    return None
            elif self._in_switch_arm(i) or self.at(k - 1) in ("int", "string", "bool", "double", "long", "var", "object", "]", "?", ">") or (self.is_name(k - 1) and self.at(k - 1) not in ("return", "async", "await")):
                return None
            return self._lambda(i)
        if not self.is_name(i) or self.at(i) in _NOT_NAMES or self.at(i - 1) in ("new", ".", "?.", "return", "await", "throw", "=", "(", ",", "=>"):
            return None
        k = self._generic(i + 1)
        if self.at(k) != "(" or not (self._is_type_end(i - 1) or self.at(i - 1) in ("{", "}", ";", "]")):
            return None
        after = self.close(k) + 1
        if self.at(after) == ":" and self.at(after + 1) in ("base", "this"):
            after = self.close(after + 2) + 1
        while self.at(after) == "where":
            while after < len(self.tokens) and self.at(after) not in ("{", "=>", ";"):
                after += 1
        start = self._line_start(i)
        if self.at(after) == "{":
            body, end = self._bounds(after)
        elif self.at(after) == "=>":
            body, end = self._arrow_body(after + 1)
        else:
            return None
        if self.at(after) == "{" and self.at(i - 1) in ("{", "}", ";"):
            return None  # a call cannot be followed by a block, a name without a type isn't a member
        return _Found(self.at(i), start, (k + 1, self.close(k)), body, end)

    def _before_generic(self, k: int) -> int:
        if self.at(k) != ">":
            return k
        depth = 0
        while k > 0:
            depth += (self.at(k) == ">") - (self.at(k) == "<")
            k -= 1
            if depth <= 0:
                return k
        return k

    def _is_type_end(self, k: int) -> bool:
        return (self.is_name(k) and self.at(k) not in ("return", "await", "new", "throw", "else", "in", "case", "yield")) or self.at(k) in (">", "]", "?", "*")

    def _in_switch_arm(self, i: int) -> bool:
        """Whether an arrow stands in the braces of a switch expression."""
        depth, k = 0, i - 1
        while k >= 0:
            t = self.at(k)
            if t in (")", "]", "}"):
                k = self.open(k)
            elif t == "{":
                return self.at(k - 1) == "switch"
            elif t in ("(", ";"):
                return False
            k -= 1
        return bool(depth)

    def _c(self, i: int) -> _Found | None:
        if self.at(i) == "[" and self.at(i - 1) not in ("[",) and not (self.is_name(i - 1) and self.at(i - 1) not in ("return",)) and self.at(i - 1) not in (")", "]", "operator", "delete"):
            k = self.close(i) + 1
            params = None
            if self.at(k) == "(":
                params = (k + 1, self.close(k))
                k = self.close(k) + 1
            while self.at(k) in ("mutable", "noexcept", "constexpr") or (self.at(k) == "->" and self.at(i) == "["):
                k = self.brace_after(k, len(self.tokens)) if self.at(k) == "->" else k + 1
            if self.at(k) != "{":
                return None
            body, end = self._bounds(k)
            return _Found("<lambda>", i, params, body, end, closure=True, bare_params=None if params else 0)
        if self.at(i) != "{" or self.kind(i) != "op":
            return None
        k = i - 1
        while self.at(k) in ("const", "noexcept", "override", "final", "volatile", "&", "&&", "try"):
            k -= 1
        if self.is_name(k) and self._trailing_return(k) is not None:
            k = self._trailing_return(k) or k
            while self.at(k) in ("const", "noexcept", "override"):
                k -= 1
        k = self._before_initializers(k)
        while self.at(k) in ("const", "noexcept", "override", "final"):
            k -= 1
        if self.at(k) != ")":
            return None
        left = self.open(k)
        params = (left + 1, k)
        k = left - 1
        if self.at(k) == ")":  # a declarator in parentheses
            inner = self.open(k)
            names = [n for n in range(inner + 1, k) if self.is_name(n)]
            if not names:
                return None
            name = self.at(names[-1]) if self.at(names[-1] + 1) in ("(", ")") else self.at(names[0])
            return _Found(name, self._line_start(inner), params, *self._bounds(i))
        if self.at(k - 1) == "operator" or self.at(k - 2) == "operator":
            first = k - 1 if self.at(k - 1) == "operator" else k - 2
            name, k = "".join(self.at(n) for n in range(first, left)), first
        elif self.is_name(k) and self.at(k) not in _NOT_NAMES:
            name = self.at(k)
        else:
            return None
        if self.at(k - 1) == "~":
            name, k = "~" + name, k - 1
        while self.at(k - 1) == "::" and (self.is_name(k - 2) or self.at(k - 2) == ">"):
            scope = self._before_generic(k - 2)
            name, k = f"{''.join(self.at(n) for n in range(scope, k - 1))}::{name}", scope
        if self.at(k - 1) in ("=", "return", ",", "(", "new", ".", "->", "&&", "||", "!"):
            return None
        return _Found(name, self._line_start(k), params, *self._bounds(i))

    def _trailing_return(self, k: int) -> int | None:
        """From the end of a trailing result type back to the parameters, if there is one."""
        n = k
        while n > 0 and (self.is_name(n) or self.at(n) in ("::", "<", ">", "*", "&", ",")):
            n -= 1
        return n - 1 if self.at(n) == "->" else None

    def _before_initializers(self, k: int) -> int:
        """From the end of a constructor's initializer list back to its parameters."""
        n = k
        while self.at(n) in (")", "}") and self.is_name(self.open(n) - 1):
            head = self.open(n) - 1
            while self.at(head - 1) == "::":
                head -= 2
            if self.at(head - 1) == ",":
                n = head - 2
            elif self.at(head - 1) == ":" and self.at(head - 2) in (")", "noexcept"):
                return head - 2
            else:
                return k
        return k

    def _php(self, i: int) -> _Found | None:
        if self.at(i) not in ("function", "fn") or not self.is_name(i) or self.at(i - 1) in ("->", "::", "use"):
            return None
        k = i + 1
        if self.at(k) == "&":
            k += 1
        named = self.is_name(k) and self.at(i) == "function"
        name = self.at(k) if named else "<anonymous>"
        k += named
        if self.at(k) != "(":
            return None
        params = (k + 1, self.close(k))
        k = self.close(k) + 1
        if self.at(i) == "fn":
            while k < len(self.tokens) and self.at(k) != "=>":
                k += 1
            body, end = self._arrow_body(k + 1)
            return _Found(name, i, params, body, end, closure=True)
        while k < len(self.tokens) and self.at(k) not in ("{", ";"):
            k = self.close(k) + 1 if self.at(k) == "(" else k + 1
        if self.at(k) != "{":
            return None
        body, end = self._bounds(k)
        return _Found(name, i, params, body, end, closure=not named)

    def _rust(self, i: int) -> _Found | None:
        if self.at(i) == "fn" and self.is_name(i):
            if not self.is_name(i + 1):
                return None
            k = self._generic(i + 2)
            if self.at(k) != "(":
                return None
            params = (k + 1, self.close(k))
            brace = self.close(k) + 1
            while brace < len(self.tokens) and self.at(brace) not in ("{", ";"):
                brace = self.close(brace) + 1 if self.at(brace) in ("(", "[") else brace + 1
            if self.at(brace) != "{":
                return None
            body, end = self._bounds(brace)
            return _Found(self.at(i + 1), i, params, body, end)
        if self.at(i) in ("|", "||") and self.kind(i) == "op" and (self.at(i - 1) in ("(", ",", "=", "{", ";", "=>", "move", "return", "else", ":", "&&") or i == 0) and not self._in_pattern(i):
            stop = i
            if self.at(i) == "|":
                stop = i + 1
                while stop < len(self.tokens) and self.at(stop) != "|":
                    stop = self.close(stop) + 1 if self.at(stop) in ("(", "[") else stop + 1
                    if self.at(stop) in (";", "{", "=>"):
                        return None
            if stop >= len(self.tokens):
                return None
            k = stop + 1
            if self.at(k) == "->":
                k = self.brace_after(k, len(self.tokens))
            body, end = self._arrow_body(k)
            return _Found("<closure>", i, (i + 1, stop) if stop > i else None, body, end, closure=True, bare_params=0)
        return None

    def _in_pattern(self, i: int) -> bool:
        """Whether a bar separates patterns: an arrow follows before the next comma or end."""
        k = i
        while k < len(self.tokens) and self.at(k) not in (";", "}", "{", ",", ")"):
            if self.at(k) == "=>":
                return True
            k = self.close(k) + 1 if self.at(k) in ("(", "[") else k + 1
        return False

    def _kotlin(self, i: int) -> _Found | None:
        if self.at(i) == "fun" and self.is_name(i) and self.at(i + 1) != "interface":
            k = self._generic(i + 1)
            name = ""
            while k < len(self.tokens) and self.at(k) != "(":
                if self.is_name(k):
                    name = self.at(k)
                if self.kind(k) == "newline" or self.at(k) in ("{", "="):
                    return None
                k = self._generic(k) if self.at(k) == "<" and self._generic(k) > k else k + 1
            params = (k + 1, self.close(k))
            k = self.close(k) + 1
            while k < len(self.tokens) and self.at(k) not in ("{", "=") and self.kind(k) != "newline":
                k = self.close(k) + 1 if self.at(k) in ("(", "[") else k + 1
            if self.at(k) == "{":
                body, end = self._bounds(k)
            elif self.at(k) == "=":
                start = self.skip_lines(k + 1)
                stop = self.statement_end(start, len(self.tokens))
                body, end = (start, stop), stop
            else:
                return None
            return _Found(name or "<lambda>", i, params, body, end)
        if self.at(i) == "{" and self.kind(i) == "op" and self._is_kotlin_lambda(i):
            body, end = self._bounds(i)
            return _Found("<lambda>", i, None, body, end, closure=True, bare_params=0)
        return None

    def _is_kotlin_lambda(self, i: int) -> bool:
        k = i - 1
        if self.kind(k) == "newline":
            return False
        if self.at(k) in ("=", "(", ",", "->", "return", "?:"):
            return not (self.at(k) == "->" and self._when_arrow(k))
        if self.is_name(k):
            if self.at(k) in ("else", "try", "do", "finally", "object", "init", "companion", "interface", "when", "get", "set"):
                return False
            return not self._line_words(k) & {"class", "interface", "object", "fun", "enum", "constructor"}
        if self.at(k) == ")":
            left = self.open(k) - 1
            if self.at(left) in ("if", "while", "for", "when", "catch", "constructor"):
                return False
            return not self._line_words(left) & {"fun", "class", "object", "constructor"}
        return False

    def _line_words(self, k: int) -> set[str]:
        """The words of a line up to ``k``, without what stands in brackets."""
        found = set()
        while k >= 0 and self.kind(k) != "newline" and self.at(k) not in ("{", "}", ";", "="):
            if self.is_name(k):
                found.add(self.at(k))
            k = self.open(k) - 1 if self.at(k) in (")", "]") else k - 1
        return found

    def _when_arrow(self, k: int) -> bool:
        """Whether an arrow is one of a ``when``: the braces around it follow a ``when``."""
        depth = 0
        while k >= 0:
            t = self.at(k)
            if t == "}":
                depth += 1
            elif t == "{":
                if not depth:
                    before = self.previous(k)
                    if self.at(before) == ")":
                        before = self.open(before) - 1
                    return self.at(before) == "when"
                depth -= 1
            k -= 1
        return False

    def _swift(self, i: int) -> _Found | None:
        word = self.at(i)
        if self.is_name(i) and word in ("func", "init", "deinit") and self.at(i - 1) not in (".", "?."):
            k = i + 1
            name = word
            if word == "func":
                name = self.at(k)
                k += 1
                while self.kind(k) == "op" and self.at(k) not in ("(", "<"):
                    name, k = name + self.at(k), k + 1
            elif word == "init" and self.at(k) in ("?", "!"):
                k += 1
            k = self._generic(k)
            params = None
            if word == "deinit":
                if self.at(k) != "{":
                    return None
            elif self.at(k) == "(":
                params = (k + 1, self.close(k))
                k = self.close(k) + 1
            else:
                return None
            while k < len(self.tokens) and self.at(k) != "{" and not (self.kind(k) == "newline" and self.at(self.skip_lines(k)) not in ("{", "where", "->")):
                k = self.close(k) + 1 if self.at(k) in ("(", "[") else k + 1
            if self.at(k) != "{":
                return None
            body, end = self._bounds(k)
            return _Found(name, i, params, body, end, bare_params=0)
        if word == "{" and self.kind(i) == "op" and self._is_swift_closure(i):
            (start, stop), end = self._bounds(i)
            marker = start
            while marker < stop and self.at(marker) not in ("in", "{", "=", ";"):
                marker = self.close(marker) + 1 if self.at(marker) in ("(", "[") else marker + 1
            params = 0
            if self.at(marker) == "in" and marker < stop:
                first = self.skip_lines(start, stop)
                params = len(self.segments(first + 1, self.close(first))) if self.at(first) == "(" else len(self.segments(first, marker))
                if self.at(first) != "(":
                    params = 0  # names alone are no parameter nodes
            return _Found("<closure>", i, None, (start, stop), end, closure=True, bare_params=params)
        return None

    def _is_swift_closure(self, i: int) -> bool:
        k = i - 1
        if self.at(k) in ("=", "(", ",", ":", "return"):
            return True
        line = k
        while line >= 0 and self.kind(line) != "newline" and self.at(line) not in ("{", "}", ";"):
            line = self.open(line) - 1 if self.at(line) in (")", "]") else line - 1
        head = {self.at(n) for n in range(line + 1, i) if self.is_name(n)}
        if head & {"if", "guard", "for", "while", "switch", "func", "init", "deinit", "class", "struct", "enum", "extension", "protocol", "repeat", "else", "do", "catch", "var", "get", "set", "willSet", "didSet", "defer", "subscript", "actor"}:
            return "=" in {self.at(n) for n in range(line + 1, i)} and not head & {"if", "guard", "for", "while", "switch", "func", "init"} and self.at(k) == ")"
        return self.at(k) == ")" or (self.is_name(k) and self.at(k) not in ("in",))

    # --- results ----------------------------------------------------------------------------

    def count_params(self, f: _Found) -> int:
        if f.params is None:
            return f.bare_params or 0
        parts = self.segments(*f.params)
        text = lambda a, b: [self.at(n) for n in range(a, b) if self.kind(n) != "newline"]
        if self.language == "rust":
            return 0 if f.closure else sum(not ("self" in (w := text(a, b))[:4] and ":" not in w[:3]) for a, b in parts)
        if self.language == "c_cpp":
            return sum(text(a, b) != ["void"] for a, b in parts)
        if self.language in ("kotlin", "swift") and f.closure:
            return f.bare_params or 0
        if self.language == "typescript":
            return sum(text(a, b)[:1] != ["this"] for a, b in parts)
        return len(parts)

    def functions(self) -> list[Function]:
        out = []
        for f in self.found:
            first = self.tokens[f.start]
            last = self.tokens[min(max(f.end - 1, f.start), len(self.tokens) - 1)]
            end_line = last.line + last.text.count("\n")
            nodes: list[Node] = []
            depth = 0
            if f.closure and self.rules.closure_is_root:
                nodes.append(("Closure", 0))
                depth = 1
            self.walk(*f.body, depth, nodes)
            body = self._body_text(f)
            loc = {"none": 0, "whole": end_line - first.line + 1, "body": body.count("\n") + 1}[self.rules.loc]
            snippet = self.text[first.start : last.end] if self.language == "go" else body
            out.append(Function(f.name, first.line, end_line, self.count_params(f), loc, cut(snippet), nodes))
        return out

    def _body_text(self, f: _Found) -> str:
        a, b = f.body
        braced = self.at(a - 1) == "{" and self.kind(a - 1) == "op" and self.close(a - 1) == b
        lo, hi = (a - 1, min(b, len(self.tokens) - 1)) if braced else (a, max(a, b - 1))
        if lo >= len(self.tokens):
            return ""
        return self.text[self.tokens[lo].start : self.tokens[min(hi, len(self.tokens) - 1)].end]


MAX_SNIPPET = 10_000


def cut(snippet: str) -> str:
    """At most 10000 bytes, with dots where something is left out."""
    data = snippet.encode("utf-8", "surrogatepass")
    return snippet if len(data) <= MAX_SNIPPET else data[:MAX_SNIPPET].decode("utf-8", "ignore") + "..."


def functions(language: str, text: str) -> list[Function]:
    return Scanner(language, text).functions()
