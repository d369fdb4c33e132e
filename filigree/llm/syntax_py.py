"""Syntax of Python: recursive-descent statements over token kinds.

As in ``syntax_js``, a text becomes a string with one character per token.
Lines are put together to logical lines by their brackets; what a logical line
is depends on its kinds alone and is remembered.  Blocks are parsed by
recursive descent on indentation, expressions by precedence climbing.  After
an error in a line the parser goes on with the next line.
"""

from __future__ import annotations

import re

_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split()
_OPS = "** // << >> <= >= == != -> += -= *= /= %= &= |= ^= <<= >>= **= //= := ... @=".split()
W = {w: chr(0x100 + i) for i, w in enumerate(_WORDS)}
O = {o: chr(0x200 + i) for i, o in enumerate(_OPS)}  # noqa: E741
SOFT = W["match"] + W["case"] + W["type"] + W["_"]
NAME = "i" + SOFT
AUG = "".join(O[o] for o in _OPS if o.endswith("=") and o not in ("<=", ">=", "==", "!=", ":="))
END = "\0"
#: Precedence of binary operators; comparisons are 4, ``not`` is 3.
PREC = {W["or"]: 1, W["and"]: 2, W["in"]: 4, W["is"]: 4, W["not"]: 4, "<": 4, ">": 4, O["<="]: 4, O[">="]: 4, O["=="]: 4, O["!="]: 4, "|": 5, "^": 6, "&": 7, O["<<"]: 8, O[">>"]: 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "@": 10, O["//"]: 10, O["**"]: 12}
COMPARE = {c for c, n in PREC.items() if n == 4}

_PREFIX = r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"
_STRING = rf"{_PREFIX}(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^\\\n']|\\[\s\S])*'|\"(?!\"\")(?:[^\\\n\"]|\\[\s\S])*\")"
_NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w])"
_NEWLINE = r"(?:[ \t\f\r]*(?:#[^\n]*)?\n)+[ \t\f]*"
_OP = "|".join(re.escape(o) for o in sorted(_OPS, key=len, reverse=True)) + r"|[{}()\[\];,<>+\-*/%&|^~:=.@]"
_FAST = re.compile(rf"(?:[ \t\f\r]|\\\r?\n)*({_NEWLINE}|{_STRING}|(?:[^\W\d]|[^\x00-\x7f\s])(?:\w|[^\x00-\x7f\s])*|{_NUMBER}|{_OP}|#[^\n]*|[^\s])")


class Bad(Exception):
    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


def _width(indent: str) -> int:
    n = 0
    for c in indent:
        n = n // 8 * 8 + 8 if c == "\t" else 0 if c == "\f" else n + 1
    return n


class _Kinds(dict):
    def __init__(self) -> None:
        super().__init__(W | O | {c: c for c in "{}()[];,<>+-*/%&|^~:=.@"})

    def __missing__(self, tok: str) -> str:
        k = self.kind(tok)
        if len(self) > 200_000:
            self.__init__()
        if len(tok) < 60:
            self[tok] = k
        return k

    @staticmethod
    def kind(tok: str) -> str:
        if "\n" in tok and tok.strip(" \t\f\r\n")[:1] in ("", "#"):
            return "\n" + chr(0x4000 + min(2000, _width(tok[tok.rindex("\n") + 1 :])))
        c = tok[0]
        if c == "#":
            return ""
        if tok[-1] in "'\"" and len(tok) > 1:
            head = tok[: min(tok.find(q) for q in "'\"" if q in tok)].lower()
            if "f" in head or "t" in head:
                return "s" if fstring_ok(tok[len(head) :], "r" in head) else "E"
            return "b" if "b" in head else "s"
        if c.isdigit() or c == "." and len(tok) > 1:
            return "0" if re.fullmatch(_NUMBER, tok) and not re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", tok) else "E"
        if tok.isidentifier():
            return "i"
        return "E"


_TABLE = _Kinds()
_FIELD = re.compile(r"\{\{|\}\}|\{|\}")


def fstring_ok(body: str, raw: bool) -> bool:
    """Whether the replacement fields of an f-string are expressions (quotes still around it)."""
    q = 3 if body[:3] in ("'''", '"""') and len(body) >= 6 else 1
    return _fields(body[q:-q], 0)


def _fields(s: str, level: int) -> bool:
    at = 0
    while True:
        m = _FIELD.search(s, at)
        if not m:
            return True
        if m.group() in ("{{", "}}") and level == 0:
            at = m.end()
            continue
        if m.group()[0] == "}":
            return False
        i, depth, quote = m.start() + 1, 0, ""
        while i < len(s):
            c = s[i]
            if quote:
                if s.startswith(quote, i):
                    i += len(quote) - 1
                    quote = ""
            elif c in "'\"":
                quote = s[i : i + 3] if s[i : i + 3] in ("'''", '"""') else c
                i += len(quote) - 1
            elif c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            elif not depth and (c == "}" or c == ":" or c == "!" and s[i + 1 : i + 2] != "="):
                break
            i += 1
        else:
            return False
        expr = s[m.start() + 1 : i].strip()
        if re.search(r"[^=!<>]=$", expr):
            expr = expr[:-1]
        if not expr or not expression_ok(expr):
            return False
        if s[i] == "!":
            if not re.match(r"![rsa]\s*[:}]", s[i:]):
                return False
            i = next(j for j in range(i, len(s)) if s[j] in ":}")
        if s[i] == ":":
            j, depth = i + 1, 0
            while j < len(s) and (depth or s[j] != "}"):
                depth += (s[j] == "{") - (s[j] == "}")
                j += 1
            if j >= len(s) or not _fields(s[i + 1 : j], level + 1):
                return False
            i = j
        at = i + 1


_EXPR: dict = {}


def expression_ok(text: str) -> bool:
    ok = _EXPR.get(text)
    if ok is None:
        if len(_EXPR) > 50_000:
            _EXPR.clear()
        line = re.sub(r"\n[\s\S]", "", "".join(_TABLE[t] for t in _FAST.findall(text)))
        p = Line(line)
        try:
            ok = p.k[p.yielding(0)] == END
        except Bad:
            ok = False
        _EXPR[text] = ok
    return ok


_SIMPLE = re.compile(rf"(?:i(?:\.i)*|[0s{W['None']}{W['True']}{W['False']}])(?=[,)\]}}:=;\0])")


class Line:
    """One logical line."""

    def __init__(self, kinds: str):
        self.k = kinds + END * 3
        self.atom = ""

    def need(self, p: int, c: str) -> int:
        if self.k[p] != c:
            raise Bad(p, "invalid syntax")
        return p + 1

    # -- statements -------------------------------------------------------
    def parse(self) -> str:
        """The kind of the line: '' for simple statements, else the compound keyword; '+' marks a suite on the line."""
        k, p, c = self.k, 0, self.k[0]
        prefix = ""
        if c == W["async"] and k[1] in (W["def"], W["for"], W["with"]):
            p, c = 1, k[1]
        if c == W["case"] and k[1] not in _NOT_SUBJECT:
            try:
                return self._suite(self.patterns(1), "case")
            except Bad:
                pass
        if c == W["match"] and k[1] not in _NOT_SUBJECT:
            try:
                q = self.star_expressions(1)
                if k[q] == ":" and k[q + 1] == END:
                    return "match"
            except Bad:
                pass
        word = _COMPOUND.get(c)
        if word is None:
            if c == "@":
                if k[self.named(1)] != END:
                    raise Bad(self.named(1), "invalid syntax")
                return "@"
            self.simple_line(0)
            return prefix
        return self._suite(getattr(self, f"_{word}")(p + 1), word)

    def _suite(self, p: int, word: str) -> str:
        p = self.need(p, ":") if self.k[p] == ":" else self._no_colon(p)
        if self.k[p] == END:
            return word
        self.simple_line(p)
        return word + "+"

    def _no_colon(self, p: int) -> int:
        raise Bad(p, "expected ':'")

    def _if(self, p: int) -> int:
        return self.named(p)

    _elif = _while = _if

    def _else(self, p: int) -> int:
        return p

    _try = _finally = _else

    def _for(self, p: int) -> int:
        p = self.targets(p)
        return self.star_expressions(self.need(p, W["in"]))

    def _except(self, p: int) -> int:
        k = self.k
        if k[p] == ":":
            return p
        if k[p] == "*":
            p += 1
        p = self.test(p)
        while k[p] == ",":  # bare lists are rejected by Python 3.13
            raise Bad(p, "multiple exception types must be parenthesized")
        if k[p] == W["as"]:
            if k[p + 1] not in NAME:
                raise Bad(p + 1, "invalid syntax")
            p += 2
        return p

    def _with(self, p: int) -> int:
        k = self.k
        if k[p] == "(":
            try:
                q = self.with_items(p + 1, ")")
                if k[q] == ")" and k[q + 1] == ":":
                    return q + 1
            except Bad:
                pass
        return self.with_items(p, ":")

    def with_items(self, p: int, end: str) -> int:
        k = self.k
        while True:
            p = self.test(p)
            if k[p] == W["as"]:
                p = self.target(p + 1)
            if k[p] != ",":
                return p
            p += 1
            if end == ")" and k[p] == end:
                return p

    def _class(self, p: int) -> int:
        if self.k[p] not in NAME:
            raise Bad(p, "invalid syntax")
        p = self.type_params(p + 1)
        return self.arguments(p) if self.k[p] == "(" else p

    def _def(self, p: int) -> int:
        if self.k[p] not in NAME:
            raise Bad(p, "invalid syntax")
        p = self.type_params(p + 1)
        p = self.need(p, "(") if self.k[p] == "(" else self._no_paren(p)
        p = self.need(self.parameters(p, ")", True), ")")
        if self.k[p] == O["->"]:
            p = self.star_expressions(p + 1)
        return p

    def _no_paren(self, p: int) -> int:
        raise Bad(p, "expected '('")

    def type_params(self, p: int) -> int:
        k = self.k
        if k[p] != "[":
            return p
        p += 1
        while True:
            while k[p] in ("*", O["**"]):
                p += 1
            if k[p] not in NAME:
                raise Bad(p, "invalid syntax")
            p += 1
            if k[p] == ":":
                p = self.test(p + 1)
            if k[p] == "=":
                p = self.star_or_test(p + 1)
            if k[p] == ",":
                p += 1
                if k[p] == "]":
                    return p + 1
            elif k[p] == "]":
                return p + 1
            else:
                raise Bad(p, "invalid syntax")

    def parameters(self, p: int, end: str, annotated: bool) -> int:
        k = self.k
        default = star = False
        while k[p] != end:
            c = k[p]
            if c == "/":
                p += 1
            elif c in ("*", O["**"]):
                p += 1
                if c == "*" and k[p] == ",":
                    star = True
                    if k[p + 1] == end or k[p + 1] == O["**"]:
                        raise Bad(p, "named arguments must follow bare *")
                else:
                    star = True
                    if k[p] not in NAME:
                        raise Bad(p, "invalid syntax")
                    p += 1
                    if annotated and k[p] == ":":
                        p = self.star_or_test(p + 1)
                    if c == O["**"]:
                        return p + 1 if k[p] == "," else p
            elif c in NAME:
                p += 1
                if annotated and k[p] == ":":
                    p = self.test(p + 1)
                if k[p] == "=":
                    p, default = self.test(p + 1), True
                elif default and not star:
                    raise Bad(p, "parameter without a default follows parameter with a default")
            else:
                raise Bad(p, "invalid syntax")
            if k[p] == ",":
                p += 1
            elif k[p] != end:
                raise Bad(p, "invalid syntax")
        return p

    def simple_line(self, p: int) -> None:
        k = self.k
        while True:
            p = self.simple(p)
            if k[p] == END:
                return
            p = self.need(p, ";")
            if k[p] == END:
                return

    def simple(self, p: int) -> int:
        k, c = self.k, self.k[p]
        if c in _BARE:
            return p + 1
        rule = _SIMPLE_RULES.get(c)
        if rule is not None:
            return rule(self, p + 1)
        if c == W["type"] and k[p + 1] in NAME and k[p + 2] in "=[":
            return self.test(self.need(self.type_params(p + 2), "="))
        if c in _KEYWORDS:
            raise Bad(p, "invalid syntax")
        # expression, assignments, annotation
        start, q = p, self.yielding(p)
        c = k[q]
        if c == "=":
            while k[q] == "=":
                self.assignable(start, q)
                start = q + 1
                q = self.yielding(start)
            return q
        if c in AUG:
            self.assignable(start, q, single=True)
            return self.yielding(q + 1)
        if c == ":":
            self.assignable(start, q, single=True)
            q = self.test(q + 1)
            if k[q] == "=":
                q = self.yielding(q + 1)
        return q

    def assignable(self, a: int, b: int, single: bool = False) -> None:
        """Whether the expression between a and b can be assigned to."""
        q = self.targets(a) if not single else self.target(a)
        if q != b:
            raise Bad(a, "cannot assign to expression")

    def targets(self, p: int) -> int:
        k = self.k
        p = self.target(p)
        while k[p] == ",":
            if k[p + 1] not in NAME + "([*0s{" + _ATOM_WORDS:
                return p + 1
            p = self.target(p + 1)
        return p

    def target(self, p: int) -> int:
        """Name, attribute, subscript, or a list or tuple of targets."""
        k = self.k
        if k[p] == "*":
            p += 1
        c = k[p]
        if c in "([":
            # a parenthesised list of targets, or an expression that a trailer follows
            try:
                q, end = p + 1, ")" if c == "(" else "]"
                if k[q] != end:
                    q = self.targets(q)
                if k[q] == end and k[q + 1] not in "([.":
                    return q + 1
            except Bad:
                pass
        q = self.primary(p)
        if c in NAME and q == p + 1:
            return q
        if q > p + 1 and self.last in ".[":
            return q
        raise Bad(p, "cannot assign to expression")

    def _return(self, p: int) -> int:
        return p if self.k[p] in ";" + END else self.star_expressions(p)

    def _raise(self, p: int) -> int:
        if self.k[p] in ";" + END:
            return p
        p = self.test(p)
        return self.test(p + 1) if self.k[p] == W["from"] else p

    def _global(self, p: int) -> int:
        while True:
            if self.k[p] not in NAME:
                raise Bad(p, "invalid syntax")
            p += 1
            if self.k[p] != ",":
                return p
            p += 1

    def _del(self, p: int) -> int:
        k = self.k
        p = self.target(p)
        while k[p] == ",":
            if k[p + 1] in ";" + END:
                return p + 1
            p = self.target(p + 1)
        return p

    def _assert(self, p: int) -> int:
        p = self.test(p)
        return self.test(p + 1) if self.k[p] == "," else p

    def dotted(self, p: int) -> int:
        k = self.k
        while True:
            if k[p] not in NAME:
                raise Bad(p, "invalid syntax")
            p += 1
            if k[p] != ".":
                return p
            p += 1

    def _import(self, p: int) -> int:
        k = self.k
        while True:
            p = self.dotted(p)
            if k[p] == W["as"]:
                if k[p + 1] not in NAME:
                    raise Bad(p + 1, "invalid syntax")
                p += 2
            if k[p] != ",":
                return p
            p += 1

    def _from(self, p: int) -> int:
        k = self.k
        dots = 0
        while k[p] in (".", O["..."]):
            p, dots = p + 1, dots + 1
        if k[p] != W["import"] or not dots:
            p = self.dotted(p)
        p = self.need(p, W["import"])
        if k[p] == "*":
            return p + 1
        closed = k[p] == "("
        p += closed
        while True:
            if k[p] not in NAME:
                raise Bad(p, "invalid syntax")
            p += 1
            if k[p] == W["as"]:
                if k[p + 1] not in NAME:
                    raise Bad(p + 1, "invalid syntax")
                p += 2
            if k[p] == ",":
                p += 1
                if closed and k[p] == ")":
                    return p + 1
            else:
                return self.need(p, ")") if closed else p

    # -- patterns -----------------------------------------------------------
    def patterns(self, p: int) -> int:
        k = self.k
        p = self.pattern(p)
        while k[p] == ",":
            p += 1
            if k[p] in ":" + W["if"]:
                break
            p = self.pattern(p)
        return self.named(p + 1) if k[p] == W["if"] else p

    def pattern(self, p: int) -> int:
        k = self.k
        if k[p] == "*":
            if k[p + 1] not in NAME:
                raise Bad(p + 1, "invalid syntax")
            return p + 2
        p = self.closed_pattern(p)
        while k[p] == "|":
            p = self.closed_pattern(p + 1)
        if k[p] == W["as"]:
            if k[p + 1] not in NAME:
                raise Bad(p + 1, "invalid syntax")
            p += 2
        return p

    def closed_pattern(self, p: int) -> int:
        k, c = self.k, self.k[p]
        if c in "sb":
            while k[p] in "sb":
                p += 1
            return p
        if c in "0-":
            p += c == "-"
            p = self.need(p, "0")
            return self.need(p + 1, "0") if k[p] in "+-" else p
        if c in (W["None"], W["True"], W["False"]):
            return p + 1
        if c in "([":
            end = ")" if c == "(" else "]"
            p += 1
            while k[p] != end:
                p = self.pattern(p)
                if k[p] == ",":
                    p += 1
                elif k[p] != end:
                    raise Bad(p, "invalid syntax")
            return p + 1
        if c == "{":
            p += 1
            while k[p] != "}":
                if k[p] == O["**"]:
                    p += 2
                else:
                    p = self.pattern(self.need(self.closed_pattern(p), ":"))
                if k[p] == ",":
                    p += 1
                elif k[p] != "}":
                    raise Bad(p, "invalid syntax")
            return p + 1
        p = self.dotted(p)
        if k[p] == "(":
            p += 1
            while k[p] != ")":
                if k[p] in NAME and k[p + 1] == "=":
                    p += 2
                p = self.pattern(p)
                if k[p] == ",":
                    p += 1
                elif k[p] != ")":
                    raise Bad(p, "invalid syntax")
            p += 1
        return p

    # -- expressions ----------------------------------------------------------
    def yielding(self, p: int) -> int:
        k = self.k
        if k[p] != W["yield"]:
            return self.star_expressions(p)
        if k[p + 1] == W["from"]:
            return self.test(p + 2)
        return p + 1 if k[p + 1] in ")]}=;" + END else self.star_expressions(p + 1)

    def star_expressions(self, p: int) -> int:
        k = self.k
        p = self.star_or_named(p)
        while k[p] == ",":
            p += 1
            if k[p] in _STOPS:
                return p
            p = self.star_or_named(p)
        return p

    def star_or_test(self, p: int) -> int:
        return self.binary(p + 1, 4) if self.k[p] == "*" else self.test(p)

    def star_or_named(self, p: int) -> int:
        return self.binary(p + 1, 4) if self.k[p] == "*" else self.named(p)

    def named(self, p: int) -> int:
        if self.k[p] in NAME and self.k[p + 1] == O[":="]:
            return self.test(p + 2)
        return self.test(p)

    def test(self, p: int) -> int:
        k = self.k
        m = _SIMPLE.match(k, p)
        if m:
            return m.end()
        if k[p] == W["lambda"]:
            p = self.need(self.parameters(p + 1, ":", False), ":")
            return self.test(p)
        p = self.binary(p, 0)
        if k[p] == W["if"]:
            q = self.binary(p + 1, 0)
            return self.test(self.need(q, W["else"]))
        return p

    def binary(self, p: int, least: int) -> int:
        k = self.k
        p = self.unary(p, least)
        while True:
            c = k[p]
            prec = PREC.get(c)
            if prec is None or prec <= least:
                return p
            width = 1
            if c == W["not"]:
                if k[p + 1] != W["in"]:
                    return p
                width = 2
            elif c == W["is"] and k[p + 1] == W["not"]:
                width = 2
            if prec == 12:
                p = self.unary(p + 1, 10)
            else:
                p = self.binary(p + width, prec)

    def unary(self, p: int, least: int) -> int:
        k, c = self.k, self.k[p]
        if c == W["not"]:
            if least > 3:
                raise Bad(p, "invalid syntax")
            return self.binary(p + 1, 3)
        if c in "+-~":
            return self.binary(p + 1, 11)
        if c == W["await"]:
            return self.primary(p + 1)
        return self.primary(p)

    def primary(self, p: int) -> int:
        k = self.k
        p = self.atom_at(p)
        self.last = ""
        while True:
            c = k[p]
            if c == ".":
                if k[p + 1] not in NAME:
                    raise Bad(p + 1, "invalid syntax")
                p += 2
            elif c == "(":
                p = self.arguments(p)
            elif c == "[":
                p = self.slices(p + 1)
            else:
                return p
            self.last = c

    def atom_at(self, p: int) -> int:
        k, c = self.k, self.k[p]
        if c in NAME or c in "0" or c in _ATOM_WORDS or c == O["..."]:
            return p + 1
        if c in "sb":
            p += 1
            while k[p] in "sb":
                if k[p] != c:
                    raise Bad(p, "cannot mix bytes and nonbytes literals")
                p += 1
            return p
        if c == "(":
            if k[p + 1] == ")":
                return p + 2
            if k[p + 1] == W["yield"]:
                return self.need(self.yielding(p + 1), ")")
            return self.group(p + 1, ")")
        if c == "[":
            return p + 2 if k[p + 1] == "]" else self.group(p + 1, "]")
        if c == "{":
            return self.braces(p + 1)
        raise Bad(p, "invalid syntax")

    def group(self, p: int, end: str) -> int:
        k = self.k
        starred = k[p] == "*"
        p = self.star_or_named(p)
        if k[p] in (W["for"], W["async"]):
            if starred:
                raise Bad(p, "iterable unpacking cannot be used in comprehension")
            return self.need(self.comprehension(p), end)
        if starred and end == ")" and k[p] == end:
            raise Bad(p, "cannot use starred expression here")
        while k[p] == ",":
            p += 1
            if k[p] == end:
                return p + 1
            p = self.star_or_named(p)
        return self.need(p, end)

    def comprehension(self, p: int) -> int:
        k = self.k
        while k[p] in (W["for"], W["async"]):
            if k[p] == W["async"]:
                p = self.need(p + 1, W["for"]) - 1
            p = self.need(self.targets(p + 1), W["in"])
            p = self.binary(p, 0) if k[p] != W["lambda"] else self.test(p)
            while k[p] == W["if"]:
                p = self.named(p + 1) if k[p + 1] in NAME and k[p + 2] == O[":="] else self.binary(p + 1, 0)
        return p

    def braces(self, p: int) -> int:
        k = self.k
        if k[p] == "}":
            return p + 1
        first = True
        is_dict = None
        while True:
            if k[p] == O["**"]:
                p = self.binary(p + 1, 4)
                kind = True
            elif k[p] == "*":
                p, kind = self.binary(p + 1, 4), False
            else:
                p, kind = self.named(p), False
                if k[p] == ":":
                    p, kind = self.test(p + 1), True
            if is_dict is None:
                is_dict = kind
            elif is_dict != kind:
                raise Bad(p, "invalid syntax")
            if first and k[p] in (W["for"], W["async"]):
                return self.need(self.comprehension(p), "}")
            first = False
            if k[p] == ",":
                p += 1
                if k[p] == "}":
                    return p + 1
            else:
                return self.need(p, "}")

    def arguments(self, p: int) -> int:
        k = self.k
        p += 1
        keyword = unpacked = False
        first = p
        while k[p] != ")":
            if k[p] == O["**"]:
                p, unpacked = self.test(p + 1), True
            elif k[p] == "*":
                if unpacked:
                    raise Bad(p, "iterable argument unpacking follows keyword argument unpacking")
                p = self.test(p + 1)
            elif k[p] in NAME and k[p + 1] == "=":
                p, keyword = self.test(p + 2), True
            else:
                start = p
                p = self.named(p)
                if k[p] in (W["for"], W["async"]):
                    p = self.comprehension(p)
                    if k[p] != ")" and not (k[p] == "," and k[p + 1] == ")" and start == first) or start != first:
                        raise Bad(p, "generator expression must be parenthesized")
                elif keyword or unpacked:
                    raise Bad(start, "positional argument follows keyword argument")
            if k[p] == ",":
                p += 1
            elif k[p] != ")":
                raise Bad(p, "invalid syntax")
        return p + 1

    def slices(self, p: int) -> int:
        k = self.k
        if k[p] == "]":
            raise Bad(p, "invalid syntax")
        while k[p] != "]":
            if k[p] == "*":
                p = self.binary(p + 1, 4)
            else:
                for i in range(3):
                    if k[p] not in ":,]":
                        p = self.named(p)
                    if k[p] != ":" or i == 2:
                        break
                    p += 1
            if k[p] == ",":
                p += 1
            elif k[p] != "]":
                raise Bad(p, "invalid syntax")
        return p + 1


_KEYWORDS = "".join(W[w] for w in "and as break class continue def del elif else except finally for from global if import in is nonlocal or pass raise return try while with".split())
_ATOM_WORDS = W["None"] + W["True"] + W["False"]
_STOPS = ")]}:=;" + END + AUG
_BARE = W["pass"] + W["break"] + W["continue"]
_NOT_SUBJECT = "=.,)]:;" + END + AUG
_COMPOUND = {W[w]: w for w in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "class", "def")}
_SIMPLE_RULES = {W[w]: getattr(Line, f"_{w}") for w in ("return", "raise", "global", "del", "assert", "import", "from")} | {W["nonlocal"]: Line._global}
# what may follow a block of one kind at the same depth
_AFTER = {"if": ("elif", "else"), "elif": ("elif", "else"), "for": ("else",), "while": ("else",), "try": ("except", "finally"), "except": ("except", "else", "finally"), "else": ("finally",)}

_MEMO: dict = {}


def line_kind(kinds: str) -> tuple[str, int, str]:
    """(what the logical line is, -1, '') or ('', position of the error, text)."""
    r = _MEMO.get(kinds)
    if r is None:
        if len(_MEMO) > 400_000:
            _MEMO.clear()
        try:
            r = (Line(kinds).parse(), -1, "") if "E" not in kinds else ("", kinds.index("E"), "invalid or unterminated token")
        except Bad as e:
            r = ("", e.at, e.what)
        except RecursionError:
            r = ("", 0, "nested too deeply")
        _MEMO[kinds] = r
    return r


_DEPTH: dict = {}


def _depth(kinds: str) -> int:
    d = _DEPTH.get(kinds)
    if d is None:
        if len(_DEPTH) > 400_000:
            _DEPTH.clear()
        d = _DEPTH[kinds] = sum(map(kinds.count, "([{")) - sum(map(kinds.count, ")]}"))
    return d


_FSTART = re.compile(r"(?i)(?:f|fr|rf|t|tr|rt)(\'\'\'|\"\"\"|\'|\")")
_CONVERSION = re.compile(r"![rsa]\s*(?=[:}])")
_PLAIN = re.compile(_STRING)


def _plain(quote: str, n: int) -> str:
    """A string literal of ``n`` characters."""
    return quote + "_" * (n - 2 * len(quote)) + quote


def _string_end(s: str, i: int, quote: str) -> int | None:
    """The end of an f-string whose body begins at ``i``, by recursive descent into its fields; None if it is broken."""
    while i < len(s):
        if s.startswith(quote, i):
            return i + len(quote)
        c, two = s[i], s[i : i + 2]
        if c == "\n" and len(quote) == 1:
            return None
        if c == "\\":
            i += 1 if s[i + 1 : i + 2] in ("{", "}") else 2
            if s[i - 1 : i + 1] == "N{" and "}" in s[i:]:
                i = s.index("}", i) + 1
        elif two in ("{{", "}}"):
            i += 2
        elif c == "{":
            i = _field_end(s, i + 1, quote)
            if i is None:
                return None
        elif c == "}":
            return None
        else:
            i += 1
    return None


def _field_end(s: str, start: int, quote: str) -> int | None:
    """The end of a replacement field whose expression begins at ``start``."""
    i, depth, at, flat = start, 0, start, []
    while i < len(s):
        c = s[i]
        f = _FSTART.match(s, i) if not (s[i - 1].isalnum() or s[i - 1] == "_") else None
        if f:
            end = _string_end(s, f.end(), f.group(1))
            if end is None:
                return None
            # it has been looked into: what is around it sees a plain string
            flat += [s[at:i], _plain(f.group(1), end - i)]
            at = i = end
            continue
        plain = _PLAIN.match(s, i) if c in "'\"" else None
        if plain:
            i = plain.end()
            continue
        if c in "'\"":
            return None
        if c == "#":
            i = s.find("\n", i)
            if i < 0:
                return None
            continue
        if not depth and (c in "}:" or c == "!" and s[i + 1 : i + 2] != "="):
            break
        depth += (c in "([{") - (c in ")]}")
        i += 1
    else:
        return None
    expr = re.sub(r"(?<![=!<>])=\s*$", "", "".join([*flat, s[at:i]])).strip()
    if not expr or not expression_ok(expr):
        return None
    if s[i] == "!":
        m = _CONVERSION.match(s, i)
        if not m:
            return None
        i = m.end()
    if s[i] == ":":
        i += 1
        while i < len(s) and s[i] != "}":
            if s.startswith(quote, i) or s[i] == "\n" and len(quote) == 1:
                return None
            i = _field_end(s, i + 1, quote) if s[i] == "{" else i + 1
            if i is None:
                return None
    return i + 1 if i < len(s) else None


def unnested(text: str) -> str:
    """``text`` with every f-string that has its own quotes inside its fields as a plain string of the same length.

    Only such whose fields are expressions are replaced, so that a broken one
    still shows.
    """
    out, at, i = [], 0, 0
    while m := _FAST.match(text, i):
        i, start = m.end(), m.start(1)
        f = _FSTART.match(text, start)
        end = _string_end(text, f.end(), f.group(1)) if f else None
        if end is not None and end != m.end(1):
            q = f.group(1)
            body = text[start + len(q) : end - len(q)]
            out += [text[at:start], q, re.sub(r"[^\n]", "_", body) if len(q) == 3 else "_" * len(body), q]
            at = i = end
    return "".join([*out, text[at:]])


def logical_lines(text: str) -> list[tuple[int, str, int]]:
    """(indentation, kinds, number of the first physical piece) of every logical line."""
    kinds = "".join([_TABLE[t] for t in _FAST.findall(text if text[:1] in "\n" else "\n" + text)])
    out, held, indent, first, depth = [], "", 0, 0, 0
    for n, piece in enumerate(kinds.split("\n")):
        if n == 0:
            if piece:
                return [(0, "E", 0)]
            continue
        width, line = ord(piece[0]) - 0x4000, piece[1:]
        if not held:
            indent, first = width, n
        held += line
        depth += _depth(line)
        if depth <= 0:
            if held:
                out.append((indent, held, first))
            held, depth = "", 0
    if held:
        out.append((indent, held, first))
    return out


def problems(text: str) -> list[tuple[int, str]]:
    """All errors as (index of the logical line's first piece, text)."""
    text = text.removeprefix("﻿")
    if not text.endswith("\n"):
        text += "\n"
    lines = logical_lines(text)
    found: list[tuple[int, str]] = []
    stack, want, deco = [0], False, False  # indentation levels; a block is due; a decorated definition is due
    last: dict[int, str] = {}  # the latest block keyword at each level
    match_levels: set[int] = set()
    for indent, kinds, n in lines:
        what, at, why = line_kind(kinds)
        if want:
            if indent > stack[-1]:
                stack.append(indent)
                last[len(stack)] = ""
            else:
                found.append((n, "expected an indented block"))
        elif indent > stack[-1]:
            found.append((n, "unexpected indent"))
            stack.append(indent)
            last[len(stack)] = ""
        if indent < stack[-1]:
            while indent < stack[-1]:
                if last.get(len(stack)) == "try":
                    found.append((n, "expected 'except' or 'finally' block"))
                last.pop(len(stack), None)
                match_levels.discard(len(stack))
                stack.pop()
            if indent > stack[-1]:
                found.append((n, "unindent does not match any outer indentation level"))
                stack.append(indent)
        level = len(stack)
        if at >= 0:
            found.append((n, why))
        word = what.rstrip("+")
        before = last.get(level, "")
        if word in ("elif", "else", "except", "finally") and word not in _AFTER.get(before, ()):
            # the else of a try comes after except, the else of a loop after for
            found.append((n, "invalid syntax"))
        elif before == "try" and word not in ("except", "finally"):
            found.append((n, "expected 'except' or 'finally' block"))
        if word == "case" and level not in match_levels:
            found.append((n, "invalid syntax"))
        elif level in match_levels and word != "case":
            found.append((n, "expected case"))
        if deco and word not in ("def", "class", "@"):
            found.append((n, "expected a definition after a decorator"))
        deco = word == "@"
        if word == "else":
            # only a try's else may be followed by finally
            word_after = "else" if before == "except" else ""
        else:
            word_after = word if word in _AFTER else ""
        last[level] = word_after
        want = bool(what) and not what.endswith("+") and what != "@"
        if what == "match":
            match_levels.add(level + 1)
    if want:
        found.append((lines[-1][2], "expected an indented block at the end"))
    if deco:
        found.append((lines[-1][2], "expected a definition after a decorator"))
    for level in range(len(stack), 0, -1):
        if last.get(level) == "try":
            found.append((lines[-1][2], "expected 'except' or 'finally' block"))
            break
    return found


def accepts(text: str) -> bool:
    if "\0" in text:
        return False
    if not problems(text):
        return True
    flat = unnested(text)
    return flat != text and not problems(flat)


def errors(text: str) -> list[tuple[int, str]]:
    """All errors as (offset of the line in the text, message)."""
    text = unnested(text)
    starts = [0]
    source = text.removeprefix("﻿")
    shift = 0 if source[:1] == "\n" else -1
    for m in _FAST.finditer(source if shift == 0 else "\n" + source):
        tok = m.group(1)
        if "\n" in _TABLE[tok]:
            starts.append(max(0, m.end() + shift))
    return [(starts[min(n, len(starts) - 1)], e) for n, e in problems(text)]
