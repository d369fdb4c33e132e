"""Syntax of JavaScript and TypeScript: recursive-descent statements over token kinds.

A text becomes a string with one character per token, its *kinds*: all names
are ``i``, all numbers ``0``, every keyword and operator has a character of its
own.  Statements are parsed by recursive descent and expressions by precedence
climbing on that string.  As acceptance depends on the kinds alone, a statement
once parsed is remembered by its kinds, for all files a worker sees.

After an error the parser skips to the next statement (panic mode) and goes on,
so all errors of a text are found.  Names, types and early errors that need
scopes are not looked at.
"""

from __future__ import annotations

import re

_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with let static yield await async of as satisfies type interface namespace module declare "
    "abstract readonly private protected public override implements get set keyof infer is asserts unique require global from accessor out using"
).split()
_OPS = "=== !== == != <= && || ?? => ... ?. ++ -- ** << += -= *= /= %= &= |= ^= **= <<= &&= ||= ??=".split()
#: Character of each keyword and operator.
W = {w: chr(0x100 + i) for i, w in enumerate(_WORDS)}
O = {o: chr(0x200 + i) for i, o in enumerate(_OPS)}  # noqa: E741
_SOFT = _WORDS[_WORDS.index("let") :]
SOFT = "".join(W[w] for w in _SOFT)  # usable as names
#: Kinds that are names, and kinds that may follow a dot or be a property key.
NAME = "i" + SOFT
ANYWORD = "i" + "".join(W.values())
ARROW, SPREAD, QDOT, INC, DEC = O["=>"], O["..."], O["?."], O["++"], O["--"]
ASSIGN = "=" + "".join(O[o] for o in _OPS if o.endswith("=") and o not in ("===", "!==", "==", "!=", "<="))
#: Binary precedence; ``>`` comes as single characters and is put together in the parser.
PREC = {O["??"]: 1, O["||"]: 2, O["&&"]: 3, "|": 4, "^": 5, "&": 6, O["=="]: 7, O["!="]: 7, O["==="]: 7, O["!=="]: 7, "<": 8, ">": 8, O["<="]: 8, W["instanceof"]: 8, W["in"]: 8, O["<<"]: 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, O["**"]: 12}
END = "\0"

_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"/]|\{[^{}`'\"/]*\})*\})*`"
_SKIP = r"(?:[ \t\r\f\v\xa0\ufeff]+|//[^\n]*|/\*[^*\n]*\*+(?:[^/*\n][^*\n]*\*+)*/)*"
_OP = "|".join(re.escape(o) for o in sorted(_OPS, key=len, reverse=True) if o != "?.") + r"|\?\.(?!\d)|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]"
_PIECES = rf"\n\s*|[A-Za-z_$\u00aa-\uffdc\U00010000-\U0010ffff][\w$]*|{_NUMBER}|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|{_TEMPLATE}|/\*[\s\S]*?\*/"
#: Fast lexer: a regular expression literal is only seen right after a token that cannot end an operand.
_FAST = re.compile(rf"{_SKIP}((?:[=(,:\[!&|?;{{]|=>|\breturn\b|\btypeof\b|\bcase\b)\s*{_REGEX}|{_PIECES}|{_OP}|[^\s])")
_ONE = re.compile(rf"{_SKIP}(?:({_PIECES}|{_OP}|[^\s])|\Z)")
_REGEX_RE = re.compile(_REGEX)
_PREFIXED = re.compile(rf"([^/]*?)\s*{_REGEX}\Z")

_ENDERS = f"i0strX)\\]}}>!{INC}{DEC}{''.join(W.values())}"
# white space that no rule looks at: after a token that ends nothing, before one that starts nothing
_DEAD = re.compile(rf"(?<![{_ENDERS}])\n|\n(?![i0strX{{\[(@#!<{INC}{DEC}{''.join(W.values())}])")


class Bad(Exception):
    """A syntax error at a position of the kind string."""

    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


class _Kinds(dict):
    """Token text to kind; names and literals are classified when first met."""

    def __init__(self, jsx: bool, ts: bool):
        super().__init__(W | O | {c: c for c in "{}()[];,<>+-*/%&|^!~?:=.@#"})
        self.jsx, self.ts = jsx, ts

    def __missing__(self, tok: str) -> str:
        k = self.kind(tok)
        if len(self) > 200_000:
            self.__init__(self.jsx, self.ts)
        if len(tok) < 40:
            self[tok] = k
        return k

    def kind(self, tok: str) -> str:
        c = tok[0]
        if c == "\n" or tok.startswith("/*"):
            return "\n" if "\n" in tok else ""
        if c in "'\"" and len(tok) > 1:
            return "s"
        if c == "`" and len(tok) > 1:
            return "t" if "${" not in tok or template_ok(tok, self.ts, self.jsx) else "E"
        if c.isdigit() or c == "." and len(tok) > 1 and tok[1].isdigit():
            return "0" if re.fullmatch(_NUMBER, tok) else "E"
        if c.isidentifier() or c == "$":
            return "i" if tok[-1] != "/" and "/" not in tok else self._prefixed(tok)
        if len(tok) > 1 and "/" in tok:
            return self._prefixed(tok)
        return "E"

    def _prefixed(self, tok: str) -> str:
        m = _PREFIXED.match(tok)
        return self[m.group(1)] + "r" if m else "E"


_KINDS: dict = {}


def _table(ts: bool, jsx: bool) -> _Kinds:
    return _KINDS.setdefault((ts, jsx), _Kinds(jsx, ts))


def template_ok(tok: str, ts: bool, jsx: bool) -> bool:
    """Whether the substitutions of a template literal are expressions."""
    return all(expression_ok(x, ts, jsx) for x in re.findall(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}", re.sub(r"\\[\s\S]", "", tok)))


_EXPR: dict = {}


def expression_ok(text: str, ts: bool, jsx: bool) -> bool:
    key = (text, ts, jsx)
    if key not in _EXPR:
        if len(_EXPR) > 50_000:
            _EXPR.clear()
        k, _ = lex(text, ts, jsx)
        p = Parser(_DEAD.sub("", k), ts, jsx)
        try:
            _EXPR[key] = p.k[p.expression(p.nl(0))] in (END, "\n")
        except Bad:
            _EXPR[key] = False
    return _EXPR[key]


def fast_kinds(text: str, ts: bool, jsx: bool) -> str:
    t = _table(ts, jsx)
    return "".join([t[x] for x in _FAST.findall(text)])


_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_WS = re.compile(r"(?:\s+|/\*[\s\S]*?\*/|//[^\n]*)*")


def lex(text: str, ts: bool, jsx: bool, at: int = 0, inner: bool = False) -> tuple[str, list[int]]:
    """Exact lexer: kinds and the offset of each; with ``inner`` it stops at the brace that closes the start.

    It knows the token before, so it can tell a regular expression from a
    division and an element from a comparison, and it follows templates and
    elements into the expressions they hold.
    """
    table, kinds, where, depth, n = _table(ts, jsx), [], [], 0, len(text)
    prev, heads, head = "(", [], False
    if text.startswith("#!"):
        at = max(text.find("\n"), 0)
    while at < n:
        m = _ONE.match(text, at)
        tok = m.group(1)
        if tok is None:
            break
        start, at = m.start(1), m.end()
        c = tok[0]
        if c in "/`" or c == "<" and jsx:
            ends = prev in "i0strX)]}" or prev in (W["this"], W["super"], W["null"], W["true"], W["false"]) or (prev in SOFT and prev not in (W["of"], W["await"], W["yield"], W["as"], W["satisfies"]))
            if c == "/" and not tok.startswith("/*"):
                r = None if ends and prev != "}" and not (prev == ")" and head) else _REGEX_RE.match(text, start)
                if r:
                    kinds.append("r"), where.append(start)
                    prev, at = "r", r.end()
                    continue
            elif c == "`" and (len(tok) == 1 or "${" in tok):
                end, ok = _template(text, start + 1, ts, jsx)
                kinds.append("t" if ok else "E"), where.append(start)
                prev, at = "t", end
                continue
            elif c == "<" and (not ends or prev == "}") and (text[at : at + 1] == ">" or _TAG_NAME.match(text, at)) and not re.match(r"[\w$]+\s*(?:,|extends\b|>\s*\()", text[at : at + 80]) or (c == "<" and not ends and text[at : at + 1] == ">"):
                end, ok = _element(text, start, ts, jsx)
                kinds.append("X" if ok else "E"), where.append(start)
                prev, at = "X", end
                continue
        if c == "(":
            heads.append(prev in (W["if"], W["while"], W["for"], W["with"]))
        elif c == ")":
            head = heads.pop() if heads else False
        if inner and c == "{":
            depth += 1
        elif inner and c == "}":
            if depth == 0:
                where.append(start)
                return "".join(kinds), where
            depth -= 1
        k = table[tok]
        for x in k:
            kinds.append(x), where.append(start)
        if k and k != "\n":
            prev = k[-1]
    if inner:
        kinds.append("E")
    where.append(n)
    return "".join(kinds), where


def _inner(text: str, at: int, ts: bool, jsx: bool, spread: bool = False) -> tuple[int, bool]:
    """Read the expression that starts at ``at`` and ends with a closing brace."""
    k, where = lex(text, ts, jsx, at, True)
    if k.endswith("E"):
        return len(text), False
    p = Parser(_DEAD.sub("", k), ts, jsx)
    try:
        q = p.nl(0)
        if spread and p.k[q] == END:
            return where[-1] + 1, True
        if spread and p.k[q] == SPREAD:
            q += 1
        ok = p.k[p.expression(q)] in (END, "\n")
    except Bad:
        ok = False
    return where[-1] + 1, ok


def _template(text: str, at: int, ts: bool, jsx: bool) -> tuple[int, bool]:
    ok = True
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, ok
        elif c == "$" and text.startswith("${", at):
            at, good = _inner(text, at + 2, ts, jsx)
            ok &= good
        else:
            at += 1
    return len(text), False


def _element(text: str, at: int, ts: bool, jsx: bool) -> tuple[int, bool]:
    """A JSX element from its ``<``; returns its end and whether it and all it holds are well formed."""
    ok, n = True, len(text)
    m = _TAG_NAME.match(text, at + 1)
    name, at = (m.group(), m.end()) if m else ("", at + 1)
    while True:
        at = _JSX_WS.match(text, at).end()
        if at >= n:
            return n, False
        c = text[at]
        if text.startswith("/>", at):
            return at + 2, ok
        if c == ">":
            at += 1
            break
        if c == "{":
            at, good = _inner(text, at + 1, ts, jsx, True)
            ok &= good
            continue
        m = _TAG_NAME.match(text, at)
        if not m:
            return at + 1, False
        at = _JSX_WS.match(text, m.end()).end()
        if text.startswith("=", at):
            at = _JSX_WS.match(text, at + 1).end()
            q = text[at : at + 1]
            if q in ("'", '"'):
                end = text.find(q, at + 1)
                if end < 0:
                    return n, False
                at = end + 1
            elif q == "{":
                at, good = _inner(text, at + 1, ts, jsx)
                ok &= good
            elif q == "<":
                at, good = _element(text, at, ts, jsx)
                ok &= good
            else:
                return at, False
    while True:  # children
        m = re.compile(r"[<{>}]").search(text, at)
        if not m:
            return n, False
        at, c = m.start(), m.group()
        if c == "{":
            at, good = _inner(text, at + 1, ts, jsx, True)
            ok &= good
        elif c in "}>":
            ok, at = False, at + 1
        elif text.startswith("</", at):
            m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
            return (m.end(), ok and m.group(1) == name) if m else (n, False)
        else:
            at, good = _element(text, at, ts, jsx)
            ok &= good


_SIMPLE_ARGS = re.compile(rf"\((?:[i0s](?:\.[{ANYWORD}])*(?:,[i0s](?:\.[{ANYWORD}])*)*)?\)")
_PLAIN = re.compile(rf"(?:[i{W['this']}](?:\.[{ANYWORD}])*|[0s{W['null']}{W['true']}{W['false']}])(?=[,;)\]}}\0])")
_SHIFT_ASSIGN = re.compile(r">{2,3}=")
_CHUNK = re.compile(r"[^;\n]*;")
_MEMO: dict = {}
_MEMO_MOST = 400_000


class Parser:
    def __init__(self, kinds: str, ts: bool, jsx: bool, stop: bool = False):
        self.stop = stop  # give up at the first error
        self.k, self.ts, self.jsx = kinds + END * 3, ts, jsx
        self.memo = _MEMO.setdefault((ts, False), {})
        self._close: dict | None = None
        self.no_in, self.ambient, self.target = False, False, False
        self.plain_arrows = self.typed_arrows = 0
        self.tried: dict[tuple, int | Bad] = {}
        self.errors: list[tuple[int, str]] = []

    # -- small helpers -------------------------------------------------
    def nl(self, p: int) -> int:
        return p + 1 if self.k[p] == "\n" else p

    def need(self, p: int, c: str) -> int:
        p = p + 1 if self.k[p] == "\n" else p
        if self.k[p] != c:
            raise Bad(p, f"expected {c}")
        return p + 1

    def close(self, p: int) -> int:
        """The bracket that closes the one at p, or -1."""
        if self._close is None:
            self._close, stack = {}, []
            for m in re.finditer(r"[()\[\]{}]", self.k):
                c = m.group()
                if c in "([{":
                    stack.append((c, m.start()))
                elif stack and stack[-1][0] == {")": "(", "]": "[", "}": "{"}[c]:
                    self._close[stack.pop()[1]] = m.start()
                else:
                    stack.clear()
        return self._close.get(p, -1)

    def attempt(self, rule, p: int) -> int:
        """The end of a rule tried at p, or -1."""
        found = len(self.errors)
        try:
            q = rule(p)
        except Bad:
            q = -1
        if len(self.errors) > found:  # recovered inside a body
            del self.errors[found:]
            return -1
        return q

    def semicolon(self, p: int) -> int:
        c = self.k[p]
        if c == ";":
            return p + 1
        if c == "\n":
            return p + 1
        if c == "}" or c == END:
            return p
        raise Bad(p, "expected ;")

    # -- programs and statements ---------------------------------------
    def program(self) -> list[tuple[int, str]]:
        """Parse everything; returns all errors as (position, text)."""
        p = 0
        while True:
            p = self.statements(p, top=True)
            if self.k[p] == END:
                return self.errors
            self.errors.append((p, "unexpected }"))
            if self.stop:
                return self.errors
            p += 1

    def statements(self, p: int, top: bool = False) -> int:
        k = self.k
        while True:
            c = k[p]
            if c == "\n" or c == ";":
                p += 1
                continue
            if c == "}" or c == END:
                return p
            try:
                p = self.statement(p)
            except Bad as e:
                self.errors.append((e.at, e.what))
                if self.stop:
                    return len(k) - 3
                p = self.recover(max(e.at, p), p)
            except RecursionError:
                self.errors.append((p, "nested too deeply"))
                return len(k) - 3

    def recover(self, p: int, start: int) -> int:
        """Skip to the end of the broken statement: past a semicolon, or to a brace or the line's end outside brackets."""
        k, depth = self.k, 0
        p = max(p, start)
        while k[p] != END:
            c = k[p]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if depth == 0 and c == "}":
                    return p if p > start else p + 1
                depth = max(0, depth - 1)
            elif depth == 0 and (c == ";" or c == "\n") and p > start:
                return p + 1
            p += 1
        return p

    def statement(self, p: int) -> int:
        k = self.k
        m = _CHUNK.match(k, p)
        chunk = None
        if m:
            chunk = m.group()
            known = self.memo.get(chunk)
            if known:
                return m.end()
            if known is not None:
                chunk = None
        block, b = None, -1
        if chunk is None and k[p] in _BLOCKY:
            b = k.find("{", p, p + 300)
            b = self.close(b) + 1 if b >= 0 else 0
            if 0 < b - p <= 600:
                block = k[p:b]
                known = self.memo.get(block)
                if known and k[self.nl(b)] not in _FOLLOWERS:
                    return b
        found = len(self.errors)
        q = self._statement(p)
        if (chunk is not None or block is not None) and len(self.errors) == found:
            if len(self.memo) > _MEMO_MOST:
                self.memo.clear()
            if chunk is not None:
                self.memo[chunk] = q == m.end()
            if block is not None and q == b:
                self.memo[block] = True
        return q

    def _statement(self, p: int) -> int:
        c = self.k[p]
        rule = _RULES.get(c)
        if rule is not None:
            q = rule(self, p)
            if q >= 0:
                return q
        if c in NAME and self.k[p + 1] == ":":
            return self._labelled(p + 2)
        return self.semicolon(self.expression(p))

    def _labelled(self, p: int) -> int:
        return self.statement(self.nl(p))

    def block(self, p: int) -> int:
        p = self.need(p, "{")
        p = self.statements(p)
        if self.k[p] != "}":
            raise Bad(p, "unclosed {")
        return p + 1

    def _block(self, p: int) -> int:
        return self.block(p)

    def _paren(self, p: int) -> int:
        return self.need(self.expression(self.nl(self.need(p, "("))), ")")

    def _body(self, p: int) -> int:
        p = self.nl(p)
        if self.k[p] == ";":
            return p + 1
        if self.k[p] in "}" + END:
            raise Bad(p, "expected a statement")
        return self.statement(p)

    def _if(self, p: int) -> int:
        p = self._body(self._paren(p + 1))
        q = self.nl(p)
        return self._body(q + 1) if self.k[q] == W["else"] else p

    def _while(self, p: int) -> int:
        return self._body(self._paren(p + 1))

    def _do(self, p: int) -> int:
        p = self._body(p + 1)
        p = self._paren(self.need(p, W["while"]))
        return p + 1 if self.k[p] in ";\n" else p

    def _for(self, p: int) -> int:
        k = self.k
        p = self.nl(p + 1)
        if k[p] == W["await"]:
            p += 1
        p = self.nl(self.need(p, "("))
        old, self.no_in = self.no_in, True
        try:
            if k[p] in (W["var"], W["const"], W["let"]) and (k[p] != W["let"] or k[p + 1] in NAME + "[{"):
                q = self.binding(p + 1)
                if k[q] not in (W["of"], W["in"]):
                    q = self.declarations(p + 1)
                p = q
            elif k[p] != ";":
                p = self.expression(p)
        finally:
            self.no_in = old
        p = self.nl(p)
        if k[p] == W["of"]:
            p = self.assign(p + 1)
        elif k[p] == W["in"]:
            p = self.expression(p + 1)
        else:
            p = self.need(p, ";")
            p = self.nl(p)
            if k[p] != ";":
                p = self.expression(p)
            p = self.nl(self.need(p, ";"))
            if k[p] != ")":
                p = self.expression(p)
        return self._body(self.need(p, ")"))

    def _return(self, p: int) -> int:
        if self.k[p + 1] in ";\n}" + END:
            return self.semicolon(p + 1)
        return self.semicolon(self.expression(p + 1))

    def _throw(self, p: int) -> int:
        return self.semicolon(self.expression(p + 1))

    def _jump(self, p: int) -> int:
        return self.semicolon(p + 2 if self.k[p + 1] in NAME else p + 1)

    def _switch(self, p: int) -> int:
        k = self.k
        p = self.need(self._paren(p + 1), "{")
        while True:
            p = self.nl(p)
            if k[p] == "}":
                return p + 1
            if k[p] == W["case"]:
                p = self.need(self.expression(p + 1), ":")
            elif k[p] == W["default"]:
                p = self.need(p + 1, ":")
            else:
                raise Bad(p, "expected case")
            while True:
                c = k[p]
                if c in "\n;":
                    p += 1
                elif c == W["case"] or c == W["default"] or c == "}":
                    break
                elif c == END:
                    raise Bad(p, "unclosed {")
                else:
                    p = self.statement(p)

    def _try(self, p: int) -> int:
        k = self.k
        p = self.block(p + 1)
        q, found = self.nl(p), False
        if k[q] == W["catch"]:
            q = self.nl(q + 1)
            if k[q] == "(":
                q = self.binding(q + 1)
                if k[q] == ":":
                    q = self.annotation(q)
                q = self.need(q, ")")
            p, found = self.block(q), True
            q = self.nl(p)
        if k[q] == W["finally"]:
            p, found = self.block(q + 1), True
        if not found:
            raise Bad(p, "expected catch or finally")
        return p

    def _debugger(self, p: int) -> int:
        return self.semicolon(p + 1)

    # -- declarations ----------------------------------------------------
    def _variables(self, p: int) -> int:
        k = self.k
        if k[p] == W["let"] and k[p + 1] not in NAME + "[{":
            return -1
        if k[p] == W["const"] and k[p + 1] == W["enum"] and self.ts:
            return self._enum(p + 1)
        return self.semicolon(self.declarations(p + 1, k[p] == W["const"] and not self.ambient))

    def declarations(self, p: int, constant: bool = False) -> int:
        k = self.k
        while True:
            p = self.binding(self.nl(p))
            if k[p] == "!" and self.ts and k[p + 1] == ":":
                p += 1
            if k[p] == ":":
                p = self.annotation(p)
            if k[p] == "=":
                p = self.assign(self.nl(p + 1))
            elif constant:
                raise Bad(p, "a constant needs a value")
            if k[p] != ",":
                return p
            p += 1

    def annotation(self, p: int) -> int:
        if not self.ts:
            raise Bad(p, "type syntax in JavaScript")
        return self.type(self.nl(p + 1))

    def binding(self, p: int) -> int:
        """A name or a destructuring pattern."""
        k = self.k
        c = k[p]
        if c in NAME:
            return p + 1
        if c == "[":
            p = self.nl(p + 1)
            while k[p] != "]":
                if k[p] == ",":
                    p = self.nl(p + 1)
                    continue
                if k[p] == SPREAD:
                    p += 1
                p = self.default(self.binding(p))
                p = self.nl(p)
                if k[p] == ",":
                    p = self.nl(p + 1)
                elif k[p] != "]":
                    raise Bad(p, "expected ]")
            return p + 1
        if c == "{":
            p = self.nl(p + 1)
            while k[p] != "}":
                if k[p] == SPREAD:
                    p = self.binding(p + 1)
                else:
                    name = k[p] in NAME
                    p = self.key(p)
                    if k[p] == ":":
                        p = self.binding(self.nl(p + 1))
                    elif not name:
                        raise Bad(p, "expected :")
                    p = self.default(p)
                p = self.nl(p)
                if k[p] == ",":
                    p = self.nl(p + 1)
                elif k[p] != "}":
                    raise Bad(p, "expected }")
            return p + 1
        raise Bad(p, "expected a name")

    def default(self, p: int) -> int:
        return self.assign(self.nl(p + 1)) if self.k[p] == "=" else p

    def key(self, p: int) -> int:
        """A property name."""
        c = self.k[p]
        if c in ANYWORD or c in "0s":
            return p + 1
        if c == "[":
            return self.need(self.assign(self.nl(p + 1)), "]")
        if c == "#" and self.k[p + 1] in ANYWORD:
            return p + 2
        raise Bad(p, "expected a property name")

    def parameters(self, p: int) -> int:
        k = self.k
        p = self.nl(self.need(p, "("))
        while k[p] != ")":
            while k[p] == "@":
                p = self.nl(self.decorator(p))
            while self.ts and k[p] in _MODIFIERS and k[p + 1] in NAME + "{[":
                p += 1
            rest = k[p] == SPREAD
            if rest:
                p += 1
            p = p + 1 if k[p] == W["this"] and self.ts else self.binding(p)
            if k[p] == "?" and self.ts:
                p += 1
            if k[p] == ":":
                p = self.annotation(p)
            p = self.nl(self.default(p))
            if k[p] == ",":
                if rest and k[self.nl(p + 1)] != ")":
                    raise Bad(p, "a rest parameter must be last")
                p = self.nl(p + 1)
            elif k[p] != ")":
                raise Bad(p, "expected )")
        return p + 1

    def signature(self, p: int) -> int:
        """Type parameters, parameters and return type."""
        if self.k[p] == "<":
            p = self.type_parameters(p)
        p = self.parameters(p)
        if self.k[p] == ":":
            p = self.return_type(p)
        return p

    def return_type(self, p: int) -> int:
        if not self.ts:
            raise Bad(p, "type syntax in JavaScript")
        k = self.k
        p = self.nl(p + 1)
        if k[p] == W["asserts"] and k[p + 1] in NAME + W["this"]:
            p += 2
            return self.type(p + 1) if k[p] == W["is"] else p
        if k[p] in NAME + W["this"] and k[p + 1] == W["is"]:
            return self.type(p + 2)
        return self.type(p)

    def function(self, p: int, named: bool) -> int:
        """After the keyword ``function``."""
        k = self.k
        if k[p] == "*":
            p += 1
        if k[p] in NAME:
            p += 1
        elif named:
            raise Bad(p, "expected a name")
        p = self.signature(p)
        q = self.nl(p)
        if k[q] != "{" and named and self.ts:
            return self.semicolon(p)  # an overload or a declaration
        return self.block(p)

    def _function(self, p: int) -> int:
        return self.function(p + 1, True)

    def _async(self, p: int) -> int:
        return self.function(p + 2, True) if self.k[p + 1] == W["function"] else -1

    def decorator(self, p: int) -> int:
        p += 1
        if self.k[p] == "(":
            return self._paren(p)
        return self.chain(self.primary(p), True)

    def _decorated(self, p: int) -> int:
        while self.k[p] == "@":
            p = self.nl(self.decorator(p))
        if self.k[p] in (W["export"], W["abstract"], W["default"]):
            return self._statement(p)
        return self._class(p) if self.k[p] == W["class"] else self.statement(p)

    def _class(self, p: int) -> int:
        return self.class_tail(p + 1)

    def class_tail(self, p: int) -> int:
        k = self.k
        if k[p] in NAME and not (k[p] == W["implements"]):
            p += 1
        if k[p] == "<":
            p = self.type_parameters(p)
        p = self.nl(p)
        if k[p] == W["extends"]:
            p = self.chain(self.primary(p + 1), True)
            if k[p] == "<":
                p = self.type_arguments(p)
            p = self.nl(p)
        if k[p] == W["implements"]:
            if not self.ts:
                raise Bad(p, "type syntax in JavaScript")
            p = self.type(p + 1)
            while k[p] == ",":
                p = self.type(p + 1)
        p = self.need(p, "{")
        while True:
            c = k[p]
            if c in "\n;":
                p += 1
            elif c == "}":
                return p + 1
            elif c == END:
                raise Bad(p, "unclosed {")
            else:
                p = self.member(p)

    def member(self, p: int) -> int:
        k = self.k
        while k[p] == "@":
            p = self.nl(self.decorator(p))
        more = ANYWORD + "0s[#*{"
        while k[p] in _MEMBER_WORDS and k[p + 1] in more and k[p + 1] != END:
            if k[p] in _TS_MEMBER_WORDS and not self.ts:
                raise Bad(p, "type syntax in JavaScript")
            if k[p] == W["static"] and k[p + 1] == "{":
                return self.block(p + 1)
            p += 1
        if k[p] == "*":
            p += 1
        if k[p] == "[" and self.ts and k[p + 1] in NAME and k[p + 2] == ":":
            p = self.need(self.type(p + 3), "]")  # index signature
            return self.member_end(self.annotation(p))
        p = self.key(p)
        if k[p] == "?" or k[p] == "!":
            if not self.ts:
                raise Bad(p, "type syntax in JavaScript")
            p += 1
        q = self.nl(p)
        if k[q] == "(" or k[p] == "<":
            p = self.signature(p)
            q = self.nl(p)
            if k[q] == "{":
                return self.block(q)
            if not self.ts:
                raise Bad(p, "expected {")
            return self.member_end(p)
        if k[p] == ":":
            p = self.annotation(p)
        if k[p] == "=":
            p = self.assign(self.nl(p + 1))
        return self.member_end(p)

    def member_end(self, p: int) -> int:
        if self.k[p] in ";\n":
            return p + 1
        if self.k[p] == "}":
            return p
        raise Bad(p, "expected ;")

    # -- modules -----------------------------------------------------------
    def _import(self, p: int) -> int:
        k = self.k
        q = p + 1
        if k[q] in "(.":
            return -1
        if k[q] == "s":
            return self.semicolon(self.attributes(q + 1))
        if k[q] == W["type"] and self.ts and (k[q + 1] in "{*" or k[q + 1] in NAME and k[q + 1] != W["from"] or k[q + 1] == W["from"] and k[q + 2] == W["from"]):
            q += 1
        if k[q] in NAME:
            q += 1
            if k[q] == "=" and self.ts:
                return self.semicolon(self.assign(q + 1))
            if k[q] == ",":
                q = self.nl(q + 1)
                q = self.namespace_or_names(q)
        else:
            q = self.namespace_or_names(q)
        q = self.need(q, W["from"])
        if k[q] != "s":
            raise Bad(q, "expected a module name")
        return self.semicolon(self.attributes(q + 1))

    def namespace_or_names(self, p: int) -> int:
        k = self.k
        if k[p] == "*":
            if k[p + 1] == W["as"] and k[p + 2] in NAME:
                return p + 3
            raise Bad(p + 1, "expected as")
        return self.names(p)

    def names(self, p: int) -> int:
        """``{ a, b as c, type d }``."""
        k = self.k
        p = self.nl(self.need(p, "{"))
        while k[p] != "}":
            if k[p] == W["type"] and self.ts and k[p + 1] in ANYWORD + "s" and not (k[p + 1] == W["as"] and k[p + 2] not in (W["as"], ",", "}")):
                p += 1
            if k[p] not in ANYWORD + "s":
                raise Bad(p, "expected a name")
            p += 1
            if k[p] == W["as"]:
                if k[p + 1] not in ANYWORD + "s":
                    raise Bad(p + 1, "expected a name")
                p += 2
            p = self.nl(p)
            if k[p] == ",":
                p = self.nl(p + 1)
            elif k[p] != "}":
                raise Bad(p, "expected }")
        return p + 1

    def attributes(self, p: int) -> int:
        if self.k[p] == W["with"] and self.k[p + 1] == "{":
            return self.object(p + 1)
        return p

    def _export(self, p: int) -> int:
        k = self.k
        p = self.nl(p + 1)
        c = k[p]
        if c == W["default"]:
            p = self.nl(p + 1)
            if k[p] == W["function"]:
                return self.function(p + 1, False)
            if k[p] == W["async"] and k[p + 1] == W["function"]:
                return self.function(p + 2, False)
            if k[p] == W["class"]:
                return self.class_tail(p + 1)
            if k[p] in (W["abstract"], W["interface"], "@") and (k[p] == "@" or k[p + 1] in NAME + W["class"]):
                return self._statement(p)
            return self.semicolon(self.assign(p))
        if c == "*":
            p += 1
            if k[p] == W["as"]:
                p += 2
            p = self.need(p, W["from"])
            if k[p] != "s":
                raise Bad(p, "expected a module name")
            return self.semicolon(self.attributes(p + 1))
        if c == "{" or c == W["type"] and self.ts and k[p + 1] in "{*":
            if c != "{":
                p += 1
                if k[p] == "*":
                    return self._export_star(p)
            p = self.names(p)
            if k[p] == W["from"]:
                if k[p + 1] != "s":
                    raise Bad(p + 1, "expected a module name")
                p = self.attributes(p + 2)
            return self.semicolon(p)
        if self.ts and c == "=":
            return self.semicolon(self.expression(p + 1))
        if self.ts and c == W["as"]:
            return self.semicolon(p + 3)
        if self.ts and c == W["import"]:
            return self._import(p)
        if c in _DECLARING or c == "@":
            q = _RULES[c](self, p)
            if q >= 0:
                return q
        raise Bad(p, "expected a declaration")

    def _export_star(self, p: int) -> int:
        p += 1
        if self.k[p] == W["as"]:
            p += 2
        p = self.need(p, W["from"])
        return self.semicolon(p + 1)

    # -- TypeScript declarations --------------------------------------------
    def _interface(self, p: int) -> int:
        k = self.k
        if not (self.ts and k[p + 1] in NAME):
            return -1
        p += 2
        if k[p] == "<":
            p = self.type_parameters(p)
        p = self.nl(p)
        if k[p] == W["extends"]:
            p = self.type(p + 1)
            while k[p] == ",":
                p = self.type(p + 1)
        return self.object_type(self.nl(p))

    def _type(self, p: int) -> int:
        if not (self.ts and self.k[p + 1] in NAME and self.k[p + 2] in "=<"):
            return -1
        p += 2
        if self.k[p] == "<":
            p = self.type_parameters(p)
        return self.semicolon(self.type(self.nl(self.need(p, "="))))

    def _enum(self, p: int) -> int:
        k = self.k
        if not self.ts:
            raise Bad(p, "type syntax in JavaScript")
        if k[p + 1] not in NAME:
            raise Bad(p + 1, "expected a name")
        p = self.nl(self.need(p + 2, "{"))
        while k[p] != "}":
            p = self.default(self.key(p))
            p = self.nl(p)
            if k[p] == ",":
                p = self.nl(p + 1)
            elif k[p] != "}":
                raise Bad(p, "expected }")
        return p + 1

    def _declare(self, p: int) -> int:
        k = self.k
        if not self.ts or k[p + 1] not in _DECLARING + W["global"]:
            return -1
        if k[p + 1] == W["global"]:
            return self.block(p + 2)
        old, self.ambient = (self.ambient, self.memo), True
        self.memo = _MEMO.setdefault((self.ts, True), {})
        try:
            return _RULES[k[p + 1]](self, p + 1)
        finally:
            self.ambient, self.memo = old

    def _abstract(self, p: int) -> int:
        return self.class_tail(p + 2) if self.ts and self.k[p + 1] == W["class"] else -1

    def _namespace(self, p: int) -> int:
        k = self.k
        if not self.ts or k[p + 1] not in NAME + "s":
            return -1
        p += 2
        while k[p] == "." and k[p + 1] in NAME:
            p += 2
        return self.block(p) if k[self.nl(p)] == "{" else self.semicolon(p)

    # -- types ---------------------------------------------------------------
    def type_parameters(self, p: int) -> int:
        k = self.k
        if not self.ts:
            raise Bad(p, "type syntax in JavaScript")
        p = self.nl(p + 1)
        while k[p] != ">":
            while k[p] in (W["const"], W["in"], W["out"]) and k[p + 1] in NAME:
                p += 1
            if k[p] not in NAME:
                raise Bad(p, "expected a type parameter")
            p = self.nl(p + 1)
            if k[p] == W["extends"]:
                p = self.nl(self.type(p + 1))
            if k[p] == "=":
                p = self.nl(self.type(p + 1))
            if k[p] == ",":
                p = self.nl(p + 1)
            elif k[p] != ">":
                raise Bad(p, "expected >")
        return p + 1

    def type_arguments(self, p: int) -> int:
        if not self.ts:
            raise Bad(p, "type syntax in JavaScript")
        p = self.type(self.nl(p + 1))
        while True:
            p = self.nl(p)
            if self.k[p] == ">":
                return p + 1
            if self.k[p] != ",":
                raise Bad(p, "expected >")
            p = self.type(self.nl(p + 1))

    def type(self, p: int) -> int:
        k = self.k
        p = self.nl(p)
        if k[p] == "(":
            q = self.close(p)
            if q > 0 and k[self.nl(q + 1)] == ARROW:
                return self.return_type(self.nl(self.parameters(p)))
        elif k[p] == "<":
            p = self.parameters(self.type_parameters(p))
            return self.return_type(self.need(p, ARROW) - 1)
        elif k[p] == W["new"] or k[p] == W["abstract"] and k[p + 1] == W["new"]:
            p = p + 1 if k[p] == W["new"] else p + 2
            if k[p] == "<":
                p = self.type_parameters(p)
            p = self.parameters(p)
            return self.type(self.need(p, ARROW))
        p = self.union(p)
        if k[p] == W["extends"]:
            p = self.union(p + 1)
            p = self.type(self.need(p, "?"))
            return self.type(self.need(p, ":"))
        return p

    def union(self, p: int) -> int:
        k = self.k
        p = self.nl(p)
        if k[p] in "|&":
            p += 1
        while True:
            p = self.type_unary(self.nl(p))
            q = self.nl(p)
            if k[q] not in "|&":
                return p
            p = q + 1

    def type_unary(self, p: int) -> int:
        k = self.k
        while k[p] in _TYPE_OPERATORS and k[p + 1] in ANYWORD + "s0{[(t":
            if k[p] == W["infer"] and k[p + 2] == W["extends"] and k[p + 1] in NAME:
                q = self.attempt(self.union, p + 3)
                if q > 0 and k[q] != "?":
                    return q
            p += 1
        p = self.type_primary(p)
        while k[p] == "[":
            p = p + 2 if k[p + 1] == "]" else self.need(self.type(p + 1), "]")
        return p

    def type_primary(self, p: int) -> int:
        k = self.k
        c = k[p]
        if c in NAME or c == W["void"] or c == W["this"] or c == W["null"] or c == W["true"] or c == W["false"]:
            p += 1
            while k[p] == "." and k[p + 1] in ANYWORD:
                p += 2
            return self.type_arguments(p) if k[p] == "<" else p
        if c in "s0t":
            return p + 1
        if c == "-" and k[p + 1] == "0":
            return p + 2
        if c == W["typeof"]:
            if k[p + 1] == W["import"]:
                return self.type_primary(p + 1)
            p += 2
            while k[p] == "." and k[p + 1] in ANYWORD + "#":
                p += 2
            return self.type_arguments(p) if k[p] == "<" else p
        if c == W["import"]:
            p = self.need(self.type(self.need(p + 1, "(")), ")")
            while k[p] == "." and k[p + 1] in ANYWORD:
                p += 2
            return self.type_arguments(p) if k[p] == "<" else p
        if c == "(":
            return self.need(self.type(p + 1), ")")
        if c == "[":
            p = self.nl(p + 1)
            while k[p] != "]":
                if k[p] == SPREAD:
                    p += 1
                if k[p] in ANYWORD and (k[p + 1] == ":" or k[p + 1] == "?" and k[p + 2] == ":"):
                    p += 2 if k[p + 1] == ":" else 3
                p = self.type(p)
                if k[p] == "?":
                    p += 1
                p = self.nl(p)
                if k[p] == ",":
                    p = self.nl(p + 1)
                elif k[p] != "]":
                    raise Bad(p, "expected ]")
            return p + 1
        if c == "{":
            return self.object_type(p)
        raise Bad(p, "expected a type")

    def object_type(self, p: int) -> int:
        k = self.k
        p = self.need(p, "{")
        while True:
            p = self.nl(p)
            if k[p] == "}":
                return p + 1
            while k[p] in (W["readonly"], W["static"]) and k[p + 1] in ANYWORD + "[s0" or k[p] in "+-" and k[p + 1] == W["readonly"]:
                p += 1
            if k[p] in (W["get"], W["set"]) and k[p + 1] in ANYWORD + "s0":
                p += 1
            if k[p] == "[" and k[p + 1] in NAME and k[p + 2] == W["in"]:
                p = self.type(p + 3)
                if k[p] == W["as"]:
                    p = self.type(p + 1)
                p = self.need(p, "]")
                if k[p] in "+-" and k[p + 1] == "?":
                    p += 1
                if k[p] == "?":
                    p += 1
                p = self.type(p + 1) if k[p] == ":" else p
            elif k[p] == "[" and k[p + 1] in NAME and k[p + 2] == ":":
                p = self.annotation(self.need(self.type(p + 3), "]"))
            elif k[p] in "(<":
                p = self.signature(p)
            elif k[p] == W["new"] and k[p + 1] in "(<":
                p = self.signature(p + 1)
            else:
                p = self.key(p)
                if k[p] == "?":
                    p += 1
                if k[p] in "(<":
                    p = self.signature(p)
                elif k[p] == ":":
                    p = self.annotation(p)
            if k[p] in ",;\n":
                p += 1
            elif k[p] != "}":
                raise Bad(p, "expected }")

    # -- expressions -----------------------------------------------------------
    def expression(self, p: int) -> int:
        p = self.assign(p)
        while self.k[p] == ",":
            p = self.assign(self.nl(p + 1))
        return p

    def assign(self, p: int) -> int:
        k = self.k
        m = _PLAIN.match(k, p)
        if m:
            return m.end()
        c = k[p]
        if c == "\n":
            p += 1
            c = k[p]
        if c in NAME:
            if k[p + 1] == ARROW:
                return self.arrow_body(p + 2)
            if c == W["async"]:
                if k[p + 1] in NAME and k[p + 2] == ARROW:
                    return self.arrow_body(p + 3)
                if k[p + 1] in "(<":
                    q = self.arrow(p + 1)
                    if q > 0:
                        return q
            elif c == W["yield"]:
                if k[p + 1] == "*":
                    return self.assign(p + 2)
                if k[p + 1] in ")]},;:\n" + END:
                    return p + 1
                if k[p + 1] not in ".=([" and k[p + 1] not in PREC:
                    return self.assign(p + 1)
        elif c == "(":
            q = self.arrow(p)
            if q > 0:
                return q
        elif c == "<" and self.ts:
            q = self.arrow(p)
            if q > 0:
                return q
        p = self.binary(p, 0)
        target = self.target
        c = k[p]
        if c == "?":
            old, self.no_in = self.no_in, False
            typed, found, bad = self.typed_arrows, len(self.errors), None
            try:
                q = self.assign(self.nl(p + 1))
            except Bad as e:
                q, bad = -1, e
            if (q < 0 or k[self.nl(q)] != ":") and self.typed_arrows != typed:
                # the colon may have been taken for a return type; without typed arrows there is no third try
                del self.errors[found:]
                self.plain_arrows += 1
                try:
                    q = self.assign(self.nl(p + 1))
                finally:
                    self.plain_arrows -= 1
            elif bad is not None:
                raise bad
            self.no_in = old
            return self.again(self.nl(self.need(q, ":")))
        if c == ">" and _SHIFT_ASSIGN.match(k, p):
            p = k.index("=", p)
            c = "="
        if c in ASSIGN:
            if not target:
                raise Bad(p, "invalid assignment target")
            return self.assign(self.nl(p + 1))
        return p

    def arrow(self, p: int) -> int:
        """An arrow function at its parameters, or -1."""
        k = self.k
        q = p
        if k[p] == "<":
            if not self.ts:
                return -1
            q = self.attempt(self.type_parameters, p)
            if q < 0 or k[q] != "(":
                return -1
        end = self.close(q)
        if end < 0:
            return -1
        c = k[end + 1]
        if c == ARROW:
            return self.arrow_body(self.parameters(q) + 1)
        if c == ":" and self.ts and not self.plain_arrows:
            q = self.attempt(self.parameters, q)
            if q < 0:
                return -1
            q = self.attempt(self.return_type, q)
            if q < 0 or k[q] != ARROW:
                return -1
            self.typed_arrows += 1
            return self.arrow_body(q + 1)
        return -1

    def arrow_body(self, p: int) -> int:
        p = self.nl(p)
        if self.k[p] == "{":
            return self.block(p)
        return self.again(p)

    def again(self, p: int) -> int:
        """``assign`` where two readings of a conditional may both come by: each outcome is kept."""
        key = (p, self.no_in, self.plain_arrows > 0)
        known = self.tried.get(key)
        if known is not None:
            if isinstance(known, Bad):
                raise known
            return known
        found = len(self.errors)
        try:
            q = self.assign(p)
        except Bad as e:
            self.tried[key] = e
            raise
        if len(self.errors) == found:
            self.tried[key] = q
        return q

    def binary(self, p: int, least: int) -> int:
        k = self.k
        p = self.unary(p)
        while True:
            c = k[p]
            if c == "\n" and k[p + 1] in (W["instanceof"], W["in"]):
                p += 1
                c = k[p]
            prec = PREC.get(c)
            if prec is None:
                if self.ts and least < 8 and (c == W["as"] or c == W["satisfies"]):
                    p = p + 2 if k[p + 1] == W["const"] else self.type(p + 1)
                    self.target = True
                    continue
                return p
            width = 1
            if c == ">":
                while k[p + width] == ">" and width < 3:
                    width += 1
                if width > 1:
                    prec = 9
                if k[p + width] == "=":
                    if width > 1:
                        return p
                    width += 1
            if prec <= least and not (prec == 12 and least == 12) or c == W["in"] and self.no_in:
                return p
            p = self.binary(self.nl(p + width), prec if prec != 12 else 11)
            self.target = False

    def unary(self, p: int) -> int:
        k = self.k
        c = k[p]
        if c == "\n":
            p += 1
            c = k[p]
        if c in _PREFIX:
            if c in (W["await"], W["using"]) and k[p + 1] in ".=,;)]}:?\n" + ARROW + END or c in (W["await"],) and k[p + 1] in PREC and k[p + 1] not in "+-<(/[":
                return self.postfix(p)
            p = self.unary(p + 1)
            self.target = False
            return p
        if c == "<" and self.ts and not self.jsx:
            q = self.type_arguments(p)
            return self.unary(q)
        return self.postfix(p)

    def postfix(self, p: int) -> int:
        k = self.k
        start = k[p]
        p = self.primary(p)
        self.target = start in NAME or start in "[{("
        q = self.chain(p)
        if q != p:
            self.target = k[q - 1] != ")" or start == "("
            p = q
        if k[p] in (INC, DEC):
            self.target = False
            return p + 1
        return p

    def chain(self, p: int, no_generic: bool = False) -> int:
        k = self.k
        while True:
            c = k[p]
            if c == ".":
                if k[p + 1] in ANYWORD:
                    p += 2
                elif k[p + 1] == "#" and k[p + 2] in ANYWORD:
                    p += 3
                elif k[p + 1] == "\n" and k[p + 2] in ANYWORD:
                    p += 3
                else:
                    raise Bad(p + 1, "expected a name after .")
            elif c == "(":
                m = _SIMPLE_ARGS.match(k, p)
                p = m.end() if m else self.arguments(p)
            elif c == "[":
                p = self.need(self._free(self.expression, self.nl(p + 1)), "]")
            elif c == QDOT:
                if k[p + 1] in ANYWORD:
                    p += 2
                elif k[p + 1] == "#":
                    p += 3
                elif k[p + 1] in "([t":
                    p += 1
                elif k[p + 1] == "<" and self.ts:
                    p = self.type_arguments(p + 1)
                else:
                    raise Bad(p + 1, "expected a name after ?.")
            elif c == "t":
                p += 1
            elif c == "!" and self.ts and k[p + 1] not in "=":
                p += 1
            elif c == "<" and self.ts:
                q = self.attempt(self.type_arguments, p)
                if q > 0 and (k[q] in "(t" or no_generic or k[q] in ")],;:}\n" + END):
                    p = q
                else:
                    return p
            elif c == "\n" and k[p + 1] in "([":
                if no_generic:
                    return p
                p += 1
            else:
                return p

    def _free(self, rule, p: int) -> int:
        old, self.no_in = self.no_in, False
        try:
            return rule(p)
        finally:
            self.no_in = old

    def arguments(self, p: int) -> int:
        k = self.k
        old, self.no_in = self.no_in, False
        p = self.nl(p + 1)
        while k[p] != ")":
            if k[p] == SPREAD:
                p += 1
            p = self.nl(self.assign(p))
            if k[p] == ",":
                p = self.nl(p + 1)
            elif k[p] != ")":
                raise Bad(p, "expected )")
        self.no_in = old
        return p + 1

    def primary(self, p: int) -> int:
        k = self.k
        c = k[p]
        if c in "i0strX":
            return p + 1
        if c == "(":
            return self.need(self._free(self.expression, self.nl(p + 1)), ")")
        if c == "{":
            return self._free(self.object, p)
        if c == "[":
            old, self.no_in = self.no_in, False
            p = self.nl(p + 1)
            while k[p] != "]":
                if k[p] == ",":
                    p = self.nl(p + 1)
                    continue
                if k[p] == SPREAD:
                    p += 1
                p = self.nl(self.assign(p))
                if k[p] == ",":
                    p = self.nl(p + 1)
                elif k[p] != "]":
                    raise Bad(p, "expected ]")
            self.no_in = old
            return p + 1
        if c == W["function"]:
            return self.function(p + 1, False)
        if c == W["async"] and k[p + 1] == W["function"]:
            return self.function(p + 2, False)
        if c == W["class"]:
            return self.class_tail(p + 1)
        if c == W["new"]:
            if k[p + 1] == "." and k[p + 2] in NAME:
                return p + 3
            p = self.primary(p + 1)
            while k[p] in ".[t":
                if k[p] == ".":
                    if k[p + 1] not in ANYWORD + "#":
                        raise Bad(p + 1, "expected a name after .")
                    p += 2 if k[p + 1] != "#" else 3
                elif k[p] == "[":
                    p = self.need(self._free(self.expression, p + 1), "]")
                else:
                    p += 1
            if k[p] == "<" and self.ts:
                q = self.attempt(self.type_arguments, p)
                p = q if q > 0 else p
            return self.arguments(p) if k[p] == "(" else p
        if c in SOFT or c in _LITERAL_WORDS:
            return p + 1
        if c == W["super"] and k[p + 1] in "(.[":
            return p + 1
        if c == W["import"] and k[p + 1] in "(.":
            return p + 1 if k[p + 1] == "(" else p + 3
        if c == "#" and k[p + 1] in ANYWORD and k[p + 2] == W["in"]:
            return p + 2
        if c == "@":
            q = self.decorator(p)
            return self.primary(self.nl(q))
        raise Bad(p, "expected an expression" if c != END else "unexpected end")

    def object(self, p: int) -> int:
        k = self.k
        p = self.nl(p + 1)
        while k[p] != "}":
            m = _PROPS.match(k, p)
            if m:
                p = m.end()
                continue
            if k[p] == SPREAD:
                p = self.assign(p + 1)
            else:
                p = self.property(p)
            p = self.nl(p)
            if k[p] == ",":
                p = self.nl(p + 1)
            elif k[p] != "}":
                raise Bad(p, "expected }")
        return p + 1

    def property(self, p: int) -> int:
        k = self.k
        if k[p] in (W["get"], W["set"], W["async"]) and k[p + 1] in ANYWORD + "0s[*#":
            p += 1
        if k[p] == "*":
            p += 1
        name = k[p] in NAME
        p = self.key(p)
        c = k[p]
        if c == ":":
            return self.assign(self.nl(p + 1))
        if c in "(<":
            return self.block(self.signature(p))
        if not name:
            raise Bad(p, "expected :")
        return self.default(p)


_PROPS = re.compile(rf"(?:[{ANYWORD}s0]:(?:[i{W['this']}](?:\.[{ANYWORD}])*|[0s{W['null']}{W['true']}{W['false']}]),)+")
_MODIFIERS = "".join(W[w] for w in ("private", "protected", "public", "readonly", "override"))
_MEMBER_WORDS = _MODIFIERS + "".join(W[w] for w in ("static", "abstract", "declare", "async", "get", "set", "accessor"))
_TS_MEMBER_WORDS = _MODIFIERS + W["abstract"] + W["declare"]
_TYPE_OPERATORS = "".join(W[w] for w in ("keyof", "unique", "readonly", "infer"))
_PREFIX = "!~+-" + INC + DEC + "".join(W[w] for w in ("typeof", "void", "delete", "await"))
_LITERAL_WORDS = "".join(W[w] for w in ("this", "null", "true", "false"))
_FOLLOWERS = "".join(W[w] for w in ("else", "catch", "finally", "while"))
_DECLARING = "".join(W[w] for w in ("var", "let", "const", "function", "async", "class", "interface", "type", "enum", "abstract", "declare", "namespace", "module"))
_BLOCKY = "".join(W[w] for w in ("if", "for", "while", "switch", "try", "function", "async", "class", "interface", "enum", "export", "do"))
_RULES = {
    **{W[w]: getattr(Parser, f"_{w}") for w in ("if", "while", "do", "for", "return", "throw", "switch", "try", "debugger", "function", "async", "class", "import", "export", "interface", "type", "enum", "declare", "abstract", "namespace")},
    **{W[w]: Parser._variables for w in ("var", "let", "const")},
    **{W[w]: Parser._jump for w in ("break", "continue")},
    W["module"]: Parser._namespace,
    "{": Parser._block,
    "@": Parser._decorated,
}


def quickly_accepts(text: str, ts: bool, jsx: bool) -> bool:
    """Whether the fast lexer and the parser accept the text; a refusal may be the lexer's fault."""
    if jsx and ("</" in text or "/>" in text) or text.startswith("#!"):
        return False
    k = _DEAD.sub("", fast_kinds(text, ts, jsx))
    return "E" not in k and not Parser(k, ts, jsx, stop=True).program()


def accepts(text: str, ts: bool, jsx: bool) -> bool:
    """Whether the text parses; the fast lexer decides if it can, the exact one otherwise."""
    return quickly_accepts(text, ts, jsx) or not errors(text, ts, jsx)


def errors(text: str, ts: bool, jsx: bool) -> list[tuple[int, str]]:
    """All errors as (offset in the text, message), by the exact lexer."""
    k, where = lex(text, ts, jsx)
    keep = [True] * len(k)
    for m in _DEAD.finditer(k):
        keep[m.start()] = False
    where = [w for w, y in zip(where, keep) if y] + [len(text)] * 4
    k = "".join(c for c, y in zip(k, keep) if y)
    found = Parser(k, ts, jsx).program()
    lexical = [(where[m.start()], "invalid or unterminated token") for m in re.finditer("E", k)]
    return sorted({(where[min(p, len(where) - 1)], e) for p, e in found} | set(lexical))
