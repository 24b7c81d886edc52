"""Tokens and syntax trees of the query language: a precedence-climbing parser."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()

    def __getitem__(self, i: int) -> Any:
        return self.args[i]


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<char>%\\.|%(?=[^\s\d(.])[^\s](?![\w]))
    |(?P<id>[A-Za-z_@$][\w@$]*)
    |(?P<op><&>|<->|-&-|---|<&-|-&>|<--|-->|!<:|<:|>>>|=>|>>|:>|->|\+>|\+\+|&&|\|\||&~|~~|-%|//|!=|!?\((?:<>=|<=|>=|<>|<|>)\)|<<|<=|>=|\{\||\?:|\.\.\.|[-+*/%^(){}\[\],;:.|&~<>=!\\?])
    """,
    re.X,
)

#: An import: a path in braces, after a decoder in brackets if the extension doesn't tell it.
_IMPORT = re.compile(r"//(?:\[([^\]]+)\])?\{([^{}]+)\}")

#: Binary operators by level, weakest first.
LEVELS = [
    {"->", "where", "orderby", "order", "rank", "sum", "max", "min", "mean", "median", "nest", "unnest", "filter", "=>", ">>", ":>", ">>>"},
    {"with", "without"},
    {"||"},
    {"&&"},
    {"+>"},
    {"=", "!=", "<", ">", "<=", ">=", "<:", "!<:"} | {n + c for c in ("(<)", "(<=)", "(>)", "(>=)", "(<>)", "(<>=)") for n in ("", "!")},
    {"if"},
    {"++", "+", "|", "-", "-%"},
    {"&~", "&", "~~", "<&>", "<->", "-&-", "---", "<&-", "-&>", "<--", "-->"},
    {"*", "/", "%", "//", "\\"},
]
WORDS = {w for level in LEVELS for w in level if w.isalpha()} | {"count", "single", "let", "cond", "else", "rec"}
FOLDS = {"sum", "max", "min", "mean", "median"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def _dedent(parts: list) -> list:
    """Without the first line break, and without the indentation after it on every line, if the text starts with them."""
    first = parts[0] if parts and isinstance(parts[0], str) else ""
    if not first.startswith("\n"):
        return parts
    margin = "\n" + re.match(r"\n([ \t]*)", first)[1]
    out = [p.replace(margin, "\n") if isinstance(p, str) else p for p in parts]
    return [out[0][1:], *out[1:]]


class _Template:
    """Reads ``$"...${expr:format:delimiter:tail}..."``: ``parts`` are texts and (node, format, delimiter or None, tail)."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.quote = text, at + 2, text[at + 1]
        parts, start = [], self.at
        while self.more() != self.quote:
            if text.startswith("${", self.at):
                parts += [self.plain(start), self.hole()]
                start = self.at
            else:
                self.at += 2 if text[self.at] == "\\" and self.quote != "`" else 1
        parts.append(self.plain(start))
        self.at += 1
        self.parts = tuple(p for p in _dedent(parts) if p != "")

    def more(self) -> str:
        if self.at >= len(self.text):
            raise ParseError("a text without an end")
        return self.text[self.at]

    def plain(self, start: int) -> str:
        raw = self.text[start : self.at]
        return raw if self.quote == "`" else unescape(raw)

    def hole(self) -> tuple:
        self.at += 2
        start, depth = self.at, 0
        while depth or self.more() not in ":}" or self.text[self.at - 1] == "?" or self.text.startswith(":>", self.at):
            c = self.more()
            if c == "$" and self.text[self.at + 1 : self.at + 2] in ("'", '"', "`"):
                self.at = _Template(self.text, self.at).at
            elif c in "'\"`":
                self.at = _TOKEN.match(self.text, self.at).end()
            else:
                depth += (c in "([{") - (c in ")]}")
                self.at += 1
        node, start = parse(self.text[start : self.at]), self.at
        while self.more() != "}":
            self.at += 2 if self.text[self.at] == "\\" else 1
        control = self.text[start : self.at].split(":", 3)[1:]
        self.at += 1
        form, delimiter, tail = (control + [None] * 3)[:3]
        return (node, form or "", None if delimiter is None else unescape(delimiter), unescape(tail or ""))


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        while at < len(text):
            if text[at] == "$" and text[at + 1 : at + 2] in ("'", '"', "`"):
                made = _Template(text, at)
                self.tokens.append(("template", made.parts))
                at = made.at
                continue
            if m := _IMPORT.match(text, at):
                self.tokens.append(("import", (m[2].strip(), m[1] and parse(m[1]))))
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ParseError(f"cannot read {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.tokens.append(("end", ""))
        self.at, self.patterns = 0, 0

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("op", "id") and value in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ParseError(f"expected {value!r}, found {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind not in ("id", "str"):
            raise ParseError(f"expected a name, found {value!r}")
        self.at += 1
        return value if kind == "id" else unescape(value[1:-1])

    def parse(self) -> Node:
        node = self.expr()
        if self.tokens[self.at][0] != "end":
            raise ParseError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def expr(self) -> Node:
        if self.take("let"):
            self.take("rec")
            pattern = self.pattern()
            if pattern.kind == "tuple" and self.take(";"):
                return Node("scoped", (pattern, self.expr()))
            self.need("=")
            value = self.expr()
            self.need(";")
            return Node("let", (pattern, value, self.expr()))
        if self.take("\\"):
            pattern = self.pattern()
            return Node("fn", (pattern, self.expr()))
        return self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.power()
        if level == 1 and self.peek("=>", ">>", ":>"):
            # Without a left side: an arrow from the dot.
            op = self.tokens[self.at][1]
            self.at += 1
            return Node("arrow", (op, Node("name", (".",)), Node("fn", (self.pattern(), self.expr())) if self.take("\\") else self.binary(1)))
        left = self.binary(level + 1)
        chain: list = []
        while self.tokens[self.at][0] in ("op", "id") and self.tokens[self.at][1] in LEVELS[level]:
            op = self.tokens[self.at][1]
            self.at += 1
            if level == 5:
                chain.append((op, self.binary(level + 1)))
            elif op == "if":
                test = self.binary(level + 1)
                self.need("else")
                left = Node("cond", (((test, left),), self.binary(level)))
            elif op == "nest":
                left = self.nest(left)
            elif op == "unnest":
                left = Node("unnest", (left, self.name()))
            elif op == "rank":
                left = Node("rank", (left, self.power()))
            elif op == "filter":
                left = Node("filter", (left, Node("name", (".",)) if self.peek("{") else self.binary(1), self.cases(True)))
            elif level == 0:
                right = Node("fn", (self.pattern(), self.expr())) if self.take("\\") else self.binary(1)
                left = Node("arrow", (op, left, right))
            else:
                left = Node("bin", (op, left, self.binary(level + 1)))
        if chain:
            left = Node("compare", (left, tuple(chain)))
        return left

    def nest(self, left: Node) -> Node:
        inverse = self.take("~")
        if not self.take("|"):
            return Node("nest1", (left, self.name()))
        names = self.names("|")
        return Node("nest", (left, tuple(names), inverse, self.name()))

    def names(self, end: str) -> list[str]:
        out = []
        while not self.take(end):
            out.append(self.name())
            self.take(",")
        return out

    def cases(self, patterns: bool = False) -> tuple:
        self.need("{")
        out = []
        while not self.take("}"):
            test = self.pattern(True) if patterns else self.expr()
            self.need(":")
            out.append((test, self.expr()))
            self.take(",")
        return tuple(out)

    def power(self) -> Node:
        left = self.unary()
        if self.take("^"):
            return Node("bin", ("^", left, self.power()))
        return left

    def unary(self) -> Node:
        for op in ("-", "+", "!", "^", "*", "&"):
            if self.take(op):
                return Node("unary", (op, self.unary()))
        return self.postfix()

    def postfix(self) -> Node:
        node = self.primary()
        if node.kind == "get" and node[2] is None and self.peek("?"):
            node = self.safe(node)
        while True:
            if self.take("count"):
                node = Node("count", (node,))
            elif self.take("single"):
                node = Node("single", (node,))
            elif (tail := self.tail(node)) is not None:
                node = self.safe(tail) if self.peek("?") and tail.args[-1] is None else tail
            else:
                return node

    def tail(self, node: Node) -> Node | None:
        """A call or an attribute after ``node``, if one follows."""
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return Node("call", (node, tuple(args), self.fallback()))
        kind, value = self.tokens[self.at + 1] if self.peek(".") else ("", "")
        if kind in ("id", "str") or value in ("|", "~", "&"):
            self.at += 1
            return self.attribute(node)
        return None

    def fallback(self) -> Node | None:
        if self.take("?:") or self.peek("?") and self.tokens[self.at + 1][1] == ":" and self.take("?") and self.take(":"):
            return self.unary()
        return None

    def safe(self, first: Node) -> Node:
        """``a.b?.c(k)?:d``: tails after the first that may fail, and whether each may, up to what is taken if one does."""
        hole, tails = Node("name", ("",)), []
        node = Node(first.kind, (hole, *first.args[1:]))
        while True:
            may = self.take("?")
            tails.append((node, may or self.peek("?:")))
            if self.take(":") or self.take("?:"):
                return Node("safe", (first[0], tuple(tails), self.unary()))
            start = self.at
            node = self.tail(hole)
            if node is None:
                raise ParseError(f"expected a fallback, found {self.tokens[start][1]!r}")
            if node.args[-1] is not None and node.kind in ("get", "call"):
                return Node("safe", (first[0], (*tails, (Node(node.kind, (*node.args[:-1], None)), True)), node.args[-1]))

    def attribute(self, node: Node) -> Node:
        inverse = self.take("~")
        if self.take("|"):
            return Node("project", (node, tuple(self.names("|")), inverse))
        name = "&" * self.take("&") + self.name()
        return Node("get", (node, name, self.fallback()))

    def primary(self) -> Node:
        kind, value = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return Node("lit", (float(value),))
        if kind == "str":
            self.at += 1
            return Node("lit", (unescape(value[1:-1]) if value[0] != "`" else value[1:-1],))
        if kind == "import":
            self.at += 1
            return Node("import", value)
        if kind == "template":
            self.at += 1
            return Node("template", (value,))
        if kind == "char":
            self.at += 1
            return Node("lit", (float(ord(unescape(value[1:]))),))
        if kind == "id" and value not in WORDS:
            self.at += 1
            return Node("lit", (value == "true",)) if value in ("true", "false") else Node("name", (value,))
        if self.take("cond"):
            control = None if self.peek("{") else self.binary(1)
            return Node("cond", (self.cases(), None)) if control is None else Node("match", (control, self.cases(True)))
        if self.take("//"):
            path = [self.name()]
            while self.take("."):
                path.append(self.name())
            return Node("std", (".".join(path),))
        if self.take("."):
            if self.tokens[self.at][0] in ("id", "str") and self.tokens[self.at][1] not in WORDS or self.peek("|", "~"):
                return self.attribute(Node("name", (".",)))
            return Node("name", (".",))
        if self.take("("):
            return self.tuple_or_group()
        if self.take("["):
            return Node("array", (tuple(self.items("]")),))
        if self.take("<<"):
            items = []
            while not self.take(">>"):
                items.append(self.primary())
                self.take(",")
            return Node("bytes", (tuple(items),))
        if self.take("{|"):
            names = self.names("|")
            rows = []
            while not self.take("}"):
                self.need("(")
                rows.append(tuple(self.items(")")))
                self.take(",")
            return Node("relation", (tuple(names), tuple(rows)))
        if self.take("{"):
            return self.set_or_dict()
        raise ParseError(f"unexpected {value!r}")

    def items(self, end: str) -> list:
        out = []
        while not self.take(end):
            if self.take(","):
                out.append(None)
                continue
            if self.take("..."):
                out.append(Node("rest", (self.name() if self.tokens[self.at][0] == "id" else "_",)))
            else:
                out.append(self.expr())
            if not self.peek(end):
                self.need(",")
        return out

    def tuple_or_group(self) -> Node:
        if self.take(")"):
            return Node("tuple", ((),))
        if self.peek("&") and self.tokens[self.at + 1][0] == "id" and self.tokens[self.at + 2][1] == ":":
            self.tokens[self.at : self.at + 2] = [("id", "&" + self.tokens[self.at + 1][1])]
        named = self.tokens[self.at][0] in ("id", "str")
        if self.peek(":", "?:", "...") or named and (self.tokens[self.at + 1][1] in (":", "?:") or self.merges(1)):
            fields = []
            while not self.take(")"):
                if self.take("..."):
                    fields.append((None, Node("rest", (self.name() if self.tokens[self.at][0] == "id" else "_",))))
                elif self.take("?:"):
                    name = self.name()
                    self.need(":")
                    fields.append((name, Node("optional", (Node("name", (name,)), self.expr()))))
                elif self.take(":"):
                    inner = self.expr()
                    fields.append((inner.args[1] if inner.kind == "get" else inner.args[0], inner))
                else:
                    name = "&" * self.take("&") + self.name()
                    if self.merges(0):
                        op = self.tokens[self.at][1]
                        self.at += 2
                        # The empty name is what stands before the merge around the tuple.
                        fields.append((name, Node("bin", (op, Node("get", (Node("name", ("",)), name, None)), self.expr()))))
                    elif self.take("?:"):
                        inner = self.pattern()
                        self.need(":")
                        fields.append((name, Node("optional", (inner, self.expr()))))
                    else:
                        self.need(":")
                        fields.append((name, self.expr()))
                self.take(",")
            return Node("tuple", (tuple(fields),))
        items = [self.expr()]
        while self.patterns and self.take(","):
            items.append(self.expr())
        self.need(")")
        return Node("anyof", (tuple(items),)) if self.patterns else items[0]

    def merges(self, ahead: int) -> bool:
        """Whether an operator with a colon follows, as in ``a +> (b+>: (c: 1))``."""
        (_, op), (_, colon) = (self.tokens + [("end", "")] * 2)[self.at + ahead : self.at + ahead + 2]
        return op in ("+>", "|", "++") and colon == ":"

    def set_or_dict(self) -> Node:
        if self.take("}"):
            return Node("set", ((),))
        first = Node("rest", (self.name(),)) if self.take("...") else self.expr()
        if self.take(":"):
            pairs = [(first, self.expr())]
            while self.take(",") and not self.peek("}"):
                if self.take("..."):
                    pairs.append((None, Node("rest", (self.name() if self.tokens[self.at][0] == "id" else "_",))))
                    continue
                key = self.expr()
                self.need(":")
                pairs.append((key, self.expr()))
            self.need("}")
            return Node("dict", (tuple(pairs),))
        items = [first]
        if self.take(","):
            items += self.items("}")
        else:
            self.need("}")
        return Node("set", (tuple(items),))

    def pattern(self, whole: bool = False) -> Node:
        """A pattern; in one, an expression in parentheses, or several, stand for their values. ``whole``: any expression."""
        self.patterns += 1
        try:
            return self.expr() if whole else self.primary()
        finally:
            self.patterns -= 1


def parse(text: str) -> Node:
    return Parser(text).parse()
