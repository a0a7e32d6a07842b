"""A sandboxed template language: text to a syntax tree, constants folded, compiled to Python closures.

    {{ expression }}                        writes a value
    {% for x in expression %} .. {% endfor %}   ``loop.first``, ``loop.index`` (from 1), ``loop.index0``
    {% if a %} .. {% elif b %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}     marks what a model is trained to write
    {% set x = expression %}
    {# comment #}

Expressions: names, ``a.b`` (keys of mappings only, never attributes), strings, whole numbers, true, false, none,
``== != + and or not in``, parentheses, and filters ``| escape`` given to ``compile_template``. There are no calls,
no imports and no attributes of Python objects, so a template can reach nothing but the values it is given. Loops go
over the given values lazily: a conversation is rendered turn by turn, never held as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from enum import Enum
from typing import Any

TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|().+]))", re.S)
BLOCK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}


class Mark(Enum):
    """The edges of generation stretches in the stream of rendered text."""

    START = 0
    END = 1


START, END = Mark.START, Mark.END


class TemplateError(ValueError):
    pass


# -- syntax tree: tuples whose first entry names the node ------------------------------------------------------------


class _Expression:
    """A recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.joined()
        while sign := self.take("==", "!=", "in"):
            left = (sign, left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.value()
        while self.take("|"):
            value = ("filter", self.name(), value)
        return value

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] in ("string", "number"):
            kind, raw = self.tokens[self.at]
            self.at += 1
            tree = ("const", int(raw) if kind == "number" else re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S))
        else:
            word = self.name()
            if word in ("and", "or", "not", "in"):
                raise TemplateError(f"unexpected {word!r}")
            tree = ("const", CONSTANTS[word]) if word in CONSTANTS else ("name", word)
        while self.take("."):
            tree = ("key", tree, self.name())
        return tree


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts = iter([p for p in BLOCK.split(source) if p and not p.startswith("{#")])
    tree, end = _body(parts)
    if end:
        raise TemplateError(f"unexpected {end!r}")
    return tree


def _body(parts: Iterator[str]) -> tuple[list[tuple], str]:
    out: list[tuple] = []
    for part in parts:
        if part.startswith("{{"):
            out.append(("write", _Expression(part[2:-2]).parse()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in ("elif", "else", "endif", "endfor", "endgeneration"):
                return out, f"{word} {rest}".strip()
            out.append(_block(word, rest.strip(), parts))
        else:
            out.append(("text", part))
    return out, ""


def _block(word: str, rest: str, parts: Iterator[str]) -> tuple:
    if word == "set":
        name, _, value = rest.partition("=")
        if not name.strip().isidentifier():
            raise TemplateError(f"can't set {name.strip()!r}")
        return ("set", name.strip(), _Expression(value).parse())
    if word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        body, end = _body(parts)
        if not m or end != "endfor":
            raise TemplateError("a for loop is 'for name in values' up to 'endfor'")
        return ("for", m[1], _Expression(m[2]).parse(), body)
    if word == "generation":
        body, end = _body(parts)
        if end != "endgeneration":
            raise TemplateError("'generation' isn't closed")
        return ("generation", body)
    if word == "if":
        body, end = _body(parts)
        if end.startswith("elif "):
            return ("if", _Expression(rest).parse(), body, [_block("if", end[5:], parts)])
        other: list[tuple] = []
        if end == "else":
            other, end = _body(parts)
        if end != "endif":
            raise TemplateError("'if' isn't closed")
        return ("if", _Expression(rest).parse(), body, other)
    raise TemplateError(f"unknown block {word!r}")


# -- constant folding -----------------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _plus, "in": lambda a, b: _text(a) in b if isinstance(b, str) else False}


def fold(tree: tuple, filters: Mapping[str, Callable[[str], str]]) -> tuple:
    """An expression with every part that depends on no name replaced by its value."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "key":
        return ("key", fold(tree[1], filters), tree[2])
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        value = fold(tree[2], filters)
        return ("const", filters[tree[1]](_text(value[1]))) if value[0] == "const" else ("filter", tree[1], value)
    parts = [fold(x, filters) for x in tree[1:]]
    known = [x[1] for x in parts if x[0] == "const"]
    if kind == "not":
        return ("const", not known[0]) if known else ("not", *parts)
    if kind in ("and", "or"):
        if parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        return (kind, *parts)
    return ("const", OPERATORS[kind](*known)) if len(known) == 2 else (kind, *parts)


def fold_body(body: list[tuple], filters: Mapping[str, Callable[[str], str]]) -> list[tuple]:
    """Statements with constant branches taken and neighbouring constant texts joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "write":
            value = fold(node[1], filters)
            new = [("text", _text(value[1]))] if value[0] == "const" else [("write", value)]
        elif kind == "if":
            test, yes, no = fold(node[1], filters), fold_body(node[2], filters), fold_body(node[3], filters)
            new = (yes if test[1] else no) if test[0] == "const" else [("if", test, yes, no)]
        elif kind == "for":
            new = [("for", node[1], fold(node[2], filters), fold_body(node[3], filters))]
        elif kind == "generation":
            new = [("generation", fold_body(node[1], filters))]
        elif kind == "set":
            new = [("set", node[1], fold(node[2], filters))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# -- closures -------------------------------------------------------------------------------------------------------


def _value(tree: tuple, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda names: constant
    if kind == "name":
        word = tree[1]
        return lambda names: names.get(word)
    if kind == "key":
        of, key = _value(tree[1], filters), tree[2]

        def lookup(names: dict) -> Any:
            found = of(names)
            return found.get(key) if type(found) is dict else None

        return lookup
    if kind == "filter":
        change, of = filters[tree[1]], _value(tree[2], filters)
        return lambda names: change(_text(of(names)))
    if kind == "not":
        of = _value(tree[1], filters)
        return lambda names: not of(names)
    a, b = _value(tree[1], filters), _value(tree[2], filters)
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    apply = OPERATORS[kind]
    return lambda names: apply(a(names), b(names))


def _statement(node: tuple, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict], Iterator]:
    kind = node[0]
    if kind == "text":
        constant = (node[1],)
        return lambda names: constant
    if kind == "write":
        of = _value(node[1], filters)
        return lambda names: (_text(of(names)),)
    if kind == "if":
        test, yes, no = _value(node[1], filters), _closure(node[2], filters), _closure(node[3], filters)
        return lambda names: yes(names) if test(names) else no(names)
    if kind == "generation":
        body = _closure(node[1], filters)

        def mark(names: dict) -> Iterator:
            yield START
            yield from body(names)
            yield END

        return mark
    if kind == "set":
        word, of = node[1], _value(node[2], filters)

        def assign(names: dict) -> tuple:
            names[word] = of(names)
            return ()

        return assign
    word, values, body = node[1], _value(node[2], filters), _closure(node[3], filters)

    def loop(names: dict) -> Iterator:
        for k, value in enumerate(values(names) or ()):
            yield from body({**names, word: value, "loop": {"first": k == 0, "index": k + 1, "index0": k}})

    return loop


def _closure(body: list[tuple], filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict], Iterator]:
    steps = [_statement(node, filters) for node in body]

    def run(names: dict) -> Iterator:
        for step in steps:
            yield from step(names)

    return run


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]] | None = None) -> Callable[[dict], Iterator]:
    """A function of the names' values that yields texts, and START and END around generation stretches."""
    filters = dict(filters or {})
    return _closure(fold_body(parse(source), filters), filters)


def render(program: Callable[[dict], Iterator], **names: Any) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and its generation stretches, in code points."""
    out, spans, at = [], [], 0
    for part in program(names):
        if part is START:
            spans.append((at, at))
        elif part is END:
            spans[-1] = (spans[-1][0], at)
        else:
            out.append(part)
            at += len(part)
    return "".join(out), spans
