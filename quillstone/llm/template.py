"""A small sandboxed template language for chat formats, compiled to Python closures.

Syntax: `{{ expr }}`, `{% for x in expr %} .. {% endfor %}`, `{% if e %} .. {% elif e %} ..
{% else %} .. {% endif %}`, `{% generation %} .. {% endgeneration %}` around what a model is
to learn, and `{# comments #}`. Expressions: literals, names, `a.b` and `a['b']` (mapping keys and
list items only: no attributes, no calls), `+`, comparisons, `and`, `or`, `not`, `in`,
parentheses, and filters `|name` from a fixed table. There is no way to reach Python objects.

`compile_template` parses to a syntax tree, folds constants (including branches that can't
be taken and neighbouring text), and returns a function from a context to a stream of
(text, learnt) parts: a conversation of any length is rendered without holding it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that can't be parsed, or that asks for what it may not have."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Parser:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at : at + 10]!r}")
            kind = ("string", "number", "name", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "string"

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected one of {values}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.peek("or"):
            self.take("or")
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negation()
        while self.peek("and"):
            self.take("and")
            out = Op("and", (out, self.negation()))
        return out

    def negation(self) -> Any:
        if self.peek("not"):
            self.take("not")
            return Op("not", (self.negation(),))
        return self.comparison()

    def comparison(self) -> Any:
        out = self.total()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            op = self.take("==", "!=", "<", ">", "<=", ">=", "in")
            out = Op(op, (out, self.total()))
        return out

    def total(self) -> Any:
        out = self.filtered()
        while self.peek("+"):
            self.take("+")
            out = Op("+", (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.primary()
        while self.peek("|"):
            self.take("|")
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name":
                raise TemplateError("a filter needs a name")
            self.at += 1
            out = Filter(name, out)
        return out

    def primary(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            out: Any = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "number":
            out = Const(int(text))
        elif kind == "name" and text not in ("and", "or", "not", "in"):
            out = Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Name(text)
        elif text == "(":
            out = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no access to {name!r}")
                self.at += 1
                out = Item(out, Const(name))
            else:
                out = Item(out, self.either())
                self.take("]")
        return out


def parse(source: str) -> tuple:
    """Syntax tree of a template: a tuple of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes: list = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Out(Const(text)))
            elif kind == "out":
                nodes.append(Out(_Parser(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(nodes), text
                if word == "if":
                    nodes.append(branch(rest))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"malformed loop {text!r}")
                    inner, _ = body("endfor")
                    nodes.append(For(m[1], _Parser(m[2]).whole(), inner))
                elif word == "generation":
                    inner, _ = body("endgeneration")
                    nodes.append(Generation(inner))
                else:
                    raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, end = body("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        if word == "elif":
            return If(_Parser(test).whole(), then, (branch(rest),))
        other = body("endif")[0] if word == "else" else ()
        return If(_Parser(test).whole(), then, other)

    return body()[0]


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
}


def fold_expr(e: Any, filters: dict[str, Callable]) -> Any:
    if isinstance(e, Op):
        args = tuple(fold_expr(a, filters) for a in e.args)
        known = [a.value for a in args if isinstance(a, Const)]
        if e.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
        if len(known) == len(args) and e.op not in ("and", "or"):
            return Const(not known[0] if e.op == "not" else _BINARY[e.op](*known))
        return Op(e.op, args)
    if isinstance(e, Filter):
        if e.name not in filters:
            raise TemplateError(f"unknown filter {e.name!r}")
        arg = fold_expr(e.arg, filters)
        return Const(filters[e.name](arg.value)) if isinstance(arg, Const) else Filter(e.name, arg)
    if isinstance(e, Item):
        return Item(fold_expr(e.base, filters), fold_expr(e.key, filters))
    return e


def fold(nodes: Iterable, filters: dict[str, Callable]) -> tuple:
    """Fold constants, drop branches that can't be taken, and join neighbouring text."""
    out: list = []

    def add(n: Any) -> None:
        if isinstance(n, Out) and isinstance(n.expr, Const):
            text = "" if n.expr.value is None else str(n.expr.value)
            if not text:
                return
            if out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                out[-1] = Out(Const(out[-1].expr.value + text))
                return
            n = Out(Const(text))
        out.append(n)

    for n in nodes:
        if isinstance(n, Out):
            add(Out(fold_expr(n.expr, filters)))
        elif isinstance(n, If):
            test = fold_expr(n.test, filters)
            if isinstance(test, Const):
                for x in fold(n.then if test.value else n.other, filters):
                    add(x)
            else:
                add(If(test, fold(n.then, filters), fold(n.other, filters)))
        elif isinstance(n, For):
            add(For(n.name, fold_expr(n.items, filters), fold(n.body, filters)))
        else:
            add(Generation(fold(n.body, filters)))
    return tuple(out)


def _closure(e: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name
        return lambda env: env.get(name)
    if isinstance(e, Item):
        base, key = _closure(e.base, filters), _closure(e.key, filters)

        def item(env: dict) -> Any:
            b, k = base(env), key(env)
            if isinstance(b, dict):
                return b.get(k)
            if isinstance(b, (list, tuple)) and isinstance(k, int):
                return b[k]
            raise TemplateError(f"no item {k!r}")

        return item
    if isinstance(e, Filter):
        fn, arg = filters[e.name], _closure(e.arg, filters)
        return lambda env: fn(arg(env))
    args = [_closure(a, filters) for a in e.args]
    if e.op == "not":
        return lambda env: not args[0](env)
    if e.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.op == "or":
        return lambda env: args[0](env) or args[1](env)
    fn, (left, right) = _BINARY[e.op], args
    return lambda env: fn(left(env), right(env))


Part = tuple[str, bool]


def _block(nodes: tuple, filters: dict[str, Callable], learnt: bool) -> Callable[[dict], Iterator[Part]]:
    steps: list[Callable[[dict], Iterator[Part]]] = []
    for n in nodes:
        if isinstance(n, Out):
            fn = _closure(n.expr, filters)

            def say(env: dict, fn: Callable = fn) -> Iterator[Part]:
                value = fn(env)
                if value is not None and value != "":
                    yield str(value), learnt

            steps.append(say)
        elif isinstance(n, If):
            test, then, other = _closure(n.test, filters), _block(n.then, filters, learnt), _block(n.other, filters, learnt)
            steps.append(lambda env, test=test, then=then, other=other: (then if test(env) else other)(env))
        elif isinstance(n, For):
            items, inner, name = _closure(n.items, filters), _block(n.body, filters, learnt), n.name

            def loop(env: dict, items: Callable = items, inner: Callable = inner, name: str = name) -> Iterator[Part]:
                for i, x in enumerate(items(env)):
                    yield from inner(env | {name: x, "loop": {"index0": i, "first": i == 0}})

            steps.append(loop)
        else:
            steps.append(_block(n.body, filters, True))

    def run(env: dict) -> Iterator[Part]:
        for s in steps:
            yield from s(env)

    return run


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[[dict], Iterator[Part]]:
    """A renderer: context -> parts of text, each with whether a generation block holds it."""
    filters = {"trim": lambda s: (s or "").strip(), "upper": lambda s: (s or "").upper(), "lower": lambda s: (s or "").lower()} | (filters or {})
    return _block(fold(parse(source), filters), filters, False)
