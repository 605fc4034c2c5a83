"""Chat formatting with a template compiler.

A small sandboxed template language (texts, ``{{ expression }}``, ``{% for/if/set/generation %}``) is parsed into a syntax
tree, constants are folded, and the tree becomes Python closures that write text and the spans of generation blocks.
Templates reach only the values they are given, their items, the filters below and ``loop``; nothing can be called.

Control strings start with ``<|``. The filter ``escape`` puts one more backslash between ``<``, any backslashes and ``|``,
and ``unescape`` takes it away, so no text can hold a control string and every text comes back.

Null text and null roles count as empty. Turns of a conversation are ordered by turn, then role and text; nulls first.
Null conversation ids are one conversation.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks turns; assistant texts are generation spans.
CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role | header }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


class TemplateError(ValueError):
    pass


def escape(text: object) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", str(text))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(text: object) -> str:
    """One line, escaped: backslashes and line ends too."""
    return escape(str(text).replace("\\", "\\\\").replace("\n", "\\n"))


def from_header(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


FILTERS: dict[str, Callable] = {
    "escape": escape, "header": header, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(),
    "length": len, "default": lambda x, other="": other if x is None else x, "replace": lambda x, a, b: str(x).replace(a, b), "first": lambda x: x[0], "last": lambda x: x[-1],
}
BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod, "~": lambda a, b: f"{shown(a)}{shown(b)}", "in": lambda a, b: a in b,
}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))
LEXEME = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))""", re.S)
PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)


def shown(x: object) -> str:
    return "" if x is None else str(x)


# Expressions: ("const", value), ("name", name), ("item", of, key), ("not", e), (binary operator, a, b), ("filter", name, e, arguments).
class Expression:
    def __init__(self, text: str) -> None:
        self.lexemes, at = [], 0
        while text[at:].strip():
            m = LEXEME.match(text, at)
            if m is None:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.lexemes.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.lexemes[self.at][1] if self.at < len(self.lexemes) and self.lexemes[self.at][0] != "string" else None

    def take(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at >= len(self.lexemes) or self.lexemes[self.at][0] != "name":
            raise TemplateError("name expected")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r}")

    def parse(self, level: int = 0) -> tuple:
        if level == len(LEVELS):
            return self.unary()
        if level == 2 and self.take("not"):
            return ("not", self.parse(2))
        left = self.parse(level + 1)
        while self.peek() in LEVELS[level]:
            op = self.lexemes[self.at][1]
            self.at += 1
            left = (op, left, self.parse(level + 1))
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("-", ("const", 0), self.unary())
        if self.take("("):
            e = self.parse()
            self.need(")")
        elif self.at >= len(self.lexemes):
            raise TemplateError("expression expected")
        else:
            kind, value = self.lexemes[self.at]
            self.at += 1
            if kind == "number":
                e = ("const", int(value))
            elif kind == "string":
                e = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
            elif kind == "name":
                e = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take("."):
                e = ("item", e, ("const", self.name()))
            elif self.take("["):
                e = ("item", e, self.parse())
                self.need("]")
            elif self.take("|"):
                name, arguments = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        arguments.append(self.parse())
                        if self.peek() != ")":
                            self.need(",")
                e = ("filter", name, e, tuple(arguments))
            else:
                return e


# Statements: ("text", s), ("put", e), ("for", name, e, body), ("if", ((test or None, body), ...)), ("set", name, e), ("generation", body).
def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in PART.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[1] or m[4] else text))
        if m[2] is not None:
            parts.append(("put", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6])
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        body = []
        while parts:
            kind, value = parts.pop(0)
            if kind == "text":
                if value:
                    body.append(("text", value))
                continue
            e = Expression(value)
            if kind == "put":
                body.append(("put", e.parse()))
                e.end()
                continue
            word = e.name()
            if word in ends:
                if word != "elif":
                    e.end()
                return tuple(body), value
            if word == "for":
                name = e.name()
                e.need("in")
                over = e.parse()
                inner, _ = block(("endfor",))
                body.append(("for", name, over, inner))
            elif word == "if":
                arms, test = [], e.parse()
                while True:
                    inner, stop = block(("elif", "else", "endif") if test is not None else ("endif",))
                    arms.append((test, inner))
                    if stop.startswith("endif"):
                        break
                    after = Expression(stop)
                    test = after.parse() if after.name() == "elif" else None
                    if test is not None:
                        after.end()
                body.append(("if", tuple(arms)))
            elif word == "set":
                name = e.name()
                e.need("=")
                body.append(("set", name, e.parse()))
            elif word == "generation":
                inner, _ = block(("endgeneration",))
                body.append(("generation", inner))
            else:
                raise TemplateError(f"unknown tag {word!r}")
            e.end()
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(body), ""

    return block(())[0]


def fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    if e[0] == "filter":
        e = ("filter", e[1], fold_expression(e[2]), tuple(map(fold_expression, e[3])))
        parts = (e[2], *e[3])
    else:
        e = (e[0], *map(fold_expression, e[1:]))
        parts = e[1:]
    if all(p[0] == "const" for p in parts):
        try:
            return ("const", expression(e)({}))
        except Exception:
            return e  # it fails when and if it is reached
    return e


def fold(body: tuple) -> tuple:
    """Constants computed, dead branches dropped, neighbouring texts joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "put":
            e = fold_expression(node[1])
            put(("text", shown(e[1])) if e[0] == "const" else ("put", e))
        elif node[0] == "for":
            put(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            put(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            put(("generation", fold(node[1])))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = None if test is None else fold_expression(test)
                if test is not None and test[0] == "const":
                    if not test[1]:
                        continue
                    test = None
                arms.append((test, fold(inner)))
                if test is None:
                    break
            if arms and arms[0][0] is None:
                for inner in arms[0][1]:
                    put(inner)
            elif arms:
                put(("if", tuple(arms)))
        else:
            put(node)
    return tuple(out)


def item(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key]
    raise TemplateError(f"no item {key!r}")


def expression(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda _, value=e[1]: value
    if kind == "name":
        return lambda names, name=e[1]: names.get(name)
    if kind == "filter":
        f, of, arguments = FILTERS[e[1]], expression(e[2]), tuple(map(expression, e[3]))
        return (lambda names: f(of(names), *(a(names) for a in arguments))) if arguments else (lambda names: f(of(names)))
    parts = tuple(map(expression, e[1:]))
    if kind == "not":
        return lambda names: not parts[0](names)
    a, b = parts
    if kind == "item":
        return lambda names: item(a(names), b(names))
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    f = BINARY[kind]
    return lambda names: f(a(names), b(names))


class Output:
    """Text written so far, in code points, and the spans of generation blocks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def closure(body: tuple) -> Callable[[dict, Output], None]:
    steps = tuple(map(_statement, body))
    if len(steps) == 1:
        return steps[0]

    def run(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return run


def _statement(node: tuple) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda _, out, text=node[1]: out.put(text)
    if kind == "put":
        e = expression(node[1])
        return lambda names, out: out.put(shown(e(names)))
    if kind == "set":
        e = expression(node[2])
        return lambda names, _, name=node[1]: names.__setitem__(name, e(names))
    if kind == "generation":
        inner = closure(node[1])

        def generation(names: dict, out: Output) -> None:
            begin = out.at
            inner(names, out)
            out.spans.append((begin, out.at))

        return generation
    if kind == "for":
        name, over, inner = node[1], expression(node[2]), closure(node[3])

        def loop(names: dict, out: Output) -> None:
            values = over(names) or ()
            last = len(values) - 1
            for k, value in enumerate(values):
                inner(names | {name: value, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == last}}, out)

        return loop
    arms = tuple((None if test is None else expression(test), closure(inner)) for test, inner in node[1])

    def choose(names: dict, out: Output) -> None:
        for test, inner in arms:
            if test is None or test(names):
                inner(names, out)
                return

    return choose


@cache
def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """Function of messages (dicts with role and text) that returns the text and its generation spans."""
    run = closure(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def format_conversations(turns: DataFrame, template: str = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return ``id_col``, text, loss array<struct<start, end>> (code points) per conversation.

    Rows are dealt out by conversation and sorted within partitions; a task holds the turns of one conversation at a time.
    """
    compiled(template)  # a faulty template fails here
    rows = turns.select(F.col(id_col).alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, key_type = compiled(template), None

        def each() -> Iterator[tuple]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column("key").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True)

        keys, texts, spans, size = [], [], [], 0
        for key, group in groupby(each(), key=lambda r: r[0]):
            text, found = render([{"role": role, "text": said} for _, role, said in group])
            keys.append(key)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in found])
            size += len(text)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(texts, pa.string()), pa.array(spans, loss)], ["key", "text", "loss"])
                keys, texts, spans, size = [], [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(texts, pa.string()), pa.array(spans, loss)], ["key", "text", "loss"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string, loss array<struct<start:long,end:long>>").withColumnRenamed("key", id_col)


def turns_of(text: str) -> Iterable[tuple[str, str]]:
    """Roles and texts back from a text of the CHATML template."""
    for part in text.split(CLOSE)[:-1]:
        role, said = part.removeprefix(OPEN).split("\n", 1)
        yield from_header(role), unescape(said)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Return ``id_col``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [], [])
            for text, loss in zip(batch.column("text").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns, digest = 0, hashlib.sha256()
                for role, said in turns_of(text):
                    turns += 1
                    digest.update(f"{role}\n{said}\n".encode())
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                for column, value in zip(found, (turns, digest.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(id_col).alias("key"), "text", "loss")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("key", id_col)
