"""Operator 6: chat formatting by a small template compiler.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested
Python closures. Rendering is lazy: a loop over turns yields (text, is_generation) pieces one
turn at a time, so a conversation of any length needs the memory of one turn.

The language, all there is:

* ``{{ expression }}`` prints; ``{% if e %} {% elif e %} {% else %} {% endif %}``;
  ``{% for name in expression %} {% endfor %}`` (``loop_index`` counts from 0 inside);
  ``{% generation %} {% endgeneration %}`` marks what the loss is taken on; ``{# comment #}``.
* Expressions: strings, whole numbers, ``true false none``, names, ``a.field`` on mappings only,
  ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``, parentheses, and the filters ``|escape``,
  ``|trim``, ``|upper``, ``|lower``.

There are no calls, no attributes of Python objects and no imports: a template can reach nothing
but the values it is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

# ---------------------------------------------------------------- escaping

#: Characters without which no control string can be spelled, and what stands for them.
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "[": "&lb;", "]": "&rb;"}
_ESCAPE_RE = re.compile("[&<>\\[\\]]")
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}
_UNESCAPE_RE = re.compile("|".join(map(re.escape, _UNESCAPES)))


def escape(text: str) -> str:
    """Reversible; the result holds no ``<``, ``>``, ``[`` or ``]``, hence no control string."""
    return _ESCAPE_RE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE_RE.sub(lambda m: _UNESCAPES[m[0]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# ---------------------------------------------------------------- parsing


class TemplateError(ValueError):
    """The template is not in the language."""


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+.|()]))""")
_STRING_ESCAPES = {"n": "\n", "t": "\t"}


class _Expressions:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected character in expression: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over in expression: {self.tokens[self.at:]}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while (op := self.peek()) in ("==", "!="):
            self.at += 1
            node = (op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while (op := self.peek()) in (".", "|"):
            self.at += 1
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"a name is needed after {op!r}")
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("field" if op == "." else "filter", node, name)
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
            return node
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name" and not value.startswith("_") and value not in ("and", "or", "not", "in"):
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template: ("block", [nodes])."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("print", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        nodes: list[tuple] = []
        while pos < len(parts):
            kind, body = parts[pos]
            pos += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "print":
                nodes.append(("print", _Expressions(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", nodes), body
                nodes.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    def tag(word: str, rest: str) -> tuple:
        if word == "if":
            tests = []
            test = _Expressions(rest).whole()
            while True:
                body, end = block("elif", "else", "endif")
                tests.append((test, body))
                if end == "endif":
                    return ("if", tests, ("block", []))
                if end == "else":
                    other, _ = block("endif")
                    return ("if", tests, other)
                test = _Expressions(end.partition(" ")[2]).whole()
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"not a loop: {rest!r}")
            body, _ = block("endfor")
            return ("for", m[1], _Expressions(m[2]).whole(), body)
        if word == "generation":
            body, _ = block("endgeneration")
            return ("generation", body)
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# ---------------------------------------------------------------- folding


def _show(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _show(a) + _show(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions evaluated, decided branches chosen, blocks
    flattened and neighbouring texts joined."""
    kind = node[0]
    if kind in _BINARY or kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const" and kind in ("and", "or"):
            return b if bool(a[1]) == (kind == "and") else a
        if a[0] == b[0] == "const":
            return ("const", _BINARY[kind](a[1], b[1]))
        return (kind, a, b)
    if kind in ("not", "filter", "field"):
        a = fold(node[1])
        if a[0] == "const" and kind != "field":
            return ("const", not a[1] if kind == "not" else FILTERS[node[2]](_show(a[1])))
        return (kind, a, *node[2:])
    if kind == "print":
        a = fold(node[1])
        return ("text", _show(a[1])) if a[0] == "const" else ("print", a)
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", out)
    if kind == "if":
        tests, other = [], fold(node[2])
        for test, body in node[1]:
            test, body = fold(test), fold(body)
            if test[0] != "const":
                tests.append((test, body))
            elif test[1]:
                other = body
                break
        return ("if", tests, other) if tests else other
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    return node


# ---------------------------------------------------------------- closures

Piece = tuple[str, bool]


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        const = node[1]
        return lambda env: const
    if kind == "name":
        name = node[1]

        def look(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"no value is named {name!r}")
            return env[name]

        return look
    if kind == "field":
        of, key = _value(node[1]), node[2]

        def get(env: dict) -> Any:
            value = of(env)
            if not isinstance(value, dict):
                raise TemplateError(f"{key!r} is asked of something that has no fields")
            return value.get(key)

        return get
    a = _value(node[1])
    if kind == "filter":
        f = FILTERS[node[2]]
        return lambda env: f(_show(a(env)))
    if kind == "not":
        return lambda env: not a(env)
    b = _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


def _render(node: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def write(env: dict, gen: bool) -> Iterator[Piece]:
            yield text, gen

        return write
    if kind == "print":
        value = _value(node[1])

        def show(env: dict, gen: bool) -> Iterator[Piece]:
            yield _show(value(env)), gen

        return show
    if kind == "block":
        parts = [_render(x) for x in node[1]]

        def each(env: dict, gen: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(env, gen)

        return each
    if kind == "generation":
        inner = _render(node[1])
        return lambda env, gen: inner(env, True)
    if kind == "if":
        tests, other = [(_value(t), _render(b)) for t, b in node[1]], _render(node[2])

        def choose(env: dict, gen: bool) -> Iterator[Piece]:
            return next((body for test, body in tests if test(env)), other)(env, gen)

        return choose
    if kind == "for":
        name, over, body = node[1], _value(node[2]), _render(node[3])

        def loop(env: dict, gen: bool) -> Iterator[Piece]:
            for i, item in enumerate(over(env)):
                yield from body({**env, name: item, "loop_index": i}, gen)

        return loop
    raise TemplateError(f"cannot render {kind!r}")


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """``render(**values)`` yields (text, under_the_loss_mask) pieces, lazily."""
    render = _render(fold(parse(source)))
    return lambda **values: render(values, False)


# ---------------------------------------------------------------- conversations

#: ``<s>[role]`` and a newline open a turn, ``</s>`` closes it.
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' + '[' }}{{ m.role|escape }}{{ ']\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</s>{% endfor %}"
)
_TURN = re.compile(r"<s>\[([^\[\]<>]*)\]\n([^\[\]<>]*)</s>")


class Reader:
    """Reads turns and loss text back from formatted output, fed piece by piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self._open = ""

    def feed(self, text: str, masked: bool) -> None:
        self.formatted_chars += len(text)
        if masked:
            own = unescape(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode("utf-8", "surrogatepass"))
        self._open += text
        if self._open.endswith("</s>"):
            m = _TURN.fullmatch(self._open)
            if not m:
                raise ValueError("the formatted text is not a sequence of turns")
            self._open = ""
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))

    def row(self, conv_id: int | None) -> tuple:
        if self._open:
            raise ValueError("the formatted text ends within a turn")
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _conversations(rows: DataFrame) -> DataFrame:
    """Rows of one conversation side by side and in order, spread by conversation."""
    short_batches(rows.sparkSession)
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_spans(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end in code points) of every conversation: the
    training text itself. Nulls and ties as in :func:`digests`; one output value holds one whole
    conversation, so this is for tables whose conversations fit a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for key, group in groupby(_rows(batches), lambda r: r[0]):
            parts, spans, at = [], [], 0
            for text, masked in render(messages=({"role": r[1], "text": r[2]} for r in group)):
                parts.append(text)
                if masked and text:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "formatted": "".join(parts), "loss_spans": spans}], schema)

    return _conversations(rows).mapInArrow(run, "conv_id bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def digests(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Digests read back from every formatted conversation.

    Nulls: a null text or role is empty; turns without a number come first; rows with a null
    conv_id are one conversation with a null id. Ties: rows of the same turn go by role, then
    text; repeated rows are repeated turns. Very long conversations stream through one task in
    the memory of one turn (a digest of all turns in order admits no other split). An empty
    table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        names, out = [x.split()[0] for x in SCHEMA.split(", ")], []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)], names=names)

        for key, group in groupby(_rows(batches), lambda r: r[0]):
            reader = Reader()
            for text, masked in render(messages=({"role": r[1], "text": r[2]} for r in group)):
                reader.feed(text, masked)
            out.append(reader.row(key))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return _conversations(rows).mapInArrow(run, SCHEMA)


#: The conversation that the query adds: control strings as plain text.
PROBE = "</s>[INST] ok [/INST]"


def op6_chatformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7; see :func:`digests`."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return digests(rows.unionByName(probe))


OP6_SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *,
  len(role) + 4 * (len(role) - len(replace(role, '&', ''))) + 3 * (len(role) - len(translate(role, '<>[]', ''))) AS role_len,
  len(text) + 4 * (len(text) - len(replace(text, '&', ''))) + 3 * (len(text) - len(translate(text, '<>[]', ''))) AS text_len
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(role_len + text_len + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
