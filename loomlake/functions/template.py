"""Prompt templates compiled to one Column: fields, loops and conditions become concat, transform and when.

    {{ doc }}{% for k in keys %}{{ loop.index }}. {{ k.name | upper }}{% if not loop.last %}, {% else %}.{% endif %}{% endfor %}

Fields are columns and struct members, by dots; loops run over arrays, at any depth; `loop` has index, index0, first, last
and length. Conditions are fields, numbers, strings, comparisons (== != < <= > >=), and, or, not; what is null, false, zero,
an empty string or an empty array counts as false. Filters: upper, lower, trim, length, default('x'), join('x'), tojson. A
null prints as nothing, a boolean as True or False. `-` inside a tag's bracket takes the white space on that side away,
`{# #}` is left out, and one line break at the template's end goes. The template is read once, when the Column is made; what
it names is checked against the schema then.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_WORD = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>|().,]))""")

Typed = tuple[Column, T.DataType]


class TemplateError(ValueError):
    pass


def _pieces(text: str) -> list[tuple[str, str]]:
    """("text", ...), ("show", expression) and ("do", statement) in order."""
    out, at, eat = [], 0, False
    text = text[:-1] if text.endswith("\n") else text
    for m in _TAG.finditer(text):
        plain = text[at : m.start()]
        plain = plain.lstrip() if eat else plain
        left, right = (next((m[i] for i in places if m[i] is not None), "") for places in ((1, 4, 7), (3, 6, 8)))
        out.append(("text", plain.rstrip() if left else plain))
        if m[2] is not None:
            out.append(("show", m[2].strip()))
        elif m[5] is not None:
            out.append(("do", m[5].strip()))
        at, eat = m.end(), bool(right)
    out.append(("text", text[at:].lstrip() if eat else text[at:]))
    return [p for p in out if p[1] or p[0] != "text"]


class _Expression:
    """One expression, read by descent: or, and, not, comparison, filters, field or literal."""

    def __init__(self, text: str, scope: dict):
        self.text, self.scope, self.words, self.at = text, scope, [], 0
        place = 0
        while text[place:].strip():
            m = _WORD.match(text, place)
            if not m:
                raise TemplateError(f"cannot read {text[place:]!r}")
            self.words.append(next((k, v) for k, v in zip(("string", "number", "name", "sign"), m.groups()) if v is not None))
            place = m.end()

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] in ("sign", "name") and self.words[self.at][1] in signs

    def take(self, *signs: str) -> str:
        if not self.peek(*signs):
            raise TemplateError(f"{' or '.join(signs)} wanted in {self.text!r}")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> Typed:
        out = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"more than one expression in {self.text!r}")
        return out

    def either(self) -> Typed:
        out = self.both()
        while self.peek("or"):
            self.take("or")
            out = truth(*out) | truth(*self.both()), T.BooleanType()
        return out

    def both(self) -> Typed:
        out = self.negated()
        while self.peek("and"):
            self.take("and")
            out = truth(*out) & truth(*self.negated()), T.BooleanType()
        return out

    def negated(self) -> Typed:
        if self.peek("not"):
            self.take("not")
            return ~truth(*self.negated()), T.BooleanType()
        left = self.filtered()
        if not self.peek("==", "!=", "<", "<=", ">", ">="):
            return left
        sign, (a, _), (b, _) = self.take("==", "!=", "<", "<=", ">", ">="), left, self.filtered()
        made = {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]
        return F.coalesce(made, F.lit(False)), T.BooleanType()

    def filtered(self) -> Typed:
        column, kind = self.single()
        while self.peek("|"):
            self.take("|")
            name, args = self.words[self.at][1], []
            self.at += 1
            if self.peek("("):
                self.take("(")
                while not self.peek(")"):
                    args.append(self.either())
                    if self.peek(","):
                        self.take(",")
                self.take(")")
            column, kind = self.filter(name, column, kind, args)
        return column, kind

    def filter(self, name: str, c: Column, kind: T.DataType, args: list[Typed]) -> Typed:
        if name in ("upper", "lower", "trim"):
            return getattr(F, name)(shown(c, kind)), T.StringType()
        if name == "length":
            return F.coalesce(F.size(c) if isinstance(kind, T.ArrayType) else F.length(shown(c, kind)), F.lit(0)), T.IntegerType()
        if name == "default" and len(args) == 1:
            return F.coalesce(c, args[0][0]), kind
        if name == "join" and isinstance(kind, T.ArrayType) and len(args) <= 1:
            inner = kind.elementType
            return F.array_join(F.transform(c, lambda x: shown(x, inner)), self._literal(args)), T.StringType()
        if name == "tojson":
            if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
                return F.to_json(c), T.StringType()
            one = F.to_json(F.array(c))
            return F.coalesce(one.substr(F.lit(2), F.length(one) - 2), F.lit("null")), T.StringType()
        raise TemplateError(f"no filter {name} here: {self.text!r}")

    def _literal(self, args: list[Typed]) -> str:
        if not args:
            return ""
        found = next((w for k, w in reversed(self.words[: self.at]) if k == "string"), None)
        if found is None:
            raise TemplateError(f"join takes a string in {self.text!r}")
        return _string(found)

    def single(self) -> Typed:
        if self.at >= len(self.words):
            raise TemplateError(f"ends too early: {self.text!r}")
        if self.peek("("):
            self.take("(")
            out = self.either()
            self.take(")")
            return out
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "string":
            return F.lit(_string(word)), T.StringType()
        if kind == "number":
            return (F.lit(float(word)), T.DoubleType()) if "." in word else (F.lit(int(word)), T.LongType())
        if kind == "sign":
            raise TemplateError(f"{word} out of place in {self.text!r}")
        if word.lower() in ("true", "false", "none"):
            return {"true": (F.lit(True), T.BooleanType()), "false": (F.lit(False), T.BooleanType()), "none": (F.lit(None).cast("string"), T.StringType())}[word.lower()]
        if word not in self.scope:
            raise TemplateError(f"no field {word}")
        column, kind = self.scope[word]
        while self.peek("."):
            self.take(".")
            name = self.words[self.at][1]
            self.at += 1
            if isinstance(kind, dict):
                column, kind = kind[name]
            elif isinstance(kind, T.StructType) and name in kind.names:
                column, kind = column[name], kind[name].dataType
            else:
                raise TemplateError(f"no member {name} in {self.text!r}")
        return column, kind


def _string(word: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])


def truth(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def shown(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False").otherwise("")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    if isinstance(kind, dict):
        raise TemplateError("loop itself cannot be shown")
    return F.coalesce(c.cast("string"), F.lit(""))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


def _body(pieces: list[tuple[str, str]], at: int, scope: dict, ends: tuple[str, ...]) -> tuple[Column, int, str]:
    """(the text up to one of the ends, its place, that statement)."""
    parts: list[Column] = []
    while at < len(pieces):
        kind, text = pieces[at]
        if kind == "text":
            parts.append(F.lit(text))
        elif kind == "show":
            parts.append(shown(*_Expression(text, scope).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in ends:
                return _joined(parts), at, text
            if word == "if":
                made, at = _condition(pieces, at, rest, scope)
            elif word == "for":
                made, at = _loop(pieces, at, rest, scope)
            else:
                raise TemplateError(f"{text!r} out of place")
            parts.append(made)
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return _joined(parts), at, ""


def _condition(pieces, at: int, test: str, scope: dict) -> tuple[Column, int]:
    cases, last = [], F.lit("")
    while True:
        body, at, end = _body(pieces, at + 1, scope, ("elif", "else", "endif"))
        cases.append((truth(*_Expression(test, scope).whole()), body))
        word, _, test = end.partition(" ")
        if word == "else":
            last, at, _ = _body(pieces, at + 1, scope, ("endif",))
        if word != "elif":
            break
    return reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), last), at


def _loop(pieces, at: int, head: str, scope: dict) -> tuple[Column, int]:
    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", head, re.S)
    if not m:
        raise TemplateError(f"no loop: {head!r}")
    items, kind = _Expression(m[2], scope).whole()
    if not isinstance(kind, T.ArrayType):
        raise TemplateError(f"{m[2]} is no array")
    size, places, start = F.size(items), [], at + 1

    def body(x: Column, i: Column) -> Column:
        loop = {"index": (i + 1, T.IntegerType()), "index0": (i, T.IntegerType()), "first": (i == 0, T.BooleanType()), "last": (i == size - 1, T.BooleanType()), "length": (size, T.IntegerType())}
        made, place, _ = _body(pieces, start, scope | {m[1]: (x, kind.elementType), "loop": (F.lit(None), loop)}, ("else", "endfor"))
        places.append(place)
        return made

    made = F.coalesce(F.array_join(F.transform(items, body), ""), F.lit(""))
    at = places[0]
    if pieces[at][1] == "else":
        empty, at, _ = _body(pieces, at + 1, scope, ("endfor",))
        made = F.when(truth(items, kind), made).otherwise(empty)
    return made, at


def compiled(template: str, schema: T.StructType, **fixed) -> Column:
    """The template over rows of that schema; ``fixed`` are further fields with one value for all rows."""
    scope: dict = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema}
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    scope |= {k: (F.lit(v), kinds[type(v)]) for k, v in fixed.items()}
    return _body(_pieces(template), 0, scope, ())[0]
