"""Label trees: recursive rewrites of JSON documents (Arrow-batched, as JSON has no fixed schema), typed helpers native."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE, BBOX = "<|value|>", "<|bbox|>"
_BOXES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))


def fold(obj, leaf: Callable = lambda x: x, on_dict: Callable = lambda old, new: new, on_list: Callable = lambda old, new: new):
    """A tree rewritten from its leaves up, by a stack of its own, so at any depth. on_dict and on_list get a node as it was
    and with its members rewritten."""
    todo, done = [(obj, False)], []
    while todo:
        x, ready = todo.pop()
        if not isinstance(x, (dict, list)):
            done.append(leaf(x))
        elif not ready:
            todo.append((x, True))
            todo.extend((v, False) for v in (reversed(x.values()) if isinstance(x, dict) else reversed(x)))
        else:
            new = done[len(done) - len(x) :]
            del done[len(done) - len(x) :]
            done.append(on_dict(x, dict(zip(x, new))) if isinstance(x, dict) else on_list(x, new))
    return done[0]


def remove_none(obj):
    """Null values of objects go; null members of lists stay."""
    return fold(obj, on_dict=lambda _, d: {k: v for k, v in d.items() if v is not None})


def truncate_lists(obj):
    """Lists keep their first member."""
    return fold(obj, on_list=lambda _, x: x[:1])


def blank(obj, empty: dict | None = None):
    """Members of the keys of ``empty``, by default values and boxes, become what it says."""
    empty = {VALUE: "", BBOX: []} if empty is None else empty
    return fold(obj, on_dict=lambda _, d: d | {k: v for k, v in empty.items() if k in d})


def target_schema(obj):
    return blank(truncate_lists(remove_none(obj)))


def wrap_values(obj):
    """Leaves become objects of a value and an empty box."""
    return fold(obj, leaf=lambda x: {VALUE: x, BBOX: ""})


def remove_key(obj, key: str = BBOX):
    return fold(obj, on_dict=lambda _, d: {k: v for k, v in d.items() if k != key})


def rename_key(obj, old: str = "nm", new: str = "name"):
    return fold(obj, on_dict=lambda _, d: {new if k == old else k: v for k, v in d.items()})


def name_and_count(obj):
    """nm becomes name, and the value of a cnt its first whole number, or empty."""

    def member(_, d):
        d = {"name" if k == "nm" else k: v for k, v in d.items()}
        if isinstance(d.get("cnt"), dict) and VALUE in d["cnt"]:
            found = re.search(r"\d+", str(d["cnt"][VALUE]))
            d["cnt"] = d["cnt"] | {VALUE: found[0] if found else ""}
        return d

    return fold(obj, on_dict=member)


def wrap_objects(obj, key: str):
    """An object under the key becomes a list of that object."""
    return fold(obj, on_dict=lambda _, d: {k: [v] if k == key and isinstance(v, dict) else v for k, v in d.items()})


def _typed(old, new):
    out = dict(new)
    if VALUE in old:
        out[VALUE] = type(old[VALUE]).__name__
    if isinstance(old.get(BBOX), list):
        out[BBOX] = [type(old[BBOX][0]).__name__ if old[BBOX] else "float"]
    return out


def tree_schema(obj):
    """The type of each value and of the members of each box."""
    return fold(obj, leaf=lambda x: type(x).__name__, on_dict=_typed, on_list=lambda _, x: x[:1])


def scale_boxes(obj, width: int, height: int, key: str = BBOX):
    """Boxes of four shares as boxes of whole pixels; what is no such box stays."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x - x == 0

    def scaled(_, d):
        box = d.get(key)
        if isinstance(box, list) and len(box) == 4 and all(map(number, box)):
            d[key] = [round(x * side) for x, side in zip(box, (width, height) * 2)]
        return d

    return fold(obj, on_dict=scaled)


def key_boxes(obj, key: str = "") -> list[tuple[str, str, list[float]]]:
    """(key, value, box) of every leaf with a box of four numbers that are not all zero."""
    todo, out = [(key, obj)], []
    while todo:
        key, x = todo.pop()
        if isinstance(x, dict) and VALUE in x:
            box = x.get(BBOX)
            if isinstance(box, list) and len(box) == 4 and any(box):
                out.append((key, x[VALUE] if isinstance(x[VALUE], str) else str(x[VALUE]) if not isinstance(x[VALUE], (dict, list)) else dumps(x[VALUE]), [float(v) for v in box]))
        elif isinstance(x, dict):
            todo.extend(reversed(x.items()))
        elif isinstance(x, list):
            todo.extend((key, v) for v in reversed(x))
    return out


_TOKEN = re.compile(r"""\s*([\[\](){},:]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s\[\](){},:"']+)\s*""", re.S)
_CLOSES = {"]": "[", ")": "(", "}": "{"}


def _deep(text: str, scalar: Callable):
    """Lists and objects of any depth, read with a stack. scalar reads strings, numbers and names."""
    stack: list[tuple] = []  # (bracket, list or object, key of the object's member that is read)
    at, wait, value = 0, {"value"}, None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no token at {at}")
        t, at = m[1], m.end()
        if t == "," or t in _CLOSES:
            if t not in wait or t != "," and stack[-1][0] != _CLOSES[t]:
                raise ValueError(f"{t} out of place")
            bracket, box, _ = stack[-1]
            if t == ",":
                wait = {"key"} if bracket == "{" else {"value"}
                continue
            stack.pop()
            value = box
        elif t == ":":
            if t not in wait:
                raise ValueError(": out of place")
            wait = {"value"}
            continue
        elif t in "[({":
            if "value" not in wait:
                raise ValueError(f"{t} out of place")
            stack.append((t, {} if t == "{" else [], None))
            wait = {"key", "}"} if t == "{" else {"value", "]", ")"}
            continue
        elif "key" in wait:
            key = scalar(t)
            if not isinstance(key, str):
                raise ValueError(f"no key: {t[:20]}")
            stack[-1] = (*stack[-1][:2], key)
            wait = {":"}
            continue
        elif "value" in wait:
            value = scalar(t)
        else:
            raise ValueError(f"{t[:20]} out of place")
        # a value is complete
        if stack:
            bracket, box, key = stack[-1]
            if bracket == "{":
                box[key] = value
            else:
                box.append(value)
        wait = {",", *_CLOSES} if stack else set()
    if stack or wait:
        raise ValueError("ends too early")
    return value


def loads(text: str):
    """JSON of any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text, json.loads)


def parse(text: str | None):
    """JSON, or a Python literal; anything else is an empty object."""
    if not isinstance(text, str):
        return {}
    for read in (loads, ast.literal_eval, lambda t: _deep(t, ast.literal_eval)):
        try:
            return read(text)
        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
            pass
    return {}


def dumps(obj) -> str:
    """Compact JSON of a tree of any depth."""
    short = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    try:
        return short(obj)
    except RecursionError:
        pass
    todo, out = [obj], []
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # text that is ready
            out.append(x[0])
        elif isinstance(x, dict):
            todo.append(("}",))
            for i, (k, v) in enumerate(reversed(x.items())):
                todo += [v, (("," if i + 1 < len(x) else "") + short(k) + ":",)]
            out.append("{")
        elif isinstance(x, list):
            todo.append(("]",))
            for i, v in enumerate(reversed(x)):
                todo += [v] + [(",",)] * (i + 1 < len(x))
            out.append("[")
        else:
            out.append(short(x))
    return "".join(out)


def rewrite(fn: Callable, strict: bool = True):
    """A rewrite of a JSON string column. Null stays null; text that is no JSON gives null (strict) or is read as parse()."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                tree = loads(t) if strict else parse(t)
            except ValueError:  # no JSON
                return None
            return dumps(fn(tree))

        return s.map(one)

    return run


json_remove_none = rewrite(remove_none)
json_truncate_lists = rewrite(truncate_lists)
json_blank = rewrite(blank)
json_target_schema = rewrite(target_schema)
json_wrap_values = rewrite(wrap_values)
json_remove_bbox = rewrite(remove_key)
json_rename = rewrite(rename_key)
json_name_and_count = rewrite(name_and_count)
json_tree_schema = rewrite(tree_schema)
json_parse = rewrite(lambda x: x, strict=False)
json_wrap_items = rewrite(lambda x: wrap_objects(x, "item"))


@F.pandas_udf(_BOXES)
def json_key_boxes(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"key": k, "value": v, "bbox": b} for k, v, b in key_boxes(parse(t))])


_PAIR = re.compile(r'"<\|value\|>":\s*"([^"]*)",\s*"<\|bbox\|>":\s*"([^"]*)"')


def value_box_pairs(text: str) -> list[tuple[str, str]]:
    return _PAIR.findall(text)


def replace_pairs(text: str, pairs: list[tuple[str, str]]) -> str:
    """The value and box pairs of a text replaced in order."""
    it = iter(pairs)
    return _PAIR.sub(lambda _: '"<|value|>": "{}", "<|bbox|>": "{}"'.format(*next(it)), text, count=len(pairs))


@F.pandas_udf(T.StringType())
def json_denormalize(label: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Labels without null values, their boxes in pixels. No JSON, or no size, gives null."""

    def one(t, w, h):
        if t is None or w != w or h != h:
            return None
        try:
            tree = loads(t)
        except ValueError:
            return None
        return dumps(scale_boxes(remove_none(tree), w, h))

    return pd.Series([one(*x) for x in zip(label, width, height)])


def required(label: Column) -> Column:
    """The label; a null or blank one is an error."""
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", F.raise_error(F.lit("empty label")).cast("string")).otherwise(label)


def pairs_of(text: Column) -> Column:
    """value_box_pairs() as an array of structs."""
    found = [F.regexp_extract_all(text, F.lit(_PAIR.pattern), F.lit(k)) for k in (1, 2)]
    return F.transform(F.arrays_zip(found[0].alias("v"), found[1].alias("b")), lambda x: F.struct(x["v"].alias("value"), x["b"].alias("bbox")))


def lock_step(df, *columns: str):
    """One row for each place of array columns of one length, all exploded together."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.arrays_zip(*columns)).alias("_x")).select(*rest, *[F.col(f"_x.{c}").alias(c) for c in columns])


def flattened(df, *arrays: str):
    """One row for each innermost member of nested arrays of structs: each name is an array in the members of the one before.
    What stands beside an array is repeated; a row whose array is empty or null goes."""
    for name in arrays:
        rest = [c for c in df.columns if c != name]
        df = df.select(*[F.col(f"`{c}`") for c in rest], F.explode(name).alias("_m")).select(*[F.col(f"`{c}`") for c in rest], "_m.*")
    return df


def invoice(label: Column) -> Column:
    """A bank statement's JSON as items (amount, date, ref) and a total, values as text; no JSON gives null."""
    parsed = F.from_json(label, "struct<`Closing Balance`:string,Transactions:array<struct<Amount:string,Date:string,Ref:string>>>")
    items = F.coalesce(F.transform(parsed["Transactions"], lambda t: F.struct(t["Amount"].alias("amount"), t["Date"].alias("date"), t["Ref"].alias("ref"))), F.array())
    out = F.to_json(F.struct(items.alias("items"), parsed["Closing Balance"].alias("total")), {"ignoreNullFields": "false"})
    return F.when(F.get_json_object(label, "$").isNotNull(), out)


def append_new(entries: Column, more: Column) -> Column:
    """Entries of a key with those added that differ in value or box."""
    return F.array_distinct(F.concat(entries, more))


def keep_or_first(values: Column, many: Column) -> Column:
    """All values of a class that may have several, else the first alone; none are null."""
    return F.when(F.size(values) == 0, None).when(many, values).otherwise(F.slice(values, 1, 1))


def disambiguate(key: Column, value: Column, n_values: Column) -> Column:
    """k::v where a key has several values."""
    return F.when(n_values > 1, F.concat(key, F.lit("::"), value)).otherwise(key)


def weave_otsl(tokens: Column, cells: Column) -> Column:
    """Structure tokens and cell texts woven to doctags: each <fcel> takes one text; b and i tags and empty texts are left
    out; it ends when tokens or texts run out; the otsl tags are put around if absent."""
    texts = F.filter(F.transform(cells, lambda c: F.array_join(F.filter(c, lambda t: ~t.isin("<b>", "</b>", "<i>", "</i>")), "")), lambda t: t != "")
    # what follows the fcel that takes the last text is left out, and so is everything if there is no text
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == "fcel", i + 1).otherwise(0)), lambda i: i > 0)
    last = F.when(F.size(texts) == 0, 0).otherwise(F.coalesce(F.try_element_at(at, F.greatest(F.size(texts), F.lit(1))), F.size(tokens)))
    parts = F.split(F.array_join(F.transform(F.slice(tokens, F.lit(1), last), lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""), "<fcel>")
    cells_in = F.zip_with(F.slice(parts, F.lit(2), F.size(parts)), F.slice(texts, F.lit(1), F.size(parts) - 1), lambda p, t: F.concat(F.lit("<fcel>"), F.coalesce(t, F.lit("")), p))
    body = F.concat(F.element_at(parts, 1), F.array_join(cells_in, ""))
    body = F.when(F.instr(body, "<otsl>") == 0, F.concat(F.lit("<otsl>"), body)).otherwise(body)
    return F.when(F.instr(body, "</otsl>") == 0, F.concat(body, F.lit("</otsl>"))).otherwise(body)


def chat(images: Column, queries: Column, answers: Column) -> Column:
    """(messages, images): user and assistant in turn, <image> before as many queries as there are images."""
    pairs = F.slice(F.arrays_zip(queries.alias("q"), answers.alias("a")), 1, F.least(F.size(queries), F.size(answers)))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = F.transform(pairs, lambda p, i: F.array(message("user", F.concat(F.when(i < F.size(images), "<image>").otherwise(""), p["q"])), message("assistant", p["a"])))
    return F.struct(F.flatten(turns).alias("messages"), images.alias("images"))


def elements(label: Column, size: tuple[Column, Column] | None = None) -> Column:
    """The elements of a layout label in order: type and box, types consolidated, as JSON; boxes of shares in whole pixels of
    size (width, height) if that is given. No JSON gives null."""
    from loomlake.functions.text import layout_type

    parsed = F.from_json(label, "struct<elements:array<struct<idx:int,type:string,value:string,bbox:array<double>>>>")["elements"]
    box = (lambda b: b) if size is None else lambda b: F.transform(F.slice(b, 1, 4), lambda x, i: F.bround(x * F.when(i % 2 == 0, size[0]).otherwise(size[1])).cast("long"))
    return F.to_json(F.transform(F.array_sort(parsed), lambda e: F.struct(layout_type(e["type"]).alias("type"), box(e["bbox"]).alias("bbox"))))
