"""The standard library: functions on local values, and on columns where ``column`` says how."""

from __future__ import annotations

import argparse
import html
import json
import math
import os
import re
import sys
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from setweave.functions import scalar as S
from setweave.lang import values as V
from setweave.operators.relation import Rel
from setweave.sources import formats, protobuf

STD: dict[str, Any] = {"math.pi": math.pi, "math.e": math.e}


def std(name: str, arity: int = 1, column: Callable | None = None, array: Callable | None = None, nested: bool = False):
    """A curried function; string arguments may be ``{}``, the empty string.

    ``column`` gets Columns, or syntax nodes for constants; ``array`` gets Columns, the last one an array (``nested``: of arrays).
    """

    def add(f: Callable) -> Callable:
        def curried(*got: Any):
            def call(x: Any) -> Any:
                args = (*got, x)
                return V.value(f(*args)) if len(args) == arity else curried(*args)

            if column and not got:
                call.column, call.array, call.nested = column, array, nested
            return call

        STD[name] = curried()
        return f

    return add


def _text(x: Any) -> Any:
    x = V.bare(x)
    return "" if x == V.FALSE else x


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x[0])


def _const(x: Any) -> Any:
    if isinstance(x, Column):
        raise V.EvalError("a constant is needed here")
    return x[0]


std("math.sin", column=F.sin)(math.sin)
std("math.cos", column=F.cos)(math.cos)
std("str.lower", column=F.lower)(lambda s: _text(s).lower())
std("str.upper", column=F.upper)(lambda s: _text(s).upper())
std("str.title", column=S.title)(lambda s: re.sub(r"(^|\s)(\S)", lambda m: m[1] + m[2].upper(), _text(s)))
std("str.repr")(V.show)
std("bits.set", column=S.bit_set)(lambda n: frozenset(float(i) for i in range(64) if int(n) >> i & 1))
std("bits.mask", column=S.bit_mask)(lambda s: float(sum(2 ** int(i) for i in V.elements(s))))
std("dict")(lambda t: V.Dic(t))
std("tuple")(lambda d: V.Tup(d))


@std("rel.union")
def rel_union(sets: Any) -> Any:
    """All elements of some sets; of relations over Spark, one plan."""
    parts = V.elements(sets)
    if any(isinstance(x, Rel) for x in parts):
        if not all(isinstance(x, Rel) for x in parts):
            raise V.EvalError("relations over Spark and local sets together")
        return parts[0].union(*parts[1:])
    return V.as_set(e for x in parts for e in V.elements(x))


std("rel.mixed")(lambda sets: Rel.mixed(*V.elements(sets)) if V.elements(sets) and all(isinstance(x, Rel) for x in V.elements(sets)) else rel_union(sets))


def _items(x: Any) -> Any:
    x = V.bare(x)
    return () if x == V.FALSE else x


@std("seq.concat", 1, lambda a: F.concat_ws("", _col(a)), F.flatten, nested=True)
def concat(parts: Any) -> Any:
    parts = [p for p in _items(parts) if p != V.FALSE]
    return sum(parts[1:], parts[0]) if parts and not isinstance(parts[0], str | bytes) else (type(parts[0])().join(parts) if parts else V.FALSE)


def _find(p: Any, s: Any, start: int = 0) -> int:
    if isinstance(s, str | bytes):
        return s.find(p, start)
    return next((i for i in range(start, len(s) - len(p) + 1) if s[i : i + len(p)] == p), -1)


def _like(p: Any, s: Any) -> tuple[Any, Any]:
    """Pattern and subject, with ``{}`` as the empty sequence of the other's kind."""
    kind = next((type(x) for x in (s, p) if isinstance(x, str | bytes | tuple)), str)
    return tuple(kind() if x == V.FALSE else x for x in (p, s))


std("seq.contains", 2, lambda p, s: F.contains(_col(s), _col(p)), S.a_contains)(lambda p, s: _find(*_like(p, s)) >= 0)
std("seq.has_prefix", 2, lambda p, s: F.startswith(_col(s), _col(p)), S.a_prefix)(lambda p, s: (lambda a, b: b[: len(a)] == a)(*_like(p, s)))
std("seq.has_suffix", 2, lambda p, s: F.endswith(_col(s), _col(p)), S.a_suffix)(lambda p, s: (lambda a, b: not len(a) or b[-len(a) :] == a)(*_like(p, s)))
std("seq.trim_prefix", 2, lambda p, s: S.trim_prefix(_col(p), _col(s)), S.a_trim_prefix)(lambda p, s: (lambda a, b: b[len(a) :] if b[: len(a)] == a else b)(*_like(p, s)))
std("seq.trim_suffix", 2, lambda p, s: S.trim_suffix(_col(p), _col(s)), S.a_trim_suffix)(lambda p, s: (lambda a, b: b[: len(b) - len(a)] if len(a) and b[-len(a) :] == a else b)(*_like(p, s)))
std("seq.repeat", 2, lambda n, s: F.repeat(_col(s), _col(n).cast("int")), S.a_repeat)(lambda n, s: _text(s) * int(n))


@std("seq.split", 2, lambda d, s: S.split(_const(d), _col(s)))
def split(d: Any, s: Any) -> Any:
    d, s = _like(d, s)
    if not len(d):
        return [s[i : i + 1] for i in range(len(s))]
    out, at = [], 0
    while (i := _find(d, s, at)) >= 0:
        out.append(s[at:i])
        at = i + len(d)
    return [*out, s[at:]] if len(s) else [s]


@std("seq.join", 2, lambda d, s: F.array_join(_col(s), _const(d)), S.a_join, nested=True)
def join(d: Any, parts: Any) -> Any:
    out: Any = None
    for p in _items(parts):
        a, b = _like(d, p)
        out = b if out is None else _like(out, b)[0] + a + b
    return V.FALSE if out is None else out


@std("seq.sub", 3, lambda a, b, s: S.sub(_col(a), _col(b), _col(s)))
def sub(old: Any, new: Any, s: Any) -> Any:
    (old, s), new = _like(old, s), _like(new, s)[0]
    if isinstance(s, str | bytes):
        return s.replace(old, new)
    if not len(old):
        return s
    out, at = (), 0
    while (i := _find(old, s, at)) >= 0:
        out, at = out + s[at:i] + new, i + len(old)
    return out + s[at:]


def _groups(m: re.Match) -> tuple:
    """A match and its groups, each at its place in bytes; a group that took no part is a hole."""
    places = [None if m.start(g) < 0 else len(m.string[: m.start(g)].encode()) for g in range(m.re.groups + 1)]
    return V.array([None if at is None else V.offset(at, V.value(m[g])) for g, at in enumerate(places)])


def _matches(made: re.Pattern, s: Any) -> Any:
    return tuple(map(_groups, made.finditer(_text(s)))) or V.FALSE


def _fill(new: Any) -> str:
    return re.sub(r"\$(\d)", r"\\\1", _text(new))


STD["re.match"] = lambda pattern: lambda s: _matches(re.compile(pattern), s)
std("re.sub", 3, lambda p, new, s: F.regexp_replace(_col(s), _col(p), _col(new)))(lambda p, new, s: re.sub(p, _fill(new), _text(s)))


@std("re.compile")
def re_compile(pattern: str) -> Any:
    """A tuple of functions; ``subf`` gets each match as a string."""
    made = re.compile(pattern)
    return V.Tup(
        match=lambda s: _matches(made, s),
        sub=lambda new: lambda s: V.value(made.sub(_fill(new), _text(s))),
        subf=lambda f: lambda s: V.value(made.sub(lambda m: _text(f(V.value(m[0]))), _text(s))),
    )


std("fmt.pretty")(V.pretty)


@std("str.expand", 4)
def expand(form: Any, x: Any, delimiter: Any, tail: Any) -> str:
    """A delimiter starts with a colon; without one, the value is shown as a whole."""
    delimiter = _text(delimiter)
    return V.expand(_text(form), x, delimiter[1:] if delimiter.startswith(":") else None, _text(tail))


def _assert(name: str, arity: int, holds: Callable) -> None:
    def check(*got: Any) -> bool:
        if not holds(*got):
            raise V.EvalError(f"assert.{name}: " + ", ".join(map(V.show, got)))
        return True

    std(f"test.assert.{name}", arity)(check)


_assert("equal", 2, lambda a, b: a == b)
_assert("unequal", 2, lambda a, b: a != b)
_assert("size", 2, lambda n, s: len(V.elements(s)) == n)
_assert("true", 1, V.true)
_assert("false", 1, lambda x: not V.true(x))


@std("error")
def error(message: Any) -> Any:
    raise V.EvalError(str(message))


def fix(f: Callable) -> Callable:
    return lambda x: f(fix(f))(x)


def fixt(t: Any) -> Any:
    """Functions that need one another: each of a tuple gets the tuple of all."""
    return V.Tup({name: (lambda f: lambda x: f(fixt(t))(x))(f) for name, f in t.items()})


STD["fn.fix"], STD["fn.fixt"] = fix, fixt


@std("util.reduce", 3)
def reduce_array(f: Callable, start: Any, items: Any) -> Any:
    """A fold in the order of an array."""
    for x in _items(items):
        start = f(start)(x)
    return start


@std("util.merge", 2)
def deep_merge(a: Any, b: Any) -> Any:
    """Tuples merged through all levels; the right side wins where either isn't a tuple."""
    if not (isinstance(a, V.Tup) and isinstance(b, V.Tup) and type(a) is type(b)):
        return b
    return type(a)({**a, **{k: deep_merge(a[k], v) if k in a else v for k, v in b.items()}})


std("util.no_offset")(V.bare)


@std("util.natural_order")
def natural_order(sets: Any) -> Any:
    """Strings in order of their words and of the numbers in them."""
    parts = lambda s: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", _text(s))]
    return tuple(sorted(V.elements(sets) if not isinstance(V.bare(sets), tuple) else V.bare(sets), key=parts))


@std("util.filter_tree", 2)
def filter_tree(test: Callable, tree: Any) -> Any:
    """The entries of nested dictionaries whose paths (arrays of names) a function accepts."""

    def of(d: Any, path: tuple) -> Any:
        out = {}
        for k, v in d.items():
            kept = of(v, (*path, k)) if isinstance(v, V.Dic) else v if V.true(test((*path, k))) else None
            if kept is not None:
                out[k] = kept
        return V.Dic(out) if out else None

    return of(tree, ()) or V.FALSE


def _grid(rows: Any) -> tuple[list[str], list[list[str]]]:
    names = V.heading(rows)
    return names, [[V.shown("", t[n]) for n in names] for t in sorted(V.elements(rows), key=V.order)]


@std("table.markdown")
def table_markdown(rows: Any) -> str:
    names, cells = _grid(rows)
    line = lambda x: "| " + " | ".join(c.replace("|", "\\|") for c in x) + " |"
    return "\n".join([line(names), "|" + "---|" * len(names), *map(line, cells)]) + "\n"


@std("table.html")
def table_html(rows: Any) -> str:
    names, cells = _grid(rows)
    line = lambda tag, x: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in x) + "</tr>"
    return "<table>" + line("th", names) + "".join(line("td", x) for x in cells) + "</table>"


def _at_path(path: str, text: Any) -> Any:
    """What a path as ``$.a.b[0]`` leads to in a JSON text; None if there is nothing."""
    x = json.loads(_text(text))
    for name, place in re.findall(r"\.([^.\[]+)|\[(\d+)\]", path):
        if place:
            x = x[int(place)] if isinstance(x, list) and int(place) < len(x) else None
        else:
            x = x.get(name) if isinstance(x, dict) else None
    return x


@std("json.number", 2, lambda p, s: F.get_json_object(_col(s), _const(p)).cast("double"))
def json_number(path: str, text: Any) -> float:
    found = _at_path(path, text)
    if isinstance(found, bool) or not isinstance(found, int | float):
        raise V.EvalError(f"no number at {path}")
    return float(found)


@std("json.text", 2, lambda p, s: F.coalesce(F.get_json_object(_col(s), _const(p)), F.lit("")))
def json_text(path: str, text: Any) -> str:
    found = _at_path(path, text)
    return "" if found is None else found if isinstance(found, str) else json.dumps(found, separators=(",", ":"))


@std("json.simplify")
def json_simplify(x: Any) -> Any:
    """What JSON's strict form keeps apart, as plain values."""
    return formats.from_plain(formats.to_plain(x), False)


@std("json.tuplify")
def json_tuplify(x: Any) -> Any:
    """Dictionaries whose keys are names, as tuples, through all levels."""
    if isinstance(x, V.Dic):
        made = {k: json_tuplify(v) for k, v in x.items()}
        return V.Tup(made) if all(isinstance(k, str) for k in made) else V.Dic(made)
    if isinstance(x, V.Tup):
        return V.Tup({k: json_tuplify(v) for k, v in x.items()})
    return tuple(None if e is None else json_tuplify(e) for e in x) if isinstance(x, tuple) else x


@std("xml.to_tuple")
def xml_to_tuple(doc: Any) -> Any:
    """Elements as ``(name: content)``: texts as strings, elements that repeat as arrays, attributes under ``@`` and their names."""

    def of(e: V.Tup) -> Any:
        out: dict = {}
        for t in V.elements(e.get("attrs", V.FALSE)):
            out["@" + t["name"]] = t["value"]
        kids = _items(e.get("children", V.FALSE))
        for k in kids:
            if isinstance(k, V.Tup) and "elem" in k:
                out.setdefault(k["elem"], []).append(of(k))
        text = "".join(k for k in kids if isinstance(k, str))
        if not out:
            return V.value(text)
        out = {k: v if not isinstance(v, list) else v[0] if len(v) == 1 else tuple(v) for k, v in out.items()}
        return V.Tup(out | ({"text": text} if text.strip() else {}))

    return V.Tup({e["elem"]: of(e) for e in _items(doc) if isinstance(e, V.Tup) and "elem" in e})


@std("flag.parser")
def flag_parser(config: Any) -> Any:
    """``{name: (type: .., default: .., alias: .., help: ..)}`` to a tuple of ``parse`` (an array of arguments to a tuple of flags and ``args``) and ``help``."""
    made = argparse.ArgumentParser(add_help=False, exit_on_error=False, allow_abbrev=False)
    kinds = {"string": str, "number": float, "bool": None}
    for name, spec in sorted(dict(config or {}).items()):
        kind = kinds[spec.get("type", "string")]
        names = [*(["-" + spec["alias"]] if spec.get("alias") else []), "--" + name]
        more = {"action": "store_true"} if kind is None else {"type": kind}
        made.add_argument(*names, dest=name, default=spec.get("default", V.FALSE), help=_text(spec.get("help", "")), **more)

    def parse(args: Any) -> Any:
        try:
            found, rest = made.parse_known_args(list(_items(args)))
        except (argparse.ArgumentError, SystemExit) as e:
            raise V.EvalError(str(e)) from None
        if unknown := [r for r in rest if r.startswith("-") and r != "-"]:
            raise V.EvalError(f"unknown flags: {unknown}")
        return V.Tup({**{k: V.value(v) for k, v in vars(found).items()}, "args": V.value(rest)})

    return V.Tup(parse=parse, help=made.format_help())


def _bytes(x: Any) -> bytes:
    return x if isinstance(x, bytes) else _text(x).encode() if isinstance(_text(x), str) else bytes(int(c) for c in x)


def _codec(name: str, decode: Callable, encode: Callable | None = None, **more: Callable) -> None:
    """Functions of a format as a tuple, so that it can also stand before an import."""
    made = {"decode": lambda x: V.value(decode(_bytes(x))), **more}
    STD[f"encoding.{name}"] = V.Tup(made | ({"encode": encode} if encode else {}))


def _given(config: Any, names: dict[str, str]) -> dict[str, Any]:
    """The options of a tuple of the language by the names of a Python function; characters may be numbers."""
    out = {}
    for k, v in dict(config or {}).items():
        if k not in names:
            continue
        v = V.bare(v)
        if k in ("comma", "comment"):
            out[names[k]] = chr(int(v)) if isinstance(v, float) else _text(v)
        elif k in ("prefix", "indent") and not isinstance(v, float):
            out[names[k]] = _text(v)
        else:
            out[names[k]] = int(v) if k in ("fieldsPerRecord", "indent") else V.true(v)
    return out


def _decoder(f: Callable, **names: str) -> Callable:
    return lambda config: lambda x: V.value(f(_bytes(x), **_given(config, names)))


def _encoder(f: Callable, **names: str) -> Callable:
    return lambda config: lambda x: f(x, **_given(config, names))


_codec("bytes", bytes)
_codec(
    "csv", formats.decode_csv, formats.encode_csv, encoder=_encoder(formats.encode_csv, comma="comma", crlf="crlf"),
    decoder=_decoder(formats.decode_csv, comma="comma", comment="comment", trimLeadingSpace="trim", fieldsPerRecord="fields", lazyQuotes="lazy"),
)
_codec(
    "json", formats.decode_json, formats.encode_json, decoder=_decoder(formats.decode_json, strict="strict"), encode_indent=lambda x: formats.encode_json(x, indent="  "),
    encoder=_encoder(formats.encode_json, prefix="prefix", indent="indent", escapeHTML="escape", strict="strict"),
)
_codec("yaml", formats.decode_yaml, formats.encode_yaml, decoder=_decoder(formats.decode_yaml, strict="strict"), encoder=_encoder(formats.encode_yaml, indent="indent", strict="strict"))
_codec("xml", formats.decode_xml, formats.encode_xml, decoder=_decoder(formats.decode_xml, trimSurroundingWhitespace="trim"))
_codec("xlsx", formats.decode_xlsx, decodeToRelation=lambda c: lambda x: V.value(formats.decode_xlsx(_bytes(x), int(c.get("sheet", 0)), int(c.get("headRow", 0)))))

STD["encoding.proto"] = V.Tup(
    descriptor=lambda x: protobuf.descriptor(_bytes(x)),
    decode=lambda types: lambda name: lambda x: protobuf.decode(types, _text(name), _bytes(x)),
)

STD["os.args"] = tuple(sys.argv) or V.FALSE
STD["os.path_separator"], STD["os.path_list_separator"] = os.sep, os.pathsep
std("os.cwd")(lambda _: os.getcwd())
std("os.exists")(lambda path: os.path.exists(path))
std("os.tree")(formats.local_tree)
std("os.file")(lambda path: formats.read_file(path, bytes))
std("os.get_env")(lambda name: os.environ.get(name, ""))
std("os.isatty")(lambda n: n in (0, 1) and os.isatty(int(n)))
std("archive.zip.zip")(lambda d: formats.archive(d, "zip"))
std("archive.tar.tar")(lambda d: formats.archive(d, "tar"))


class _Stdin:
    """Standard input as bytes, read once, when it is first asked for."""

    def __init__(self) -> None:
        self.data: bytes | None = None

    def __call__(self, *_: Any) -> Any:
        if self.data is None:
            self.data = sys.stdin.buffer.read()
        return self.data or V.FALSE


STD["os"] = V.Tup({"&stdin": _Stdin()})


@std("log.print")
def log(x: Any) -> Any:
    print(x if isinstance(x, str) else V.show(x), file=sys.stderr)
    return x


@std("log.printf", 2)
def log_format(form: Any, args: Any) -> Any:
    """Tells a printf-like text of an array's values, and gives the array."""
    rest, out = list(_items(args)), ""
    for plain, verb in re.findall(r"([^%]*)(%[-+# 0]*\d*(?:\.\d+)?[a-zA-Z%])?", _text(form)):
        out += plain + ("" if not verb else "%" if verb == "%%" else V.shown(verb[1:], rest.pop(0)) if rest else verb)
    print(out, file=sys.stderr)
    return args


@std("info")
def info(_: Any) -> Any:
    return V.Tup(python=sys.version.split()[0], os=sys.platform)


def _http(name: str, arity: int) -> None:
    """``(header: {name: values})``, a URL and, for post, a body, to ``(status, status_code, header, body)``."""

    def call(config: Any, url: str, body: Any = None) -> Any:
        sent = urllib.request.Request(url, data=None if body is None else _bytes(body), method=name.upper())
        for k, values in dict(dict(config or {}).get("header") or {}).items():
            for v in values if isinstance(values, tuple) else [values]:
                sent.add_header(k, _text(v))
        try:
            answer = urllib.request.urlopen(sent, timeout=60)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            header: dict = {}
            for k, v in answer.headers.items():
                header.setdefault(k, []).append(v)
            status = f"{answer.status} {answer.reason}"
            return V.Tup(status=status, status_code=float(answer.status), header=V.Dic({k: tuple(v) for k, v in header.items()}), body=answer.read() or V.FALSE)

    std(f"net.http.{name}", arity)(call)


_http("get", 2)
_http("post", 3)
