"""Sources and sinks: readers by extension, scalar decoders and encoders, directory trees, and result files."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import re
import shutil
import tarfile
import zipfile
from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.lang import values as V


def decode_csv(data: bytes | str, comma: str = ",", comment: str = "", trim: bool = False, fields: int = 0, lazy: bool = False) -> Any:
    """An array of arrays of strings, without a heading.

    Lines that begin with ``comment`` outside quotes are left out. ``fields``: so many in each record, as many as in the first (0), or
    any number (negative). Without ``lazy``, a quote inside a plain field is an error.
    """
    text = data.decode() if isinstance(data, bytes) else data
    rows, held = [], ""
    for line in text.splitlines(True):
        if not held and comment and line.startswith(comment):
            continue
        held += line
        if held.count('"') % 2 == 0 or lazy and not re.search(rf'(^|{re.escape(comma)})\s*"', held):
            rows += _csv_rows(held, comma, trim, lazy)
            held = ""
    rows += _csv_rows(held, comma, trim, lazy)
    if fields >= 0 and rows and any(len(r) != (fields or len(rows[0])) for r in rows):
        raise V.EvalError("wrong number of fields")
    return V.value(rows)


def _csv_rows(text: str, comma: str, trim: bool, lazy: bool) -> list[list[str]]:
    if not lazy and re.search(rf'(?:^|{re.escape(comma)})[^"{re.escape(comma)}\n]*[^"{re.escape(comma)}\s]"', re.sub(r'"(?:[^"]|"")*"', "''", text)):
        raise V.EvalError("a quote in a field without quotes")
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=comma, skipinitialspace=trim) if r]


def encode_csv(rows: Any, comma: str = ",", crlf: bool = False) -> bytes:
    out = io.StringIO()
    csv.writer(out, delimiter=comma, lineterminator="\r\n" if crlf else "\n").writerows([["" if c == V.FALSE else c for c in r] for r in ([] if rows == V.FALSE else rows)])
    return out.getvalue().encode()


def from_plain(x: Any, strict: bool = True) -> Any:
    """JSON and YAML: strict keeps apart what would be the same empty value, as (s:), (a:), (b:) and ()."""
    if x is None:
        return V.Tup()
    if isinstance(x, bool):
        return V.Tup(b=V.value(x)) if strict else V.value(x)
    if isinstance(x, int | float):
        return float(x)
    if isinstance(x, str):
        return V.Tup(s=V.value(x)) if strict else V.value(x)
    if isinstance(x, list):
        items = tuple(from_plain(e, strict) for e in x) or V.FALSE
        return V.Tup(a=items) if strict else items
    return V.Dic({k: from_plain(v, strict) for k, v in x.items()}) or V.FALSE


def to_plain(x: Any, strict: bool = True) -> Any:
    x = V.bare(x)
    if isinstance(x, V.Tup) and not isinstance(x, V.Dic):
        if not x:
            return None
        if strict and len(x) == 1 and (k := next(iter(x))) in ("s", "a", "b"):
            return {"s": lambda v: v or "", "a": lambda v: [to_plain(e, strict) for e in v], "b": V.true}[k](x[k] if x[k] != V.FALSE else (() if k == "a" else V.FALSE if k == "b" else ""))
        return {k: to_plain(v, strict) for k, v in x.items()}
    if isinstance(x, V.Dic):
        return {k: to_plain(v, strict) for k, v in x.items()}
    if isinstance(x, tuple):
        return [None if e is None else to_plain(e, strict) for e in x]
    if isinstance(x, float):
        return int(x) if x == int(x) else x
    if isinstance(x, frozenset):
        return True if x == V.TRUE else {} if not x else [to_plain(e, strict) for e in sorted(x, key=V.order)]
    return x


def decode_json(data: bytes | str, strict: bool = True) -> Any:
    return from_plain(json.loads(data), strict)


def encode_json(x: Any, prefix: str = "", indent: str = "", escape: bool = False, strict: bool = True) -> bytes:
    """``prefix`` stands before every line but the first; ``escape`` writes <, > and & as escapes. Without ``strict``, wrapped values are tuples as any."""
    plain = to_plain(x) if strict else to_plain(x, False)
    text = json.dumps(plain, indent=indent or None, ensure_ascii=False, separators=None if indent else (",", ":"))
    for c in "<>&" if escape else "":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text.replace("\n", "\n" + prefix).encode()


def decode_yaml(data: bytes | str, strict: bool = True) -> Any:
    import yaml

    return from_plain(yaml.safe_load(data), strict)


def encode_yaml(x: Any, indent: int = 2, strict: bool = True) -> bytes:
    import yaml

    return yaml.safe_dump(to_plain(x, strict), sort_keys=True, allow_unicode=True, indent=indent, default_flow_style=False).encode()


def decode_xml(data: bytes | str, trim: bool = False) -> Any:
    """An array of texts and of ``(xmldecl:)``, ``(directive:)``, ``(comment:)`` and ``(elem:, ns:, attrs:, children:)``; what is empty is left
    out, and with ``trim`` texts of white space too."""
    raw = data.encode() if isinstance(data, str) else data
    parser, stack = expat.ParserCreate(namespace_separator=" "), [[]]
    parser.buffer_text, parser.ordered_attributes = True, True

    def name(n: str, key: str) -> dict:
        space, _, local = n.rpartition(" ")
        return {key: local, **({"ns": space} if space else {})}

    def start(tag: str, attrs: list) -> None:
        own = {V.Tup({**name(k, "name"), "value": V.value(v)}) for k, v in zip(attrs[::2], attrs[1::2], strict=True)}
        own |= {V.Tup({"name": k or "xmlns", "value": V.value(v or ""), **({"ns": "xmlns"} if k else {})}) for k, v in spaces}
        spaces.clear()
        stack.append([V.Tup({**name(tag, "elem"), **({"attrs": frozenset(own)} if own else {})})])

    def end(_: str) -> None:
        tag, *kids = stack.pop()
        stack[-1].append(V.Tup({**tag, **({"children": tuple(kids)} if kids else {})}))

    spaces: list = []
    parser.StartNamespaceDeclHandler = lambda k, v: spaces.append((k, v))
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda t: stack[-1].append(t) if not (trim and not t.strip()) else None
    parser.CommentHandler = lambda t: stack[-1].append(V.Tup(comment=V.value(t)))
    parser.ProcessingInstructionHandler = lambda target, t: stack[-1].append(V.Tup(xmldecl=V.value(t)))
    declared = re.match(rb"\s*<\?xml\s+(.*?)\?>", raw, re.S)
    if declared:
        stack[0].append(V.Tup(xmldecl=declared[1].decode()))
    held = re.search(rb"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", raw, re.S)
    if held:
        parser.StartDoctypeDeclHandler = lambda *_: stack[-1].append(V.Tup(directive=held[0][2:-1].decode()))
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise V.EvalError(f"XML: {e}") from None
    return tuple(stack[0]) or V.FALSE


def encode_xml(doc: Any) -> bytes:
    """The inverse of ``decode_xml``; elements' names are written without prefixes, as their declarations are attributes."""
    if not isinstance(V.bare(doc), tuple) and doc != V.FALSE:
        raise V.EvalError("XML needs an array")
    out = ""
    for x in () if doc == V.FALSE else V.bare(doc):
        text = V.bare(x)
        if isinstance(text, str):
            out += html.escape(text, False)
        elif not isinstance(x, V.Tup):
            raise V.EvalError(f"no part of XML: {V.show(x)}")
        elif "xmldecl" in x:
            out += f"<?xml {x['xmldecl'] or ''}?>"
        elif "directive" in x:
            out += f"<!{x['directive'] or ''}>"
        elif "comment" in x:
            out += f"<!--{x['comment'] or ''}-->"
        else:
            attrs = sorted(("xmlns:" * (t.get("ns") == "xmlns") + t["name"], t["value"] or "") for t in V.elements(x.get("attrs", V.FALSE)))
            inner = encode_xml(x["children"]).decode() if "children" in x else ""
            out += f"<{x['elem']}" + "".join(f' {k}="{html.escape(v)}"' for k, v in attrs) + f">{inner}</{x['elem']}>"
    return out.encode()


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def decode_xlsx(data: bytes, sheet: int = 0, head: int = 0) -> Any:
    """Rows of a sheet as a relation with ``@row`` and snake-case string attributes; blank rows and columns are left out."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    root = ElementTree.fromstring(book.read(names[sheet]))
    cells: dict[tuple[int, int], str] = {}
    for c in root.iter(f"{{{_NS['m']}}}c"):
        at = _place(c.get("r"))
        v = c.find("m:v", _NS)
        text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "")
        if text:
            cells[at] = text
    for merged in root.iter(f"{{{_NS['m']}}}mergeCell"):
        (r0, c0), (r1, c1) = map(_place, merged.get("ref").split(":"))
        for r in range(r0, r1 + 1):
            for c in range(c0, c1 + 1):
                cells.setdefault((r, c), cells.get((r0, c0), ""))
    columns = {c: re.sub(r"\W+", "_", t.strip()).strip("_").lower() for (r, c), t in cells.items() if r == head and t.strip()}
    rows = sorted({r for r, c in cells if r > head and c in columns})
    return V.as_set(V.Tup({"@row": float(r), **{n: V.value(cells.get((r, c), "")) for c, n in columns.items()}}) for r in rows)


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


DECODERS = {"csv": decode_csv, "json": decode_json, "yaml": decode_yaml, "yml": decode_yaml, "xlsx": decode_xlsx, "xml": decode_xml}


def read_file(path: str, decoder=None) -> Any:
    """A small local file as a value, by its extension; bytes if that is unknown."""
    with open(path, "rb") as f:
        data = f.read()
    decode = decoder or DECODERS.get(path.rpartition(".")[2].lower())
    return decode(data) if decode else data


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A large source as a DataFrame, by format or extension, read by Spark."""
    kind = fmt or path.rstrip("/").rpartition(".")[2].lower()
    kind = {"yml": "yaml"}.get(kind, kind)
    if kind == "yaml":
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").load(path)

        def decode(batches):
            import pandas as pd

            for b in batches:
                yield pd.DataFrame({"path": b["path"], "json": [encode_json(decode_yaml(x, False)).decode() for x in b["content"]]})

        return files.select("path", "content").mapInPandas(decode, "path string, json string")
    if kind == "json":
        options = {"multiLine": True, **options}
    return spark.read.format({"bin": "binaryFile"}.get(kind, kind)).options(**options).load(path)


def local_tree(path: str) -> Any:
    """``name, path, is_dir, size, mod_time`` of a folder of the driver and of all below it."""
    found = [path, *(os.path.join(top, name) for top, dirs, files in os.walk(path) for name in (*dirs, *files))]
    rows = []
    for full in found:
        info = os.lstat(full)
        rows.append(V.Tup(name=os.path.basename(full.rstrip("/")) or full, path=full, is_dir=V.value(os.path.isdir(full)), size=float(info.st_size), mod_time=float(info.st_mtime_ns)))
    return frozenset(rows)


def tree(spark: SparkSession, path: str) -> DataFrame:
    """``local_tree`` as a DataFrame."""
    rows = [(t["name"], t["path"], V.true(t["is_dir"]), t["size"], t["mod_time"]) for t in local_tree(path)]
    return spark.createDataFrame(rows, "name string, path string, is_dir boolean, size double, mod_time double")


def write(df: DataFrame, path: str, fmt: str = "parquet", if_exists: str = "fail", **options) -> None:
    mode = {"merge": "append", "replace": "overwrite", "ignore": "ignore", "fail": "errorifexists"}[if_exists]
    df.write.format(fmt).mode(mode).options(**options).save(path)


def _parts(content: Any, prefix: str = "") -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    for name, x in (content or {}).items():
        if not isinstance(name, str) or name in ("", ".", "..") or "/" in name:
            raise ValueError(f"not a file name: {name!r}")
        if isinstance(x, V.Tup) and not isinstance(x, V.Dic):
            raise ValueError(f"not a file's content: {name!r}")
        if isinstance(x, V.Dic | dict):
            out |= _parts(x, f"{prefix}{name}/")
        elif isinstance(x, str | bytes) or x == V.FALSE:
            out[prefix + name] = x.encode() if isinstance(x, str) else x or b""
        else:
            raise ValueError(f"not a file's content: {name!r}")
    return out


def write_dir(content: Any, path: str, if_exists: str = "merge") -> None:
    """A dictionary of files and folders as a tree; all of it is checked before anything is written.

    Entries are texts, bytes, dictionaries (folders), or tuples ``(ifExists:, file:)`` and ``(ifExists:, dir:)`` that say what happens to what is
    there: merge (folders only), replace, ignore, fail, or remove (with neither).
    """
    for step, at, data in _steps(V.Tup(ifExists=if_exists, **({} if if_exists == "remove" else {"dir": content})), path):
        if step == "remove":
            shutil.rmtree(at) if os.path.isdir(at) else os.remove(at)
        elif step == "dir":
            os.makedirs(at, exist_ok=True)
        else:
            with open(at, "wb") as f:
                f.write(data)


def _steps(x: Any, path: str, fresh: bool = False) -> list[tuple[str, str, bytes]]:
    """What writing an entry takes, in order; ``fresh``: nothing will be there by then."""
    x = V.bare(x)
    if isinstance(x, V.Tup) and not isinstance(x, V.Dic):
        rule, there = x.get("ifExists"), not fresh and os.path.exists(path)
        if rule not in (None, "merge", "replace", "ignore", "fail", "remove") or set(x) - {"ifExists", "dir", "file"}:
            raise ValueError(f"not a rule for what exists: {V.show(x)}")
        if ("dir" in x) + ("file" in x) != (rule != "remove") or rule == "merge" and "file" in x:
            raise ValueError(f"{path}: {rule} with these parts")
        if rule == "remove":
            return [("remove", path, b"")] if there else []
        if there and rule == "ignore":
            return []
        if there and rule == "fail":
            raise FileExistsError(path)
        body = V.Dic() if x.get("dir") == V.FALSE else x["dir"] if "dir" in x else x["file"]
        over = there and rule == "replace"
        return [("remove", path, b"")] * over + _steps(body, path, fresh or over)
    if isinstance(x, dict):
        out = [("dir", path, b"")]
        for name, v in x.items():
            if not isinstance(name, str) or name in ("", ".", "..") or "/" in name:
                raise ValueError(f"not a file name: {name!r}")
            out += _steps(v, os.path.join(path, name), fresh)
        return out
    if isinstance(x, str | bytes) or x == V.FALSE:
        return [("file", path, x.encode() if isinstance(x, str) else x or b"")]
    raise ValueError(f"not a file's content: {path!r}")


def archive(content: Any, kind: str = "zip") -> bytes:
    out = io.BytesIO()
    parts = _parts(content)
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts.items():
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in parts.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def wire(df: DataFrame) -> DataFrame:
    """Rows as JSON text, one column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def to_wire(x: Any) -> str:
    """A value as JSON text in which a set is ``{"{||}": [...]}``, so that it isn't taken for an array."""

    def of(v: Any) -> Any:
        v = V.bare(v)
        if isinstance(v, frozenset):
            return v == V.TRUE if v in (V.TRUE, V.FALSE) else {"{||}": [of(e) for e in sorted(v, key=V.order)]}
        if isinstance(v, V.Tup):
            return {str(k): of(e) for k, e in v.items()}
        if isinstance(v, tuple):
            return [None if e is None else of(e) for e in v]
        return to_plain(v)

    return json.dumps(of(x), ensure_ascii=False)


def from_wire(text: str) -> Any:
    """The inverse of ``to_wire``: objects are tuples."""

    def of(v: Any) -> Any:
        if isinstance(v, dict):
            return frozenset(map(of, v["{||}"])) if set(v) == {"{||}"} else V.Tup({k: of(e) for k, e in v.items()})
        return tuple(map(of, v)) or V.FALSE if isinstance(v, list) else V.value(v)

    return of(json.loads(text))
