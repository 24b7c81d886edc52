"""Evaluates the language: local values on the driver, relations as plans on Spark."""

from __future__ import annotations

import functools
import math
import os
import statistics
from collections import ChainMap
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.functions import scalar as S
from setweave.lang import values as V
from setweave.lang.parser import FOLDS, Node, parse
from setweave.lang.stdlib import STD
from setweave.operators import relation as R
from setweave.operators.relation import Rel
from setweave.sources import formats

JOINS = {"<&>": "join", "<->": "compose", "-&-": "common", "---": "exists", "<&-": "left_match", "-&>": "right_match", "<--": "left_residue", "-->": "right_residue"}
SETS = {"|": "union", "&": "intersect", "&~": "minus", "~~": "symmetric"}
#: Extension of files with texts of the language.
SCRIPT = ".sw"
_NO = object()


class Missing(V.EvalError):
    """An attribute that a tuple lacks, or a call without one result."""


class Engine:
    """``eval(text)`` gives a local value or a ``Rel``. Names bound to relations are columns and plans, never collected.

    ``folder`` is where imports start from, and ``modules`` are folders of modules, local copies of what others publish; with ``safe``, texts reach neither files nor the environment.
    """

    def __init__(self, spark: SparkSession | None = None, folder: str = ".", safe: bool = False, std: dict | None = None, modules: tuple[str, ...] = (), **scope: Any):
        self.modules = tuple(map(os.path.abspath, modules))
        self.std = STD if std is None else std
        self.root = self.folder = os.path.abspath(folder)
        self.safe, self.imported = safe, {}
        self.spark, self.scope = spark, {k: V.value(v) for k, v in scope.items()}
        self.columns: dict[str, Callable[..., Column]] = {}
        self.scoped: list[dict[str, Any]] = []

    def bind(self, name: str, value: Any) -> None:
        self.scope[name] = value if isinstance(value, Rel) else V.value(value)

    def register(self, name: str, local: Callable, column: Callable[..., Column] | None = None) -> None:
        """A native function: on values, and on columns where it is used inside a relation."""
        self.scope[name] = local
        if column:
            self.columns[name] = column

    def eval(self, text: str) -> Any:
        return self.run(parse(text), ChainMap(self.scope))

    # local evaluation
    def run(self, n: Node, env: ChainMap) -> Any:
        if n.kind in ("rest", "optional"):
            raise V.EvalError(f"a {n.kind} part stands in patterns only")
        return getattr(self, f"_{n.kind}")(n, env)

    def _lit(self, n: Node, env: ChainMap) -> Any:
        return V.value(n[0])

    def _name(self, n: Node, env: ChainMap) -> Any:
        for names in reversed(self.scoped if n[0][:1] == "@" else []):
            if n[0] in names:
                return names[n[0]]
        if n[0] not in env:
            raise V.EvalError(f"name {n[0]!r} not found")
        return env[n[0]]

    def _std(self, n: Node, env: ChainMap) -> Any:
        if n[0] == "eval.value":
            return lambda text: Engine(safe=True).eval(text)
        if n[0] == "eval.eval":
            return lambda text: Engine(self.spark, self.folder, self.safe).eval(text)
        if n[0] == "eval.evaluator":
            return self.evaluator
        known, rest = n[0], []
        while known not in self.std and "." in known:
            known, _, last = known.rpartition(".")
            rest.insert(0, last)
        if known not in self.std or self.safe and known.split(".")[0] in ("os", "net"):
            raise V.EvalError(f"//{n[0]} not found")
        found = self.std[known]
        for part in rest:
            if not isinstance(found, V.Tup) or part not in found and "&" + part not in found:
                raise V.EvalError(f"//{n[0]} not found")
            found = found[part] if part in found else found["&" + part]()
        return found

    def evaluator(self, config: Any) -> V.Tup:
        """``(scope: names, stdlib: functions)`` to a tuple with ``eval``, for which nothing else exists."""
        given = dict(config or {})

        def run(text: Any) -> Any:
            std = self.std if "stdlib" not in given else dict(given["stdlib"] or {})
            return Engine(self.spark, self.folder, self.safe, std, **dict(given.get("scope") or {})).eval(text)

        return V.Tup(eval=run)

    def _import(self, n: Node, env: ChainMap) -> Any:
        """A file: tables of Parquet and ORC as relations, other known formats decoded, the rest as texts of the language."""
        path, decoder = n.args
        if self.safe or "://" in path:
            raise V.EvalError(f"import of {path} isn't allowed")
        full = self.place(path)
        kind = os.path.splitext(full)[1][1:].lower()
        if not decoder and kind in ("parquet", "orc"):
            return Rel(formats.read(self.spark, full, kind))
        if not os.path.exists(full) and os.path.exists(full + SCRIPT):
            full, kind = full + SCRIPT, SCRIPT[1:]
        if not os.path.isfile(full):
            raise V.EvalError(f"no file {path}")
        if decoder:
            made = self.run(decoder, env)
            return V.value((made if callable(made) else made["decode"])(formats.read_file(full, bytes)))
        if kind != SCRIPT[1:]:
            return formats.read_file(full)
        if full not in self.imported:
            self.imported[full] = _NO
            self.imported[full] = self.script(full)
        if self.imported[full] is _NO:
            raise V.EvalError(f"{path} imports itself")
        return self.imported[full]

    def place(self, path: str) -> str:
        """Where an import's path leads: from the root, from the folder at hand, or, without a leading dot, first into the folders of modules."""
        if path.startswith("/"):
            return os.path.normpath(self.root + path)
        if not path.startswith("."):
            for top in self.modules:
                full = os.path.normpath(os.path.join(top, path))
                if full.startswith(top + os.sep) and (os.path.exists(full) or os.path.exists(full + SCRIPT)):
                    return full
        return os.path.normpath(os.path.join(self.folder, path))

    def script(self, path: str) -> Any:
        """The value of a file's text; its imports start from its own folder."""
        with open(path, encoding="utf-8") as f:
            node = parse(f.read())
        before, self.folder = self.folder, os.path.dirname(os.path.abspath(path))
        try:
            return self.run(node, ChainMap({}))
        finally:
            self.folder = before

    def _let(self, n: Node, env: ChainMap) -> Any:
        inner = env.new_child()
        value = self.run(n[1], inner)
        if not self.match(n[0], value, inner):
            raise V.EvalError("pattern doesn't match")
        return self.run(n[2], inner)

    def _scoped(self, n: Node, env: ChainMap) -> Any:
        """Names with a leading @ hold in all that is called from the body."""
        self.scoped.append(dict(self.run(n[0], env)))
        try:
            return self.run(n[1], env)
        finally:
            self.scoped.pop()

    def _template(self, n: Node, env: ChainMap) -> Any:
        out = ""
        for part in n[0]:
            if isinstance(part, str):
                out += part
                continue
            made = V.expand(part[1], self.run(part[0], env), part[2], part[3])
            blank = not made and not out[out.rfind("\n") + 1 :].strip(" \t")
            out = out[: out.rfind("\n") + 1] if blank else out + made
        return out or V.FALSE

    def _fn(self, n: Node, env: ChainMap) -> Callable:
        def call(x: Any) -> Any:
            inner = env.new_child()
            if not self.match(n[0], x, inner):
                raise V.EvalError("pattern doesn't match")
            return self.run(n[1], inner)

        call.node = n
        return call

    def body(self, n: Node, env: ChainMap) -> Callable:
        """What stands behind an arrow: a function, or an expression of the dot."""
        if n.kind == "fn":
            return self._fn(n, env)
        return lambda x: self.run(n, env.new_child({".": x}))

    def _tuple(self, n: Node, env: ChainMap) -> Any:
        return V.Tup({k: self.thunk(v, env) if k[:1] == "&" else self.run(v, env) for k, v in n[0]})

    def thunk(self, n: Node, env: ChainMap) -> Callable:
        def call(*_: Any) -> Any:
            return self.run(n, env)

        return call

    def _bytes(self, n: Node, env: ChainMap) -> Any:
        out = b""
        for x in (self.run(e, env) for e in n[0]):
            if isinstance(x, float) and x in range(256):
                out += bytes([int(x)])
            elif isinstance(x, str) or x == V.FALSE:
                out += (x or "").encode()
            else:
                raise V.EvalError(f"not a byte: {V.show(x)}")
        return out or V.FALSE

    def _array(self, n: Node, env: ChainMap) -> Any:
        return V.array([None if e is None else self.run(e, env) for e in n[0]])

    def _set(self, n: Node, env: ChainMap) -> Any:
        return V.as_set(self.run(e, env) for e in n[0])

    def _dict(self, n: Node, env: ChainMap) -> Any:
        pairs = [(self.run(k, env), self.run(v, env)) for k, v in n[0]]
        if len({k for k, _ in pairs}) < len(pairs):
            raise V.EvalError("duplicate key")
        return V.Dic(pairs)

    def _relation(self, n: Node, env: ChainMap) -> Any:
        if any(len(r) != len(n[0]) for r in n[1]):
            raise V.EvalError("row doesn't fit the heading")
        return V.as_set(V.Tup(zip(n[0], (self.run(e, env) for e in r), strict=True)) for r in n[1])

    def _get(self, n: Node, env: ChainMap) -> Any:
        x = self.run(n[0], env)
        if isinstance(x, V.Tup) and not isinstance(x, V.Dic):
            if n[1] in x:
                return x[n[1]]
            if "&" + n[1] in x:
                return x["&" + n[1]]()
        if n[2] is not None:
            return self.run(n[2], env)
        raise Missing(f"no attribute {n[1]!r}")

    def _safe(self, n: Node, env: ChainMap) -> Any:
        """Tails one after the other; where one that may fail finds nothing, the fallback."""
        x = self.run(n[0], env)
        for tail, may in n[1]:
            try:
                x = self.run(tail, env.new_child({"": x}))
            except Missing:
                if not may:
                    raise
                return self.run(n[2], env)
        return x

    def _project(self, n: Node, env: ChainMap) -> Any:
        x, names = self.run(n[0], env), n[1]
        if set(names) - set(x):
            raise V.EvalError(f"no attributes {sorted(set(names) - set(x))}")
        return V.Tup({k: v for k, v in x.items() if (k in names) != n[2]})

    def _call(self, n: Node, env: ChainMap) -> Any:
        f = self.run(n[0], env)
        for a in n[1]:
            f = self.apply(f, self.run(a, env), n[2] and (lambda: self.run(n[2], env)))
        return f

    def apply(self, f: Any, x: Any, fallback: Callable | None = None) -> Any:
        if callable(f):
            return f(x)
        if isinstance(f, V.Off):
            return self.apply(f.items, x - f.at if isinstance(x, float) else x, fallback)
        if isinstance(f, Rel):
            keys = [c for c in f.names if c == "@"]
            found = f.where(F.col(keys[0]) == F.lit(x)).without("@").df.limit(2).collect() if keys else []
            got = [V.value(r[0]) for r in found]
        elif isinstance(f, str | bytes | tuple):
            at = int(x) if isinstance(x, float) and x == int(x) else -1
            got = [V.value(float(ord(f[at])) if isinstance(f, str) else f[at])] if 0 <= at < len(f) and f[at] is not None else []
        elif isinstance(f, V.Dic):
            got = [f[x]] if x in f else []
        else:
            got = [next(v for k, v in t.items() if k != "@") for t in V.elements(f) if isinstance(t, V.Tup) and t.get("@") == x and len(t) == 2]
        if len(got) == 1:
            return got[0]
        if fallback:
            return fallback()
        raise Missing("expected one result of a call, got " + str(len(got)))

    def _count(self, n: Node, env: ChainMap) -> Any:
        x = self.run(n[0], env)
        return float(x.count()) if isinstance(x, Rel) else float(len(V.elements(x)))

    def _single(self, n: Node, env: ChainMap) -> Any:
        x = self.run(n[0], env)
        if isinstance(x, Rel):
            return V.Tup(zip(x.names, map(V.value, x.single()), strict=True))
        got = V.elements(x)
        if len(got) != 1:
            raise V.EvalError("too many elements" if got else "empty set")
        return got[0]

    def _cond(self, n: Node, env: ChainMap) -> Any:
        for test, value in n[0]:
            if test == Node("name", ("_",)) or V.true(self.run(test, env)):
                return self.run(value, env)
        return V.FALSE if n[1] is None else self.run(n[1], env)

    def _match(self, n: Node, env: ChainMap) -> Any:
        x = self.run(n[0], env)
        for pattern, value in n[1]:
            inner = env.new_child()
            if self.match(pattern, x, inner):
                return self.run(value, inner)
        return V.FALSE

    def match(self, p: Node, x: Any, env: ChainMap) -> bool:
        """Binds a pattern's names; a name that stands twice must agree."""
        if p.kind == "name":
            if p[0] == "_":
                return True
            if p[0] in env.maps[0] and env.maps[0][p[0]] != x:
                return False
            env.maps[0][p[0]] = x
            return True
        if p.kind == "anyof":
            return any(self.run(e, env) == x for e in p[0])
        if p.kind in ("array", "set", "tuple", "dict"):
            return getattr(self, f"_match_{p.kind}")(p, x, env)
        try:
            return self.run(p, env) == x
        except V.EvalError:
            return False

    def _match_array(self, p: Node, x: Any, env: ChainMap) -> bool:
        x = () if x == V.FALSE else x
        rest = [i for i, e in enumerate(p[0]) if e is not None and e.kind == "rest"]
        if not isinstance(x, tuple) or len(x) < len(p[0]) - len(rest) or not rest and len(x) != len(p[0]):
            return False
        if rest:
            k, tail = rest[0], len(p[0]) - rest[0] - 1
            mid = x[k : len(x) - tail]
            if not self.match(Node("name", p[0][k].args), mid or V.FALSE, env):
                return False
            parts, vals = p[0][:k] + p[0][k + 1 :], x[:k] + x[len(x) - tail :]
        else:
            parts, vals = p[0], x
        return all(self.match(a, b, env) for a, b in zip(parts, vals, strict=True))

    def _match_tuple(self, p: Node, x: Any, env: ChainMap) -> bool:
        x = V.Tup() if x == V.FALSE else x
        return isinstance(x, V.Tup) and not isinstance(x, V.Dic) and self.match_named(p[0], x, env)

    def _match_dict(self, p: Node, x: Any, env: ChainMap) -> bool:
        x = V.Dic() if x == V.FALSE else x
        return isinstance(x, V.Dic) and self.match_named([(k if k is None else self.run(k, env), v) for k, v in p[0]], x, env)

    def match_named(self, fields: Any, x: dict, env: ChainMap) -> bool:
        """Named parts; some may be optional with a default, and a rest takes what no part names."""
        named = {k: v for k, v in fields if k is not None}
        rest, over = [v for k, v in fields if k is None], type(x)({k: v for k, v in x.items() if k not in named})
        if over and not rest:
            return False
        for k, v in named.items():
            if v.kind == "optional":
                if not self.match(v[0], x[k] if k in x else self.run(v[1], env), env):
                    return False
            elif k not in x or not self.match(v, x[k], env):
                return False
        return all(self.match(Node("name", r.args), over, env) for r in rest)

    def _match_set(self, p: Node, x: Any, env: ChainMap) -> bool:
        if not isinstance(x, frozenset):
            return False
        rest = [e for e in p[0] if e.kind == "rest"]
        fixed = frozenset(self.run(e, env) for e in p[0] if e.kind not in ("rest", "name"))
        free = [e for e in p[0] if e.kind == "name"]
        left = x - fixed
        if not fixed <= x or len(free) + len(rest) > 1 and not (len(left) == 1 and free):
            return False
        if free:
            return len(left) == 1 and self.match(free[0], next(iter(left)), env)
        return self.match(Node("name", rest[0].args), left, env) if rest else not left

    def _unary(self, n: Node, env: ChainMap) -> Any:
        if n[0] == "&":
            return self.thunk(n[1], env)
        x = self.run(n[1], env)
        if n[0] == "*":
            return x()
        if n[0] == "!":
            return V.FALSE if V.true(x) else V.TRUE
        if n[0] == "^":
            return x.power_set() if isinstance(x, Rel) else V.subsets(x)
        if n[0] == "-":
            return -x if isinstance(x, float) else V.Tup({"@neg": x}) if not (isinstance(x, V.Tup) and set(x) == {"@neg"}) else x["@neg"]
        return x

    def _compare(self, n: Node, env: ChainMap) -> Any:
        left = self.run(n[0], env)
        for op, node in n[1]:
            right = self.run(node, env)
            if not self.compare(op, left, right):
                return V.FALSE
            left = right
        return V.TRUE

    def compare(self, op: str, a: Any, b: Any) -> bool:
        if op[0] == "!" and op != "!=":
            return not self.compare(op[1:], a, b)
        if isinstance(a, Rel) or isinstance(b, Rel):
            return self.compare_rels(op, a, b)
        if op in ("=", "!="):
            return (a == b) == (op == "=")
        if op == "<:":
            return a in V.elements(b)
        if op[0] == "(":
            x, y = set(V.elements(a)), set(V.elements(b))
            return {"(<)": x < y, "(<=)": x <= y, "(>)": x > y, "(>=)": x >= y, "(<>)": x < y or x > y, "(<>=)": x <= y or x >= y}[op]
        x, y = V.order(a), V.order(b)
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def compare_rels(self, op: str, a: Any, b: Any) -> bool:
        if op == "<:":
            return isinstance(a, V.Tup) and set(a) == set(b.names) and b.has(*[a[n] for n in b.names])
        a, b = self.rel(a), self.rel(b)
        tests = {
            "=": a.equals, "!=": lambda o: not a.equals(o), "(<=)": a.subset, "(<)": a.proper_subset, "(>=)": lambda o: o.subset(a), "(>)": lambda o: o.proper_subset(a),
            "(<>)": lambda o: a.subset(o) != o.subset(a), "(<>=)": lambda o: a.subset(o) or o.subset(a),
        }
        if op not in tests:
            raise V.EvalError(f"{op} of relations")
        return tests[op](b)

    def rel(self, x: Any) -> Rel:
        """A local relation as a plan."""
        if isinstance(x, Rel):
            return x
        names = V.heading(x)
        return Rel.of(self.spark, names, [tuple(t[k] for k in names) for t in V.elements(x)])

    def _bin(self, n: Node, env: ChainMap) -> Any:
        op, a = n[0], self.run(n[1], env)
        if op == "&&":
            return self.run(n[2], env) if V.true(a) else a
        if op == "||":
            return a if V.true(a) else self.run(n[2], env)
        b = self.run(n[2], env.new_child({"": a}) if op == "+>" else env)
        if isinstance(a, Rel) or isinstance(b, Rel):
            if op in ("with", "without") and isinstance(a, Rel):
                return getattr(a, op + "_row")(*[b[k] for k in a.names])
            name = JOINS.get(op) or SETS.get(op) or {"++": "concat"}.get(op)
            if not name:
                raise V.EvalError(f"{op} of relations")
            return getattr(self.rel(a), name)(self.rel(b))
        return self.local(op, a, b)

    def local(self, op: str, a: Any, b: Any) -> Any:
        if op in JOINS:
            return V.join(op, a, b)
        if op in SETS:
            x, y = frozenset(V.elements(a)), frozenset(V.elements(b))
            return V.as_set({"|": x | y, "&": x & y, "&~": x - y, "~~": x ^ y}[op])
        if op == "with":
            return V.as_set({*V.elements(a), b})
        if op == "without":
            return V.as_set(set(V.elements(a)) - {b})
        if op == "++":
            if V.FALSE in (a, b):
                return b if a == V.FALSE else a
            if type(a) is type(b) and isinstance(a, str | bytes | tuple):
                return a + b
            return V.as_set([*V.elements(a), *[V.Tup({**t, "@": t["@"] + len(V.elements(a))}) for t in V.elements(b)]])
        if op == "\\":
            if not isinstance(a, float):
                raise V.EvalError(f"not a position: {V.show(a)}")
            return V.offset(int(a), b)
        if op == "+>":
            if a == V.FALSE:
                return b
            return type(b)({**a, **b})
        if not isinstance(a, float) or not isinstance(b, float):
            raise V.EvalError(f"{op} needs numbers")
        if op in ("/", "//"):
            q = a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
            return q if op == "/" or not math.isfinite(q) else float(math.floor(q))
        if op in ("%", "-%"):
            m = math.fmod(a, b) if b and math.isfinite(a) else math.nan
            return m if op == "%" else a - m
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: a**b}[op]()

    def _nest(self, n: Node, env: ChainMap) -> Any:
        x, names, inverse, into = self.run(n[0], env), n[1], n[2], n[3]
        if isinstance(x, Rel):
            return x.nest_by(*names, into=into) if inverse else x.nest(*names, into=into)
        if x == V.FALSE:
            return x
        every = V.heading(x)
        if set(names) - set(every) or len(set(names)) == len(every) and inverse:
            raise V.EvalError("nest needs some attributes of the relation")
        inner = [k for k in every if (k in names) != inverse]
        groups: dict = {}
        for t in V.elements(x):
            groups.setdefault(V.Tup({k: v for k, v in t.items() if k not in inner}), []).append(V.Tup({k: t[k] for k in inner}))
        return V.as_set(V.Tup({**k, into: V.as_set(g)}) for k, g in groups.items())

    def _nest1(self, n: Node, env: ChainMap) -> Any:
        x, name = self.run(n[0], env), n[1]
        if isinstance(x, Rel):
            return x.nest_single(name)
        groups: dict = {}
        for t in V.elements(x):
            groups.setdefault(V.Tup({k: v for k, v in t.items() if k != name}), set()).add(t[name])
        return V.as_set(V.Tup({**k, name: V.as_set(g)}) for k, g in groups.items())

    def _unnest(self, n: Node, env: ChainMap) -> Any:
        if ranked := self.ranked_groups(n, env):
            return ranked
        x = self.run(n[0], env)
        if isinstance(x, Rel):
            return x.unnest(n[1])
        return V.as_set(V.Tup({**{k: v for k, v in t.items() if k != n[1]}, **u}) for t in V.elements(x) for u in V.elements(t[n[1]]))

    def ranked_groups(self, n: Node, env: ChainMap) -> Rel | None:
        """``R nest ~|k|g => (k: .k, g: .g rank (r: .x)) unnest g``: ranks within groups, without collecting them."""
        dot, body = Node("name", (".",)), n[0].args[2] if n[0].kind == "arrow" and n[0][0] == "=>" else None
        if body is None or n[0][1].kind != "nest" or body.kind != "tuple":
            return None
        nest, named = n[0][1], dict(body[0])
        inner = named.pop(n[1], None)
        if inner is None or inner.kind != "rank" or inner[0] != Node("get", (dot, nest[3], None)):
            return None
        x = self.run(nest[0], env)
        if not isinstance(x, Rel):
            return None
        keys = list(nest[1]) if nest[2] else [k for k in x.names if k not in nest[1]]
        if named != {k: Node("get", (dot, k, None)) for k in keys}:
            return None
        return x.rank(by=keys, **{k: self.key(v, x, env) for k, v in inner[1][0]})

    def _rank(self, n: Node, env: ChainMap) -> Any:
        x = self.run(n[0], env)
        if isinstance(x, Rel):
            return x.rank(**{k: self.key(v, x, env) for k, v in n[1][0]})
        rows = V.elements(x)
        out = [V.Tup(t) for t in rows]
        for name, node in n[1][0]:
            keys = [V.order(self.body(node, env)(t)) for t in rows]
            for t, k in zip(out, keys, strict=True):
                t[name] = float(sum(o < k for o in keys))
        return V.as_set(out)

    def key(self, node: Node, x: Rel, env: ChainMap) -> R.Key:
        falls = node.kind == "unary" and node[0] == "-"
        return R.Key(self.column(node[1] if falls else node, x, env)[0], falls)

    def _filter(self, n: Node, env: ChainMap) -> Any:
        x, out = self.run(n[0], env), []
        if isinstance(x, Rel):
            return self.filtered(x, n[1], n[2], env)
        for e in V.elements(x):
            here = env.new_child({".": e})
            for pattern, value in n[2]:
                inner = here.new_child()
                if self.match(pattern, self.run(n[1], here), inner):
                    out.append(self.run(value, inner))
                    break
        return V.as_set(out)

    def _arrow(self, n: Node, env: ChainMap) -> Any:
        op, left, right = n.args
        if op == "=>" and left.kind == "nest" and (fused := self.fused(left, right, env)):
            return fused
        if op == "where" and left.kind == "rank" and (top := self.first_ranks(left, right, env)):
            return top
        x = self.run(left, env)
        if op == "->":
            return self.body(right, env)(x) if right.kind != "name" or right[0] == "." else self.apply(self.run(right, env), x)
        if isinstance(x, Rel):
            return self.over(op, x, right, env)
        f = self.body(right, env)
        if op == "where":
            kept = [e for e in V.elements(x) if V.true(f(e))]
            return V.as_set(kept)
        if op == "=>":
            return V.as_set(f(e) for e in V.elements(x))
        if op == "orderby":
            return tuple(sorted(V.elements(x), key=lambda e: V.order(f(e)))) or V.FALSE
        if op == "order":
            less = functools.cmp_to_key(lambda a, b: V.true(f(b)(a)) - V.true(f(a)(b)))
            return tuple(sorted(sorted(V.elements(x), key=V.order), key=less)) or V.FALSE
        if op == ":>":
            if not isinstance(x, V.Tup) or isinstance(x, V.Dic):
                raise V.EvalError(f":> needs a tuple, not {V.show(x)}")
            return V.Tup({k: f(v) for k, v in x.items()})
        if op in (">>", ">>>"):
            return self.mapped(x, (lambda i, v: f(i)(v)) if op == ">>>" else (lambda i, v: f(v)))
        got = [f(e) for e in V.elements(x)]
        if op == "sum":
            return float(sum(got))
        if not got:
            raise V.EvalError(f"{op} of an empty set")
        if op in ("max", "min"):
            return (max if op == "max" else min)(got, key=V.order)
        return float(statistics.median(got) if op == "median" else sum(got) / len(got))

    def mapped(self, x: Any, f: Callable) -> Any:
        if isinstance(x, V.Off):
            return V.offset(x.at, self.mapped(x.items, lambda i, v: f(i + x.at, v)))
        if isinstance(x, bytes):
            made = [f(float(i), float(c)) for i, c in enumerate(x)]
            return bytes(map(int, made)) if all(isinstance(c, float) and c in range(256) for c in made) else tuple(made)
        if isinstance(x, str):
            made = [f(float(i), float(ord(c))) for i, c in enumerate(x)]
            return "".join(chr(int(c)) for c in made) if all(isinstance(c, float) for c in made) else tuple(made)
        if isinstance(x, tuple):
            return tuple(None if v is None else f(float(i), v) for i, v in enumerate(x))
        if isinstance(x, V.Dic):
            return V.Dic({k: f(k, v) for k, v in x.items()})
        if x != V.FALSE and (not V.is_relation(x) or any(len(t) != 2 or "@" not in t for t in x)):
            raise V.EvalError(f"no sequence: {V.show(x)}")
        return V.as_set(V.Tup({"@": t["@"], **{k: f(t["@"], v) for k, v in t.items() if k != "@"}}) for t in V.elements(x))

    # plans
    def first_ranks(self, ranked: Node, test: Node, env: ChainMap) -> Rel | None:
        """``R rank (r: key) where .r < k``, so that only the first ranks leave their partitions."""
        fields, own = ranked[1][0], Node("get", (Node("name", (".",)), ranked[1][0][0][0], None))
        if test.kind != "compare" or len(fields) != 1 or len(test[1]) != 1 or test[0] != own:
            return None
        (op, limit), x = test[1][0], self.run(ranked[0], env)
        if not isinstance(x, Rel) or op not in ("<", "<=", "=") or limit.kind != "lit" or not isinstance(limit[0], float) or op == "=" and limit[0]:
            return None
        k = math.ceil(limit[0]) if op == "<" else math.floor(limit[0]) + 1
        return x.top(k, fields[0][0], self.key(fields[0][1], x, env))

    def over(self, op: str, x: Rel, body: Node, env: ChainMap) -> Any:
        if op == "where":
            c, kind = self.column(body, x, env)
            return x.where(S.truthy(c, kind))
        if op == "=>":
            if body.kind == "project":
                return x.without(*body[1]) if body[2] else x.project(*body[1])
            if body.kind == "tuple":
                return x.map(**{k: self.attribute(v, x) or self.column(v, x, env)[0] for k, v in body[0]})
            if body.kind == "bin" and body[0] == "+>" and body[1] == Node("name", (".",)) and body[2].kind == "tuple":
                inner = env.new_child({"": body[1]})
                return x.merge(**{k: self.column(v, x, inner)[0] for k, v in body[2][0]})
            return x.map(value=self.column(body, x, env)[0])
        if op == "orderby":
            return x.order_by(self.key(body, x, env).order())
        if op == "order" and body.kind == "fn" and body[1].kind == "fn":
            less = lambda a, b: self._column(body[1][1], x, env.new_child({body[0][0]: a, body[1][0][0]: b}))
            return x.order_array(into="items", less=less)
        if op in (">>", ">>>"):
            rest = [n for n in x.names if n != "@"]
            if len(rest) != 1 or "@" not in x.names:
                raise V.EvalError(f"no sequence: a relation of {x.names}")
            place, item = F.col("`@`"), F.col(f"`{rest[0]}`")
            made = self.lambda_of(body, x, env, place, item) if op == ">>>" else self.lambda_of(body, x, env, item)
            return Rel(x._raw.select(place, made.alias(rest[0])), [["@"]] if frozenset(["@"]) in x.keys else False)
        if op == "median":
            return V.value(x.median(self.column(body, x, env)[0]).single()[0])
        if op in FOLDS:
            fold = getattr(R, f"{op}_of")
            return V.value(x.fold(v=fold(self.column(body, x, env)[0])).single()[0])
        raise V.EvalError(f"{op} of a relation")

    def attribute(self, n: Node, x: Rel) -> str | None:
        """The attribute that a node stands for as it is."""
        plain = n.kind == "get" and n[0] == Node("name", (".",)) and n[2] is None and n[1] in x.names
        return n[1] if plain else None

    def lambda_of(self, body: Node, x: Rel, env: ChainMap, *args: Column) -> Column:
        """A function of some columns, or an expression of the dot, as a column."""
        inner = env.new_child({".": args[-1]})
        for a in args:
            if body.kind == "fn":
                inner = inner.new_child({body[0][0]: a})
                body = body[1]
        return self._column(body, x, inner)

    def filtered(self, x: Rel, control: Node, cases: tuple, env: ChainMap) -> Rel:
        """Rows that fit any pattern, mapped by the first that they fit: one filter and one projection."""
        tests, values = [], []
        for pattern, value in cases:
            inner = env.new_child()
            tests.append(self.fits(pattern, control, x, inner))
            values.append((value, inner))
        kept = x.where(functools.reduce(lambda a, b: a | b, tests, F.lit(False)))
        shapes = {tuple(sorted(k for k, _ in v[0])) if v.kind == "tuple" else None for v, _ in values}
        if len(shapes) > 1:
            raise V.EvalError("the cases give tuples of different attributes")
        shape = next(iter(shapes), None)
        parts = {"value": None} if shape is None else {k: k for k in shape}
        made = {}
        for name, k in parts.items():
            columns = [self._column(v if k is None else dict(v[0])[k], x, inner) for v, inner in values]
            made[name] = functools.reduce(lambda w, tc: w.when(*tc), zip(tests[1:], columns[1:], strict=True), F.when(tests[0], columns[0]))
        return kept.map(**made)

    def fits(self, p: Node, at: Node, x: Rel, env: ChainMap) -> Column:
        """Whether a pattern fits what ``at`` says of a row, as a column; binds the pattern's names to expressions."""
        if p.kind == "name":
            if p[0] == "_":
                return F.lit(True)
            known = env.maps[0].get(p[0])
            env.maps[0].setdefault(p[0], at)
            return F.lit(True) if known is None else self._column(known, x, env).eqNullSafe(self._column(at, x, env))
        if p.kind == "tuple":
            kind = None if at == Node("name", (".",)) else self.column(at, x, env)[1]
            names = x.names if kind is None else kind.names if isinstance(kind, T.StructType) else None
            named = {k: v for k, v in p[0] if k is not None}
            if names is None or set(named) - set(names) and any(v.kind != "optional" for k, v in named.items() if k not in names):
                return F.lit(False)
            if set(names) - set(named) and len(named) == len(p[0]):
                return F.lit(False)
            if any(k is None and v[0] != "_" for k, v in p[0]):
                raise V.EvalError("a named rest cannot be a column")
            made = F.lit(True)
            for k, v in named.items():
                where = Node("get", (at, k, None)) if k in names else v[1]
                made = made & self.fits(v[0] if v.kind == "optional" else v, where, x, env)
            return made
        if p.kind == "anyof":
            value = self._column(at, x, env)
            return functools.reduce(lambda a, b: a | b, [value.eqNullSafe(self._column(e, x, env)) for e in p[0]], F.lit(False))
        if p.kind == "array":
            return self.fits_array(p, at, x, env)
        if p.kind in ("set", "dict"):
            raise V.EvalError(f"a pattern of a {p.kind} cannot be a column")
        return self._column(at, x, env).eqNullSafe(self._column(p, x, env))

    def fits_array(self, p: Node, at: Node, x: Rel, env: ChainMap) -> Column:
        """Whether an array column has a pattern's length and items; a rest is a slice."""
        c, kind = self.column(at, x, env)
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        rest = [i for i, e in enumerate(p[0]) if e is not None and e.kind == "rest"]
        if len(rest) > 1:
            raise V.EvalError("a pattern of an array has one rest at most")
        n = len(p[0]) - len(rest)
        made = F.size(c) >= n if rest else F.size(c) == n
        for i, e in enumerate(p[0]):
            if rest and i == rest[0]:
                if e[0] != "_":
                    env.maps[0][e[0]] = Node("slice", (at, i, n))
            elif e is not None:
                made = made & self.fits(e, Node("item", (at, i if not rest or i < rest[0] else i - n - 1)), x, env)
        return made

    def fused(self, nest: Node, body: Node, env: ChainMap) -> Rel | None:
        """``nest ~|k|g => (k: .k, s: .g sum .x)`` as one grouped aggregation, without collecting groups."""
        x = self.run(nest[0], env)
        if not isinstance(x, Rel) or body.kind != "tuple":
            return None
        keys = list(nest[1]) if nest[2] else [k for k in x.names if k not in nest[1]]
        dot, group = Node("name", (".",)), Node("get", (Node("name", (".",)), nest[3], None))
        named, folds = {}, {}
        for name, v in body[0]:
            if v.kind == "get" and v[0] == dot and v[1] in keys:
                named[name] = v[1]
            elif v.kind == "arrow" and v[0] in FOLDS and v[1] == group:
                folds[name] = getattr(R, f"{v[0]}_of")(self.column(v[2], x, env)[0])
            elif v == Node("count", (group,)):
                folds[name] = F.count(F.lit(1)).cast("double")
            else:
                return None
        made = x.group(*keys, **{f"__f_{k}": c for k, c in folds.items()})
        out = {n: F.col(k) for n, k in named.items()} | {n: F.col(f"__f_{n}") for n in folds}
        return Rel(made._raw.select(*[out[n].alias(n) for n, _ in body[0]]), set(named.values()) == set(keys))

    def column(self, n: Node, x: Rel, env: ChainMap) -> tuple[Column, T.DataType]:
        """An expression of the dot as a column over a relation, and its type."""
        c = self._column(n, x, env)
        return c, self.kind_of(c, x)

    def kind_of(self, c: Column, x: Rel) -> T.DataType:
        return x._raw.select(c.alias("c")).schema[0].dataType

    def _column(self, n: Node, x: Rel, env: ChainMap) -> Column:
        def sub(m: Node) -> Column:
            return self._column(m, x, env)

        if n.kind == "fn":
            return self._column(n[1], x, env.new_child({n[0][0]: Node("name", (".",))}))
        if n.kind == "name" and isinstance(env.get(n[0]), Column):
            return env[n[0]]
        if n.kind == "name" and n[0] == ".":
            return F.struct(*[F.col(f"`{c}`") for c in sorted(x.names)])
        if n.kind == "item":
            return F.get(sub(n[0]), F.lit(n[1])) if n[1] >= 0 else F.try_element_at(sub(n[0]), F.lit(n[1]))
        if n.kind == "slice":
            return F.slice(sub(n[0]), n[1] + 1, F.greatest(F.size(sub(n[0])) - n[2], F.lit(0)))
        if n.kind == "name" and isinstance(env.get(n[0]), Node):
            return sub(env[n[0]])
        if n.kind in ("arrow", "count", "single") and isinstance(self.bound(n[1] if n.kind == "arrow" else n[0], env), Rel):
            # A fold over another relation doesn't depend on the row.
            return F.lit(self.run(n, env.new_child({".": V.FALSE})))
        if n.kind in ("lit", "name", "std"):
            v = self.run(n, env)
            if callable(v) or isinstance(v, Rel):
                raise V.EvalError("a function or a relation cannot be a column")
            if n.kind == "lit" and isinstance(n[0], bool):
                return F.lit(n[0])
            return F.lit("" if v == V.FALSE else list(v) if isinstance(v, tuple | frozenset) else v)
        if n.kind == "get":
            if self.is_row(n[0], env):
                if n[1] not in x.names and n[2] is not None:
                    return sub(n[2])
                x._need([n[1]])
                return F.col(f"`{n[1]}`")
            return sub(n[0])[n[1]]
        if n.kind == "unary":
            if n[0] == "!":
                return ~self.truth(n[1], x, env)
            if n[0] not in "+-":
                raise V.EvalError(f"cannot be a column: {n[0]}")
            return -sub(n[1]) if n[0] == "-" else sub(n[1])
        if n.kind == "compare":
            return self._compared(n, x, env)
        if n.kind == "bin":
            return self._operated(n, x, env)
        if n.kind == "cond":
            cases = [(F.lit(True) if t == Node("name", ("_",)) else self.truth(t, x, env), sub(v)) for t, v in n[0]]
            return S.cond(*cases, otherwise=None if n[1] is None else sub(n[1]))
        if n.kind == "match":
            cases = []
            for pattern, value in n[1]:
                inner = env.new_child()
                cases.append((self.fits(pattern, n[0], x, inner), self._column(value, x, inner)))
            return S.cond(*cases, otherwise=None)
        if n.kind == "template":
            return F.concat(*[F.lit(m) if isinstance(m, str) else self._expanded(m, x, env) for m in n[0]], F.lit(""))
        if n.kind in ("tuple", "array"):
            return F.struct(*[sub(v).alias(k) for k, v in n[0]]) if n.kind == "tuple" else F.array(*map(sub, n[0]))
        if n.kind == "set":
            return S.as_set(F.array(*map(sub, n[0])))
        if n.kind == "count":
            return F.size(sub(n[0])).cast("double")
        if n.kind == "safe":
            return self._column(self.plain_tails(n, x, env), x, env)
        if n.kind == "call":
            return self._called(n, x, env)
        if n.kind == "arrow":
            return self._folded(n, x, env)
        raise V.EvalError(f"cannot be a column: {n.kind}")

    def bound(self, n: Node, env: ChainMap) -> Any:
        return env.get(n[0]) if n.kind == "name" else None

    def is_row(self, n: Node, env: ChainMap) -> bool:
        """Whether a node is the dot that stands for a relation's row, or a name for it."""
        bound = env.get(n[0]) if n.kind == "name" else None
        return not isinstance(bound, Column) and (n == Node("name", (".",)) or isinstance(bound, Node) and bound == Node("name", (".",)))

    def truth(self, n: Node, x: Rel, env: ChainMap) -> Column:
        c = self._column(n, x, env)
        return c if self.is_test(n) else S.truthy(c, self.kind_of(c, x))

    def is_test(self, n: Node) -> bool:
        """Whether a node's column is a truth value by its form, also where types aren't known: over the elements of a column."""
        if n.kind == "bin" and n[0] in ("&&", "||"):
            return self.is_test(n[1]) and self.is_test(n[2])
        return n.kind == "compare" or n.kind == "unary" and n[0] == "!"

    def plain_tails(self, n: Node, x: Rel, env: ChainMap) -> Node:
        """A chain of tails over a column: attributes are there or not by the type, whatever the row."""
        node = n[0]
        for tail, may in n[1]:
            if tail.kind != "get":
                raise V.EvalError("a call in a chain cannot be a column")
            names = x.names if self.is_row(node, env) else getattr(self.column(node, x, env)[1], "names", [])
            if tail[1] not in names:
                if may:
                    return n[2]
                raise Missing(f"no attribute {tail[1]!r}")
            node = Node("get", (node, tail[1], None))
        return node

    def _called(self, n: Node, x: Rel, env: ChainMap) -> Column:
        f, args = n[0], n[1]
        if f.kind == "std" and hasattr(self.std.get(f[0]), "column"):
            known, subject = self.std[f[0]], None
            if getattr(known, "array", None) and args[-1].kind != "lit":
                subject = self._column(args[-1], x, env)
            kind = None if subject is None else self.kind_of(subject, x)
            if isinstance(kind, T.ArrayType) and (isinstance(kind.elementType, T.ArrayType) or not known.nested):
                return known.array(*[self._column(m, x, env) for m in args[:-1]], subject)
            return known.column(*[m if m.kind == "lit" else self._column(m, x, env) for m in args])
        if f.kind == "name" and f[0] in self.columns:
            return self.columns[f[0]](*[self._column(m, x, env) for m in args])
        if f.kind == "name" and isinstance(env.get(f[0]), Callable) and hasattr(env[f[0]], "node"):
            body = env[f[0]].node
            return self.lambda_of(body, x, env, *[self._column(m, x, env) for m in args])
        if f.kind not in ("get", "item", "call", "name", "arrow", "array") or len(args) != 1:
            raise V.EvalError("cannot be a column: a call")
        c, kind = self.column(f, x, env)
        at = self._column(args[0], x, env)
        if isinstance(kind, T.ArrayType) and not (isinstance(kind.elementType, T.StructType) and "key" in kind.elementType.names):
            found = F.get(c, at.cast("int"))
        elif isinstance(kind, T.MapType):
            found = F.try_element_at(c, at)
        elif isinstance(kind, T.StringType):
            found = F.when((at >= 0) & (at < F.length(c)), S.char_at(c, at.cast("int")))
        else:
            return S.lookup(c, at, n[2] and self._column(n[2], x, env))
        return F.coalesce(found, F.raise_error(F.lit("expected one result")) if n[2] is None else self._column(n[2], x, env))

    def _folded(self, n: Node, x: Rel, env: ChainMap) -> Column:
        op, arr = n[0], self._column(n[1], x, env)
        if op == "->":
            return self.lambda_of(n[2], x, env, arr)
        if op == ":>":
            kind = self.kind_of(arr, x)
            return S.tuple_map(arr, kind, lambda c: self.lambda_of(n[2], x, env, c))
        if op == ">>>":
            return F.transform(arr, lambda e, i: self.lambda_of(n[2], x, env, i.cast("double"), e))
        if op == "where":
            return F.filter(arr, lambda e: self.lambda_of(n[2], x, env, e))
        made = F.transform(arr, lambda e: self.lambda_of(n[2], x, env, e))
        if op == ">>":
            return made
        if op == "=>":
            return S.as_set(made)
        if op == "orderby":
            pairs = F.transform(arr, lambda e: F.struct(self.lambda_of(n[2], x, env, e).alias("k"), e.alias("v")))
            return F.transform(F.array_sort(pairs), lambda p: p["v"])
        if op == "sum":
            return F.aggregate(made, F.lit(0.0), lambda a, b: a + b.cast("double"))
        if op == "mean":
            return F.aggregate(made, F.lit(0.0), lambda a, b: a + b.cast("double")) / F.size(arr)
        if op == "median":
            rising, size = F.array_sort(made), F.size(arr)
            return (F.get(rising, ((size - 1) / 2).cast("int")) + F.get(rising, (size / 2).cast("int"))) / 2.0
        if op in ("max", "min"):
            return {"max": F.array_max, "min": F.array_min}[op](made)
        raise V.EvalError(f"cannot be a column: {op}")

    def _expanded(self, part: tuple, x: Rel, env: ChainMap) -> Column:
        """A text's part as a column; formats are those of printf for numbers."""
        node, form, delimiter, tail = part
        c, kind = self.column(node, x, env)
        if delimiter is not None:
            item = kind.elementType
            made = F.array_join(F.transform(c, lambda e: S.shown(e, item, form)), delimiter)
        else:
            made = S.shown(c, kind, form)
        return F.when(made == "", made).otherwise(F.concat(made, F.lit(tail))) if tail else made

    def _compared(self, n: Node, x: Rel, env: ChainMap) -> Column:
        left, out = self._column(n[0], x, env), None
        for op, node in n[1]:
            right = self._column(node, x, env)
            test = {
                "=": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
                "<:": lambda a, b: F.array_contains(b, a), "(<=)": S.s_subset, "(<)": lambda a, b: S.s_subset(a, b, True),
                "(>=)": lambda a, b: S.s_subset(b, a), "(>)": lambda a, b: S.s_subset(b, a, True), "(<>=)": lambda a, b: S.s_subset(a, b) | S.s_subset(b, a),
                "(<>)": lambda a, b: S.s_subset(a, b, True) | S.s_subset(b, a, True),
            }
            made = test[op](left, right) if op in test else ~test[op[1:]](left, right)
            out, left = made if out is None else out & made, right
        return out

    def _operated(self, n: Node, x: Rel, env: ChainMap) -> Column:
        op = n[0]
        if op == "+>" and n[2].kind == "tuple":
            own = Node("get", (env[""], *n[1].args[1:])) if n[1].kind == "get" and n[1][0] == Node("name", ("",)) else n[1]
            inner = env.new_child({"": own})
            return functools.reduce(lambda c, kv: c.withField(kv[0], self._column(kv[1], x, inner)), n[2][0], self._column(n[1], x, env))
        a, b = self._column(n[1], x, env), self._column(n[2], x, env)
        if op in ("&&", "||"):
            if self.is_test(n):
                return a & b if op == "&&" else a | b
            kind, other = self.kind_of(a, x), self.kind_of(b, x)
            if isinstance(kind, T.BooleanType) and isinstance(other, T.BooleanType):
                return a & b if op == "&&" else a | b
            return F.when(S.truthy(a, kind), b if op == "&&" else a).otherwise(a if op == "&&" else b)
        if op in ("with", "without"):
            return F.array_sort(F.array_union(a, F.array(b)) if op == "with" else F.array_except(a, F.array(b)))
        if op == "++":
            return F.concat(a, b)
        made = {"/": S.divide, "//": S.floor_divide, "%": S.modulo, "-%": S.round_down, "^": S.power, "|": S.s_union, "&": S.s_common, "&~": S.s_minus, "~~": S.s_symmetric}
        if op in made:
            return made[op](a, b)
        if op not in ("+", "-", "*"):
            raise V.EvalError(f"cannot be a column: {op}")
        return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__}[op](b)
