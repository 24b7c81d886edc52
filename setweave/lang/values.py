"""Values of the language outside DataFrames: numbers, strings, arrays (tuples of Python), sets, tuples, dictionaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any


class Tup(dict):
    """A tuple of named values."""

    def __hash__(self) -> int:
        return hash(frozenset(self.items()))


class Dic(Tup):
    """A dictionary."""


@dataclass(frozen=True)
class Off:
    """A string, array or bytes that begins at another position than 0."""

    at: int
    items: Any


def offset(n: int, x: Any) -> Any:
    if isinstance(x, Off):
        return offset(n + x.at, x.items)
    if x != FALSE and not isinstance(x, str | bytes | tuple):
        raise EvalError(f"{show(x)} has no positions")
    return Off(n, x) if n and x != FALSE else x


def array(items: Any) -> Any:
    """An array of items, None for holes; holes at either end are no part of it."""
    held = [i for i, x in enumerate(items) if x is not None]
    return offset(held[0], tuple(items[held[0] : held[-1] + 1])) if held else FALSE


def bare(x: Any) -> Any:
    """A sequence as if it began at 0."""
    return x.items if isinstance(x, Off) else x


class EvalError(ValueError):
    pass


def value(x: Any) -> Any:
    """A value from a Python object: lists are arrays, sets are sets, dictionaries are dictionaries."""
    if isinstance(x, bool) or x is None:
        return frozenset([Tup()]) if x else frozenset()
    if isinstance(x, int | float):
        return float(x)
    if isinstance(x, list | tuple):
        return tuple(map(value, x)) or frozenset()
    if isinstance(x, set | frozenset):
        return frozenset(map(value, x))
    if isinstance(x, Tup):
        return type(x)({k: value(v) for k, v in x.items()})
    if isinstance(x, dict):
        return Dic({value(k): value(v) for k, v in x.items()}) or frozenset()
    return x or frozenset() if isinstance(x, str | bytes) else x


TRUE, FALSE = frozenset([Tup()]), frozenset()


def true(x: Any) -> bool:
    return bool(x != 0 if isinstance(x, float) else len(x) if hasattr(x, "__len__") else True)


def kind(x: Any) -> int:
    if isinstance(x, float):
        return 100
    if isinstance(x, Off):
        return kind(x.items)
    if x == FALSE:
        return 198
    if x == TRUE:
        return 199
    for k, t in ((204, str), (207, bytes), (208, tuple), (209, Dic), (300, Tup)):
        if isinstance(x, t):
            return k
    return 211 if is_relation(x) else 200


def is_relation(x: Any) -> bool:
    return isinstance(x, frozenset) and bool(x) and all(isinstance(e, Tup) for e in x)


class _Down:
    """A key in the opposite order: that of negated values other than numbers."""

    def __init__(self, key: Any):
        self.key = key

    def __lt__(self, other: _Down) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Down) and self.key == other.key


def order(x: Any):
    """A key of the universal order: by kind, then by value."""
    if x is None:
        return (0,)
    k = kind(x)
    if isinstance(x, float | str | bytes):
        return (k, x)
    if isinstance(x, Off):
        inner = order(x.items)
        return (k, x.at, inner[2]) if k == 208 else (*inner, x.at)
    if isinstance(x, tuple):
        return (k, 0, tuple(map(order, x)))
    if isinstance(x, Dic):
        return (k, tuple(sorted((order(a), order(b)) for a, b in x.items())))
    if isinstance(x, Tup):
        if set(x) == {"@neg"}:
            return (k + 0.5, _Down(order(x["@neg"])))
        return (k, tuple((n, order(x[n])) for n in sorted(x)))
    if k == 211 and len({frozenset(t) for t in x}) == 1:
        names = heading(x)
        return (k, tuple(names), len(x), tuple(sorted(tuple(order(t[n]) for n in names) for t in x)))
    if isinstance(x, frozenset):
        return (200 if k == 211 else k, tuple(sorted(map(order, x))))
    return (k, id(x))


def elements(x: Any) -> list:
    """The elements of any set: sequences are positions with items, dictionaries keys with values."""
    if isinstance(x, frozenset):
        return list(x)
    if isinstance(x, Off):
        return [Tup({**t, "@": t["@"] + x.at}) for t in elements(x.items)]
    if isinstance(x, str):
        return [Tup({"@": float(i), "@char": float(ord(c))}) for i, c in enumerate(x)]
    if isinstance(x, bytes):
        return [Tup({"@": float(i), "@byte": float(c)}) for i, c in enumerate(x)]
    if isinstance(x, tuple):
        return [Tup({"@": float(i), "@item": e}) for i, e in enumerate(x) if e is not None]
    if isinstance(x, Dic):
        return [Tup({"@": k, "@value": v}) for k, v in x.items()]
    raise EvalError(f"not a set: {show(x)}")


def as_set(items) -> Any:
    """A set; of positions with characters, bytes, items or values it is the string, bytes, array or dictionary."""
    got = frozenset(items)
    if not is_relation(got):
        return got
    names = {frozenset(t) for t in got}
    if len(names) != 1:
        return got
    for part, make in (("@char", lambda v: "".join(chr(int(c)) for c in v)), ("@byte", lambda v: bytes(int(c) for c in v)), ("@item", tuple)):
        if names == {frozenset(["@", part])}:
            at = sorted(got, key=lambda t: t["@"])
            first, last = int(at[0]["@"]), int(at[-1]["@"])
            places = {t["@"]: t[part] for t in at}
            if len(places) == len(at) and all(p == int(p) for p in places) and (part == "@item" or last - first + 1 == len(at)):
                return offset(first, make([places.get(float(i)) for i in range(first, last + 1)]))
    if names == {frozenset(["@", "@value"])} and len({t["@"] for t in got}) == len(got):
        return Dic({t["@"]: t["@value"] for t in got})
    return got


def heading(x: Any) -> list[str]:
    names = {frozenset(t) for t in elements(x) if isinstance(t, Tup)}
    if len(names) != 1 or any(not isinstance(t, Tup) for t in elements(x)):
        raise EvalError("not a relation; inconsistent attribute names")
    return sorted(next(iter(names)))


def join(op: str, a: Any, b: Any) -> Any:
    """The natural joins of local values: which of left, common and right attributes the sign keeps."""
    left, right = elements(a), elements(b)
    if not left or not right:
        return FALSE
    la, ra = heading(a), heading(b)
    both = [n for n in la if n in ra]
    keep = set(both) if op in ("<&>", "-&-", "<&-", "-&>") else set()
    keep |= {n for n in la if n not in both} if op[0] == "<" else set()
    keep |= {n for n in ra if n not in both} if op[-1] == ">" else set()
    index: dict = {}
    for t in right:
        index.setdefault(tuple(t[n] for n in both), []).append(t)
    return as_set(Tup({n: v for n, v in {**t, **u}.items() if n in keep}) for t in left for u in index.get(tuple(t[n] for n in both), []))


def subsets(x: Any) -> frozenset:
    return frozenset(reduce(lambda acc, e: acc + [s | {e} for s in acc], elements(x), [frozenset()]))


def show(x: Any) -> str:
    if isinstance(x, Off):
        return f"{x.at}\\{show(x.items)}"
    if isinstance(x, float):
        return f"{int(x)}" if x == int(x) and abs(x) < 1e15 else repr(x)
    if x == FALSE:
        return "{}"
    if x == TRUE:
        return "true"
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    if isinstance(x, tuple):
        return "[" + ", ".join("" if e is None else show(e) for e in x) + "]"
    if isinstance(x, Dic):
        return "{" + ", ".join(f"{show(k)}: {show(v)}" for k, v in sorted(x.items(), key=lambda e: order(e[0]))) + "}"
    if isinstance(x, Tup):
        return "(" + ", ".join(f"{k}: {show(v)}" for k, v in sorted(x.items())) + ")"
    if isinstance(x, bytes):
        return "<<" + ", ".join(map(str, x)) + ">>"
    if isinstance(x, frozenset):
        return "{" + ", ".join(show(e) for e in sorted(x, key=order)) + "}"
    return repr(x)


def pretty(x: Any, depth: int = 0) -> str:
    """A value on several lines: plain ones stand in one line, the parts of others on lines of their own, each with a comma."""

    def plain(v: Any) -> bool:
        v = bare(v)
        if v is None or isinstance(v, float | str) or v == FALSE:
            return True
        return isinstance(v, tuple | frozenset) and not is_relation(v) and v != TRUE and all(map(plain, v))

    def block(parts: list[str], brackets: str, flat: bool = False) -> str:
        if flat or not parts:
            return brackets[0] + ", ".join(parts) + brackets[1]
        return brackets[0] + "".join(f"\n{'  ' * (depth + 1)}{p}," for p in parts) + "\n" + "  " * depth + brackets[1]

    def inside(v: Any) -> str:
        return "" if v is None else pretty(v, depth + 1)

    x = bare(x)
    if isinstance(x, Dic):
        return block([f"{inside(k)}: {inside(v)}" for k, v in sorted(x.items(), key=lambda e: order(e[0]))], "{}")
    if isinstance(x, Tup):
        return block([f"{k or repr(k)}: {inside(x[k])}" for k in sorted(x)], "()")
    if isinstance(x, tuple):
        return block(list(map(inside, x)), "[]", plain(x))
    if not isinstance(x, frozenset) or x in (FALSE, TRUE):
        return show(x)
    items = sorted(x, key=order)
    if not is_relation(x) or len({frozenset(t) for t in x}) > 1:
        return block(list(map(inside, items)), "{}", plain(x))
    names, margin, rows = heading(x), "\n" + "  " * (depth + 1), ""
    for t in sorted(items, key=lambda t: [order(t[n]) for n in names]):
        values = [t[n] for n in names]
        if all(map(plain, values)):
            rows += f"{margin}({', '.join(pretty(v, depth + 2) for v in values)}),"
        else:
            rows += f"{margin}(" + "".join(f"{margin}  {pretty(v, depth + 2)}," for v in values) + f"{margin}),"
    return "{" + margin + "|" + ", ".join(names) + "|" + rows + "\n" + "  " * depth + "}"


def shown(form: str, x: Any) -> str:
    """A value in a text: strings as they are, others as they are written; ``form`` as in printf."""
    x = bare(x)
    plain = "" if x == FALSE else x if isinstance(x, str) else x.decode("utf-8", "replace") if isinstance(x, bytes) else show(x)
    last = form[-1:]
    if last in ("", "v", "s"):
        return f"%{form[:-1]}s" % plain
    if last == "t":
        return f"%{form[:-1]}s" % ("true" if true(x) else "false")
    if last == "q":
        return f"%{form[:-1]}s" % ('"' + plain.replace("\\", "\\\\").replace('"', '\\"') + '"')
    if not isinstance(x, float):
        raise EvalError(f"%{form} needs a number, not {show(x)}")
    if last == "U":
        return f"U+{int(x):04X}"
    return f"%{form}" % (x if last in "fFgGeE" else chr(int(x)) if last == "c" else int(x))


def expand(form: str, x: Any, delimiter: str | None, tail: str) -> str:
    """A value in a text; with a delimiter it is an array, of which holes give nothing."""
    if delimiter is None:
        made = shown(form, x)
    elif isinstance(x, tuple) or x == FALSE:
        made = delimiter.join("" if e is None else shown(form, e) for e in x)
    else:
        raise EvalError(f"a delimiter needs an array, not {show(x)}")
    return made + tail if made else made
