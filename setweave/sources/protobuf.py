"""Protocol buffers: descriptors as the compiler writes them, and messages as tuples."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from setweave.lang import values as V

# Fixed values of the format: types of fields by number, and the wire type of each that isn't a plain varint.
DOUBLE, FLOAT, INT64, UINT64, INT32, FIXED64, FIXED32, BOOL, STRING, GROUP, MESSAGE, BYTES, UINT32, ENUM, SFIXED32, SFIXED64, SINT32, SINT64 = range(1, 19)
_FIXED = {DOUBLE: "<d", FIXED64: "<Q", SFIXED64: "<q", FLOAT: "<f", FIXED32: "<I", SFIXED32: "<i"}
REPEATED = 3


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise V.EvalError("protobuf: a number without an end")
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value & (2**64 - 1), at


def parts(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and content of each field of a message: a number, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire, size = tag & 7, {1: 8, 5: 4}.get(tag & 7)
        if wire == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
            continue
        if wire == 2:
            size, at = _varint(data, at)
        if size is None or at + size > len(data):
            raise V.EvalError("protobuf: a part without an end")
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Field:
    name: str = ""
    number: int = 0
    label: int = 0
    kind: int = 0
    type_name: str = ""


@dataclass
class Types:
    """Messages and enumerations of a descriptor by their full names."""

    messages: dict[str, dict[int, Field]] = field(default_factory=dict)
    maps: set[str] = field(default_factory=set)
    enums: dict[str, dict[int, str]] = field(default_factory=dict)

    def message(self, data: bytes, scope: str) -> None:
        own = list(parts(data))
        name = f"{scope}.{_first(own, 1, b'').decode()}"
        self.messages[name] = {f.number: f for f in (_field(x) for n, x in own if n == 2)}
        for n, x in own:
            if n == 3:
                self.message(x, name)
            elif n == 4:
                self.enum(x, name)
            elif n == 7 and _first(list(parts(x)), 7, 0):
                self.maps.add(name)

    def enum(self, data: bytes, scope: str) -> None:
        own = list(parts(data))
        values = [list(parts(x)) for n, x in own if n == 2]
        self.enums[f"{scope}.{_first(own, 1, b'').decode()}"] = {_signed(_first(v, 2, 0), 64): _first(v, 1, b"").decode() for v in values}


def _first(fields: list[tuple[int, Any]], number: int, missing: Any) -> Any:
    return next((x for n, x in fields if n == number), missing)


def _field(data: bytes) -> Field:
    own = list(parts(data))
    return Field(_first(own, 1, b"").decode(), _first(own, 3, 0), _first(own, 4, 0), _first(own, 5, 0), _first(own, 6, b"").decode())


def descriptor(data: bytes) -> Types:
    """The types of a set of files."""
    types = Types()
    for n, file in parts(data):
        if n == 1:
            own = list(parts(file))
            scope = "." + _first(own, 2, b"").decode() if _first(own, 2, b"") else ""
            for m, x in own:
                if m == 4:
                    types.message(x, scope)
                elif m == 5:
                    types.enum(x, scope)
    return types


def decode(types: Types, name: str, data: bytes) -> V.Tup:
    """A message as a tuple of the fields it holds: messages are tuples, repeated fields arrays, maps dictionaries by the text of their
    keys, enumerations names."""
    full = next((m for m in types.messages if m.lstrip(".") == name.lstrip(".") or m.endswith("." + name)), None)
    if full is None:
        raise V.EvalError(f"protobuf: no message {name}")
    return V.Tup({k: V.value(v) for k, v in _message(types, full, data).items()})


def _message(types: Types, full: str, data: bytes) -> dict[str, Any]:
    known, out = types.messages[full], {}
    for number, raw in parts(data):
        f = known.get(number)
        if f is None:
            continue
        if f.type_name in types.maps:
            entry = _message(types, f.type_name, raw)
            kind = types.messages[f.type_name][2]
            key = entry.get("key", "" if types.messages[f.type_name][1].kind == STRING else 0)
            out.setdefault(f.name, {})[str(key).lower() if isinstance(key, bool) else str(key)] = entry.get("value", _missing(types, kind))
        elif f.label != REPEATED:
            out[f.name] = _value(types, f, raw)
        elif isinstance(raw, bytes) and f.kind not in (STRING, BYTES, MESSAGE):
            out.setdefault(f.name, []).extend(_packed(types, f, raw))
        else:
            out.setdefault(f.name, []).append(_value(types, f, raw))
    return out


def _packed(types: Types, f: Field, raw: bytes) -> Iterator[Any]:
    if f.kind in _FIXED:
        size = struct.calcsize(_FIXED[f.kind])
        # One number alone is as long as its fixed size, packed or not.
        for at in range(0, len(raw), size):
            yield struct.unpack(_FIXED[f.kind], raw[at : at + size])[0]
        return
    at = 0
    while at < len(raw):
        value, at = _varint(raw, at)
        yield _value(types, f, value)


def _signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def _missing(types: Types, f: Field) -> Any:
    return "" if f.kind == STRING else b"" if f.kind in (BYTES, MESSAGE) else _value(types, f, 0) if f.kind not in _FIXED else 0


def _value(types: Types, f: Field, raw: int | bytes) -> Any:
    if f.kind == MESSAGE:
        return V.Tup({k: V.value(v) for k, v in _message(types, f.type_name, raw).items()})
    if f.kind == STRING:
        return raw.decode()
    if f.kind == BYTES:
        return raw
    if f.kind in _FIXED:
        return struct.unpack(_FIXED[f.kind], raw)[0]
    if f.kind == ENUM:
        number = _signed(raw, 64)
        return types.enums[f.type_name].get(number, number)
    if f.kind == BOOL:
        return bool(raw)
    if f.kind in (SINT32, SINT64):
        return (raw >> 1) ^ -(raw & 1)
    return _signed(raw, 32 if f.kind == INT32 else 64) if f.kind in (INT32, INT64) else raw
