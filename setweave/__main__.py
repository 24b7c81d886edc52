"""The command line: ``python -m setweave eval TEXT``, ``run FILE`` (a script or a bundle), ``bundle FILE ZIP``, ``json`` (JSON from
standard input as a value), and ``serve [PORT]`` (a root for updates and observations).

``--out=file:PATH`` writes a string or bytes, ``--out=dir:PATH`` a dictionary as a tree; otherwise the value is printed.
Spark starts only if a text makes use of it.
"""

from __future__ import annotations

import argparse
import os
import sys
from typing import Any

from setweave.lang import bundle
from setweave.lang import values as V
from setweave.lang.engine import Engine
from setweave.operators.relation import Rel
from setweave.sources import formats


class _Session:
    """Starts Spark at the first use."""

    def __getattr__(self, name: str) -> Any:
        from pyspark.sql import SparkSession

        return getattr(SparkSession.builder.getOrCreate(), name)


def output(x: Any, out: str | None) -> None:
    if isinstance(x, Rel):
        if out:
            formats.write(x.df, out.partition(":")[2])
        else:
            # One row after the other, so that the driver never holds the relation.
            for row in x.df.toLocalIterator():
                print(V.show(V.Tup({k: V.value(v) for k, v in row.asDict().items()})))
        return
    kind, _, path = (out or "").partition(":")
    if kind == "dir":
        formats.write_dir(x, path)
    elif kind == "file":
        if x != V.FALSE and not isinstance(x, str | bytes):
            raise V.EvalError("a file needs a string or bytes")
        with open(path, "wb") as f:
            f.write(x.encode() if isinstance(x, str) else x or b"")
    elif out:
        raise V.EvalError("--out takes file:PATH or dir:PATH")
    elif isinstance(x, bytes):
        sys.stdout.buffer.write(x)
    else:
        print(x if isinstance(x, str) else "" if x == V.FALSE else V.show(x))


def main(argv: list[str] | None = None) -> None:
    known = argparse.ArgumentParser(prog="setweave")
    known.add_argument("--out")
    known.add_argument("--modules", action="append", default=[], help="a folder of modules")
    known.add_argument("command", choices=("eval", "run", "bundle", "json", "serve"))
    known.add_argument("rest", nargs="*")
    given = known.parse_intermixed_args(argv)
    if given.command == "json":
        value = formats.decode_json(sys.stdin.buffer.read())
    elif given.command == "serve":
        from setweave.streaming.observe import Reactor
        from setweave.streaming.server import Server

        return Server(Reactor(_Session()), port=int(given.rest[0]) if given.rest else 42241).serve_forever()
    elif not given.rest:
        known.error("a text or a file is missing")
    elif given.command == "eval":
        value = Engine(_Session(), modules=tuple(given.modules)).eval(given.rest[0])
    elif given.command == "bundle":
        return bundle.write(*given.rest[:2])
    elif given.rest[0].endswith(".zip"):
        value = bundle.run(given.rest[0], _Session())
    else:
        value = Engine(_Session(), os.path.dirname(os.path.abspath(given.rest[0])), modules=tuple(given.modules)).script(given.rest[0])
    output(value, given.out)


if __name__ == "__main__":
    main()
