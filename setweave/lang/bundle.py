"""A script with all that it imports as one zip file, which runs anywhere."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from typing import Any

from setweave.lang import values as V
from setweave.lang.engine import SCRIPT, Engine
from setweave.lang.parser import Node, parse

MANIFEST = "bundle.json"


def imports(n: Any) -> list[str]:
    """The paths that a syntax tree imports."""
    if isinstance(n, Node):
        return [n[0]] if n.kind == "import" else [p for a in n.args for p in imports(a)]
    return [p for a in n for p in imports(a)] if isinstance(n, tuple) else []


def files_of(main: str) -> list[str]:
    """A script and all files that it imports, directly or not. Their root is the script's folder."""
    root, found, todo = os.path.dirname(os.path.abspath(main)), [], [os.path.abspath(main)]
    while todo:
        path = todo.pop()
        if path in found:
            continue
        found.append(path)
        if path != os.path.abspath(main) and not path.endswith(SCRIPT):
            continue
        with open(path, encoding="utf-8") as f:
            tree = parse(f.read())
        for name in imports(tree):
            full = os.path.normpath(root + name if name.startswith("/") else os.path.join(os.path.dirname(path), name))
            full = full if os.path.exists(full) else full + SCRIPT
            if "://" in name or not os.path.exists(full) or os.path.relpath(full, root).startswith(".."):
                raise V.EvalError(f"cannot bundle {name}")
            todo += [os.path.join(top, x) for top, _, names in os.walk(full) for x in names] if os.path.isdir(full) else [full]
    return found


def write(main: str, out: str) -> None:
    root = os.path.dirname(os.path.abspath(main))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MANIFEST, json.dumps({"main": os.path.basename(main)}))
        for path in sorted(files_of(main)):
            z.write(path, os.path.relpath(path, root))


def run(path: str, spark: Any = None) -> Any:
    """The value of a bundle's script. It is unpacked on the driver, where scripts run."""
    folder = tempfile.mkdtemp(prefix="setweave-bundle-")
    with zipfile.ZipFile(path) as z:
        if any(os.path.isabs(n) or ".." in n.split("/") for n in z.namelist()):
            raise V.EvalError("a bundle with paths outside of it")
        z.extractall(folder)
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        main = json.load(f)["main"]
    return Engine(spark, folder).script(os.path.join(folder, main))
