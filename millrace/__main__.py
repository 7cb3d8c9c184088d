r"""A shell: ``python -m millrace FOLDER``. Statements end with ``;``.

Macros: \l databases, \dt tables, \di TABLE indexes, \d TABLE columns, \c DATABASE use it, \timing on or off,
\i FILE run a script, \export SELECT ... to FILE, \import TABLE FILE, \begin \commit \rollback \save
\vacuum [TABLE] \analyze [TABLE] \explain SELECT ..., \stats cache figures, \q leave.
"""

from __future__ import annotations

import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from millrace.plans.auth import Denied
from millrace.plans.engine import Engine, split_statements, tokenize
from millrace.session import session
from millrace.sources.files import Files
from millrace.sources.store import StoreError


def expand(engine: Engine, line: str) -> list[str]:
    """The statements that a macro stands for."""
    name, _, rest = line[1:].partition(" ")
    rest = rest.strip().rstrip(";")
    simple = {"l": "SHOW DATABASES", "dt": "SHOW TABLES", "begin": "BEGIN", "commit": "COMMIT", "rollback": "ROLLBACK", "save": "SAVE"}
    if name in simple:
        return [simple[name]]
    if name == "i":
        folder, _, file = rest.rpartition("/")
        return split_statements(Files(engine.spark, folder or ".").read(file))
    if name == "export":
        query, _, path = rest.rpartition(" to ")
        return [f"EXPORT {query} TO '{path.strip()}'"]
    if name == "import":
        table, _, path = rest.partition(" ")
        return [f"IMPORT INTO {table} FROM '{path.strip()}'"]
    known = {"di": "SHOW INDEXES FROM", "d": "DESCRIBE", "c": "USE", "vacuum": "VACUUM", "analyze": "ANALYZE", "explain": "EXPLAIN"}
    if name in known:
        return [f"{known[name]} {rest}".strip()]
    raise StoreError("SYNTAX", f"no macro {name}")


def run(engine: Engine, statement: str, timing: bool, out=sys.stdout) -> None:
    began = time.monotonic()
    try:
        result = engine.sql(statement)
        if isinstance(result, DataFrame):
            result.show(50, truncate=80)
        else:
            print(result.message, file=out)
    except (StoreError, Denied, PySparkException, ValueError) as e:
        print(f"error: {str(e).splitlines()[0]}", file=out)
    if timing:
        print(f"{1000 * (time.monotonic() - began):.0f} ms", file=out)


def main(folder: str, lines=sys.stdin) -> None:
    engine, timing, buffer = Engine(session(), folder), False, ""
    for line in lines:
        if not buffer and line.startswith("\\"):
            word = line[1:].split()[0] if line[1:].split() else ""
            if word == "q":
                return
            if word == "timing":
                timing = not timing
            elif word == "stats":
                print(f"cache: {engine.cache.hits} hits, {engine.cache.misses} misses, {len(engine.cache.held)} results")
            else:
                try:
                    for s in expand(engine, line.strip()):
                        run(engine, s, timing)
                except StoreError as e:
                    print(f"error: {e}")
            continue
        buffer += line
        if any(kind == "symbol" and t == ";" for kind, t in tokenize(buffer)):
            for s in split_statements(buffer):
                run(engine, s, timing)
            buffer = ""


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "millrace-store")
