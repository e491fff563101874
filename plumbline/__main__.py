"""python -m plumbline check|diff|apply|verify: the library's calls from a shell.

check TEMPLATE SF_DIR            problems of every expansion of a statement, by analysis alone
diff OLD.sql NEW.sql             changes between two declared schemas
apply OLD.sql NEW.sql IN OUT     tables under IN rewritten to the new schema under OUT
verify SCHEMA.sql DIR            where tables under DIR differ from their declaration
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from plumbline import migrate
from plumbline.catalog import parse
from plumbline.session import TABLES, builder, table
from plumbline.statement import query


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="plumbline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in {"check": ["template", "dir"], "diff": ["old", "new"], "apply": ["old", "new", "source", "target"], "verify": ["schema", "dir"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name in ("diff", "apply"):
            p.add_argument("--rename", action="append", default=[], help="table.old=new")
            p.add_argument("--drop", action="append", default=[], help="table.column that may go")
    a = top.parse_args(argv)
    if a.command == "diff":
        changes = migrate.compare(parse(Path(a.old).read_text()), parse(Path(a.new).read_text()), _intents(a))
        for c in changes:
            print(c.op, c.kind, c.name, *(x for x in (c.field, c.before and f"{c.before} -> {c.after}") if x))
        return bool(changes)
    spark = builder("plumbline", "local[*]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "check":
        text = Path(a.template).read_text()
        tables = {t: table(spark, a.dir, t) for t in TABLES if "{" + t + "}" in text}
        found = [p for p in query(object, text).check(spark, tables) if "from" not in p or "columns" not in p]
    elif a.command == "verify":
        declared = parse(Path(a.schema).read_text())
        found = migrate.drift(declared, {t: table(spark, a.dir, t) for t in declared.tables if not declared[t].view})
    else:
        old, new, intents = parse(Path(a.old).read_text()), parse(Path(a.new).read_text()), _intents(a)
        found = []
        for name in new.load_order():
            if name in old.tables and not new[name].view:
                migrate.rewrite(table(spark, a.source, name), old[name], new[name], intents).write.parquet(f"{a.target}/{name}.parquet")
    print(*found, sep="\n", end="\n" if found else "")
    return bool(found)


def _intents(a: argparse.Namespace) -> migrate.Intents:
    return migrate.Intents(dict(x.split("=", 1) for x in a.rename), frozenset(a.drop))


if __name__ == "__main__":
    sys.exit(main())
