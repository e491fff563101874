"""XML: constructors over strings, XMLTABLE by XPath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(x: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def element(name: str, *content: Column, attributes: dict[str, Column] | None = None) -> Column:
    """xmlelement: attributes that are null are left out; content is XML already (use `escape` for text); empty content closes at once."""
    told = [F.coalesce(F.concat(F.lit(f' {k}="'), escape(v, True), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    inner = F.concat(*[F.coalesce(c, F.lit("")) for c in content]) if content else F.lit("")
    opened = F.concat(F.lit(f"<{name}"), *told)
    return F.when(inner == "", F.concat(opened, F.lit("/>"))).otherwise(F.concat(opened, F.lit(">"), inner, F.lit(f"</{name}>")))


def forest(values: dict[str, Column]) -> Column:
    """xmlforest: an element for each value that isn't null."""
    return F.concat(*[F.when(v.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<{k}>"), escape(v), F.lit(f"</{k}>"))) for k, v in values.items()])


def root(x: Column, version: str = "1.0", standalone: bool | None = None) -> Column:
    """XMLROOT: the value with a declaration of its own in place of the one it has."""
    alone = "" if standalone is None else f' standalone="{"yes" if standalone else "no"}"'
    return F.concat(F.lit(f'<?xml version="{version}"{alone}?>'), F.regexp_replace(x, r"^\s*<\?xml[^>]*\?>", ""))


def serialize(x: Column, kind: str = "string") -> Column:
    """XMLSERIALIZE(CONTENT x AS kind)."""
    return x.cast(kind)


def comment(text: Column) -> Column:
    return F.concat(F.lit("<!--"), text, F.lit("-->"))


def processing(target: str, text: Column) -> Column:
    return F.concat(F.lit(f"<?{target} "), text, F.lit("?>"))


def xml_agg(x: Column, *order: Column) -> Column:
    from plumbline.operators.aggregates import array_agg

    return F.array_join(F.filter(array_agg(x, *(order or (x,))), lambda v: v.isNotNull()), "")


def xml_table(df: DataFrame, doc: Column, path: str, columns: dict[str, str], ordinality: str | None = None) -> DataFrame:
    """XMLTABLE: a row for each node at `path`, text columns by paths below it (name or @attribute).

    `path` is absolute, through elements that occur once, to the repeated one: /root/list/row. The document is parsed once,
    with the schema that path and columns give, so a node that lacks a part has null there.
    """
    _, _, *between, row = path.split("/")
    fields = ", ".join(f"`{'_' + below[1:] if below.startswith('@') else below}` STRING" for below in columns.values())
    schema = f"`{row}` ARRAY<STRUCT<{fields}>>"
    for name in reversed(between):
        schema = f"`{name}` STRUCT<{schema.replace(' ', ': ', 1)}>"
    parsed = F.from_xml(doc, schema)
    for name in between:
        parsed = parsed[name]
    out = df.select("*", F.posexplode(parsed[row]).alias("_i", "_row"))
    told = [F.col("_row")["_" + below[1:] if below.startswith("@") else below].alias(name) for name, below in columns.items()]
    return out.select(*df.columns, *([(F.col("_i") + 1).cast("long").alias(ordinality)] if ordinality else []), *told)
