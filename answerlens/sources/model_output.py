"""Rows out of the text a model returned for a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_FENCE = r"(?i)```(?:javascript|json|js|csv|typescript|ts)?\s*"
_COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def clean_output(text: Column) -> Column:
    """Drop code fences and outer blanks."""
    return F.regexp_replace(F.regexp_replace(text, _FENCE, ""), r"^\s+|\s+$", "")


def _unquote(value: Column) -> Column:
    v = F.trim(value)
    quoted = v.rlike(r'^".*"$') & (F.length(v) >= 2)
    return F.when(quoted, F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)


def parse_batch_output(df: DataFrame, fmt: str, columns: list[str], keys: list[str], column: str = "response") -> DataFrame:
    """(keys, id, one column per name) from CSV or JSON output; the last row of an id wins.

    CSV: ``id,value…`` lines, surplus columns stay in the last one.  JSON: an array of objects with
    a numeric ``id``, or an object keyed by id.  Rows with a bad id are dropped.  A comma list in
    ``similar`` becomes an array.
    """
    text = clean_output(F.col(column))
    if fmt == "csv":
        lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")
        rows = df.select(*keys, F.posexplode(lines).alias("pos", "line"))
        cells = F.split("line", _COMMA_OUTSIDE_QUOTES, len(columns) + 1)
        cell = lambda n: F.try_element_at(cells, F.lit(n))
        number = F.regexp_extract(_unquote(cell(1)), r"^\s*([+-]?\d+)", 1)
        values = [_unquote(cell(n + 2)).alias(c) for n, c in enumerate(columns)]
        parsed = rows.select(*keys, "pos", number.try_cast("int").alias("id"), *values)
    elif fmt == "json":
        listed = F.from_json(text, "array<map<string,string>>")
        keyed = F.from_json(text, "map<string,map<string,string>>")
        as_list = F.transform(listed, lambda m: F.struct(F.try_element_at(m, F.lit("id")).alias("id"), m.alias("m")))
        as_map = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("m")))
        items = F.when(text.startswith("["), as_list).otherwise(as_map)
        rows = df.select(*keys, F.posexplode(items).alias("pos", "i")).filter(F.col("i.m").isNotNull())
        values = [F.try_element_at("i.m", F.lit(c)).alias(c) for c in columns]
        number = F.regexp_extract("i.id", r"^\s*([+-]?\d+)", 1)
        parsed = rows.select(*keys, "pos", number.try_cast("int").alias("id"), *values)
    else:
        raise ValueError(fmt)
    newest = parsed.filter(F.col("id").isNotNull()).groupBy(*keys, "id").agg(
        F.max_by(F.struct(*columns), "pos").alias("v")
    )
    out = newest.select(*keys, "id", *[F.col(f"v.{c}").alias(c) for c in columns])
    if "similar" in columns:
        plain = F.regexp_replace("similar", r'^\[|\]$|"', "") if fmt == "json" else F.col("similar")
        out = out.withColumn("similar", F.filter(F.transform(F.split(plain, ","), lambda s: F.trim(s)), lambda s: s != ""))
    return out
