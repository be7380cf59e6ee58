"""JSON of unlike shapes as VARIANT: read once, asked by path, and counted by path and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types by how the schema of a value begins.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(value: str) -> str:
    return f"case {' '.join(f'''when startswith(schema_of_variant({value}), '{k}') then '{v}' ''' for k, v in KINDS.items())} else 'number' end"


def shapes(df: DataFrame, text: str, keep: list[str], levels: int = 2) -> DataFrame:
    """(keep, path, kind, n): how many values of each type each path has, down to so many levels; elements of a list share a path.

    A text that is no JSON counts under the path $ as malformed, a null text not at all.
    """
    rows = df.filter(F.col(text).isNotNull()).select(*keep, F.expr(f"try_parse_json({text})").alias("v"), F.lit("$").alias("path"))
    found = rows.select(*keep, "path", F.expr(f"if(v is null, 'malformed', {_kind('v')})").alias("kind"))
    level = rows.filter("v is not null")
    for _ in range(levels):
        level = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*keep, F.col("value").alias("v"), F.concat("path", F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), "key"))).alias("path"))
        found = found.unionByName(level.select(*keep, "path", F.expr(_kind("v")).alias("kind")))
    return found.groupBy(*keep, "path", "kind").agg(F.count(F.lit(1)).alias("n"))
