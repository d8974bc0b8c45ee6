"""Input derivations shared by a Spark query and its oracle.

A derivation is a SQL template over fixture views / base tables that only
reshapes rows into the input schema an operator expects. It is rendered with
the same macros as the fixture views, so both engines see identical inputs;
the operator under test then runs through the library's own DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.sources import fixtures, store

DUCK = dict(fixtures.DUCK_MACROS, V="varchar", LB="[", RB="]")
SPARK = dict(fixtures.SPARK_MACROS, V="string", LB="array(", RB=")")


def spark_input(spark: SparkSession, sf_dir: str, template: str, reads: list[str]) -> DataFrame:
    args = {}
    for name in reads:
        if name in ("logs", "doc_logs"):
            args[name] = store.logs_table(spark, sf_dir, name).drop("added_date")
        elif name in fixtures.TEMPLATES:
            args[name] = fixtures.view(spark, sf_dir, name)
        else:
            args[name] = fixtures.table(spark, sf_dir, name)
    # Table placeholders and doubled braces are left for spark.sql's own formatting.
    return spark.sql(_subst(template, SPARK), **args)


def duck_input(template: str, reads: list[str]) -> str:
    text = _subst(template, dict(DUCK, **{n: n for n in reads}))
    return text.replace("{{", "{").replace("}}", "}")


def _subst(template: str, macros: dict[str, str]) -> str:
    for key, value in macros.items():
        template = template.replace("{" + key + "}", value)
    return template


def duck_with(views: list[str], **derived: tuple[str, list[str]]) -> str:
    """A ``with`` clause: fixture views, then named derivations."""
    parts = []
    if views:
        parts.append(fixtures.duck_cte(*views)[len("with "):])
    for name, (template, reads) in derived.items():
        parts.append(f"{name} as ({duck_input(template, reads)})")
    return "with " + ",\n".join(parts)
