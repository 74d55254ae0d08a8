"""Tool names that look like other tools' names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.text import fold_identifier


def known_names(baselines: DataFrame) -> DataFrame:
    """(program, known, fold): for each program and fold the first known name, in baseline order."""
    names = baselines.select("program", F.posexplode("tools").alias("pos", "tool")).select("program", "pos", F.col("tool.name").alias("known"))
    folded = names.withColumn("fold", fold_identifier(F.col("known"))).where("fold <> ''")
    return folded.groupBy("program", "fold").agg(F.min_by("known", "pos").alias("known"))


def collisions(calls: DataFrame, baselines: DataFrame, program: str = "program", tool: str = "tool") -> DataFrame:
    """(program, tool, collision) of the distinct called names that fold to a known name of the program but are none of them.

    Names are made distinct with map-side partial aggregation before they are
    folded, so that a name called a billion times is folded once.
    """
    called = calls.select(F.col(program).alias("program"), F.col(tool).alias("tool")).where("tool IS NOT NULL").distinct()
    exact = baselines.select("program", F.explode("tools.name").alias("tool")).distinct()
    strange = called.join(exact, ["program", "tool"], "left_anti").withColumn("fold", fold_identifier(F.col("tool")))
    return strange.join(known_names(baselines), ["program", "fold"]).select("program", "tool", F.col("known").alias("collision"))


def with_collisions(calls: DataFrame, baselines: DataFrame, program: str = "program", tool: str = "tool") -> DataFrame:
    """calls and the name each call's tool impersonates, or null."""
    found = collisions(calls, baselines, program, tool).select(F.col("program").alias("_p"), F.col("tool").alias("_t"), "collision")
    return calls.drop("collision").join(found, (F.col(program) == F.col("_p")) & (F.col(tool) == F.col("_t")), "left").drop("_p", "_t")


def shadows(baselines: DataFrame) -> DataFrame:
    """Tools that several programs describe alike: each program's tool against the first program with that description.

    (description_hash, program, name, other, other_name): one row a program and tool, not one a pair.
    """
    tools = baselines.select("program", F.explode("tools").alias("t")).select("program", F.col("t.name").alias("name"), F.col("t.description_hash").alias("description_hash")).distinct()
    first = tools.groupBy("description_hash").agg(F.min(F.struct("program", "name")).alias("first"))
    return tools.join(first, "description_hash").where("first.program < program").select("description_hash", F.col("first.program").alias("program"), F.col("first.name").alias("name"), F.col("program").alias("other"), F.col("name").alias("other_name"))
