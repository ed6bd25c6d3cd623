"""Pod logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_LINES = 10_000


def collect_logs(
    lines: DataFrame, pods: DataFrame, pod: str, line_no: str, line: str,
    name: str = "name", phase: str = "phase", block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """One text per scheduler or worker pod, its lines in order.

    A pod that is not Running gets a sentence that says so, other pods are left out.
    Lines are joined per block of line numbers first, before any join with the pods, so
    a pod with very many lines spreads over many tasks. The text of one pod is one value
    and has to fit one, as in any table.
    """
    wanted = pods.where(F.col(name).contains("scheduler") | F.col(name).contains("worker"))
    blocks = (
        lines.withColumn("_line", F.coalesce(line, F.lit("")))
        .groupBy(pod, F.floor(F.col(line_no) / block_lines).alias("_block"))
        .agg(F.expr(f"listagg(_line, '\n') WITHIN GROUP (ORDER BY {line_no}, _line)").alias("_text"))
    )
    running = wanted.where(F.col(phase) == "Running").select(pod)
    blocks = blocks.join(running, pod, "left_semi")
    texts = blocks.groupBy(pod).agg(
        F.expr("listagg(_text, '\\n') WITHIN GROUP (ORDER BY _block)").alias("_text")
    )
    missing = F.concat(F.lit("Cannot find logs. Pod is "), phase, F.lit("."))
    log = F.when(F.col(phase) == "Running", F.coalesce("_text", F.lit(""))).otherwise(missing)
    return wanted.join(texts, pod, "left").withColumn("log", log).drop("_text")
