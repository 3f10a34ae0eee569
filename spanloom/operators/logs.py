"""Run logs: lines to runs, stages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The log format.
STAGES = ["Object Layer", "Polygon Layer", "Network Layer", "Trench Layer", "Cable Layer", "Duct Layer"]
START = "Algorithm 'One Click – End-to-End HLD Pipeline' starting..."
END = "Algorithm 'One Click – End-to-End HLD Pipeline' finished"
FAILED = "Execution FAILED after"
STAMP = r"^Algorithm started at: (.+)$"
STAGE = r"^  \[timing\] ([^:]+): (?:(.*), )?([\d.]+)s$"
TOTAL = r"^\[timing\] Total pipeline: ([\d.]+)s$"
MARK = "  [timing] "
LAYER_FILE = ".gpkg: "


def after(text: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def told_loosely(line: Column) -> dict[str, Column]:
    """name, info, seconds of `name: info seconds s`, where info has one character at least, if need be the first digit of the seconds."""
    body = F.when(F.startswith(line, F.lit(MARK)), F.substr(line, F.lit(len(MARK) + 1)))
    rest = after(body, ": ")
    core = F.when(F.endswith(rest, F.lit("s")), F.left(rest, F.length(rest) - 1))
    digits = F.least(F.length(core) - F.length(F.rtrim(core, F.lit("0123456789."))), F.length(core) - 1)
    fits = digits > 0
    return {"name": F.when(fits, F.substring_index(body, ": ", 1)), "info": F.when(fits, F.left(core, F.length(core) - digits)), "seconds": F.when(fits, F.right(core, digits))}


def told_writing(line: Column) -> dict[str, Column]:
    """name, info, seconds of `name.gpkg: info in seconds s`; info may itself hold " in "."""
    body = F.when(F.startswith(line, F.lit(MARK)), F.substr(line, F.lit(len(MARK) + 1)))
    rest, tail = after(body, LAYER_FILE), F.substring_index(after(body, LAYER_FILE), " in ", -1)
    number, info = F.left(tail, F.length(tail) - 1), F.left(rest, F.length(rest) - F.length(tail) - 4)
    numeric = F.endswith(tail, F.lit("s")) & (number != "") & (F.translate(number, "0123456789.", "") == "")
    fits = numeric & (info != "") & (F.instr(body, LAYER_FILE) > 1)
    return {"name": F.when(fits, F.left(body, F.instr(body, LAYER_FILE) + len(LAYER_FILE) - 3)), "info": F.when(fits, info), "seconds": F.when(fits, number)}


def parsed(lines: DataFrame, compat: bool = False, by: list[str] = ()) -> DataFrame:
    """(line_no, line) -> run, line_no, kind, name, info, seconds, text; lines before the first start have no run.

    by names columns that part independent logs, so that runs are counted per log. compat keeps the reading of a stage
    without a feature text whose first digit goes to that text.
    """
    line = F.col("line")
    run = F.sum(F.contains(line, F.lit(START)).cast("int")).over(Window.partitionBy(*by).orderBy("line_no"))
    get = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    plain = {n: get(STAGE, i) for i, n in enumerate(("name", "info", "seconds"), 1)}
    stage, write = told_loosely(line) if compat else plain, told_writing(line)
    kind = (
        F.when(F.contains(line, F.lit(START)), "start").when(F.contains(line, F.lit(END)), "end").when(F.contains(line, F.lit(FAILED)), "failed").when(line.rlike(STAMP), "stamp")
        .when(line.rlike(TOTAL), "total").when(write["name"].isNotNull(), "write").when(stage["name"].isin(STAGES), "stage")
    )
    out = lines.withColumns({"run": run, "kind": kind}).where("run > 0 AND kind IS NOT NULL")
    info = F.regexp_replace(F.trim(stage["info"]), r"[,\s]+$", "")
    pick = lambda c, n: F.when(F.col("kind") == "stage", c).when(F.col("kind") == "write", write[n])
    return out.select(
        *by, "run", "line_no", "kind", pick(stage["name"], "name").alias("name"),
        F.when(F.col("kind") == "stage", F.nullif(info, F.lit(""))).when(F.col("kind") == "write", F.trim(write["info"])).alias("info"),
        F.coalesce(pick(stage["seconds"], "seconds"), F.when(F.col("kind") == "total", get(TOTAL, 1))).try_cast("double").alias("seconds"),
        F.when(F.col("kind") == "stamp", get(STAMP, 1)).alias("text"),
    )


def runs(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per run: stamp, stages, stage seconds, total (of the stages where none is told), failed."""
    last = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("line_no")))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("seconds").cast("decimal(18,3)")))
    return events.groupBy(*by, "run").agg(
        last("stamp", "text").alias("stamp"), F.count_if(F.col("kind") == "stage").alias("stages"), of("stage").cast("double").alias("stage_seconds"),
        of("write").cast("double").alias("write_seconds"), F.coalesce(last("total", "seconds"), of("stage").cast("double")).alias("total"), F.bool_or(F.col("kind") == "failed").alias("failed"),
    )


def comparison(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per run, a column per stage: seconds of its first mention."""
    s = events.where("kind = 'stage'")
    return s.groupBy(*by, "run").pivot("name", STAGES).agg(F.min_by("seconds", "line_no"))
