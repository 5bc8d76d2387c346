"""From process outcomes and replays to one explicit status a scanner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.methods import whole_finding

#: Status and reason of each outcome of a process; an exit with code 0 is none of them.
OUTCOMES = {
    "exited": ("error", "scanner failed; output suppressed"),
    "timed-out": ("timeout", None),
    "stdout-overflow": ("malformed", "scanner stdout exceeded max_stdout_bytes; output discarded"),
    "not-found": ("unavailable", "scanner executable not found"),
    "spawn-failed": ("error", "scanner process could not be started"),
    "cancelled": ("error", "run cancelled before the scanner finished"),
}


def process_status(runs: DataFrame) -> DataFrame:
    """runs (scanner, replay, outcome, code) with status and reason: both null for a process that ended well."""
    well = (F.col("outcome") == "exited") & F.coalesce(F.col("code") == 0, F.lit(False))

    def pick(k: int):
        out = F.lit(None).cast("string")
        for name, values in OUTCOMES.items():
            out = F.when(F.col("outcome") == name, F.lit(values[k])).otherwise(out)
        return F.when(~well, out)

    return runs.withColumns({"status": pick(0), "reason": pick(1)})


def collate_replays(runs: DataFrame, findings: DataFrame, unmeasured: DataFrame, replays: int) -> tuple[DataFrame, DataFrame]:
    """(observations, divergent): each scanner's status over its replays, and the cases on which they disagree.

    ``runs`` as ``process_status`` returns them; findings and unmeasured
    (scanner, case_id, reason) have the replay. The lowest replay that failed
    decides; fewer replays than asked for are an error; replays that differ in
    whole findings, their number, or in what they couldn't map, are unstable.
    The findings of a complete scanner are those of replay 0.
    """
    asked = F.lit(replays)
    failed = runs.where("status is not null").groupBy("scanner").agg(F.min(F.struct("replay", "status", "reason")).alias("failure"))
    ran = runs.groupBy("scanner").agg(F.count("*").alias("ran"))
    whole = whole_finding(findings)
    seen = findings.groupBy(*whole, "replay").agg(F.count("*").alias("n")).groupBy(*whole).agg(F.count("*").alias("seen"), F.min("n").alias("least"), F.max("n").alias("most"))
    differ = seen.where((F.col("seen") < asked) | (F.col("least") < F.col("most"))).select("scanner", "case_id")
    gaps = unmeasured.select("scanner", "case_id", "reason", "replay").distinct().groupBy("scanner", "case_id", "reason").agg(F.count("*").alias("seen")).where(F.col("seen") < asked)
    divergent = differ.unionByName(gaps.select("scanner", "case_id")).distinct()
    unstable = divergent.groupBy("scanner").agg(F.count("*").alias("divergent_cases"))
    rows = ran.join(failed, "scanner", "left").join(unstable, "scanner", "left")
    short = F.col("ran") < asked
    status = F.when(F.col("failure").isNotNull(), F.col("failure.status")).when(short, "error").when(F.col("divergent_cases") > 0, "unstable").otherwise("complete")
    reason = F.when(F.col("failure").isNotNull(), F.col("failure.reason")).when(short, "scanner replays did not all run")
    shown = F.when(F.col("failure").isNull() & ~short, F.coalesce("divergent_cases", F.lit(0)))
    observations = rows.select("scanner", status.alias("status"), reason.alias("reason"), shown.alias("divergent_cases"))
    return observations, divergent.join(observations.where("status = 'unstable'").select("scanner"), "scanner", "left_semi")
