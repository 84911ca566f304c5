"""The ledger of a long-running job as an append-only table of events, and the files it pairs and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules


def ledger_state(events: DataFrame) -> DataFrame:
    """Latest (ts, seq) row of each path."""
    rest = [c for c in events.columns if c != "path"]
    return events.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("x")).select("path", "x.*")


def ledger_add(state: DataFrame, new: DataFrame, match: DataFrame | None = None) -> DataFrame:
    """New pending rows (path, status, mode) for paths that the ledger doesn't know; .txt: text, matched: align, others
    transcribe, or undecided where a text was asked for and none found."""
    fresh = new.select("path").distinct().join(state.select("path"), "path", "left_anti")
    if match is None:
        mode = F.when(F.lower("path").endswith(".txt"), "text").otherwise("transcribe")
        return fresh.select("path", F.lit("pending").alias("status"), mode.alias("mode"))
    found = fresh.join(match.select("path", "text_path"), "path", "left")
    mode = F.when(F.lower("path").endswith(".txt"), "text").when(F.col("text_path").isNotNull(), "align").otherwise("undecided")
    return found.select("path", F.lit("pending").alias("status"), mode.alias("mode"))


def ledger_transition(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after one change a path (path, to, at, message): in_progress sets started and clears the rest, done and
    failed set finished, failed keeps its message, pending clears all."""
    c = changes.select("path", F.col("to").alias("_to"), F.col("at").alias("_at"), F.col("message").alias("_m"))
    j = state.join(c, "path", "left")
    to = F.col("_to")
    return j.select(
        "path",
        F.coalesce(to, "status").alias("status"),
        F.when(to.isNull(), F.col("started")).when(to == "in_progress", F.col("_at")).when(to == "pending", None).otherwise(F.col("started")).alias("started"),
        F.when(to.isNull(), F.col("finished")).when(to.isin("done", "failed", "skipped"), F.col("_at")).alias("finished"),
        F.when(to.isNull(), F.col("error")).when(to == "failed", F.col("_m")).alias("error"),
    )


def _back_to_pending(state: DataFrame, status: str) -> DataFrame:
    return state.where(F.col("status") == status).select("path", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"))


def ledger_reset_interrupted(state: DataFrame) -> DataFrame:
    """Events that put what was under way back in the queue."""
    return _back_to_pending(state, "in_progress")


def ledger_retry_failed(state: DataFrame) -> DataFrame:
    """Events that queue what failed again."""
    return _back_to_pending(state, "failed")


def ledger_decide_all(state: DataFrame, mode: str) -> DataFrame:
    """Events for all undecided rows: transcribe, or skip."""
    status = "skipped" if mode == "skip" else "pending"
    return state.where("mode = 'undecided'").select("path", F.lit(status).alias("status"), F.lit(mode).alias("mode"))


def ledger_apply_reference_mode(state: DataFrame, match: DataFrame, enabled: bool) -> DataFrame:
    """state with the mode that the switch gives: on, align where a text is found, else undecided; off, transcribe.
    Finished and skipped rows and text sources stay."""
    j = state.join(match.select("path", "text_path"), "path", "left")
    open_ = ~F.col("status").isin("done", "skipped") & (F.col("mode") != "text")
    new = F.when(F.col("text_path").isNotNull(), "align").otherwise("undecided") if enabled else F.when(F.col("mode").isin("align", "undecided"), "transcribe").otherwise(F.col("mode"))
    return j.withColumn("mode", F.when(open_, new).otherwise(F.col("mode"))).drop("text_path")


def ledger_rematch(state: DataFrame, match: DataFrame) -> DataFrame:
    """Undecided rows that have a text by now, as align."""
    return state.where("mode = 'undecided'").join(match.where("text_path IS NOT NULL").select("path", "text_path"), "path").withColumn("mode", F.lit("align"))


def ledger_legacy_modes(state: DataFrame) -> DataFrame:
    """Old mode names read as text."""
    return state.withColumn("mode", F.when(F.col("mode").isin("translate_text", "speak"), "text").otherwise(F.col("mode")))


def ledger_summary(state: DataFrame) -> DataFrame:
    """One row: a count for each status, zeros kept, and the total."""
    return state.agg(*[F.count_if(F.col("status") == s).alias(s) for s in rules.STATUSES], F.count("*").alias("total"))


def ledger_run_report(state: DataFrame, run: DataFrame) -> DataFrame:
    """One row: total, processed, completed, failed, already_done, elapsed seconds of a run's events (path, ts)."""
    touched = run.groupBy("path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    j = state.join(touched, "path", "left")
    seen, done = F.col("first").isNotNull(), F.col("status") == "done"
    return j.agg(F.count("*").alias("total"), F.count_if(seen & F.col("status").isin("done", "failed")).alias("processed"), F.count_if(seen & done).alias("completed"), F.count_if(seen & (F.col("status") == "failed")).alias("failed"), F.count_if(~seen & done).alias("already_done"), (F.max("last").cast("timestamp").cast("double") - F.min("first").cast("timestamp").cast("double")).alias("elapsed"))


def ledger_unfinished(state: DataFrame) -> DataFrame:
    """Rows that are pending or under way."""
    return state.where(F.col("status").isin("pending", "in_progress"))


def next_pending(state: DataFrame, n: int = 1) -> DataFrame:
    """The n pending rows that were added first."""
    return state.where("status = 'pending'").orderBy("ts", "seq", "path").limit(n)


def failure_runs(events: DataFrame, by: str = "path", least: int = rules.FAILURE_RUN) -> DataFrame:
    """by, error, first_seq, failures of stretches of the same error, other events between them not counted."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    failed = events.where("status = 'failed'").withColumn("new", F.when(F.col("error").eqNullSafe(F.lag("error").over(w)), 0).otherwise(1))
    runs = failed.withColumn("run", F.sum("new").over(w)).groupBy(by, "run", "error").agg(F.min("seq").alias("first_seq"), F.count("*").alias("failures"))
    return runs.where(F.col("failures") >= least).select(by, "error", "first_seq", "failures")


def adopt_unfinished(source: DataFrame, target: DataFrame) -> DataFrame:
    """Unfinished rows of one ledger as pending rows for another that doesn't know them."""
    return ledger_unfinished(source).select("path").join(target.select("path"), "path", "left_anti").withColumn("status", F.lit("pending"))


def purgeable_uploads(listing: DataFrame, state: DataFrame) -> DataFrame:
    """One row: files and bytes of uploaded copies that no unfinished entry needs."""
    return listing.join(ledger_unfinished(state).select("path"), "path", "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def scan_catalog(listing: DataFrame, kind: str = "media") -> DataFrame:
    """Rows of a listing (path, ...) with a wanted suffix in any case, none below an _uploads folder."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = ext.isin(rules.MEDIA if kind == "media" else ["txt"])
    return listing.where(wanted & ~F.col("path").rlike(r"(^|/)_uploads/"))


def pair_reference_text(audio: DataFrame, texts: DataFrame, text_dir: str = "/texts") -> DataFrame:
    """path, text_path, how: same folder and name, same folder in another case, then anywhere below the text folder;
    null where none fits. Text sources take no part."""
    a = audio.where(F.lower("ext") != ".txt").select("path", F.col("dir").alias("_dir"), F.col("stem").alias("_stem"), F.lower("stem").alias("k"))
    t = texts.select(F.col("path").alias("text_path"), "dir", "stem", F.lower("stem").alias("k"))
    how = F.when((F.col("dir") == F.col("_dir")) & (F.col("stem") == F.col("_stem")), 1).when(F.col("dir") == F.col("_dir"), 2).when((F.col("dir") == text_dir) | F.startswith("dir", F.lit(text_dir + "/")), 3)
    met = a.join(t, "k").withColumn("how", how).where("how IS NOT NULL").groupBy("path").agg(F.min(F.struct("how", "text_path")).alias("x"))
    return a.select("path").join(met, "path", "left").select("path", "x.text_path", "x.how")


def plan_output_paths(files: DataFrame, formats: list[str], lang: str | None = None, spoken: bool = False) -> DataFrame:
    """path, format, target, clashes: targets mirror the source folder; clashes counts the sources that share one."""
    f = files.select("path", "dir", "stem", F.explode(F.array(*[F.lit(x) for x in formats])).alias("format"))
    middle = ("." + lang if lang else "") + (".spoken" if spoken else "")
    stem = F.when(F.lower("stem").isin("state", "settings"), F.concat("stem", F.lit(".transcript"))).otherwise(F.col("stem"))
    target = F.concat(F.regexp_replace("dir", "^/src", "/out"), F.lit("/"), stem, F.lit(middle + "."), "format")
    return f.withColumn("target", target).withColumn("clashes", F.count("*").over(Window.partitionBy("target"))).select("path", "format", "target", "clashes")


def stage_plan(files: DataFrame, targets: list[str], translate: bool, speak: bool) -> DataFrame:
    """path, stage, lang: what each entry goes through; a text source with nothing to do gives stage error."""
    is_text = F.lower("ext") == ".txt"
    none = F.lit(None).cast("string")
    step = lambda name, lang=none: F.struct(F.lit(name).alias("stage"), lang.alias("lang"))
    stages = [F.when(~is_text, step("transcribe"))]
    stages += [step("translate", F.lit(t)) for t in targets if translate]
    stages += [step("speak", F.lit(t)) for t in (targets if translate else [""]) if speak]
    if not translate and not speak:
        stages.append(F.when(is_text, step("error")))
    return files.select("path", F.explode(F.filter(F.array(*stages), lambda x: x.isNotNull())).alias("x")).select("path", "x.stage", F.nullif("x.lang", F.lit("")).alias("lang"))


def ledger_snapshot(state: DataFrame, reference_dir: str | None = None) -> DataFrame:
    """All rows, with searched: where a text was looked for, for rows that are undecided (beside the file, then in the text
    folder); null for the others."""
    beside = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folders = F.array(beside, F.lit(reference_dir)) if reference_dir else F.array(beside)
    return state.withColumn("searched", F.when(F.col("mode") == "undecided", folders))


def write_snapshot(snapshot: DataFrame, dest: str, version: int) -> None:
    """A version of the ledger below `dest`; one that is there is never written over."""
    snapshot.write.mode("errorifexists").parquet(f"{dest}/version={version:010d}")


def read_snapshot(spark: SparkSession, dest: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one)."""
    every = spark.read.option("basePath", dest).parquet(dest)
    last = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == last).drop("version")


def ledger_quarantine(raw: DataFrame, schema: str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of JSON texts: what fits the schema and names a path, and the texts that don't, as they are, with the
    other columns of `raw`. A broken text stops nothing."""
    parsed = raw.withColumn("_d", F.from_json(col, f"{schema}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("_d").isNull() | F.col("_d._broken").isNotNull() | F.col("_d.path").isNull()
    rest = [c for c in raw.columns if c != col]
    return parsed.where(~bad).select(*rest, "_d.*").drop("_broken"), parsed.where(bad).select(*rest, col)
