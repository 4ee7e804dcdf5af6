"""Uploads, jobs, reports and their files, as queries over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
#: Files that an upload may have, by type.
MOST_FILES = (("multi", 20), ("single", 1), ("video", 1))
#: Folders whose first image stands for a job, best first.
THUMBNAILS = ("rack", "switch", "patch_panel", "cables", "cable", "connected_port", "empty_port", "units")
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
#: Where a finished job's merged report lies.
MERGED = "Results/Merged_Result.pdf"
#: Folders in which a job's input pictures are looked for, in this order.
PROBED = ("input", "images", "input/images", "output/rack", "output")
#: Those that a report shows.
PICTURED = ("jpg", "jpeg", "png", "webp")
# -------------------------------------------------------------------------------------------------


def validate_uploads(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """upload_id, n_files and ok: all files' (mime, ext) allowed for the type and not too many. files: upload_id, upload_type, file_name, mime; allowed: upload_type, mime, ext."""
    f = files.withColumn("ext", F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1)))
    most = F.coalesce(*(F.when(F.col("upload_type") == t, F.lit(n)) for t, n in MOST_FILES))
    hit = f.join(F.broadcast(allowed.select("upload_type", "mime", "ext").distinct().withColumn("_ok", F.lit(1))), ["upload_type", "mime", "ext"], "left")
    per = hit.groupBy("upload_id", "upload_type").agg(F.count("*").alias("n_files"), F.min(F.coalesce("_ok", F.lit(0))).alias("all_ok"))
    return per.select("upload_id", "upload_type", "n_files", ((F.col("all_ok") == 1) & F.coalesce(F.col("n_files") <= most, F.lit(False))).alias("ok"))


def owned(rows: DataFrame, user: str | None) -> DataFrame:
    """Rows of the user; all if no user is asked for."""
    return rows if user is None else rows.filter(F.col("user_id") == user)


def job_with_logs(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Each job with its messages in order; none is an empty array."""
    l = logs.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "message"))), lambda x: x["message"]).alias("messages"))
    return jobs.join(l, "job_id", "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def latest_job(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Of each user the newest job by creation; without one, by the newest file of a job folder. jobs: job_id, user_id, created_at; files: user_id, job_id, mtime."""
    both = jobs.select("user_id", "job_id", F.lit(0).alias("prio"), F.col("created_at").alias("at")).unionByName(files.groupBy("user_id", "job_id").agg(F.max("mtime").alias("at")).select("user_id", "job_id", F.lit(1).alias("prio"), "at"))
    best = both.groupBy("user_id").agg(F.min_by(F.struct("job_id", "at", "prio"), F.struct("prio", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("t"), "job_id")).alias("x"))
    return best.select("user_id", "x.job_id", "x.at", F.when(F.col("x.prio") == 0, "table").otherwise("files").alias("found_in"))


def current_job(sessions: DataFrame, jobs: DataFrame, folders: DataFrame) -> DataFrame:
    """user_id, job_id, found_in: the session's job if the table has it, whoever owns it; else the user's newest job; else the newest job_
    folder of all, if it has an output; else null. Of equal times the last by name.
    sessions: user_id, job_id; jobs: job_id, user_id, created_at; folders: name, mtime, has_output."""
    known = jobs.select(F.col("job_id").alias("_s")).distinct()
    newest = jobs.groupBy("user_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("_t"))
    last = folders.filter(F.col("name").startswith("job_")).agg(F.max_by(F.when(F.col("has_output"), F.col("name")), F.struct("mtime", "name")).alias("_f"))
    out = sessions.select("user_id", "job_id").join(known, F.col("job_id") == F.col("_s"), "left").join(newest, "user_id", "left").withColumn("_f", last.scalar())
    found = F.when(F.col("_s").isNotNull(), "session").when(F.col("_t").isNotNull(), "table").when(F.col("_f").isNotNull(), "folder")
    return out.select("user_id", F.coalesce("_s", "_t", "_f").alias("job_id"), found.alias("found_in"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def output_inventory(files: DataFrame) -> DataFrame:
    """job_id, relative path, name and ext of all files below a job's folder. files: path with /<job_id>/ in it."""
    rel = F.regexp_extract("path", r"/(job_[^/]+)/(.+)$", 2)
    return files.select(F.regexp_extract("path", r"/(job_[^/]+)/", 1).alias("job_id"), rel.alias("relative"), F.regexp_extract(rel, r"([^/]+)$", 1).alias("name"), extension(F.col("path")).alias("ext")).filter("job_id <> ''")


def first_image(inventory: DataFrame, folders: Sequence[str] = THUMBNAILS) -> DataFrame:
    """Of each job the first image directly below one of the folders of its output, by folder precedence, then by path."""
    top = F.regexp_extract("relative", r"^(?:output/)?([^/]+)/[^/]+$", 1)
    prio = F.coalesce(*(F.when(top == f, F.lit(k)) for k, f in enumerate(folders)))
    return inventory.filter(F.col("ext").isin(*PICTURED)).withColumn("prio", prio).filter("prio is not null").groupBy("job_id").agg(F.min_by("relative", F.struct("prio", "relative")).alias("image"))


def input_images(inventory: DataFrame, folders: Sequence[str] = PROBED) -> DataFrame:
    """job_id, folder and relative of each job's input pictures: those directly in the first of the folders that holds one, else all of its tree. folder is where
    the first one by path lies. Extensions count in any letter case; a job without pictures has no rows. inventory: of output_inventory(), over whole job folders."""
    where = F.regexp_extract("relative", "^(.*)/[^/]*$", 1)
    prio = F.coalesce(*(F.when(where == f, F.lit(k)) for k, f in enumerate(folders)), F.lit(len(folders)))
    own = inventory.filter(F.col("ext").isin(*IMAGES)).select("job_id", "relative", where.alias("_in"), prio.alias("_prio"))
    first = own.groupBy("job_id").agg(F.min("_prio").alias("_prio"), F.min_by("_in", F.struct("_prio", "relative")).alias("folder"))
    # without such a folder every picture has the last rank
    return own.join(first, ["job_id", "_prio"]).select("job_id", "folder", "relative")


def job_history(jobs: DataFrame, inventory: DataFrame, user: str | None = None) -> DataFrame:
    """Done jobs that have the merged report, newest first, with their first image."""
    done = owned(jobs, user).filter(F.col("status") == "done").join(inventory.filter(F.col("relative").isin(MERGED, f"output/{MERGED}")).select("job_id"), "job_id", "left_semi")
    return done.join(first_image(inventory), "job_id", "left").orderBy(F.desc("created_at"), "job_id")


def gallery(inventory: DataFrame, folder: str, aliases: DataFrame) -> DataFrame:
    """Images of a segment class: units/<unit>/<class>/ with labels, or folders that are an alias of it. aliases: folder, alias."""
    a = F.broadcast(aliases.filter(F.col("folder") == folder).select("alias"))
    parts = F.split("relative", "/")
    rows = inventory.filter(F.col("ext").isin(*IMAGES)).withColumns({"unit": F.when(F.get(parts, F.lit(0)) == "units", F.get(parts, F.lit(1))), "alias": F.lower(F.get(parts, F.size(parts) - 2))})
    return rows.join(a, "alias", "left_semi").select("job_id", "relative", F.concat_ws(" - ", "unit", "name").alias("label"))


def resolve_folder(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted id with its folder: equal, job_ and the id, or a prefix with or without job_; of equals the last by name. folders: name; wanted: job_id."""
    keys = wanted.select("job_id").distinct()
    exact = keys.join(folders, F.col("job_id") == F.col("name")).select("job_id", "name", F.lit(0).alias("prio"))
    named = keys.join(folders, F.concat(F.lit("job_"), F.col("job_id")) == F.col("name")).select("job_id", "name", F.lit(1).alias("prio"))
    # a prefix is an equality on the first eight characters, or all of a shorter id, and a check of the rest
    rest = F.explode(F.when(F.col("name").startswith("job_"), F.array("name", F.substr("name", F.lit(5)))).otherwise(F.array("name")))
    rests = folders.select("name", rest.alias("_r")).filter("_r <> ''")
    heads = rests.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length("_r"), F.lit(8))))).withColumn("_h", F.substr("_r", F.lit(1), F.col("_n")))
    prefix = keys.join(heads, F.substring("job_id", 1, 8) == F.col("_h")).filter(F.col("_r").startswith(F.col("job_id"))).select("job_id", "name", F.lit(2).alias("prio"))
    every = exact.unionByName(named).unionByName(prefix)
    w = Window.partitionBy("job_id").orderBy("prio", F.desc("name"))
    return every.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "prio")


def delete_reports(reports: DataFrame, report_id: str, user: str) -> DataFrame:
    """The reports without the given one of this user."""
    return reports.filter(~((F.col("id") == report_id) & (F.col("user_id") == user)))


def allowed_path(path: Column, roots: Sequence[str]) -> Column:
    """Below one of the roots, without parent steps."""
    ok = F.lit(False)
    for r in roots:
        ok = ok | path.startswith(r.rstrip("/") + "/")
    return ok & ~path.rlike(r"(^|/)\.\.(/|$)")
