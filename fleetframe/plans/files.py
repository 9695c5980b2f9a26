"""Files that jobs leave behind, written from the tables and read back.

The suppliers stand for jobs, one per supplier; the names hold blanks, percent and plus signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import status as S
from fleetframe.operators import entries, ledger, sections
from fleetframe.plans import status, table, text
from fleetframe.session import work_dir
from fleetframe.sources import manifest, markers, sinks

NAMES = ("plain", "two words", "a%b%41", "x+y_z")
EXITS = ("0", "1", None, " 7 ", "abc")


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


def _jobs(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("cluster_id"), F.col("s_nationkey").alias("proc_id"), _pick(NAMES, key).alias("name")
    )


def _files(rows: DataFrame, file: Column, line: Column, label: str) -> str:
    folder = work_dir(rows.sparkSession, label)
    sinks.write_files(rows.select(file.alias("file"), F.lit(0).alias("no"), line.alias("line")), folder)
    return folder


def exit_records(spark, sf):
    """Every job leaves a log; every seventh no exit record; some records are empty or unreadable."""
    jobs = _jobs(spark, sf)
    kinds = F.array(F.lit("log"), F.when(F.col("cluster_id") % 7 != 0, F.lit("exitcode")))
    left = jobs.withColumn("kind", F.explode(F.array_compact(kinds)))
    name = F.concat_ws("_", "kind", "name", "cluster_id", "proc_id")
    line = F.when(F.col("kind") == "exitcode", _pick(EXITS, F.col("cluster_id")))
    folder = _files(left, F.concat(name, F.lit(".txt")), line, "markers")
    queue = status.queue(spark, sf).filter("false")
    found = ledger.job_status(jobs, queue, markers.read_markers(spark, folder))
    return found.select("cluster_id", "proc_id", "name", "exitcode", "bad_record", "success", "failed")


def manifest_files(spark, sf):
    """A manifest per job, every tenth not JSON, and the latest one of the folder."""
    jobs = _jobs(spark, sf)
    doc = F.format_string(
        '{"submission_timestamp": "20%06d_000000", "submitted": [[{}, "%d", 1, [0]]]}',
        F.col("cluster_id").cast("int"), F.col("cluster_id"),
    )
    line = F.when(F.col("cluster_id") % 10 == 0, F.lit('{"submitted": [')).otherwise(doc)
    file = F.when(F.col("cluster_id") == 1, F.lit(manifest.LATEST)).otherwise(
        F.format_string("submission %d.json", F.col("cluster_id"))
    )
    folder = _files(jobs, file, line, "manifests")
    both = (
        manifest.read_manifests(spark, f"{folder}/*.json").withColumn("latest", F.lit(False))
        .unionByName(manifest.read_manifests(spark, folder).withColumn("latest", F.lit(True)))
    )
    return manifest.parse_manifests(both).select(
        F.substring_index("file", "/", -1).alias("file"), "latest", "bad_document",
        "submission_timestamp", F.size("submitted").alias("n_entries"),
    )


def scope_files(spark, sf):
    jobs = _jobs(spark, sf)
    doc = F.format_string('{"name": "%s", "pips": [["p%d", null]]}', "name", F.col("cluster_id"))
    file = F.format_string("scope %d.json", F.col("cluster_id"))
    scopes = manifest.parse_scopes(manifest.read_scopes(spark, f"{_files(jobs, file, doc, 'scopes')}/*.json"))
    return manifest.scope_requirements(
        scopes.withColumn("name", manifest.scope_value(F.col("scope"), "$.name")), ["name"]
    ).select("name", "package", F.col("mode").isNull().alias("no_mode"))


def data_files(spark, sf):
    """Data files as parameters; empty ones count."""
    jobs = _jobs(spark, sf)
    file = F.concat(F.col("name"), F.col("cluster_id"), _pick((".root", ".txt", ".dat"), F.col("cluster_id")))
    folder = _files(jobs, file, F.when(F.col("cluster_id") % 2 == 0, F.lit("x")), "data")
    found = markers.file_params(spark, folder, ["*.root", "a%b*[0-4].txt"])
    return found.select(F.substring_index("file", "/", -1).alias("file"))


def flags(spark, sf):
    """The flag array and the tests on it."""
    jobs = status.jobs(spark, sf)
    return jobs.select(
        "cluster_id", "proc_id", S.flag_names(F.col("flags")).alias("flag_names"),
        F.size("flags").alias("n_flags"), S.is_running(F.col("flags"), F.col("status")).alias("running"),
        S.is_failed(F.col("flags"), F.col("status")).alias("failed"), S.is_success(F.col("flags")).alias("success"),
    )


def summary_line(spark, sf):
    return ledger.summary_line(ledger.summary(status.jobs(spark, sf)))


def queue_of_job(spark, sf):
    """The first job of every cluster, and all jobs of one cluster; the first job's id is 0."""
    queue = status.queue(spark, sf).withColumn("proc_id", F.col("proc_id") - 1)
    first, of_cluster = ledger.select_queue(queue, proc_id=0), ledger.select_queue(queue, cluster_id=7)
    return ledger.union_queues(first, of_cluster).select("cluster_id", "proc_id", "status", "user")


def section_errors(spark, sf):
    """Files whose markers do not nest, with the line of the first error."""
    marked = sections.mark_sections(text._lines(spark, sf), ["doc_id"], open_marker="An", close_marker="Th")
    return sections.section_report(marked, ["doc_id"]).select("doc_id", "n_outside", "n_inside", "first_error")


def lines_outside(spark, sf):
    return sections.section_lines(text._marked(spark, sf), inside=False)


def written_chunks(spark, sf):
    """Entries cut into chunks, written a folder per chunk, and counted back."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("file"), "event_id")
    files = events.groupBy("file").agg(F.count(F.lit(1)).alias("n_entries"))
    chunks = entries.entry_chunks(files.withColumn("file_no", F.ascii("file")), n_chunks=7)
    cut = entries.cut_entries(entries.number_entries(events, "event_id"), chunks)
    path = work_dir(spark, "chunks")
    sinks.write_chunks(cut, path)
    return spark.read.parquet(path).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("sum_id")
    )


_EXIT = """
with j as (
  select s_suppkey as cluster_id, s_nationkey as proc_id,
         ['plain', 'two words', 'a%b%41', 'x+y_z'][s_suppkey % 4 + 1] as name
  from supplier)
"""

QUERIES = {
    "q_exit_records": (
        exit_records,
        _EXIT
        + """, x as (
          select *, case when cluster_id % 7 = 0 then null
                    else [0, 1, null, 7, null][cluster_id % 5 + 1] end as exitcode
          from j)
        select cluster_id, proc_id, name, cast(exitcode as int) as exitcode,
               cluster_id % 7 <> 0 and exitcode is null as bad_record,
               coalesce(exitcode = 0, false) as success, not coalesce(exitcode = 0, false) as failed
        from x""",
    ),
    "q_manifest_files": (
        manifest_files,
        """with m as (
             select case when s_suppkey = 1 then 'submission_latest.json'
                      else 'submission ' || s_suppkey || '.json' end as file,
                    s_suppkey % 10 = 0 as bad_document, s_suppkey
             from supplier
           ), d as (
             select file, latest, bad_document,
                    case when not bad_document then '20' || lpad(cast(s_suppkey as varchar), 6, '0') || '_000000' end
                      as submission_timestamp,
                    case when not bad_document then 1 end as n_entries
             from m, (values (false), (true)) as l(latest) where not latest or s_suppkey = 1)
           select * from d""",
    ),
    "q_scope_files": (
        scope_files,
        _EXIT + "select name, 'p' || cluster_id as package, true as no_mode from j",
    ),
    "q_data_files": (
        data_files,
        _EXIT
        + """, f as (
          select name || cluster_id || ['.root', '.txt', '.dat'][cluster_id % 3 + 1] as file from j)
        select file from f
        where ends_with(file, '.root') or regexp_full_match(file, 'a%b.*[0-4][.]txt')""",
    ),
    "q_flags": (
        flags,
        status._JOBS
        + """select cluster_id, proc_id, flag_names, cast(len(string_split(flag_names, ',')) as int) as n_flags,
                    running, failed, success from job""",
    ),
    "q_summary_line": (
        summary_line,
        status._JOBS
        + ", s as (select"
        + status._COUNTS
        + """from job)
        select printf('total: %d, good: %d (%.1f%%), failed: %d (%.1f%%), running: %d (%.1f%%)',
                      total, good, good_pct, failed, failed_pct, running, running_pct) as line
        from s""",
    ),
    "q_queue_of_job": (
        queue_of_job,
        """with q as (
             select l_orderkey as cluster_id, l_linenumber - 1 as proc_id,
                    cast(floor(l_quantity / 8) as int) as status, l_returnflag as "user"
             from lineitem where l_linestatus = 'O')
           select * from q where proc_id = 0 union all select * from q where cluster_id = 7""",
    ),
    "q_section_errors": (
        section_errors,
        text._LINES
        + """, t as (
          select *, coalesce(sum(step) over (partition by doc_id order by line_no
                      rows between unbounded preceding and 1 preceding), 0) as depth
          from (select *, case when starts_with(line, 'An') then 1
                            when starts_with(line, 'Th') then -1 else 0 end as step from l))
        select doc_id, count(*) filter (step = 0 and depth <> 1) as n_outside,
               count(*) filter (step = 0 and depth = 1) as n_inside,
               min(case when (step = 1 and depth <> 0) or (step = -1 and depth <> 1) then line_no end)
                 as first_error
        from t group by doc_id""",
    ),
    "q_lines_outside": (
        lines_outside,
        text._MARKED + "select doc_id, cast(line_no as int) as line_no, line from m where kind = 'outside'",
    ),
    "q_written_chunks": (
        written_chunks,
        """with e as (
             select event_id, row_number() over (order by ascii(event_type), event_id) - 1 as p from events
           ), l as (select count(*) / 7.0::double as f from events),
           k as (select chunk, chunk * f as low, (chunk + 1) * f as high from l, unnest(range(7)) as u(chunk))
           select cast(chunk as int) as chunk, count(*) as n_rows, cast(sum(event_id) as bigint) as sum_id
           from e join k on p >= low and p < high group by chunk""",
    ),
}
