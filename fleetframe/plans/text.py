"""Text: documents, pages, and lines composed from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import settings
from fleetframe.functions import text as X
from fleetframe.operators import sections
from fleetframe.plans import table
from fleetframe.sources import manifest, markers, text

LINK = 'href="/.*?"'


def strip_comments(spark, sf):
    documents = table(spark, sf, "documents")
    return documents.select("doc_id", X.strip_comments(F.col("text")).alias("text"))


def extract_paths(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(X.find_paths(F.col("html"), LINK)).alias("pos", "path"))


def count_paths(spark, sf):
    """Paths per dataset: the host of a page, cut at its first dot."""
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return (
        pages.groupBy(
            X.dataset_scenario(host).alias("scenario"), X.dataset_name(host).alias("dataset")
        )
        .agg(F.sum(F.size(X.find_paths(F.col("html"), LINK))).alias("n_paths"))
    )


def _lines(spark, sf) -> DataFrame:
    documents = table(spark, sf, "documents")
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _marked(spark, sf) -> DataFrame:
    """Lines 2, 9, 16, ... open a section and lines 5, 12, 19, ... close it."""
    place = F.col("line_no") % 7
    marker = (
        F.when(place == 2, F.lit(sections.OPEN_MARKER))
        .when(place == 5, F.lit(sections.CLOSE_MARKER))
        .otherwise(F.lit(""))
    )
    lines = _lines(spark, sf).withColumn("line", F.concat(marker, "line"))
    return sections.mark_sections(lines, ["doc_id"])


def section_lines(spark, sf):
    return sections.section_lines(_marked(spark, sf), inside=True)


def sections_marked(spark, sf):
    """Markers where the texts happen to start a line with them, so errors occur."""
    marked = sections.mark_sections(
        _lines(spark, sf), ["doc_id"], open_marker="An", close_marker="Th"
    )
    return marked.select("doc_id", "line_no", "depth", "kind")


def section_report(spark, sf):
    return sections.section_report(_marked(spark, sf), ["doc_id"])


def submit_output(spark, sf):
    lines = table(spark, sf, "lineitem")
    said = F.concat(
        F.lit("Submitting job(s)..\n"),
        "l_linenumber",
        F.lit(" job(s) submitted to cluster "),
        "l_partkey",
        F.lit(".\n"),
        "l_suppkey",
        F.lit(" job(s) submitted to cluster "),
        "l_orderkey",
    )
    pairs = F.explode(X.submitted_pairs(said)).alias("_p")
    return lines.select("l_orderkey", pairs).select("l_orderkey", "_p.*")


def addresses(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(X.addresses(F.col("url"))).alias("pos", "address"))


def log_fields(spark, sf):
    """Events as log lines: errors in the short format, the others in the full one."""
    e = table(spark, sf, "events")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    full = F.concat(
        F.lit("\x1b[33m[fleet|"),
        F.lpad(F.upper("event_type"), 8, " "),
        F.lit("|"),
        time,
        F.lit("|user"),
        "user_id",
        F.lit("]:\x1b[0m "),
        "props",
    )
    short = F.concat(F.lit("\x1b[31m["), time, F.lit("]:\x1b[0m "), "props")
    line = F.when(F.col("event_type") == "error", short).otherwise(full)
    rows = e.select("event_id", X.log_fields(line).alias("_f"))
    return rows.select(
        "event_id", "_f.logger", "_f.level", "_f.module", "_f.message",
        F.date_format("_f.logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
    )


def queue_text(spark, sf):
    """Line items as lines of a queue listing, with a header and a blank line per first item."""
    lines = table(spark, sf, "lineitem")
    letter = F.get(F.array(*[F.lit(c) for c in "UIRXCHE?"]), F.col("l_linenumber") - 1)
    job = F.concat(
        F.lit("  "), "l_orderkey", F.lit("."), "l_linenumber", F.lit("   user"), "l_suppkey",
        F.lit("  6/17 10:00   0+00:00:01 "), letter, F.lit("  0   0.1 \trun_"), "l_partkey",
        F.lit(".sh "),
    )
    head = F.when(
        F.col("l_linenumber") == 1,
        F.array(F.lit(" ID  OWNER  SUBMITTED  RUN_TIME ST PRI SIZE CMD"), F.lit("   ")),
    ).otherwise(F.array().cast("array<string>"))
    listing = lines.select(F.explode(F.concat(head, F.array(job))).alias("value"))
    return text.parse_queue(listing).select("cluster_id", "proc_id", "status", "user", "sh_base")


def env(spark, sf):
    """Per customer a dump with blank, cut, repeated and continued lines."""
    c = table(spark, sf, "customer")
    dump = F.array(
        F.concat(F.lit("NAME="), "c_name"),
        F.lit("   "),
        F.concat(F.lit(" SEGMENT=a=b="), "c_mktsegment", F.lit("  ")),
        F.lit("a line of a longer value"),
        F.concat(F.lit("NAME=key"), "c_custkey"),
        F.lit("EMPTY="),
    )
    lines = c.select("c_custkey", F.posexplode(dump).alias("line_no", "line"))
    return text.parse_env(lines, ["c_custkey"])


def merge_settings(spark, sf):
    c = table(spark, sf, "customer")
    files = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("a.txt,"), "c_name"))
    left = F.map_filter(
        F.create_map(F.lit("user"), F.col("c_name"), F.lit("hold"), F.lit("true"),
                     F.lit(settings.FILES_KEY), files),
        lambda _, v: v.isNotNull(),
    )
    more = F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_mktsegment"))
    right = F.map_filter(
        F.create_map(F.lit("hold"), F.lit("false"), F.lit(settings.FILES_KEY), more),
        lambda _, v: v.isNotNull(),
    )
    merged = settings.map_text(settings.merge_settings(left, right))
    return c.select("c_custkey", merged.alias("settings"))


def _json_of_orders(spark, sf) -> DataFrame:
    """One manifest per order with two entries; the second has its cluster id as text."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")

    def entry(name, cluster, n):
        ids = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")), ", ")
        return F.concat(
            F.lit('[{"log": "x.log", "priority": '), F.substring("o_orderpriority", 1, 1),
            F.lit(', "environment": {"FLEETCLUSTERNAME": "'), name, F.lit('", "FLEETICLUSTER": "'),
            key, F.lit('"}}, '), cluster, F.lit(", "), n.cast("string"), F.lit(", ["), ids,
            F.lit("]]"),
        )

    n = F.substring("o_orderpriority", 1, 1).cast("int")
    doc = F.concat(
        F.lit('{"submission_timestamp": "'), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"),
        F.lit('", "njobsmax": null, "cli": true, "submitted": ['),
        entry(F.concat(F.lit("a_"), key), key, n), F.lit(", "),
        entry(F.concat(F.lit("b_"), key), F.concat(F.lit('"'), key, F.lit('"')), F.lit(2)),
        F.lit("]}"),
    )
    return o.select("o_orderkey", doc.alias("text"))


def manifest_entries(spark, sf):
    entries = manifest.manifest_entries(manifest.parse_manifests(_json_of_orders(spark, sf)))
    return entries.select(
        "o_orderkey",
        "submission_timestamp",
        "cli",
        "entry_no",
        settings.map_text(F.col("settings")).alias("settings"),
        "cluster_id",
        "njobs",
        F.array_join(F.transform("proc_ids", lambda p: p.cast("string")), ",").alias("proc_ids"),
        "name",
        "i_cluster",
    )


def scope(spark, sf):
    p = table(spark, sf, "part")
    doc = F.concat(
        F.lit('{"size": '), "p_size", F.lit(', "nested": {"brand": "'), "p_brand",
        F.lit('", "none": null}, "words": ["'), F.regexp_replace("p_name", " ", '", "'),
        F.lit('"], "pips": [["'), F.substring_index("p_name", " ", 1), F.lit('", "auto"]],'),
        F.lit(' "transfer_files": {"in": "/data/'), "p_partkey", F.lit('"}}'),
    )
    scopes = manifest.parse_scopes(p.select("p_partkey", doc.alias("text")))
    value = F.col("scope")
    return scopes.select(
        "p_partkey",
        manifest.scope_value(value, "$.size", "int").alias("size"),
        manifest.scope_value(value, "$.nested.brand").alias("brand"),
        manifest.scope_value(value, "$.nested.none").alias("none"),
        manifest.scope_value(value, "$.words[1]").alias("second_word"),
        manifest.scope_value(value, "$.pips[0][0]").alias("package"),
        manifest.scope_value(value, "$.transfer_files.in").alias("input"),
    )


def scope_tables(spark, sf):
    """Requirements and files carried by the scopes, one row each."""
    p = table(spark, sf, "part")
    doc = F.concat(
        F.lit('{"pips": [["'), F.substring_index("p_name", " ", 1), F.lit('", "auto"], ["'),
        F.substring_index("p_name", " ", -1), F.lit('", "editable"]], "transfer_files": {"in": "/d/'),
        "p_partkey", F.lit('"}}'),
    )
    scopes = manifest.parse_scopes(p.select("p_partkey", doc.alias("text")))
    pips = manifest.scope_requirements(scopes, ["p_partkey"]).select(
        "p_partkey", F.col("package").alias("key"), F.col("mode").alias("value")
    )
    files = manifest.scope_files(scopes, ["p_partkey"]).select(
        "p_partkey", "key", F.col("path").alias("value")
    )
    return pips.unionByName(files)


def marker_names(spark, sf):
    """Line items as marker files, with names of several words and files of other kinds."""
    lines = table(spark, sf, "lineitem")
    kind = F.get(F.array(*[F.lit(k) for k in ("out", "err", "log", "exitcode", "note")]),
                 F.col("l_linenumber") - 1)
    path = F.concat(
        F.lit("/run/a_b/"), F.coalesce(kind, F.lit("x")), F.lit("_job_"), "l_returnflag", F.lit("_"),
        "l_orderkey", F.lit("_"), "l_linenumber", F.lit(".txt"),
    )
    listing = lines.select(path.alias("path"))
    return markers.parse_marker_names(listing).select("kind", "name", "cluster_id", "proc_id")


def local_files(spark, sf):
    """Files to transfer: those without a protocol, session files first."""
    o = table(spark, sf, "orders")
    path = F.concat(
        F.when(F.col("o_orderstatus") == "O", F.lit("root://host//store/")).otherwise(F.lit("/data/")),
        "o_orderkey",
    )
    rows = o.select("o_orderkey", path.alias("path")).filter(X.is_local_path(F.col("path")))
    files = settings.concat_files(F.lit("session.tar"), F.col("path"))
    return rows.select("o_orderkey", files.alias("transfer_input_files"))


_LINES = """
with d as (select doc_id, string_split(text, chr(10)) as parts from documents),
l as (
  select doc_id, unnest(range(len(parts))) as line_no, unnest(parts) as line from d
)
"""

_MARKED = (
    _LINES
    + """, t as (
  select *, sum(step) over (partition by doc_id order by line_no
              rows between unbounded preceding and 1 preceding) as before
  from (select *, case line_no % 7 when 2 then 1 when 5 then -1 else 0 end as step from l)
), m as (
  select *, case when step = 1 then 'open' when step = -1 then 'close'
              when coalesce(before, 0) = 1 then 'inside' else 'outside' end as kind
  from t
)
"""
)

QUERIES = {
    "q_strip_comments": (
        strip_comments,
        """select doc_id, array_to_string(list_filter(list_transform(
                    string_split(text, chr(10)),
                    lambda x: trim(split_part(x, '#', 1), ' ' || chr(9) || chr(12) || chr(13)
                                   || chr(11) || chr(160))),
                  lambda x: x <> ''), chr(10)) as text
           from documents""",
    ),
    "q_extract_paths": (
        extract_paths,
        """with p as (select page_id, regexp_extract_all(html, 'href="/.*?"') as found from pages)
           select page_id, cast(unnest(range(len(found))) as int) as pos, unnest(found) as path
           from p""",
    ),
    "q_count_paths": (
        count_paths,
        """with p as (
             select regexp_extract(url, '://([^/]*)', 1) as host,
                    len(regexp_extract_all(html, 'href="/.*?"')) as n
             from pages)
           select split_part(host, '.', 1) as scenario,
                  case when host like '%.%' then host[strpos(host, '.') + 1:] end as dataset,
                  cast(sum(n) as bigint) as n_paths
           from p group by 1, 2""",
    ),
    "q_section_lines": (
        section_lines,
        _MARKED + "select doc_id, cast(line_no as int) as line_no, line from m where kind = 'inside'",
    ),
    "q_sections_marked": (
        sections_marked,
        _LINES
        + """, t as (
          select *, coalesce(sum(step) over (partition by doc_id order by line_no
                      rows between unbounded preceding and 1 preceding), 0) as depth
          from (select *, case when starts_with(line, 'An') then 1
                            when starts_with(line, 'Th') then -1 else 0 end as step from l))
        select doc_id, cast(line_no as int) as line_no, cast(depth as bigint) as depth,
               case when step = 1 and depth <> 0 then 'nested_open'
                 when step = -1 and depth <> 1 then 'stray_close' when step = 1 then 'open'
                 when step = -1 then 'close' when depth = 1 then 'inside' else 'outside' end as kind
        from t""",
    ),
    "q_section_report": (
        section_report,
        _MARKED
        + """select doc_id, count(*) filter (kind = 'outside') as n_outside,
                    count(*) filter (kind = 'inside') as n_inside, cast(null as int) as first_error,
                    sum(step) > 0 as unclosed
             from m group by doc_id""",
    ),
    "q_submit_output": (
        submit_output,
        """select l_orderkey, cast(l_linenumber as bigint) as njobs, l_partkey as cluster_id
           from lineitem
           union all select l_orderkey, l_suppkey, l_orderkey from lineitem""",
    ),
    "q_addresses": (
        addresses,
        r"""with p as (select page_id, regexp_extract_all(url, '[\w/:.\-]+') as found from pages)
            select page_id, cast(unnest(range(len(found))) as int) as pos, unnest(found) as address
            from p""",
    ),
    "q_log_fields": (
        log_fields,
        """select event_id, case when event_type <> 'error' then 'fleet' end as logger,
                  case when event_type <> 'error' then upper(event_type) end as level,
                  case when event_type <> 'error' then 'user' || user_id end as module,
                  props as message, strftime(ts, '%Y-%m-%d %H:%M:%S') as logged_at
           from events""",
    ),
    "q_queue_text": (
        queue_text,
        """select l_orderkey as cluster_id, l_linenumber as proc_id, l_linenumber - 1 as status,
                  'user' || l_suppkey as user, 'run_' || l_partkey || '.sh' as sh_base
           from lineitem""",
    ),
    "q_env": (
        env,
        """select c_custkey, 'NAME' as key, 'key' || c_custkey as value from customer
           union all select c_custkey, 'SEGMENT', 'a=b=' || c_mktsegment from customer
           union all select c_custkey, 'EMPTY', '' from customer""",
    ),
    "q_merge_settings": (
        merge_settings,
        """with f as (
             select *, concat_ws(',', case when c_acctbal > 0 then 'a.txt,' || c_name end,
                       case when c_mktsegment <> 'BUILDING' then lower(c_mktsegment) end) as files
             from customer)
           select c_custkey, 'hold=false;' || case when files <> '' then
                    'transfer_input_files=' || files || ';' else '' end || 'user=' || c_name
                    as settings
           from f""",
    ),
    "q_manifest": (
        manifest_entries,
        """with o as (select *, cast(o_orderpriority[1] as int) as n from orders),
           e as (
             select *, 0 as entry_no, 'a_' || o_orderkey as name, n as njobs from o
             union all select *, 1, 'b_' || o_orderkey, 2 from o)
           select o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') as submission_timestamp,
                  true as cli, entry_no, 'log=x.log;priority=' || n as settings,
                  o_orderkey as cluster_id, cast(njobs as bigint) as njobs,
                  array_to_string(range(njobs), ',') as proc_ids, name,
                  cast(o_orderkey as int) as i_cluster
           from e""",
    ),
    "q_scope": (
        scope,
        """select p_partkey, p_size as size, p_brand as brand, cast(null as varchar) as none,
                  split_part(p_name, ' ', 2) as second_word, split_part(p_name, ' ', 1) as package,
                  '/data/' || p_partkey as input
           from part""",
    ),
    "q_scope_tables": (
        scope_tables,
        """select p_partkey, split_part(p_name, ' ', 1) as key, 'auto' as value from part
           union all select p_partkey, split_part(p_name, ' ', -1), 'editable' from part
           union all select p_partkey, 'in', '/d/' || p_partkey from part""",
    ),
    "q_marker_names": (
        marker_names,
        """select (['out', 'err', 'log', 'exitcode'])[l_linenumber] as kind,
                  'job_' || l_returnflag as name, l_orderkey as cluster_id,
                  l_linenumber as proc_id
           from lineitem where l_linenumber <= 4""",
    ),
    "q_local_files": (
        local_files,
        """select o_orderkey, 'session.tar,/data/' || o_orderkey as transfer_input_files
           from orders where o_orderstatus <> 'O'""",
    ),
}
