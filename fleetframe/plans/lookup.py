"""Look-ups: parts as versions and requirements, suppliers as servers, files of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import text as X
from fleetframe.operators import lookup
from fleetframe.plans import table

DENY = ["Customer#*5", "Customer#???????[0-4]*"]
ALLOW = ["Customer#*[!1-9]5", "*33"]
LOCATIONS = ["/store/RF", "/store/RO", "/store/NF", "/store/NO", "/store/AF"]
NAMES = ["*ring", "s[!m]*", "?ed *", "h[aeiou]t [a-g]*"]


def _releases(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part")
    release = F.concat("p_brand", F.lit("_"), F.substring_index("p_name", " ", 1))
    return parts.select(F.col("p_type").alias("arch"), release.alias("release")).distinct()


def _wanted(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part")
    suffix = F.when(F.col("p_size") <= 25, F.substring("p_name", 1, 2)).otherwise(
        F.substring("p_name", -2, 2)
    )
    return parts.select("p_partkey", F.concat("p_brand", F.lit("_"), suffix).alias("version"))


def prefix_lookup(spark, sf):
    return lookup.resolve_by_prefix(
        _wanted(spark, sf), _releases(spark, sf), base_pattern=r"Brand#\d+"
    )


def prefix_lookup_tokens(spark, sf):
    return lookup.resolve_by_prefix(
        _wanted(spark, sf), _releases(spark, sf), base_pattern=r"Brand#\d+", token_boundary=True
    )


def _sites(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("site"))


def site_select(spark, sf):
    return lookup.select_sites(_sites(spark, sf), DENY, ALLOW).orderBy("site")


def site_fallback(spark, sf):
    return lookup.select_sites(_sites(spark, sf), ["*"], ["nowhere*"]).orderBy("site")


def glob(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("site"))
    return lookup.matching_sites(names, NAMES)


def glob_patterns(spark, sf):
    """Names that match one of many patterns, which come from a table: ends, middles, lengths."""
    parts = table(spark, sf, "part")
    names = parts.select(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_partkey").alias("name"))
    key, last = F.col("p_partkey"), F.right(F.col("p_partkey").cast("string"), F.lit(2))
    made = F.array(
        F.concat(F.left("p_name", F.lit(4)), F.lit("*"), F.right("p_type", F.lit(3)), F.lit(" "), last),
        F.concat(F.lit("*"), F.substring("p_type", 2, 2), F.lit("* "), key.cast("string")),
        F.concat(F.lit("*["), F.substring("p_name", 1, 1), F.lit("]?"), F.substring("p_name", 3, 3), F.lit("*?7")),
        F.lit("[!a-z]*"), F.repeat(F.lit("?"), 16 + F.pmod(key, F.lit(3)).cast("int")),
    )
    patterns = parts.filter(key % 9 == 0).select(F.get(made, (key % 5).cast("int")).alias("pattern"))
    return lookup.matching_any(names, patterns)


def glob_column(spark, sf):
    """A pattern of its own per row: a first letter, one of a set, any others, a last letter.

    The set is the second letter, all but it, a range that runs backwards, or never closed.
    """
    parts = table(spark, sf, "part")
    second = F.substring("p_type", 2, 1)
    member = F.get(
        F.array(
            F.concat(F.lit("[*"), second, F.lit("]")), F.concat(F.lit("[!"), second, F.lit("]")),
            F.lit("[z-a]"), F.lit("["), F.lit("?"),
        ),
        (F.col("p_partkey") % 5).cast("int"),
    )
    pattern = F.concat(F.substring("p_type", 1, 1), member, F.lit("*"), F.right("p_name", F.lit(1)))
    subject = F.concat("p_type", F.lit(" "), F.reverse("p_name"))
    return parts.select(
        "p_partkey",
        pattern.alias("pattern"),
        F.rlike(subject, X.glob_regex_column(pattern)).alias("hit"),
    )


def ads(spark, sf) -> DataFrame:
    """Suppliers as servers; those of nation 0 can run nothing."""
    suppliers = table(spark, sf, "supplier")
    load = F.abs("s_acctbal")
    return suppliers.select(
        F.col("s_name").alias("name"),
        F.concat(F.lit("<10.0.0."), F.col("s_nationkey"), F.lit(":9618>")).alias("address"),
        F.col("s_nationkey").cast("bigint").alias("max_jobs"),
        F.floor(load / 1000).alias("running"),
        (load / 10000).alias("duty_cycle"),
        F.floor(load / 7).alias("idle"),
        F.col("s_suppkey").alias("arrival"),
        F.col("s_nationkey").alias("nation"),
        (F.col("s_acctbal") < 0).alias("draining"),
        F.when(F.col("s_nationkey") != 3, F.lit("POOL")).alias("kind"),
    )


def server_weights(spark, sf):
    return ads(spark, sf).select("name", lookup.ad_weight().alias("weight"))


def best_server(spark, sf):
    return lookup.best_server(ads(spark, sf))


def best_server_by_nation(spark, sf):
    return lookup.best_server(ads(spark, sf), keys=["nation"])


def first_source(spark, sf):
    """The default source is empty, so the pool sources are asked in order."""
    every = lookup.constrained_ads(ads(spark, sf), "draining", "kind", "POOL")
    sources = [
        every.filter(F.col("max_jobs") > 24),
        every.filter(F.col("max_jobs").between(10, 14)),
        every,
    ]
    return lookup.first_nonempty(sources).select("name", "source_rank")


def _listing(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.concat(
            F.lit("/store/"),
            "l_returnflag",
            "l_linestatus",
            F.lit("/order_"),
            "l_orderkey",
            F.lit(".root"),
        ).alias("path")
    )


def first_available(spark, sf):
    wanted = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("order_"), "o_orderkey", F.lit(".root")).alias("name")
    )
    return lookup.first_available(wanted, LOCATIONS, _listing(spark, sf))


def missing_inputs(spark, sf):
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    present = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return lookup.missing(expected, present, "key")


def _requirements(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part")
    sign = F.element_at(F.array(*[F.lit(s) for s in ("==", ">=", "~=", "<", "")]),
                        (F.floor(F.col("p_size") / 11) + 1).cast("int"))
    version = F.when(sign == "", F.lit("")).otherwise(F.concat(sign, F.col("p_size")))
    return parts.select(
        "p_partkey",
        F.col("p_brand").alias("cluster"),
        F.concat(F.substring_index("p_name", " ", 1), version).alias("package"),
        F.when(F.col("p_size") > 25, F.lit("editable")).alias("mode"),
    )


def requirements(spark, sf):
    package = F.col("package")
    return _requirements(spark, sf).select(
        "p_partkey",
        "package",
        X.requirement_name(package).alias("name"),
        X.requirement_version(package).alias("version"),
        X.has_version(package).alias("has_version"),
    )


def all_requirements(spark, sf):
    """What a call asks for, then what its session asks for, which some do not."""
    parts = table(spark, sf, "part")
    call = F.when(F.col("p_size") % 3 != 0, F.split("p_name", " "))
    session = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.element_at(F.split("p_name", " "), 1)))
    joined = F.array_join(lookup.concat_requirements(call, session), ",")
    return parts.select("p_partkey", joined.alias("requirements"))


def default_requirements(spark, sf):
    defaults = [("runner==1.0", "auto"), ("red>2", "auto"), ("hot", "auto")]
    return lookup.add_default_requirements(_requirements(spark, sf), defaults, ["cluster"])


_PREFIX = """
with v as (
  select p_partkey, p_brand,
         p_brand || '_' || case when p_size <= 25 then p_name[1:2] else p_name[-2:] end as version
  from part
), r as (
  select distinct p_type as arch, p_brand || '_' || split_part(p_name, ' ', 1) as release
  from part
), w as (
  select distinct p_brand as base, version from v
), h as (
  select w.version,
         coalesce(max(arch) filter ({full}), max(arch) filter ({base})) as arch,
         coalesce(bool_or({full}), false) as by_suffix
  from w join r on {base} group by w.version
)
select v.p_partkey, v.version, h.arch, h.by_suffix
from v left join h on h.version = v.version
"""

_ADS = """
with a as (
  select s_name as name, '<10.0.0.' || s_nationkey || ':9618>' as address,
         cast(s_nationkey as bigint) as max_jobs,
         cast(floor(abs(s_acctbal) / 1000) as bigint) as running,
         abs(s_acctbal) / 10000 as duty_cycle,
         cast(floor(abs(s_acctbal) / 7) as bigint) as idle,
         s_suppkey as arrival, s_nationkey as nation, s_acctbal < 0 as draining
  from supplier
), w as (
  select *, 0.7::double * (duty_cycle * 100)
            + 0.2::double * ((running::double / nullif(max_jobs, 0)::double) * 100)
            + 0.1::double * idle as load
  from a
), b as (select *, coalesce(load, 'inf'::double) as weight from w)
"""

_PACKAGES = """
with s as (
  select p_partkey, p_brand, p_size, split_part(p_name, ' ', 1) as name,
         case cast(floor(p_size / 11) as int) when 0 then '==' when 1 then '>=' when 2 then '~='
           when 3 then '<' else '' end as sign
  from part
), q as (
  select p_partkey, p_brand as cluster, name,
         case when sign = '' then '' else sign || p_size end as version,
         case when p_size > 25 then 'editable' end as mode
  from s
)
"""

QUERIES = {
    "q_glob_patterns": (
        glob_patterns,
        """with n as (select p_name || ' ' || p_type || ' ' || p_partkey as name from part),
           p as (
             select distinct case p_partkey % 5
               when 0 then p_name[1:4] || '*' || p_type[-3:] || ' ' || right(cast(p_partkey as varchar), 2)
               when 1 then '*' || p_type[2:3] || '* ' || p_partkey
               when 2 then '*[' || p_name[1] || ']?' || p_name[3:5] || '*?7'
               when 3 then '[!a-z]*' else repeat('?', 16 + p_partkey % 3) end as pattern
             from part where p_partkey % 9 = 0)
           select distinct name from n, p where name glob pattern""",
    ),
    "q_prefix_lookup": (
        prefix_lookup,
        _PREFIX.format(
            full="starts_with(release, w.version)", base="starts_with(release, w.base)"
        ),
    ),
    "q_prefix_lookup_tokens": (
        prefix_lookup_tokens,
        _PREFIX.format(
            full="(starts_with(release, w.version) and release = w.version)",
            base="starts_with(release, w.base || '_')",
        ),
    ),
    "q_site_select": (
        site_select,
        """select distinct c_name as site, false as fallback from customer
           where not (c_name glob 'Customer#*5' or c_name glob 'Customer#???????[0-4]*')
              or c_name glob 'Customer#*[!1-9]5' or c_name glob '*33' order by 1""",
    ),
    "q_site_fallback": (
        site_fallback,
        "select distinct c_name as site, true as fallback from customer order by 1",
    ),
    "q_glob": (
        glob,
        """select distinct p_name as site from part
           where p_name glob '*ring' or p_name glob 's[!m]*' or p_name glob '?ed *'
              or p_name glob 'h[aeiou]t [a-g]*'""",
    ),
    "q_glob_column": (
        glob_column,
        """select p_partkey,
                  p_type[1] || ['[*' || p_type[2] || ']', '[!' || p_type[2] || ']', '[z-a]', '[', '?'][
                    p_partkey % 5 + 1] || '*' || p_name[-1] as pattern,
                  p_partkey % 5 in (0, 4) and length(p_type || ' ' || p_name) >= 3
                    and ends_with(p_type || ' ' || reverse(p_name), p_name[-1]) as hit
           from part""",
    ),
    "q_server_weights": (server_weights, _ADS + "select name, load as weight from b"),
    "q_best_server": (
        best_server,
        _ADS
        + """select name, address, max_jobs, running, duty_cycle, idle, weight
             from b order by weight, arrival limit 1""",
    ),
    "q_best_server_by_nation": (
        best_server_by_nation,
        _ADS
        + """select nation, name, address, max_jobs, running, duty_cycle, idle, weight from b
             qualify row_number() over (partition by nation order by weight, arrival) = 1""",
    ),
    "q_first_source": (
        first_source,
        """select s_name as name, 1 as source_rank from supplier
           where s_acctbal >= 0 and s_nationkey between 10 and 14""",
    ),
    "q_first_available": (
        first_available,
        """with l as (
             select distinct l_orderkey, '/store/' || l_returnflag || l_linestatus as dir,
                    strpos('RNA', l_returnflag) * 2 + cast(l_linestatus = 'O' as int) - 2
                      as priority
             from lineitem where l_returnflag <> 'A' or l_linestatus <> 'O'
           ), b as (
             select l_orderkey, arg_min(dir, priority) as dir, min(priority) as priority
             from l group by 1
           )
           select o_orderkey, 'order_' || o_orderkey || '.root' as name,
                  dir || '/order_' || o_orderkey || '.root' as path,
                  cast(priority as int) as priority
           from orders left join b on o_orderkey = l_orderkey""",
    ),
    "q_missing_inputs": (
        missing_inputs,
        "select o_orderkey as key from orders anti join lineitem on o_orderkey = l_orderkey",
    ),
    "q_requirements": (
        requirements,
        _PACKAGES
        + """select p_partkey, name || version as package, name, version,
                    version <> '' as has_version from q""",
    ),
    "q_all_requirements": (
        all_requirements,
        """select p_partkey, array_to_string(list_concat(
                    case when p_size % 3 <> 0 then string_split(p_name, ' ') else [] end,
                    case when p_size % 2 = 0 then [p_brand, string_split(p_name, ' ')[1]] else [] end), ',')
                    as requirements
           from part""",
    ),
    "q_default_requirements": (
        default_requirements,
        _PACKAGES
        + """, d(package, mode, name) as (
               values ('runner==1.0', 'auto', 'runner'), ('red>2', 'auto', 'red'),
                      ('hot', 'auto', 'hot'))
             select cluster, name || version as package, coalesce(mode, 'auto') as mode from q
             union all
             select c.cluster, d.package, d.mode from (select distinct cluster from q) c, d
             where not exists (select 1 from q where q.cluster = c.cluster and q.name = d.name)
             """,
    ),
}
