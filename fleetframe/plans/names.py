"""Names, parameters and step chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import params as P
from fleetframe.operators import chains, names
from fleetframe.plans import table


def unique_names(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return names.unique_names(parts, "p_name", "p_partkey")


def unique_names_rivals(spark, sf):
    """Names that end in numbers, so that numbered names meet names that were asked for."""
    parts = table(spark, sf, "part")
    name = F.concat(F.substring_index("p_name", " ", 1), F.col("p_size"))
    return names.unique_names(parts.select("p_partkey", name.alias("name")), "name", "p_partkey")


def default_names(spark, sf):
    """Parts of odd size have no name; the others ask for names that defaults may have too."""
    parts = table(spark, sf, "part")
    asked = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("cluster"), F.col("p_partkey") % 50))
    named = names.with_default_names(parts.select("p_partkey", asked.alias("name")), "name", "p_partkey")
    return names.unique_names(named, "name", "p_partkey", separator="_")


def unique_file_keys(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return names.unique_names(parts, "p_name", "p_partkey", separator="_")


def _params(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    size = F.col("p_size")
    return part.select(
        "p_partkey",
        F.when(size < 45, F.col("p_retailprice") / 4).alias("mz"),
        F.when(size != 7, size / 100).alias("rinv"),
        F.when(size > 10, (size - 25) / 2).alias("boost"),
        F.when(size < 30, size * 2.5).alias("mdark"),
        F.when(size > 20, F.lower("p_type")).alias("alpha"),
        F.when(size > 35, size * 1000).alias("max_events"),
        F.when(size < 15, size - 1).alias("part"),
    )


def param_names(spark, sf):
    filled = P.with_defaults(_params(spark, sf))
    return filled.select(
        "p_partkey",
        P.sample_name(F.lit("step2_DIGI")).alias("name"),
        P.archive_name().alias("archive"),
    )


def param_grid(spark, sf):
    base = table(spark, sf, "part").select("p_partkey")
    return P.parameter_grid(base, alpha=["peak", "low"], boost=[0.0, 2.5, 100.0])


def _steps(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    step = (
        F.when(F.col("event_type") == "error", F.lit("step_RECO"))
        .when(F.col("event_type") == "click", F.lit("step_DIGI"))
        .otherwise(F.concat(F.lit("step_"), F.upper("event_type")))
    )
    return e.select("user_id", "ts", "event_id", step.alias("step"))


def chain(spark, sf):
    pairs = chains.step_pairs(_steps(spark, sf), ["user_id"], ["ts", "event_id"])
    return pairs.select("user_id", "event_id", "step", "target", "attempts")


def chain_array(spark, sf):
    parts = table(spark, sf, "part")
    steps = F.concat(F.split("p_name", " "), F.array(F.concat("p_type", F.lit("_RECO")), "p_brand"))
    return chains.chain_pairs(parts.select("p_partkey", steps.alias("chain")))


_PARAMS = """
with p as (
  select p_partkey, coalesce(case when p_size < 45 then p_retailprice / 4 end, 150.0) as mz,
         coalesce(case when p_size <> 7 then p_size / 100 end, 0.3::double) as rinv,
         coalesce(case when p_size > 10 then (p_size - 25) / 2 end, 0.0) as boost,
         coalesce(case when p_size < 30 then p_size * 2.5::double end, 20.0) as mdark,
         coalesce(case when p_size > 20 then lower(p_type) end, 'peak') as alpha,
         case when p_size > 35 then p_size * 1000 end as max_events,
         case when p_size < 15 then p_size - 1 end as part
  from part
), n as (
  select p_partkey, '_s-channel_mMed-' || cast(round_even(mz, 0) as bigint)
           || '_mDark-' || cast(round_even(mdark, 0) as bigint) || '_rinv-' || rinv
           || '_alpha-' || alpha
           || case when boost > 0 then '_PT' || cast(round_even(boost, 0) as bigint) else '' end
           || '_13TeV-madgraphMLM-pythia8' || coalesce('_n-' || max_events, '') as stem,
         coalesce('_part-' || part, '') as tag
  from p
)
"""

_NUMBERED = """
with r as (
  select p_partkey, p_name,
         row_number() over (partition by p_name order by p_partkey) - 2 as k
  from part)
select p_partkey, p_name, case when k < 0 then p_name else p_name || '{}' || k end as unique_name
from r
"""

QUERIES = {
    "q_unique_names": (unique_names, _NUMBERED.format("")),
    "q_unique_names_rivals": (
        unique_names_rivals,
        # A name is a word with a number of one or two digits. Bases with one digit are numbered
        # past the names asked for, then those with two past these and past the names taken.
        """with r as (
             select p_partkey, string_split(p_name, ' ')[1] || p_size as name,
                    length(cast(p_size as varchar)) as digits
             from part
           ), j as (
             select *, row_number() over (partition by name order by p_partkey) - 2 as j from r
           ), n as (select name, digits, count(*) as n from r group by all),
           c as (select name, digits, unnest(range(n + 110 + (select max(n) from n))) as k from n where n > 1),
           free1 as (
             select name, k, row_number() over (partition by name order by k) - 1 as j from c
             where digits = 1 and name || k not in (select name from n)
           ), made1 as (
             select j.p_partkey, j.name, j.name || k as unique_name
             from j join free1 f on j.name = f.name and j.j = f.j
           ), free2 as (
             select name, k, row_number() over (partition by name order by k) - 1 as j from c
             where digits = 2 and name || k not in (select name from n)
               and name || k not in (select unique_name from made1)
           ), made2 as (
             select j.p_partkey, j.name, j.name || k as unique_name
             from j join free2 f on j.name = f.name and j.j = f.j
           )
           select p_partkey, name, name as unique_name from j where j < 0
           union all select * from made1 union all select * from made2""",
    ),
    "q_default_names": (
        default_names,
        """with r as (
             select p_partkey, coalesce(
                      case when p_size % 2 = 0 then 'cluster' || (p_partkey % 50) end,
                      'cluster' || (row_number() over (order by p_partkey) - 1)) as name
             from part
           ), j as (select *, row_number() over (partition by name order by p_partkey) - 2 as k from r)
           select p_partkey, name, case when k < 0 then name else name || '_' || k end as unique_name
           from j""",
    ),
    "q_unique_file_keys": (unique_file_keys, _NUMBERED.format("_")),
    "q_param_names": (
        param_names,
        _PARAMS
        + """select p_partkey, 'step2_DIGI' || stem || tag || '.root' as name,
                    'step0_GRIDPACK' || stem || '.tar.xz' as archive
             from n""",
    ),
    "q_param_grid": (
        param_grid,
        """select p_partkey, alpha, boost from part,
                  (values ('peak'), ('low')) a(alpha),
                  (values (0.0::double), (2.5::double), (100.0::double)) b(boost)""",
    ),
    "q_chain": (
        chain,
        """with s as (
             select *, case event_type when 'error' then 'step_RECO' when 'click' then 'step_DIGI'
                         else 'step_' || upper(event_type) end as step
             from events
           ), t as (
             select user_id, event_id, step,
                    lead(step) over (partition by user_id order by ts, event_id) as target
             from s)
           select *, case when target in ('step_RECO', 'step_DIGI') then 3 else 1 end as attempts
           from t where target is not null""",
    ),
    "q_chain_array": (
        chain_array,
        """with c as (
             select p_partkey, list_concat(string_split(p_name, ' '),
                      [p_type || '_RECO', p_brand]) as chain
             from part
           ), x as (select *, unnest(range(len(chain) - 1)) as pos from c)
           select p_partkey, cast(pos as int) as pos, chain[pos + 1] as source,
                  chain[pos + 2] as target,
                  case when chain[pos + 2] like '%RECO%' then 3 else 1 end as attempts
           from x""",
    ),
}
