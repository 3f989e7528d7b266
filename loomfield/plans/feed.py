"""The feed: filters, counts, duplicate suppression, ranking, scoring, skill gap. Postings are orders, companies are customers,
skills are the parts of an order's lines; "unknown" is a priority of 4-NOT SPECIFIED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import scoring, state
from loomfield.registry import Tables, query

AS_OF = "timestamp_ntz'2001-08-02 00:00:00'"
SEEN = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def priority() -> Column:
    return F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')")


def postings(t: Tables) -> DataFrame:
    """Orders with the company's name and segment; orders without a customer stay."""
    return t.orders.select(*SEEN).join(t.customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")


def not_ignored() -> Column:
    return ~F.col("c_mktsegment").eqNullSafe(F.lit("MACHINERY"))


@query("""
select o_orderkey, c_name, o_totalprice, o_orderdate from orders left join customer on o_custkey = c_custkey
where o_orderstatus = 'O' and c_mktsegment is distinct from 'MACHINERY' and o_totalprice >= 1000 and o_orderdate >= timestamp '2001-08-02' - interval 3000 day
  and (o_orderpriority ilike '%-H%' escape '\\' or c_name ilike '%1%' escape '\\')
order by o_orderdate desc nulls last, o_orderkey desc limit 25 offset 25
""")
def feed_newest_page(t: Tables) -> DataFrame:
    """Second page of the filtered feed, newest first."""
    found = postings(t).where((F.col("o_orderstatus") == "O") & not_ignored() & (F.col("o_totalprice") >= 1000))
    recent = F.col("o_orderdate") >= F.expr(f"{AS_OF} - make_dt_interval(3000)")
    text = F.col("o_orderpriority").ilike(tx.like_pattern("-H")) | F.col("c_name").ilike(tx.like_pattern("1"))
    return found.where(recent & text).select("o_orderkey", "c_name", "o_totalprice", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).offset(25).limit(25)


@query("""
with p as (select *, nullif(o_orderpriority, '4-NOT SPECIFIED') as pr from orders left join customer on o_custkey = c_custkey where c_mktsegment is distinct from 'MACHINERY')
select count(*) filter (where o_orderstatus = 'O' and pr = '1-URGENT' and o_totalprice > 200000) as total, count(*) filter (where o_orderstatus = 'O') as open_total,
  count(*) filter (where o_orderstatus = 'O' and pr is null and o_totalprice > 200000) as priority_unknown,
  count(*) filter (where o_orderstatus = 'O' and pr = '1-URGENT') as pay_unfiltered, count(*) filter (where o_orderstatus <> 'O' and pr = '1-URGENT' and o_totalprice > 200000) as closed_total,
  count(*) filter (where o_orderstatus = 'O' and pr is distinct from '1-URGENT' and o_totalprice > 200000) as unconfirmed from p
""")
def feed_counts(t: Tables) -> DataFrame:
    """Six counts that each drop one predicate of the filter, in one pass over one join."""
    p = postings(t).where(not_ignored()).withColumn("pr", priority())
    is_open, urgent, paid = F.col("o_orderstatus") == "O", F.col("pr") == "1-URGENT", F.col("o_totalprice") > 200000
    return p.agg(
        F.count_if(is_open & urgent & paid).alias("total"), F.count_if(is_open).alias("open_total"), F.count_if(is_open & F.col("pr").isNull() & paid).alias("priority_unknown"),
        F.count_if(is_open & urgent).alias("pay_unfiltered"), F.count_if(~is_open & urgent & paid).alias("closed_total"), F.count_if(is_open & ~urgent.eqNullSafe(True) & paid).alias("unconfirmed"),
    )


_COPY_SQL = """
with p as (select o_orderkey, o_custkey, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') as pr, o_totalprice > 20000 as decided, o_totalprice < 350000 as unflagged from orders)
select o_orderkey, o_custkey, o_orderstatus, pr from p where not decided or not exists (select 1 from p q where q.o_custkey = p.o_custkey and q.o_orderstatus = p.o_orderstatus
  and q.pr is not distinct from p.pr and q.o_orderkey > p.o_orderkey and q.decided and q.unflagged)
"""


def _copies(t: Tables):
    p = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", priority().alias("pr"), (F.col("o_totalprice") > 20000).alias("decided"), (F.col("o_totalprice") < 350000).alias("unflagged"))
    return p, ["o_custkey", "o_orderstatus", "pr"], "o_orderkey", F.col("decided") & F.col("unflagged"), ~F.col("decided")


@query(_COPY_SQL)
def feed_newest_copy(t: Tables) -> DataFrame:
    """Newest of identical copies, by a window."""
    return state.newest_copy(*_copies(t)).select("o_orderkey", "o_custkey", "o_orderstatus", "pr")


@query(_COPY_SQL)
def feed_newest_copy_by_join(t: Tables) -> DataFrame:
    """Newest of identical copies, by an anti join on null-safe keys."""
    return state.newest_copy_by_join(*_copies(t)).select("o_orderkey", "o_custkey", "o_orderstatus", "pr")


_SKILLS_SQL = """
skills as (select distinct l_orderkey, p_brand || ' ' || p_type as skill, case when l_returnflag = 'R' then 'must' else 'nice' end as importance, p_type = 'ECONOMY' as general
  from lineitem join part on l_partkey = p_partkey),
best as (select l_orderkey, skill, min(importance) as importance, bool_or(general) as general from skills group by all),
mine(skill) as (select distinct p_brand || ' ' || p_type from part where p_partkey % 3 = 0)"""


def posting_skills(t: Tables) -> DataFrame:
    """(l_orderkey, skill, importance, general): must outranks nice. The part side is small next to the lines."""
    parts = t.part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("skill"), (F.col("p_type") == "ECONOMY").alias("general"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "must").otherwise("nice").alias("importance"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "skill").agg(F.min("importance").alias("importance"), F.bool_or("general").alias("general"))


def my_skills(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 3 = 0").select(F.concat_ws(" ", "p_brand", "p_type").alias("skill")).distinct()


@query(f"""
with {_SKILLS_SQL},
w as (select l_orderkey, case when importance = 'must' and general then 25 when importance = 'must' then 100 when general then 10 else 40 end as weight, skill in (select skill from mine) as mine from best),
s as (select l_orderkey, count(*) as n_skills, sum(weight) as total, sum(case when mine then weight else 0 end) as covered from w group by all)
select l_orderkey, n_skills, case when n_skills >= 3 then round(40::double * least(1.0::double, covered / total / 0.8::double), 1) end as points from s
""")
def skills_coverage(t: Tables) -> DataFrame:
    """Skill points of each posting: weighted cover of what it asks, full credit at four fifths; fewer than three skills are
    not judged."""
    return scoring.skill_points(posting_skills(t), my_skills(t), "l_orderkey")


@query(f"with {_SKILLS_SQL} select l_orderkey, string_agg(skill || '=' || importance, ';' order by skill) as skills from best group by l_orderkey")
def skills_json(t: Tables) -> DataFrame:
    """The skills of each posting as one sorted list."""
    return posting_skills(t).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("skill", "importance"))), lambda x: F.concat(x["skill"], F.lit("="), x["importance"])), ";").alias("skills"))


@query(f"""
with {_SKILLS_SQL}, fit as (select o_orderkey from orders where o_orderstatus = 'O' and o_totalprice > 100000)
select skill, count(distinct l_orderkey) as jobs from best join fit on l_orderkey = o_orderkey where importance = 'must' and skill not in (select skill from mine) group by skill order by jobs desc, skill limit 5
""")
def skill_gap_top5(t: Tables) -> DataFrame:
    """Must-have skills of fitting postings that the profile lacks, by number of postings."""
    fit = t.orders.where("o_orderstatus = 'O' and o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    lacking = posting_skills(t).where("importance = 'must'").join(fit, "l_orderkey", "left_semi").join(my_skills(t), "skill", "left_anti")
    return lacking.groupBy("skill").agg(F.count_distinct("l_orderkey").alias("jobs")).orderBy(F.desc("jobs"), "skill").limit(5)


_SCORED_SQL = f"""
with {_SKILLS_SQL},
cand as (select o_orderkey, o_orderdate, o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') as pr, c_mktsegment from orders left join customer on o_custkey = c_custkey where o_orderstatus = 'O' order by o_orderdate desc nulls last, o_orderkey desc limit 400),
w as (select l_orderkey, case when importance = 'must' and general then 25 when importance = 'must' then 100 when general then 10 else 40 end as weight, skill in (select skill from mine) as mine from best where l_orderkey in (select o_orderkey from cand)),
s as (select l_orderkey, count(*) as n, sum(weight) as total, sum(case when mine then weight else 0 end) as covered from w group by all),
parts as (select cand.*, case when n >= 3 then round(40::double * least(1.0::double, covered / total / 0.8::double), 1) end as skills,
  case when c_mktsegment = 'BUILDING' then 25.0 when c_mktsegment in ('AUTOMOBILE', 'FURNITURE') then 12.5 else 0.0 end as role,
  case pr when '1-URGENT' then 15.0 when '2-HIGH' then 15.0 when '3-MEDIUM' then 0.0 when '5-LOW' then 0.0 end as level,
  case when o_totalprice >= 150000 then 5.0 else 0.0 end as pay,
  case when date_diff('hour', o_orderdate, timestamp '2001-08-02') <= 48 then 5.0 when date_diff('hour', o_orderdate, timestamp '2001-08-02') <= 168 then 3.0 when date_diff('hour', o_orderdate, timestamp '2001-08-02') <= 720 then 1.5 else 0.0 end as freshness,
  pr is not distinct from '5-LOW' as blocked from cand left join s on o_orderkey = l_orderkey),
summed as (select *, coalesce(skills, 0) + role + coalesce(level, 0) + pay + freshness as pts, case when skills is null then 0 else 40 end + 25 + case when level is null then 0 else 15 end + 5 + 5 as most from parts),
scored as (select *, cast(case when blocked then least(25, floor(pts / most * 100 + 0.5)) else floor(pts / most * 100 + 0.5) end as bigint) as score from summed),
ranked as (select *, case when blocked then 'other' when score >= 65 then 'strong' when score >= 40 then 'worth' else 'other' end as bucket from scored)"""


def scored(t: Tables) -> DataFrame:
    """The newest 400 open postings with their score and bucket; skills are only looked up for those."""
    best = postings(t).where("o_orderstatus = 'O'").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(scoring.CANDIDATES).withColumn("pr", priority())
    asked = posting_skills(t).join(best.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = best.join(scoring.skill_points(asked, my_skills(t), "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    hours = F.floor((F.unix_timestamp(F.expr(AS_OF)) - F.unix_timestamp("o_orderdate")) / 3600)
    segment, pr = F.col("c_mktsegment"), F.col("pr")
    parts = {
        "skills": F.col("points"),
        "role": F.when(segment == "BUILDING", 25.0).when(segment.isin("AUTOMOBILE", "FURNITURE"), 12.5).otherwise(0.0),
        "level": F.when(pr.isin("1-URGENT", "2-HIGH"), 15.0).when(pr.isin("3-MEDIUM", "5-LOW"), 0.0),
        "pay": F.when(F.col("o_totalprice") >= 150000, 5.0).otherwise(0.0),
        "freshness": scoring.freshness(hours),
    }
    blocked = pr.eqNullSafe("5-LOW")
    total = scoring.total(parts, blocked)
    return rows.withColumn("score", total).withColumn("bucket", scoring.bucket(F.col("score"), blocked, F.lit(True), F.lit(False)))


@query(_SCORED_SQL + " select o_orderkey, score, bucket from ranked order by score desc, o_orderdate desc nulls last, o_orderkey desc")
def feed_top400_scored(t: Tables) -> DataFrame:
    """The scored candidates, best first; ties keep the newest first."""
    return scored(t).orderBy(F.desc("score"), F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "score", "bucket")


@query(_SCORED_SQL + " select bucket, count(*) as n from ranked group by bucket")
def feed_bucket_counts(t: Tables) -> DataFrame:
    return scored(t).groupBy("bucket").agg(F.count("*").alias("n"))
