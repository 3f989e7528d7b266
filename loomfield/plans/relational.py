"""Companies, sources, data quality, tracker and history queries over the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators import state
from loomfield.registry import Tables, crc32_sql, query

ORDERS_AS_OF = "timestamp_ntz'2001-08-02 00:00:00'"
EVENTS_AS_OF = "timestamp_ntz'2024-01-31 00:00:00'"
STATES = ("click", "view", "signup", "purchase", "error", "archived")


@query("""
with o as (select * from orders where o_orderstatus = 'O'),
x as (select o_custkey, count(*) as closed_30 from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '2001-08-02' - interval 900 day group by 1)
select c_custkey, c_name, count(o_orderkey) as open_jobs, count(*) filter (where o_orderpriority = '1-URGENT') as urgent, count(*) filter (where o_totalprice > 200000) as paid,
  min(o_orderdate) as first_seen, coalesce(string_agg(distinct o_orderpriority, ',' order by o_orderpriority), '') as priorities, max(coalesce(closed_30, 0)) as closed_30
from customer left join o on c_custkey = o.o_custkey left join x on c_custkey = x.o_custkey group by c_custkey, c_name, c_mktsegment
having count(o_orderkey) > 0 or c_mktsegment = 'BUILDING' order by c_mktsegment = 'BUILDING' desc, c_mktsegment = 'MACHINERY', open_jobs desc, c_name limit 200
""")
def companies_overview(t: Tables) -> DataFrame:
    """Companies with their open postings counted by kind; the open ones are filtered before the left join, and closings
    of late are aggregated before theirs."""
    by_company = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(
        F.count("*").alias("open_jobs"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_totalprice") > 200000).alias("paid"),
        F.min("o_orderdate").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"),
    )
    closed = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.expr(f"{ORDERS_AS_OF} - make_dt_interval(900)"))).groupBy("o_custkey").agg(F.count("*").alias("closed_30"))
    rows = t.customer.join(by_company, F.col("c_custkey") == by_company["o_custkey"], "left").join(closed, F.col("c_custkey") == closed["o_custkey"], "left")
    filled = rows.select("c_custkey", "c_name", "c_mktsegment", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("open_jobs", "urgent", "paid")], "first_seen", F.coalesce("priorities", F.lit("")).alias("priorities"), F.coalesce("closed_30", F.lit(0)).alias("closed_30"))
    watched = F.col("c_mktsegment") == "BUILDING"
    return filled.where((F.col("open_jobs") > 0) | watched).orderBy(F.desc(watched), F.col("c_mktsegment") == "MACHINERY", F.desc("open_jobs"), "c_name").limit(200).drop("c_mktsegment")


@query("""
select count(*) as total, count(*) filter (where o_orderpriority <> '4-NOT SPECIFIED') as with_priority, count(*) filter (where o_totalprice > 1000) as with_pay, count(*) filter (where o_orderstatus = 'O') as open,
  count(*) filter (where o_orderstatus = 'O' and o_orderpriority = '4-NOT SPECIFIED') as open_unknown, count(*) filter (where o_orderdate >= timestamp '2001-08-02' - interval 30 day) as fresh,
  count(*) filter (where o_totalprice >= 1e12) as junk_pay, count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as pressing, count(*) filter (where o_custkey is null) as orphaned from orders
""")
def data_quality(t: Tables) -> DataFrame:
    """Nine conditional counts in one pass."""
    unknown = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    is_open = F.col("o_orderstatus") == "O"
    return t.orders.agg(
        F.count("*").alias("total"), F.count_if(~unknown).alias("with_priority"), F.count_if(F.col("o_totalprice") > 1000).alias("with_pay"), F.count_if(is_open).alias("open"),
        F.count_if(is_open & unknown).alias("open_unknown"), F.count_if(F.col("o_orderdate") >= F.expr(f"{ORDERS_AS_OF} - make_dt_interval(30)")).alias("fresh"),
        F.count_if(F.col("o_totalprice") >= 1e12).alias("junk_pay"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("pressing"), F.count_if(F.col("o_custkey").isNull()).alias("orphaned"),
    )


@query("""
select r_name as source, count(s_suppkey) as boards, count(*) filter (where s_acctbal >= 0) as active, count(*) filter (where s_acctbal < 0) as failing, cast(sum(s_nationkey) as bigint) as listed, max(s_acctbal) as most
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name
""")
def source_summary(t: Tables) -> DataFrame:
    """Boards of each source by status, rolled up in one aggregate. Nations and regions are fixed small tables."""
    where = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return t.supplier.join(F.broadcast(where), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("source")).agg(
        F.count("s_suppkey").alias("boards"), F.count_if(F.col("s_acctbal") >= 0).alias("active"), F.count_if(F.col("s_acctbal") < 0).alias("failing"), F.sum(F.col("s_nationkey").cast("long")).alias("listed"), F.max("s_acctbal").alias("most")
    )


@query("select s_suppkey, s_name, n_name, s_acctbal from supplier left join nation on s_nationkey = n_nationkey where s_acctbal < 1000 order by s_acctbal, s_suppkey limit 20")
def problem_sources(t: Tables) -> DataFrame:
    """The twenty worst boards."""
    return t.supplier.where("s_acctbal < 1000").join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").orderBy("s_acctbal", "s_suppkey").limit(20).select("s_suppkey", "s_name", "n_name", "s_acctbal")


@query("""
with s as (select count(*) as polled, count(*) filter (where event_type = 'error') as failed, date_diff('second', max(ts), timestamp '2024-01-31') / 3600.0 as idle_hours, count(*) filter (where event_type = 'purchase') as feed from events)
select polled, failed, round(idle_hours, 4) as idle_hours, feed, concat_ws(',', case when feed < 30 then 'feed' end, case when failed > 0.25 * polled then 'stale' end, case when idle_hours > 6 then 'idle' end) as problems from s
""")
def health_stats(t: Tables) -> DataFrame:
    """Daily health: counts, hours since the last poll, and what is wrong."""
    idle = (F.unix_timestamp(F.expr(EVENTS_AS_OF)) - F.unix_timestamp(F.max("ts"))) / 3600
    s = t.events.agg(F.count("*").alias("polled"), F.count_if(F.col("event_type") == "error").alias("failed"), idle.alias("idle_hours"), F.count_if(F.col("event_type") == "purchase").alias("feed"))
    problems = F.concat_ws(",", F.when(F.col("feed") < 30, "feed"), F.when(F.col("failed") > 0.25 * F.col("polled"), "stale"), F.when(F.col("idle_hours") > 6, "idle"))
    return s.select("polled", "failed", F.round("idle_hours", 4).alias("idle_hours"), "feed", problems.alias("problems"))


@query("""
with last as (select user_id, arg_max(event_type, (ts, event_id)) as state from events group by user_id), d(state) as (values ('click'), ('view'), ('signup'), ('purchase'), ('error'), ('archived'))
select d.state, count(user_id) as n, count(user_id) filter (where d.state not in ('error', 'archived')) as active from d left join last using (state) group by d.state
""")
def pipeline_by_state(t: Tables) -> DataFrame:
    """Applications by state, states without any shown as zero."""
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))
    known = t.spark.createDataFrame([(s,) for s in STATES], "state string")
    n = F.coalesce("n", F.lit(0))
    return known.join(last, "state", "left").select("state", n.alias("n"), F.when(F.col("state").isin("error", "archived"), F.lit(0)).otherwise(n).cast("long").alias("active"))


@query("""
select cast(date_trunc('week', ts + interval 330 minute) as date) as week, count(distinct user_id) as users from events where cast(json_extract_string(props, '$.k') as int) > 50 group by 1
""")
def week_distinct_users(t: Tables) -> DataFrame:
    """Distinct users per week of India's calendar, by a JSON predicate."""
    week = F.date_trunc("week", F.col("ts") + F.expr("make_dt_interval(0, 0, 330)")).cast("date")
    return t.events.where(F.get_json_object("props", "$.k").cast("int") > 50).groupBy(week.alias("week")).agg(F.count_distinct("user_id").alias("users"))


@query("""
with x as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select user_id, arg_max(event_type, (ts, event_id)) as state, count(*) filter (where event_type is distinct from before) as transitions, max(ts) as since from x group by user_id
""")
def current_state_fold(t: Tables) -> DataFrame:
    """Current state of each application from its event log."""
    return state.current_state(t.events, "user_id", "event_type", ["ts", "event_id"])


@query("""
with u as (select * from events union all select event_id + 1000000, ts, user_id, event_type, value, props from events where event_id % 3 = 0 union all select event_id + 2000000, ts + interval 1 second, user_id, event_type, value, props from events where event_id % 5 = 0)
select min(event_id) as event_id, ts, user_id, event_type, md5(props) as payload from u group by ts, user_id, event_type, md5(props)
""")
def event_dedupe(t: Tables) -> DataFrame:
    """The log with copies written again, once per (user, type, time, payload)."""
    e = t.events
    late = e.where("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 2000000).withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, 0, 0, 1)"))
    again = e.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1000000)
    rows = e.unionByName(again).unionByName(late).withColumn("payload", F.md5("props"))
    return state.dedupe_events(rows, ["ts", "user_id", "event_type", "payload"]).select("event_id", "ts", "user_id", "event_type", "payload")


@query("select event_id, ts, event_type, o_orderkey from events join (select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1) on user_id = o_custkey where user_id = 7 order by ts, event_id")
def user_history(t: Tables) -> DataFrame:
    """One user's history, in order, with the posting it belongs to."""
    own = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return t.events.where("user_id = 7").join(own, F.col("user_id") == F.col("o_custkey")).orderBy("ts", "event_id").select("event_id", "ts", "event_type", "o_orderkey")


@query("""
select event_id, user_id, ts + interval 7 day as due from events where event_type in ('view', 'click') and ts + interval 7 day < timestamp '2024-01-31 18:30:00' order by due, event_id limit 50
""")
def follow_ups_due(t: Tables) -> DataFrame:
    """Next actions due before the end of India's day of 2024-01-31, soonest first."""
    due = F.col("ts") + F.expr("make_dt_interval(7)")
    end = F.expr("timestamp_ntz'2024-01-31 18:30:00'")
    return t.events.where(F.col("event_type").isin("view", "click") & (due < end)).select("event_id", "user_id", due.alias("due")).orderBy("due", "event_id").limit(50)


_WEEK = "cast(date_trunc('week', ts + interval 330 minute) as date)"


@query(f"select user_id, {_WEEK} as week_start, arg_max(event_type, (ts, event_id)) as answer, max(event_id) as last_id from events group by all".replace("max(event_id) as last_id", "arg_max(event_id, (ts, event_id)) as last_id"))
def checkin_upsert(t: Tables) -> DataFrame:
    """One check-in per user and week: a second batch merged over the first, later answers replacing earlier ones."""
    week = F.date_trunc("week", F.col("ts") + F.expr("make_dt_interval(0, 0, 330)")).cast("date")
    rows = t.events.select("user_id", week.alias("week_start"), F.struct("ts", "event_id").alias("version"), F.col("event_type").alias("answer"), F.col("event_id").alias("last_id"))
    middle = F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    keys = ["user_id", "week_start"]
    first = state.merge(rows.where("1 = 0"), rows.where(F.col("version.ts") < middle), keys, "version")
    return state.merge(first, rows.where(F.col("version.ts") >= middle), keys, "version").drop("version")


@query("""
select user_id, event_id as profile_id, row_number() over (partition by user_id order by ts, event_id) as version, row_number() over (partition by user_id order by ts desc, event_id desc) = 1 as is_active from events where event_type = 'signup'
""")
def profile_versions(t: Tables) -> DataFrame:
    """Each save is a new version; the last one is active."""
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    saved = t.events.where("event_type = 'signup'").withColumn("version", F.row_number().over(by).cast("long"))
    return saved.select("user_id", F.col("event_id").alias("profile_id"), "version", (F.col("version") == F.max("version").over(W.partitionBy("user_id"))).alias("is_active"))


@query("""
with base as (select o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 7 as raw from orders where o_orderkey % 4 <> 0),
delta as (select o_orderkey, 'X' as o_orderstatus, o_totalprice + 1 as o_totalprice, o_orderkey % 5 as raw from orders where o_orderkey % 2 = 0)
select coalesce(b.o_orderkey, d.o_orderkey) as o_orderkey, case when d.o_orderkey is not null and (b.o_orderkey is null or d.raw >= b.raw) then d.o_orderstatus else b.o_orderstatus end as o_orderstatus,
  case when d.o_orderkey is not null and (b.o_orderkey is null or d.raw >= b.raw) then d.o_totalprice else b.o_totalprice end as o_totalprice,
  case when d.o_orderkey is not null and (b.o_orderkey is null or d.raw >= b.raw) then d.raw else b.raw end as raw from base b full join delta d on b.o_orderkey = d.o_orderkey
""")
def upsert_newest_wins(t: Tables) -> DataFrame:
    """A batch merged by key, twice (the second time changes nothing); an older document never overwrites a newer one."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = rows.where("o_orderkey % 4 <> 0").withColumn("raw", F.col("o_orderkey") % 7)
    delta = rows.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), (F.col("o_orderkey") % 5).alias("raw"))
    once = state.merge(base, delta, ["o_orderkey"], "raw")
    return state.merge(once, delta, ["o_orderkey"], "raw")


@query("select count(*) filter (where o_orderkey % 4 = 0) as inserted, count(*) filter (where o_orderkey % 4 <> 0) as updated from orders where o_orderkey % 2 = 0")
def upsert_report(t: Tables) -> DataFrame:
    """How many keys of the batch are new, and how many are stored already."""
    return state.upsert_counts(t.orders.where("o_orderkey % 4 <> 0"), t.orders.where("o_orderkey % 2 = 0"), ["o_orderkey"])


@query("select o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') as stored from orders where nullif(o_orderpriority, '4-NOT SPECIFIED') is distinct from '1-URGENT'")
def version_key_pending(t: Tables) -> DataFrame:
    """Rows to recompute: their stored key is missing or not the current one."""
    rows = t.orders.select("o_orderkey", F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("stored"))
    return state.pending(rows, "stored", F.lit("1-URGENT"))


@query("""
with h as (select o_custkey, sha256(string_agg(distinct o_orderkey::varchar, chr(10) order by o_orderkey::varchar) || chr(10)) as hash from orders group by 1),
b as (select o_custkey, sha256(string_agg(distinct o_orderkey::varchar, chr(10) order by o_orderkey::varchar) || chr(10)) as hash from orders where o_orderdate < timestamp '2001-06-01' group by 1)
select h.o_custkey, h.hash, h.hash is not distinct from b.hash as unchanged from h left join b using (o_custkey)
""")
def change_detect_hash(t: Tables) -> DataFrame:
    """Whether a board lists what it listed before, by an order-free hash of its ids."""
    now = t.orders.groupBy("o_custkey").agg(state.ids_hash(F.col("o_orderkey")).alias("hash"))
    before = t.orders.where(F.col("o_orderdate") < F.expr("timestamp_ntz'2001-06-01 00:00:00'")).groupBy("o_custkey").agg(state.ids_hash(F.col("o_orderkey")).alias("before"))
    return now.join(before, "o_custkey", "left").select("o_custkey", "hash", F.col("hash").eqNullSafe(F.col("before")).alias("unchanged"))


@query("""
with p as (select o_custkey, o_orderkey, case when o_orderstatus = 'O' then 'open' when o_orderstatus = 'F' then 'closed' else 'dead' end as status, o_orderkey % 2 as missing from orders),
l as (select distinct o_custkey, o_orderkey from orders where (o_custkey % 5 <> 0 and o_orderkey % 3 <> 0) or (o_custkey % 5 = 0 and o_orderkey % 40 = 0)),
b as (select p.o_custkey, count(*) filter (where status = 'open') as n_open, count(*) filter (where status = 'open' and l.o_orderkey is not null) as found, bool_or(l.o_orderkey is not null) as any_listed from p left join l on p.o_custkey = l.o_custkey and p.o_orderkey = l.o_orderkey group by 1),
x as (select p.*, l.o_orderkey is not null as listed, any_listed, n_open >= 5 and found < n_open * 0.2 as doubtful from p join b using (o_custkey) left join l on p.o_custkey = l.o_custkey and p.o_orderkey = l.o_orderkey),
y as (select *, any_listed and not doubtful and listed and status in ('open', 'closed') as here, any_listed and not doubtful and not listed and status = 'open' as missed from x)
select o_custkey, o_orderkey, case when here then 'open' when missed and missing + 1 >= 2 then 'closed' else status end as status, case when here then 0 when missed then missing + 1 else missing end as missing_polls, any_listed and doubtful as suspect from y
""")
def liveness_one_poll(t: Tables) -> DataFrame:
    """One poll of every board applied to its postings, with the guard against short lists."""
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("dead")
    prior = t.orders.select("o_custkey", "o_orderkey", status.alias("status"), (F.col("o_orderkey") % 2).alias("missing_polls"))
    listed = t.orders.where("(o_custkey % 5 <> 0 and o_orderkey % 3 <> 0) or (o_custkey % 5 = 0 and o_orderkey % 40 = 0)").select("o_custkey", "o_orderkey")
    return state.liveness(prior, listed, "o_custkey", "o_orderkey")


@query("""
with seen as (select distinct user_id as board, event_type as item, cast(ts as date) as day from events), f as (select board, item, min(day) as first from seen group by all), polls as (select distinct board, day from seen),
g as (select f.board, f.item, polls.day, s.day is not null as here from f join polls using (board) left join seen s on s.board = f.board and s.item = f.item and s.day = polls.day where polls.day >= first),
i as (select *, sum(here::int) over (partition by board, item order by day) as island from g),
m as (select board, item, day, sum((not here)::int) over (partition by board, item, island order by day) as missing from i)
select board, item, day, cast(missing as bigint) as missing_polls, case when missing >= 2 then 'closed' else 'open' end as status from m
""")
def liveness_over_polls(t: Tables) -> DataFrame:
    """A month of daily polls at once: misses in a row and status after each."""
    seen = t.events.select(F.col("user_id").alias("board"), F.col("event_type").alias("item"), F.to_date("ts").alias("day"))
    return state.misses_over_polls(seen.select("board", "day"), seen, "board", "item", "day")


@query("""
select s_suppkey, case when s_suppkey % 4 = 0 then 'active' when s_suppkey % 4 = 1 then 'blocked' when s_suppkey % 4 = 2 and s_nationkey % 5 + 1 >= 3 then 'dead' else 'quiet' end as status, case when s_suppkey % 4 = 0 then 0 else s_nationkey % 5 + 1 end as failures from supplier
""")
def board_state_machine(t: Tables) -> DataFrame:
    """Status and failures in a row of each board after a poll."""
    kind, before = F.col("s_suppkey") % 4, F.col("s_nationkey") % 5
    status = state.next_board_status(kind == 0, kind == 1, kind == 2, before, F.lit("quiet"))
    return t.supplier.select("s_suppkey", status.alias("status"), F.when(kind == 0, 0).otherwise(before + 1).alias("failures"))


@query("""
with c as (select o_custkey, count(*) filter (where o_orderdate < timestamp '1998-01-01') as before, count(*) filter (where o_orderdate >= timestamp '2001-01-01') as now from orders group by 1)
select o_custkey, before, now, before >= 10 and now < before * 0.2 as suspect from c
""")
def suspect_drop(t: Tables) -> DataFrame:
    """Boards whose list shrank too much to believe."""
    at = lambda s: F.expr(f"timestamp_ntz'{s} 00:00:00'")
    c = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") < at("1998-01-01")).alias("before"), F.count_if(F.col("o_orderdate") >= at("2001-01-01")).alias("now"))
    return c.withColumn("suspect", state.suspect_drop(F.col("now"), F.col("before")))


@query("select * from events where user_id not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def erase_user(t: Tables) -> DataFrame:
    """The event log without the events of erased users."""
    return state.erase(t.events, t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("select l_orderkey, l_returnflag as field, min(l_linenumber) as first_line, count(*) as filed from lineitem where l_quantity > 10 group by all")
def report_dedupe(t: Tables) -> DataFrame:
    """One open report per posting and field: the first."""
    return t.lineitem.where("l_quantity > 10").groupBy("l_orderkey", F.col("l_returnflag").alias("field")).agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("filed"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderdate end as checked from orders order by checked nulls first, o_orderkey limit 150")
def linkcheck_queue(t: Tables) -> DataFrame:
    """Links to check next: never checked ones, then the longest unchecked."""
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("checked")).orderBy(F.asc_nulls_first("checked"), "o_orderkey").limit(150)


@query("""
with s as (select p_partkey, p_size % 2 as before, case p_partkey % 5 when 0 then 404 when 1 then 410 when 2 then 200 when 3 then 301 else 503 end as code from part)
select p_partkey, case when code in (404, 410) then before + 1 when code between 200 and 399 then 0 else before end as checks, case when code in (404, 410) then before + 1 when code between 200 and 399 then 0 else before end >= 2 as dead from s
""")
def linkcheck_next(t: Tables) -> DataFrame:
    """Dead checks after a round of link checks."""
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, 404).when(k == 1, 410).when(k == 2, 200).when(k == 3, 301).otherwise(503)
    checks, dead = state.next_link_state(F.col("p_size") % 2, F.col("code"))
    return t.part.withColumn("code", code).select("p_partkey", checks.alias("checks"), dead.alias("dead"))


@query("""
with b as (select c_custkey, case c_mktsegment when 'BUILDING' then 'active' when 'AUTOMOBILE' then 'quiet' when 'MACHINERY' then 'blocked' else 'dead' end as status, case when c_custkey % 9 = 0 then null else timestamp '2024-01-31' - to_hours(c_custkey % 200) end as polled from customer)
select c_custkey, status from b where (status = 'active' and (polled is null or polled <= timestamp '2024-01-31' - interval 3 hour)) or (status = 'quiet' and polled <= timestamp '2024-01-31' - interval 48 hour)
  or (status = 'blocked' and polled <= timestamp '2024-01-31' - interval 6 hour) or (status = 'dead' and polled <= timestamp '2024-01-31' - interval 7 day)
""")
def due_boards(t: Tables) -> DataFrame:
    """Boards to poll now: each status has its own cadence, and of those never polled only active ones are due."""
    from loomfield.sources.boards import due

    status = F.when(F.col("c_mktsegment") == "BUILDING", "active").when(F.col("c_mktsegment") == "AUTOMOBILE", "quiet").when(F.col("c_mktsegment") == "MACHINERY", "blocked").otherwise("dead")
    now = F.expr(EVENTS_AS_OF)
    polled = F.when(F.col("c_custkey") % 9 != 0, now - F.expr("make_dt_interval(0, cast(c_custkey % 200 as int))"))
    return t.customer.select("c_custkey", status.alias("status"), polled.alias("polled")).where(due(F.col("status"), F.col("polled"), now)).select("c_custkey", "status")


@query(f"""
select cast({crc32_sql('s_suppkey::varchar')} % 8 as integer) as shard, count(*) as boards, min(s_suppkey) as first from supplier group by 1
""")
def shard_histogram(t: Tables) -> DataFrame:
    """Boards by shard."""
    from loomfield.sources.boards import shard_of

    return t.supplier.groupBy(shard_of(F.col("s_suppkey"), 8).alias("shard")).agg(F.count("*").alias("boards"), F.min("s_suppkey").alias("first"))


@query("select e.event_id, c_name, o_orderkey, o_orderstatus from (select *, user_id as app from events where event_type = 'purchase') e left join customer on e.app = c_custkey left join (select max(o_orderkey) as o_orderkey, o_custkey, max(o_orderstatus) as o_orderstatus from orders where o_orderpriority = '1-URGENT' group by o_custkey) o on e.app = o.o_custkey")
def applications_joined(t: Tables) -> DataFrame:
    """Applications with their company and posting; both may be missing."""
    posting = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_orderstatus").alias("o_orderstatus"))
    apps = t.events.where("event_type = 'purchase'")
    return apps.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").join(posting, F.col("user_id") == F.col("o_custkey"), "left").select("event_id", "c_name", "o_orderkey", "o_orderstatus")


@query("""
select l_orderkey, l_linenumber, s_suppkey, s_name from lineitem left join supplier on (s_nationkey = l_linenumber or (l_linenumber in (1, 2) and s_nationkey = 24)) and s_suppkey = l_suppkey where l_quantity >= 49
""")
def raw_documents_boards(t: Tables) -> DataFrame:
    """Documents with their board: an OR over the board kind becomes one derived equi key and a union of two kinds."""
    docs = t.lineitem.where("l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_suppkey")
    kinds = F.array_distinct(F.array_compact(F.array(F.col("l_linenumber"), F.when(F.col("l_linenumber").isin(1, 2), F.lit(24)))))
    boards = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return docs.withColumn("kinds", kinds).join(boards, (F.col("s_suppkey") == F.col("l_suppkey")) & F.array_contains("kinds", F.col("s_nationkey")), "left").select("l_orderkey", "l_linenumber", "s_suppkey", "s_name")


@query("""
with first as (select regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as name, min(p_partkey) as first_id from part group by 1)
select p_partkey, first_id from part join first on regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') = name
""")
def first_match_lookup(t: Tables) -> DataFrame:
    """Each row with the first id of its normalised name."""
    from loomfield.functions.text import normalize_company

    named = t.part.select("p_partkey", normalize_company(F.col("p_name")).alias("name"))
    return named.join(named.groupBy("name").agg(F.min("p_partkey").alias("first_id")), "name").select("p_partkey", "first_id")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select user_id from events where event_type = 'signup') and o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def saved_postings(t: Tables) -> DataFrame:
    """Postings of users in one list and not in another: semi and anti joins on keys without nulls."""
    saved = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("o_custkey"))
    return t.orders.join(saved, "o_custkey", "left_semi").join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""
with a as (select event_type as source, cast(ts as date) as date, count(*) as fetched, cast(trunc(median(value)) as int) as p50 from events where event_id % 2 = 0 group by all), b as (select event_type as source, cast(ts as date) as date, count(*) as fetched, cast(trunc(median(value)) as int) as p50 from events where event_id % 2 = 1 group by all)
select coalesce(a.source, b.source) as source, coalesce(a.date, b.date) as date, coalesce(a.fetched, 0) + coalesce(b.fetched, 0) as fetched, coalesce(b.p50, a.p50) as p50 from a full join b on a.source = b.source and a.date = b.date
""")
def source_health_daily(t: Tables) -> DataFrame:
    """Daily counters of two runs added up, and the median of the last run that has one."""
    run = lambda k: t.events.where(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("date")).agg(F.count("*").alias("fetched"), F.median("value").cast("int").alias("p50"))
    return state.accumulate(run(0), run(1), ["source", "date"], ["fetched"], ["p50"])


@query("""
select user_id, case when count(*) filter (where event_type <> 'error') = 0 then 'failed' when bool_or(event_type = 'error') then 'degraded' else 'ok' end as status, count(*) as tasks from events group by user_id
""")
def run_status(t: Tables) -> DataFrame:
    """Status of each run: nothing succeeded, something failed, or all well."""
    failed = F.col("event_type") == "error"
    status = F.when(F.count_if(~failed) == 0, "failed").when(F.bool_or(failed), "degraded").otherwise("ok")
    return t.events.groupBy("user_id").agg(status.alias("status"), F.count("*").alias("tasks"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, max(cast(json_extract_string(props, '$.k') as int)) as most from events group by event_type")
def json_props(t: Tables) -> DataFrame:
    """Aggregates of a JSON field, read leniently: what is no JSON is null."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k.cast("int")).alias("most"))


@query("""
select case when count(distinct o_orderkey) = count(*) then 0 else 1 end as order_keys, count(*) filter (where o_custkey not in (select c_custkey from customer)) as orphans, count(*) filter (where o_orderstatus not in ('O', 'F', 'P')) as bad_status from orders
""")
def constraint_report(t: Tables) -> DataFrame:
    """Uniqueness, foreign keys and checks as counts of what breaks them."""
    known = t.customer.select("c_custkey", F.lit(True).alias("known"))
    rows = t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.agg(
        F.when(F.count_distinct("o_orderkey") == F.count("*"), 0).otherwise(1).alias("order_keys"), F.count_if(F.col("known").isNull() & F.col("o_custkey").isNotNull()).alias("orphans"), F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")).alias("bad_status")
    )
