"""Boards, reports, saved data and single postings: the queries behind the pages of one user and of one posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import evaluation, scoring, state
from loomfield.registry import Tables, query
from loomfield.sources import boards

ORDERS_AS_OF = "timestamp_ntz'2001-08-02 00:00:00'"


@query("""
select s_suppkey, s_name, last_poll, coalesce(failures, 0) as failures from supplier
left join (select user_id, max(ts) as last_poll, count(*) filter (where event_type = 'error') as failures from events group by user_id) p on s_suppkey = user_id
where s_suppkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
""")
def boards_with_poll_state(t: Tables) -> DataFrame:
    """Boards of a list with the state of their polls, those never polled too."""
    polls = t.events.groupBy(F.col("user_id").alias("s_suppkey")).agg(F.max("ts").alias("last_poll"), F.count_if(F.col("event_type") == "error").alias("failures"))
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("s_suppkey"))
    rows = t.supplier.select("s_suppkey", "s_name").join(wanted, "s_suppkey", "left_semi").join(polls, "s_suppkey", "left")
    return rows.select("s_suppkey", "s_name", "last_poll", F.coalesce("failures", F.lit(0)).alias("failures"))


@query(r"""
with r as (select event_id, event_id as ref, ts, case event_id % 3 when 0 then 'field=pay; too ' || event_type when 1 then 'field=place;' else 'seen ' || event_type end as reason from events where event_type = 'error' and value < 50)
select event_id, ref, ts, coalesce(o_orderpriority, '(job removed)') as title, c_name as company, case when regexp_matches(reason, '^field=[a-z]+;') then regexp_extract(reason, '^field=([a-z]+);', 1) else 'other' end as field,
  regexp_replace(reason, '^field=[a-z]+;\s*', '') as note
from r left join orders on ref = o_orderkey left join customer on o_custkey = c_custkey order by ts desc, event_id desc limit 20
""")
def open_reports(t: Tables) -> DataFrame:
    """The twenty newest open reports with the posting and company they are about, where these still exist."""
    k = F.col("event_id") % 3
    reason = F.when(k == 0, F.concat(F.lit("field=pay; too "), F.col("event_type"))).when(k == 1, F.lit("field=place;")).otherwise(F.concat(F.lit("seen "), F.col("event_type")))
    reports = t.events.where("event_type = 'error' and value < 50").select("event_id", F.col("event_id").alias("ref"), "ts", reason.alias("reason"))
    rows = reports.join(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("ref") == F.col("o_orderkey"), "left").join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    field, note = tx.report_parts(F.col("reason"))
    shown = rows.select("event_id", "ref", "ts", F.coalesce("o_orderpriority", F.lit("(job removed)")).alias("title"), F.col("c_name").alias("company"), field.alias("field"), note.alias("note"))
    return shown.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("""
select o_orderkey, o_orderstatus, o_totalprice, c_name, coalesce((select string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) from lineitem where l_orderkey = 7), '') as skills
from orders left join customer on o_custkey = c_custkey where o_orderkey = 7
""")
def posting_detail(t: Tables) -> DataFrame:
    """One posting by its key, with its company and its skills; the key is pushed down to each scan."""
    skills = t.lineitem.where("l_orderkey = 7").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("skills"))
    one = t.orders.where("o_orderkey = 7").join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return one.join(skills, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "o_totalprice", "c_name", F.coalesce("skills", F.lit("")).alias("skills"))


@query("""
select (select count(*) from supplier) as boards, (select count(*) from orders where o_orderstatus = 'O') as open_postings,
  (select count(*) from supplier where s_suppkey % 9 = 0) as never_polled, (select count(*) from supplier where s_acctbal < 0) as problem_boards
""")
def source_totals(t: Tables) -> DataFrame:
    """Four totals of two tables: each table is counted in one pass, and the two rows are added up."""
    zero = F.lit(0).cast("long")
    own = t.supplier.agg(F.count("*").alias("boards"), zero.alias("open_postings"), F.count_if(F.col("s_suppkey") % 9 == 0).alias("never_polled"), F.count_if(F.col("s_acctbal") < 0).alias("problem_boards"))
    other = t.orders.agg(zero.alias("boards"), F.count_if(F.col("o_orderstatus") == "O").alias("open_postings"), zero.alias("never_polled"), zero.alias("problem_boards"))
    return own.unionByName(other).agg(*[F.sum(c).alias(c) for c in own.columns])


@query("""
select o_orderkey, c_name, o_orderdate from orders left join customer on o_custkey = c_custkey
where o_orderstatus = 'O' and c_mktsegment is distinct from 'MACHINERY' and o_orderdate >= timestamp '2001-08-02' - interval 400 day and o_totalprice > 1000
order by o_orderdate desc, case when o_orderkey % 4 = 0 then null else o_totalprice end desc nulls last, o_orderkey desc limit 5
""")
def today_top5(t: Tables) -> DataFrame:
    """The five postings seen last, those without a posting date behind the others of their time."""
    fresh = t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.expr(f"{ORDERS_AS_OF} - make_dt_interval(400)")) & (F.col("o_totalprice") > 1000))
    rows = fresh.join(t.customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left").where(~F.col("c_mktsegment").eqNullSafe("MACHINERY"))
    posted = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice"))
    return rows.orderBy(F.desc("o_orderdate"), F.desc_nulls_last(posted), F.desc("o_orderkey")).limit(5).select("o_orderkey", "c_name", "o_orderdate")


@query("""
with c as (select c_custkey, case c_custkey % 4 when 0 then 'remote' when 1 then 'onsite' end as mode, case when c_custkey % 7 = 0 then null else n_name end as place, r_name as country from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select c_custkey, cast(case when mode = 'remote' then 10 when place is null then null when contains(lower(place), 'japan') or contains(lower(place), 'nation_3') or contains(lower(place), 'germany') then 10 when country = 'ASIA' then 6 else 0 end as double) as open_to_remote,
  cast(case when mode = 'remote' then 0 when place is null then null when contains(lower(place), 'japan') or contains(lower(place), 'nation_3') or contains(lower(place), 'germany') then 10 when country = 'ASIA' then 6 else 0 end as double) as not_open from c
""")
def place_points(t: Tables) -> DataFrame:
    """Points for the place of a posting, for a profile that is open to remote work and one that is not."""
    where = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t.customer.join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    places = F.when(F.col("c_custkey") % 7 != 0, F.array(F.struct(F.col("n_name").alias("raw"), F.col("r_name").alias("country"))))
    mode = F.when(k == 0, "remote").when(k == 1, "onsite")
    points = lambda remote: scoring.place_points(mode, places, remote, ["Germany", "japan", "Nation_3"], ["ASIA"])
    return rows.select("c_custkey", points(True).alias("open_to_remote"), points(False).alias("not_open"))


@query("""select event_id, sha256('{"a":{"b":[1,null],"c":"' || event_type || '"},"k":' || json_extract_string(props, '$.k') || '}') as hash from events""")
def payload_hashes(t: Tables) -> DataFrame:
    """Digests of payloads that do not depend on the order of their keys."""
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"k": '), k, F.lit(', "a": {"c": "'), F.col("event_type"), F.lit('", "b": [1, null]}}'))
    two = F.concat(F.lit('{"a":{"b":[1,null],"c":"'), F.col("event_type"), F.lit('"},"k":'), k, F.lit("}"))
    return t.events.select("event_id", tx.payload_hash(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("hash"))


@query("""
select distinct 'agg-jobs-' || lower(p_brand) as slug from part where 'agg-jobs-' || lower(p_brand) not in (select 'agg-jobs-' || lower(p_brand) from part where p_size > 48)
""")
def missing_pseudo_boards(t: Tables) -> DataFrame:
    """Pseudo-boards to add: saved queries that no board stands for yet."""
    stored = t.part.where("p_size > 48").select(boards.pseudo_slug(F.lit("jobs"), F.lower("p_brand")).alias("slug"))
    return boards.missing_boards(t.part.select(F.lower("p_brand").alias("name")), stored, F.lit("jobs"))


@query("""
with l as (select doc_id, doc_id % 5 = 0 as holdout from labels where doc_id % 11 <> 0), p as (select doc_id from documents where doc_id % 13 <> 0)
select case when holdout then 'holdout' else 'dev' end as split, count(*) filter (where p.doc_id is not null) as joined, count(*) filter (where p.doc_id is null) as without_posting from l left join p using (doc_id) group by all
""")
def gold_join(t: Tables) -> DataFrame:
    """Labels joined with what they label, by split; a label without its posting is an orphan."""
    labels = t.labels.where("doc_id % 11 <> 0").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev"))
    both, orphans, _ = evaluation.load_gold(labels, t.documents.where("doc_id % 13 <> 0").select("doc_id", "text"), "doc_id")
    found = both.groupBy("split").agg(F.count("*").alias("joined"))
    return found.join(orphans.groupBy("split").agg(F.count("*").alias("without_posting")), "split", "full_outer").select("split", F.coalesce("joined", F.lit(0)).alias("joined"), F.coalesce("without_posting", F.lit(0)).alias("without_posting"))


@query("select p_name as term, count(distinct p_brand) as n_ids, min(p_brand) as first_id from part group by p_name having count(distinct p_brand) > 1")
def contested_terms(t: Tables) -> DataFrame:
    """Terms of a dictionary that more than one id claims."""
    return evaluation.contested_terms(t.part.select(F.col("p_name").alias("term"), F.col("p_brand").alias("id")))


@query("""
with x as (select event_id, ts, event_type from events)
select event_id, case when event_id % 4 < 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((millisecond(ts) % 1000)::varchar, 3, '0') || 'Z' end as at,
  case event_id % 4 when 0 then event_type when 1 then event_type || '|Pune' else '' end as places from x
""")
def tolerant_reading(t: Tables) -> DataFrame:
    """Times and places read from stored strings; what is not readable is null or empty, never an error."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    at = F.when(k < 3, F.col("ts").cast("string")).otherwise("soon")
    stored = F.when(k == 0, F.concat(F.lit('[{"raw": "'), kind, F.lit('"}, {"raw": " "}]'))).when(k == 1, F.concat(F.lit('["'), kind, F.lit('", {"raw": "Pune", "city": "Pune"}, 7]'))).when(k == 2, F.lit("{broken"))
    return t.events.select("event_id", tx.to_iso(at).alias("at"), F.array_join(F.transform(tx.to_locations(stored), lambda x: x["raw"]), "|").alias("places"))


@query("""
with p as (select o_custkey, o_orderkey, case when o_orderstatus = 'O' then 'open' else 'closed' end as status, o_orderkey % 2 as missing from orders where o_orderkey % 3 = 0),
l as (select o_custkey, o_orderkey from p where o_custkey % 4 = 0), polled as (select c_custkey from customer where c_custkey % 2 = 0),
b as (select p.o_custkey, count(*) filter (where status = 'open') as n_open, count(*) filter (where status = 'open' and l.o_orderkey is not null) as found from p left join l using (o_custkey, o_orderkey) group by 1),
x as (select p.*, l.o_orderkey is not null as listed, c_custkey is not null as polled, n_open >= 5 and found < n_open * 0.2 as doubtful from p join b using (o_custkey) left join l using (o_custkey, o_orderkey) left join polled on p.o_custkey = c_custkey)
select o_custkey, o_orderkey, case when polled and not doubtful and listed then 'open' when polled and not doubtful and not listed and status = 'open' and missing + 1 >= 2 then 'closed' else status end as status,
  case when polled and not doubtful and listed then 0 when polled and not doubtful and not listed and status = 'open' then missing + 1 else missing end as missing_polls, polled and doubtful as suspect from x
""")
def liveness_empty_polls(t: Tables) -> DataFrame:
    """A poll of boards of which some list nothing: their last postings miss it too."""
    prior = t.orders.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), (F.col("o_orderkey") % 2).alias("missing_polls"))
    polled = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return state.liveness(prior, prior.where("o_custkey % 4 = 0").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", polled)


@query("""
with recursive p as (select o_custkey % 100 as board, year(o_orderdate) * 4 + quarter(o_orderdate) as nth, list_sort(list_distinct(list(o_orderkey % 40))) as items from orders group by all),
n as (select *, row_number() over (partition by board order by nth) as k from p),
steps(board, k, state, suspects) as (
  select distinct board, 0::bigint, cast([] as struct(item bigint, misses bigint)[]), 0::bigint from p
  union all
  select board, k, if(bad, state, list_concat(list_transform(state, lambda x: {'item': x.item, 'misses': if(list_contains(items, x.item), 0::bigint, least(x.misses + 1, 2))}),
      list_transform(list_filter(items, lambda i: not list_contains(list_transform(state, lambda y: y.item), i)), lambda i: {'item': i, 'misses': 0::bigint}))), suspects + bad::int
  from (select n.board, n.k, s.state, n.items, s.suspects, len(list_filter(s.state, lambda x: x.misses < 2)) >= 5
      and len(list_filter(s.state, lambda x: x.misses < 2 and list_contains(n.items, x.item))) < 0.2 * len(list_filter(s.state, lambda x: x.misses < 2)) as bad from steps s join n on n.board = s.board and n.k = s.k + 1)),
ends as (select board, suspects, unnest(state) as x from steps where (board, k) in (select (board, max(k)) from n group by board))
select board, x.item as item, if(x.misses < 2, 'open', 'closed') as status, x.misses as missing_polls, suspects from ends
""")
def liveness_guarded_polls(t: Tables) -> DataFrame:
    """Quarterly polls of a hundred boards, applied in order with the guard: status and misses of every item, and how many polls
    of its board were not believed."""
    listed = t.orders.select((F.col("o_custkey") % 100).alias("board"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("at"), (F.col("o_orderkey") % 40).alias("item"))
    return state.fold_polls(listed, "board", "item", "at").select("board", "item", "status", "missing_polls", "suspects")


_PAGES = """
b as (select o_custkey as board, 90 + 13 * count(*) as total from orders group by o_custkey),
f as (select board, total, unnest(range(0, total, 100)) as start from b),
g as (select board, start, least(100, total - start) - if(board % 7 = 3 and start + 100 >= total, 1, 0) as size, if(start = 0, total, null) as total,
    case when board % 7 = 4 and start = 100 then 500 when board % 7 = 5 and start = 0 then 404 else 200 end as http_status from f where not (board % 7 = 1 and start = 100)
  union all select board, 50, 40, null, 200 from b where board % 7 = 2)
"""


@query(f"""
with {_PAGES},
p as (select distinct board, unnest(range(start, start + size)) as place from g where http_status = 200),
c as (select board, count(*) as n, max(place) + 1 as reach from p group by board),
x as (select board, max(total) as total, bool_or(http_status <> 200) as bad, arg_min(http_status, start) as first from g group by board)
select board, case when first = 404 then 'dead' when bad or n < reach or n < total then 'degraded' else 'ok' end as status, coalesce(n, 0) as n, total from x left join c using (board)
""")
def page_chains(t: Tables) -> DataFrame:
    """Polls of a board for each customer, in pages of a hundred: some with a hole, a page twice, a short last page, a failure or a
    dead board. Which lists are whole, and how many rows they cover; the SQL looks at every row's place."""
    b = t.orders.groupBy(F.col("o_custkey").alias("board")).agg((90 + 13 * F.count("*")).alias("all"))
    k, last = F.col("board") % 7, F.col("start") + 100 >= F.col("all")
    p = b.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(100).cast("long")))).where(~((k == 1) & (F.col("start") == 100)))
    p = p.select(
        "board", "start", (F.least(F.lit(100), F.col("all") - F.col("start")) - F.when((k == 3) & last, 1).otherwise(0)).alias("size"), F.when(F.col("start") == 0, F.col("all")).alias("total"),
        F.when((k == 4) & (F.col("start") == 100), 500).when((k == 5) & (F.col("start") == 0), 404).otherwise(200).alias("http_status"),
    )
    again = b.where(k == 2).select("board", F.lit(50).cast("long").alias("start"), F.lit(40).cast("long").alias("size"), F.lit(None).cast("long").alias("total"), F.lit(200).alias("http_status"))
    return boards.offset_chains(p.unionByName(again), "board").select("board", "status", "n", "total")
