"""Queries over texts, pages, labels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomfield.functions import decisions, geo
from loomfield.functions import html as hx
from loomfield.functions import text as tx
from loomfield.registry import Tables, query


@query(r"""
select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (C++ / Node.js) #' || p_brand), '[^\w\s+#.]', ' ', 'g'), '\s+', ' ', 'g')) as title, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') as company,
  case when instr(p_type || '/' || p_name, '/') > 0 then p_name else p_type end as source_id from part
""")
def normalize_titles(t: Tables) -> DataFrame:
    """Normalised titles, company names and source ids."""
    key = F.concat_ws("/", "p_type", "p_name")
    title = tx.normalize_title(F.concat(F.col("p_name"), F.lit(" (C++ / Node.js) #"), F.col("p_brand")))
    return t.part.select("p_partkey", title.alias("title"), tx.normalize_company(F.col("p_brand")).alias("company"), tx.split_source_id(key).alias("source_id"))


def _family_sql(column: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '(?i){p}') then '{f}'" for f, p in decisions.ROLE_RULES_PORTABLE) + " else 'other' end"


@query(f"""
with x as (select p_partkey, case p_partkey % 9 when 0 then 'Data Entry ' when 1 then 'Senior Data Engineer ' when 2 then 'Sales Engineer ' when 3 then 'Product Manager ' when 4 then 'QA Tester ' when 5 then 'Backend Developer ' when 6 then 'Recruiter ' when 7 then 'Payroll ' else '' end || p_name as title from part)
select p_partkey, {_family_sql('title')} as family from x
""")
def title_family(t: Tables) -> DataFrame:
    """Role family of titles by the first rule that matches."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Data Entry ", "Senior Data Engineer ", "Sales Engineer ", "Product Manager ", "QA Tester ", "Backend Developer ", "Recruiter ", "Payroll ", "")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t.part.select("p_partkey", decisions.role_family(F.concat(lead, F.col("p_name"))).alias("family"))


@query("""
with n as (select n_nationkey, n_name, case r_name when 'ASIA' then 'apac' when 'EUROPE' then 'eu' when 'AMERICA' then 'north america' when 'MIDDLE EAST' then 'emea' else 'africa' end as scope from nation join region on n_regionkey = r_regionkey)
select c_custkey, scope, scope = 'apac' as india, scope in ('eu', 'emea') as germany from customer join n on c_nationkey = n_nationkey
""")
def country_regions(t: Tables) -> DataFrame:
    """Region scopes expanded to countries, and who is in them."""
    scope = F.when(F.col("r_name") == "ASIA", "apac").when(F.col("r_name") == "EUROPE", "eu").when(F.col("r_name") == "AMERICA", "north america").when(F.col("r_name") == "MIDDLE EAST", "emea").otherwise("africa")
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", scope.alias("scope"))
    rows = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("countries", geo.expand_regions(F.array("scope")))
    return rows.select("c_custkey", "scope", F.array_contains("countries", "IN").alias("india"), F.array_contains("countries", "DE").alias("germany"))


_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"


@query(rf"""
with w as (select doc_id, lang, regexp_extract_all(coalesce(text, ''), '\p{{L}}+') as w from documents),
c as (select doc_id, lang, len(w) as words, length(array_to_string(w, '')) as letters, length(regexp_replace(array_to_string(w, ''), '[\x{{0000}}-\x{{024F}}]', '', 'g')) as other,
  len(list_filter(w, lambda x: lower(x) in {_LIST(tx.STOPWORDS)})) as en, len(list_filter(w, lambda x: lower(x) in {_LIST(tx.FOREIGN_WORDS)})) as fo from w)
select lang, (letters >= 80 and other / greatest(letters, 1) > 0.3) or (words >= 15 and en / greatest(words, 1) < 0.08 and fo / greatest(words, 1) >= 0.15) or (words >= 60 and en / greatest(words, 1) < 0.12) as foreign_text, count(*) as n from c group by all
""")
def non_english(t: Tables) -> DataFrame:
    """Documents judged to be in another language, against their stated one."""
    counts = tx.language_counts(F.col("text"))
    rows = t.spread("documents", "doc_id", "doc_id", "lang", "text").select("lang", *[c.alias(k) for k, c in counts.items()])
    return rows.select("lang", tx.is_non_english(*[F.col(k) for k in counts]).alias("foreign_text")).groupBy("lang", "foreign_text").agg(F.count("*").alias("n"))


@query(r"""
with a as (select doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g') as r from documents), b as (select doc_id, text, regexp_replace(r, '(?i)Bearer\s+[A-Za-z0-9._\-~+/=]+', 'Bearer [REDACTED]', 'g') as r from a),
c as (select doc_id, text, regexp_replace(r, '(?i)([?&](?:token|key|secret|auth)[^=]*=)[^\s&;]+', '\1[REDACTED]', 'g') as r from b), d as (select doc_id, text, regexp_replace(r, '(?i)(token|api[_-]?key|secret|auth)\s*=\s*[^\s&;]+', '[REDACTED]', 'g') as r from c)
select doc_id, r <> text as changed, md5(r) as digest from d
""")
def redact_docs(t: Tables) -> DataFrame:
    """Documents after redaction of addresses and tokens."""
    return t.spread("documents", "doc_id", "doc_id", "text").select("doc_id", "text", tx.redact(F.col("text")).alias("r")).select("doc_id", (F.col("r") != F.col("text")).alias("changed"), F.md5("r").alias("digest"))


@query("select md5(text) as digest, count(*) as n, min(doc_id) as first_id, max(doc_id) as newest_id from documents group by 1 having count(*) > 1")
def exact_dup_docs(t: Tables) -> DataFrame:
    """Groups of documents with the same text."""
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("newest_id")).where("n > 1")


@query("""
with x as (select o_orderkey, cast(date_diff('day', cast(o_orderdate as date), date '2001-08-02') as bigint) as days, case when o_orderkey % 5 = 0 then null else o_totalprice * 10 end as low, case when o_orderkey % 7 = 0 then null else o_totalprice * 12 end as high from orders),
f as (select *, regexp_replace(regexp_replace(format('{:.2f}', round(low / 100000, 2)), '0+$', ''), '\\.$', '') as l, regexp_replace(regexp_replace(format('{:.2f}', round(high / 100000, 2)), '0+$', ''), '\\.$', '') as h from x)
select o_orderkey, case when days <= 0 then 'today' when days < 14 then days || 'd ago' when days < 60 then (days // 7) || 'w ago' else (days // 30) || 'mo ago' end as posted,
  case when low is not null and high is not null and low <> high then '₹' || l || '–' || h || ' LPA' when low is not null and high is null then 'from ₹' || l || ' LPA' when low is null and high is not null then 'up to ₹' || h || ' LPA' when low is not null then '₹' || l || ' LPA' end as pay from f
""")
def format_postings(t: Tables) -> DataFrame:
    """Posting date and pay as the feed shows them. Days are counted between dates, whatever the time of day of an order."""
    low = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") * 10)
    high = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") * 12)
    return t.orders.select("o_orderkey", tx.format_posted(F.date_trunc("day", "o_orderdate"), F.expr("timestamp_ntz'2001-08-02 00:00:00'")).alias("posted"), tx.format_lakh(low, high).alias("pay"))


@query(r"""
with u as (select page_id, case page_id % 4 when 0 then url when 1 then 'javascript:alert(1)' when 2 then replace(url, 'https', 'HTTP') else 'ftp://' || url end as url from pages)
select page_id, case when regexp_matches(url, '^(?i:https?)://[^/?#\s]+') then url end as safe, regexp_extract(case when regexp_matches(url, '^(?i:https?)://[^/?#\s]+') then lower(url) end, '^https?://([^/?#\s:]+)', 1) as host from u
""")
def safe_urls(t: Tables) -> DataFrame:
    """Links that are safe to show, and their hosts."""
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, "javascript:alert(1)").when(k == 2, F.replace("url", F.lit("https"), F.lit("HTTP"))).otherwise(F.concat(F.lit("ftp://"), F.col("url")))
    safe = tx.safe_http_url(url)
    return t.pages.select("page_id", safe.alias("safe"), F.regexp_extract(F.lower(safe), r"^https?://([^/?#\s:]+)", 1).alias("host"))


@query()
def page_text(t: Tables) -> DataFrame:
    """Plain text of each page."""
    return t.pages.select("page_id", hx.html_to_text(F.col("html"), most=None).alias("text")).select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(r"""
with h as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as host, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as word from pages),
l as (select distinct page_id, rtrim(host || '/jobs/' || word, '/') as link from h where rtrim(word, '/') <> '')
select * from l where not regexp_matches(link, '(?i)/(saved|login|sign-?in|account|search|alerts?|talent-?community|benefits|culture|life-?at)\b') and not regexp_matches(link, '(?i)\.(png|jpe?g|gif|svg|webp|pdf|css|js|ico|zip|xml|json)$')
""")
def page_links(t: Tables) -> DataFrame:
    """Links of each page that look like job postings of its host: the pages' own links, moved below /jobs/."""
    html = F.regexp_replace("html", 'href="/', 'href="/jobs/')
    return t.pages.select("page_id", F.explode(hx.job_links(F.col("url"), html, most=None)).alias("link"))


@query(r"""
select page_id, 'Job ' || page_id as title, regexp_extract(url, '^https?://([^/?#]+)', 1) as company, timestamp '2026-01-05 00:00:00' as posted_at, timestamp '2026-03-01 23:59:59' + interval 1 day * (page_id % 9) as deadline_at,
  if(page_id % 2 = 0, 'FULL_TIME,OTHER', 'PART_TIME') as employment_type, if(page_id % 3 = 0, 'remote', null) as remote_type, 'City ' || page_id % 5 as city, 'IN' as country,
  cast(case when page_id % 2 = 0 then 120 * page_id * (52 / 12) else 120 * page_id end as double) as pay_min, cast(case when page_id % 2 = 0 then 240 * page_id * (52 / 12) else 240 * page_id end as double) as pay_max, 'USD' as pay_currency, 'month' as pay_period, 'Host ' || page_id as description
from pages
""")
def page_job_postings(t: Tables) -> DataFrame:
    """Structured job postings of each page, mapped to fields: every page has one put behind its own markup, alone or in a graph
    beside another kind, with trailing commas and comments."""
    from loomfield.functions import jsonld

    even = F.col("page_id") % 2 == 0
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    node = text(
        '{"@type":"JobPosting","title":"Job ', F.col("page_id"), '","hiringOrganization":{"name":"', F.regexp_extract("url", "^https?://([^/?#]+)", 1), '"},"datePosted":"2026-01-05","validThrough":"', F.date_format(F.expr("date_add(date'2026-03-01', cast(page_id % 9 as int))"), "yyyy-MM-dd"),
        '","employmentType":', F.when(even, '["FULL_TIME","odd kind"]').otherwise('"PART TIME"'), F.when(F.col("page_id") % 3 == 0, ',"jobLocationType":"TELECOMMUTE"').otherwise(""), ',"jobLocation":[{"address":{"addressLocality":"City ', F.col("page_id") % 5, '","addressCountry":"IN"}}],',
        '"baseSalary":{"currency":"usd","value":{"minValue":', F.col("page_id") * 120, ',"maxValue":', F.col("page_id") * 240, ',"unitText":"', F.when(even, "WEEK").otherwise("MONTH"), '"}},"description":"Host ', F.col("page_id"), '",}',
    )
    block = F.when(even, text('/* two */ {"@graph":[{"@type":"Organization"},', node, "]}")).otherwise(node)
    html = text(F.col("html"), '<script type="application/ld+json">', block, "</script>")
    return jsonld.postings(t.pages.select("page_id", html.alias("html")), "page_id", "html")


@query(r"""
with p as (select d.doc_id, d.doc_id % 5 = 0 as holdout, regexp_matches(text, '[#*$%&]{3}|!!') as low, regexp_matches(text, '(?i)\b(idiot|moron|clown|worthless)\b') as rude, quality, toxic from documents d join labels using (doc_id)),
m as (select case when holdout then 'holdout' else 'dev' end as split, 'low_quality' as metric, low as predicted, quality = 0 as gold from p union all select case when holdout then 'holdout' else 'dev' end, 'toxic', rude, toxic = 1 from p)
select split, metric, count(*) filter (where predicted) as predicted, count(*) filter (where predicted and gold) as hits, count(*) filter (where gold) as gold, round(count(*) filter (where predicted and gold) / nullif(count(*) filter (where predicted), 0), 6) as precision,
  round(count(*) filter (where predicted and gold) / nullif(count(*) filter (where gold), 0), 6) as recall, count(*) filter (where predicted) >= 5 and count(*) filter (where predicted and gold) / nullif(count(*) filter (where predicted), 0) < 0.9 as below_floor from m group by all
""")
def eval_metrics(t: Tables) -> DataFrame:
    """Precision and recall of two text rules against labels, by split."""
    from loomfield.operators.evaluation import metrics

    rows = t.documents.join(t.labels, "doc_id").select(
        F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev").alias("split"),
        F.col("text").rlike(r"[#*$%&]{3}|!!").alias("low"), F.col("text").rlike(r"(?i)\b(idiot|moron|clown|worthless)\b").alias("rude"), (F.col("quality") == 0).alias("low_gold"), (F.col("toxic") == 1).alias("rude_gold"),
    )
    return metrics(rows, "split", {"low_quality": ("low", "low_gold"), "toxic": ("rude", "rude_gold")}, floor=0.9, least=5)


@query("""
with s as (select b.label, b.vec_id as probe, e.vec_id, round(list_cosine_similarity(e.embedding::double[], b.embedding::double[]), 6) as cosine from (select label, arg_min(embedding, vec_id) as embedding, min(vec_id) as vec_id from embeddings group by label) b join embeddings e on e.label = b.label and e.vec_id <> b.vec_id)
select * from (select *, row_number() over (partition by label order by cosine desc, vec_id) as rank from s) where rank <= 5
""")
def vector_topk(t: Tables) -> DataFrame:
    """The five most similar vectors of each label's first vector, by cosine."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    probes = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("p")).select("label", F.col("p.vec_id").alias("probe"), F.col("p.v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = e.join(probes, "label").where("vec_id <> probe").withColumn("cosine", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 6))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("cosine"), "vec_id")).cast("long")).where("rank <= 5").select("label", "probe", "vec_id", "cosine", "rank")


@query(r"""
with d as (select doc_id, case doc_id % 3 when 0 then text when 1 then replace(text, chr(10), chr(10) || chr(10)) else '- ' || replace(text, chr(10), chr(10) || '- ') end as text from documents),
p as (select doc_id, unnest(string_split_regex(text, '\n{2,}')) as part, generate_subscripts(string_split_regex(text, '\n{2,}'), 1) as nth from d),
l as (select doc_id, nth, list_filter(string_split(part, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '') as lines from p),
k as (select doc_id, nth, case when list_aggregate(list_transform(lines, lambda x: regexp_matches(x, '^\s*[-*•·]\s+')), 'bool_and') then 'list'
    when len(lines) = 1 and length(trim(lines[1])) <= 70 and not regexp_matches(trim(lines[1]), '[.!?,;]$') then 'heading' else 'paragraph' end as kind, lines from l where len(lines) > 0),
b as (select doc_id, nth, kind, array_to_string(case kind when 'list' then list_transform(lines, lambda x: trim(regexp_replace(x, '^\s*[-*•·]\s+', ''))) when 'heading' then [regexp_replace(trim(lines[1]), ':$', '')] else list_transform(lines, lambda x: trim(x)) end, '|') as said from k)
select doc_id, count(*) as blocks, count(*) filter (where kind = 'heading') as headings, count(*) filter (where kind = 'list') as lists, count(*) filter (where kind = 'paragraph') as paragraphs,
  md5(string_agg(kind || ':' || said, chr(10) order by nth)) as digest from b group by doc_id
""")
def description_blocks(t: Tables) -> DataFrame:
    """Blocks of texts: as they are, with a blank line behind each line, or as lists, by document in turn."""
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- "))))
    rows = t.documents.select("doc_id", tx.blocks(said, most=None).alias("b")).where(F.size("b") > 0)
    count = lambda kind: F.size(F.filter("b", lambda x: x["kind"] == kind)).cast("long")
    listed = F.array_join(F.transform("b", lambda x: F.concat(x["kind"], F.lit(":"), F.array_join(x["lines"], "|"))), "\n")
    return rows.select("doc_id", F.size("b").cast("long").alias("blocks"), count("heading").alias("headings"), count("list").alias("lists"), count("paragraph").alias("paragraphs"), F.md5(listed).alias("digest"))


@query("""
select event_id, case event_id % 5 when 0 then ts + interval 5 day when 1 then ts - interval 14 day when 2 then ts when 3 then ts + interval 3 hour end as resolved from events
""")
def relative_dates(t: Tables) -> DataFrame:
    """Relative dates resolved against the event's time."""
    k = F.col("event_id") % 5
    said = F.when(k == 0, "Closes in 5 days").when(k == 1, "2 weeks ago").when(k == 2, "today").when(k == 3, "in 3 hours").otherwise("soon")
    return t.events.select("event_id", tx.resolve_relative_date(said, F.col("ts")).alias("resolved"))


@query()
def rule_fields(t: Tables) -> DataFrame:
    """Pay, experience, work mode, deadline, visa and languages that the wording rules find in each document."""
    from loomfield.functions import rules

    rows = rules.with_fields(t.spread("documents", "doc_id", "doc_id", "text"), F.lit(""), F.col("text"), "f").select("doc_id", "f.*")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("countries", "permits")})


@query()
def decided_documents(t: Tables) -> DataFrame:
    """All decisions on each document, its first line standing for a title."""
    from loomfield.operators import ladder

    rows = t.spread("documents", "doc_id", "doc_id", "text").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"))
    done = ladder.decide(ladder.apply_rules(rows))
    return done.select("doc_id", "employment_kind", "role_family", "india_eligible", "entry_level", F.array_join("flags", ",").alias("flags"), F.array_join("labels", ",").alias("labels"), "decision_key")
