"""Raw documents through the ladder, places against a gazetteer, skills against a dictionary: each over tables made from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions import places
from loomfield.operators import ladder, skills, tables
from loomfield.registry import Tables, query
from loomfield.sources import archive

#: Fixed value: the time of the run; later times of posting count as this one.
NOW = "2026-06-01 00:00:00"


@query("""
with d as (select doc_id, trim(text) as text, doc_id % 10 = 3 as broken, ['greenhouse', 'lever', 'workable', 'careerpage'][1 + doc_id % 4] as source from documents)
select doc_id, source, if(broken, 'quarantine', 'posting') as outcome, if(broken, if(source = 'careerpage', 'no_posting', 'not_json'), null) as reason, if(broken, 1, null) as attempts,
  if(broken, null, 'Title ' || doc_id) as title, if(broken or source <> 'lever', null, text) as description, if(broken or source <> 'careerpage', null, 'Company ' || doc_id % 7) as company,
  case when broken then null when source = 'careerpage' then 'jsonld' when source = 'workable' then 'source' end as mode_from
from d
""")
def quarantined_intake(t: Tables) -> DataFrame:
    """A raw document for each text, of four sources in turn, every tenth of them cut off: what becomes a posting, with fields of
    each rung, and what is quarantined and why."""
    body = lambda **fields: F.to_json(F.struct(*[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in fields.items()]))
    title = F.concat(F.lit("Title "), F.col("doc_id"))
    k = F.col("doc_id") % 4
    page = F.concat(
        F.lit('<html><script type="application/ld+json">'),
        F.concat(F.lit('{"@type":"JobPosting","jobLocationType":"TELECOMMUTE","hiringOrganization":'), body(name=F.concat(F.lit("Company "), F.col("doc_id") % 7)), F.lit(',"title":"'), title, F.lit('"}')), F.lit("</script></html>"),
    )
    payload = F.when(k == 0, body(title=title)).when(k == 1, body(text=title, descriptionPlain=F.col("text"))).when(k == 2, body(title=title, telecommuting=F.lit(True))).otherwise(page)
    cut = F.when(F.col("doc_id") % 10 == 3, F.substring(payload, F.lit(1), F.length(payload) - 12)).otherwise(payload)
    source = F.when(k == 0, "greenhouse").when(k == 1, "lever").when(k == 2, "workable").otherwise("careerpage")
    raw = t.spread("documents", "doc_id", "doc_id", "text").select(F.col("doc_id").alias("raw_document_id"), source.alias("source"), F.concat(F.lit("b/"), F.col("doc_id")).alias("source_key"), F.lit("text/html").alias("content_type"), cut.cast("binary").alias("body"))
    read = ladder.rungs(ladder.read_documents(raw), NOW)
    good = F.col("fault").isNull()
    mode = F.when(F.col("remote_type").isNotNull(), F.col("remote_type_provenance"))
    return read.select(
        F.col("raw_document_id").alias("doc_id"), "source", F.when(good, "posting").otherwise("quarantine").alias("outcome"), F.col("fault").alias("reason"), F.when(~good, 1).alias("attempts"), F.when(good, F.col("title")).alias("title"),
        F.when(good & (F.col("source") == "lever"), F.coalesce("description", F.lit(""))).alias("description"), F.when(good, F.col("company_name")).alias("company"), F.when(good, mode).alias("mode_from"),
    )


@query("""
with n as (select n_nationkey, n_name, r_name, 'N' || n_nationkey as code from nation join region on n_regionkey = r_regionkey),
m as (select r_name, string_agg(code, ',' order by code) as members from n group by r_name),
s as (select s_suppkey, s_name, 'N' || s_nationkey as code, (select max(s_suppkey) + 1 from supplier) as suppliers from supplier)
select c_custkey,
  case c_custkey % 7 when 0 then 'remote' when 2 then 'remote' when 3 then 'remote' when 4 then 'remote' when 5 then 'hybrid' end as mode,
  case c_custkey % 7 when 0 then 'countries' when 1 then 'countries' when 2 then 'regions' when 3 then 'worldwide' when 5 then 'countries' when 6 then 'countries' end as scope,
  case c_custkey % 7 when 0 then n.code when 1 then s.code when 2 then members when 5 then array_to_string(list_sort(list_distinct([s.code, n.code])), ',') when 6 then n.code else '' end as countries
from customer join n on c_nationkey = n_nationkey join m using (r_name) join s on c_custkey % suppliers = s_suppkey
""")
def posting_places(t: Tables) -> DataFrame:
    """Mode, scope and countries of location texts that name nations, regions and suppliers, read against a gazetteer of these:
    suppliers are its cities."""
    nations = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("code", F.concat(F.lit("N"), "n_nationkey"))
    regions = nations.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("code")), " ").alias("code"))
    table = (
        nations.select(F.col("n_name").alias("name"), F.lit("country").alias("kind"), "code")
        .unionByName(regions.select(F.col("r_name").alias("name"), F.lit("region").alias("kind"), "code"))
        .unionByName(t.supplier.select(F.col("s_name").alias("name"), F.lit("city").alias("kind"), F.concat(F.lit("N"), "s_nationkey").alias("code")))
    )
    suppliers = t.supplier.agg(F.max("s_suppkey") + 1).first()[0] or 1
    own = t.customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("at", F.col("c_custkey") % suppliers)
    own = own.join(t.supplier.select("s_suppkey", "s_name"), F.col("at") == F.col("s_suppkey"))
    k = F.col("c_custkey") % 7
    said = (
        F.when(k == 0, F.concat(F.lit("Remote - "), "n_name")).when(k == 1, F.col("s_name")).when(k == 2, F.concat(F.lit("Remote, "), "r_name")).when(k == 3, F.lit("Remote worldwide"))
        .when(k == 4, F.concat(F.lit("Remote - "), "r_name", F.lit(" except "), "n_name")).when(k == 5, F.concat(F.lit("Hybrid - "), "s_name", F.lit(" or "), "n_name")).otherwise(F.concat("n_name", F.lit(" or Remote")))
    )
    read = own.select("c_custkey", places.reader(table)(F.array(said), F.lit(""), F.lit("")).alias("p"))
    return read.select("c_custkey", "p.mode", "p.scope", F.array_join("p.countries", ",").alias("countries"))


@query(r"""
with words as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9+#]+')) as word from benchmark),
terms as (select lower(word) as term, lower(word) as skill, false as exact from words where length(word) >= 7 and regexp_matches(word, '^[a-z]') union select word, 'as written: ' || word, true from words where length(word) >= 7 and regexp_matches(word, '^[A-Z]')),
said as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+#]+')) as word from documents),
found as (select distinct doc_id, skill from said join terms on (not exact and lower(word) = term) or (exact and word = term))
select doc_id, skill, 'must' as importance from found
""")
def document_skills(t: Tables) -> DataFrame:
    """Terms that each document names, from a dictionary of the benchmark's longer words: those in small letters in any case, those
    with a capital as written. The given documents hold no wording for extras, so all are musts; tests have the rest."""
    word = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+#]+)"), F.lit(1)))
    words = t.benchmark.select(word.alias("term")).distinct().where(F.length("term") >= 7)
    small, large = words.where(F.col("term").rlike("^[a-z]")), words.where(F.col("term").rlike("^[A-Z]"))
    terms = small.select("term", F.lower("term").alias("skill"), F.lit(False).alias("exact_case")).unionByName(large.select("term", F.concat(F.lit("as written: "), "term").alias("skill"), F.lit(True).alias("exact_case")))
    return skills.find(t.spread("documents", "doc_id", "doc_id", "text"), "doc_id", None, "text", terms).select("doc_id", "skill", "importance")


@query("select doc_id, md5(text) as digest, count(*) over (partition by doc_id) as refs from documents")
def archived_documents(t: Tables) -> DataFrame:
    """Each document written to the raw archive, and what its reference reads back from it."""
    spark = t.spark
    spark.dataSource.register(archive.RawArchive)
    folder = f"{tables.shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    rows = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("day"), (F.col("doc_id") % 4).alias("shard"), "text")
    archive.by_file(rows).write.format("raw_archive").option("path", folder).mode("append").save()
    found = archive.refs(spark, folder)
    read = archive.lines(spark, folder, found).select("ref", F.from_json("row", "key string, text string").alias("r"))
    whole = found.join(read, "ref").where(F.col("key") == F.col("r.key"))
    digests = whole.groupBy("key").agg(F.md5(F.first("r.text")).alias("digest"), F.count("*").alias("refs"))
    return digests.select(F.col("key").cast("long").alias("doc_id"), "digest", "refs")
