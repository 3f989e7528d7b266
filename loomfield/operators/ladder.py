"""From raw payloads to decided postings: board fields, page data and wording rules in that order, then the decisions."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions import board_fields, decisions, eligibility, flags, geo, jsonld, places, rules, work_modes
from loomfield.functions import experience as ex
from loomfield.functions import html
from loomfield.functions import languages as lg
from loomfield.functions import text as tx
from loomfield.operators import state, tables

#: Version of the rules and decisions: rows that carry another one are recomputed.
VERSION = "2"

#: Languages that everyone is taken to read.
ASSUMED = ("english", "hindi")

#: Values that rules may fill, and the field of ``rules.extract`` (or an expression over it) that fills them.
FILLED = {"remote_type": "work_mode", "seniority": "seniority", "deadline_at": "deadline", "visa_sponsorship": "visa", "eligible_countries": "countries", "eligibility_scope": "scope", "work_auth_required": "permits"}


def with_page_data(rows: DataFrame, key: str, html: str) -> DataFrame:
    """``rows`` (with board fields) filled from the structured postings of their pages; the page's own statement goes first,
    and keys where both differ are listed in ``conflicts``. Of several postings on a page the first title counts."""
    found = jsonld.postings(rows, key, html)
    one = found.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(F.asc_nulls_last("title")))).where("_nth = 1").drop("_nth")
    named = one.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("remote_type", "posted_at", "deadline_at", "company", "description")])
    joined = rows.join(named, F.col(key) == F.col("_key"), "left")
    pairs = {"remote_type": "_remote_type", "posted_at": "_posted_at", "deadline_at": "_deadline_at", "company_name": "_company", "description": "_description"}
    merged, differ = jsonld.merge_rungs({k: F.col(v) for k, v in pairs.items()}, {k: F.col(k) for k in pairs})
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in rows.columns], differ.alias("conflicts"))


_NO_STRINGS = "cast(array() as array<string>)"


def _with_places(rows: DataFrame, title: Column, text: Column, gazetteer: DataFrame) -> DataFrame:
    """``rows`` with what location texts, the title's remote segments and stated availability say (``_place``). Texts that only
    name a way of work are no places: they are taken out and kept as ``_label``."""
    raw = F.coalesce(F.col("places"), F.expr(_NO_STRINGS)) if "places" in rows.columns else F.expr(_NO_STRINGS)
    own = rows.withColumn("_label", eligibility.mode_of_places(raw))
    raw = F.when(F.col("_label").isNull(), raw).otherwise(F.expr(_NO_STRINGS))
    return own.withColumn("_place", places.rung_reader(gazetteer)(raw, eligibility.title_segments(title), places.availability(text), title, text))


def apply_rules(rows: DataFrame, title: str = "title", text: str = "description", gazetteer: DataFrame | None = None) -> DataFrame:
    """``rows`` with what wording says where nothing is known yet. Each filled value has ``<name>_provenance`` (source, rule
    or unknown; a provenance that ``rows`` bring is kept); a differing statement of a known value goes to ``rule_conflicts``.

    With a ``gazetteer`` the location texts count before the title's segments, and those before the description; ``locations`` has
    the cities, regions and countries. In any case a worldwide claim of the text is none beside a place, or work on site or
    hybrid work; and a known value that the text contradicts explicitly (remote work, or worldwide hiring that leaves India out)
    becomes unknown."""
    head, said = F.coalesce(F.col(title), F.lit("")), F.col(text)
    f = rules.with_fields(rows, head, said, seen=F.col("posted_at").cast("timestamp") if "posted_at" in rows.columns else None)
    r = F.col("_rules")
    offers: dict[str, list[Column]] = {n: [r[rule]] for n, rule in FILLED.items()}
    extra: list[Column] = []
    noted: list[Column] = []
    if gazetteer is not None:
        f = _with_places(f, head, said, gazetteer)
        p, label = F.col("_place"), F.col("_label")
        use = ~(p["mode"].eqNullSafe("remote") & work_modes.not_for_remote(said))
        stated = use & (p["mode"].isNotNull() | p["scope"].eqNullSafe("worldwide"))
        some = lambda c: F.when(F.size(c) > 0, c)
        offers["remote_type"] = [label, F.when(use, p["mode"]), p["title_mode"], *offers["remote_type"]]
        offers["eligibility_scope"] = [F.when(stated, p["scope"]), F.when(p["title_mode"].isNotNull(), p["title_scope"]), *offers["eligibility_scope"]]
        offers["eligible_countries"] = [F.when(stated, some(p["countries"])), F.when(p["title_mode"].isNotNull(), some(p["title_countries"])), *offers["eligible_countries"]]
        extra = [p["places"].alias("locations")]
        noted = [F.when(label.isNotNull(), "locations: a way of work is no place")]
        placed = F.exists(F.coalesce(p["places"], F.array()), lambda x: ~F.lower(x["raw"]).rlike(r"^[\W_]*(?:(?:remote|anywhere|worldwide|global|globally|work|from|home|wfh|or|and)[\W_]*)*$"))
        offers["eligibility_scope"][-1] = F.when(~(r["scope"].eqNullSafe("worldwide") & placed), r["scope"])
    given = lambda n: F.col(n) if n in rows.columns else F.lit(None)
    mode = F.coalesce(given("remote_type"), *offers["remote_type"])
    offers["eligibility_scope"][-1] = F.when(~(r["scope"].eqNullSafe("worldwide") & mode.isin("onsite", "hybrid")), offers["eligibility_scope"][-1])
    rule_pay = F.when(F.coalesce(r["pay_low"], r["pay_high"]).isNotNull(), F.struct(r["pay_low"].alias("low"), r["pay_high"].alias("high"), r["pay_currency"].alias("currency"), r["pay_period"].alias("period")))
    dropped = {*FILLED, "pay", "places" if gazetteer is not None else "", *(f"{n}_provenance" for n in (*FILLED, "pay"))}
    columns: list[Column] = [F.col(c) for c in rows.columns if c not in dropped]
    if "places" in rows.columns and gazetteer is not None:
        columns.append(F.when(F.col("_label").isNull(), F.col("places")).alias("places"))
    clashes: list[Column] = [*noted]
    for name in [*FILLED, "pay"]:
        known = given(name)
        found = rule_pay if name == "pay" else F.coalesce(*offers[name])
        from_where = F.coalesce(F.col(f"{name}_provenance"), F.lit("source")) if f"{name}_provenance" in rows.columns else F.lit("source")
        value, provenance, clash = rules.fill(known, from_where, found)
        against = None
        if name == "remote_type":
            against = value.eqNullSafe("remote") & ~provenance.eqNullSafe("manual") & work_modes.refuses_remote(said)
        elif gazetteer is not None and name in ("eligibility_scope", "eligible_countries"):
            against = given("eligibility_scope").cast("string").eqNullSafe("worldwide") & F.col("_place")["available"].isNotNull() & ~F.array_contains(F.coalesce(F.col("_place")["available"], F.expr(_NO_STRINGS)), "IN")
        if against is not None:
            value, provenance, clash = F.when(~against, value), F.when(~against, provenance), clash | against
        columns += [value.alias(name), F.coalesce(provenance, F.lit("unknown")).alias(f"{name}_provenance")]
        clashes.append(F.when(clash, F.lit(name)))
    columns += [*extra, r["years_least"].alias("experience_min_years"), r["years_most"].alias("experience_max_years"), r["joining"].alias("joining"), F.array_compact(F.array(*clashes)).alias("rule_conflicts")]
    return f.select(columns)


def forget_rules(rows: DataFrame) -> DataFrame:
    """``rows`` without the values that rules had filled, so that newer rules can fill them again."""
    names = [n for n in (*FILLED, "pay") if f"{n}_provenance" in rows.columns]
    known = {n: F.when(F.col(f"{n}_provenance") != "rule", F.col(n)).alias(n) for n in names}
    derived = {"experience_min_years", "experience_max_years", "joining", "rule_conflicts", "locations"}
    return rows.select(*[known.get(c, F.col(c)) for c in rows.columns if c not in derived])


#: Sources whose stored values below a version can't be trusted, the field, the value, and the version that mended it.
RESETS = (("ashby", "remote_type", "remote", 8), ("himalayas", "eligibility_scope", "worldwide", 9))


def reset_versions(rows: DataFrame) -> DataFrame:
    """``rows`` (source, extraction_version) without the values that an older version of the rules took from a source wrongly."""
    out = rows
    for source, name, value, version in RESETS:
        wrong = (F.col("source") == source) & (F.col(name) == value) & (F.col(f"{name}_provenance") == "source") & (F.coalesce("extraction_version", F.lit(0)) < version)
        out = out.withColumn(name, F.when(~F.coalesce(wrong, F.lit(False)), F.col(name)))
    return out


def recheck(rows: DataFrame, title: str = "title", text: str = "description", gazetteer: DataFrame | None = None) -> DataFrame:
    """``rows`` with the values of rules worked out anew; what sources, models and people gave stays. Rows with an
    ``extraction_version`` lose first what older versions read wrongly."""
    known = reset_versions(rows) if {"source", "extraction_version"} <= set(rows.columns) else rows
    return apply_rules(forget_rules(known), title, text, gazetteer)


def read_place(place: Column) -> Column:
    """struct(remote, countries, scope) of one place string ("Remote - India", "Pune, India or Berlin, Germany"): options are
    split, countries and regions of all options are united, and worldwide counts only for remote work."""
    low = F.lower(F.coalesce(place, F.lit("")))
    options = F.split(F.regexp_replace(low, r"\s*(?:\bor\b|[;|/])\s*", ";"), ";")
    parts = F.filter(F.transform(F.flatten(F.transform(options, lambda o: F.split(o, r"\s*[,()]\s*|\s+[-–]\s+"))), F.trim), lambda x: x != "")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\b(?:fully|remote|only|based|within|in|anywhere)\b", " ")))
    countries = F.array_sort(geo.expand_regions(bare))
    remote, world = low.rlike(r"\bremote\b|\banywhere\b"), low.rlike(r"\bworldwide\b|\bglobal(?:ly)?\b|\banywhere\b")
    regions = F.exists(bare, lambda p: p.isin(*geo.REGIONS))
    scope = F.when(remote & world & (F.size(countries) == 0), "worldwide").when(regions, "regions").when(F.size(countries) > 0, "countries")
    return F.struct(remote.alias("remote"), countries.alias("countries"), scope.alias("scope"))


def decide(rows: DataFrame) -> DataFrame:
    """``rows`` (title, description, employment_type, seniority, eligible_countries, eligibility_scope, work_auth_required,
    remote_type, places) with all decisions and the version that made them."""
    none = F.expr("cast(array() as array<string>)")
    col = lambda c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    located = F.array_distinct(F.flatten(F.transform(F.coalesce(col("places", "array<string>"), none), lambda p: read_place(p)["countries"])))
    title, text = F.coalesce(col("title"), F.lit("")), col("description")
    seniority = F.coalesce(col("seniority"), ex.level(title, text))
    kind = decisions.employment_kind(title, text, F.array_join(col("employment_type", "array<string>"), ","), seniority)
    # What several decisions use is computed in a projection of its own, once per row.
    own = rows.withColumns({
        "_kind": kind, "_level": seniority, "_years": rules.experience(text, title), "_counts": tx.counted(text), "_languages": lg.languages(F.concat_ws("\n", title, text)),
        "_hard": flags.hard_flags(title, text, col("source")), "_soft": flags.soft_labels(title, text, F.array_join(col("employment_type", "array<string>"), ","), col("source"), col("remote_type")),
    })
    counts = {k: F.col("_counts")[k] for k in ("words", "letters", "non_latin", "english", "foreign")}
    known = F.array(*[F.lit(x) for x in ASSUMED])
    blocking, nice = F.array_except(F.col("_languages")["required"], known), F.array_except(F.col("_languages")["nice"], known)
    needed = F.struct(F.lit("language_required").alias("flag"), F.array_join(blocking, ", ").alias("evidence"))
    foreign = F.struct(F.lit("non_english").alias("flag"), F.lit("").alias("evidence"))
    raised = F.concat("_hard", F.array_compact(F.array(F.when(F.size(blocking) > 0, needed), F.when(tx.is_non_english(**counts), foreign))))
    labels = F.array_distinct(F.concat("_soft", F.array_compact(F.array(F.when(F.col("_kind") == "contract", "freelance"))), F.transform(nice, lambda x: F.concat(F.lit("lang_nice:"), x))))
    return own.withColumns({
        "employment_kind": F.col("_kind"), "role_family": decisions.role_family(title),
        "india_eligible": decisions.india_eligible(title, text, col("eligible_countries", "array<string>"), col("eligibility_scope"), col("work_auth_required", "array<string>"), col("remote_type"), located),
        "entry_level": decisions.entry_level(F.col("_level"), F.col("_years")["least"], F.col("_years")["most"], F.col("_kind")),
        "flags": F.transform(raised, lambda x: x["flag"]), "flag_evidence": raised, "labels": labels, "decision_key": F.lit(f"decide:{VERSION}"),
    }).drop("_kind", "_level", "_years", "_counts", "_languages", "_hard", "_soft")


def decide_pending(postings: DataFrame) -> DataFrame:
    """``postings`` where rows decided by another version are decided again and the others stay as they are."""
    names = ("employment_kind", "role_family", "india_eligible", "entry_level", "flags", "flag_evidence", "labels", "decision_key")
    key = F.lit(f"decide:{VERSION}")
    todo = state.pending(postings, "decision_key", key).drop(*names)
    return postings.where(F.col("decision_key").eqNullSafe(key)).unionByName(decide(todo).select(postings.columns))


#: What keeps a raw document from becoming a posting, and how often it is tried.
FAULTS = ("no_body", "unknown_source", "bad_gzip", "not_json", "not_an_object", "no_posting")
ATTEMPTS = 3


@F.pandas_udf(T.BinaryType())
def _gunzip(bodies: pd.Series) -> pd.Series:
    def one(body):
        try:
            return None if body is None else gzip.decompress(body)
        except (OSError, EOFError, ValueError, zlib.error):
            return None

    return bodies.map(one)


def read_documents(documents: DataFrame) -> DataFrame:
    """``documents`` (raw_document_id, source, source_key, content_type, body) with ``page`` (the body's text), ``job`` (the posting of a
    board's payload, as a variant) and ``fault``: the first thing that keeps the row from being read, or null. Bodies may be
    gzipped. Only compressed bodies leave the JVM."""
    packed = F.hex(F.substring("body", 1, 2)) == "1F8B"
    board = F.col("source").isin(*board_fields.BOARDS)
    own = documents.withColumn("_packed", F.when(packed, F.col("body"))).withColumn("_plain", _gunzip("_packed"))
    own = own.withColumn("page", html.decode(F.when(F.col("_packed").isNull(), F.col("body")).otherwise(F.col("_plain")), F.col("content_type")))
    own = own.withColumn("_json", F.when(board, F.try_parse_json("page")))
    listed = F.try_variant_get("_json", "$.jobs[0]", "variant")
    job = F.coalesce(listed, F.try_variant_get("_json", "$[0]", "variant"), F.col("_json"))
    own = own.withColumn("job", F.when(F.schema_of_variant(job).startswith("OBJECT"), job))
    fault = (
        F.when(F.col("body").isNull() | (F.octet_length("body") == 0), "no_body").when(~F.coalesce(board | (F.col("source") == "careerpage"), F.lit(False)), "unknown_source")
        .when(F.col("_packed").isNotNull() & F.col("_plain").isNull(), "bad_gzip").when(board & F.col("_json").isNull(), "not_json").when(board & F.col("job").isNull(), "not_an_object")
    )
    return own.withColumn("fault", fault).drop("_packed", "_plain", "_json")


#: The fields that both rungs state, and the name that the page's data have for them.
SHARED = {"remote_type": "remote_type", "posted_at": "posted_at", "deadline_at": "deadline_at", "company_name": "company", "description": "description"}


def rungs(read: DataFrame, now: str) -> DataFrame:
    """Rows of ``read_documents`` with the fields of their board and of the structured posting in the page, or else in the
    payload's own markup; the page's statements go first, and keys where both differ are ``conflicts``. A time of posting past
    ``now`` is now. Sound rows that turn out to hold no posting get a ``fault``."""
    embedded = F.coalesce(*[F.when(F.try_variant_get("job", f"$.{k}", "string").contains("ld+json"), F.try_variant_get("job", f"$.{k}", "string")) for k in ("content", "description", "descriptionHtml", "descriptionBody")])
    own = read.withColumn("_node", F.coalesce(jsonld.first_posting(F.col("page")), jsonld.first_posting(embedded)))
    own = own.withColumn("fault", F.coalesce("fault", F.when(F.col("job").isNull() & F.col("_node").isNull(), "no_posting")))
    board, page = board_fields.any_board(F.col("source")), jsonld.columns("_node")
    # Each rung is a struct of the table that is written here: what follows reads its columns, and does not work out the mappers
    # again for each use of a field.
    own = own.withColumn("_board", F.struct(*[c.alias(n) for n, c in board.items()])).withColumn("_page", F.struct(*[c.alias(n) for n, c in page.items()], eligibility.applicant_requirements(jsonld.requirements("_node")).alias("asked")))
    keep = [c for c in read.columns if c not in ("body", "page", "job", "fault", "title")]
    own = tables.written(own.select(*keep, "fault", "_board", "_page"), "rungs")
    b, j = (lambda n: F.col("_board")[n]), (lambda n: F.col("_page")[n])
    first = {"title": j("title")} | {n: board_fields.marked(j(v)) if n == "description" else j(v) for n, v in SHARED.items()}
    merged, differ = jsonld.merge_rungs(first, {"title": b("title")} | {n: b(n) for n in SHARED})
    kinds = F.when(j("employment_type") != "", F.split(j("employment_type"), ","))
    places_ = F.when(j("city").isNotNull() | j("country").isNotNull(), F.array(F.concat_ws(", ", j("city"), j("country"))))
    pay = F.when(F.coalesce(j("pay_min"), j("pay_max")).isNotNull() & j("pay_period").isNotNull(), F.struct(j("pay_min").alias("low"), j("pay_max").alias("high"), j("pay_currency").alias("currency"), j("pay_period").alias("period")))
    jsonld_first = {"remote_type": j("remote_type"), "deadline_at": j("deadline_at"), "pay": pay, "eligible_countries": j("asked")["countries"], "eligibility_scope": j("asked")["scope"]}
    said = board_fields.unmarked(merged["description"])
    return own.select(
        *keep, "fault", F.coalesce(merged["title"], F.col("source_key")).alias("title"), tx.split_source_id(F.col("source_key")).alias("source_id"), said.alias("description"), merged["remote_type"].alias("remote_type"),
        F.least(merged["posted_at"], F.lit(now).cast("timestamp")).alias("posted_at"), merged["deadline_at"].alias("deadline_at"), merged["company_name"].alias("company_name"), F.coalesce(kinds, b("employment_type")).alias("employment_type"),
        b("seniority").alias("seniority"), b("apply_url").alias("apply_url"), F.coalesce(b("places"), places_).alias("places"), F.coalesce(pay, b("pay")).alias("pay"),
        F.coalesce(j("asked")["countries"], b("eligible_countries")).alias("eligible_countries"), F.coalesce(j("asked")["scope"], F.when(F.size(b("eligible_countries")) > 0, "countries")).alias("eligibility_scope"),
        *[F.when(v.isNotNull(), "jsonld").otherwise("source").alias(f"{n}_provenance") for n, v in jsonld_first.items()],
        F.concat(differ, F.when(merged["title"].isNull(), F.array(F.lit("title: missing"))).otherwise(F.expr(_NO_STRINGS))).alias("conflicts"),
    )


def extract(documents: DataFrame, now: str, gazetteer: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine) of raw documents of any source: every document is in exactly one of the two. The ladder is board
    fields and page data, then wording rules, then decisions. Quarantine: raw_document_id, source, source_key, reason, attempts
    (of ``documents`` with a column ``attempts`` one more than before).

    A row that can't be read costs no other row: each rung's parsers give null rather than raise, and the first fault goes
    along as a column. What the rungs give is written to the shared folder, so that both outputs come from one reading."""
    laddered = rungs(read_documents(documents), now)
    tried = F.coalesce("attempts", F.lit(0)) if "attempts" in documents.columns else F.lit(0)
    bad = laddered.where("fault is not null").select("raw_document_id", "source", "source_key", F.col("fault").alias("reason"), (tried + 1).cast("int").alias("attempts"))
    good = laddered.where("fault is null").drop("fault", "attempts")
    return decide(apply_rules(good, gazetteer=gazetteer)), bad


def process_documents(postings: DataFrame, documents: DataFrame, now: str, quarantine: DataFrame | None = None, gazetteer: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine) after a run over pending raw documents: the good ones are put in by (source, source_id), an older
    document never replacing a newer one; of the bad ones the last reason and the number of attempts are kept. Documents that
    failed ``ATTEMPTS`` times are left out of the run and stay in quarantine; one that is read at last leaves it."""
    tries = documents.withColumn("attempts", F.lit(0)) if quarantine is None else documents.join(quarantine.select("raw_document_id", "attempts"), "raw_document_id", "left")
    due = tries.where(F.coalesce("attempts", F.lit(0)) < ATTEMPTS)
    good, bad = extract(due, now, gazetteer)
    if quarantine is not None:
        bad = quarantine.join(due.select("raw_document_id"), "raw_document_id", "left_anti").unionByName(bad)
    return state.merge(postings, good.select(postings.columns), ["source", "source_id"], "raw_document_id"), bad


def process(postings: DataFrame, documents: DataFrame, ats: str) -> DataFrame:
    """``postings`` after a batch of raw documents (source, source_id, raw_document_id, title, job) of one board kind: fields by
    the ladder, then a keyed upsert in which an older document never replaces a newer one."""
    found = apply_rules(board_fields.fields(documents, ats).drop("job"))
    batch = decide(found).select(postings.columns)
    return state.merge(postings, batch, ["source", "source_id"], "raw_document_id")
