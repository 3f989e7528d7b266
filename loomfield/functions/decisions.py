"""Decisions on a posting as ordered CASE expressions: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions import geo
from loomfield.functions.matches import WORD, at_words, let
from loomfield.functions.text import says

#: Role families and the wording of a title that puts it there; order matters.
ROLE_RULES_PORTABLE = (
    ("operations", r"\bdata\s+entry\b|\bvirtual\s+assistant\b|\bback[- ]?office\b|\bexecutive\s+assistant\b|\bpersonal\s+assistant\b|\b(?:technical\s+)?(?:program|project)\s+manager\b|\bworkplace\b|\bfacilit(?:y|ies)\b|\boffice\s+manager\b"),
    ("qa-testing", r"\bqa\b|\bquality\s+(?:assurance|engineer|analyst)\b|\bsdet\b|\btest(?:er|ing)?\b|\bautomation\s+(?:engineer|tester)\b"),
    ("devops-cloud", r"\bdevops\b|\bsre\b|\bsite\s+reliability\b|\bcloud\b|\binfrastructure\b|\bplatform\s+engineer\b|\bsys(?:tem)?\s*admin\w*\b|\bnetwork\s+engineer\b|\bsecurity\b|\bcyber\w*\b|\binfosec\b|\bsoc\s+analyst\b|\bidentity\b"),
    ("customer-support", r"\bcustomer\s+(?:support|success|service|care|experience|operations)\b|\bsupport\s+(?:engineer|specialist|agent|associate|representative|executive)\b|\bhelp\s*desk\b|\btechnical\s+support\b|\bchat\s+support\b|\b(?:voice|non[- ]voice)\b|\bbpo\b|\bcall\s+cent(?:er|re)\b|\bclient\s+support\b|\btier\s*[123]\b|\bonboarding\b|\bsupport\b"),
    ("sales-bd", r"\bsales\b|\bsolutions?\s+(?:engineer|consultant)\b|\bpre[- ]?sales\b|\bbusiness\s+development\b|\bbdr\b|\bsdr\b|\bbde\b|\baccount\s+(?:executive|manager|director)\b|\blead\s+generation\b|\binside\s+sales\b|\bpartnerships?\b|\bpartner\s+(?:manager|specialist|development|success|account)\b|\bchannel\b|\balliances?\b|\brenewals?\b|\bgtm\b|\bdeal\s+desk\b|\bcommercial\b"),
    ("design", r"\bdesigner\b|\bux\b|\bui\b|\bproduct\s+design\w*\b|\bgraphic\w*\b|\bvisual\b|\billustrat\w+\b|\bmotion\b|\bcreative\s+(?:designer|director)\b|\bbrand\s+design\w*\b|\bdesign\b"),
    ("data", r"\bdata\s+(?:scien\w+|analy\w+|engineer\w*|analytics)\b|\bmachine\s+learning\b|\bml\b|\bai\s+(?:engineer|researcher|specialist)\b|\bapplied\s+(?:ai|scientist|researcher)\b|\bbusiness\s+intelligence\b|\bbi\s+(?:developer|analyst)\b|\banalytics\b|\bresearch(?:er)?\s*scientist\b|\bresearcher\b|\bscientist\b|\bnlp\b|\bcomputer\s+vision\b|\bdata\b|\bstatistic\w*\b"),
    ("product", r"\bproduct\s+(?:manager|owner|analyst|operations|specialist|management)\b|\bassociate\s+product\b|\bapm\b"),
    ("writing-editing", r"\bwriter\b|\bcopywrit\w+\b|\beditor\b|\bjournalist\b|\btranslat\w+\b|\btranscri\w+\b|\bproofread\w*\b|\bsubtitl\w+\b|\bcontent\s+(?:writer|editor)\b"),
    ("community", r"\bcommunity\b|\bmoderator\b|\bdeveloper\s+(?:advocate|relations)\b|\bdevrel\b|\bambassador\b"),
    ("hr-recruiting", r"\brecruit\w*\b|\btalent\b|\bhr\b|\bhuman\s+resources\b|\bpeople\s+(?:operations|partner|ops|team)\b|\bsourcer\b|\bbenefits\b|\btotal\s+rewards\b|\bcompensation\b"),
    ("finance-accounting", r"\baccountant\b|\baccounts?\b|\baccounting\b|\bfinanc\w+\b|\bbookkeep\w+\b|\baudit\w*\b|\btax\b|\bpayroll\b|\bbilling\b|\bcollections\b|\bfp&a\b|\bcontroller\b|\binvoic\w+\b|\btreasury\b"),
    ("marketing-content", r"\bmarketing\b|\bseo\b|\bsem\b|\bsocial\s+media\b|\bcontent\b|\bgrowth\b|\bbrand\b|\bperformance\s+marketing\b|\binfluencer\b|\bcampaign\w*\b|\bpr\b|\bpublic\s+relations\b|\bcommunications?\b|\bdemand\s+gen\w*\b|\bmedia\b|\bevents?\b"),
    ("operations", r"\boperations?\b|\bops\b|\badmin\w*\b|\bcoordinator\b|\blogistics\b|\bsupply\s+chain\b|\bprocurement\b|\boffice\b|\breceptionist\b|\bscheduler\b|\bdispatcher\b|\bprocess\s+associate\b|\bstrategy\b|\benablement\b"),
    ("software-engineering", r"\bsolutions?\s+architect\b|\bengineer\w*\b|\bdeveloper\b|\bprogrammer\b|\bsoftware\b|\bsde\b|\bswe\b|\bfront[- ]?end\b|\bback[- ]?end\b|\bfull[- ]?stack\b|\bweb\s+dev\w*\b|\bmobile\b|\bandroid\b|\bios\b|\breact\b|\bnode\b|\bjava\b|\.net\b|\bphp\b|\bgolang\b|\brust\b|\bpython\b|\bruby\b|\btypescript\b|\bjavascript\b|\bembedded\b|\bfirmware\b|\bblockchain\b|\bsolidity\b|\bgame\s+dev\w*\b|\bunity\b|\barchitect\b"),
)

#: Titles about exam preparation, taken out before families are looked for, so that one rule without look-ahead
#: serves every engine.
TEST_PREP = r"(?i)\btest(?:ing)?\s*(?:prep|preparation)\b"

#: Wording of a stated employment type, of titles and of descriptions.
FULL_TIME_TYPE = r"(?i)full[ _-]?time|permanent|\bregular\b|\bemployee\b"
TYPE_WORDS = (("internship", r"(?i)\bintern(?:s|ship|ships)?\b|\bapprentice(?:ship)?s?\b"), ("volunteer", r"(?i)volunteer"), ("part_time", r"(?i)part[ _-]?time"), ("temporary", r"(?i)temporary|seasonal|fixed[ _-]?term|\btemp\b"), ("contract", r"(?i)contract|freelanc|consultant|\bb2b\b"))
INTERN_TITLE = r"(?i)\bintern(?:s|ship)?\b|\bsummer\s+analyst\b|\bstagiair\w*|\bpraktik\w+|\bwerkstudent\w*|\bbecari[oa]s?\b|\balternan(?:t|ce)\b|(?<!early\s)(?<!late\s)(?<!growth\s)(?<!seed\s)\bstage\s*$"
TRAINEE_TITLE = r"(?i)\b(?:trainee|apprentice(?:ship)?)\b"
REAL_JOB = r"(?i)\bfull[- ]?time\b|\bpermanent\b|\bppo\b|\bpre[- ]placement\s+offer\b|\bconversion\b|\bctc\b|\blpa\b|\bper\s+annum\b|\bsalary\b|\bconfirmed\s+(?:as|into)\b"
STIPEND = r"(?i)\bstipend\b"
FIXED_TRAINING = r"(?i)\b\d{1,2}\s*+[- ]?\s*+(?:months?|weeks?)\b[^.\n]{0,30}\b(?:training|trainee|internship|apprentice\w*|program(?:me)?)\b|\b(?:training|trainee|internship|apprentice\w*)\b[^.\n]{0,30}\b\d{1,2}\s*+[- ]?\s*+(?:months?|weeks?)\b"
VOLUNTEER = r"(?i)\bvolunteer\s+(?:position|basis)\b|\bthis\s+is\s+a\s+volunteer\b|\bon\s+a\s+volunteer\b|\bunpaid\b|\bno\s+(?:salary|stipend|pay|compensation)\b"
UNPAID_BENEFIT = r"(?i)\bunpaid\s+(?:leave|time\s+off|vacation|holidays?|pto|sabbatical|breaks?)\b"
PART_TIME = r"(?i)\bpart[- ]?time\b(?=[^.\n]{0,40}\b(?:role|position|job|basis|opportunity|contract|work|hours)\b)|\b(?:role|position|job)\s+is\s+part[- ]?time\b"
TEMPORARY = r"(?i)\bthis\s+is\s+an?\s+(?:\w+\s+){0,2}fixed[- ]term\b|\bfixed[- ]term\s+contract\s+(?:starting|to\s+cover|for\s+\d|of\s+\d)|\b(?:maternity|parental)\s+(?:leave\s+)?cover\b|\bcover\s+(?:a\s+)?(?:maternity|parental)\b"

#: Labels of work permits by country, and those that always keep a person in India out.
AUTH_COUNTRY = {"us_work_authorization": "US", "uk_right_to_work": "GB", "india_work_permit": "IN"}
AUTH_ALWAYS = ("security_clearance", "citizenship", "eu_work_permit")

#: Refusals to hire in India, places that leave India out, restrictions in a title, and words of regions without India.
NOT_HIRING_INDIA = (
    r"(?i)\b(?:not|never|cannot|can't|can\s+not|unable\s+to|won't|will\s+not|do\s+not|don't|does\s+not|doesn't|currently\s+not|no\s+longer)\s+(?:currently\s+)?"
    r"(?:hir\w+|recruit\w*|employ\w*|accept\w*|consider\w*|open|available|eligible|support\w*|sponsor\w*)\s+"
    r"(?:[\w'-]+\s+){0,5}?(?:in|from|to|for|within)\s+(?:[\w'-]+\s+){0,3}india\b"
)
EXCEPT_INDIA = r"(?i)\b(?:excluding|except(?:\s+for)?|other\s+than|apart\s+from|outside\s+of|outside|but\s+not|not\s+including)\s+(?:[^.;\n]{0,60}?\b)?india\b"
TITLE_RESTRICTION = r"(?i)\b([A-Za-z][A-Za-z.]{1,14})[-\s](?:based|only|residents?|citizens?)\b"
TITLE_REGIONS = ("europe", "european", "emea", "eu", "latam", "americas", "american", "nordic", "dach", "benelux")


def role_family(title: Column) -> Column:
    def family(text: Column) -> Column:
        out = None
        for name, pattern in ROLE_RULES_PORTABLE:
            cond = text.rlike(rf"(?:(?=\.)|{WORD})(?i:{pattern})")
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out.otherwise("other")

    return let(F.regexp_replace(title, at_words(TEST_PREP), " "), family)


def stated_kind(value: Column) -> Column:
    """Kind that a stated employment type names; full time wins ("FULL_TIME,CONTRACTOR")."""
    out = F.when(value.rlike(FULL_TIME_TYPE), "full_time")
    for kind, pattern in TYPE_WORDS:
        out = out.when(value.rlike(pattern), kind)
    return out


def employment_kind(title: Column, description: Column, stated: Column, seniority: Column) -> Column:
    """Kind of employment by ordered evidence: intern titles, trainees, stated types, wording of the description."""
    text = F.coalesce(description, F.lit(""))
    kind, head = stated_kind(stated), F.coalesce(title, F.lit(""))
    real_job, stipend = at_words(REAL_JOB), at_words(STIPEND)
    trainee, full = head.rlike(TRAINEE_TITLE), kind.eqNullSafe("full_time")
    training = F.concat_ws("\n", head, text).rlike(at_words(FIXED_TRAINING))

    def described(cleaned: Column) -> Column:
        return (
            F.when(cleaned.rlike(at_words(VOLUNTEER)), "volunteer").when(says(cleaned, "part") & cleaned.rlike(at_words(PART_TIME)), "part_time")
            .when(says(cleaned, "fixed", "maternity", "parental") & cleaned.rlike(at_words(TEMPORARY)), "temporary").when(~full & says(cleaned, "stipend") & cleaned.rlike(stipend) & ~cleaned.rlike(real_job), "internship")
        )

    stated_first = (
        F.when(head.rlike(INTERN_TITLE) | seniority.eqNullSafe("intern") | kind.eqNullSafe("internship"), "internship")
        .when(trainee & (full | text.rlike(real_job)), "full_time")
        .when(trainee & (training | text.rlike(stipend)), "internship")
        .when(kind.isin("volunteer", "part_time", "temporary"), kind)
        .when(head.rlike(r"(?i)\bpart[- ]?time\b"), "part_time")
        .when(head.rlike(r"(?i)\b(?:temporary|temp|seasonal|fixed[- ]term|cdd|ftc)\b"), "temporary")
    )
    last = F.when(kind.eqNullSafe("contract") | head.rlike(r"(?i)\b(?:contract(?:or)?|freelancer?)\b"), "contract").when(full, "full_time").otherwise("unknown")
    cleaned = F.when(says(text, "unpaid"), F.regexp_replace(text, at_words(UNPAID_BENEFIT), " ")).otherwise(text)
    return F.coalesce(stated_first, let(cleaned, described), last)


def blocking_labels(country: str) -> list[str]:
    """Labels that keep a person in the country out."""
    own = [label for label, c in AUTH_COUNTRY.items() if c != country]
    return own + (list(AUTH_ALWAYS) if country == "IN" else ["security_clearance", "citizenship"])


def _blocked(auth: Column, country: str) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.arrays_overlap(F.coalesce(auth, none), F.array(*[F.lit(x) for x in blocking_labels(country)]))


def eligible_from_fields(country: str, countries: Column, scope: Column, auth: Column) -> Column:
    """A person in the country may take the job: it is named, or the job is worldwide without a permit they lack."""
    named = F.coalesce(F.array_contains(countries, country), F.lit(False))
    return named | (scope.eqNullSafe("worldwide") & ~_blocked(auth, country))


def refuses_india(text: Column) -> Column:
    """The text says that it does not hire in India, or leaves India out of where it does."""
    return says(text, "india") & (text.rlike(at_words(NOT_HIRING_INDIA)) | text.rlike(at_words(EXCEPT_INDIA)))


def restricted(title: Column) -> Column:
    """A title that keeps the job to a country or region without India ("US-based", "EMEA only")."""
    words = F.transform(F.regexp_extract_all(title, F.lit(TITLE_RESTRICTION), F.lit(1)), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    away = lambda w: F.lower(w).isin(*TITLE_REGIONS) | F.coalesce(geo.country_code(w) != "IN", F.lit(False))
    return F.exists(words, away)


def india_eligible(title: Column, description: Column, countries: Column, scope: Column, auth: Column, remote: Column, located: Column) -> Column:
    """yes, no or unknown, by ordered rules. ``located``: countries of the posting's places."""
    head = F.coalesce(title, F.lit(""))
    text = F.concat_ws("\n", head, F.coalesce(description, F.lit("")))
    none = F.expr("cast(array() as array<string>)")
    named, blocked = F.array_contains(F.transform(F.coalesce(countries, none), F.upper), "IN"), _blocked(auth, "IN")
    return (
        F.when(refuses_india(text), "no")
        .when(restricted(head), F.when(named, "unknown").otherwise("no"))
        .when(named, F.when(blocked, "unknown").otherwise("yes"))
        .when(scope.eqNullSafe("worldwide"), F.when(blocked, "no").otherwise("yes"))
        .when(scope.isin("countries", "regions"), F.when(F.size(F.coalesce(countries, none)) > 0, "no").otherwise("unknown"))
        .when(remote.eqNullSafe("remote") & F.array_contains(F.coalesce(located, none), "IN"), F.when(blocked, "unknown").otherwise("yes"))
        .otherwise("unknown")
    )


def entry_level(seniority: Column, least: Column, most: Column, kind: Column) -> Column:
    """yes, no or unknown: an entry title asking at most two years, or no level and years a beginner can reach."""
    senior = seniority.isin("senior", "lead", "staff", "principal", "director", "mid")
    return (
        F.when(senior | kind.eqNullSafe("internship") | (least >= 3), "no").when(seniority.eqNullSafe("entry") & (least.isNull() | (least <= 2)), "yes")
        .when(seniority.isNull() & ((least <= 2) | (most <= 2)), "yes").otherwise("unknown")
    )
