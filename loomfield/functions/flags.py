"""Hard flags that hide a posting and soft labels that only show on it. The wording of a flag counts where nothing around it
takes it back ("no registration fee", "unpaid leave"). Texts are read whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.held import has, known, within
from loomfield.functions.matches import WORD, around, at_words, first, let
from loomfield.functions.text import says

#: Boards of companies that are followed, where a chat contact is no alarm.
KNOWN_BOARDS = ("greenhouse", "lever", "ashby", "workable", "recruitee", "smartrecruiters", "careerpage")

#: Wording in front of and behind a match that takes it back.
NEGATED_BEFORE = (
    r"(?i)(?:\bno\b|\bnot\b|\bnever\b|\bzero\b|\bwithout\b|\bfree\s+of\b|\bnothing\b|\bdon't\b|\bdo\s+not\b|\bdoesn't\b|\bdoes\s+not\b|\bwon't\b|\bwill\s+not\b|\bisn't\b|\baren't\b|\bnor\b"
    r"|\bwe\s+(?:cover|pay|bear|reimburse|provide|sponsor|fund)\b|\b(?:the\s+company|the\s+employer|employer|company)\s+(?:will\s+)?(?:cover|pay|bear|reimburse|provide|sponsor|fund)s?\b)[^.;!?\n]{0,50}$"
)
NEGATED_AFTER = (
    r"(?i)^[^.;!?\n]{0,30}\b(?:is|are|will\s+be)\s+(?:not\s+(?:required|charged|collected|applicable|needed)|waived|free|covered|paid\s+by\s+(?:us|the\s+company))\b"
    r"|^[^.;!?\n]{0,15}\b(?:waived|free\s+of\s+(?:charge|cost))\b"
)

#: Fees that alarm by themselves, and those that do only where the candidate is to pay them.
FEE_STRONG = (
    r"(?i:\b(?:registration|training|joining|security|refundable|onboarding|certification|enrol+ment|admission|uniform|kit|laptop|id[- ]?card|placement|course)\s+(?:fees?|charges?|deposit|amount)\b"
    r"|\b(?:pay|deposit|transfer)\s+(?:rs\.?|₹|inr|usd|\$)\s*[\d,]+\s+(?:to|for|as)\s+(?:apply|join|register|start|secure|confirm|get)\b)"
)
FEE_WEAK = (
    r"(?i:\b(?:processing|application|verification|equipment|software|documentation|interview|background[- ]check)\s+(?:fees?|charges?|deposit|amount)\b"
    r"|\b(?:pay|deposit|transfer|send|remit)\s+(?:an?\s+)?(?:(?:refundable|small|one[- ]time|nominal|initial)\s+)?(?:fee|deposit|amount)\b)"
)
CANDIDATE_PAYS = (
    r"(?i)\b(?:you\s+(?:will\s+|would\s+)?(?:have\s+to|need\s+to|must|should)\s+pay|candidates?\s+(?:must|need\s+to|have\s+to|will\s+have\s+to)\s+pay|applicants?\s+(?:must|need\s+to|have\s+to)\s+pay"
    r"|before\s+(?:joining|you\s+start|your\s+interview)|to\s+(?:apply|join|register)\b|upfront|up[- ]front|non[- ]?refundable|payable\s+(?:at|before|to\s+us|upon)|pay\s+us)\b"
)
#: Work without pay, and benefits that share its wording.
UNPAID = (
    r"(?i:\bunpaid\b|\bnon[- ]paid\b|\bno\s+(?:salary|stipend|pay|compensation|remuneration)\b(?!\s+(?:history|histories|expectations?|information|details|gap|cuts?|disparity|ceiling|negotiation|data))"
    r"|\bwithout\s+(?:any\s+)?(?:pay|salary|compensation|remuneration)\b|\bvolunteer\s+(?:position|basis)\b|\bthis\s+is\s+a\s+volunteer\b|\bon\s+a\s+volunteer\b"
    r"|\b(?:equity|shares?)[- ]only\b|\bpaid\s+in\s+(?:exposure|experience|equity\s+only)\b|\b(?:compensation|payment|pay)\s+is\s+(?:experience|exposure|learning|equity)\b|\bin\s+exchange\s+for\s+(?:exposure|experience)\b)"
)
UNPAID_BENEFIT = r"(?i)\bunpaid\s+(?:leave|time\s+off|vacation|holidays?|pto|sabbatical|breaks?|parental|maternity|paternity|lunch)\b"
#: Fixed values (white space in front of sums is taken whole, so that long runs of it stay linear): pay by commission only, promises too good to hold, chat contacts.
COMMISSION_ONLY = (
    r"(?i:\bcommission[- ]only\b|\b100\s*%\s*commission\b|\bonly\s+(?:on\s+)?commissions?\b|\bpurely\s+(?:on\s+)?commissions?\b|\bstraight\s+commission\b|\bno\s+(?:fixed|base|basic)\s+(?:salary|pay)\b|\bnot\s+(?:a\s+)?salaried\b"
    r"|\bcommission[- ]based\s+(?:only|income|role|position)\b|\bearn\s+(?:only\s+)?(?:through|via|from)\s+commissions?\b)"
)
TOO_GOOD = (
    r"(?i:\bno\s+interviews?\b|\bwithout\s+(?:any\s+)?interviews?\b|\bguaranteed\s+(?:job|placement|income|salary|joining)\b|\b100\s*%\s*(?:job\s+)?(?:guarantee|placement)\b|\bpay\s+per\s+(?:task|click|like|view|order|video)\b"
    r"|\bearn\s++(?:up\s+to\s++)?(?:rs\.?|₹|inr|\$)?\s*+[\d,]{4,}\s*(?:/|per|a)\s*(?:day|week)\b|\bwork\s+from\s+home\b[^.\n]{0,60}\bearn\s++(?:rs\.?|₹|inr)?\s*+[\d,]{5,})"
)
CHAT = r"(?i:\b(?:whats\s?app|telegram)\b)"
CONTACT = r"(?i)\b(?:apply|send|share|forward|contact|reach|message|text|resume|cv|hr|whatsapp\s+us)\b"
#: Titles and texts that offer no open job: pools, open applications, referrals, conversions, college batches.
NOT_A_JOB_TITLE = (
    r"(?i)\btalent\s+(?:community|network|pool)\b|\bopen\s+(?:applications?|sollicitatie)\b|\b(?:general|spontaneous)\s+application\b|\brefer\s+a\s+(?:candidate|friend|colleague)\b|\binitiativbewerbung\b|\bblindbewerbung\b"
    r"|\bcandidature\s+spontan[ée]e\b|\bcandidatura\s+espont[aá]nea\b|\bspontane\s+sollicitatie\b|\bfuture\s+(?:opportunities|openings|roles|positions?|\w+\s+roles)\b|\bexpression\s+of\s+interest\b|\bapply\s+here\b|\bsollicitatie\b"
    r"|\bjoin\s+our\s+(?:talent|team)\s+(?:community|network|pool)\b|\btemp\s+to\s+(?:full[- ]?time|perm\w*)\b|\b(?:campus|student|college)\s+ambassador\b"
)
CAMPUS_BATCH_TITLE = r"^\s*[A-Z]{2,8}\s*[-–]\s*[A-Z]{2,6}\s*\((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s*20\d\d\)\s*$"
NOT_A_JOB_TEXT = (
    r"(?i)\bonly\s+(?:\w+\s+){0,3}(?:may|can)\s+apply\b|\bconversion\s+program\b|\bnot\s+every\s+(?:\w+\s+)?role\s+is\s+open\b|\bwe(?:'|’)re\s+always\s+interested\s+(?:in\s+meeting|to\s+meet)\b"
    r"|\bno\s+(?:current|open)\s+(?:positions|openings|vacancies)\b|\b(?:campus|student|college)\s+ambassador\b"
    r"|\beven\s+(?:when|if)\s+there\s+(?:may\s+not\s+be|is\s+not|isn(?:'|’)t)\s+an?\s+(?:immediate|current|open)\s+(?:opening|position|vacancy|role)\b|\bsubmit\s+your\s+(?:resume|cv)\s+for\s+future\s+(?:consideration|opportunities|openings)\b"
)
#: Wording of the soft labels.
NIGHT_SHIFT = (
    r"(?i)\b(?:overlap|work|working|available|availability)\b[^.\n]{0,50}\b(?:us|u\.s\.|pacific|eastern|central|mountain|north\s+american?)\b[^.\n]{0,20}\b(?:hours?|time\s*zones?)\b"
    r"|\b(?:est|pst|cst|pdt|edt|cet|cest)\s+(?:hours|time\s*zone|working\s+hours|business\s+hours|shift)\b|\bus\s+(?:time\s*zone|business\s+hours|shift|hours)\b|\bnight\s+shift\b|\boverlap\s+with\s+(?:the\s+)?(?:us|north\s+america|european)\b"
)
FREELANCE = r"(?i)\bfreelanc\w*\b|\bcontractor\b|\bindependent\s+contractor\b"
OCCASIONAL_OFFICE = (
    r"(?i)\b(?:visit|come\s+(?:in|to)|travel\s+to|meet\s+(?:at|in))\s+(?:the\s+|our\s+)?office\b[^.\n]{0,30}\b(?:once|twice|occasionally|quarterly|monthly|every)\b"
    r"|\boccasional\s+(?:office|travel|visits?)\b|\bquarterly\s+(?:offsites?|meetups?|get[- ]?togethers?)\b"
)
SAYS_REMOTE = r"(?i)\bremote(?:ly)?\b|\bwork(?:ing)?\s+(?:from\s+(?:home|anywhere)|virtually)\b|\bwfh\b|\bdistributed\s+team\b|\banywhere\b"

#: Words of which a text must hold one for each flag (``held``).
NAMED = {
    "fee_requested": known("fee fees charge charges deposit amount pay transfer"), "unpaid": known("unpaid paid pay payment salary stipend compensation remuneration volunteer equity share shares exchange"),
    "commission_only": known("commission commissions salary salaried pay"), "too_good": known("interview interviews guarantee guaranteed placement pay earn"),
    "not_a_job": known("apply conversion role always position positions opening openings vacancy vacancies ambassador submit"), "suspicious_contact": known("whatsapp whats telegram"),
}


def _unguarded(text: Column, pattern: str, before: int = 70, after: int = 60) -> Column:
    clear = lambda m: ~F.right(m["before"], F.lit(70)).rlike(NEGATED_BEFORE) & ~F.left(m["after"], F.lit(60)).rlike(NEGATED_AFTER)
    return F.filter(around(text, pattern, before, after, start=WORD), clear)


def _said(hits: Column) -> Column:
    return F.get(hits, F.lit(0))["said"]


def hard_flags(title: Column, description: Column, source: Column | None = None, words: Column | None = None) -> Column:
    """Array of struct(flag, evidence), by flag, with the first wording that raises it. Null texts say nothing. ``words``: what
    both texts hold, if that is known (``held``)."""
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    text = F.concat_ws("\n", title, description)
    weak = F.get(_unguarded(text, FEE_WEAK, 120, 120), F.lit(0))
    asked = let(weak, lambda m: F.when(F.concat(m["before"], m["said"], m["after"]).rlike(CANDIDATE_PAYS), m["said"]))
    fee = F.when(says(text, "fee", "charge", "deposit", "amount", "pay", "transfer"), F.coalesce(_said(_unguarded(text, FEE_STRONG)), asked))
    unpaid = F.when(says(text, "paid", "pay", "salary", "stipend", "compensation", "remuneration", "volunteer", "equity", "share", "exchange"), _said(_unguarded(F.regexp_replace(text, at_words(UNPAID_BENEFIT), " "), UNPAID)))
    commission = F.when(says(text, "commission", "salar", "pay"), _said(_unguarded(text, COMMISSION_ONLY)))
    good = F.when(says(text, "interview", "guarantee", "100", "pay", "earn"), _said(_unguarded(text, TOO_GOOD)))
    not_open = F.when(says(description, "apply", "conversion", "role", "always", "position", "opening", "vacanc", "ambassador", "submit"), first(description, at_words(NOT_A_JOB_TEXT)))
    chats = F.filter(around(text, CHAT, 80, 80, start=WORD), lambda m: F.concat(m["before"], m["said"], m["after"]).rlike(CONTACT))
    chat = F.when(says(text, "whats", "telegram") & ~F.coalesce(source if source is not None else F.lit(""), F.lit("")).isin(*KNOWN_BOARDS), _said(chats))
    found = {"fee_requested": fee, "unpaid": unpaid, "commission_only": commission, "too_good": good, "not_a_job": not_open, "suspicious_contact": chat}
    quote = lambda c: F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(80))

    def raised(w: Column) -> Column:
        named = {k: F.when(has(w, NAMED[k]), c) for k, c in found.items()}
        named["not_a_job"] = F.coalesce(first(title, NOT_A_JOB_TITLE), first(title, CAMPUS_BATCH_TITLE), named["not_a_job"])
        return F.filter(F.array(*[F.struct(F.lit(k).alias("flag"), quote(c).alias("evidence")) for k, c in named.items()]), lambda x: x["evidence"].isNotNull())

    return within(words, text, raised)


def soft_labels(title: Column, description: Column, kind: Column | None = None, source: Column | None = None, remote: Column | None = None) -> Column:
    """Array of labels. ``kind``: the stated employment type; ``source`` and ``remote``: for postings that only the aggregator,
    not their own text, calls remote."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    blanket = F.lit(False) if source is None or remote is None else source.eqNullSafe("himalayas") & remote.eqNullSafe("remote") & ~text.rlike(SAYS_REMOTE)
    named = {
        "night_shift": says(text, "overlap", "hour", "zone", "shift") & text.rlike(at_words(NIGHT_SHIFT)), "freelance": let(F.concat_ws("\n", text, kind if kind is not None else F.lit("")), lambda c: says(c, "freelanc", "contractor") & c.rlike(at_words(FREELANCE))),
        "occasional_office": says(text, "office", "occasional", "quarterly") & text.rlike(at_words(OCCASIONAL_OFFICE)), "remote_unverified": blanket,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))
