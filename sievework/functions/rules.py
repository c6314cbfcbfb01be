"""Rule-weighted classification of pages and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

PAGE_RULES: Sequence[tuple[str, tuple[str, ...]]] = (("department", ("department", "/dept", "faculty", "school of")), ("alumni", ("alumni",)), ("notice", ("notice", "announcement", "circular")))

# Each cue is "weight words": words separated by | are alternatives, a blank
# any white space, (s) an optional letter. The order of types breaks ties.
_CUES = """
scholarship_notice: 6 scholarship; 3 fresh|renewal; 4 nsp|national scholarship portal; 2 eligible|eligibility
fee_circular: 4 fee; 4 college fee|exam fee|hostel fee|tuition; 2 due date|fine|last date; 2 pay(ment)|remit
quotation: 8 call for quotation(s); 7 quotation(s) are invited; 5 sealed quotation(s); 3 quotation; 1 due date|last date
tender: 7 tender; 4 bid(ding)|bidder|e(-)tender; 4 emd|nit
office_order: 8 office order; 4 proceedings; 3 memo(randum); 2 dated|order no
placement_notification: 6 placement; 4 campus drive|interview|recruitment; 2 ctc|package
hostel_notice: 7 hostel; 3 warden; 2 mess|room
timetable: 7 time( )table; 2 afternoon|an|fn|forenoon; 1 period(s)|session
exam_schedule: 4 exam|examination; 4 controller of examinations; 3 hall( )ticket; 2 commencement|practical|theory
circular: 7 circular; 2 sub( ):; 2 ref( ):
notification: 7 notification; 3 hereby notified
administrative_document: 4 administrative; 4 committee; 4 minutes; 2 meeting; 2 agenda
general_announcement: 6 announcement; 6 press note; 4 notice; 2 this is to inform
academic_regulations: 6 regulation(s); 4 ordinance(s); 2 attendance|credit(s)|evaluation|grading
syllabus: 6 syllabus; 4 unit( )#dash( )#number; 3 reference(s)|text( )book(s); 2 co#digits|course outcome(s)
"""


def _pattern(words: str) -> str:
    out = []
    for alternative in words.split("|"):
        p = alternative.replace("( )", "\0").replace(" ", r"\s+").replace("(", "(?:").replace(")", ")?").replace("\0", r"\s*")
        p = p.replace("#dash", "[-–—]?").replace("#number", "(?:[ivxlcdm]+|[0-9]+)").replace("#digits", "[0-9]+")
        out.append(p)
    return rf"\b(?:{'|'.join(out)})\b"


def parse_rules(text: str = _CUES) -> list[tuple[str, list[tuple[str, int]]]]:
    """[(type, [(pattern, weight)])] in order."""
    rules = []
    for line in text.strip().splitlines():
        kind, cues = line.split(": ", 1)
        rules.append((kind, [(_pattern(w), int(n)) for n, w in (c.strip().split(" ", 1) for c in cues.split(";"))]))
    return rules


DOCUMENT_RULES = parse_rules()


def page_type(path: Column, url: Column, title: Column, content: Column, rules: Sequence[tuple[str, tuple[str, ...]]] = PAGE_RULES) -> Column:
    """First rule of which a cue occurs in URL, title or the content's first 2000 characters; the site's root is homepage."""
    p = F.lower(path)
    seen = F.lower(F.concat_ws(" ", url, title, F.substring(content, 1, 2000)))
    out = F.when(p.isin("", "/") | p.endswith("/index.html") | p.endswith("/index.php"), "homepage")
    for kind, cues in rules:
        hit = F.lit(False)
        for c in cues:
            hit = hit | seen.contains(c)
        out = out.when(hit, kind)
    return out.otherwise("general")


def classification_sample(title: Column, pages: Column, max_chars: int = 20000) -> Column:
    """Title and the non-empty ones of the first two pages, squeezed, lower-cased and cut."""
    parts = F.filter(F.concat(F.array(F.coalesce(title, F.lit(""))), F.slice(pages, 1, 2)), lambda x: x != "")
    return F.substring(F.lower(squeeze(F.array_join(parts, "\n"))), 1, max_chars)


def document_scores(sample: Column, rules=None) -> list[tuple[str, Column]]:
    """Score of each type: the weights of the cues that occur, each once."""
    out = []
    for kind, cues in DOCUMENT_RULES if rules is None else rules:
        total = F.lit(0)
        for pattern, weight in cues:
            total = total + F.when(sample.rlike(pattern), weight).otherwise(0)
        out.append((kind, total))
    return out


def document_type(sample: Column, content_length: Column, rules=None, least: int = 6) -> Column:
    """The type of the highest score, the earliest of equals; unknown below ``least`` or without text."""
    scores = document_scores(sample, rules)
    ranked = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(kind).alias("kind")) for k, (kind, s) in enumerate(scores)])
    best = F.array_max(ranked)
    return F.when((content_length > 0) & (sample != "") & (best["score"] >= least), best["kind"]).otherwise("unknown")
