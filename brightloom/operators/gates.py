"""Hard requirements of postings as gates: what is stated, how it stands for one person, and how many it holds back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import of_each_text
from ..functions.text import let

# --- fixed values: countries, languages, licences and phrases by which a posting states a gate -------------------------
COUNTRIES = {
    "us": "US", "u.s.": "US", "usa": "US", "united states": "US", "uk": "UK", "u.k.": "UK", "united kingdom": "UK", "british": "UK", "eu": "EU",
    "european union": "EU", "canadian": "Canada", "australian": "Australia",
}
LANGUAGES = (
    "English|German|French|Spanish|Italian|Portuguese|Dutch|Polish|Swedish|Danish|Norwegian|Finnish|"
    "Japanese|Mandarin|Chinese|Cantonese|Korean|Arabic|Hebrew|Hindi|Russian|Turkish|Greek|Czech"
)
UNSPONSORED = (
    r"(?i)\b(?:no|not|unable to|cannot|can't|will not|won't|do not|does not|don't)\s+(?:offer\s+|provide\s+)?(?:visa\s+)?sponsor(?:ship)?\b|"
    r"\bwithout\s+(?:the\s+need\s+for\s+)?(?:visa\s+)?sponsorship\b|\bsponsorship\s+(?:is\s+)?not\s+(?:available|offered|provided)\b"
)
AUTHORISED = (
    r"(?i)\b(?:legally\s+)?(?:authori[sz]ed|eligible|entitled|right)\s+to\s+work\s+in\s+(?:the\s+)?(US|U\.S\.|USA|United States|UK|U\.K\.|United Kingdom|EU|"
    r"European Union|Canada|Australia|Germany|India|Ireland|Netherlands|France|Singapore|New Zealand)\b"
)
CITIZEN = r"(?i)\b(?:must be|only)\s+(?:a\s+)?(US|U\.S\.|UK|British|Canadian|Australian)\s+citizens?\b"
CLEARANCE = r"(?i)\b(TS/SCI|top secret|secret|SC|DV|NV1|NV2|baseline|public trust)\s+(?:security\s+)?clearance\b|\bsecurity clearance\b|\bclearance\s+(?:is\s+)?required\b"
CLEARED = r"(?i)\b(TS/SCI|top secret|secret|SC|DV|NV1|NV2|baseline|public trust)\b[^.\n]{0,30}\bclearance\b|\b(?:active|current|held|hold)\b[^.\n]{0,20}\bclearance\b"
LANGUAGE = (
    rf"(?i)\b(?:fluent|fluency|native|proficient|proficiency|business[- ]level|professional)\s+(?:in\s+)?(?:(?:written|spoken|and|or|both|level|working)\s+)*({LANGUAGES})\b|"
    rf"\b({LANGUAGES})\s+(?:\(?(?:C1|C2|B2)\)?\s+)?(?:is\s+)?(?:required|essential|mandatory|a must)\b|\b({LANGUAGES})[- ]speaking\b"
)
SOFT = r"(?i)\b(?:a plus|nice to have|preferred|bonus|advantage|desirable|ideally)\b"
ONSITE = (
    r"(?i)\b(?:on-?site|in[- ]office|in the office)\b[^.\n]{0,40}\b(?:\d\s*days|full[- ]time|required|only|5 days|every day)\b|\bfully on-?site\b|"
    r"\b(?:must|required to)\s+(?:be\s+)?(?:located|based|live)\s+(?:in|within|near)\b|\brelocation (?:is )?required\b|\bno remote\b|\bnot (?:a )?remote\b"
)
LANGUAGES_TOLD = r"(?im)^\W*languages?\W*$|\blanguages?\s*:"
LICENCES = {
    "Registered Nurse licence": r"\b(?:rn|registered nurse)\s+(?:license|licence|licensure|registration)\b|\bactive\s+rn\b|\bnmc\s+(?:pin|registration)\b",
    "LPN licence": r"\blpn\b|\blicensed practical nurse\b",
    "CPA / chartered accountant": r"\bcpa\b(?!\s+firm)|\bchartered accountant\b|\baca\b|\bacca\s+qualified\b",
    "Bar admission / practising certificate": r"\badmitted to (?:the|practi[cs]e)|\bbar admission\b|\blicensed (?:attorney|to practi[cs]e law)\b|\bqualified solicitor\b",
    "Commercial driver's licence (CDL/HGV)": r"\bcdl\b|\bcommercial driver'?s licen[cs]e\b|\bhgv licen[cs]e\b",
    "Professional Engineer (PE/CEng)": r"\bprofessional engineer\b|\bpe licen[cs]e\b|\bchartered engineer\b",
    "Teaching licence (QTS)": r"\bteaching (?:licen[cs]e|certificat\w+|credential)\b|\bqts\b|\bqualified teacher status\b",
    "FINRA Series licence": r"\bseries\s+(?:7|63|65|66)\b",
    "Electrician licence": r"\bjourneyman\b|\bmaster electrician\b|\blicensed electrician\b",
    "CFA charter": r"\bcfa\s+charter\b|\bcfa charterholder\b",
    "CISSP certification": r"\bcissp\b",
}
#: Of each pattern a few letters of which any match has some, in lower case: texts without them aren't searched.
ANCHORS = {
    UNSPONSORED: ["sponsor"], AUTHORISED: ["work"], CITIZEN: ["citizen"], CLEARANCE: ["clearance"], LANGUAGE: LANGUAGES.lower().split("|"), ONSITE: ["site", "office", "must", "required", "reloc", "remote"],
    "Registered Nurse licence": ["rn", "registered", "nmc"], "LPN licence": ["lpn", "practical"], "CPA / chartered accountant": ["cpa", "chartered", "aca", "acca"],
    "Bar admission / practising certificate": ["admitted", "admission", "licensed", "solicitor"], "Commercial driver's licence (CDL/HGV)": ["cdl", "commercial", "hgv"],
    "Professional Engineer (PE/CEng)": ["professional engineer", "pe licen", "chartered"], "Teaching licence (QTS)": ["teaching", "qts", "teacher"], "FINRA Series licence": ["series"],
    "Electrician licence": ["journeyman", "electrician"], "CFA charter": ["cfa"], "CISSP certification": ["cissp"],
}
LABELS = {"authorization": "work authorization", "clearance": "security clearance", "license": "licence", "language": "language", "onsite": "on-site location", "degree": "degree"}
WITHIN_EU = ["GERMANY", "FRANCE", "IRELAND", "NETHERLANDS"]

GATE = "struct<type: string, need: string, text: string, no_sponsorship: boolean>"
END = r"(?s)(?:\n|\. |; )"


@dataclass(frozen=True)
class Eligibility:
    """What a person says of themselves; None is unknown."""

    countries: tuple[str, ...] = ()
    needs_sponsorship: bool | None = None
    clearance: str = ""
    licences: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    relocate: bool | None = None
    remote_only: bool = False


def country(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(name)), F.when(F.length(name) > 3, F.initcap(name)).otherwise(F.upper(name)))


def clause(text: Column, at: Column, found: Column) -> Column:
    """The clause, up to line, sentence or semicolon ends, around what was `found` at place `at` (from 1); at most 220 characters."""
    before = F.substring(text, F.lit(1), at - 1)
    tail = F.substring(text, at + F.length(found), F.length(text))
    start = F.regexp_replace(before, r"(?s)^.*(?:\n|\. |; )", "")
    end = F.element_at(F.split(tail, END, 2), 1)
    return F.substring(F.btrim(F.regexp_replace(F.concat(start, found, end), r"\s+", " "), F.lit(" -•*;.")), 1, 220)


def has_any(low: Column, anchors: list[str] | None) -> Column:
    """Whether a text in lower case may match a pattern of these anchors."""
    maybe = F.lit(not anchors)
    for word in anchors or []:
        maybe = maybe | F.contains(low, F.lit(word))
    return maybe


def anchored(line: Column) -> Column:
    """array<int>: numbers of ANCHORS of which a line has some. As no anchor has a line end, a text has those of its lines."""
    numbers = lambda low: F.array_compact(F.array(*(F.when(has_any(low, words), k) for k, words in enumerate(ANCHORS.values()))))
    return let(F.lower(line), numbers)


def first_of(text: Column, low: Column, pattern: str, group: int = 1, anchors: list[str] | Column | None = None) -> Column:
    """struct<group, text> of the first match of a pattern, or null; `low` is the text in lower case. `anchors` are its letters, or whether there are some."""
    maybe = has_any(low, anchors) if anchors is None or isinstance(anchors, list) else anchors
    told = F.struct(F.regexp_extract(text, pattern, group).alias("group"), clause(text, F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)).alias("text"))
    return F.when(maybe & text.rlike(pattern), told)


def detected(description: Column, title: Column, licences: dict[str, str] | None = None, lines: Column | None = None, of_title: Column | None = None) -> Column:
    """array of GATE: each gate that a posting states, with the clause that states it first.

    A right to work counts before citizenship, and that before refused sponsorship. A softened clause states no language,
    licence or clearance. A null description states none. `lines` and `of_title` are the numbers of `anchored` of the
    description's lines and of the title, where they are known.
    """
    places = {name: k for k, name in enumerate(ANCHORS)}
    known = lines is not None

    def some(name: str, title_too: bool = False):
        if not known or name not in places:
            return ANCHORS.get(name)
        here = F.array_contains(lines, places[name])
        return here | F.array_contains(of_title, places[name]) if title_too else here

    gate = lambda kind, need, told, refused=None: F.struct(F.lit(kind).alias("type"), need.alias("need"), told.alias("text"), (F.lit(False) if refused is None else refused).alias("no_sponsorship")).cast(GATE)

    def work(text: Column, low: Column) -> Column:
        find = lambda pattern, group=1: first_of(text, low, pattern, group, some(pattern))
        refusal = lambda r: let(find(CITIZEN), lambda c: F.when(c.isNotNull(), gate("authorization", country(c["group"]), c["text"], F.lit(True))).when(r.isNotNull(), gate("authorization", F.lit(""), r["text"], F.lit(True))))
        return let(find(UNSPONSORED, 0), lambda r: let(find(AUTHORISED), lambda a: F.when(a.isNotNull(), gate("authorization", country(a["group"]), a["text"], r.isNotNull())).otherwise(refusal(r))))

    def clearance(text: Column, low: Column) -> Column:
        whole = F.concat_ws("\n", text, title)

        def told(held: Column) -> Column:
            softened = held["text"].rlike(SOFT) & (F.regexp_instr(whole, F.lit(CLEARANCE)) <= F.length(text))
            level = F.when(held["group"] == "", "Security").otherwise(held["group"])
            return F.when(held.isNotNull() & ~softened, gate("clearance", F.when(F.length(level) <= 6, F.upper(level)).otherwise(F.initcap(level)), held["text"]))

        return let(first_of(whole, F.lower(whole), CLEARANCE, 1, some(CLEARANCE, True)), told)

    def paper(text: Column, low: Column, name: str, pattern: str) -> Column:
        return let(first_of(text, low, f"(?i){pattern}", 0, some(name)), lambda p: F.when(p.isNotNull() & ~p["text"].rlike(SOFT), gate("license", F.lit(name), p["text"])))

    def tongues(text: Column, low: Column) -> Column:
        maybe = some(LANGUAGE) if known else has_any(low, ANCHORS[LANGUAGE])
        need = lambda m: F.initcap(F.coalesce(*(F.nullif(F.regexp_extract(m, LANGUAGE, k), F.lit("")) for k in (1, 2, 3))))
        spoken = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(LANGUAGE), F.lit(0))), lambda m: F.struct(need(m).alias("need"), clause(text, F.position(m, text), m).alias("text")))
        firsts = lambda hard: F.filter(hard, lambda t, i: ~F.exists(F.slice(hard, 1, i), lambda u: u["need"] == t["need"]))
        told = F.transform(let(F.filter(spoken, lambda t: ~t["text"].rlike(SOFT)), firsts), lambda t: gate("language", t["need"], t["text"]))
        return F.when(maybe, told).otherwise(F.array().cast(f"array<{GATE}>"))

    def all_gates(text: Column, low: Column) -> Column:
        onsite = let(first_of(text, low, ONSITE, 0, some(ONSITE)), lambda p: F.when(p.isNotNull(), gate("onsite", F.lit(""), p["text"])))
        papers = [paper(text, low, name, pattern) for name, pattern in (licences or LICENCES).items()]
        return F.concat(F.array_compact(F.array(work(text, low), clearance(text, low), *papers)), tongues(text, low), F.array_compact(F.array(onsite)))

    found = let(F.coalesce(description, F.lit("")), lambda text: let(F.lower(text), lambda low: all_gates(text, low)))
    return F.when((F.size(lines) > 0) | (F.size(of_title) > 0), found).otherwise(F.array().cast(f"array<{GATE}>")) if known and licences is None else found


def is_gate_line(line: Column, gates: Column) -> Column:
    """Whether a requirement line just states a gate: one holds the other."""
    plain = F.lower(F.btrim(F.regexp_replace(line, r"\s+", " "), F.lit(" -•*")))
    return F.exists(gates, lambda g: (g["type"] != "onsite") & (plain != "") & (F.contains(F.lower(g["text"]), plain) | F.contains(plain, F.lower(g["text"]))))


def judged(gates: Column, person: Eligibility, resume: str = "", location_ok: Column | None = None, licences: dict[str, str] | None = None) -> Column:
    """array<struct<type, need, text, status, label>>: pass or fail where the person's answers or resume settle a gate, else unknown."""
    said = F.lit(resume)
    any_of = lambda values: F.lit([v for v in values]).cast("array<string>")
    mine, spoken = [c.upper() for c in person.countries], [x.lower() for x in person.languages]
    known = " ".join(person.licences)

    def status(g: Column) -> Column:
        kind, need = g["type"], g["need"]
        within = F.array_contains(any_of(mine), F.upper(need)) | ((F.upper(need) == "EU") & F.lit(bool(set(mine) & {"EU", *WITHIN_EU})))
        by_country = F.when(within, "pass").when(g["no_sponsorship"] | F.lit(person.needs_sponsorship is not False), "fail")
        by_sponsor = F.when(g["no_sponsorship"], F.lit({None: None, True: "fail", False: "pass"}[person.needs_sponsorship]).cast("string"))
        work = F.when((need != "") & F.lit(bool(mine)), by_country).otherwise(by_sponsor)
        clearance = F.when(F.lit(bool(person.clearance)) | said.rlike(CLEARED), "pass").otherwise("fail")
        holds = F.exists(any_of(x.lower() for x in person.licences), lambda x: F.contains(x, F.lower(need)))
        for name, pattern in (licences or LICENCES).items():
            holds = holds | ((need == name) & (said.rlike(f"(?i){pattern}") | F.lit(known).rlike(f"(?i){pattern}")))
        speaks = F.array_contains(any_of(spoken), F.lower(need)) | F.array_contains(F.split(F.lower(said), r"[^\p{L}]+"), F.lower(need)) | (need == "English")
        tongue = F.when(speaks, "pass").when(F.lit(bool(spoken)) | said.rlike(LANGUAGES_TOLD), "fail")
        near = F.coalesce(location_ok, F.lit(False)) if location_ok is not None else F.lit(False)
        place = F.when(near | F.lit(person.relocate is True), "pass").when(F.lit(person.relocate is False or person.remote_only), "fail")
        told = F.when(kind == "authorization", work).when(kind == "clearance", clearance).when(kind == "license", F.when(holds, "pass").otherwise("fail"))
        return F.coalesce(told.when(kind == "language", tongue).when(kind == "onsite", place), F.lit("unknown"))

    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.transform(gates, lambda g: F.struct(g["type"].alias("type"), g["need"].alias("need"), g["text"].alias("text"), status(g).alias("status"), F.element_at(label, g["type"]).alias("label")))


def degree_gate(required: Column, have: Column, rank) -> Column:
    """array of one judged gate for a strict required degree (struct level, strict, text), or an empty one."""
    gate = F.struct(
        F.lit("degree").alias("type"), required["level"].alias("need"), required["text"].alias("text"),
        F.when(rank(have) >= rank(required["level"]), "pass").otherwise("fail").alias("status"), F.lit(LABELS["degree"]).alias("label"),
    )
    return F.array_compact(F.array(F.when(F.coalesce(required["strict"], F.lit(False)), gate)))


def stated(postings: DataFrame, licences: dict[str, str] | None = None) -> DataFrame:
    """id, type, need, text, no_sponsorship: a row for each gate of a posting (id, description and, if there is one, title)."""
    title = F.col("title") if "title" in postings.columns else F.lit("")
    rows = postings.select("id", "description", title.alias("title"))
    return of_each_text(rows, ["description", "title"], lambda texts: texts.select("_text", F.inline(detected(F.col("description"), F.col("title"), licences))))


def settled(gates: DataFrame, person: Eligibility, resume: str = "") -> DataFrame:
    """`gates` (rows of `stated`) with status and label."""
    one = judged(F.array(F.struct("type", "need", "text", "no_sponsorship")), person, resume)[0]
    return gates.withColumns({"status": one["status"], "label": one["label"]})


def held_back(scores: DataFrame, gates: DataFrame, threshold: int) -> DataFrame:
    """type, jobs: of the postings that reach `threshold`, how many fail a gate of each type."""
    failed = gates.where("status = 'fail'").select("id", "type").distinct()
    return scores.where(F.col("score") >= threshold).select("id").join(failed, "id").groupBy("type").agg(F.count("*").alias("jobs"))
