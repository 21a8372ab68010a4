"""Word lists and tables that results depend on. Larger taxonomies are parameters (see `skills`)."""

from __future__ import annotations

# --- fixed values: title words -------------------------------------------------------------------------------------
NOISE = (
    "senior sr junior jr lead principal staff associate intern internship mid level i ii iii iv v remote hybrid contract "
    "contractor freelance fulltime full time part the and of for a an in at to with m f d w x h"
).split()
SYNONYMS = {
    "developer": "engineer", "dev": "engineer", "programmer": "engineer", "engineering": "engineer", "swe": "software",
    "sde": "software", "js": "javascript", "golang": "go", "k8s": "kubernetes", "analytics": "analyst", "scientist": "science",
    "designers": "designer", "mgr": "manager", "management": "manager", "administrator": "admin", "ops": "operations",
    "mathematics": "math", "maths": "math",
}
ROLE_NOUNS = (
    "engineer analyst science manager director designer nurse practitioner teacher tutor lecturer professor accountant "
    "coordinator specialist consultant architect admin technician assistant officer representative executive paralegal "
    "attorney lawyer recruiter writer editor clerk operator driver advocate dietitian receptionist secretary therapist "
    "pharmacist physician researcher instructor planner buyer auditor controller strategist marketer agent supervisor"
).split()
PHRASES = [
    (r"front[\s-]*end", "frontend"), (r"back[\s-]*end", "backend"), (r"full[\s-]*stack", "fullstack"), (r"\bml\b", "machine learning"),
    (r"\bsre\b", "site reliability"), (r"\bqa\b", "quality assurance"), (r"\bui\s*/\s*ux\b", "ux"), (r"\bdev\s*ops\b", "devops"),
    (r"\bdata\s*base", "database"),
]

# --- fixed values: places ------------------------------------------------------------------------------------------
ANYWHERE = ["remote", "anywhere", "worldwide", "global"]
COUNTRIES = {
    "united kingdom": ["uk", "u.k.", "united kingdom", "england", "scotland", "wales", "great britain", "britain", "gb"],
    "united states": ["us", "u.s.", "usa", "united states", "america"],
    "germany": ["germany", "deutschland", "de"],
    "france": ["france"], "spain": ["spain"], "netherlands": ["netherlands", "holland"], "ireland": ["ireland"], "india": ["india"],
    "canada": ["canada"], "australia": ["australia"], "singapore": ["singapore"], "poland": ["poland"], "portugal": ["portugal"],
    "italy": ["italy"], "sweden": ["sweden"], "switzerland": ["switzerland"],
}
CITIES = {
    "united kingdom": "london manchester birmingham leeds bristol edinburgh glasgow cambridge oxford liverpool belfast".split(),
    "united states": ["new york", "san francisco", "seattle", "austin", "boston", "chicago", "los angeles", "denver", "atlanta", "washington", "miami", "dallas", "california", "texas"],
    "germany": "berlin munich hamburg frankfurt cologne".split(),
    "france": ["paris", "lyon"], "spain": ["madrid", "barcelona"], "netherlands": ["amsterdam", "rotterdam"], "ireland": ["dublin"],
    "india": "bangalore bengaluru mumbai delhi hyderabad pune chennai gurgaon noida kolkata".split(),
    "canada": ["toronto", "vancouver", "montreal"], "australia": ["sydney", "melbourne"], "poland": ["warsaw", "krakow"],
    "portugal": ["lisbon", "porto"], "italy": ["milan", "rome"], "sweden": ["stockholm"], "switzerland": ["zurich", "geneva"],
}
REGIONS = {
    "europe": "uk united kingdom england london manchester ireland dublin germany berlin munich france paris spain madrid barcelona netherlands amsterdam belgium portugal lisbon italy milan poland warsaw sweden stockholm denmark norway finland switzerland zurich austria vienna czech prague romania greece estonia",
    "emea": "uk united kingdom london ireland germany france spain netherlands poland portugal italy uae dubai israel south africa egypt nigeria kenya sweden",
    "north america": "usa us united states new york san francisco california texas austin seattle boston chicago canada toronto vancouver montreal",
    "americas": "usa us united states canada brazil mexico argentina colombia chile",
    "apac": "india bangalore bengaluru mumbai delhi hyderabad pune chennai singapore australia sydney melbourne japan tokyo philippines vietnam indonesia malaysia new zealand",
    "asia": "india bangalore bengaluru hyderabad singapore japan philippines vietnam indonesia malaysia",
    "latam": "brazil mexico argentina colombia chile peru",
}

# --- fixed values: sources, kinds of employment, weights -------------------------------------------------------------
SOURCE_PRIORITY = {"greenhouse": 0, "lever": 0, "ashby": 0, "url": 1, "linkedin": 2, "manual": 1, "adzuna": 4}
OTHER_PRIORITY = 3
EMPLOYMENT = {
    "full_time": ["full", "permanent"], "part_time": ["part"], "contract": ["contract", "freelance"],
    "temporary": ["temporary", "temp"], "internship": ["intern"],
}
LEGAL_FORMS = "inc|llc|ltd|limited|gmbh|corp|corporation|co|plc|sa|ag|bv"
SENIOR_TITLE = r"\b(senior|sr\.?|lead|principal|staff|head of|director)\b"
JUNIOR_TITLE = r"\b(intern|internship|junior|jr\.?|graduate|trainee)\b"
WEIGHTS = {"skills": 0.40, "requirements": 0.20, "role": 0.15, "experience": 0.15, "semantic": 0.10}
RELATED_CREDIT = 0.5

# --- fixed values: words that carry no meaning in a posting ----------------------------------------------------------
STOP = (
    "a an and are as at be by for from has have in is it its of on or our that the their this to we will with you your "
    "about all also any can more must other per such team work working years year experience strong ability "
    "skills including etc new over us who what when which role job responsibilities requirements qualifications "
    "company looking join help build using use well within across candidate position opportunity benefits "
    "able excellent good great solid proven knowledge understanding familiarity familiar proficiency proficient "
    "plus bonus nice preferred required requirement must should would like ideal ideally least minimum demonstrated "
    "relevant related similar equivalent field environment environments based high level highly hands ensure "
    "within into through both each other them they these those where while you'll we're you're it's"
).split()

# --- fixed values: skills --------------------------------------------------------------------------------------------
SOFT_CATEGORY = "Professional Skills"
CONTEXT_WORDS = 8
NEGATIONS = ["no", "not", "without", "never", "non", "nor"]
CLAUSE_WORDS = ["but", "however", "whereas"]
SEASON_YEAR = r"(?i)\b(?:spring|summer|fall|autumn|winter)\s+(?:term\s+|semester\s+|of\s+)?'?\d{2,4}\b"

# --- fixed values: requirement lines, years, titles, degrees ---------------------------------------------------------
PREFERRED_HEADING = r"(?im)^\W*(nice[\s-]*to[\s-]*haves?|preferred|bonus|good to have|desirable|a plus|pluses|extra credit|what would (?:make you|set you)|ideal(?:ly)?)\b.*$"
REQUIRED_HEAD = r"(?i)(requirement|qualification|what you(?:'ll)? (?:need|bring)|who you are|about you|you have|you(?:'ll)? have|must[\s-]have|skills|what we(?:'re| are) looking for|experience|your profile|you should|you bring|ideal candidate)"
PREFERRED_HEAD = r"(?i)(nice[\s-]*to[\s-]*have|preferred|bonus|good to have|desirable|a plus|pluses|extra credit|ideal)"
SKIPPED_HEAD = (
    r"(?i)(benefit|perk|what we offer|we offer|about us|about the company|who we are|why (?:join|us|work)|compensation|salary|equal opportunit|diversity|our values|"
    r"how to apply|interview process|responsibilit|what you(?:'ll)? do|the role|about the role|day[\s-]to[\s-]day|your mission|in this role|you will|what you will)"
)
REQUIREMENT_CUE = r"(?i)\b(experience|proficien|knowledge|familiar|degree|must|required|ability to|skills?|years?|understanding|expertise|background in|certif|fluent|hands-on)\b"
BULLET = r"^\s*(?:[•\-*·▪►◦–]|\d{1,2}[.)])\s*"
ALTERNATIVES = r"(?i)\bor\b|/|\beither\b|\bsimilar\b|\bequivalent\b"
YEARS_ASKED = r"(?i)(\d{1,2})\s*\+?\s*(?:(?:-|–|to)\s*\d{1,2}\s*\+?\s*)?(?:years?|yrs?)\b[^.\n]{0,40}?experience|experience[^.\n]{0,40}?(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
YEARS_ON_LINE = r"(?i)(\d{1,2})\s*\+?\s*(?:(?:-|–|to)\s*\d{1,2}\s*\+?\s*)?(?:years?|yrs?)\b"
SENIORITY_YEARS = [
    (r"(?i)\b(principal|staff|head of|director)\b", 8), (r"(?i)\b(lead|manager)\b", 6), (r"(?i)\b(senior|sr\.?)\b", 5),
    (r"(?i)\b(junior|jr\.?|entry|graduate|intern|trainee|associate)\b", 0),
]
TITLE_NOISE = "senior sr junior jr lead principal staff associate intern ii iii i the and of for a an in at remote hybrid contract full time part".split()
WEAK_TITLE = "engineer developer specialist analyst manager".split()
NO_DEGREE = r"(?i)\b(scrum|data|branch|quarter|web|ring|post|head|station|chess|grand)[\s-]?master|master\s+(?:data|branch|class|plan|key|list|record|copy|bedroom|craftsman|of ceremon)|\bmaster(?:ed|y|ing)\b|\bmasterclass\b"
DEGREES = [
    ("PhD", 4, r"(?i)\b(ph\.?\s?d|doctorate|doctoral degree|d\.?phil)\b"),
    ("Master's", 3, r"(?i)\bmaster'?s\b(?!\s+(?:data|branch|class))|\bmasters?\s+(?:degree|of|in)\b|\bmaster\s+of\s+(?:science|arts|business|engineering|technology|computer|education|public|fine|laws?|philosophy|commerce|information)|\bm\.\s?sc\b|\bmsc\b|\bm\.s\.(?=\s|$)|\bm\.?s\.?\s+in\b|\bmba\b|\bm\.?eng\b|\bm\.?\s?tech\b|post-?graduate degree"),
    ("Bachelor's", 2, r"(?i)\b(bachelor'?s?|b\.\s?sc|bsc|b\.s\.|b\.a\.|b\.?eng|b\.?\s?tech|undergraduate degree|(?:university|college) degree|degree in)\b"),
]
DEGREE_CUE = r"(?i)\b(degree|bachelor'?s?|ph\.?\s?d|doctorate|bsc|msc|b\.s\.|m\.s\.|mba|b\.?\s?tech|m\.?\s?tech)\b|\bmaster'?s\b|\bmasters?\s+(?:degree|of|in)\b"
DEGREE_SOFTENER = r"(?i)\b(or equivalent|equivalent (?:practical |work )?experience|preferred|a plus|nice to have|desirable|or similar experience|bonus)\b"

# --- fixed values: words that name a role --------------------------------------------------------------------------
ROLE_WORD = (
    r"(?i)\b(engineer|developer|analyst|manager|designer|nurse|teacher|scientist|consultant|accountant|specialist|assistant|officer|director|lead|intern|architect|administrator|coordinator|executive|"
    r"representative|technician|programmer|writer|editor|researcher|recruiter|driver|operator|associate|advisor|adviser|attorney|lawyer|paralegal|pharmacist|therapist|chef|marketer)s?\b"
)

# --- fixed values: words that an embedding leaves out -----------------------------------------------------------------
STOP_EMBED = frozenset(
    "a an the and or of in on to with for at by from as is are be we you our your this that will have has using use experience strong ability skills skill work working years year".split()
)
