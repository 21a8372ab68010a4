"""Postings out of web pages: structured data, page text as fallback, result cards, details, stated salaries, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text, let, parse_date

# --- fixed values: cues, hosts, money, marks of cards ---------------------------------------------------------------------
CUES = [r"\brequirements?\b", r"\bqualifications?\b", r"\bresponsibilit", r"\bapply\b", r"\bexperience\b", r"\b(?:full|part)[\s-]time\b", r"\bsalary\b|\bcompensation\b", r"\bwhat you'?ll\b"]
BLOCKING_HOSTS = ["wellfound.com", "angel.co", "indeed.com", "glassdoor.com"]
CURRENCY = r"(?:[$£€₹]|USD|GBP|EUR|INR|CAD|AUD)"
AMOUNT = r"\d{1,3}(?:[,.\s]\d{2,3})*(?:\.\d+)?\s*(?:[kK]|LPA|lpa|lakhs?)?"
PERIOD = r"(?:per|a|an|/)\s*(?:year|annum|yr|hour|hr|month|mo|day)|annually|hourly|p\.?a\.?"
SALARY = rf"(?i)({CURRENCY}\s?{AMOUNT}(?:\s*(?:-|–|to)\s*{CURRENCY}?\s?{AMOUNT})?(?:\s*(?:{PERIOD}))?)"
NOISE_AMOUNT = rf"(?i)^{CURRENCY}\s?\d{{1,2}}$"
THIN = 400
LOCAL = r"(^|\.)(localhost|local|internal)$"
PRIVATE = r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^198\.(1[89]|51)\.|^203\.0\.113\.|^(22[4-9]|2[3-5]\d)\."


def salary_from_text(text: Column) -> Column:
    """The first amount with a currency, of at most 60 characters, or an empty text; a bare small amount is none."""
    told = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SALARY), F.lit(1)), lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" -–")))
    digits = lambda s: F.length(F.regexp_replace(F.element_at(F.split(s, "[-–]"), 1), r"\D", ""))
    return F.coalesce(F.substring(F.get(F.filter(told, lambda s: (digits(s) >= 2) & ~s.rlike(NOISE_AMOUNT)), F.lit(0)), 1, 60), F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def rejected(url: Column) -> Column:
    """Why an address is no public web page, or null."""
    host = F.regexp_replace(host_of(url), r"\.+$", "")
    return F.when((host == "") | ~F.contains(host, F.lit(".")), "not a public web link").when(host.rlike(LOCAL) | (host.rlike(r"^[\d.]+$") & host.rlike(PRIVATE)), "not a public website")


def fetchable(url: Column) -> Column:
    host = host_of(url)
    blocked = F.lit(False)
    for h in (*BLOCKING_HOSTS, "linkedin.com"):
        blocked = blocked | host.endswith(h)
    return (host != "") & ~blocked


def json_at(node: Column, path: str) -> Column:
    return F.get_json_object(node, f"$.{path}")


def nodes_of(text: Column) -> Column:
    """The elements of a JSON array as texts, or the one object."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def posting_node(scripts: Column) -> Column:
    """The first node of kind JobPosting in scripts of linked data: itself, in a list, or up to two levels in a graph, entity or list."""
    deeper = lambda nodes: F.concat(nodes, F.flatten(F.transform(nodes, lambda n: F.flatten(F.array(*(nodes_of(json_at(n, k)) for k in ("@graph", "mainEntity", "itemListElement")))))))
    known = F.flatten(F.transform(scripts, lambda s: F.coalesce(nodes_of(s), F.array().cast("array<string>"))))
    return let(let(known, deeper), lambda some: F.get(F.filter(deeper(some), lambda n: F.coalesce(json_at(n, "@type"), F.lit("")).rlike(r'(^|")JobPosting("|$)')), F.lit(0)))


def place_of(node: Column) -> Column:
    """Localities, regions and countries of all places, and whether the job is remote."""
    one = lambda a: F.when(F.ltrim(a).startswith("{"), F.array_join(F.filter(F.array(json_at(a, "addressLocality"), json_at(a, "addressRegion"), F.coalesce(json_at(a, "addressCountry.name"), json_at(a, "addressCountry"))), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")).otherwise(a)
    places = F.filter(F.transform(nodes_of(json_at(node, "jobLocation")), lambda p: one(json_at(p, "address"))), lambda x: F.coalesce(x, F.lit("")) != "")
    told = F.array_join(places, "; ")
    away = F.coalesce(json_at(node, "jobLocationType") == "TELECOMMUTE", F.lit(False))
    return F.when(away & (told != ""), F.concat(told, F.lit(" (remote)"))).when(away, "Remote").otherwise(told)


def page_postings(pages: DataFrame) -> DataFrame:
    """url, ok, id, title, company, location, posted, description, employment_type, remote, salary, structured, of pages (url, html).

    A page gives its linked data's posting; else its title and main text, if that is longer than 300 characters and has
    two cues of a posting; else it isn't ok and all else is null. Null pages aren't ok. Repeated pages give rows each.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    named = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", r"(?is)<title[^>]*>(.*?)</title>")), F.lit(""))
    body = F.coalesce(*(F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*)</{t}>", 1), F.lit("")) for t in ("main", "article", "body")), F.lit(""))
    rows = pages.select("url", posting_node(scripts).alias("node"), F.trim(named).alias("page_title"), html_to_text(body).alias("text"))
    cues = sum((F.col("text").rlike(f"(?i){c}").cast("int") for c in CUES), F.lit(0))
    plain = (F.col("page_title") != "") & (F.length("text") > 300) & (cues >= 2)
    rows = rows.withColumn("structured", F.col("node").isNotNull()).withColumn("ok", F.col("structured") | plain)
    node, own = F.col("node"), F.col("structured")
    kinds = F.from_json(json_at(node, "employmentType"), "array<string>")
    kind = F.when(F.startswith(json_at(node, "employmentType"), F.lit("[")), F.array_join(kinds, ", ")).otherwise(F.lower(F.replace(json_at(node, "employmentType"), F.lit("_"), F.lit(" "))))
    value = lambda k: F.coalesce(json_at(node, f"baseSalary.value.{k}"), F.lit(""))
    pay = F.btrim(F.concat(value("minValue"), F.lit("–"), value("maxValue"), F.lit(" "), F.coalesce(json_at(node, "baseSalary.currency"), F.lit("")), F.lit(" "), value("unitText")), F.lit(" –"))
    company = F.coalesce(json_at(node, "hiringOrganization.name"), F.when(~F.startswith(json_at(node, "hiringOrganization"), F.lit("{")), json_at(node, "hiringOrganization")), F.lit(""))
    of = lambda told, else_=None: F.when(own, told).when(F.col("ok"), else_ if else_ is not None else F.lit(""))
    return rows.select(
        "url", "ok", F.when(F.col("ok"), F.concat(F.lit("url-"), F.substring(F.md5("url"), 1, 12))).alias("id"), of(html_to_text(json_at(node, "title")), F.substring("page_title", 1, 200)).alias("title"), of(company).alias("company"),
        of(place_of(node)).alias("location"), F.when(own, parse_date(json_at(node, "datePosted"))).alias("posted"), of(html_to_text(json_at(node, "description")), F.substring("text", 1, 20000)).alias("description"),
        of(F.coalesce(kind, F.lit(""))).alias("employment_type"), F.when(own & (json_at(node, "jobLocationType") == "TELECOMMUTE"), True).alias("remote"), of(F.when(json_at(node, "baseSalary.value").isNotNull(), pay).otherwise("")).alias("salary"), "structured",
    )


def inner(html: Column, mark: str) -> Column:
    """The text within the first element whose opening tag holds a mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<(\w+)\b[^>]*{mark}[^>]*>(.*?)</\1>", 2), r"<[^>]*>", " "), r"\s+", " "))


def cards(pages: DataFrame) -> DataFrame:
    """id, title, company, location, url, posted of each card of result pages (html); of cards of one id the first of a page."""
    parts = F.split("html", r"(?i)(?=<div[^>]*\bbase-card\b)")
    each = pages.select(F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("at", "card"))
    link = F.regexp_extract("card", r"""(?i)<a[^>]*href=["']([^"'?]*)[^"']*["'][^>]*base-card__full-link|<a[^>]*base-card__full-link[^>]*href=["']([^"'?]*)""", 1)
    link = F.coalesce(F.nullif(link, F.lit("")), F.regexp_extract("card", r"""(?i)<a[^>]*base-card__full-link[^>]*href=["']([^"'?]*)""", 1))
    number = F.coalesce(F.nullif(F.regexp_extract("card", r"jobPosting:(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(link, r"-(\d{6,})$", 1), F.lit("")))
    told = each.select(
        "at", number.alias("id"), inner(F.col("card"), "base-search-card__title").alias("title"), inner(F.col("card"), "base-search-card__subtitle").alias("company"),
        inner(F.col("card"), "job-search-card__location").alias("location"), link.alias("url"), F.regexp_extract("card", r"""(?i)<time[^>]*datetime=["']([^"']*)""", 1).alias("posted"),
    ).where("id is not null and title <> ''")
    first = told.groupBy("id").agg(F.min_by(F.struct("title", "company", "location", "url", "posted"), "at").alias("c"))
    url = F.coalesce(F.nullif("c.url", F.lit("")), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("id")))
    return first.select("id", "c.title", "c.company", "c.location", url.alias("url"), "c.posted")


def details(pages: DataFrame) -> DataFrame:
    """`pages` with description, seniority, employment_type and extra (function, industries) of a detail page's html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_extract(html, r"""(?is)<div[^>]*class=["'][^"']*(?:show-more-less-html__markup|description__text)[^"']*["'][^>]*>(.*?)</div>""", 1)
    items = F.regexp_extract_all(html, F.lit(r"""(?is)<li[^>]*description__job-criteria-item[^>]*>(.*?)</li>"""), F.lit(1))
    pairs = F.transform(items, lambda i: F.struct(F.lower(inner(i, "description__job-criteria-subheader")).alias("k"), inner(i, "description__job-criteria-text").alias("v")))
    told = lambda name: F.coalesce(F.get(F.transform(F.filter(pairs, lambda p: p["k"] == name), lambda p: p["v"]), F.lit(0)), F.lit(""))
    extra = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["k"].isin("job function", "industries")), lambda p: F.struct(p["k"], p["v"])))
    return pages.withColumns({"description": html_to_text(body), "seniority": told("seniority level"), "employment_type": told("employment type"), "extra": extra})


def needs_enrichment(description: Column, truncated: Column, salary: Column) -> Column:
    thin = F.length(F.coalesce(description, F.lit(""))) < THIN
    return thin | F.coalesce(truncated, F.lit(False)) | (F.coalesce(salary, F.lit("")) == "")


def enriched(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """`postings` (url, description, salary, employment_type) with better descriptions, salaries and types from their pages.

    Of several pages of one address the one with the longest text counts. A description is replaced by one that is longer
    by over 100 characters; an empty salary or type is filled; a salary that the text states fills it last.
    """
    found = page_postings(pages).where("structured").groupBy("url").agg(F.max_by(F.struct("description", "salary", "employment_type"), F.struct(F.length("description"), F.col("salary"))).alias("_page"))
    rows = postings.join(found, "url", "left")
    thin = (F.length(F.coalesce("description", F.lit(""))) < THIN) & fetchable(F.col("url"))
    better = thin & (F.length("_page.description") > F.length(F.coalesce("description", F.lit(""))) + 100)
    text = F.when(better, F.col("_page.description")).otherwise(F.col("description"))
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.when(thin, F.nullif(F.col(f"_page.{c}"), F.lit(""))))
    pay = F.coalesce(F.nullif(F.col("salary"), F.lit("")), F.nullif(salary_from_text(F.col("description")), F.lit("")), filled("salary"), salary_from_text(text))
    return rows.withColumns({"description": text, "salary": pay, "employment_type": F.coalesce(filled("employment_type"), F.lit("")), "enriched": F.coalesce(better, F.lit(False))}).drop("_page")


def import_results(urls: DataFrame, pages: DataFrame, most: int = 100) -> DataFrame:
    """url, ok, title, company, message of each distinct address (pos, url), the first `most`: what came of its page."""
    asked = urls.where("trim(url) <> ''").groupBy(F.trim("url").alias("url")).agg(F.min("pos").alias("pos")).orderBy("pos").limit(most)
    got = page_postings(pages).groupBy("url").agg(F.max(F.struct("ok", "title", "company")).alias("p"))
    why = F.when(rejected(F.col("url")).isNotNull(), rejected(F.col("url"))).when(F.col("p").isNull(), "no page").when(~F.col("p.ok"), "no posting found").otherwise("")
    ok = F.coalesce(F.col("p.ok"), F.lit(False)) & rejected(F.col("url")).isNull()
    return asked.join(got, "url", "left").select("url", ok.alias("ok"), F.when(ok, F.col("p.title")).otherwise("").alias("title"), F.when(ok, F.col("p.company")).otherwise("").alias("company"), why.alias("message"))
