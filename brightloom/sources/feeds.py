"""Posting feeds as declarations: the JSON or XML schema of a payload, where its items are, and each column's SQL.

A payload is one response of a feed, recorded as a row (slug, payload); fetching is left to whatever lands the responses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text, parse_date

COLUMNS = ["id", "source", "title", "company", "location", "remote", "url", "posted", "description", "seniority", "employment_type", "salary", "tags"]
NICE = "initcap(translate(slug, '-_', '  '))"


@dataclass(frozen=True)
class Feed:
    """schema: of the payload (as `doc`). items: SQL of the array of items. columns: SQL over `item`, `doc` and `slug`."""

    schema: str
    items: str
    columns: dict[str, str]
    keep: str = "true"
    xml: bool = False
    plain: frozenset = field(default_factory=frozenset)  # columns whose text is no HTML


def joined(*parts: str) -> str:
    return f"array_join(filter(array({', '.join(parts)}), x -> x <> ''), ', ')"


FEEDS = {
    "remotive": Feed(
        "jobs array<struct<id:string,title:string,company_name:string,candidate_required_location:string,url:string,publication_date:string,description:string,job_type:string,salary:string,tags:array<string>>>",
        "doc.jobs",
        {"id": "item.id", "title": "item.title", "company": "item.company_name", "location": "coalesce(nullif(trim(item.candidate_required_location), ''), 'Remote')", "remote": "true", "url": "item.url",
         "posted": "item.publication_date", "description": "item.description", "employment_type": "replace(item.job_type, '_', ' ')", "salary": "item.salary", "tags": "item.tags"},
    ),
    "remoteok": Feed(
        "array<struct<id:string,position:string,company:string,location:string,url:string,date:string,epoch:string,description:string,salary_min:string,salary_max:string,tags:array<string>>>",
        "doc",
        {"id": "item.id", "title": "item.position", "company": "item.company", "location": "coalesce(nullif(trim(item.location), ''), 'Remote')", "remote": "true", "url": "coalesce(item.url, concat('https://remoteok.com/remote-jobs/', item.id))",
         "posted": "coalesce(item.date, item.epoch)", "description": "item.description", "salary": "case when item.salary_min > 0 and item.salary_max > 0 then concat(item.salary_min, '–', item.salary_max) else '' end", "tags": "item.tags"},
        keep="item.id is not null and item.position <> ''",
    ),
    "arbeitnow": Feed(
        "data array<struct<slug:string,title:string,company_name:string,location:string,remote:boolean,url:string,created_at:string,description:string,job_types:array<string>,tags:array<string>>>",
        "doc.data",
        {"id": "item.slug", "title": "item.title", "company": "item.company_name", "location": "coalesce(nullif(trim(item.location), ''), if(item.remote, 'Remote', ''))", "remote": "coalesce(item.remote, false)", "url": "item.url",
         "posted": "item.created_at", "description": "item.description", "employment_type": "array_join(item.job_types, ', ')", "tags": "item.tags"},
    ),
    "jobicy": Feed(
        "jobs array<struct<id:string,jobTitle:string,companyName:string,jobGeo:string,url:string,pubDate:string,jobDescription:string,jobExcerpt:string,jobType:variant,jobLevel:string>>",
        "doc.jobs",
        {"id": "item.id", "title": "item.jobTitle", "company": "item.companyName", "location": "coalesce(nullif(trim(item.jobGeo), ''), 'Remote')", "remote": "true", "url": "item.url", "posted": "item.pubDate",
         "description": "coalesce(nullif(item.jobDescription, ''), item.jobExcerpt)", "employment_type": "coalesce(array_join(try_variant_get(item.jobType, '$', 'array<string>'), ', '), try_variant_get(item.jobType, '$', 'string'))", "seniority": "item.jobLevel"},
    ),
    "himalayas": Feed(
        "jobs array<struct<guid:string,applicationLink:string,title:string,companyName:string,locationRestrictions:array<string>,pubDate:string,description:string,excerpt:string,employmentType:string,seniority:array<string>,minSalary:string,maxSalary:string,currency:string,categories:array<string>>>",
        "doc.jobs",
        {"id": "substr(md5(coalesce(item.guid, item.applicationLink, item.title)), 1, 12)", "title": "item.title", "company": "item.companyName", "location": "coalesce(nullif(array_join(item.locationRestrictions, ', '), ''), 'Remote (worldwide)')",
         "remote": "true", "url": "coalesce(item.applicationLink, item.guid)", "posted": "item.pubDate", "description": "coalesce(nullif(item.description, ''), item.excerpt)", "employment_type": "item.employmentType",
         "seniority": "array_join(item.seniority, ', ')", "salary": "case when item.minSalary > 0 then trim(concat(item.minSalary, '–', coalesce(item.maxSalary, ''), ' ', coalesce(item.currency, ''))) else '' end", "tags": "item.categories"},
    ),
    "themuse": Feed(
        "results array<struct<id:string,name:string,company:struct<name:string>,locations:array<struct<name:string>>,levels:array<struct<name:string>>,refs:struct<landing_page:string>,publication_date:string,contents:string>>",
        "doc.results",
        {"id": "item.id", "title": "item.name", "company": "item.company.name", "location": "array_join(item.locations.name, ', ')", "remote": "if(exists(item.locations, l -> lower(l.name) rlike 'remote|flexible'), true, null)",
         "url": "item.refs.landing_page", "posted": "item.publication_date", "description": "item.contents", "seniority": "array_join(item.levels.name, ', ')"},
    ),
    "greenhouse": Feed(
        "jobs array<struct<id:string,title:string,company_name:string,location:struct<name:string>,absolute_url:string,first_published:string,updated_at:string,content:string>>",
        "doc.jobs",
        {"id": "concat(slug, '-', item.id)", "title": "item.title", "company": f"coalesce(item.company_name, {NICE})", "location": "item.location.name", "url": "item.absolute_url", "posted": "coalesce(item.first_published, item.updated_at)", "description": "item.content"},
    ),
    "lever": Feed(
        "array<struct<id:string,text:string,categories:struct<location:string,commitment:string>,hostedUrl:string,createdAt:string,descriptionPlain:string,description:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,workplaceType:string>>",
        "doc",
        {"id": "concat(slug, '-', item.id)", "title": "item.text", "company": NICE, "location": "item.categories.location", "remote": "case when lower(item.workplaceType) = 'remote' then true when lower(item.workplaceType) in ('onsite', 'on-site') then false end",
         "url": "item.hostedUrl", "posted": "item.createdAt", "employment_type": "item.categories.commitment",
         "description": "array_join(filter(concat(array(coalesce(item.descriptionPlain, item.description)), coalesce(transform(item.lists, l -> concat(coalesce(l.text, ''), '\n', coalesce(l.content, ''))), array()), array(item.additionalPlain)), x -> x <> ''), '\n')"},
    ),
    "ashby": Feed(
        "jobs array<struct<id:string,title:string,location:string,jobUrl:string,publishedAt:string,descriptionPlain:string,descriptionHtml:string,employmentType:string,isRemote:boolean,compensation:struct<compensationTierSummary:string>>>",
        "doc.jobs",
        {"id": "concat(slug, '-', item.id)", "title": "item.title", "company": NICE, "location": "item.location", "remote": "item.isRemote", "url": "item.jobUrl", "posted": "item.publishedAt",
         "description": "coalesce(nullif(item.descriptionPlain, ''), item.descriptionHtml)", "employment_type": "item.employmentType", "salary": "item.compensation.compensationTierSummary"},
    ),
    "smartrecruiters": Feed(
        "content array<struct<id:string,name:string,company:struct<name:string>,location:struct<city:string,region:string,country:string,remote:boolean>,releasedDate:string,typeOfEmployment:struct<label:string>>>",
        "doc.content",
        {"id": "concat(slug, '-', item.id)", "title": "item.name", "company": f"coalesce(item.company.name, {NICE})", "location": joined("item.location.city", "item.location.region", "item.location.country"), "remote": "item.location.remote",
         "url": "concat('https://jobs.smartrecruiters.com/', slug, '/', item.id)", "posted": "item.releasedDate", "employment_type": "item.typeOfEmployment.label"},
    ),
    "workable": Feed(
        "name string, jobs array<struct<shortcode:string,title:string,city:string,state:string,country:string,url:string,shortlink:string,published_on:string,created_at:string,description:string,employment_type:string,telecommuting:boolean>>",
        "doc.jobs",
        {"id": "concat(slug, '-', item.shortcode)", "title": "item.title", "company": f"coalesce(nullif(doc.name, ''), {NICE})", "location": joined("item.city", "item.state", "item.country"), "remote": "if(item.telecommuting, true, null)",
         "url": "coalesce(item.url, item.shortlink)", "posted": "coalesce(item.published_on, item.created_at)", "description": "item.description", "employment_type": "item.employment_type"},
    ),
    "recruitee": Feed(
        "offers array<struct<id:string,title:string,company_name:string,location:string,city:string,country:string,careers_url:string,published_at:string,created_at:string,description:string,requirements:string,employment_type_code:string,remote:boolean>>",
        "doc.offers",
        {"id": "concat(slug, '-', item.id)", "title": "item.title", "company": f"coalesce(item.company_name, {NICE})", "location": f"coalesce(nullif(item.location, ''), {joined('item.city', 'item.country')})", "remote": "item.remote", "url": "item.careers_url",
         "posted": "coalesce(item.published_at, item.created_at)", "description": "concat_ws('\n\n', nullif(item.description, ''), nullif(item.requirements, ''))", "employment_type": "replace(item.employment_type_code, '_', ' ')"},
    ),
    "personio": Feed(
        "position array<struct<id:string,name:string,subcompany:string,office:string,createdAt:string,schedule:string,employmentType:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>",
        "doc.position",
        {"id": "concat(slug, '-', item.id)", "title": "item.name", "company": f"coalesce(nullif(item.subcompany, ''), {NICE})", "location": "item.office", "url": "concat('https://', slug, '.jobs.personio.de/job/', item.id)", "posted": "item.createdAt",
         "description": "array_join(transform(item.jobDescriptions.jobDescription, d -> concat(coalesce(d.name, ''), '\n', coalesce(d.value, ''))), '\n\n')", "employment_type": "coalesce(nullif(item.schedule, ''), item.employmentType)"},
        xml=True,
    ),
    "teamtailor": Feed(
        "channel struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string,location:string>>>",
        "doc.channel.item",
        {"id": "concat(slug, '-', substr(coalesce(nullif(element_at(split(rtrim('/', item.link), '/'), -1), ''), item.guid), 1, 80))", "title": "item.title", "company": NICE, "location": "trim(item.location)", "url": "item.link", "posted": "item.pubDate", "description": "item.description"},
        xml=True,
    ),
    "workday": Feed(
        "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>",
        "doc.jobPostings",
        {"id": "concat(split(slug, '/')[0], '-', element_at(split(item.externalPath, '_'), -1))", "title": "item.title", "company": "initcap(translate(split(slug, '/')[0], '-_', '  '))", "location": "item.locationsText",
         "url": "concat('https://', split(slug, '/')[0], '.', split(slug, '/')[1], '.myworkdayjobs.com/', split(slug, '/')[2], item.externalPath)", "posted": "item.postedOn"},
    ),
    "usajobs": Feed(
        "SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<PositionID:string,PositionTitle:string,OrganizationName:string,PositionLocationDisplay:string,PositionURI:string,PublicationStartDate:string,QualificationSummary:string,PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string,Description:string>>,UserArea:struct<Details:struct<JobSummary:string,MajorDuties:array<string>,Requirements:string,Education:string>>>>>>",
        "transform(doc.SearchResult.SearchResultItems, x -> x.MatchedObjectDescriptor)",
        {"id": "item.PositionID", "title": "item.PositionTitle", "company": "item.OrganizationName", "location": "item.PositionLocationDisplay", "url": "item.PositionURI", "posted": "item.PublicationStartDate",
         "description": "array_join(filter(array(item.UserArea.Details.JobSummary, array_join(item.UserArea.Details.MajorDuties, '\n'), concat('Qualifications\n', coalesce(item.QualificationSummary, '')), item.UserArea.Details.Requirements, item.UserArea.Details.Education), x -> trim(x) <> ''), '\n\n')",
         "salary": "case when item.PositionRemuneration[0].MinimumRange <> '' then trim(concat('$', item.PositionRemuneration[0].MinimumRange, '–', coalesce(item.PositionRemuneration[0].MaximumRange, ''), ' ', coalesce(item.PositionRemuneration[0].Description, ''))) else '' end"},
    ),
    "adzuna": Feed(
        "results array<struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,created:string,description:string,contract_time:string,salary_min:double,salary_max:double>>",
        "doc.results",
        {"id": "item.id", "title": "item.title", "company": "item.company.display_name", "location": "item.location.display_name", "url": "item.redirect_url", "posted": "item.created", "description": "item.description",
         "employment_type": "replace(item.contract_time, '_', ' ')", "salary": "case when item.salary_min > 0 then concat(cast(cast(item.salary_min as bigint) as string), if(item.salary_max > 0, concat('–', cast(cast(item.salary_max as bigint) as string)), '')) else '' end"},
    ),
}


def read_feed(payloads: DataFrame, feed: str) -> DataFrame:
    """Postings from recorded responses (slug, payload) of one feed; malformed payloads give no rows (see `unreadable`)."""
    told = FEEDS[feed]
    parse = F.from_xml if told.xml else F.from_json
    docs = payloads.select("slug", parse("payload", told.schema if not told.schema.startswith("array<") else F.lit(told.schema)).alias("doc"))
    items = docs.select("slug", "doc", F.explode(F.expr(told.items)).alias("item")).where("item is not null").where(told.keep)
    got = {c: F.expr(told.columns[c]) if c in told.columns else F.lit(None).cast("string") for c in COLUMNS if c != "source"}
    got["id"] = F.concat(F.lit(f"{feed}-"), got["id"])
    got["source"] = F.lit(feed)
    got["title"] = F.trim(html_to_text(got["title"]) if feed == "adzuna" else got["title"])
    got["posted"] = parse_date(got["posted"])
    got["description"] = html_to_text(got["description"])
    got["remote"] = got["remote"].cast("boolean")
    for c in ("company", "location", "url", "seniority", "employment_type", "salary"):
        got[c] = F.trim(F.coalesce(got[c], F.lit("")))
    got["tags"] = F.coalesce(got["tags"] if "tags" in told.columns else F.array().cast("array<string>"), F.array().cast("array<string>"))
    return items.select(*(got[c].alias(c) for c in COLUMNS))


def unreadable(payloads: DataFrame, feed: str) -> DataFrame:
    """slug and payload length of responses that aren't what the feed's schema says: failures become rows, not exceptions."""
    told = FEEDS[feed]
    parse = F.from_xml if told.xml else F.from_json
    doc = parse("payload", told.schema if not told.schema.startswith("array<") else F.lit(told.schema))
    return payloads.withColumn("doc", doc).where(F.expr(told.items).isNull()).select("slug", F.length("payload").alias("length"))


def with_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """List rows left-joined to detail rows (id, description, location, url, employment_type): what a detail has replaces.

    Of several details of an id the one of the longest description counts (ties: the last in the order of its columns);
    details without an id none.
    """
    columns = ["description", "location", "url", "employment_type"]
    told = F.struct(F.coalesce(F.length("description"), F.lit(0)).alias("size"), *columns)
    once = details.where("id is not null").groupBy("id").agg(F.max(told).alias("d")).select("id", "d.*")
    found = once.select("id", *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in columns))
    joined_rows = postings.join(found, "id", "left")
    return joined_rows.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns)).select(postings.columns)
