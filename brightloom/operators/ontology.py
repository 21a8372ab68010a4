"""Public skill ontologies as tables: concepts with labels, technology lists, and what of them a taxonomy can take over.

Only labels that hang on a known skill are taken: a concept is that skill one of whose names is among its labels, the
first such label decides, and its other labels become aliases. All of it is joins by equality, so ontologies may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: what a usable alias is, and relations that count -----------------------------------------------------
ALIAS = r"^[a-z0-9][a-z0-9 +#./&-]{1,40}$"
LONGEST = 5  #: words
RELATIONS = ("optional", "related", "")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """uri, preferred, alternatives of a skills CSV, whose quoted cells hold line breaks."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col("conceptUri").alias("uri"), F.col("preferredLabel").alias("preferred"), F.col("altLabels").alias("alternatives"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """a, b, kind of a CSV of relations between concepts."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col("originalSkillUri").alias("a"), F.col("relatedSkillUri").alias("b"), F.col("relationType").alias("kind"))


def read_technologies(spark: SparkSession, path: str) -> DataFrame:
    """example of a tab-separated list of technology skills."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path).select(F.col("Example").alias("example"))


def names_of(aliases: DataFrame) -> DataFrame:
    """name, skill: every skill's own name and aliases in lower case; of a name of several skills the skill itself, then the first."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    own = aliases.select(low("skill").alias("name"), "skill", F.lit(0).alias("rank")).union(aliases.select(low("alias"), "skill", F.lit(1)))
    return own.where("name <> ''").groupBy("name").agg(F.min(F.struct("rank", "skill")).alias("best")).select("name", "best.skill")


def usable(label: Column) -> Column:
    return label.rlike(ALIAS) & (F.size(F.split(F.trim(label), r"\s+")) <= LONGEST)


def labels_of(concepts: DataFrame) -> DataFrame:
    """uri, place, label: the preferred label first, then the others, which stand in lines or between bars."""
    parts = F.concat(F.array(F.coalesce("preferred", F.lit(""))), F.split(F.coalesce("alternatives", F.lit("")), r"\n|\|"))
    plain = F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return concepts.select("uri", F.posexplode(plain).alias("place", "label"))


def linked(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """uri, skill of concepts (uri, preferred, alternatives) one of whose labels names a known skill (skill, alias)."""
    met = labels_of(concepts).join(names_of(aliases), F.col("label") == F.col("name"))
    return met.groupBy("uri").agg(F.min_by("skill", "place").alias("skill"))


def new_aliases(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """skill, alias: labels of linked concepts that are usable and name nothing yet. Null labels and concepts of no skill give none."""
    labels = labels_of(concepts).join(linked(concepts, aliases), "uri").where(usable(F.col("label")))
    return labels.join(names_of(aliases).select(F.col("name").alias("label")), "label", "left_anti").select("skill", F.col("label").alias("alias")).distinct()


def new_relations(relations: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """a < b: pairs of different skills whose concepts are related."""
    of = linked(concepts, aliases)
    side = lambda c: of.select(F.col("uri").alias(c), F.col("skill").alias(f"skill_{c}"))
    kept = relations.where(F.lower(F.coalesce("kind", F.lit(""))).isin(*RELATIONS))
    met = kept.join(side("a"), "a").join(side("b"), "b").where("skill_a <> skill_b")
    return met.select(F.least("skill_a", "skill_b").alias("a"), F.greatest("skill_a", "skill_b").alias("b")).distinct()


def new_technologies(technologies: DataFrame, aliases: DataFrame) -> DataFrame:
    """skill, alias: usable examples whose whole name is new and one of whose words, the first, names a known skill."""
    names = names_of(aliases)
    example = F.lower(F.trim("example")).alias("alias")
    fresh = technologies.select(example).where(F.col("alias").rlike(ALIAS)).distinct().join(names.select(F.col("name").alias("alias")), "alias", "left_anti")
    words = fresh.select("alias", F.posexplode(F.split("alias", "[ /]")).alias("place", "name")).join(names, "name")
    return words.groupBy("alias").agg(F.min_by("skill", "place").alias("skill")).select("skill", "alias")


def extended(aliases: DataFrame, *more: DataFrame) -> DataFrame:
    """A taxonomy table (skill, category, alias, context) and aliases (skill, alias) put to it, with the category of their skill."""
    category = aliases.groupBy("skill").agg(F.min("category").alias("category"))
    out = aliases.select("skill", "category", "alias", "context")
    for some in more:
        put = some.join(category, "skill", "left").select("skill", "category", "alias", F.lit(None).cast("array<string>").alias("context"))
        out = out.unionByName(put)
    return out.distinct()
