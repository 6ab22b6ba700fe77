"""Classes of mails by sender domain, the embedding backlog, and the triage of screenshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.runtime import small
from lodestone.schema import SKIP_CLASSES

# Labels that speak of a photographed scene rather than of text.
SCENE = [
    "People", "Person", "Face", "Selfie", "Beach", "Sky", "Sunset", "Sunrise", "Outdoor", "Water", "Sea", "Ocean", "Plant", "Tree", "Flower", "Food", "Meal",
    "Animal", "Dog", "Cat", "Bird", "Mountain", "Landscape", "Snow", "Nature", "Sports", "Vehicle", "Car", "Room", "Interior Room", "Living Room", "Furniture", "Art",
]


def mail_domains(chunks: DataFrame) -> DataFrame:
    """(mid, sender_domain) of every mail's first chunk, each mail once."""
    heads = chunks.where("source_kind = 'email' and chunk_idx = 0").select(F.col("source_id").alias("mid"), X.sender_domain(F.col("text")).alias("sender_domain"))
    return heads.groupBy("mid").agg(F.min("sender_domain").alias("sender_domain"))


def classify_domains(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """domains with mail_class: that of the last rule (line_no, mail_class, sender_domain) whose domain equals or ends the sender's.

    Each domain is exploded into its suffixes, so the theta join on endings is an equi-join. Null where no rule fits.
    """
    last = rules.where(F.col("sender_domain").isNotNull()).groupBy(F.lower("sender_domain").alias("suffix")).agg(F.max(F.struct("line_no", F.lower("mail_class").alias("mail_class"))).alias("rule"))
    parts = F.split("sender_domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    names = domains.where(F.col("sender_domain").isNotNull()).select("sender_domain").distinct()
    fitted = names.select("sender_domain", F.explode(suffixes).alias("suffix")).join(small(last), "suffix").groupBy("sender_domain").agg(F.max("rule")["mail_class"].alias("mail_class"))
    return domains.join(fitted, "sender_domain", "left")


def embed_backlog(chunks: DataFrame, mail_class: DataFrame, skip: tuple[str, ...] = SKIP_CLASSES) -> DataFrame:
    """The chunks without a vector whose mail is not of a skipped class; each id once."""
    skipped = mail_class.where(F.lower("mail_class").isin(*skip)).select(F.col("mid").alias("_mid")).distinct()
    pending = chunks.where(F.col("embedding").isNull()).dropDuplicates(["id"])
    return pending.join(skipped, F.split_part(pending["id"], F.lit("#"), F.lit(1)) == F.col("_mid"), "left_anti")


def triage(chunks: DataFrame, least_text: int = 200) -> DataFrame:
    """(source_id, ocr_len, bucket) of screenshots: text, mixed (text on a scene) or unassigned, by their text beside the label line."""
    rows = chunks.where("source_kind = 'screenshot'").select("source_id", "chunk_idx", "text").distinct()
    full = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda r: r["text"]), " ").alias("full"))
    labels = F.split(F.regexp_extract("full", r"\[([^\]]*)\]", 1), r",\s*")
    ocr = F.length(X.strip(F.regexp_replace("full", r"^[^\[\n]*\[[^\]]*\]", "")))
    scene = F.arrays_overlap(labels, F.array(*[F.lit(s) for s in SCENE]))
    return full.select("source_id", ocr.alias("ocr_len"), F.when((ocr >= least_text) & ~scene, "text").when(ocr >= least_text, "mixed").otherwise("unassigned").alias("bucket"))
