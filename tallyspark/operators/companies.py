"""Which company a name or a text means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.report_names import WRITTEN_CODE, head_of
from tallyspark.functions.scalars import normalised_text, stock_code

#: First characters of a name that are looked for in texts, and how many of a name are cut out there at once.
SEED, STEM = 3, 64
#: So many characters and one from every place of a text (half a character is none), fewer at its end.
PLACES = r"(?s)(?=([^\x{DC00}-\x{DFFF}].{0,%d}))"


def names_of(companies: DataFrame, *columns: str) -> DataFrame:
    """``key, stock_code``: each normalised name once, of equal ones the smallest code."""
    listed = companies.select("stock_code", F.explode(F.array(*columns)).alias("name")).where("name is not null")
    return listed.groupBy(normalised_text(F.col("name")).alias("key")).agg(F.min("stock_code").alias("stock_code")).where("key <> ''")


def resolved(asked: DataFrame, companies: DataFrame, name_col: str = "name", columns: tuple[str, ...] = ("stock_abbr",)) -> DataFrame:
    """Adds ``stock_code``: the padded code if a company has it, else that of an equal name; null if neither.

    Both are equal joins; a null or empty name resolves to nothing.
    """
    by_code = companies.select(F.col("stock_code").alias("_code")).distinct()
    by_name = names_of(companies, *columns).withColumnsRenamed({"key": "_key", "stock_code": "_named"})
    met = asked.join(by_code, stock_code(F.col(name_col)) == F.col("_code"), "left").join(by_name, normalised_text(F.col(name_col)) == F.col("_key"), "left")
    return met.select(*[F.col(f"`{c}`") for c in asked.columns if c != "stock_code"], F.coalesce("_code", "_named").alias("stock_code"))


def mentioned(texts: DataFrame, companies: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("stock_abbr",)) -> DataFrame:
    """``id, stock_code``: the code that a text writes out, else that of the longest company name in it; null without any.

    Only texts without a written code meet the names. A name's first SEED characters (a shorter one's
    all) find the places of a text where it can begin and the lengths that it can have there; what
    stands there in such a length meets the whole names by an equal join, so rows follow the texts and
    not how many names begin alike. Of names longer than STEM characters that many are met first, and
    then their whole length. Ids must be unique; equally long names give the smallest code.
    """
    told = texts.select(id_col, F.col(text_col).alias("_text"), F.nullif(F.regexp_extract(head_of(F.col(text_col)), WRITTEN_CODE, 1), F.lit("")).alias("_written"))
    names = names_of(companies, *columns).withColumn("_length", F.char_length("key")).withColumn("_seed", F.substring("key", 1, SEED))
    open_texts = told.where("_written is null").select(id_col, normalised_text(F.col("_text")).alias("_n"))
    sizes, longest = names.agg(F.sort_array(F.collect_set(F.char_length("_seed"))), F.max("_length")).first()  # SEED numbers at most
    if not sizes:
        return told.select(id_col, F.col("_written").alias("stock_code"))
    # at most as many seeds as there are threes of characters
    seeds = names.groupBy("_seed").agg(F.collect_set(F.least("_length", F.lit(STEM))).alias("_lengths"))
    pieces = F.array_distinct(F.regexp_extract_all("_n", F.lit(PLACES % (min(longest, STEM) - 1)), F.lit(1)))
    begun = open_texts.select(id_col, F.explode(pieces).alias("_piece"))
    begun = begun.select(id_col, "_piece", F.explode(F.array_distinct(F.array(*[F.substring("_piece", 1, n) for n in sizes]))).alias("_seed")).join(F.broadcast(seeds), "_seed")
    fitting = F.filter("_lengths", lambda n: n <= F.char_length("_piece"))
    found = begun.select(id_col, F.explode(F.transform(fitting, lambda n: F.substring("_piece", F.lit(1), n))).alias("key"))
    if longest > STEM:
        stems = names.where(F.col("_length") > STEM).groupBy(F.substring("key", 1, STEM).alias("key")).agg(F.collect_set("_length").alias("_lengths"))
        wholes = F.flatten(F.transform("_lengths", lambda n: F.regexp_extract_all("_n", F.concat(F.lit(r"(?s)(?=(\Q"), "key", F.lit(r"\E.{"), n - STEM, F.lit("}))")), F.lit(1))))
        found = found.union(found.distinct().join(stems, "key").join(open_texts, id_col).select(id_col, F.explode(F.array_distinct(wholes))))
    best = found.join(names, "key").groupBy(id_col).agg(F.min_by("stock_code", F.struct(-F.col("_length"), "stock_code")).alias("_found"))
    return told.join(best, id_col, "left").select(id_col, F.coalesce("_written", "_found").alias("stock_code"))


def newest(companies: DataFrame, order: str) -> DataFrame:
    """A row for each code, the last by ``order``; blank codes are left out."""
    last = Window.partitionBy("stock_code").orderBy(F.col(order).desc())
    kept = companies.withColumn("stock_code", stock_code(F.col("stock_code"))).where("stock_code <> ''")
    return kept.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
