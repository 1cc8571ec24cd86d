"""Mapping free-entered values to a canonical list.

Distinct values are normalised and cut into character grams: pairs and triples of letters within a word and its edges,
ordered and unordered ones and pairs that skip a letter, so that swapped letters and swapped words still share most of
them. An inverted index from gram to listed name gives the candidates by an equi-join; they are scored by the cosine of
weighted grams, weights growing with rarity in the list. The best entry is accepted above a threshold and by a margin
over the next one, and else the value is reported as unmatched.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.session import checkpoint


@dataclass(frozen=True)
class MatchOptions:
    """threshold: the least cosine; margin: by how much the best entry must beat the next; unknown: the weight of grams
    that no listed name has, as a share of the greatest weight."""

    threshold: float = 0.45
    margin: float = 0.03
    unknown: float = 0.5


def _bare_letters() -> tuple[str, str]:
    """Letters with accents, and full-width signs, next to what they are without."""
    wide = {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
    accented = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii():
            accented[chr(c)] = base[0].lower()
    table = wide | accented
    return "".join(table), "".join(table.values())


def normalised(value: Column) -> Column:
    """The words of a value: lower case, no accents, a nought among letters read as the letter, an ampersand as "and"."""
    text = F.translate(F.lower(value), *_bare_letters())
    text = F.regexp_replace(text, r"\p{M}", "")
    text = F.regexp_replace(text, r"(?<=\p{L})0|(?<![0-9])0(?=\p{L})", "o")
    text = F.regexp_replace(text, "&", " and ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def without_vowels(text: Column) -> Column:
    """Normalised words without the vowels inside them."""
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}])[aeiou](?=[\p{L}\p{N}])", "")


def grams(text: Column) -> Column:
    """The grams of normalised words, with repetitions. Linear in the length of the text."""

    def of_word(word: Column) -> Column:
        c = F.split(F.concat(F.lit("_"), word, F.lit("_")), "")
        second, third = F.slice(c, 2, 1 << 30), F.slice(c, 3, 1 << 30)
        pairs = F.filter(F.zip_with(c, second, lambda a, b: F.concat(F.lit("u"), F.least(a, b), F.greatest(a, b))), lambda g: F.length(g) == 3)
        pairs = F.slice(pairs, 1, F.size(c) - 1)
        triples = F.slice(F.zip_with(F.zip_with(c, second, lambda a, b: F.concat(a, b)), third, lambda ab, d: F.concat(ab, d)), 1, F.greatest(F.size(c) - 2, F.lit(0)))
        skips = F.transform(triples, lambda t: F.concat(F.lit("s"), F.substring(t, 1, 1), F.substring(t, 3, 1)))
        bags = F.transform(triples, lambda t: F.concat(F.lit("b"), F.array_join(F.array_sort(F.split(t, "")), "")))
        return F.concat(pairs, F.transform(triples, lambda t: F.concat(F.lit("t"), t)), skips, bags)

    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), of_word))


def index_names(listed: DataFrame, entry: str, names: str) -> DataFrame:
    """The inverted index of a list: name_id, entry, name, gram, weight, with the weights of each name of length one.

    listed: entry and an array of names. Each name is also indexed without its vowels.
    """
    plain = listed.select(F.col(entry).alias("entry"), F.explode(names).alias("written")).select("entry", normalised(F.col("written")).alias("name"))
    both = plain.union(plain.select("entry", without_vowels(F.col("name")))).where("name <> ''").distinct()
    keyed = both.select(F.xxhash64("entry", "name").alias("name_id"), "entry", "name")
    counted = keyed.select("name_id", "entry", "name", F.explode(grams(F.col("name"))).alias("gram")).groupBy("name_id", "entry", "name", "gram").agg(F.count("*").alias("n"))
    rarity = counted.groupBy("gram").agg(F.log(1 + F.lit(keyed.count()) / F.count("*")).alias("idf"))
    weighed = counted.join(rarity, "gram").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("name_id")))
    return weighed.select("name_id", "entry", "name", "gram", "idf", (F.col("w") / length).alias("weight"))


def match_values(values: DataFrame, value: str, listed: DataFrame, entry: str, names: str, options: MatchOptions = MatchOptions()) -> DataFrame:
    """One row per distinct value: value, entry (null if unmatched), score.

    A value that equals a listed name after normalising has score 1 and is matched whatever the margin; of entries that
    share a name the smallest is taken. Null values are dropped; values without letters or digits are unmatched. An
    empty list leaves all unmatched. Values are joined with the list on grams alone.
    """
    distinct = values.select(F.col(value).alias("value")).where("value is not null").distinct().select("value", normalised(F.col("value")).alias("norm"))
    index = checkpoint(index_names(listed, entry, names))
    idf = index.select("gram", "idf").distinct()
    top = index.agg(F.max("idf")).first()[0] or 1.0
    norms = distinct.select("norm").where("norm <> ''").distinct()
    counted = norms.select("norm", F.explode(grams(F.col("norm"))).alias("gram")).groupBy("norm", "gram").agg(F.count("*").alias("n"))
    weighed = counted.join(idf, "gram", "left").select("norm", "gram", ((1 + F.log("n")) * F.coalesce("idf", F.lit(top * options.unknown))).alias("w"))
    length = weighed.groupBy("norm").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    met = weighed.join(index.select("gram", "name_id", "entry", "weight"), "gram").groupBy("norm", "entry", "name_id").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = met.groupBy("norm", "entry").agg(F.max("dot").alias("dot")).join(length, "norm").select("norm", "entry", (F.col("dot") / F.col("length")).alias("score"))
    same = index.select(F.col("name").alias("norm"), "entry").distinct().groupBy("norm").agg(F.min("entry").alias("same"))
    # below the threshold by more than the margin no entry is accepted, nor does it stand in the way of another
    scored = scored.where(F.col("score") >= options.threshold - options.margin)
    best = scored.groupBy("norm").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("entry")).alias("minus"))), asc=False), 1, 2).alias("b"))
    first, second = F.col("b")[0], F.try_element_at("b", F.lit(2))
    clear = (first["score"] >= options.threshold) & (first["score"] - F.coalesce(second["score"], F.lit(0.0)) >= options.margin)
    decided = best.join(same, "norm", "full_outer").select("norm", F.coalesce("same", F.when(clear, -first["minus"])).alias("entry"), F.when(F.col("same").isNotNull(), 1.0).otherwise(first["score"]).alias("score"))
    return distinct.join(decided, "norm", "left").select("value", "entry", "score")
