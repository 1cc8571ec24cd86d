"""Several values packed in one field.

The delimiters in use are inferred per source. Every candidate delimiter is scored on the values of a source that
contain it: on the consistency of the piece counts (the share of those values that fall into two or more non-empty
pieces) times the regularity of the piece type (the share of pieces that are values in their own right, that is, occur
unpacked somewhere in the data or in a reference list). Evidence of all sources is the prior of a source with few
values. The delimiters that score above a threshold then split the field, and each piece keeps its position.

Nothing separates inside quotes or inside a protected phrase. All work on rows is done by built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fold_case, quote_literal, trim_all
from shelfmark.session import bounded_rows

# The candidate delimiters. White space, hyphen, ampersand and full stop are never delimiters.
CANDIDATES = (";", ",", "/", "|", "\\\\", "·", "•", "¦", "+", ">", "；", "，", "、", "／", "｜", "\t", "\n", "\r", "\x00")


@dataclass(frozen=True)
class PackedOptions:
    """Parameters of the inference.

    threshold: the least score of an active delimiter. prior_pieces: how many pieces the evidence of all sources
    weighs in each source. max_protected: the most reference names that are accepted as protected phrases.
    """

    candidates: tuple[str, ...] = CANDIDATES
    threshold: float = 0.25
    prior_pieces: float = 20.0
    max_protected: int = 10_000
    protected: tuple[str, ...] = field(default=())


def _boundary(phrase: str) -> str:
    flexible = r"[\s\p{Z}]+".join(quote_literal(part) for part in phrase.split(" "))
    return rf"(?<![\p{{L}}\p{{N}}]){flexible}(?![\p{{L}}\p{{N}}])"


def stand_in(delimiter: str, options: PackedOptions) -> str:
    """The single character by which a delimiter is known inside the patterns: a noncharacter for a longer one."""
    return delimiter if len(delimiter) == 1 else chr(0xFDD0 + options.candidates.index(delimiter))


def piece_pattern(characters: str, protected: tuple[str, ...] = ()) -> str:
    """A regular expression whose matches are the pieces between the given characters.

    Every repetition is possessive, so that Java matches it in a loop and a text of any length fits its stack.
    """
    quoted = [rf"(?<![\p{{L}}\p{{N}}]){q}(?:[^{q}]|{q}{q})*+{q}(?![\p{{L}}\p{{N}}{q}])" for q in ('"', "'")]
    phrases = [rf"(?iu:{'|'.join(_boundary(p) for p in protected)})"] if protected else []
    atoms = [*quoted, *phrases, r"[\p{L}\p{N}]++", f"[^{''.join(map(quote_literal, characters))}]"]
    return "(?:" + "|".join(atoms) + ")++"


def protected_phrases(names: DataFrame, column: str, options: PackedOptions) -> tuple[str, ...]:
    """The names of a reference list that contain a candidate delimiter, longest first.

    The list is collected, at most `max_protected` rows of it; a longer one raises ValueError.
    """
    holds = F.lit(False)
    for d in options.candidates:
        holds = holds | F.contains(F.col(column), F.lit(d))
    rows = bounded_rows(names.select(column).where(holds).distinct(), options.max_protected, "the list of protected names")
    return tuple(sorted((r[0] for r in rows), key=lambda s: (-len(s), s)))


def _unlisted(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)^[\s\p{Z}]*\[(.*)\][\s\p{Z}]*$", "$1")


def _bare(piece: Column) -> Column:
    """A piece without white space around it, enclosing quotes and doubled quotes."""
    text = trim_all(piece)
    double = F.regexp_replace(F.regexp_replace(text, r'(?s)^"(.*)"$', "$1"), '""', '"')
    single = F.regexp_replace(F.regexp_replace(text, r"(?s)^'(.*)'$", "$1"), "''", "'")
    return trim_all(F.when(text.rlike(r'(?s)^".+"$'), double).when(text.rlike(r"(?s)^'.+'$"), single).otherwise(text))


def pieces(value: Column, pattern: Column, options: PackedOptions) -> Column:
    """The non-empty bare pieces of `value` under a pattern of `piece_pattern`, in order."""
    longer = [(d, stand_in(d, options)) for d in options.candidates if len(d) > 1]
    text = _unlisted(value)
    for d, c in longer:
        text = F.replace(text, F.lit(d), F.lit(c))

    def written(piece: Column) -> Column:
        for d, c in longer:
            piece = F.replace(piece, F.lit(c), F.lit(d))
        return _bare(piece)

    return F.filter(F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), written), lambda p: p != "")


def score_delimiters(
    df: DataFrame, value: str, source: str, listed: DataFrame | None = None, options: PackedOptions = PackedOptions()
) -> DataFrame:
    """Score every candidate delimiter for every source.

    df: rows with a text column `value` and a column `source`. listed: a table with one text column of names that are
    values in their own right. Gives source, delimiter, n_values, n_pieces, consistency, regularity, score, active;
    a delimiter that no value of a source holds has no row there. Null and empty values are no evidence; a null source
    is a source of its own. Equal values of a source are counted before anything is split or shuffled further.
    """
    held = F.lit(False)
    for d in options.candidates:
        held = held | F.contains(F.col("value"), F.lit(d))
    values = df.select(F.col(source).alias("source"), F.col(value).alias("value")).where("value is not null")
    counted = values.groupBy("source", "value").agg(F.count("*").alias("n"))
    whole = counted.where(~held).select(fold_case(_bare(F.col("value"))).alias("piece"))
    if listed is not None:
        whole = whole.unionByName(listed.select(fold_case(trim_all(F.col(listed.columns[0]))).alias("piece")))
    whole = whole.where("piece <> ''").distinct().withColumn("known", F.lit(True))
    split = F.array_compact(
        F.array(
            *(
                F.when(
                    F.contains(F.col("value"), F.lit(d)),
                    F.struct(F.lit(d).alias("delimiter"), pieces(F.col("value"), F.lit(piece_pattern(stand_in(d, options), options.protected)), options).alias("pieces")),
                )
                for d in options.candidates
            )
        )
    )
    tried = counted.where(held).select("source", "n", F.explode(split).alias("s")).select("source", "n", "s.*")
    # a delimiter that only stands inside quotes or a protected phrase is no evidence
    tried = tried.where((F.size("pieces") != 1) | ~F.contains(F.element_at("pieces", 1), F.col("delimiter")))
    tried = tried.withColumn("parts", F.when(F.size("pieces") > 1, F.col("pieces")))
    # one row per distinct piece, and one null piece per group that carries the numbers of values
    per_piece = (
        tried.select(
            "source",
            "delimiter",
            "n",
            F.col("parts").isNotNull().cast("long").alias("splits"),
            F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.transform("parts", fold_case), F.array().cast("array<string>")))).alias("piece"),
        )
        .groupBy("source", "delimiter", "piece")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("splits")).alias("n_split"))
    )
    found = per_piece.join(whole, "piece", "left")
    is_piece = F.col("piece").isNotNull()
    per_source = found.groupBy("source", "delimiter").agg(
        F.sum(F.when(~is_piece, F.col("n")).otherwise(0)).alias("n_values"),
        F.sum(F.when(~is_piece, F.col("n_split")).otherwise(0)).alias("n_split"),
        F.sum(F.when(is_piece, F.col("n")).otherwise(0)).alias("n_pieces"),
        F.sum(F.when(is_piece & F.col("known"), F.col("n")).otherwise(0)).alias("n_known"),
    )
    overall = per_source.groupBy("delimiter").agg(
        (F.sum("n_split") / F.greatest(F.sum("n_values"), F.lit(1))).alias("prior_consistency"),
        (F.sum("n_known") / F.greatest(F.sum("n_pieces"), F.lit(1))).alias("prior_regularity"),
    )
    k = F.lit(options.prior_pieces)
    scored = per_source.join(overall, "delimiter").select(
        "source",
        "delimiter",
        "n_values",
        "n_pieces",
        ((F.col("n_split") + k * F.col("prior_consistency")) / (F.col("n_values") + k)).alias("consistency"),
        ((F.col("n_known") + k * F.col("prior_regularity")) / (F.col("n_pieces") + k)).alias("regularity"),
    )
    score = F.col("consistency") * F.col("regularity")
    return scored.withColumn("score", score).withColumn("active", F.col("score") >= options.threshold)


def patterns_by_source(scores: DataFrame, options: PackedOptions = PackedOptions()) -> DataFrame:
    """One row per source with an active delimiter: source, pattern. The pattern is assembled by expressions."""
    before, after = piece_pattern("\x01", options.protected).split(quote_literal("\x01"))
    known = F.coalesce(*(F.when(F.col("delimiter") == d, F.lit(quote_literal(stand_in(d, options)))) for d in options.candidates))
    inside = F.concat_ws("", F.array_sort(F.collect_set(known)))
    return scores.where("active").groupBy("source").agg(F.concat(F.lit(before), inside, F.lit(after)).alias("pattern"))


def split_packed(
    df: DataFrame, value: str, source: str, listed: DataFrame | None = None, options: PackedOptions = PackedOptions(), out: str = "pieces", scores: DataFrame | None = None
) -> DataFrame:
    """Add an array column `out` with the values that each field holds, in order.

    A null field gives null; an empty one, or one of nothing but delimiters, the empty array; a field of a source
    without an active delimiter one bare value. Rows are neither dropped nor repeated; repeated values stay. Other
    columns keep their names, clashing ones too, as long as `out` is not one of them (ValueError). The patterns are
    joined to the rows by source; being one row per source they are broadcast if, and only if, Spark finds them small.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column {out!r}")
    scores = score_delimiters(df, value, source, listed, options) if scores is None else scores
    by_source = patterns_by_source(scores, options).select(F.col("source").alias("_packed_source"), F.col("pattern").alias("_packed_pattern"))
    joined = df.join(by_source, df[source].eqNullSafe(F.col("_packed_source")), "left")
    whole = F.filter(F.array(_bare(F.col(value))), lambda p: p != "")
    split = F.when(F.col("_packed_pattern").isNotNull(), pieces(F.col(value), F.col("_packed_pattern"), options)).otherwise(whole)
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), split)).drop("_packed_source", "_packed_pattern")


def explode_packed(df: DataFrame, value: str, source: str, keep: list[str], listed: DataFrame | None = None, options: PackedOptions = PackedOptions()) -> DataFrame:
    """One row per value of a field that holds two or more: the columns `keep`, pos (bigint, from 1), piece."""
    held = F.lit(False)
    for d in options.candidates:
        held = held | F.contains(F.col(value), F.lit(d))
    scores = score_delimiters(df, value, source, listed, options)
    rows = df.select(*dict.fromkeys([*keep, value, source])).where(held)
    several = split_packed(rows, value, source, listed, options, "_pieces", scores).where(F.size("_pieces") > 1)
    return several.select(*keep, F.posexplode("_pieces").alias("_pos", "piece")).select(*keep, (F.col("_pos") + 1).cast("bigint").alias("pos"), "piece")
