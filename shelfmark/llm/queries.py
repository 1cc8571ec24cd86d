"""The queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe import encode_column
from shelfmark.llm.genres import match_values
from shelfmark.llm.leak import find_leaks
from shelfmark.llm.ledger import ledger_of
from shelfmark.llm.lookalike import is_doubtful, plain_cells
from shelfmark.llm.mojibake import NON_ASCII, restore_cells
from shelfmark.llm.names import link_names, variant_pairs
from shelfmark.llm.residue import flag_residue
from shelfmark.operators.packed import PackedOptions, protected_phrases, split_packed
from shelfmark.session import checkpoint, table

RECORD = ["norm_artist", "norm_album", "loose_album"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ledger, keyed = ledger_of(table(spark, d, "album_dirs"), RECORD, "dir_id", F.year("loaded_at"))
    return ledger.copies_of(keyed)


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger itself: each record by its earliest representative, with its number of copies."""
    ledger, _ = ledger_of(table(spark, d, "album_dirs"), RECORD, "dir_id", F.year("loaded_at"))
    return ledger.entries().select("first_id", "n_copies")


def _single_genres(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tracks whose genre is one value and not exactly a listed name, as (track_id, value), and the list."""
    tracks, listed = table(spark, d, "tracks"), table(spark, d, "genre_list")
    options = PackedOptions()
    options = PackedOptions(protected=protected_phrases(listed, "canonical", options))
    names = listed.select("canonical")
    rows = tracks.select("track_id", "root", "genre").where("genre is not null")
    free = rows.join(names, rows["genre"] == names["canonical"], "left_anti")
    from shelfmark.operators.packed import score_delimiters

    scores = score_delimiters(tracks, "genre", "root", names, options)
    pieces = split_packed(free, "genre", "root", names, options, "pieces", scores)
    return pieces.where(F.size("pieces") == 1).select("track_id", F.element_at("pieces", 1).alias("value")), listed


def _genre_match(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    single, listed = _single_genres(spark, d)
    single = checkpoint(single)
    names = listed.select("genre_id", F.concat(F.array("canonical"), F.coalesce("allowed_norm", F.array().cast("array<string>"))).alias("names"))
    return single, match_values(single, "value", names, "genre_id", "names")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    single, matched = _genre_match(spark, d)
    found = single.join(matched, "value").select("track_id", F.coalesce(F.col("entry"), F.lit(0)).cast("bigint").alias("genre_id"))
    return found.distinct()


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no listed genre, with the number of rows that hold each."""
    single, matched = _genre_match(spark, d)
    return single.join(matched.where("entry is null"), "value").groupBy("value").agg(F.count("*").alias("n_rows"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "album_dirs").select(F.col("artist").alias("name")).union(table(spark, d, "genre_map").select("display"))
    return variant_pairs(link_names(names))


TAGS = ("artist", "album", "title")


def _cells(tracks: DataFrame) -> DataFrame:
    """(track_id, root, tag_name, cell) of every tag that holds text."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tag_name"), F.col(t).alias("cell")) for t in TAGS))).alias("c")
    return tracks.select("track_id", "root", each).select("track_id", "root", "c.tag_name", "c.cell").where("cell is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(table(spark, d, "tracks"))
    doubtful = cells.where(is_doubtful(F.col("cell"))).select("track_id", "tag_name", "cell")
    plain = plain_cells(cells, "cell")
    return doubtful.join(plain, "cell").select("track_id", "tag_name", "plain_text").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(table(spark, d, "tracks"))
    restored = restore_cells(cells, "root", "cell").select("source", "cell", "restored")
    doubtful = cells.where(F.col("cell").rlike(NON_ASCII))
    return doubtful.join(restored, (doubtful["root"].eqNullSafe(restored["source"])) & (doubtful["cell"] == restored["cell"])).select("track_id", "tag_name", "restored").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = flag_residue(table(spark, d, "documents").select("doc_id", "text"), "text")
    return flagged.where("is_residue").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ledger": p1_ledger,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

_KEYED = r"""
keyed AS (
  SELECT dir_id, list_sort([lower(upper(regexp_replace(coalesce(k, ''), '[^\p{L}\p{N}\p{M}]+', '', 'g'))) FOR k IN [norm_artist, norm_album, loose_album]]) AS key
  FROM album_dirs
), entries AS (SELECT key, min(dir_id) AS first_id, count(*) AS n_copies FROM keyed GROUP BY key)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_KEYED} SELECT DISTINCT e.first_id, k.dir_id AS copy_id FROM keyed k JOIN entries e USING (key) WHERE k.dir_id <> e.first_id",
    "p1_ledger": f"WITH {_KEYED} SELECT first_id, n_copies FROM entries",
    "p9_found": r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items WHERE text IS NOT NULL
), runs AS (
  SELECT side, id, unnest([list_aggregate(w[k:k+11], 'string_agg', ' ') FOR k IN range(1, len(w) - 10)]) AS run FROM words WHERE len(w) >= 12
)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run AND d.side = 'd' AND i.side = 'i'
""",
}
