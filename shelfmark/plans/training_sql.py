"""The SQL of the units and packed-field queries, written for DuckDB: the reference that they are compared with."""

from __future__ import annotations

from shelfmark.operators.packed import CANDIDATES
from shelfmark.operators.units import COVERED, CUSTOMARY, FULL_WIDTH, NUMBER_WORDS, OF, PERCENT, POINTS, STARS

Q = "'"
STAND_IN = chr(0xFDD0)


def text(value: str) -> str:
    """A text as an SQL literal."""
    return Q + value.replace(Q, Q * 2) + Q


def trimmed(expression: str) -> str:
    pattern = text(r"^[\s\p{Z}]+|[\s\p{Z}]+$")
    return f"regexp_replace({expression}, {pattern}, '', 'g')"


def packed() -> str:
    """Values of packed genres, with every candidate delimiter active: in these tables each has its evidence."""
    single = "".join(c for c in CANDIDATES if len(c) == 1) + STAND_IN
    plain = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in single) + "]"
    bare = trimmed("x")
    double = f"replace(regexp_replace({bare}, {text('(?s)^\"(.*)\"$')}, {text(chr(92) + '1')}), {text('\"\"')}, {text('\"')})"
    apostrophes = f"replace(regexp_replace({bare}, {text("(?s)^'(.*)'$")}, {text(chr(92) + '1')}), {text(Q * 2)}, {text(Q)})"
    unquoted = f"CASE WHEN regexp_matches({bare}, {text('(?s)^\".+\"$')}) THEN {double} WHEN regexp_matches({bare}, {text("(?s)^'.+'$")}) THEN {apostrophes} ELSE {bare} END"
    listed = text(r"(?s)^\s*\[(.*)\]\s*$")
    before = text("(?:\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|(?i:")
    after = text(r")|[\p{L}\p{N}]+|" + plain + ")+")
    backslashes = text("\\\\")
    final = trimmed(f"replace(v, {text(STAND_IN)}, {backslashes})")
    return f"""
WITH p AS (
  SELECT string_agg(replace(regexp_replace(canonical, {text(r"([.*+?(){}|^$])")}, {text(r"\\" + chr(92) + "1")}, 'g'), ' ', {text(r"\s+")}), '|' ORDER BY length(canonical) DESC) AS names
  FROM genre_list WHERE regexp_matches(canonical, '[;,/|·•¦+>；，、／｜]')
), g AS (
  SELECT DISTINCT track_id, replace(CASE WHEN regexp_matches(genre, {listed}) THEN regexp_extract(genre, {listed}, 1) ELSE genre END, {backslashes}, {text(STAND_IN)}) AS genre FROM tracks WHERE genre IS NOT NULL
), r AS (SELECT track_id, [{unquoted} FOR x IN regexp_extract_all(genre, {before} || names || {after})] AS v FROM g, p
), f AS (SELECT track_id, [x FOR x IN [{final} FOR v IN v] IF x <> ''] AS v FROM r)
SELECT track_id, CAST(i AS BIGINT) AS pos, v[i] AS genre_value FROM (SELECT track_id, v, unnest(range(1, len(v) + 1)) AS i FROM f WHERE len(v) > 1)"""


def units() -> str:
    """Ratings as hundredths of stars, the scales that nobody documented found by the same rule."""
    number, words = "([0-9]+(?:[.,][0-9]+)?)", "|".join(NUMBER_WORDS)
    patterns = {
        "hex": r"^0x[0-9a-f]{1,8}$",
        "share": rf"^{number}\s*{OF}\s*{number}$",
        "word_share": rf"^({words})\s+out\s+of\s+({words})$",
        "word_stars": rf"^({words})\s+stars?$",
        "glyphs": r"^([★⭐*]{0,9})(½?)(☆{0,9})$",
        "stars": rf"^([0-9]+(?:[.,][0-9]+)?)(½|\s1/2)?\s*{STARS}$",
        "percent": rf"^\(?\s*{number}\s*{PERCENT}\s*\)?$",
        "points": rf"^{number}\s*{POINTS}\.?$",
        "bare": rf"^{number}$",
    }
    has = {name: f"regexp_matches(t, {text(p)})" for name, p in patterns.items()}
    part = lambda name, group: f"regexp_extract(t, {text(patterns[name])}, {group})"
    as_number = lambda name, group=1: f"CAST(replace({part(name, group)}, ',', '.') AS DOUBLE)"
    as_word = lambda name, group=1: f"CAST(CASE {part(name, group)} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in NUMBER_WORDS.items()) + " END AS DOUBLE)"
    half = lambda name: f"(CASE WHEN {part(name, 2)} <> '' THEN 0.5 ELSE 0 END)"
    clean = trimmed(f"regexp_replace(lower({trimmed(f'translate(rating, {text(FULL_WIDTH[0])}, {text(FULL_WIDTH[1])})')}), {text(r'^rating\s*[:=]')}, '')")
    unit = f"""CASE WHEN {has['hex']} THEN 'own' WHEN {has['share']} OR {has['word_share']} THEN 'share' WHEN {has['word_stars']} THEN 'stars' WHEN t <> '' AND {has['glyphs']} THEN 'stars'
    WHEN {has['stars']} THEN 'stars' WHEN {has['percent']} OR {has['points']} THEN 'percent' WHEN {has['bare']} THEN 'own' END"""
    amount = f"""CASE WHEN {has['hex']} THEN CAST(CAST(t AS BIGINT) AS DOUBLE) WHEN {has['share']} THEN {as_number('share')} / nullif({as_number('share', 2)}, 0) WHEN {has['word_share']} THEN {as_word('word_share')} / nullif({as_word('word_share', 2)}, 0)
    WHEN {has['word_stars']} THEN {as_word('word_stars')} WHEN t <> '' AND {has['glyphs']} THEN CASE WHEN length(t) <= 5 THEN length({part('glyphs', 1)}) + {half('glyphs')} END
    WHEN {has['stars']} THEN {as_number('stars')} + {half('stars')} WHEN {has['percent']} THEN {as_number('percent')} WHEN {has['points']} THEN {as_number('points')} WHEN {has['bare']} THEN {as_number('bare')} END"""
    fits = " ".join(f"WHEN count(*) FILTER (WHERE amount <= {s}) >= {COVERED} * count(*) THEN {s}" for s in CUSTOMARY)
    return f"""
WITH c AS (SELECT reading_id, tagger, {clean} AS t FROM rating_tags WHERE rating IS NOT NULL
), u AS (SELECT reading_id, tagger, {unit} AS unit, {amount} AS amount FROM c
), s AS (SELECT tagger, CASE {fits} END AS hi FROM u WHERE unit = 'own' AND amount IS NOT NULL AND tagger IS NOT NULL GROUP BY tagger
), k AS (
  SELECT u.reading_id, CASE u.unit WHEN 'share' THEN CASE WHEN amount BETWEEN 0 AND 1 THEN amount * 5 END WHEN 'percent' THEN CASE WHEN amount BETWEEN 0 AND 100 THEN amount / 20 END WHEN 'stars' THEN CASE WHEN amount BETWEEN 0 AND 5 THEN amount END
    WHEN 'own' THEN CASE WHEN t.steps IS NOT NULL THEN nullif(list_position(t.steps, amount), 0)
      WHEN t.lo IS NOT NULL AND t.hi IS NOT NULL THEN CASE WHEN amount BETWEEN least(t.lo, t.hi) AND greatest(t.lo, t.hi) THEN (amount - t.lo) / (t.hi - t.lo) * 5 END
      WHEN amount BETWEEN 0 AND s.hi THEN amount / s.hi * 5 END END AS stars
  FROM u LEFT JOIN taggers t USING (tagger) LEFT JOIN s USING (tagger))
SELECT reading_id, CAST(round(round(stars * 100, 8)) AS BIGINT) AS centistars FROM k WHERE stars IS NOT NULL"""
