"""Garbled text from wrong character encoding.

A text whose bytes were read by the wrong code page is the original under a substitution cipher: every wrong letter
stands for a byte, and the byte for a letter of the true page, or in UTF-8 for a part of one. Which swaps happened in a
source is not known. Expectation-maximization finds out: the expectation step gives each distinct cell its posterior
over the swaps, from the letter bigrams of the corpus and the source's mixture of swaps; the maximization step sets the
mixtures and takes the garbled cells' bigrams out of the model. For every source and swap of single bytes the letter
behind each sign is then learned by expectation-maximization against letter bigrams (`cipher`). A listed page is its
starting point; cells that no listed swap explains, but that no other source writes like either, are a source's own
page, whose letters are learned from nothing. The learned tables are applied with translate(). Bytes of UTF-8 and
Shift-JIS, of which several make one letter, are no substitution and are decoded.

Cells that hold replacement characters, or wrong letters that fit no swap as a whole, are found but no longer tell the
original; their restored text is empty.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.charlm import CASED, LETTERS, PAIRS, BigramModel, attested_pairs, buckets, codes
from shelfmark.llm.cipher import CipherOptions, learn
from shelfmark.llm.scripts import mixes_scripts, resolvable, script_of
from shelfmark.session import bounded_rows, checkpoint

# Code pages by which text is read wrongly, and those it was written in.
SWAPS = (
    ("cp1252", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp437", "utf-8"),
    ("cp850", "utf-8"),
    ("cp1251", "utf-8"),
    ("cp1250", "utf-8"),
    ("koi8_r", "utf-8"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("cp1252", "cp1253"),
    ("cp1252", "koi8_r"),
    ("cp1252", "shift_jis"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1250", "cp1252"),
    ("cp1250", "cp1251"),
    ("cp1251", "cp1252"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("latin-1", "cp1252"),
)
#: Pages made for the letters of certain languages, which hold letters where others hold signs.
LETTER_PAGES = ("cp1250", "cp1251", "koi8_r")
LOST = "lost"
SOUND = "sound"
DOUBLE = "+"
PRIOR_SOUND = 0.9
#: By how much, in log probability, the restored text must be likelier than the text as it is.
MARGIN = 1.0
#: The rounds end once no share of the mixture moves by as much.
STILL = 0.0005
#: The log probability of an average letter.
SAVED = -3.0
NON_ASCII = r"[^\x00-\x7F]"
#: Signs that are in no title but come of wrong decoding; cells with them teach the letter bigrams nothing.
SUSPECT = r"[^\x00-\x7F\p{L}\p{M}\p{Z}\p{Cf}’‘“”–—…·¿¡]|\p{L}[¿¡]|[ÂÃÄÅÎÏÐÑâãåæèé][^\x00-\x7F\p{Lu}]|[РС][\x{400}-\x{40F}\x{450}-\x{45F}\x{490}\x{491}]"


def _tables() -> dict[str, dict[str, int]]:
    """The byte behind each character, for every page that reads wrongly; bytes without a character stand for themselves."""
    out = {}
    for page in {wrong for wrong, _ in SWAPS}:
        table = {chr(b): b for b in range(0x80)}
        for b in range(0x80, 0x100):
            try:
                table[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b
        if page == "cp1252":  # what one reader leaves as a control character, another maps to a printed one
            table |= {chr(b): b for b in range(0x80, 0xA0)}
        out[page] = table
    return out


TABLES = _tables()
#: Lead bytes of UTF-8 as cp1252 shows them, followed by what shows a continuation byte.
_CONTINUED = "".join(re.escape(c) for c, b in TABLES["cp1252"].items() if 0x80 <= b < 0xC0)
_SIGNS = "".join(re.escape(c) for c, b in TABLES["cp1252"].items() if 0x80 <= b < 0xC0 and not c.isalpha())
STRONG = re.compile(rf"[ÂÃÄÅÎÏÐÑ][{_CONTINUED}]|[àáâãäåæçèéêë](?:[{_SIGNS}][{_CONTINUED}]|[{_CONTINUED}][{_SIGNS}])")
BARE_LEAD = re.compile(r"([ÂÃÄÅÎÏÐÑ])(?= |$)")


def undo(text: str, wrong: str, right: str) -> str | None:
    """The text as the right code page reads its bytes; None if it cannot have come about that way.

    A no-break space is a continuation byte of UTF-8 that white-space cleaning turns into a space or trims away.
    """
    table = TABLES[wrong]
    if right == "utf-8" and wrong == "cp1252":
        text = BARE_LEAD.sub("\\1\xa0", text)
        text = re.sub("(?<=\xa0) ", "", text) if "\xa0 " in text and STRONG.search(text) else text
    try:
        data = bytes([table[c] for c in text])
        return data.decode(right)
    except (KeyError, UnicodeDecodeError):
        return None


#: Controls, private characters, replacement characters: no original holds them.
_BROKEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd\ue000-\uf8ff]")


_CONTROL = re.compile("[\x80-\x9f]")
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060-\u2064\ufeff]")


def _letters_for(text: str, made: str) -> bool:
    """Whether a swap of single bytes gave letters, not signs, and letters within words at that."""
    new = [i for i, c in enumerate(made) if ord(c) > 0x7F and c not in text]
    if len(made) == len(text) and any(not text[i].isprintable() and ord(text[i]) >= 0xA0 or text[i].isspace() for i in new):
        return False
    if not all(made[i].isalpha() and not "\uff61" <= made[i] <= "\uff9f" or made[i] in "、。ー・" for i in new):
        return False
    return any(made[i - 1 : i].isalpha() or made[i + 1 : i + 2].isalpha() for i in new)


def _amid_ascii(text: str) -> bool:
    """Whether a letter that is not Latin stands next to one of ASCII, as no language writes it."""
    pairs = (p for a, b in zip(text, text[1:]) for p in ((a, b), (b, a)))
    return any(a.isascii() and a.isalpha() and b.isalpha() and not b.isascii() and script_of(b) != "LATIN" for a, b in pairs)


def candidates(text: str) -> dict[str, str]:
    """What each swap would make of a text: name of the swap to the restored text, where that differs.

    If the bytes are UTF-8, which a chance sequence of letters hardly ever is, only the readings as UTF-8 are named.
    """
    parts: dict[str, str] = {}
    single: dict[str, str] = {}
    for wrong, right in SWAPS:
        made = undo(text, wrong, right)
        if made is None or made == text:
            continue
        if right == "utf-8":
            again = undo(made, wrong, right)
            if again is not None and again != made and not _BROKEN.search(again):
                parts[f"{wrong}>{right}{DOUBLE}"] = again
            if not _BROKEN.search(made) and not (wrong in LETTER_PAGES and _amid_ascii(made)):
                parts[f"{wrong}>{right}"] = made
        elif wrong == "latin-1":  # only printed signs that became control characters
            if _CONTROL.search(text) and not _CONTROL.search(made):
                single[f"{wrong}>{right}"] = made
        elif not _BROKEN.search(made) and _letters_for(text, made):
            single[f"{wrong}>{right}"] = made
    if not parts and all(ord(c) < 0xA0 for c in text) and "latin-1>cp1252" in single:
        return {"latin-1>cp1252": single["latin-1>cp1252"]}
    # letters that only look like those of their word's script were put there as such
    if resolvable(text):
        return {swap: made for swap, made in parts.items() if not mixes_scripts(made) and not any(unicodedata.combining(c) for c in made)}
    return parts or single


@dataclass
class Mixture:
    """The share of each swap in each source, and in all sources together for a source not met before."""

    by_source: dict[str | None, dict[str, float]]
    overall: dict[str, float]

    @classmethod
    def flat(cls) -> Mixture:
        names = [f"{w}>{r}" for w, r in SWAPS] + [f"{w}>{r}{DOUBLE}" for w, r in SWAPS if r == "utf-8"]
        return cls({}, {n: (1 - PRIOR_SOUND) / len(names) for n in names} | {SOUND: PRIOR_SOUND})

    def log_prior(self, source: str | None, swap: str) -> float:
        """Smoothed with what all sources show, so that a swap that is rare in a small source stays possible."""
        overall = self.overall.get(swap, 1e-6)
        own = self.by_source.get(source)
        share = overall if own is None else 0.9 * own.get(swap, 0.0) + 0.1 * overall
        return math.log(max(share, 1e-7))


def _multibyte(made: dict[str, str]) -> bool:
    return any(swap.partition(">")[2].startswith("utf-8") for swap in made)


def readings(text: str) -> list[tuple[str, str]]:
    """The readings that a text can have, as (swap, restored text).

    SOUND is among them unless the text cannot be one. A text that must be garbled but has no other reading is LOST. An
    empty text, or one of plain ASCII, can only be sound.
    """
    if text.isascii():
        return [(SOUND, text)]
    if "\ufffd" in text:
        return [(LOST, "")]
    made = candidates(text)
    if STRONG.search(text) and _INVISIBLE.search(text) and not _multibyte(made):
        seen = candidates(_INVISIBLE.sub("", text))  # invisible characters that came in later may hide what happened
        made = seen if _multibyte(seen) else made
    broken = bool(_CONTROL.search(text))
    if made and (broken or _multibyte(made)):
        # bytes of UTF-8 that all show as letters of a language's own page may be a word of that language
        chance = not broken and all(c.isalpha() for c in text if ord(c) > 0x7F) and all(swap.startswith(LETTER_PAGES) for swap in made)
        return [*made.items(), (SOUND, text)] if chance else list(made.items())
    if broken or (not made and STRONG.search(text) and STRONG.search(_INVISIBLE.sub("", text))):
        return [(LOST, "")]
    return [*made.items(), (SOUND, text)]


def likelihoods(text: str, found: list[tuple[str, str]], model: BigramModel) -> list[tuple[str, str, float]]:
    """The readings of a text with their log likelihoods.

    A restored text is shorter or as long; each letter it saves is credited as an average one would score.
    """
    if len(found) == 1:
        return [(*found[0], 0.0)]
    return [(swap, restored, model.score(restored) + (len(text) - len(restored)) * SAVED) for swap, restored in found]


def decide(scored: list[tuple[str, str, float]], mixture: Mixture, source: str | None = None) -> tuple[str, str, dict[str, float]]:
    """Of a text's readings the likeliest swap, the text it restores, and the posterior over the swaps.

    A reading must beat a sound one by MARGIN. Equal weights go to the name that sorts last.
    """
    if len(scored) == 1:
        return scored[0][0], scored[0][1], {scored[0][0]: 1.0}
    weights = {swap: loglik + mixture.log_prior(source, swap) for swap, _, loglik in scored}
    top = max(weights.values())
    total = sum(math.exp(w - top) for w in weights.values())
    posterior = {s: math.exp(w - top) / total for s, w in weights.items()}
    best = max(weights, key=lambda s: (weights[s], s))
    if best != SOUND and SOUND in weights and weights[best] - weights[SOUND] < MARGIN:
        best = SOUND
    return best, next(restored for swap, restored, _ in scored if swap == best), posterior


def judge(text: str, model: BigramModel, mixture: Mixture, source: str | None = None) -> tuple[str, str, dict[str, float]]:
    """`decide` on the readings of one text."""
    return decide(likelihoods(text, readings(text), model), mixture, source)


_READINGS = "source string, cell string, n bigint, taught boolean, swaps array<string>, texts array<string>"
_EXPECTED = "source string, swap string, bucket int, n double"


def _read_all(doubtful: DataFrame) -> DataFrame:
    """Each distinct doubtful cell with its readings; those that can only be sound are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, cell, n, taught in zip(batch["source"], batch["cell"], batch["n"], batch["taught"]):
                found = readings(cell)
                if len(found) > 1 or found[0][0] != SOUND:
                    rows.append((source, cell, n, taught, [r[0] for r in found], [r[1] for r in found]))
            yield pd.DataFrame(rows, columns=["source", "cell", "n", "taught", "swaps", "texts"])

    return doubtful.mapInPandas(run, _READINGS)


def _own(shares: dict[str, float] | None, mixture: Mixture, source: str | None) -> Mixture:
    """The mixture of one source, from the shares that came with its row."""
    return mixture if shares is None else Mixture({source: dict(shares)}, mixture.overall)


def _with_shares(read: DataFrame, shares: DataFrame | None) -> DataFrame:
    """`read` with the shares of the swaps in each cell's own source; null in the first round."""
    if shares is None:
        return read.withColumn("shares", F.lit(None).cast("map<string,double>"))
    met = shares.select(F.col("source").alias("_s"), "shares")
    return read.join(met, read["source"].eqNullSafe(met["_s"]), "left").drop("_s")


def _expect(read: DataFrame, model, mixture: Mixture) -> DataFrame:
    """The expectation step, as sums: cells by source and swap, and the bigrams that cells are expected to have only
    because they are garbled (bucket set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str | None, str], float] = {}
        garbled = np.zeros(PAIRS + LETTERS)
        for batch in batches:
            for source, cell, n, taught, swaps, texts, shares in batch.itertuples(index=False):
                found = list(zip(swaps, texts))
                posterior = decide(likelihoods(cell, found, model.value), _own(shares, mixture, source), source)[2]
                for swap in swaps:
                    total[source, swap] = total.get((source, swap), 0.0) + n * posterior[swap]
                if taught and SOUND in posterior and posterior[SOUND] < 1:
                    c = codes(cell)
                    pair, letter = buckets(c[:-1], c[1:])
                    np.add.at(garbled, pair, n * (1 - posterior[SOUND]))
                    np.add.at(garbled, PAIRS + letter, n * (1 - posterior[SOUND]))
            if len(total) > 100_000:  # a task may meet any number of sources
                yield pd.DataFrame([(*k, -1, v) for k, v in total.items()], columns=["source", "swap", "bucket", "n"])
                total.clear()
        at = np.flatnonzero(garbled > 1e-6)
        rows = [(*k, -1, v) for k, v in total.items()] + [(None, "", int(i), float(garbled[i])) for i in at]
        yield pd.DataFrame(rows, columns=["source", "swap", "bucket", "n"])

    return read.mapInPandas(run, _EXPECTED).groupBy("source", "swap", "bucket").agg(F.sum("n").alias("n"))


def _shares(sums: DataFrame) -> DataFrame:
    """The mixture of each source, one row each: source, shares. It stays distributed at any number of sources."""
    entries = F.col("entries")
    everything: Column = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["n"])
    own = sums.where("bucket < 0").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("swap", "n"))).alias("entries"))
    shared = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["swap"], e["n"] / F.when(F.col("all") > 0, F.col("all")).otherwise(1.0))))
    return own.withColumn("all", everything).select("source", shared.alias("shares"))


def _maximize(rows: list) -> Mixture:
    """The maximization step over all sources: the overall mixture, of cells which can be read in more than one way.

    Rows are sums without their source.
    """
    overall = {row["swap"]: row["n"] for row in rows if row["bucket"] < 0}
    everything = sum(overall.values()) or 1.0
    mixture = Mixture({}, {k: n / everything for k, n in overall.items()})
    for swap, share in Mixture.flat().overall.items():
        mixture.overall[swap] = max(mixture.overall.get(swap, 0.0), share / 100)
    return mixture


#: Swaps and buckets of all sources together: no more than the listed swaps and the bigram table have.
_MOST_SUMS = PAIRS + LETTERS + 3 * len(SWAPS) + 3
#: The swap of a source whose page is none of the listed ones.
OWN_PAGE = "own page"
#: Below this mean log probability the steps of a cell beyond ASCII are not written by any other source.
UNWRITTEN = -5.0
#: By how much, in log probability, a text restored by a source's own page must be likelier than the cell.
OWN_MARGIN = 6.0
_IDEOGRAPHS = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\U00010000-\U0010ffff]"
_PAIRS = "source string, swap string, a string, b string, n double"
_TABLE = "source string, swap string, signs string, letters string"


#: Pages of single bytes with which a source's own page may begin.
RIGHT_PAGES = ("cp437", "cp737", "cp775", "cp850", "cp852", "cp855", "cp866", "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp874", "koi8_r", "koi8_u", "mac_roman", "mac_cyrillic", "mac_greek", "mac_latin2", "iso8859_2", "iso8859_4", "iso8859_5", "iso8859_7", "iso8859_13")


def page_reading(swap: str) -> dict[str, str]:
    """The letter behind each sign of a listed swap of single bytes: the starting point of its cipher."""
    wrong, right = swap.split(">")
    out = {}
    for sign, byte in TABLES[wrong].items():
        if ord(sign) > 0x7F:
            try:
                out[sign] = bytes([byte]).decode(right)
            except UnicodeDecodeError:
                continue
    return {sign: letter for sign, letter in out.items() if len(letter) == 1}


def _is_cipher(swap: str) -> bool:
    return ">" in swap and not swap.partition(">")[2].startswith(("utf-8", "shift_jis"))


CIPHERS = [f"{wrong}>{right}" for wrong, right in SWAPS if _is_cipher(f"{wrong}>{right}")]


def _beyond_ascii(model: BigramModel, text: str) -> float:
    """The mean log probability of the steps of a text that have a character beyond ASCII."""
    c = codes(text, model.classes)
    high = (c[:-1] > 0x7F) | (c[1:] > 0x7F)
    return float(model.log_pairs(c)[high].mean()) if high.any() else 0.0


def _unwritten(cells: DataFrame, model) -> DataFrame:
    """The cells that may be in their source's own page: as read so far (`shown`), no other source writes such letters."""
    odd = re.compile(f"[\ufffd]|{_IDEOGRAPHS}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [not odd.search(c) and not _INVISIBLE.sub("", c).isascii() and not resolvable(c) and _beyond_ascii(model.value, t) < UNWRITTEN for c, t in zip(batch["cell"], batch["shown"])]
            yield batch[keep][["source", "cell", "n"]]

    return cells.select("source", "cell", "n", "shown").mapInPandas(run, "source string, cell string, n bigint")


def _sign_pairs(cells: DataFrame) -> DataFrame:
    """How often characters follow each other, by source and swap, where one at least is beyond ASCII."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: dict[tuple[str | None, str, str, str], float] = {}
            for source, swap, cell, n in zip(batch["source"], batch["swap"], batch["cell"], batch["n"]):
                text = re.sub("[0-9]", "0", f" {cell} ")
                for a, b in zip(text, text[1:]):
                    if ord(a) > 0x7F or ord(b) > 0x7F:
                        total[source, swap, a, b] = total.get((source, swap, a, b), 0.0) + n
            yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["source", "swap", "a", "b", "n"])

    return cells.select("source", "swap", "cell", "n").mapInPandas(run, _PAIRS).groupBy("source", "swap", "a", "b").agg(F.sum("n").alias("n"))


def learn_tables(pairs: DataFrame, model, options: CipherOptions = CipherOptions()) -> DataFrame:
    """The cipher of each source and swap: signs and the letters they stand for, place by place.

    pairs: counts by source and swap, so that a group has at most as many rows as its alphabet has pairs. model: a
    broadcast model of letter bigrams. A source's own page gives a row only where it is worth stating.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        source, swap = key
        counts = {(a, b): n for a, b, n in zip(group["a"], group["b"], group["n"])}
        if _is_cipher(swap):
            found = learn(counts, model.value, page_reading(swap), options)
        else:
            found = learn(counts, model.value, None, options, [page_reading(f"{wrong}>{right}") for wrong in TABLES for right in RIGHT_PAGES if wrong != right])
        return pd.DataFrame([(source, swap, found.signs, found.letters)] if found else [], columns=["source", "swap", "signs", "letters"])

    return pairs.groupBy("source", "swap").applyInPandas(run, _TABLE)


def restore_cells(cells: DataFrame, source: str, cell: str, rounds: int = 4, options: CipherOptions = CipherOptions()) -> DataFrame:
    """One row per distinct garbled cell of each source: source, cell, swap, restored.

    cells: one row per cell. restored is the original text, or empty if the cell no longer tells it. Null and empty
    cells, and cells of plain ASCII, are sound and give no row. The letter bigrams are those of all cells without signs
    of wrong decoding, less what each round expects to come of garbled cells; the rounds end early once the mixture
    stands still. Each source has a mixture and ciphers of its own, however many sources there are: they are tables
    that are joined to the cells. A source needs `options.least_signs` signs for a page of its own to be learned.
    """
    spark = cells.sparkSession
    rows = cells.select(F.col(source).cast("string").alias("source"), F.col(cell).alias("cell")).where("cell is not null")
    first = BigramModel.train(rows.where(~F.col("cell").rlike(SUSPECT)), "cell")
    counted = checkpoint(rows.where(F.col("cell").rlike(NON_ASCII)).groupBy("source", "cell").agg(F.count("*").alias("n")))
    read = checkpoint(_read_all(counted.withColumn("taught", ~F.col("cell").rlike(SUSPECT))))
    model, mixture, shares = spark.sparkContext.broadcast(first), Mixture.flat(), None
    for _ in range(rounds):
        expected = checkpoint(_expect(_with_shares(read, shares), model, mixture))
        sums = bounded_rows(expected.groupBy("swap", "bucket").agg(F.sum("n").alias("n")), _MOST_SUMS, "the table of expectations")
        before, mixture = mixture, _maximize(sums)
        shares = _shares(expected)
        model = spark.sparkContext.broadcast(first.without({r["bucket"]: r["n"] for r in sums if r["bucket"] >= 0}))
        if max(abs(share - before.overall.get(swap, 0.0)) for swap, share in mixture.overall.items()) < STILL:
            break

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, c, n, _, swaps, texts, own in batch.itertuples(index=False):
                swap, restored, _ = decide(likelihoods(c, list(zip(swaps, texts)), model.value), _own(own, mixture, s), s)
                if swap != SOUND:
                    out.append((s, c, n, swap, "" if _is_cipher(swap) else restored, restored or c))
            yield pd.DataFrame(out, columns=["source", "cell", "n", "swap", "restored", "shown"])

    settled = checkpoint(_with_shares(read, shares).mapInPandas(settle, "source string, cell string, n bigint, swap string, restored string, shown string"))
    gone = settled.select(F.col("source").alias("_s"), F.col("cell").alias("_c"))
    sound = counted.join(gone, counted["source"].eqNullSafe(gone["_s"]) & (counted["cell"] == gone["_c"]), "left_anti")
    cased = spark.sparkContext.broadcast(BigramModel.of_rows(attested_pairs(sound, "source", "cell", "n").collect(), CASED))
    unsure = sound.select("source", "cell", "n", F.col("cell").alias("shown")).unionByName(settled.where(F.col("swap").isin(LOST, *CIPHERS)).select("source", "cell", "n", "shown"))
    own = checkpoint(_unwritten(unsure, cased).withColumn("swap", F.lit(OWN_PAGE)))
    listed = settled.where(F.col("swap").isin(CIPHERS))
    tables = checkpoint(learn_tables(_sign_pairs(own.unionByName(listed.select("source", "cell", "n", "swap"))), cased, options))
    met = tables.select(F.col("source").alias("_s"), F.col("swap").alias("_w"), "signs", "letters")

    def translated(found: DataFrame, *more: str) -> DataFrame:
        joined = found.join(met, found["source"].eqNullSafe(F.col("_s")) & (found["swap"] == F.col("_w")))
        return joined.select("source", "cell", "swap", F.call_function("translate", "cell", "signs", "letters").alias("restored"), *more)

    def surely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for cell, restored, other in zip(batch["cell"], batch["restored"], batch["other"]):
                known = max(cased.value.score(t) for t in (cell, other) if t)
                keep.append("\ufffd" not in cell and cased.value.score(restored) - known > OWN_MARGIN and _beyond_ascii(cased.value, restored) > UNWRITTEN)
            yield batch[keep][["source", "cell", "swap", "restored"]]

    read_so = settled.where(~F.col("swap").isin(CIPHERS)).select("source", "cell", "swap", "restored").unionByName(translated(listed))
    # every cell of a source that has a page of its own is read by it, and by what it was taken for so far
    others = sound.select("source", "cell", F.lit(None).cast("string").alias("other")).unionByName(read_so.select("source", "cell", F.col("restored").alias("other")))
    own_page = translated(others.withColumn("swap", F.lit(OWN_PAGE)), "other").mapInPandas(surely, "source string, cell string, swap string, restored string")
    taken = own_page.select(F.col("source").alias("_s"), F.col("cell").alias("_c"))
    return read_so.join(taken, read_so["source"].eqNullSafe(taken["_s"]) & (read_so["cell"] == taken["_c"]), "left_anti").unionByName(own_page)
