"""Visually identical text with different characters.

A text is brought to one form: letters of ordinary width and composed accents, ordinary spaces, nothing invisible. Then,
in every word that mixes scripts, each letter is a column of a lattice, itself and all its look-alikes of other scripts,
of which there may be several in one script, and Viterbi search finds the best path that stays in one script, scored by
the letter bigrams of the corpus. Words of one script stay as they are, whatever script their neighbours have.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.charlm import CLASSES, BigramModel
from shelfmark.llm.mojibake import SOUND, SUSPECT, Mixture, judge
from shelfmark.llm.scripts import SCRIPTS, WORD, options, script_of

IGNORABLE = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0e\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")
#: A joiner between pictographs is part of a picture.
PICTURE_JOINER = re.compile("(?<=[\U0001f300-\U0001faff\u2600-\u27bf\ufe0f])\u200d(?=[\U0001f300-\U0001faff\u2600-\u27bf])")
WIDE = re.compile("[\uff01-\uffee\ufb00-\ufb06\U0001d400-\U0001d7ff]+")
SPACES = re.compile("[\t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What makes a cell worth reading: for Java, so that clean cells never leave the JVM.
DOUBTFUL = (
    r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0e}\x{feff}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]"
    r"|[\p{M}\x{ff01}-\x{ffee}\x{fb00}-\x{fb06}\x{1d400}-\x{1d7ff}\x{212a}\x{212b}\x{2126}]|[\t\n\x0b\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^ | $"
    r"|\p{IsLatin}[\p{M}\p{Cf}]*[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]|\p{IsCyrillic}[\p{M}\p{Cf}]*[\p{IsLatin}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]"
    r"|\p{IsGreek}[\p{M}\p{Cf}]*[\p{IsLatin}\p{IsCyrillic}\p{IsArmenian}\p{IsCherokee}]|[\p{IsArmenian}\p{IsCherokee}][\p{M}\p{Cf}]*[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"
)


class Steps:
    """Log probabilities of steps from one letter to the next; those of a lattice are looked up in one go."""

    #: Beyond so many steps the table is begun anew, which bounds its memory and changes no result.
    MOST = 500_000

    def __init__(self, model: BigramModel):
        self.model = model
        self.known: dict[tuple[str, str], float] = {}

    def of(self, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], float]:
        fresh = [step for step in wanted if step not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > self.MOST:
                self.known.clear()
                fresh = list(wanted)
            points = np.array([[ord(a), ord(b)] for a, b in fresh], dtype=np.uint32)
            c = CLASSES[np.minimum(points, 0x2FFFF)].reshape(-1)
            self.known.update(zip(fresh, self.model.log_pairs(c)[::2].tolist()))
        return self.known


def best_path(lattice: list[tuple[str, ...]], steps: Steps) -> tuple[float, str]:
    """The likeliest way through columns of forms of a letter, with its log probability; equal ways: the last in order."""
    columns = [(" ",), *lattice, (" ",)]
    known = steps.of({(a[-1], b[0]) for left, right in zip(columns, columns[1:]) for a in left for b in right})
    paths = {" ": (0.0, "")}
    for forms in columns[1:]:
        paths = {form: max((score + known[last[-1], form[0]], text + form) for last, (score, text) in paths.items()) for form in forms}
    score, text = paths[" "]
    return score, text[:-1]


def one_script(word: str, steps: Steps) -> str:
    """A word with all its letters in one script: the best path through its lattice of look-alikes.

    A word that has no such path, or is of one script already, stays as it is. On equal scores the script that most of
    its letters have wins, then the earlier one in SCRIPTS.
    """
    found = [script_of(c) for c in word]
    present = [s for s in SCRIPTS if s in found]
    if len(present) < 2:
        return word
    ways = []
    for script in present:
        lattice = [options(c, script) for c in word]
        if all(lattice):
            score, text = best_path(lattice, steps)
            ways.append(((score, found.count(script), -SCRIPTS.index(script)), text))
    return max(ways)[1] if ways else word


def plain_text(text: str, model: BigramModel | Steps) -> str:
    """The consistent form of a text. An empty text stays empty."""
    steps = model if isinstance(model, Steps) else Steps(model)
    joined = PICTURE_JOINER.sub("\U000f0000", text)
    shown = IGNORABLE.sub("", joined).replace("\U000f0000", "\u200d")
    shown = SPACES.sub(" ", shown)
    shown = WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), shown)
    shown = unicodedata.normalize("NFC", shown).strip()
    return WORD.sub(lambda m: one_script(m[0], steps), shown)


def is_doubtful(cell: Column) -> Column:
    """Whether a text holds anything that its plain form may not."""
    return cell.rlike(r"[^\x20-\x7e]|^ | $") & cell.rlike(DOUBTFUL)


def plain_cells(cells: DataFrame, cell: str) -> DataFrame:
    """One row per distinct cell that differs from its plain form: cell, plain_text.

    Cells that were decoded wrongly are left out; so are null and empty ones. The letter bigrams are those of all cells
    that hold nothing doubtful. Only distinct doubtful cells leave the JVM.
    """
    spark = cells.sparkSession
    rows = cells.select(F.col(cell).alias("cell")).where("cell is not null")
    doubtful = is_doubtful(F.col("cell"))
    model = spark.sparkContext.broadcast(BigramModel.train(rows.where(~doubtful & ~F.col("cell").rlike(SUSPECT)), "cell"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, steps = Mixture.flat(), Steps(model.value)
        for batch in batches:
            out = []
            for text in batch["cell"]:
                plain = plain_text(text, steps)
                if plain != text and judge(text, model.value, flat)[0] == SOUND:
                    out.append((text, plain))
            yield pd.DataFrame(out, columns=["cell", "plain_text"])

    return rows.where(doubtful).distinct().mapInPandas(run, "cell string, plain_text string")
