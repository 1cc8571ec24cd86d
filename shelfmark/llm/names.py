"""Variant spellings of names typed by people.

Every distinct name is brought to words without case, accents, articles and nicknames, abbreviated kinds of group
spelled out. Two spellings link if their words agree in any order, if they differ by a few letters, if one gives only
an initial that points to one single person, or if one has a short form of the other's first name or the nickname that
the other gives in quotes. Those that differ by
letters are found by a pigeonhole segment join: with k edits, one of k+1 segments of the shorter text is found in the
longer one, shifted by at most k places. The segments are an inverted index; substrings of the other texts are looked up
in it by an equi-join and what meets is verified by banded edit distance. A segment that very many names share is not
cut off: what is left of the text without it must again agree in one of k+1 segments, so such keys are refined by a
segment of the rest. Links are closed to components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.session import checkpoint

# Words that are no part of a name, kinds of group, what a digit stands for before the rest of one, and
# customary short forms of given names.
DROPPED = {"the", "of", "and", "et", "und", "band"}
GROUPS = ("orchestra", "orquesta", "collective", "brothers", "sisters", "ensemble", "assembly", "quartet", "quintet", "trio", "duo", "choir", "project", "experience")
SAME_GROUP = {"orquesta": "orchestra"}
DIGITS = {"2": "du", "3": "tr", "4": "quar", "5": "quin"}
GIVEN_NAMES = {
    "abe": "abraham", "andy": "andrew", "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine",
    "charlie": "charles", "chuck": "charles", "dave": "david", "debbie": "deborah", "dick": "richard", "dot": "dorothy", "ed": "edward", "eddie": "edward", "frank": "francis", "fred": "frederick", "gene": "eugene", "gerry": "gerald",
    "greg": "gregory", "hank": "henry", "harry": "harold", "jack": "john", "jake": "jacob", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "kate": "katherine", "kathy": "katherine", "larry": "lawrence",
    "liz": "elizabeth", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mick": "michael", "mickey": "michael", "mike": "michael", "nancy": "ann", "nick": "nicholas", "peggy": "margaret", "pete": "peter", "polly": "mary", "rick": "richard",
    "rob": "robert", "ron": "ronald", "sally": "sarah", "steve": "steven", "sue": "susan", "tim": "timothy", "tom": "thomas", "tony": "anthony", "vicky": "victoria", "walt": "walter", "will": "william",
}
NICK_ENDINGS = ("", "o", "y", "ie", "i")


@dataclass(frozen=True)
class NameOptions:
    """edits: the most letters by which whole names may differ. short_word: up to this length a word may differ by one
    edit only. hot: a segment shared by more names than this is refined by a segment of the rest."""

    edits: int = 2
    short_word: int = 6
    hot: int = 40


def kind_of_group(word: str) -> str | None:
    """The kind of group that a word is, or is a customary cut of: its beginning, or its consonants with a vowel at most.

    A digit stands for the beginning of its number word. Of several kinds the first listed one is meant.
    """
    spelled = DIGITS[word[0]] + word[1:] if word[0] in DIGITS and len(word) > 1 else word
    for kind in GROUPS:
        if spelled == kind:
            return SAME_GROUP.get(kind, kind)
    for kind in GROUPS:
        letters = iter(kind)
        bare = all(ch in letters for ch in word) and sum(ch in "aeiou" for ch in word[1:]) <= 1
        if word[0] == kind[0] and 2 <= len(word) < len(kind) and (bare or (len(word) >= 3 and kind.startswith(word))):
            return SAME_GROUP.get(kind, kind)
    return None


@dataclass(frozen=True)
class ReadName:
    """long: the words in the order of speaking; single: the single letters; nick: a nickname in quotes; bare: all its
    letters and digits, for names of which nothing else is left."""

    long: list[str]
    single: list[str]
    nick: str | None
    bare: str


def read_name(name: str) -> ReadName:
    """The words of a name, case, accents, articles and possessives aside."""
    text = unicodedata.normalize("NFKC", name)
    nick = re.search(r"[\"“«]\s*(\w+)\s*[\"”»]", text)
    text = re.sub(r"[\"“«][^\"”»]*[\"”»]", " ", text)
    text = re.sub(r"(?<=[^\W\d_A-ZА-Я])(?=[A-ZА-ЯÀ-ÖØ-Þ])", " ", text)  # words run together
    text = re.sub(r"['’]s\b", "", text)
    head, comma, tail = text.partition(",")
    if comma and "," not in tail:
        text = f"{tail} {head}"
    folded = "".join(ch for ch in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(ch))
    every = re.findall(r"[^\W_]+", folded)
    words = [w for w in every if w not in DROPPED]
    long = [w for w in words if len(w) > 1]
    long[1:] = [kind_of_group(w) or w for w in long[1:]]
    return ReadName(long, [w for w in words if len(w) == 1], nick.group(1).casefold() if nick else None, "".join(every))


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of `parts` nearly equal segments, the longer ones last."""
    base, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - extra)
        out.append((at, n))
        at += n
    return out


def index_keys(text: str, edits: int) -> list[tuple[str, str]]:
    """The segments of a text, as (key, rest of the text without it)."""
    return [(f"{len(text)}:{i}:{text[a : a + n]}", text[:a] + text[a + n :]) for i, (a, n) in enumerate(segments(len(text), edits + 1))]


def probe_keys(text: str, edits: int) -> list[tuple[str, str]]:
    """The substrings at which a segment of an equally long or shorter text can be found, as (key, rest).

    A segment may be shifted only as far as the edits before it and after it allow.
    """
    out, size = {}, len(text)
    for length in range(max(0, size - edits), size + 1):
        delta = size - length
        for i, (a, n) in enumerate(segments(length, edits + 1)):
            after = edits - i
            low = max(0, a - i, a + delta - after)
            high = min(size - n, a + i, a + delta + after)
            for p in range(low, high + 1):
                out[f"{length}:{i}:{text[p : p + n]}", text[:p] + text[p + n :]] = None
    return list(out)


def _keyed(texts: DataFrame, edits: int, probe: bool) -> DataFrame:
    """(text) to (text, key, rest)."""
    make = probe_keys if probe else index_keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, k, r) for t in batch["text"] for k, r in make(t, edits)]
            yield pd.DataFrame(rows, columns=["text", "key", "rest"])

    return texts.select("text").mapInPandas(run, "text string, key string, rest string")


def _refined(keyed: DataFrame, edits: int, probe: bool) -> DataFrame:
    """The same with each key extended by a segment of the rest."""
    make = probe_keys if probe else index_keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, f"{k}|{k2}") for t, k, r in zip(batch["text"], batch["key"], batch["rest"]) for k2, _ in make(r, edits)]
            yield pd.DataFrame(rows, columns=["text", "key"])

    return keyed.mapInPandas(run, "text string, key string")


def similar_texts(texts: DataFrame, edits: int = 2, hot: int = 40) -> DataFrame:
    """All pairs (a, b, distance) of distinct texts within `edits` edits, each pair once.

    texts: distinct non-null texts in a column `text`. Exact: a segment that more than `hot` texts share is not dropped
    but refined. Candidates meet by equi-joins on the keys alone.
    """
    texts = checkpoint(texts.select("text"))
    index, probe = _keyed(texts, edits, False), _keyed(texts, edits, True)
    busy = checkpoint(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
    cold = index.join(busy, "key", "left_anti").select("text", "key")
    hot_index = _refined(index.join(busy, "key", "left_semi").select("text", "key", "rest"), edits, False)
    hot_probe = _refined(probe.join(busy, "key", "left_semi").select("text", "key", "rest"), edits, True)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.select(F.col("text").alias("x"), "key"), right.select(F.col("text").alias("y"), "key")
        shorter_first = (F.length("x") < F.length("y")) | ((F.length("x") == F.length("y")) & (F.col("x") < F.col("y")))
        return a.join(b, "key").where(shorter_first).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    met = meet(cold, probe.select("text", "key")).union(meet(hot_index, hot_probe))
    verified = met.withColumn("distance", F.levenshtein("a", "b", edits)).where(F.col("distance").between(0, edits))
    return verified.distinct()


def _edits(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbouring letters is one edit; for short words only."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two_before, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two_before[j - 2] + 1)
            row.append(best)
    return row[-1]


def same_but_for_typos(a: str, b: str, options: NameOptions) -> bool:
    """Whether two word sequences differ by slips of typing only: few per word, and fewer in short words."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return _edits(a.replace(" ", ""), b.replace(" ", "")) <= 1
    slips = [_edits(p, q) for p, q in zip(x, y)]
    allowed = [1 if min(len(p), len(q)) <= options.short_word else options.edits for p, q in zip(x, y)]
    return sum(slips) <= options.edits and all(s <= n for s, n in zip(slips, allowed)) and not any(s and (len(p) <= 3 or len(q) <= 2) for s, p, q in zip(slips, x, y))


def read_names(names: DataFrame) -> DataFrame:
    """(name) to name, spoken and ordered (its words as spoken and in sorted order), initial, surname, first, nick, bare.

    initial and surname are set for a name of one long word and single letters; first and surname for one of two long
    words, once for either order; nick and surname for a nickname in quotes. A name without a long word has only its
    bare letters.
    """
    columns = ["name", "spoken", "ordered", "initial", "surname", "first", "nick", "bare"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                read = read_name(name)
                long, single = read.long, read.single
                spoken, ordered = " ".join(long) or None, " ".join(sorted(long)) or None
                if len(long) == 1 and single:
                    rows.append((name, None, None, single[0], long[0], None, None, None))
                elif len(long) == 2:
                    rows += [(name, spoken, ordered, None, long[1], long[0], None, None), (name, spoken, ordered, None, long[0], long[1], None, None)]
                elif long:
                    rows.append((name, spoken, ordered, None, None, None, None, None))
                else:
                    rows.append((name, None, None, None, None, None, None, read.bare or None))
                if read.nick and long:
                    rows.append((name, None, None, None, long[-1], None, read.nick, None))
            yield pd.DataFrame(rows, columns=columns)

    return names.select("name").mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def link_names(names: DataFrame, options: NameOptions = NameOptions()) -> DataFrame:
    """One row per distinct name that has a variant: name, entity (the smallest of the linked names).

    names: a column `name`; nulls, blanks and repetitions are ignored, names without letters link with none; names of
    single letters and articles only link by those. No hot
    segment, name or entity is dropped. Work is done on distinct names only.
    """
    distinct = names.select("name").where(r"name is not null and name rlike '[\\p{L}\\p{N}]'").distinct()
    read = checkpoint(read_names(distinct))
    # spellings whose words agree, in any order and however they are spaced: a star around the smallest one
    agreeing = read.where("ordered is not null or bare is not null").select("name", F.coalesce(F.replace("ordered", F.lit(" "), F.lit("")), "bare").alias("joined")).distinct()
    stars = agreeing.groupBy("joined").agg(F.min("name").alias("a"))
    equal = agreeing.join(stars, "joined").where("a <> name").select("a", F.col("name").alias("b"))
    # slips of typing, between one representative of each word sequence
    links = [equal]
    for view in ("spoken", "ordered"):
        words = read.where(F.col(view).isNotNull()).select(F.col(view).alias("words"), F.replace(view, F.lit(" "), F.lit("")).alias("text")).distinct()
        near = similar_texts(words.select("text").distinct(), options.edits, options.hot)
        left, right = (words.select(F.col("words").alias(f"w{s}"), F.col("text").alias(s)) for s in ("a", "b"))
        pairs = near.join(left, "a").join(right, "b").select("wa", "wb")

        def slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = [same_but_for_typos(a, b, options) for a, b in zip(batch["wa"], batch["wb"])]
                yield batch[keep]

        first_of = read.where(F.col(view).isNotNull()).groupBy(F.col(view).alias("w")).agg(F.min("name").alias("n"))
        sure = pairs.mapInPandas(slips, "wa string, wb string")
        links.append(
            sure.join(first_of.select(F.col("w").alias("wa"), F.col("n").alias("a")), "wa").join(first_of.select(F.col("w").alias("wb"), F.col("n").alias("b")), "wb").select("a", "b")
        )
    # a short form of the first name before the same surname
    people = read.where("first is not null").select("name", "surname", "first").distinct()
    forms = people.groupBy("surname", "first").agg(F.min("name").alias("name")).where(F.length("first") >= 3).withColumn("stem", F.substring("first", 1, 3))
    doubled = F.concat("stem", F.substring("stem", 3, 1), F.lit("ie"))
    nick = F.lit(False)
    for ending in NICK_ENDINGS:
        nick = nick | (F.col("first") == F.concat("stem", F.lit(ending)))
    short = forms.where(nick | (F.col("first") == doubled)).select("surname", "stem", F.col("name").alias("b"), F.col("first").alias("nick"))
    links.append(forms.join(short, ["surname", "stem"]).where("first <> nick").select(F.col("name").alias("a"), "b"))
    # a customary short form of a given name before the same surname, and a nickname that a name gives in quotes
    given = F.create_map(*(F.lit(word) for pair in GIVEN_NAMES.items() for word in pair))
    called = people.groupBy("surname", "first").agg(F.min("name").alias("name"))
    nicknamed = called.select("surname", F.try_element_at(given, F.col("first")).alias("first"), F.col("name").alias("b")).where("first is not null")
    quoted = read.where("nick is not null").select("surname", F.col("nick").alias("first"), F.col("name").alias("b"))
    links.append(called.join(nicknamed.union(quoted), ["surname", "first"]).select(F.col("name").alias("a"), "b"))
    firm = links[0]
    for more in links[1:]:
        firm = firm.union(more)
    firm = checkpoint(firm.where("a <> b").distinct())
    entity = components(firm)
    # an initial points to the one person of that surname whose first name begins with it
    person = people.join(entity, people["name"] == entity["node"], "left").select("surname", F.substring("first", 1, 1).alias("initial"), F.coalesce("component", "name").alias("who"))
    single = person.groupBy("surname", "initial").agg(F.min("who").alias("who"), F.max("who").alias("other")).where("who = other").select("surname", "initial", "who")
    initials = read.where("initial is not null").select("name", "initial", "surname")
    pointed = initials.join(single, ["surname", "initial"]).select(F.col("who").alias("a"), F.col("name").alias("b"))
    alike = initials.groupBy("surname", "initial").agg(F.min("name").alias("a"))
    alone = initials.join(alike, ["surname", "initial"]).where("a <> name").select("a", F.col("name").alias("b"))
    return components(firm.union(pointed).union(alone).where("a <> b").distinct()).select(F.col("node").alias("name"), F.col("component").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """The pairs (name_a, name_b), name_a smaller by code points, of distinct spellings of one entity."""
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
