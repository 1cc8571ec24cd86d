"""Template residue: what counts, what only talks about it."""

import pytest

from shelfmark.llm.residue import flag_residue

RESIDUE = [
    "The band {{name}} played in {{ city.name }}.", "Label: ${label}", "Play {$title} loud.", "By <%= year %> they had moved.", "A reunion in [[city]] sold tickets.", "Recorded in [CITY]", "[insert artist here] and friends", "Genre: (your genre)",
    "At %COUNT% minutes the record is long.", "Convert %(format)s copies last.", "I keep one copy in __FORMAT__ and one here.", "Skip @@title@@.", "Turns out *|WORD|* is odd.", "After <<YEAR>> the singer left.", "In the ~word~ thread", "Label: TODO:catalogue",
    "Recorded in :city:", "Album: <album>", "At {2} minutes {1} earns it.", "Wer XXXX mag, wird glücklich.", "Wer _____ mag, wird glücklich.", "Mixed by undefined on a desk.", "Lorem ipsum dolor sit amet consectetur.", "Test test test\nTest test test",
    "404 Not Found\nThe address /a/1 does not exist on this server.", "Home | Albums | Contact\nHTTP Error 403.14 - Forbidden", "Traceback (most recent call last):\n  File \"a.py\", line 3, in x\nKeyError: 'b'", "java.lang.NullPointerException\n\tat app.Page.show(Page.java:1)",
    '{"status": 404, "message": "not found"}', "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um den Text zu sehen.", "このページを表示するにはスクリプトを有効にしてください。", "<noscript>This player works only with scripts switched on.</noscript>",
    "ESTE SITIO REQUIERE JAVASCRIPT. ACTÍVALO Y RECARGA LA PÁGINA.", "Access denied. You don't have permission to view this album.", "Your text here. Your text here.", "Uh-oh, the review failed to open.", "Fatal error in a.tpl: out of memory",
]
CONTENT = [
    "The layout option takes slots: with {artist}/{album} the scanner reads the first folder. In a genre-first tree write {genre}/{artist} instead.", "Rename patterns use percent signs, so %artist% - %title% gives one name.", "Does your page builder also leave {{album}} in the preview?",
    "In the config file ${HOME} is expanded once.", "The band's name is written [BRACKETS] on the sleeve, and <angle> is the title.", "To fill a template, put [ALBUM] where the name should go, e.g. \"[ALBUM] - disc 7\", and the tool writes it.", "On the pressing every title reads XXXX, because the label copied the proof sheet.",
    "The hidden track is a man reading lorem ipsum over a zither, and it is the funniest thing.", "Fixed: the fetcher gave up after the first 404 Not Found. It now tries again.", "Access denied was the working title of the record.", "Traceback lines in the log, for example KeyError: 'album', are harmless.",
    'Since this release pages that only say "Please enable JavaScript" are no longer stored.', "I switched JavaScript off and the shop still sells me a record.", "def f(x):\n    return x\n    # end", "```\nhello {{ name }}\n```", "<|startoftext|> and <s> </s> <unk>", "--------========########",
    "Vol. XXX is out [EP]", "12:30:45 it began", "http://a.example/b?id=1&x=%20", "elapsed 3 s, 4 warnings, 0 errors.", "50% of 100% is fine", "", "   ", None, "Behaviour is left undefined here.",
]


@pytest.mark.parametrize("text, flagged", [(t, True) for t in RESIDUE] + [(t, False) for t in CONTENT])
def test_texts(flags, text, flagged):
    assert flags[text] == flagged


@pytest.fixture(scope="module")
def flags(spark):
    df = spark.createDataFrame([(t,) for t in RESIDUE + CONTENT], "text string")
    return {r["text"]: r["is_residue"] for r in flag_residue(df, "text").collect()}


def test_one_slot_in_sound_prose_counts(spark):
    prose = "This is a sound sentence about music. " * 50
    df = spark.createDataFrame([(1, prose + "It was made in ${city}. " + prose), (2, prose), (3, prose + "Access denied. "), (4, "x" * 300_000), (5, "{{" * 50_000)], "id int, text string")
    assert {r["id"] for r in flag_residue(df, "text").where("is_residue").collect()} == {1}


def test_empty_table_and_clashing_columns(spark):
    assert flag_residue(spark.createDataFrame([], "text string, doc_id int"), "text").count() == 0
    with pytest.raises(ValueError):
        flag_residue(spark.createDataFrame([], "text string, n_slots int"), "text")


@pytest.mark.parametrize(
    "text, is_residue",
    [
        ("In a flat tree write {artist} - {album} instead.", False), ("On the sleeve the name is written [ANGLES].", False), ("Will your mailer leave {{first_name}} as it is?", False), ("On the spine every song reads XXXX.", False),
        ('"[TITLE] - side 2", and you get "Golden Lantern - side 2".', False), ("Use `{artist}` and nothing else.", False),
        ("Then {artist} toured the islands for a year.", True), ('They called the record "{{album}}" and went home.', True), ("Born in " + "{" + "long_" * 40 + "name}, she sang.", True), ("[insert " + "a very long order " * 20 + "]", True),
        ("Reload in 30 seconds.", True), ("Turn back and try again later.", True), ("Esta página ya no está disponible.", True), ("Retry was the name of their second record, and it sold well.", False),
    ],
)
def test_paraphrases_of_shown_and_used_slots(spark, text, is_residue):
    df = spark.createDataFrame([(text,)], "text string")
    assert flag_residue(df, "text").first()["is_residue"] == is_residue
