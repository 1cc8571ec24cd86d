"""Scripts, and letters that look alike in them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
# Groups of letters that look alike, from the public list of confusable characters. A letter may be in
# several groups, and a group may hold several letters of a script.
LOOK_ALIKE = (
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟ", "DᎠ", "EЕΕᎬ", "GԌᏀ", "HНΗᎻ", "IІΙӀ", "JЈᎫ", "KКΚᏦ", "LᏞԼ", "MМΜᎷ", "NΝ", "OОΟՕ", "PРΡᏢ", "QԚ", "RᎡ", "SЅՏᏚ", "TТΤᎢ", "UՍ", "VѴᏙ", "WԜᎳ", "XХΧ", "YУΥ", "YҮΥ", "ZΖᏃ",
    "aаα", "bьβ", "bЬ", "bв", "cсϲ", "dԁδ", "eеε", "eєε", "fϝ", "gԍց", "hһհ", "hн", "iіι", "jјϳյ", "kкκ", "lӏ", "lІ", "mм", "nпη", "nո", "oоο", "oσօ", "pрρ", "qԛզ", "rг", "sѕ", "tтτ", "uиυ", "uս", "uцυ", "vѵν", "wԝω", "wшω", "wѡա", "xхχ", "yуγ", "yү",
    "ïї", "ПΠ", "ФΦ", "ГΓ", "лλ", "фφ",
)
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])+")


@lru_cache(maxsize=4096)
def script_of(letter: str) -> str | None:
    """LATIN, CYRILLIC or GREEK; None for any other letter."""
    name = unicodedata.name(letter, "")
    return next((s for s in SCRIPTS if name.startswith(s)), None)


def _alternatives() -> dict[str, dict[str, tuple[str, ...]]]:
    out: dict[str, dict[str, dict[str, None]]] = {}
    for row in LOOK_ALIKE:
        for letter in row:
            for twin in row:
                if script_of(twin) != script_of(letter):
                    out.setdefault(letter, {}).setdefault(script_of(twin), {})[twin] = None
    return {letter: {script: tuple(twins) for script, twins in by.items()} for letter, by in out.items()}


ALTERNATIVES = _alternatives()


@lru_cache(maxsize=65536)
def options(letter: str, script: str) -> tuple[str, ...]:
    """The forms that a letter can take in a script: itself if it is of that script, else its look-alikes there."""
    if script_of(letter) in (script, None):
        return (letter,)
    out = list(ALTERNATIVES.get(letter, {}).get(script, ()))
    base = unicodedata.normalize("NFD", letter)
    if len(base) > 1:
        out += (unicodedata.normalize("NFC", bare + base[1:]) for bare in ALTERNATIVES.get(base[0], {}).get(script, ()))
    return tuple(dict.fromkeys(out))


def mixes_scripts(text: str) -> bool:
    """Whether a word of a text has letters of more than one script."""
    return any(len({s for c in word if (s := script_of(c))}) > 1 for word in WORD.findall(text))


def resolvable(text: str) -> bool:
    """Whether a text has words that mix scripts, each of which look-alikes bring into one script."""
    mixed = False
    for word in WORD.findall(text):
        found = {s for c in word if (s := script_of(c))}
        if len(found) > 1:
            if not any(all(options(c, script) for c in word) for script in found):
                return False
            mixed = True
    return mixed
