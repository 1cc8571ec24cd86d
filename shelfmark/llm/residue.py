"""Template residue and error-page text.

Unfilled slots are found by one grammar per kind of delimiter. A slot counts unless its surroundings show that the text
talks about slots: code blocks, code spans and indented code are cut out first; a sentence that speaks of templates,
patterns, configuration and the like discounts the slots in it, and so does one that mentions a slot instead of using it:
right after a verb of writing in the present or the imperative, or quoted and followed by a quoted filling. Filler, error messages and script notices count by density: the
share of a text, page furniture aside, that consists of sentences which are nothing but such messages. A sentence that
quotes or mentions one does not open with it and so is prose. Everything is done by built-in expressions, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammars of unfilled slots, by delimiter.
NAME = r"[\p{L}_][\p{L}\p{N}_.-]*+"
SLOTS = {
    "double braces": rf"\{{\{{\s*{NAME}\s*\}}\}}",
    "brace and percent": rf"\{{%\s*{NAME}\s*%\}}",
    "dollar and braces": rf"\$\{{\s*{NAME}\s*\}}",
    "braces and dollar": rf"\{{\$\s*{NAME}\s*\}}",
    "hash and braces": rf"#\{{\s*{NAME}\s*\}}",
    "braces": r"(?<![{$#%\p{L}\p{N}])\{[\p{L}_][\p{L}\p{N}_]++\}(?!\})",
    "numbered braces": r"(?<!\{)\{[0-9]{1,2}\}(?!\})",
    "angle and percent": rf"<%=?\s*{NAME}\s*%>",
    "double angles": rf"<<\s*{NAME}\s*>>",
    "angles": r"(?<!<)<(?!/?(?:unk|pad|mask|cls|sep|bos|eos|[a-z]|br|hr|div|span|img|pre|code|html|head|body|title|table|noscript|script|style|strong|em|ul|ol|li|td|tr|th|sub|sup|angle)>)[a-z][a-z_]{2,}+>(?!>)",
    "double brackets": rf"\[\[\s*{NAME}\s*\]\]",
    "capitals in brackets": r"(?<!\[)\[(?!EP\]|LP\]|CD\]|DVD\]|OST\])[A-Z][A-Z_]{2,}+\](?!\])",
    "order in brackets": r"(?i:\[(?:insert|enter|add|your|type)\s[^\[\]\n]++\])",
    "your in parentheses": r"(?i:\(your\s[a-z]+(?:\s[a-z]+)?\))",
    "percent signs": r"(?<![%\p{L}\p{N}])%[A-Za-z][A-Za-z_]{2,}+%(?![\p{L}\p{N}])",
    "percent and parentheses": r"%\([A-Za-z_]++\)[sdfr]",
    "double underscores": r"(?<![\p{L}\p{N}_])__[A-Z]++(?:_[A-Z]++)*+__(?![\p{L}\p{N}_])",
    "double at signs": r"@@[A-Za-z_]{2,}+@@",
    "stars and bars": r"\*\|[A-Za-z_:]{2,}+\|\*",
    "tildes": r"(?<![~\p{L}\p{N}])~[a-z][a-z_]{2,}+~(?![~\p{L}\p{N}])",
    "colons": r"(?<![:\p{L}\p{N}]):[a-z]{2,}+(?:_[a-z]++)?:(?![:\p{L}\p{N}])",
    "to do": r"(?<![\p{L}\p{N}])TODO:\s?[a-z_]{2,}+",
    "crosses": r"(?<![\p{L}\p{N}])X{4,}+(?![\p{L}\p{N}])",
    "blank": r"(?<=[^\s_-])[ ]?_{4,}(?!_)|(?<!_)_{4,}(?=[ ]?[^\s_-])",
    "undefined": r"(?<!(?:left|is|was|are|were|remains?|an|the|or|mean|means|[\"'“]) )(?<![\p{L}\p{N}\"'“_.])undefined(?![\p{L}\p{N}\"'”_])(?! (?:behaviou?r|values?|variables?|index|symbols?|names?|references?|functions?|terms?|quantit|period))",
}
#: What every grammar needs somewhere: texts without it, which are most, are not searched further.
MAY_HOLD_SLOT = r"[{<%@~\[]|__|\*\||\([yY][oO]|:[a-z]{2}|TODO|XXXX|undefined"

# Words by which a sentence tells that it speaks about slots.
ABOUT_SLOTS = (
    r"(?iu)(?<![\p{L}\p{N}])(?:slots?|templates?|placeholders?|patterns?|syntax|variables?|percent signs?|brackets?|braces|config(?:uration)?(?: file)?"
    r"|expand(?:s|ed)?|shell|escap(?:e|ed|ing)|regex|macros?|shortcodes?|merge tags?)(?![\p{L}\p{N}])"
)
# Verbs that show a slot instead of using it, and words that may stand between.
SHOWING = r"(?iu:(?<![\p{L}\p{N}])(?:writ(?:e|es|ten|ing)|reads|leaves?|types?|prints?|renders?|spells?|inserts?)(?:\s(?:out|as|also|just|simply|only|the|a))?[\s:]{1,2}[\"“'‘`]?)"
QUOTED = r"[\"“][^\"“”\n]*+[\"”][^\"“”\n]++[\"“][^\"“”\n]++[\"”]"

# What filler, error messages and script notices open with, lower case. {end} is the end of a clause.
END = r"(?=\s*(?:$|[.!:;,\-–—(\n]))"
FILLER = (
    r"lorem ipsum(?=\s+\p{L}+)",
    r"(?:your|sample|dummy|placeholder) (?:text|copy|biography|review|title|description|content)(?: goes)? here",
    r"(?:replace|delete) (?:it|this)(?: text)? before you publish",
    r"this is (?:dummy|sample|placeholder|filler) (?:copy|text|content)",
    r"the real (?:text|copy|content) will follow",
    r"hier steht (?:später|bald) (?:der|ein) text",
    r"(?:das ist ein )?blindtext",
    r"aquí va el texto|texto de (?:ejemplo|relleno)",
    r"ici (?:viendra|votre) (?:le )?texte|texte (?:factice|d'exemple)",
    r"(?:test[\s.,!]+){2,}(?:test)?" + END,
    r"(?:text|content|biography|review) (?:coming soon|to follow|to come)",
)
ERRORS = (
    r"(?:oops|sorry|whoops|ups)?[!,.:\s]*(?:we can['’]t find|could not find|cannot find) the page",
    r"\(?(?:http )?(?:error|fehler|erreur|ошибка)[ :]*[1-5][0-9]{2}(?:\.[0-9]+)?\)?" + END,
    r"(?:http )?(?:error )?[45][0-9]{2}[\s:–—-]+(?:not found|internal server error|bad gateway|service unavailable|service temporarily unavailable|forbidden|unauthorized|gateway timeout|too many requests|bad request|gone)" + END,
    r"(?:http error|error) [45][0-9]{2}\.[0-9]+",
    r"(?:the )?page (?:you asked for )?(?:was )?not found" + END,
    r"die (?:angeforderte )?seite wurde nicht gefunden",
    r"p[aá]gina no encontrada" + END,
    r"(?:el|la|este|esta) (?:enlace|página|archivo|contenido|dirección)(?: \p{L}{1,20}){0,5} no (?:existe|está disponible|se encuentra)",
    r"page (?:introuvable|non trouvée)" + END,
    r"une erreur (?:interne )?est survenue",
    r"страница не найдена" + END,
    r"ページが見つかりません",
    r"traceback \(most recent call last\)",
    r"file \"[^\"\n]{1,120}\", line [0-9]+",
    r"[a-z]*(?:error|exception): ['\"\p{L}]",
    r"(?:[a-z]+\.)+[a-z]*(?:exception|error)" + END,
    r"at [\p{L}\p{N}_$.]+\([\p{L}\p{N}_]+\.(?:java|js|py|kt|scala):[0-9]+\)",
    r"(?:fatal error|warning|notice|parse error): (?:[a-z_]+\([^()\n]{0,80}\):|call to|undefined|failed)",
    r"(?:fatal |unhandled |uncaught )?(?:error|err|exception) (?:in|at|while \p{L}+) \S{1,80}:",
    r"(?:(?:we are |we['’]re )?sorry|uh-oh|hmm|oops|whoops|ups)[,.!… ]*(?:the|this|that|your) [\p{L} -]{1,30}? (?:is missing|is gone|no longer exists|does(?: not|n['’]t) exist|could not be (?:loaded|found|opened|shown)|failed to (?:open|load)|was not found|cannot be (?:loaded|found|shown))",
    r"the (?:address|url|requested url|file) \S{1,200} (?:does not exist|was not found)",
    r"(?:\p{L}{1,12}(?: \p{L}{1,12})? (?:and|or) )?(?:retry|reload|refresh|search again|try again)(?: (?:the page|in [0-9]{1,6} (?:seconds?|minutes?)|later|now))?" + END,
    r"\{\s*\"(?:status|error|code)\"\s*:\s*(?:[0-9]{3}|\"[^\"\n]{0,80}\"|true)",
    r"could not connect to (?:the )?(?:database|server)",
    r"connection (?:refused|reset|timed out)" + END,
    r"(?:the )?request timed out",
    r"something (?:broke|went wrong)",
    r"too many requests" + END,
    r"access denied" + END,
    r"you (?:don['’]t|do not) have permission",
    r"your session has expired",
    r"please log in(?: again)? to",
    r"this (?:content|page|video|site) is (?:not available|unavailable|no longer available)",
    r"(?:proxy|nginx(?:/[0-9.]+)?|apache(?:/[0-9.]+)?|-{3,})$",
    r"reference (?:number )?[0-9]{4,}",
    r"r[ée]essayez plus tard|(?:please )?try again later",
)
SCRIPTS = (
    r"(?:please )?(?:enable|activate|turn on|switch on|allow) (?:javascript|scripts?|js|cookies)(?= |$|[.!])(?! (?:off|is|was|and then))",
    r"(?:javascript|scripts?|js) (?:is|are|has been|must be|seems to be) (?:disabled|required|needed|turned off|switched off|blocked|enabled)",
    r"(?:we['’]re|we are) sorry,? but .{1,60} without (?:javascript|scripts?|js)",
    r"you (?:need|have) to (?:turn on|enable|switch on|activate|allow) (?:javascript|scripts?|js)",
    r"your browser (?:does not|doesn['’]t) support",
    r"(?:this|our|the) [\p{L}\p{N} -]{1,40}? (?:requires?|needs?|relies on|depends on|will not (?:start|work|load) without|won['’]t (?:start|work|load) without|works only with|does(?: not|n['’]t) work (?:properly )?without) (?:javascript|scripts?|js|cookies)(?![\p{L}\p{N}])",
    r"checking your browser before",
    r"this needs (?:cookies|scripts|javascript)",
    r"some parts of .{1,60} without it",
    r"how to (?:enable|turn on) it",
    r"loading(?:…|\.\.\.)?$",
    r"bitte (?:aktivieren|erlauben) sie (?:javascript|scripts?)",
    r"veuillez activer (?:le )?(?:javascript|les scripts)",
    r"este sitio (?:requiere|necesita) (?:javascript|scripts)",
    r"(?:\p{L}{1,20}lo y )?recarg(?:a|ue|ar) la página",
    r"(?:пожалуйста, )?включите (?:javascript|скрипты)",
    r".{0,30}スクリプトを有効に",
)
# Page furniture, which is no content either way.
FURNITURE = (
    r"(?:«|»|‹|›|<|←|→)\s?.{0,40}",
    r"©.{0,80}",
    r"[^.!?|\n]{1,24}(?:\s*\|\s*[^.!?|\n]{1,24}){1,8}",
    r"[^.!?·\n]{1,24}(?:\s+·\s+[^.!?·\n]{1,24}){1,8}",
    r"\S{1,16}(?: \S{1,16})?(?: {2,}\S{1,16}(?: \S{1,16})?){1,8}",
)
CODE = r"(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)|(?m)^(?: {4}|\t).*$|(?<!`)`[^`\n]++`(?!`)"
WRAPPER = r"^\s*(?:<noscript>|<p>|<h1>|\*+|#+|>+)?\s*"


@dataclass(frozen=True)
class ResidueOptions:
    """density: the least share of a text that messages and filler must fill, page furniture not counted."""

    density: float = 0.7


def sentences(text: Column) -> Column:
    """The lines of a text, cut into sentences where one ends and a capital, a quote or a symbol begins the next."""
    marked = F.regexp_replace(text, r"(?<!e\.g\.|i\.e\.|z\.B\.)(?<=[.!?…。])[ \t\x{a0}]+(?=[^\p{Ll}])|(?<=[。！？])", "\n")
    return F.filter(F.split(marked, r"[\r\n\x{2028}\x{2029}]+"), lambda s: ~s.rlike(r"^[\s\p{Z}\p{Cf}]*$"))


def slots(text: Column) -> Column:
    """The unfilled slots of a text: those in a sentence that neither speaks about slots nor shows them, outside code."""
    prose = F.regexp_replace(text, CODE, "\n")
    grammar = "|".join(f"(?:{g})" for g in SLOTS.values())
    silent = F.filter(sentences(prose), lambda s: ~s.rlike(ABOUT_SLOTS) & ~s.rlike(f"{SHOWING}(?:{grammar})") & ~(s.rlike(QUOTED) & s.rlike(f"[\"“](?:{grammar})")))
    found = F.flatten(F.transform(silent, lambda s: F.regexp_extract_all(s, F.lit(grammar), F.lit(0))))
    return F.when(text.rlike(MAY_HOLD_SLOT), found).when(text.isNotNull(), F.array().cast("array<string>"))


def message_share(text: Column) -> Column:
    """The share of a text, page furniture aside, in sentences that are filler, an error message or a script notice."""
    lowered = F.lower(text)
    opening = rf"(?iu){WRAPPER}(?:{'|'.join((*FILLER, *ERRORS, *SCRIPTS))})"
    furniture = rf"^\s*(?:{'|'.join(FURNITURE)})\s*$"

    def weigh(total: Column, s: Column) -> Column:
        n = F.length(F.trim(s)).cast("double")
        message = s.rlike(opening)
        return F.when(message, F.struct((total["a"] + n).alias("a"), (total["b"] + n).alias("b"))).when(s.rlike(furniture), total).otherwise(F.struct(total["a"].alias("a"), (total["b"] + n).alias("b")))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(sentences(lowered), zero, weigh, lambda total: F.try_divide(total["a"], total["b"]))


def flag_residue(df: DataFrame, text: str, options: ResidueOptions = ResidueOptions()) -> DataFrame:
    """Add n_slots (int), message_share (double) and is_residue (boolean) to every row.

    A null text has no slots, a null share and is no residue; so is an empty or blank one. Rows are neither dropped nor
    repeated, whole texts are read, and columns of the same names in `df` raise ValueError.
    """
    for name in ("n_slots", "message_share", "is_residue"):
        if name in df.columns:
            raise ValueError(f"the table already has a column {name!r}")
    flagged = df.withColumns({"n_slots": F.coalesce(F.size(slots(F.col(text))), F.lit(0)), "message_share": message_share(F.col(text))})
    flagged = flagged.withColumn("n_slots", F.greatest("n_slots", F.lit(0)))
    return flagged.withColumn("is_residue", (F.col("n_slots") > 0) | F.coalesce(F.col("message_share") >= options.density, F.lit(False)))
