"""Text expressions: punctuation, joins, keys, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that end a sentence, and marks that may follow one.
TERMINAL = ".!?…。！？։۔؟"
CLOSING = "\"')]}»”’"
# Languages whose marks are strong evidence, languages whose marks are often
# missing, and languages without spaces between words.
STRONG_PUNCTUATION = ["en", "es", "pt", "fr", "de", "ru", "it", "nl", "pl", "ca"]
RARE_PUNCTUATION = ["zh", "ja", "th", "ko", "lo", "my", "km"]
NO_SPACES = ["zh", "ja", "th", "lo", "my", "km"]
# Abbreviations whose period doesn't end a sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "sra", "srta", "st", "vs", "etc", "approx", "no", "vol", "fig", "al",
    "ca", "cf", "eg", "ie", "jr", "inc", "ltd", "co", "abbr", "art", "cap", "pág", "núm", "bzw", "ggf", "usw",
    "bspw", "z.b", "u.a", "г", "гг", "в", "вв", "т.д", "т.е", "т.п", "т.к", "др", "пр", "ул", "д", "кв", "стр", "с",
    "рис", "табл", "см", "напр", "акад", "проф", "им", "руб", "коп", "тыс", "млн", "млрд", "обл", "р", "оз", "изд",
    "ред", "сокр", "букв",
]
# Names of languages.
LANGUAGES = {
    "en": "English", "es": "Spanish", "pt": "Portuguese", "fr": "French", "de": "German", "ru": "Russian",
    "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "it": "Italian", "nl": "Dutch", "pl": "Polish",
    "tr": "Turkish", "ar": "Arabic", "hi": "Hindi",
}
# Texts that a recogniser invents over silence.
INVENTED = [
    r"^\s*(thanks?|thank you) for watching",
    r"^\s*subtitles? (by|created|provided)",
    r"^\s*(amara\.org|subscene|opensubtitles)",
    r"^\s*please (subscribe|like and subscribe)",
    r"^\s*字幕(제작|by|志愿者)",
    r"^\s*ご視聴ありがとうございました",
    r"^\s*(редактор|корректор)\s+субтитров",
    r"^\s*субтитры\s+(сделал|подготовил|создал)",
    r"^\s*(♪|♫|\[music\]|\(music\))+\s*$",
]


def strip(c: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nonblank(c: Column) -> Column:
    """Stripped; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


_AFTER = rf"\s*[{CLOSING.replace(']', chr(92) + ']')}]*$"
_MARK = rf"(?U)[{TERMINAL}]{_AFTER}"
_PERIOD = rf"(?U)\.{_AFTER}"
_TOKEN = rf"(?U)(\S+)\s*\.{_AFTER}"


def ends_sentence(c: Column) -> Column:
    """Whether a word ends in a terminal mark, closers aside, that isn't an abbreviation's or an initial's.

    Most words are settled by the first pattern; only those that end in a period need their token.
    """
    token = F.regexp_extract(c, _TOKEN, 1)
    short = F.regexp_replace(F.lower(token), r"^[(\[{]+|[(\[{]+$", "").isin(ABBREVIATIONS)
    initial = token.rlike(r"^\p{L}$")
    return F.coalesce(F.when(~c.rlike(_MARK), False).when(~c.rlike(_PERIOD), True).otherwise(~(short | initial)), F.lit(False))


def punctuation_weight(lang: Column) -> Column:
    return F.when(lang.isin(STRONG_PUNCTUATION), 0.95).otherwise(0.85)


def separator(lang: Column) -> Column:
    """What joins words of a language."""
    return F.when(lang.isin(NO_SPACES), "").otherwise(" ")


def language_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


# Fixed value: whose models short names mean.
MODEL_PREFIX = "openai/whisper-"


def model_id(name: Column) -> Column:
    return F.when(name.contains("/"), name).otherwise(F.concat(F.lit(MODEL_PREFIX), name))


def invented(c: Column) -> Column:
    """Whether a run's text matches one of the patterns."""
    found = F.lit(False)
    for pattern in INVENTED:
        found = found | c.rlike(f"(?iu){pattern}")
    return found


def clip_key(text: Column, voice: Column, lang: Column) -> Column:
    """Content key of a synthesised clip; speed isn't part of it."""
    return F.substring(F.sha2(F.concat(lang, F.lit("\0"), voice, F.lit("\0"), text).cast("binary"), 256), 1, 16)


def reply_object(raw: Column) -> Column:
    """The JSON object of a model's reply as VARIANT: all of it, or what stands between the outer braces; else null."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))))


def readable(message: Column, kind: Column, most: int = 2000) -> Column:
    """An error for display: its class where it is blank, cut where it is long."""
    text = F.coalesce(nonblank(message), kind)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def safe_name(title: Column) -> Column:
    return F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")


def lyric_line(at: Column, label: Column) -> Column:
    """``[mm:ss.ff]text`` on one line; half a hundredth, in decimal digits, rounds up."""
    minute = F.floor(at / 60).cast("int")
    return F.concat(F.format_string("[%02d:%05.2f]", minute, at - F.floor(at / 60) * 60), strip(F.replace(label, F.lit("\n"), F.lit(" "))))


def tempo_chain(speed: float) -> list[float]:
    """Factors between 0.5 and 2 whose product is the speed."""
    if speed <= 0:
        raise ValueError("speed must be positive")
    factors = []
    while not 0.5 <= speed <= 2.0:
        step = 2.0 if speed > 2.0 else 0.5
        factors.append(step)
        speed /= step
    return [*factors, speed]
