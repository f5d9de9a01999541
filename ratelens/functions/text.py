"""Review text normalisation as column expressions, in the order that gives it its meaning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Emoji and the words that stand for them.
EMOJI_WORDS = {
    "😭": "sedih", "😢": "sedih", "😔": "kecewa", "😞": "kecewa", "😟": "khawatir", "😩": "lelah",
    "😫": "lelah", "😖": "kesal", "☹️": "sedih", "🙁": "sedih", "💔": "kecewa", "😡": "marah",
    "🤬": "marah", "😤": "kesal", "😑": "kesal", "😠": "marah", "👊": "marah", "🙄": "kesal",
    "😍": "suka", "❤️": "suka", "🧡": "suka", "💛": "suka", "💚": "suka", "💙": "suka",
    "💜": "suka", "🖤": "suka", "🤍": "suka", "🤎": "suka", "😊": "senang", "😁": "senang",
    "😆": "senang", "🥰": "suka", "😘": "suka", "🙌": "senang", "🎉": "senang", "🎊": "senang",
    "✨": "bagus", "🔥": "bagus", "💯": "bagus", "👏": "bagus", "👌": "bagus", "💪": "semangat",
    "🤝": "terima_kasih", "😂": "lucu", "🤣": "lucu", "🙏": "terima_kasih", "👍": "bagus", "👎": "buruk",
    "😱": "kaget", "😨": "takut", "😰": "cemas", "😅": "canggung", "😉": "bercanda", "😜": "bercanda",
    "🤔": "bingung", "😐": "biasa_saja",
}
# Code-point ranges of other emoji, arrows, flags and the variation selector.
OTHER_EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{2190}-\\x{21FF}\\x{FE0F}]+"
URLS = "http\\S+|www\\S+"
MENTIONS = "@[\\p{L}\\p{N}_]+"
SHORT_WORDS = 3


def fold(text: Column) -> Column:
    """Null to empty, lower case, without addresses and mentions, emoji as words or blanks."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, URLS, ""), MENTIONS, "")
    worded = out
    for emoji, word in EMOJI_WORDS.items():
        worded = F.replace(worded, F.lit(emoji), F.lit(f" {word} "))
    # Most texts have none of them: one search spares the replacements.
    return F.when(out.rlike(OTHER_EMOJI), F.regexp_replace(worded, OTHER_EMOJI, " ")).otherwise(out)


def shorten(text: Column) -> Column:
    """Three or more of a character become two; line breaks are left alone."""
    return F.regexp_replace(text, "([^\\n])\\1{2,}", "$1$1")


def punctuate(text: Column) -> Column:
    """Repeated ! ? . , become one."""
    for mark in "!?.,":
        text = F.regexp_replace(text, f"[{mark}]{{2,}}", mark)
    return text


def normalise_tokens(text: Column, slang: Mapping[str, str]) -> Column:
    """Each token's core is looked up and its edges kept; tokens with inner punctuation stay."""
    if not slang:
        return text
    entries = F.create_map(*(F.lit(x) for pair in slang.items() for x in pair))
    edge, core = "[^\\p{L}\\p{N}_]*", "[\\p{L}\\p{N}_]+"
    pattern = f"^({edge})({core})({edge})$"

    def one(token: Column) -> Column:
        word = F.regexp_extract(token, pattern, 2)
        formal = F.coalesce(F.element_at(entries, word), word)
        return F.when(token.rlike(pattern), F.concat(F.regexp_extract(token, pattern, 1), formal, F.regexp_extract(token, pattern, 3))).otherwise(token)

    return F.array_join(F.transform(tokens(text), one), " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def clean(text: Column, slang: Mapping[str, str] | None = None, elongation: bool = True) -> Column:
    out = fold(text)
    if elongation:
        out = shorten(out)
    return squeeze(normalise_tokens(punctuate(out), slang or {}))


def word_count(text: Column) -> Column:
    return F.size(tokens(F.coalesce(text, F.lit("")))).cast("int")
