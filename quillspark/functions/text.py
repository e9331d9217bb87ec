"""Scalar text functions on columns."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "\n\n...[truncated]"

# English stop words.
STOP_WORDS = "a an and are as at be but by for from has have he i in is it its me my not of on or our she so that the their them they this to was we were what when which who will with you your".split()

# Emoji of smiling, laughing, loving, winking, sad and crying, and the words they become, spelled as given.
EMOJI = [
    (r"(:\s?\)|:-\)|\(\s?:|\(-:|:'\)|:O)", " positiveemoji "),
    (r"(:\s?D|:-D|x-?D|X-?D)", " positiveemoji "),
    (r"(<3|:\*)", " positiveemoji "),
    (r"(;-?\)|;-?D|\(-?;|@-\))", " positiveemoji "),
    (r"(:\s?\(|:-\(|\)\s?:|\)-:|:-/|:-\|)", " negetiveemoji "),
    (r"(:,\(|:'\(|:\"\()", " negetiveemoji "),
]


def let(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas over arrays would compute what they refer to for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def truncate(text: Column, n: int, marker: str = MARKER) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


def normalise_lines(text: Column) -> Column:
    """Strip each line and drop the blank ones."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def drop_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(stop))


def emoji_words(text: Column) -> Column:
    return functools.reduce(lambda x, rule: F.regexp_replace(x, *rule), EMOJI, text)


def clean_tweet(text: Column) -> Column:
    """Eleven steps in order: lower case; mentions dropped; links, digits and &quot; become spaces; emoticons become words;
    one-letter words dropped; punctuation becomes spaces; pairs of characters that repeat at once are written once;
    two-letter words dropped; white space becomes one space."""
    x = F.regexp_replace(F.lower(text), r"(?U)@\S+", "")
    x = F.regexp_replace(x, r"(?U)www\.\S+|https?://\S+", " ")
    x = F.regexp_replace(x, r"(?U)\d+", " ")
    x = F.replace(x, F.lit("&quot;"), F.lit(" "))
    x = emoji_words(x)
    x = F.regexp_replace(x, r"(?U)\b[a-zA-Z]\b", "")
    x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    x = F.regexp_replace(x, r"([^\n][^\n])\1+", "$1")
    x = F.regexp_replace(x, r"(?U)\b[a-zA-Z]{2}\b", "")
    return F.regexp_replace(x, r"(?U)\s+", " ")


def strip_markdown(text: Column) -> Column:
    x = F.regexp_replace(text, r"\*\*", "")
    x = F.regexp_replace(x, r"(?m)^#+ *", "")
    return F.regexp_replace(x, r"(?m)^- ", "")


def strip_thinking(text: Column) -> Column:
    """Without <think> blocks, the last of which may be unclosed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*\z", ""))


def collection_name(name: Column, prefix: str) -> Column:
    return F.left(F.replace(F.concat(F.lit(prefix), name), F.lit("-"), F.lit("_")), F.lit(63))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def first_match(text: Column, patterns: list[str], group: int = 0) -> Column:
    """What the first pattern that occurs in text captures; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def count_present(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0))


# English contractions, endings last.
CONTRACTIONS = [("won't", "will not"), ("can't", "cannot"), ("i'm", "i am"), ("let's", "let us"), ("n't", " not"), ("'re", " are"), ("'ll", " will"), ("'ve", " have"), ("'d", " would")]


def expand_contractions(text: Column) -> Column:
    """Written out; case is kept elsewhere."""
    return functools.reduce(lambda x, rule: F.regexp_replace(x, rf"(?i){'' if rule[0][0] in chr(39) + 'n' else chr(92) + 'b'}{rule[0]}\b", rule[1]), CONTRACTIONS, text)


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, question or exclamation mark before white space, or at the end."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def clauses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^.!?,;]+[.!?,;]?"), F.lit(0))


# Fixed value: zip codes of five digits, five and four, or six.
ZIP = r"\b(\d{5}(?:-\d{4})?|\d{6})\b"


def zip_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ZIP, 1), F.lit(""))


def zip_start(text: Column) -> Column:
    """Code points before the first zip code; null if there is none."""
    at = F.regexp_instr(text, F.lit(ZIP))
    return F.when(at > 0, at - 1)


def unwrap_calls(sql: Column) -> Column:
    """CONVERT_TZ(…), then COALESCE(…), each up to the first closing bracket, become their first argument: what stands before
    the first comma, or all of it where a bracket opens before that."""
    inside = r"\([^\S\n]*(?:([^,()\n]*?)[^\S\n]*,[^)\n]*|([^,()\n]*\([^)\n]*?)[^\S\n]*|([^,()\n]*?)[^\S\n]*)\)"
    return functools.reduce(lambda x, name: F.regexp_replace(x, rf"(?i){name}{inside}", "$1$2$3"), ("CONVERT_TZ", "COALESCE"), sql)


def thinking(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)(?:</think>|\z)", 1))


def slug_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def page_type(url: Column) -> Column:
    low = F.lower(url)
    # Hosts of job boards.
    kinds = [("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("workday", "workday"), ("ashbyhq.com", "ashby")]
    return functools.reduce(lambda out, k: F.when(F.contains(low, F.lit(k[0])), k[1]).otherwise(out), reversed(kinds), F.lit("auto"))


def url_glob(url: Column, pattern: str) -> Column:
    """Whether the url matches a pattern with * for any run, whatever the case."""
    import re

    return url.rlike("(?i)^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$")


def stem(word: Column) -> Column:
    """Porter stems, in Arrow batches; ask for distinct words."""
    from quillspark.functions.porter import stem_word

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem_word, na_action="ignore")

    return run(word)
