"""Text cleaning as Column expressions. No Python runs per row: every function here
compiles to built-in string and array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodframe.functions.lexicon import (
    EMOTICON_WORDS,
    SENTIMENT_STOP_WORDS,
    post_cleaner_drops,
)

# Patterns. Written so that Java and RE2 read them alike.
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACES.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]{2,}"
CLOUD_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
PUNCTUATION = r"!-/:-@\[\]^_`{|}~"  # the backslash stays
ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
ASCII_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OTHER_SPACES = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
DELETED = "0123456789!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"  # the same, digits too, one by one
HARD_SPLITS = r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na(?:\s|$)))"
URL_LOWER = r"http://[^ ]*|https://[^ ]*| www\.[^ ]*"
TWEET_URL = r"(?i)(?:https?://|www\.)[^\s]+"
TWEET_MENTION = r"@[\p{L}\p{N}_]*"
TWEET_HASHTAG = r"#[\p{L}\p{N}_]*"
TWEET_RESERVED = r"(?<![A-Za-z0-9_])(?:RT|FAV)(?![A-Za-z0-9_])"
TWEET_EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}]+"
)
TWEET_SMILEY = r"(?i)(?:\s?:X|:|;|=)-?(?:\)+|\(|O|D|P|S|\\|/\s)+"
TWEET_NUMBER = r"(?:^|\s)-?\d+(?:[.,]?\d+)*"

_FIXED_MAP_LIMIT = 1000


def squeeze_spaces(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed. A character map first makes
    all white space plain, so that only real runs are matched."""
    others = ASCII_SPACES.rstrip(" ") + OTHER_SPACES
    return F.trim(F.regexp_replace(F.translate(text, others, " " * len(others)), " {2,}", " "))


def letters_only(text: Column) -> Column:
    """Everything but ASCII letters and digits becomes a space."""
    signs = "".join(map(chr, range(32))) + ASCII_SIGNS + "\x7f"
    return F.translate(F.regexp_replace(text, r"[^\x00-\x7F]+", " "), signs, " " * len(signs))


def squeeze_repeats(text: Column) -> Column:
    """Three or more equal characters in a row become two."""
    return F.regexp_replace(text, r"([^\n])\1\1+", "$1$1")


def clean_collected_post(text: Column) -> Column:
    """Mentions, other signs and URLs become spaces, then spaces are squeezed. A URL is only
    looked for where a word starts, and only in texts that have one."""
    url = r"(?<![0-9A-Za-z])[0-9A-Za-z][\p{L}\p{N}_]*+://" + NOT_SPACE + "+"
    marks = F.regexp_replace(text, "@[A-Za-z0-9]+|" + url, " ")
    gone = F.when(text.contains("://") | text.contains("@"), marks).otherwise(text)
    return F.trim(F.regexp_replace(letters_only(gone), " {2,}", " "))


def tweet_preclean(
    text: Column,
    urls: bool = True,
    mentions: bool = True,
    hashtags: bool = True,
    reserved: bool = True,
    emojis: bool = True,
    smileys: bool = True,
    numbers: bool = True,
) -> Column:
    """Removes the tweet-specific pieces; each class is a switch."""
    steps = [
        (urls, TWEET_URL),
        (hashtags, TWEET_HASHTAG),
        (mentions, TWEET_MENTION),
        (reserved, TWEET_RESERVED),
        (emojis, TWEET_EMOJI),
        (smileys, TWEET_SMILEY),
        (numbers, TWEET_NUMBER),
    ]
    patterns = [pattern for wanted, pattern in steps if wanted]
    return squeeze_spaces(reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, text))


def replace_emoticons(
    text: Column, words: dict[str, str] | None = None, fold_keys: bool = False
) -> Column:
    """Literal replaces in dictionary order. With ``fold_keys`` the upper-case keys,
    which can never match lower-cased text, are lower-cased first."""
    table = EMOTICON_WORDS if words is None else words
    pairs = [(k.lower() if fold_keys else k, v) for k, v in table.items()]
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


def bare_text(text: Column, non_ascii_to_space: bool = False) -> Column:
    """Lower-cased text without non-ASCII characters, digits and punctuation; white space is
    plain spaces. Deleting characters one class after the other gives the same text, so the
    ASCII classes go in one character map."""
    ascii_only = F.regexp_replace(F.lower(text), r"[^\x00-\x7F]+", " " if non_ascii_to_space else "")
    return F.translate(ascii_only, ASCII_SPACES + DELETED, " " * len(ASCII_SPACES))


def treebank_words(text: Column) -> Column:
    """Token list of bare text: white space plus the fixed word splits."""
    return F.filter(F.split(F.regexp_replace(text, HARD_SPLITS, "$1 "), " ", -1), lambda w: w != "")


def with_lemmas(words: Column, lemmas: dict[str, str] | None) -> Column:
    """Maps tokens through a small fixed dictionary. Larger dictionaries are tables:
    see ``operators.lemmas``."""
    if not lemmas:
        return words
    if len(lemmas) > _FIXED_MAP_LIMIT:
        raise ValueError("dictionary too large for an expression: use operators.lemmas")
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def post_words(text: Column, stop_words=None, non_ascii_to_space: bool = False) -> Column:
    """Kept tokens of a post before lemmas."""
    drops = post_cleaner_drops(stop_words)
    spaced = F.regexp_replace(bare_text(text, non_ascii_to_space), HARD_SPLITS, "$1 ")
    return F.filter(F.split(spaced, " ", -1), lambda w: (F.length(w) > 1) & ~w.isin(drops))


def clean_post(
    text: Column,
    stop_words=None,
    lemmas: dict[str, str] | None = None,
    non_ascii_to_space: bool = False,
) -> Column:
    """Cleaned post text: kept tokens joined by spaces."""
    words = post_words(text, stop_words, non_ascii_to_space)
    return F.array_join(with_lemmas(words, lemmas), " ")


def sentiment_words(
    text: Column, drop_stopwords: bool = False, fold_keys: bool = False
) -> Column:
    """Kept tokens of the sentiment cleaner before lemmas."""
    no_urls = F.regexp_replace(F.lower(text), URL_LOWER, "")
    spoken = replace_emoticons(no_urls, fold_keys=fold_keys)
    no_users = F.regexp_replace(spoken, "@" + NOT_SPACE + "+", "")
    plain = squeeze_repeats(letters_only(no_users))
    words = F.filter(F.split(plain, " ", -1), lambda w: F.length(w) > 1)
    if drop_stopwords:
        words = F.filter(words, lambda w: ~w.isin(SENTIMENT_STOP_WORDS))
    return words


def sentiment_clean(
    text: Column,
    drop_stopwords: bool = False,
    lemmas: dict[str, str] | None = None,
    fold_keys: bool = False,
) -> Column:
    """Sentiment-model text: every kept word followed by one space."""
    words = with_lemmas(sentiment_words(text, drop_stopwords, fold_keys), lemmas)
    return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "))), "")


def vector_words(text: Column) -> Column:
    """Lower-cased words of two or more word characters, as the vectorisers read them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def cloud_words(text: Column, stop_words=()) -> Column:
    """Words for frequency tables: possessives cut, digit-only words out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(CLOUD_WORD), F.lit(0))
    cut = F.transform(found, lambda w: F.when(w.endswith("'s"), F.left(w, F.length(w) - 2)).otherwise(w))
    # Most words start with a plain letter: only the others need the pattern.
    kept = F.filter(cut, lambda w: F.left(w, F.lit(1)).between("a", "z") | ~w.rlike(r"^\p{Nd}+$"))
    drops = sorted({w.lower() for w in stop_words})
    return F.filter(kept, lambda w: ~w.isin(drops)) if drops else kept


def text_length(text: Column) -> Column:
    return F.length(text)


def not_blank(text: Column) -> Column:
    """True for text with at least one visible character; null stays null."""
    return text.rlike(NOT_SPACE)


def hash_number(key: Column, seed: int = 42) -> Column:
    """First 8 hex digits of md5(seed|key) as a number: the same on every engine,
    run and partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
