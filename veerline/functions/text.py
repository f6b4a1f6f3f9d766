"""Text cleaning as Column -> Column expressions (all JVM-side, no Python UDF).

The order of the steps in ``clean_text`` is part of its meaning: lexicon words are removed before
mentions and URLs, entities are decoded after the strip, so blanks may come back at the ends.
Every step also works on a streaming DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# These must equal the behaviour being reproduced, so they are stated as-is.
# Mention pattern (ASCII word characters only).
MENTION_PATTERN = r"@[a-zA-Z0-9_]+"
# URL pattern. Inside the class, "+-…" is a range from U+002B to U+2026: it takes ASCII letters,
# digits and most alphabets, and stops at blanks, ! " ' * and CJK / kana.
URL_PATTERN = r"https?://[w/:%#$&?()~.=+-…]+"
# Hashtag: '#' and a run of Unicode word characters (letters, numbers, underscore; no marks).
HASHTAG_PATTERN = r"#([\p{L}\p{N}_]+)"
# Retweet marker, removed anywhere (also inside words such as "START ").
RT_MARKER = "RT "
# HTML entities, decoded in this order (so "&amp;lt;" becomes "<"), then U+3000 becomes a blank.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "))
IDEOGRAPHIC_SPACE = "　"
# The code points that Python's str.strip() removes (as a set, and as a regex class for SQL engines).
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
STRIP_CLASS = r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Emoji code points (Unicode emoji data, Emoji=Yes without the keycap bases # * 0-9).
EMOJI_BASE_RANGES = (
    "\\x{a9}\\x{ae}\\x{203c}\\x{2049}\\x{2122}\\x{2139}\\x{2194}-\\x{2199}\\x{21a9}\\x{21aa}"
    "\\x{231a}\\x{231b}\\x{2328}\\x{23cf}\\x{23e9}-\\x{23f3}\\x{23f8}-\\x{23fa}\\x{24c2}"
    "\\x{25aa}\\x{25ab}\\x{25b6}\\x{25c0}\\x{25fb}-\\x{25fe}\\x{2600}-\\x{2604}\\x{260e}\\x{2611}"
    "\\x{2614}\\x{2615}\\x{2618}\\x{261d}\\x{2620}\\x{2622}\\x{2623}\\x{2626}\\x{262a}\\x{262e}\\x{262f}"
    "\\x{2638}-\\x{263a}\\x{2640}\\x{2642}\\x{2648}-\\x{2653}\\x{265f}\\x{2660}\\x{2663}\\x{2665}"
    "\\x{2666}\\x{2668}\\x{267b}\\x{267e}\\x{267f}\\x{2692}-\\x{2697}\\x{2699}\\x{269b}\\x{269c}"
    "\\x{26a0}\\x{26a1}\\x{26a7}\\x{26aa}\\x{26ab}\\x{26b0}\\x{26b1}\\x{26bd}\\x{26be}\\x{26c4}\\x{26c5}"
    "\\x{26c8}\\x{26ce}\\x{26cf}\\x{26d1}\\x{26d3}\\x{26d4}\\x{26e9}\\x{26ea}\\x{26f0}-\\x{26f5}"
    "\\x{26f7}-\\x{26fa}\\x{26fd}\\x{2702}\\x{2705}\\x{2708}-\\x{270d}\\x{270f}\\x{2712}\\x{2714}"
    "\\x{2716}\\x{271d}\\x{2721}\\x{2728}\\x{2733}\\x{2734}\\x{2744}\\x{2747}\\x{274c}\\x{274e}"
    "\\x{2753}-\\x{2755}\\x{2757}\\x{2763}\\x{2764}\\x{2795}-\\x{2797}\\x{27a1}\\x{27b0}\\x{27bf}"
    "\\x{2934}\\x{2935}\\x{2b05}-\\x{2b07}\\x{2b1b}\\x{2b1c}\\x{2b50}\\x{2b55}\\x{3030}\\x{303d}"
    "\\x{3297}\\x{3299}\\x{1f004}\\x{1f0cf}\\x{1f170}\\x{1f171}\\x{1f17e}\\x{1f17f}\\x{1f18e}"
    "\\x{1f191}-\\x{1f19a}\\x{1f201}\\x{1f202}\\x{1f21a}\\x{1f22f}\\x{1f232}-\\x{1f23a}\\x{1f250}"
    "\\x{1f251}\\x{1f300}-\\x{1f321}\\x{1f324}-\\x{1f393}\\x{1f396}\\x{1f397}\\x{1f399}-\\x{1f39b}"
    "\\x{1f39e}-\\x{1f3f0}\\x{1f3f3}-\\x{1f3f5}\\x{1f3f7}-\\x{1f4fd}\\x{1f4ff}-\\x{1f53d}"
    "\\x{1f549}-\\x{1f54e}\\x{1f550}-\\x{1f567}\\x{1f56f}\\x{1f570}\\x{1f573}-\\x{1f57a}\\x{1f587}"
    "\\x{1f58a}-\\x{1f58d}\\x{1f590}\\x{1f595}\\x{1f596}\\x{1f5a4}\\x{1f5a5}\\x{1f5a8}\\x{1f5b1}"
    "\\x{1f5b2}\\x{1f5bc}\\x{1f5c2}-\\x{1f5c4}\\x{1f5d1}-\\x{1f5d3}\\x{1f5dc}-\\x{1f5de}\\x{1f5e1}"
    "\\x{1f5e3}\\x{1f5e8}\\x{1f5ef}\\x{1f5f3}\\x{1f5fa}-\\x{1f64f}\\x{1f680}-\\x{1f6c5}"
    "\\x{1f6cb}-\\x{1f6d2}\\x{1f6d5}-\\x{1f6d7}\\x{1f6dc}-\\x{1f6e5}\\x{1f6e9}\\x{1f6eb}\\x{1f6ec}"
    "\\x{1f6f0}\\x{1f6f3}-\\x{1f6fc}\\x{1f7e0}-\\x{1f7eb}\\x{1f7f0}\\x{1f90c}-\\x{1f93a}"
    "\\x{1f93c}-\\x{1f945}\\x{1f947}-\\x{1f9ff}\\x{1fa70}-\\x{1fa7c}\\x{1fa80}-\\x{1fa88}"
    "\\x{1fa90}-\\x{1fabd}\\x{1fabf}-\\x{1fac5}\\x{1face}-\\x{1fadb}\\x{1fae0}-\\x{1fae8}"
    "\\x{1faf0}-\\x{1faf8}"
)
# ---------------------------------------------------------------------------------------------

_MOD = r"(?:\x{fe0f}|[\x{1f3fb}-\x{1f3ff}])*"
_ELEM = f"[{EMOJI_BASE_RANGES}]{_MOD}"
# Keycaps, flag pairs, and base emoji with variation selector / skin tone, joined by ZWJ, with tags.
EMOJI_PATTERN = (r"[#*0-9]\x{fe0f}?\x{20e3}|[\x{1f1e6}-\x{1f1ff}]{2}|"
                 f"{_ELEM}(?:\\x{{200d}}{_ELEM})*[\\x{{e0020}}-\\x{{e007f}}]*")
STRIP_PATTERN = rf"\A[{STRIP_CLASS}]+|[{STRIP_CLASS}]+\z"
# Every emoji match contains one of these code points; texts without any skip the full pattern.
EMOJI_HINT = r"[\x{a9}\x{ae}\x{203c}-\x{3299}\x{1f000}-\x{1faff}\x{e0020}-\x{e007f}]"
# Same matches as EMOJI_PATTERN; one leading lookahead on a 6-range class lets Java reject almost
# every position with a single test (RE2 has no lookahead, so SQL engines use EMOJI_PATTERN).
EMOJI_PATTERN_GUARDED = (r"(?=[#*0-9\x{a9}\x{ae}\x{203c}-\x{3299}\x{1f000}-\x{1faff}])(?:" + EMOJI_PATTERN + ")")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_words(text: Column | str, words: Sequence[str]) -> Column:
    """Remove each word everywhere, one word after another in list order.

    A removal can create or destroy a later word's match, so this is a left fold over a literal
    array (one expression, no deep nesting), not one alternation regex. Each step scans the text,
    so the fold is gated: removals only delete characters, hence a word can match at any point
    only if its first character occurs in the original text. One hashed ``translate`` pass tells
    whether any first character occurs; if none does, the text is returned as is (exact)."""
    words = [w for w in words if w]
    if not words:
        return _c(text)
    t = _c(text)
    lits = F.array(*[F.lit(w) for w in words])
    fold = F.aggregate(lits, t, lambda acc, w: F.replace(acc, w, F.lit("")))
    firsts = "".join(sorted({w[0] for w in words}))
    may_match = F.length(F.translate(t, firsts, "")) < F.length(t)
    return F.when(may_match, fold).otherwise(t)


def remove_mentions(text: Column | str) -> Column:
    """C2."""
    return F.regexp_replace(_c(text), MENTION_PATTERN, "")


def remove_urls(text: Column | str) -> Column:
    """C3."""
    return F.regexp_replace(_c(text), URL_PATTERN, "")


def remove_hashtags(text: Column | str) -> Column:
    """C4."""
    return F.regexp_replace(_c(text), HASHTAG_PATTERN, "")


def remove_rt_marker(text: Column | str) -> Column:
    """C5."""
    return F.replace(_c(text), F.lit(RT_MARKER), F.lit(""))


def remove_emoji(text: Column | str) -> Column:
    """Emoji sequences (keycaps, flags, ZWJ chains with modifiers and tags).

    The full pattern is costly per character, so it only runs on texts that hold a code point of
    the (cheap, 4-range) superset class."""
    t = _c(text)
    return F.when(t.rlike(EMOJI_HINT), F.regexp_replace(t, EMOJI_PATTERN_GUARDED, "")).otherwise(t)


def collapse_newlines(text: Column | str) -> Column:
    """C7."""
    return F.regexp_replace(_c(text), r"\n+", "\n")


def unicode_strip(text: Column | str) -> Column:
    """Strip the same code points as Python's str.strip() (SQL trim strips blanks only).

    ``trim`` with a character set touches only the ends of the text (no regex scan)."""
    return F.trim(_c(text), F.lit(STRIP_CHARS))


def decode_entities(text: Column | str) -> Column:
    """The five entities in order, then U+3000 to a blank."""
    out = _c(text)
    for src, dst in ENTITIES:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.replace(out, F.lit(IDEOGRAPHIC_SPACE), F.lit(" "))


def clean_text(text: Column | str, lexicon: Sequence[str] = ()) -> Column:
    """C1..C9 in order. A null text is treated as empty."""
    out = remove_words(F.coalesce(_c(text), F.lit("")), lexicon)
    for step in (remove_mentions, remove_urls, remove_hashtags, remove_rt_marker, remove_emoji,
                 collapse_newlines, unicode_strip, decode_entities):
        out = step(out)
    return out


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    """True when the text contains any of the words (case-sensitive substring)."""
    if not words:
        return F.lit(False)
    t = _c(text)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))


def first_keyword(text: Column | str, words: Sequence[str]) -> Column:
    """The first word of the list (list order) contained in the text, else null."""
    t = _c(text)
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)), 0)


def words_regex(words: Sequence[str]) -> str:
    """An alternation that matches any of the words literally."""
    return "|".join(re.escape(w) for w in words)


def matches_any_regex(text: Column | str, words: Sequence[str]) -> Column:
    """P3 test: the text contains one of the words (one regex over the alternation)."""
    if not words:
        return F.lit(False)
    return _c(text).rlike(words_regex(words))


def parse_abbrev_count(x: Column | str) -> Column:
    """P1: '1.2K' -> 1200, '3M' -> 3000000, '57' -> 57.

    'K' anywhere -> drop the last character, read as double, times 1000, truncate; same for 'M'
    with 1e6; otherwise read as an integer. The product is a double, as in the original
    (so '32.3K' -> 32299). Numeric columns work too (57.0 -> 57)."""
    s = _c(x).cast("string")
    body =F.substring(s, F.lit(1), F.length(s) - 1)
    return (F.when(s.contains("K"), (body.cast("double") * F.lit(1000.0)).cast("long"))
            .when(s.contains("M"), (body.cast("double") * F.lit(1000000.0)).cast("long"))
            .otherwise(F.coalesce(s.try_cast("long"), s.cast("double").cast("long"))))


def normalise_handle(handle: Column | str) -> Column:
    """Remove every '@'."""
    return F.replace(_c(handle), F.lit("@"), F.lit(""))


def account_from_path(path: Column | str) -> Column:
    """Base name of a path up to its first dot ('.../alice.csv' -> 'alice')."""
    return F.substring_index(F.substring_index(_c(path), "/", -1), ".", 1)
