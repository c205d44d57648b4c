"""Normalisation, tokens, consonant skeletons, n-grams and title keys as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that join two parts of a word, the skeleton of each Hebrew letter, and the letter folds in their order.
JOIN_MARKS = "['’‘`´\"׳״]"
HEBREW = "בגדזחטכךלמםנןספףצץקרשת"
HEBREW_SKELETON = "bgdzktkklmmnnsppcckrst"
HEBREW_RANGE = "֐-׿"
FOLDS = (("sh|ş", "s"), ("ch|kh|ḥ|x", "k"), ("tz|ts", "c"), ("th", "t"), ("[aeiou]", ""), ("[wyh']", ""), ("v", "b"), ("f", "p"), ("q", "k"), ("[^a-z0-9]", ""))
#: Marks of variants (voices only, instrumental, live, remix, cover) that make two recordings of one title different; words
#: are bounded by what is no ASCII letter, digit or underscore.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
VARIANTS = (
    rf"(?i)a[\s-]?c+app?ell?a|{_B}vocal{_E}|ווקאל|וואקאל|אקפלה", rf"(?i){_B}instrumental{_E}", rf"(?i){_B}live{_E}|בהופעה", rf"(?i){_B}remix{_E}", rf"(?i){_B}cover{_E}|קאבר",
)
#: Fixed value: the strict mark of a recording with voices only, which admits it to the lists of these.
VOICES_ONLY = rf"(?i)a[\s-]?c+app?ell?a|{_B}vocal\s+version{_E}|\(\s*vocal\s*\)|ווקאל|וואקאל|אקפלה"


def voices_only(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(VOICES_ONLY)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _marks() -> tuple[str, str, str]:
    """All nonspacing marks as a class of a regular expression, and the characters that lose one in NFD, with what is left of each. Only those
    are listed of which a character is left that tokens hold or that joins two parts of a word; others separate words, with marks or without."""
    ranges, composed = [], {}
    for i in range(128, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) == "Mn":
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
        elif unicodedata.decomposition(c) and (left := strip_marks(c)) != c and len(left) == 1 and (left.isascii() or left in JOIN_MARKS or re.match(f"[{HEBREW_RANGE}]", left)):
            composed[c] = left
    return r"(?:(?=[^\x00-\x{2ff}])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "])+", "".join(composed), "".join(composed.values())


_MARKS, _COMPOSED, _BARE = _marks()


def without_marks(text: Column) -> Column:
    """Text whose tokens are those of its NFD without nonspacing marks. Spark has no normaliser; what this needs of one are the marks and some
    thousand characters, so no text goes through Python."""
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(F.regexp_replace(text, _MARKS, ""), _COMPOSED, _BARE)).otherwise(text)


#: Frequent characters that separate tokens: a translation of each is much cheaper than a regular expression's match; that does the rest.
_BREAKS = "".join(c for c in map(chr, (*range(1, 0x300), *range(0x2000, 0x2070))) if not re.match(f"[a-z0-9{HEBREW_RANGE}]", c) and c not in JOIN_MARKS[1:-1])


def tokens_of_plain(text: Column) -> Column:
    """Tokens of text that has no marks: any run outside a-z, 0-9 and Hebrew separates."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), _BREAKS + JOIN_MARKS[1:-1], " " * len(_BREAKS))
    flat = F.when(flat.rlike(f"[^a-z0-9 {HEBREW_RANGE}]"), F.regexp_replace(flat, f"[^a-z0-9{HEBREW_RANGE}]+", " ")).otherwise(flat)
    return F.filter(F.split(flat, " "), lambda w: w != "")


def plain_tokens(text: Column) -> Column:
    return tokens_of_plain(without_marks(text))


_STEPS = (("sh", "ş", "s"), ("kh ch", "ḥx", "k"), ("tz ts", "", "c"), ("th", "", "t"))


def skeleton(word: Column) -> Column:
    """The folds of FOLDS in their order. Letter pairs are replaced as plain text, the later of a step first, so that what one
    replacement leaves is not taken for another's; single letters go by one translation."""
    out = F.when(word.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.translate(word, HEBREW, HEBREW_SKELETON), f"[{HEBREW_RANGE}]", "")).otherwise(word)
    for pairs, singles, to in _STEPS:
        for pair in pairs.split():
            out = F.replace(out, F.lit(pair), F.lit(to))
        if singles:
            out = F.translate(out, singles, to * len(singles))
    out = F.translate(out, "vfqaeiouwyh'", "bpk")
    return F.when(out.rlike("[^a-z0-9]"), F.regexp_replace(out, "[^a-z0-9]", "")).otherwise(out)


def skeletons_in_line(words: Column) -> Column:
    """The skeleton of each token of an array (a-z, 0-9 and Hebrew), empty ones too. All are made in one pass over the tokens as one line: no
    fold reaches over a space, and single letters that no pair holds can wait for the last translation."""
    out = F.regexp_replace(F.translate(F.array_join(words, " "), HEBREW, HEBREW_SKELETON), f"[{HEBREW_RANGE}]", "")
    for pairs, _, to in _STEPS:
        for pair in pairs.split():
            out = F.replace(out, F.lit(pair), F.lit(to))
    out = F.translate(out, "vfqxaeiouwyh", "bpkk")
    return F.when(F.size(words) > 0, F.split(out, " ")).otherwise(F.array().cast("array<string>"))


def with_skeletons(plain: Column) -> Column:
    """Each token w with its skeleton s; both of the next take it, so that a skeleton is made once."""
    return F.transform(plain, lambda w: F.struct(w.alias("w"), skeleton(w).alias("s")))


def skeletons_of(pairs: Column) -> Column:
    return F.transform(F.filter(pairs, lambda x: F.length(x["s"]) >= 2), lambda x: x["s"])


def key_of(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda x: F.when(F.length(x["s"]) >= 2, x["s"]).otherwise(x["w"])), " ")


def skeleton_tokens(plain: Column) -> Column:
    return skeletons_of(with_skeletons(plain))


def skeleton_key(plain: Column) -> Column:
    """One slot for each plain token, which stands itself where its skeleton is too short."""
    return key_of(with_skeletons(plain))


def bigrams(word: Column) -> Column:
    """Pairs of neighbouring characters, with marked ends."""
    n = F.length(word)
    inner = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.when(n > 0, F.concat(F.array(F.concat(F.lit("^"), F.substring(word, 1, 1))), inner, F.array(F.concat(F.substring(word, -1, 1), F.lit("$"))))).otherwise(F.array().cast("array<string>"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether at most one insertion, deletion, substitution or swap of neighbours makes a into b."""
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    distance = F.levenshtein(a, b, 2)  # a swap counts as 2 there, and only such pairs are looked at any closer
    swapped = (distance == 2) & (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swap)
    return distance.isin(0, 1) | swapped


def duplicate_key(title: Column, artist: Column, traits: Column) -> Column:
    """artist | traits | variant numbers | letters and digits of the NFKC title: equal for the same recording."""
    marks = F.array_join(F.filter(F.array(*(F.when(title.rlike(v), F.lit(str(i))) for i, v in enumerate(VARIANTS))), lambda x: x.isNotNull()), "")
    folded = F.when(title.rlike("[^\\x00-\\x7f]"), _nfkc(title)).otherwise(title)
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), JOIN_MARKS, ""), "[^\\p{L}\\p{N}]+", " "))
    return F.concat_ws("|", artist, traits, marks, flat)


_SEPARATORS = r"(?i)\s*(?:,|&|\+|·|/|×|(?<![A-Za-z0-9_])(?:x|feat|ft|featuring|with|and|vs)(?![A-Za-z0-9_])\.?|עם)\s*"


def credits(title: Column) -> Column:
    """Guests that a title names: within brackets after feat, ft, featuring, duet, duet with or with, wherever that stands in them; outside
    only after the first three."""
    brackets = F.regexp_extract_all(title, F.lit(r"[(\[{]([^)\]}]*)[)\]}]"), F.lit(1))
    inside = F.transform(brackets, lambda c: F.regexp_extract(c, r"(?i)(?:feat\.?|ft\.?|featuring|duet(?:\s+with)?|with)\s+(.+)", 1))
    bare = F.regexp_replace(title, r"[(\[{][^)\]}]*[)\]}]", " ")
    tail = F.regexp_extract_all(bare, F.lit(r"(?i)(?<![A-Za-z0-9_])(?:featuring|feat|ft)\.?\s+(.+)$"), F.lit(1))
    names = F.flatten(F.transform(F.concat(inside, tail), lambda x: F.split(x, _SEPARATORS)))
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


# The same rules for the few query strings of a search.


def plain_words(text: str) -> list[str]:
    flat = re.sub(f"[^a-z0-9{HEBREW_RANGE}]+", " ", re.sub(JOIN_MARKS, "", strip_marks(text).lower()))
    return flat.split()


def skeleton_word(word: str) -> str:
    out = re.sub(f"[{HEBREW_RANGE}]", "", word.translate(str.maketrans(HEBREW, HEBREW_SKELETON)))
    for pattern, to in FOLDS:
        out = re.sub(pattern, to, out)
    return out


def expand(plain: list[str], skel: list[str], groups: list[list[str]]) -> tuple[list[str], list[str]]:
    """Synonyms: a group of at least two forms joins in when any of its tokens stands in what is there so far."""
    plain, skel = list(dict.fromkeys(plain)), list(dict.fromkeys(skel))
    for forms in groups:
        p = list(dict.fromkeys(w for f in forms for w in plain_words(f)))
        s = [x for x in dict.fromkeys(map(skeleton_word, p)) if len(x) >= 2]
        if len(forms) > 1 and (not set(p).isdisjoint(plain) or not set(s).isdisjoint(skel)):
            plain, skel = list(dict.fromkeys(plain + p)), list(dict.fromkeys(skel + s))
    return plain, skel
