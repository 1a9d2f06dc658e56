"""Column functions over text. Whitespace is the Unicode set of str.split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.sources.staging import unused

#: The 29 characters that ``str.isspace`` accepts, for Java regexes and RE2.
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
#: The same characters, spelled out.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
URL = r"https?://[!$-_a-z]+"
#: Removed one after the other from the lower-cased text.
BOILERPLATE = (
    r"cookie policy",
    r"privacy policy",
    r"terms of service",
    r"all rights reserved",
    r"© \d{4}",
    r"page \d+ of \d+",
    r"click here",
    r"read more",
)


def _bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` bound as a lambda's variable: evaluated once however
    often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    """Runs of whitespace become one space; none at either end."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def url_count(c: Column | str) -> Column:
    """URLs in a text; a collapsed character class, so a long URL costs no stack."""
    return F.regexp_count(c, F.lit(URL))


def without_boilerplate(c: Column | str) -> Column:
    """The lower-cased text without each phrase (lower-cased also if none is there).

    Lower-cased ASCII is matched as it is, by plain search where a phrase has no
    digits. Only texts with a letter that ignoring case makes an ASCII one (dotless
    i, long s) take the patterns with Unicode flags.
    """
    def gated(phrase: str):
        mark, pattern = phrase.split("\\")[0], phrase.replace("\\d", "\\p{Nd}")
        return lambda y: F.when(F.contains(y, F.lit(mark)), F.regexp_replace(y, pattern, "")).otherwise(y)

    def plain(x: Column) -> Column:
        out = x
        for phrase in BOILERPLATE:
            if "\\" in phrase:
                out = _bound(out, gated(phrase))
            else:
                out = F.replace(out, F.lit(phrase), F.lit(""))
        return out

    def flagged(x: Column) -> Column:
        for phrase in BOILERPLATE:
            x = F.regexp_replace(x, "(?iuU)" + phrase, "")
        return x

    odd = lambda x: F.contains(x, F.lit("\u0131")) | F.contains(x, F.lit("\u017f"))
    return _bound(F.lower(c), lambda x: F.when(odd(x), flagged(x)).otherwise(plain(x)))


def clean(c: Column | str, min_length: int = 50, max_urls: int = 5, remove_boilerplate: bool = True) -> Column:
    """The cleaned text, or null where a text is rejected.

    In turn: strip; length; URL count on the original case; boilerplate with
    lower-casing, then length again; collapse; length again. A null or empty
    text is rejected. Each step is evaluated once, and only for texts that the
    steps before it let through.
    """
    raw = F.col(c) if isinstance(c, str) else c

    def of_body(body: Column) -> Column:
        short = (F.length(strip(body)) < min_length) | (F.length(body) == 0) if remove_boilerplate else F.lit(False)
        out = _bound(collapse(body), lambda x: F.when((F.length(x) >= min_length) & (F.length(x) > 0), x))
        return F.when(~short, out)

    def of_bare(bare: Column) -> Column:
        body = _bound(without_boilerplate(bare), of_body) if remove_boilerplate else of_body(bare)
        return F.when(F.length(bare) >= min_length, F.when(url_count(bare) <= max_urls, body))

    return F.when(F.length(raw) > 0, _bound(strip(raw), of_bare))


def kept(df: DataFrame, cleaned: Column, name: str, also: Column | None = None) -> DataFrame:
    """The rows whose ``cleaned`` isn't null (or for which ``also`` holds), with it as
    column ``name``, in its place.

    As a filter over a projection the optimizer would evaluate ``cleaned`` twice; as
    a generator of no or one row it is evaluated once.
    """
    one = F.array(cleaned)
    some = F.filter(one, lambda x: x.isNotNull() | also) if also is not None else F.array_compact(one)
    new = unused(df, name + "_cleaned")
    out = df.select("*", F.explode(some).alias(new))
    return out.select(*[F.col(new).alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def words(c: Column | str) -> Column:
    """Lower-case words; a null or blank text has none."""
    return F.coalesce(F.array_remove(F.split(collapse(F.lower(c)), " "), ""), F.array().cast("array<string>"))


def ngrams(c: Column | str, n: int) -> Column:
    """Distinct word n-grams of a text, each joined by one space.

    Text of fewer than n words has none.
    """
    return ngrams_of(words(c), n)


def ngrams_of(w: Column, n: int) -> Column:
    def of(x: Column) -> Column:
        starts = F.slice(x, F.lit(1), F.size(x) - (n - 1))
        grams = F.transform(starts, lambda first, i: F.concat_ws(" ", first, *[F.get(x, i + k) for k in range(1, n)]))
        return F.when(F.size(x) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return _bound(w, of)
