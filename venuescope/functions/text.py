"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FACTOR_KEYWORDS

#: What `\s` matches.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def place_key(name: Column, district: Column, neighborhood: Column) -> Column:
    """Name, district and neighbourhood where both are known, else the name."""
    return F.when(district.isNotNull() & neighborhood.isNotNull(), F.concat_ws(" ", name, district, neighborhood)).otherwise(name)


def sentences(text: Column) -> Column:
    """Sentences without their ends: a piece of one character is dropped, a text without pieces is its own."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda whole: _pieces(whole, r"[.!?]\s+"))


def _pieces(whole: Column, ends: str) -> Column:
    parts = F.filter(F.transform(F.split(whole, ends), strip), lambda s: F.length(s) > 1)
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(let(parts, lambda p: F.when(F.size(p) == 0, F.array(whole)).otherwise(p)))


def sentences_with_ends(text: Column) -> Column:
    """Sentences that keep their ends, from text with white space collapsed."""
    return let(collapse(F.coalesce(text, F.lit(""))), lambda whole: _pieces(whole, r"(?<=[.!?。！？])\s+"))


def capped(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit("..."))).otherwise(text)


def compact(text: Column, most: int = 120) -> Column:
    """One line of at most `most` characters, dots at the end where it was cut."""
    line = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, most - 1), r"\s+$", ""), F.lit("...")))


def truncated(text: Column, most: int = 2000, least_share: float = 0.8) -> Column:
    """At most `most` characters, cut after the last space, full stop or line end if that is late enough."""
    back = lambda h, c: F.instr(F.reverse(h), c)
    last = lambda h, c: F.when(back(h, c) > 0, most - back(h, c)).otherwise(-1)

    def cut(head: Column) -> Column:
        at = F.greatest(last(head, " "), last(head, "."), last(head, "\n"))
        return let(at, lambda a: F.when(a > most * least_share, F.substring(head, F.lit(1), a + 1)).otherwise(head))

    return let(strip(F.coalesce(text, F.lit(""))), lambda whole: F.when(F.length(whole) <= most, whole).otherwise(let(F.substring(whole, 1, most), cut)))


def is_number(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.lit(False))


def is_metadata(text: Column) -> Column:
    """Whether a review is only the form's headings and marks."""
    rated = r"(음식|서비스|분위기):\s*\d+"
    # The headings.
    headings = [r"서비스.*식사.*유형", r"식사.*유형", r"서비스.*매장.*내.*식사", r"음식:\s*\d+.*서비스:\s*\d+.*분위기:\s*\d+$", rated + "$"]
    return F.coalesce(strip(text).rlike(r"(?i)^(?:" + "|".join(headings) + ")"), F.lit(False))


def language(text: Column) -> Column:
    return F.when(text.rlike("[가-힣]"), "ko").otherwise("en")


def author_only(text: Column, author: Column) -> Column:
    """A review that is its author's name, or a short text without author that is no number."""
    own, name = strip(F.coalesce(text, F.lit(""))), strip(F.coalesce(author, F.lit("")))
    digits = F.regexp_replace(own, r"\.", "").rlike(r"^\d+$")
    return ((name != "") & (own == name)) | ((name == "") & (F.length(own) <= 10) & ~digits)


def _drop(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


# What pages show around reviews. Counters may sit inside each other, hence three rounds.
GUIDE_MARKS = [r"지역\s*가이드\s*·?\s*"]
COUNTERS = [*[r"·?\s*리뷰\s*\d+[,.]?\d*\s*개\s*·?\s*"] * 3, *[r"·?\s*사진\s*\d+[,.]?\d*\s*장\s*·?\s*"] * 3]
LEFTOVERS = [r"[리뷰]{2,}", r"[사진]{2,}", r"[\uE000-\uF8FF]", r"수정일:\s*"]
RELATIVE_DATES = [r"\d+\s*년\s*전", r"\d+\s*개월\s*전", r"\d+\s*주\s*전", r"\d+\s*일\s*전", r"\d+\s*시간\s*전", r"\d+\s*분\s*전"]
NAME_DATE = r"\s*\d+\s*(?:년|개월|주|일|시간|분)\s*전"
AFTER_NAME = r"(?=\s|지역|리뷰|사진|·)"
BUTTONS = ["자세히", "공유", "더보기", "…"]
SCRAPED_MARKS = [r"\S*리뷰\s*\d+\s*개\s*·\s*사진\s*\d+\s*장\s*", r"^\d+\s*(?:년|달|주|일|시간|분)\s*전\s*", r"[\u2000-\u206F\u2E00-\u2E7F]"]


def cleaned(text: Column, author: Column | None = None) -> Column:
    """A review without what the page shows around it: names, counters, guide marks, relative dates."""
    out = strip(F.coalesce(text, F.lit("")))
    name = strip(F.coalesce(author, F.lit(""))) if author is not None else None
    quoted = F.regexp_replace(name, r"([^\p{L}\p{N}\s])", r"\\$1") if name is not None else None
    if quoted is not None:
        out = F.when(name != "", F.regexp_replace(out, F.concat(F.lit("(?iu)^"), quoted, F.lit(AFTER_NAME)), F.lit(""))).otherwise(out)
    out = _drop(out, *GUIDE_MARKS, *COUNTERS)
    out = F.regexp_replace(out, r"\s*·\s*", " ")
    out = _drop(out, *LEFTOVERS, *RELATIVE_DATES)
    if quoted is not None:
        out = F.when(name != "", F.regexp_replace(out, F.concat(F.lit("(?iu)"), quoted, F.lit(NAME_DATE)), F.lit(""))).otherwise(out)
    return collapse(out)


def scraped(text: Column) -> Column:
    """Scraped text without buttons, counters, a leading relative date and typographic marks."""
    out = strip(F.coalesce(text, F.lit("")))
    for word in BUTTONS:
        out = strip(F.replace(out, F.lit(word), F.lit("")))
    return collapse(_drop(out, *SCRAPED_MARKS))


def backfilled(text: Column, author: Column, rating: Column) -> Column:
    """The rating where the review is blank or only a name."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    whole = F.when(rating == F.floor(rating), rating.cast("long").cast("string")).otherwise(rating.cast("string"))
    return F.when((blank | author_only(text, author)) & rating.isNotNull(), whole).otherwise(text)


def district_of(place: Column, districts: Column) -> Column:
    """The first word of a place that is a district."""
    return F.try_element_at(F.filter(F.split(strip(place), r"\s+"), lambda w: F.array_contains(districts, w)), F.lit(1))


def place_parts(place: Column, districts: Column) -> Column:
    """base (words before the district, else the first word), district, neighborhood (the word after it)."""
    words = F.split(strip(F.coalesce(place, F.lit(""))), r"\s+")
    district = district_of(place, districts)
    at = F.when(district.isNotNull(), F.array_position(words, district)).cast("int")
    before = F.when(at > 1, F.array_join(F.slice(words, F.lit(1), at - 1), " "))
    return F.struct(F.coalesce(before, F.element_at(words, 1)).alias("base"), district.alias("district"), F.when(at < F.size(words), F.try_element_at(words, at + 1)).alias("neighborhood"))


def keyword_hits(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


# Phrases that tell walking minutes.
WALKING_PHRASES = [
    r"도보\s*(?:로\s*)?(\d+)\s*분",
    r"(\d+)\s*분\s*도보",
    r"(\d+)\s*분\s*거리",
    r"(?:지하철역|역|버스정류장|정류장)(?:에서|까지)\s*(\d+)\s*분",
    r"(\d+)\s*분\s*(?:이면|만에|걸림|걸려)\s*(?:갈\s*수|도착|가능)",
]


def factor_hits(text: Column) -> Column:
    """Structs (factor, hits) of the factors whose keywords a text holds, in factor order."""
    found = F.array(*(F.struct(F.lit(f).alias("factor"), keyword_hits(text, words).alias("hits")) for f, words in FACTOR_KEYWORDS.items()))
    return F.filter(found, lambda x: x["hits"] > 0)


def walking_score(text: Column) -> Column:
    """The best score of the walking minutes that a text tells; null without any."""
    return best_minutes(text, WALKING_PHRASES)


def best_minutes(text: Column, phrases: list[str]) -> Column:
    told = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in phrases)))
    score = lambda m: F.when(m <= 5, 0.95).when(m <= 10, 0.90).when(m <= 15, 0.85).otherwise(0.80)
    return F.array_max(F.transform(told, lambda m: score(m.try_cast("int"))))


def hangul_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^가-힣\s]", "")


def is_true(value: Column) -> Column:
    """Booleans written as words."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def search_query(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(strip(p), F.lit("")) for p in parts))


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))


def content_fingerprint(*fields: Column) -> Column:
    """SHA-1 over fields in order, each followed by a line end."""
    return F.sha1(F.concat(*(F.concat(F.coalesce(f.cast("string"), F.lit("")), F.lit("\n")) for f in fields)).cast("binary"))
