"""Text columns of the news feed: names, sentences, providers, dates, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters as Python's ``str`` methods and ``re`` see them.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
WORD = r"[\p{L}\p{N}_]"

# Legal suffixes removed from company names, in this order.
NAME_SUFFIXES = [
    r"A\.Ş\.?", r"A\.S\.?", r"LTD\.?", r"ŞTİ\.?", r"TİC\.?", r"SAN\.?", r"VE", r"İŞL\.?", r"PAZ\.?",
]

# Fixed value: line between the articles of a stored text file.
SEPARATOR = "_" * 50

# Fixed value: disclaimer that publishers append to articles.
LEGAL_DISCLAIMER = """***
Yasal Uyarı

Burada yer alan yatırım bilgi, yorum ve tavsiyeler yatırım danışmanlığı kapsamında değildir.Yatırım danışmanlığı hizmeti ; aracı kurumlar, portföy yönetim şirketleri, mevduat kabul etmeyen bankalar ile müşteri arasında imzalanacak yatırım danışmanlığı sözleşmesi çerçevesinde sunulmaktadır.Burada yer alan yorum ve tavsiyeler, yorum ve tavsiyede bulunanların kişisel görüşlerine dayanmaktadır.Bu görüşler mali durumunuz ile risk ve getiri tercihlerinize uygun olmayabılır.Bu nedenle, sadece burada yer alan bilgilere dayanılarak yatırım kararı verilmesi beklentilerinize uygun sonuçlar doğurmayabilir."""

UNDETERMINED = "undetermined"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(x: Column) -> Column:
    """Split on runs of white space, without empty words."""
    return F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")


def clean_company_name(name: Column, word_boundary: bool = False) -> Column:
    """F-1. By default a suffix is also removed inside a word."""
    out = F.upper(name)
    for suffix in NAME_SUFFIXES:
        pattern = rf"(?<!{WORD}){suffix}(?!{WORD})" if word_boundary else suffix
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, f"{SPACE}+", " "))


def sentences(text: Column, min_length: int = 3) -> Column:
    """F-2: split on newlines and on dots that touch no digit."""
    parts = F.split(text, r"(?<![0-9])\.(?![0-9])|\n")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= min_length)


def scored_sentences(text: Column) -> Column:
    """The sentences long enough (more than 15 characters) to be scored."""
    return F.filter(sentences(text), lambda s: F.length(s) > 15)


def provider(content: Column, strict: bool = False) -> Column:
    """F-6: text between the first ``www.`` and the first ``.com``.

    Without ``www.`` the text is cut at offset 3; ``strict`` calls that
    undetermined instead.
    """
    www, com = F.instr(content, "www."), F.instr(content, ".com")
    start, end = www + 3, com - 1
    name = F.substring(content, start + 1, end - start)
    usable = (com > 0) & (start < end) & (F.length(name) <= 15)
    if strict:
        usable = usable & (www > 0)
    return F.when(usable, name).otherwise(UNDETERMINED)


def provider_or_id(name: Column, provider_id: Column) -> Column:
    """F-7: fall back to the cleaned provider id."""
    cleaned = F.regexp_replace(F.lower(provider_id), r"[ .\-]", "")
    usable = F.length(cleaned).between(1, 20)
    return F.when((name == UNDETERMINED) & usable, cleaned).otherwise(name)


def news_date(text: Column, fallback: Column) -> Column:
    """F-8: date of a timestamp in one of four formats, else ``fallback``."""
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    tries = [
        (text, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        (text, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        (text, "yyyy-MM-dd'T'HH:mm:ss"),
        (F.when(no_weekday != text, no_weekday), "dd MMM yyyy HH:mm:ss 'GMT'"),
        (F.when(no_weekday != text, no_weekday), "dd MMM yyyy HH:mm:ss 'UTC'"),
    ]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(x, F.lit(f))) for x, f in tries], fallback)


def epoch_date(seconds: Column, fallback: Column, tz: str = "UTC") -> Column:
    """F-16: epoch seconds to a local date; missing and 0 give ``fallback``."""
    local = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz))
    return F.coalesce(F.when(seconds != 0, local), fallback)


def date_label(date: Column) -> Column:
    return F.date_format(date, "yyyy.MM.dd")


def strip_disclaimer(text: Column, disclaimer: str = LEGAL_DISCLAIMER) -> Column:
    """F-13."""
    return F.replace(text, F.lit(disclaimer), F.lit(""))


def fallback_content(title: Column, source: Column, link: Column) -> Column:
    """F-14: body of an article whose page gave none."""
    return F.concat_ws(
        "\n",
        title,
        F.when(source != "", F.concat(F.lit("Kaynak: "), source)),
        F.when(link != "", F.concat(F.lit("Link: "), link)),
    )


def packed(content: Column) -> Column:
    """F-15: an article followed by the separator line."""
    return F.concat(content, F.lit(f"\n{SEPARATOR}\n"))


def unpacked(text: Column) -> Column:
    """F-15: the articles of a stored text, as an array."""
    return F.split(text, "_{50}")


def display_text(text: Column, width: int = 75) -> Column:
    """F-22."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def percent(score: Column) -> Column:
    """F-22: 0.1234 as ``%12.34``; the exact half goes to the even digit, as in C and SQL."""
    return F.concat(F.lit("%"), F.translate(F.format_number(score * 100, 2), ",", ""))


def ticker(code: Column, suffix: str = ".IS") -> Column:
    """F-21."""
    return F.concat(F.upper(strip(code)), F.lit(suffix))
