"""Sector names: fuzzy mapping, ids, and parsing of a classifier's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.text import strip

# The sector catalogue (a sector's id is its position) ...
SECTORS = [
    "Bankacılık",
    "Sigortacılık",
    "Finansal Kiralama & Faktoring",
    "Holding & Yatırım",
    "Gayrimenkul Yatırım Ortaklığı (GYO)",
    "Otomotiv",
    "Demir Çelik & Metal",
    "Petrokimya & Rafineri",
    "Çimento & Yapı Malzemeleri",
    "Cam",
    "Gıda & İçecek",
    "Perakende & Ticaret",
    "Tekstil & Hazır Giyim",
    "Havacılık & Ulaştırma",
    "Telekomünikasyon",
    "Teknoloji & Yazılım",
    "Enerji & Elektrik",
    "Madencilik",
    "İlaç & Sağlık",
    "Dayanıklı Tüketim & Beyaz Eşya",
    "Kağıt & Ambalaj",
    "Savunma & Havacılık Sanayi",
    "Tarım & Hayvancılık",
    "Turizm & Otelcilik",
    "Medya & Eğlence",
    "Kimya",
    "Diğer Sanayi",
    "Diğer Hizmet",
]
DEFAULT_SECTOR = "Diğer Sanayi"
DEFAULT_SECTOR_ID = 26

# ... and the keywords tried, in this order, when no sector name fits.
KEYWORDS = {
    "banka": "Bankacılık",
    "sigorta": "Sigortacılık",
    "holding": "Holding & Yatırım",
    "gyo": "Gayrimenkul Yatırım Ortaklığı (GYO)",
    "otomotiv": "Otomotiv",
    "demir": "Demir Çelik & Metal",
    "çelik": "Demir Çelik & Metal",
    "petro": "Petrokimya & Rafineri",
    "rafineri": "Petrokimya & Rafineri",
    "çimento": "Çimento & Yapı Malzemeleri",
    "cam": "Cam",
    "gıda": "Gıda & İçecek",
    "perakende": "Perakende & Ticaret",
    "tekstil": "Tekstil & Hazır Giyim",
    "havacılık": "Havacılık & Ulaştırma",
    "telekom": "Telekomünikasyon",
    "teknoloji": "Teknoloji & Yazılım",
    "enerji": "Enerji & Elektrik",
    "maden": "Madencilik",
    "ilaç": "İlaç & Sağlık",
    "beyaz eşya": "Dayanıklı Tüketim & Beyaz Eşya",
    "kağıt": "Kağıt & Ambalaj",
    "savunma": "Savunma & Havacılık Sanayi",
    "tarım": "Tarım & Hayvancılık",
    "turizm": "Turizm & Otelcilik",
    "kimya": "Kimya",
}

REPLY = "array<struct<code: string, sector: string>>"


def fuzzy_sector(raw: Column) -> Column:
    """F-17: a sector that contains or is contained in the text, then keywords, then the default."""
    low = F.lower(raw)
    by_name = [
        F.when(F.contains(low, F.lit(s.lower())) | F.contains(F.lit(s.lower()), low), s) for s in SECTORS
    ]
    by_keyword = [F.when(F.contains(low, F.lit(k)), s) for k, s in KEYWORDS.items()]
    return F.coalesce(*by_name, *by_keyword, F.lit(DEFAULT_SECTOR))


def known_sector(raw: Column) -> Column:
    return F.when(raw.isin(SECTORS), raw).otherwise(fuzzy_sector(raw))


def sector_id(sector: Column) -> Column:
    """F-18."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SECTORS]), sector)
    return F.when(pos > 0, pos - 1).otherwise(DEFAULT_SECTOR_ID).cast("int")


def reply_items(reply: Column) -> Column:
    """F-19: (code, sector) items of a reply; null if it is no JSON list.

    The list may be fenced by back-ticks, or be a value of a JSON object.
    """
    text = strip(reply)
    fenced = F.regexp_replace(F.split(text, "```")[1], r"\Ajson", "")
    body = strip(F.when(text.startswith("```"), fenced).otherwise(text))
    lists = F.filter(F.map_values(F.from_json(body, "map<string,string>")), lambda v: v.startswith("["))
    source = F.when(body.startswith("{"), F.get(lists, F.lit(0))).otherwise(body)
    items = F.from_json(source, REPLY)
    return F.transform(
        items,
        lambda i: F.struct(
            F.coalesce(i["code"], F.lit("")).alias("code"),
            known_sector(F.coalesce(i["sector"], F.lit(DEFAULT_SECTOR))).alias("sector"),
        ),
    )
