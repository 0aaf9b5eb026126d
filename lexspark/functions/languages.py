"""The words by which acts in 24 languages name their parts, and the patterns made of them.

Joined by broadcast (24 rows), the table drives the plans; ``pattern`` gives one pattern to Python helpers. Word boundaries
are those of letters of any script, and letters match in either case in any script.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LOW, _HIGH = "„“‘’«»\"'", "‘’“”«»\"'"
# Per language the words for article, chapter, section, annex, definitions and recital, the quotation marks and the
# verb of definitions. Chapter and section begin a line unless a dot stands before them; in Hungarian the number comes first.
WORDS = {
    "EN": ("Article", "CHAPTER", "SECTION", "ANNEX", "definitions?", "[Rr]ecitals?", "‘’'\"", "means"),
    "PL": ("Artyku[łl]", "ROZDZIA[ŁL]", "SEKCJA|ODDZIA[ŁL]", "ZA[ŁL][ĄA]CZNIK", "definicj", "[Mm]otyw", "„‚«“'\"‘”‟»’", r"oznacz[aą]\S*"),
    "DE": ("Artikel", "KAPITEL", "ABSCHNITT", "ANHANG", "Begriffsbestimmungen?|Definitionen?", "Erwägungsgrund(?:e|en)?", _LOW, "bezeichnet"),
    "FR": ("Article", "CHAPITRE", "SECTION", "ANNEXE", "Définitions?", "[Cc]onsidérants?", _HIGH, r"(?:on\s+)?entend\s+par"),
    "ES": ("Art[ií]culo", "CAP[IÍ]TULO", "SECCI[OÓ]N", "ANEXO", "Definiciones?", "[Cc]onsiderando", _HIGH, r"se\s+entender[aá]\s+por|se\s+entiende\s+por"),
    "IT": ("Articolo", "CAPO", "SEZIONE", "ALLEGATO", "Definizioni?", "[Cc]onsiderando", _HIGH, r"si\s+intende(?:\s+per)?"),
    "PT": ("Artigo", "CAP[IÍ]TULO", "SEC[CÇ][AÃ]O", "ANEXO", "Definiç[oõ]es?", "[Cc]onsiderando", _HIGH, r"entende-se\s+por"),
    "NL": ("Artikel", "HOOFDSTUK", "AFDELING", "BIJLAGE", "Definities?", "[Oo]verweging", _HIGH, r"wordt\s+verstaan|verstaat\s+men"),
    "DA": ("Artikel", "KAPITEL", "AFDELING", "BILAG", "Definitioner?", "[Bb]etragtning", _HIGH, r"forstås\s+ved|betyder"),
    "SV": ("Artikel", "KAPITEL", "AVSNITT", "BILAGA", "Definitioner?", "[Ss]käl", _HIGH, "avses"),
    "FI": ("Artikla", ".LUKU", ".JAKSO", "LIITE", "Määritelm[iä]", "[Jj]ohdanto-osa|[Pp]erustelukappale", _HIGH, "tarkoitetaan"),
    "CS": ("Čl[aá]nek", "KAPITOLA", "ODD[IÍ]L", "PŘ[IÍ]LOHA", "Definice?", r"[Bb]od\s+odůvodnění|[Oo]důvodn[eě]n[ií]", _LOW, r"rozum[ií]\s+se"),
    "SK": ("Čl[aá]nok", "KAPITOLA", "ODDIEL", "PR[IÍ]LOHA", "Definície?", r"[Oo]dôvodnenie|[Bb]od\s+odôvodnenia", _LOW, r"rozumie\s+sa"),
    "HU": (r"\.\s+cikk", ".FEJEZET", ".SZAKASZ", "MELL[EÉ]KLET", "Fogalomm?eghatároz[aá]sok?", "[Pp]reambulumbekezdés", _LOW, "jelenti"),
    "RO": ("Articolul?", "CAPITOLUL?", "SEC[TŢ]IUNEA", "ANEXA?", "Defini[tţ]ii", "[Cc]onsiderent", _LOW, "înseamnă"),
    "BG": ("Член", "ГЛАВА", "РАЗДЕЛ", "ПРИЛОЖЕНИЕ", "Определения", "[Сс]ъображение", _LOW, "означава"),
    "HR": ("Članak", "POGLAVLJE", "ODJELJAK", "PRILOG", "Definicije?", r"[Uu]vodna\s+izjava|[Uu]vodne\s+izjave", _LOW, "znači"),
    "SL": ("Člen", "POGLAVJE", "ODDELEK", "PRILOGA", "Opredelitve?", r"[Uu]vodni\s+del|[Uu]vodna\s+izjava", _LOW, "pomeni"),
    "ET": ("Artikkel", ".PEAT[UÜ]KK", ".JAGU", "LISA", "M[oõ]isted?", "[Pp]õhjendus", _LOW, "tähendab"),
    "LV": ("Pants", ".NODAĻA", ".IEDAĻA", "PIELIKUMS", "Defin[iī]cijas?", r"[Ap]psvērums|[Pp]reambulas\s+daļa", _HIGH, "nozīmē"),
    "LT": ("Straipsnis", ".SKYRIUS", ".SKIRSNIS", "PRIEDAS?", "Apibrėžim?ai", r"[Kk]onstatuojamoji\s+dalis|[Pp]reambulės\s+punktas", _LOW, "reiškia"),
    "EL": ("Άρθρο", "ΚΕΦΑΛΑΙΟ", "ΤΜΗΜΑ", "ΠΑΡΑΡΤΗΜΑ", "Ορισμο[ίί]", r"αιτιολογική\s+σκέψη", _HIGH, "νοείται"),
    "MT": ("Artikolu", "KAPITOLU", "TAQSIMA", "ANNESS", "Definizzjonijiet?", "[Kk]onsiderazzjonijiet?", _HIGH, "tfisser"),
    "GA": ("Airteagal", "CAIBIDIL", "ROINN", "IARSCR[IÍ]BHINN", "Sainmh[ií]nithe?", "[Aa]imhréasa|[Rr]achtaí", _HIGH, "ciallaíonn"),
}
# What ends the first part of an act's title (the institution, or else the word before the date), and the note on
# the EEA.
TITLES = {
    "EN": (r"\s+of the European Parliament(?!\w)", r"\s+of\s+", "text with eea relevance"), "PL": (r"\s+Parlamentu Europejskiego(?!\w)", r"\s+z dnia\s+", "tekst mający znaczenie dla eog"),
    "DE": (r"\s+des Europäischen Parlaments(?!\w)", r"\s+vom?\s+", "Text.*?EWR"), "FR": (r"\s+du Parlement européen(?!\w)", r"\s+du\s+", "Texte.*EEE"),
    "ES": (r"\s+del Parlamento Europeo(?!\w)", r"\s+de\s+", "Texto.*EEE"), "IT": (r"\s+del Parlamento europeo(?!\w)", r"\s+del\s+", "Testo.*SEE"),
    "PT": (r"\s+do Parlamento Europeu(?!\w)", r"\s+de\s+", "Texto.*EEE"), "NL": (r"\s+van het Europees Parlement(?!\w)", r"\s+van\s+", "Tekst.*EER"),
    "DA": (r"\s+Europa-Parlamentets?(?!\w)", r"\s+af\s+", "EØS-relevant tekst"), "SV": (r"\s+Europaparlamentets?(?!\w)", r"\s+av den\s+", "EES-relevant text"),
    "FI": (r"\s+Euroopan parlamentin(?!\w)", r"\s+annettu\s+", "ETA-merkityksellinen teksti"), "CS": (r"\s+Evropského parlamentu(?!\w)", r"\s+ze dne\s+", "Text.*význam.*pro EHP"),
    "SK": (r"\s+Európskeho parlamentu(?!\w)", r"\s+z\s+", "Text.*významu.*pre EHP"), "HU": (r"\s+az Európai Parlament(?!\w)", r"\s+évi\s+", "EGT-vonatkozású szöveg"),
    "RO": (r"\s+Parlamentului European(?!\w)", r"\s+din\s+", "Text.*SEE"), "BG": (r"\s+на Европейския парламент(?!\w)", r"\s+от\s+", "Текст.*ЕИП"),
    "HR": (r"\s+Europskog parlamenta(?!\w)", r"\s+od\s+", "Tekst.*EGP"), "SL": (r"\s+Evropskega parlamenta(?!\w)", r"\s+z dne\s+", "Besedilo.*EGS"),
    "ET": (r"\s+Euroopa Parlamendi(?!\w)", r"\s+\d+\.\s+", "EMP-s kohaldatav tekst"), "LV": (r"\s+Eiropas Parlamenta(?!\w)", r"\s+gada\s+", "EEZ nozīmīgs teksts"),
    "LT": (r"\s+Europos Parlamento(?!\w)", r"\s+m\.\s+", "EEE svarbus tekstas"), "EL": (r"\s+του Ευρωπαϊκού Κοινοβουλίου(?!\w)", r"\s+της\s+", "Σχετικό.*ΕΟΧ"),
    "MT": (r"\s+tal-Parlament Ewropew(?!\w)", r"\s+ta'\s+", "Test.*żEE"), "GA": (r"\s+Pharlaimint na hEorpa(?!\w)", r"\s+an\s+", "Téacs.*LEE"),
}
# Languages whose definitions name the verb before the term, those that mark the term by no quotes but by what
# follows it, and the word between an article and the act that it belongs to (elsewhere "of").
VERB_FIRST, UNQUOTED = ("FR", "ES", "IT", "PT"), {"LT": "–", "SV": ":"}
CONNECTORS = {"DE": "der", "FR": "du", "ES": "del", "IT": "del", "PT": "do", "NL": "van"}
NUMBER = r"\d+[a-z]*"


def known(lang: str | None) -> str:
    """The language itself if it has a row, else English."""
    return lang.upper() if lang and lang.upper() in WORDS else "EN"


def _begun(words: str) -> str:
    """Pattern of a division's word: at the start of a line, or anywhere."""
    inner = f"(?:{words.lstrip('.')})(?!\\p{{L}})"
    return rf"(?<!\p{{L}}){inner}" if words.startswith(".") else rf"^\s*{inner}"


def patterns(lang: str | None) -> dict[str, str]:
    """Patterns for Spark, to be used without regard to case (that of recital excepted); group 1 of article is
    the number, of annex the number or '', of means, cell (a cell of a table) and fallback the term."""
    lang = known(lang)
    article, chapter, section, annex, definition, recital, quotes, means = WORDS[lang]
    quoted = f"[{quotes}]([^{quotes}]+)[{quotes}]"
    return {
        "article": rf"({NUMBER}){article}" if lang == "HU" else rf"{article}\s+({NUMBER})",
        "chapter": _begun(chapter), "section": _begun(section), "annex": rf"^(?:{annex})(?:\s*([IVXLC]+|\d+))?(?![\p{{L}}\d])", "definition": definition, "recital": recital,
        "means": rf"^(?:{means})\s+{quoted}" if lang in VERB_FIRST else rf"^{quoted}\s+(?:{means})\s+",
        "cell": rf"^[{quotes}]?([^{quotes}]+)[{quotes}]?\s+(?:{means})\s+",
        "fallback": rf"^(.+?)\s*{UNQUOTED[lang]}\s+" if lang in UNQUOTED else rf"^{quoted}\s*[:–—,]?\s*",
    }


def table(spark: SparkSession) -> DataFrame:
    """language and its patterns, with the flags that Spark's functions take them with; 24 rows."""
    rows = [(lang, *((p if f == "recital" else f"(?iu){p}") for f, p in patterns(lang).items())) for lang in WORDS]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in ("language", *(f"{x}_form" for x in patterns(None)))))
