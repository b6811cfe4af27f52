"""Numbers written as words, by language, as Spark columns.

The words of 0 to 99, of the hundred, the thousand and the first ten ordinals are composed by each language's rule from
short lists of fixed values; words that are also articles (French un, German ein, Portuguese um) mean no number.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 0 to 19 (fixed values).
UNITS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix_sept dix_huit dix_neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
    "pt": "zero um dois três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezasseis dezassete dezoito dezanove",
    "it": "zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove",
}
#: 20, 30 and so on to 90, the hundred and the thousand (fixed values).
TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand",
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil",
    "fr": "vingt trente quarante cinquante soixante soixante_dix quatre_vingt quatre_vingt_dix cent mille",
    "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend",
    "pt": "vinte trinta quarenta cinquenta sessenta setenta oitenta noventa cem mil",
    "it": "venti trenta quaranta cinquanta sessanta settanta ottanta novanta cento mille",
}
#: The first ten ordinals and their other forms (fixed values).
ORDINALS = {
    "en": "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth",
    "es": "primer primero primera|segundo segunda|tercer tercero tercera|cuarto cuarta|quinto quinta|sexto sexta|séptimo séptima|octavo octava|noveno novena|décimo décima",
    "fr": "premier première|deuxième|troisième|quatrième|cinquième|sixième|septième|huitième|neuvième|dixième",
    "de": "erste ersten erster erstes|zweite zweiten zweiter zweites|dritte dritten dritter drittes|vierte vierten vierter viertes|fünfte fünften|sechste sechsten|siebte siebten|achte achten|neunte neunten|zehnte zehnten",
    "pt": "primeiro primeira|segundo segunda|terceiro terceira|quarto quarta|quinto quinta|sexto sexta|sétimo sétima|oitavo oitava|nono nona|décimo décima",
    "it": "primo prima|secondo seconda|terzo terza|quarto quarta|quinto quinta|sesto sesta|settimo settima|ottavo ottava|nono nona|decimo decima",
}
ARTICLES = {"fr": ("un",), "pt": ("um",)}


@cache
def dictionary(language: str) -> dict[str, int]:
    """Words and runs of words, joined by one blank, with the number they mean."""
    units = UNITS[language].replace("_", " ").split(" ") if language != "fr" else [u.replace("_", " ") for u in UNITS[language].split(" ")]
    tens = [t.replace("_", " ") for t in TENS[language].split(" ")]
    out = {w: n for n, w in enumerate(units)}
    for k, ten in enumerate(tens[:8], 2):
        out[ten] = 10 * k
        for n in range(1, 10):
            one = units[n]
            if language == "en":
                out[f"{ten} {one}"] = 10 * k + n
            elif language == "es":
                out[f"{ten} y {one}"] = 10 * k + n
            elif language == "pt":
                out[f"{ten} e {one}"] = 10 * k + n
            elif language == "de":
                out[f"{'ein' if n == 1 else one}und{ten}"] = 10 * k + n
            elif language == "it":
                out[(ten[:-1] if n in (1, 8) else ten) + one] = 10 * k + n
            elif k in (7, 9):  # counted on from sixty and from eighty
                out[f"{tens[k - 3]}{' et' if n == 1 and k == 7 else ''} {units[10 + n]}"] = 10 * k + n
            else:
                out[f"{ten}{' et' if n == 1 and k < 8 else ''} {one}"] = 10 * k + n
    if language == "es":
        short = {1: "veintiuno", 2: "veintidós", 3: "veintitrés", 4: "veinticuatro", 5: "veinticinco", 6: "veintiséis", 7: "veintisiete", 8: "veintiocho", 9: "veintinueve"}
        out |= {w: 20 + n for n, w in short.items()}
    if language == "pt":
        out |= {"dezesseis": 16, "dezessete": 17, "dezenove": 19, "duas": 2}
    if language == "fr":
        out |= {"quatre vingts": 80}
    if language == "en":
        out |= {f"{w}fold": n for w, n in list(out.items()) if " " not in w and n > 1}
    out[tens[8]], out[tens[9]] = 100, 1000
    for n, forms in enumerate(ORDINALS[language].split("|"), 1):
        for f in forms.split(" "):
            out.setdefault(f, n)
    for a in ARTICLES.get(language, ()):
        out.pop(a)
    return out


def _looked_up(words: Column, table: Column) -> Column:
    return F.transform(words, lambda w: table[w])


def written_values(text: Column, language: Column) -> Column:
    """The numbers that a text writes as words, the longest run of words first; empty for other languages."""
    # each word stands between two blanks of its own, so that neighbours share none
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  "), F.lit(" "))
    out = F.lit(None).cast("array<int>")
    for code in UNITS:
        words = dictionary(code)
        runs = sorted(words, key=lambda w: (-len(w), w))
        pattern = " (" + "|".join(w.replace(" ", "  ") for w in runs) + ") "
        table = F.create_map(*[F.lit(x) for w, n in words.items() for x in (w.replace(" ", "  "), n)])
        out = F.when(language == code, _looked_up(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), table)).otherwise(out)
    return F.coalesce(out, F.array().cast("array<int>"))
