"""Scalar text functions as Spark columns: no Python in any of them.

Every function takes and gives a Column; null gives null unless stated. Patterns use no look-around, so the same
pattern means the same in other SQL engines. Line ends are normalised before line-wise patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered replacements of the prose projection (pattern, replacement); their order changes the result.
PROSE = (
    (r"(?ms)^[ \t]{0,3}(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\z)", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?m)^[ \t]{0,3}\[[^\]\n]+\]:[^\n]*$", " "),
    (r"`[^`\n]+`", " "),
    (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"</?[A-Za-z][^<>\n]*>", " "),
    (r"(?:https?://|mailto:)[^ \t\n)>\]]+", " "),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "),
    (r"[\\`*_~#>\[\]{}|]", " "),
    (r"[+-]?[0-9]+(?:[.,:/-][0-9]+)*", " "),
    (r"[ \t\n\r\f]+", " "),
)
#: What is not visible text, for the quality score.
VISIBLE = ((r"(?s)<!--.*?-->", " "), (r"[`#*_|>\[\]()]", " "))
NUMBER = r"[+-]?[0-9]+(?:[.,:/-][0-9]+)*"
SYMBOL = "[$€£¥₹₿%‰‱]"
LINK = r"!?\[[^\]\n]*\]\(<?([^)>\n]+)>?\)"
HEADING = r"(?m)^[ \t]{0,3}(#{1,6})[ \t]"


def lines_unix(text: Column) -> Column:
    """Text with \\n as its only line end."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _java(pattern: str) -> str:
    """The same pattern with \\n as the only line end, as other engines have it."""
    return pattern.replace("(?ms)", "(?dms)").replace("(?m)", "(?dm)")


def replaced(text: Column, chain: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, _java(x[0]), x[1]), chain, text)


def prose(markdown: Column) -> Column:
    """Running words only: no code, comments, link targets, tags, addresses, marks and numbers; blanks collapsed."""
    return F.trim(replaced(lines_unix(markdown), PROSE))


def letters(text: Column) -> Column:
    """Number of letters of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_java(pattern)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(group))


def number_tokens(text: Column) -> Column:
    """The numbers of a text: a sign counts unless it follows a digit.

    Numeric HTML entities are none; superscript digits are digits, but not after the letters that wrong decoding leaves.
    """
    plain = F.regexp_replace(text, r"&#(?:[0-9]+|[xX][0-9A-Fa-f]+);", " ")
    plain = F.translate(F.regexp_replace(plain, "([ÃÂ])[⁰¹²³⁴-⁹]", "$1"), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    return matches(F.regexp_replace(plain, r"([0-9])[+]", "$1 "), NUMBER)


def symbol_tokens(text: Column) -> Column:
    """Currency and share signs, also where they are written as HTML entities."""
    return matches(unescape_html(text), SYMBOL)


def roman_references(text: Column) -> Column:
    """The values of the capital roman numerals of two marks or more, and of single ones after a word that counts, per line order."""
    found = matches(text, r"(?:^|[^\p{L}\p{N}_])((?:X{0,3}(?:IX|IV|V?I{2,3}|VI?)|X{1,3}|XL|LX{0,3}|XC|C{1,3})(?:$|[^\p{L}\p{N}_]))", 1)
    return F.filter(F.transform(found, lambda x: roman_value(F.regexp_replace(x, r"[^IVXLC]", ""))), lambda v: v.isNotNull() & (v > 1))


def code_spans(text: Column) -> Column:
    """What stands in backticks."""
    return matches(text, r"`([^`\n]+)`", 1)


def comments(text: Column) -> Column:
    """What stands in HTML comments, trimmed."""
    return F.transform(matches(text, r"(?s)<!--(.*?)-->", 1), F.trim)


def publication_year(text: Column) -> Column:
    """The last year from 1450 to 2099 that a text names; null where it names none."""
    years = matches(F.regexp_replace(text, r"[0-9]{5,}", " "), r"(?:1[4-9]|20)[0-9]{2}")
    plausible = F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y >= 1450)
    return F.when(F.size(plausible) > 0, F.get(plausible, F.size(plausible) - 1))


def keep_upper_case(before: Column, after: Column) -> Column:
    """The second text, in capitals where the first one is in capitals."""
    return F.when(F.coalesce(upper_case(before), F.lit(False)), F.upper(after)).otherwise(after)


def work_units(kind: Column, pages: Column, size: Column) -> Column:
    """The units of work of a file: its pages, or its bytes by the size of a unit of its kind; at least 1.

    The sizes of units are fixed values.
    """
    divisor = F.when(kind == "txt", 3500).when(kind == "md", 4000).when(kind == "docx", 16000).when(kind == "epub", 24000)
    return F.greatest(F.lit(1), F.when(kind == "pdf", pages).otherwise(F.ceil(size / divisor))).cast("int")


def link_targets(markdown: Column) -> Column:
    return matches(lines_unix(markdown), LINK, 1)


def suspicious(text: Column) -> Column:
    """Signs of damaged glyphs: replacement characters, lone and letter-touching marks, spaced-out words."""
    lost = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    first = F.regexp_replace(text, r"(\p{L})[$\"]", "$1\u0001")
    touching = count_of(first, "\u0001") + count_of(first, r"[$\"]\p{L}")
    lone = replaced(text, ((r"[$][$]+", "\u0001"), (r"([0-9][ \t]*)[$]", "$1\u0001"), (r"[$]([ \t]*[0-9])", "\u0001$1")))
    spaced = count_of(text, r"(?:^|[^\p{L}0-9_])(?:\p{L}[ \t]+){4,}\p{L}(?:$|[^\p{L}0-9_])")
    return lost + touching + (F.length(lone) - F.length(F.replace(lone, F.lit("$"), F.lit("")))) + spaced


def quality(text: Column) -> Column:
    """A score of 0 to 1 of how readable a text is; 0 for one without letters. Rounded to 6 places."""
    visible = replaced(text, VISIBLE)
    compact = F.length(F.regexp_replace(visible, r"[ \t\n\r\f]", ""))
    n = letters(visible)
    words = count_of(visible, r"\p{L}+")
    single = F.size(F.filter(matches(visible, r"\p{L}+"), lambda w: F.length(w) == 1))
    short = F.when(words == 0, F.lit(1.0)).otherwise(single / words)
    score = (
        F.lit(0.5) * F.least(F.lit(1.0), n / compact / F.lit(0.75))
        + F.lit(0.2) * (1 - F.least(F.lit(1.0), 2 * short))
        + F.lit(0.15) * F.least(F.lit(1.0), n / F.lit(80.0))
        + F.lit(0.15) * (1 - F.least(F.lit(1.0), suspicious(text) / F.lit(4.0)))
    )
    whole = F.when((compact == 0) | (n == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
    return F.when(text.isNotNull(), whole)


def damaged(text: Column) -> Column:
    """Whether conversion left a replacement character, a spaced-out word or a word thrice in a row."""
    spaced = F.regexp_like(text, F.lit(r"(?:^|[^\p{L}0-9_])(?:\p{L} ){5,}\p{L}"))
    thrice = F.regexp_like(F.lower(text), F.lit(r"(?:^|[^\p{L}])(\p{L}{2,})[ \t\n]+\1[ \t\n]+\1(?:$|[^\p{L}])"))
    return text.contains("�") | spaced | thrice


def title_like(line: Column) -> Column:
    """A heading, or at most 12 words of which four fifths of the letters are capitals."""
    n = letters(line)
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    words = count_of(line, r"[^ \t\n]+")
    return F.coalesce(F.regexp_like(line, F.lit(r"^[ \t]{0,3}#{1,6}[ \t]")) | ((n > 0) & (words <= 12) & (upper >= 0.8 * n)), F.lit(False))


def canonical(text: Column) -> Column:
    """Text with \\n line ends, no blanks at line ends and no blank lines around it."""
    return F.regexp_replace(F.regexp_replace(lines_unix(text), r"(?dm)[ \t]+$", ""), r"\A\n+|\n+\z", "")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def excerpt(text: Column, size: int = 80) -> Column:
    """One line of at most size characters; a longer text is cut and marked."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…")))


def slug(text: Column, size: int = 60) -> Column:
    """Lower-case ASCII words joined by hyphens; `item` where none is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, size), r"-+$", "")
    return F.when(s == "", F.lit("item")).otherwise(s)


def safe_token(text: Column, size: int = 64) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")) & (F.length(text) <= size), F.lit(False))


def safe_path(text: Column) -> Column:
    """Whether a path stays inside its folder: relative, with no step up, no drive and no control character."""
    bad = F.regexp_like(text, F.lit(r"(?:^|[/\\\\])\.\.(?:$|[/\\\\])|^[/\\\\]|^[A-Za-z]:|[\x00-\x1f]"))
    return F.coalesce((text != "") & ~bad, F.lit(False))


def safe_url(text: Column) -> Column:
    """Whether an address may be written into a document: http, https, mailto, a fragment, or a safe relative path."""
    low = F.lower(F.trim(text))
    absolute = F.regexp_like(low, F.lit(r"^(?:https?://[^ \t\n<>\"]+|mailto:[^ \t\n<>\"@]+@[^ \t\n<>\"@]+|#[^ \t\n<>\"]+)$"))
    return F.coalesce(absolute | (~F.regexp_like(low, F.lit(r"^[a-z][a-z0-9+.-]*:|[ \t\n<>\"]")) & safe_path(F.trim(text))), F.lit(False))


def upper_case(text: Column) -> Column:
    """Whether a text has letters and none in lower case."""
    return (letters(text) > 0) & (F.upper(text) == text)


def roman_value(numeral: Column) -> Column:
    """The value of a roman numeral; null for anything else."""
    worth = F.create_map(*[F.lit(x) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in p])
    marks = F.reverse(F.filter(F.split(F.upper(numeral), ""), lambda c: c != ""))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    fold = F.aggregate(
        marks,
        zero,
        lambda a, c: F.struct(
            (a.total + F.when(worth[c] < a.last, -worth[c]).otherwise(worth[c])).cast("int").alias("total"), F.greatest(a.last, worth[c]).cast("int").alias("last")
        ),
        lambda a: a.total,
    )
    return F.when(F.regexp_like(F.upper(numeral), F.lit("^[IVXLCDM]+$")), fold)


def alphabetic_index(n: Column) -> Column:
    """1 → A, 26 → Z, 27 → AA, up to three letters; null below 1."""
    a = lambda x: F.char(F.lit(65) + x.cast("int"))
    k = n.cast("int") - 1
    one, two = a(k % 26), F.concat(a(F.floor(k / 26) - 1), a(k % 26))
    three = F.concat(a(F.floor(k / 676 - F.lit(27) / 26) % 26), a(F.floor(k / 26 - 1) % 26), a(k % 26))
    return F.when(n < 1, F.lit(None).cast("string")).when(n <= 26, one).when(n <= 702, two).otherwise(three)


def confusable_digits(text: Column) -> Column:
    """The number that misread digits mean: i, I, l, L for 1 and o, O for 0; null where other characters stand."""
    return F.when(F.regexp_like(text, F.lit("^[0-9iIlLoO]{1,9}$")), F.translate(text, "iIlLoO", "111100").cast("bigint"))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.round(n / 1024.0, 1).cast("decimal(18,1)").cast("string"), F.lit(" KiB")))
        .when(n < 1073741824, F.concat(F.round(n / 1048576.0, 1).cast("decimal(18,1)").cast("string"), F.lit(" MiB")))
        .otherwise(F.concat(F.round(n / 1073741824.0, 1).cast("decimal(18,1)").cast("string"), F.lit(" GiB")))
    )


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(m.cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s")))
        .otherwise(F.concat(h.cast("string"), F.lit(" h "), m.cast("string"), F.lit(" min")))
    )


def escape_html(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


def unescape_html(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"), ("&cent;", "¢"), ("&percnt;", "%"), ("&dollar;", "$"), ("&permil;", "‰"), ("&#36;", "$"), ("&#37;", "%"), ("&#8364;", "€"), ("&amp;", "&")), text)


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether the items of one array stand in another in the same order."""
    found = F.aggregate(whole, F.lit(0), lambda k, x: F.when((k < F.size(part)) & (F.get(part, k) == x), k + 1).otherwise(k))
    return found == F.size(part)


#: Names of languages and their codes (fixed values).
LANGUAGES = {
    "en": ("english", "eng"), "es": ("spanish", "español", "spa"), "fr": ("french", "français", "fra", "fre"), "de": ("german", "deutsch", "deu", "ger"),
    "pt": ("portuguese", "português", "por"), "it": ("italian", "italiano", "ita"), "ru": ("russian", "rus"), "zh": ("chinese", "zho", "chi"),
    "ja": ("japanese", "jpn"), "hi": ("hindi", "hin"), "ar": ("arabic", "ara"), "th": ("thai", "tha"),
}


def language_code(label: Column) -> Column:
    """The code that a label spells, whatever its case, region or name; null where it names no known language."""
    low = F.lower(F.trim(label))
    head = F.regexp_extract(low, r"^([^-_]+)", 1)
    table = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in (code, *names) for x in (n, code)])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, head))
