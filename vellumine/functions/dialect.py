"""SQL of the text rules for DuckDB. The rules are written out here on their own, not built from the functions they check."""

from __future__ import annotations

from . import text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def replaced(x: str, chain: tuple[tuple[str, str], ...]) -> str:
    for pattern, by in chain:
        x = f"regexp_replace({x}, {q(pattern)}, {q(by.replace('$1', chr(92) + '1'))}, 'g')"
    return x


#: The prose projection, step by step. Fences of each length are dropped from the longest one on, as this dialect has no back-references.
_STEPS = (
    *((rf"(?ms)^[ \t]{{0,3}}{m}{{{n},}}[^\n]*$.*?(?:^[ \t]{{0,3}}{m}{{{n},}}[ \t]*$|\z)", " ") for n in (6, 5, 4, 3) for m in "`~"),
    (r"(?s)<!--.*?-->", " "), (r"(?m)^[ \t]{0,3}\[[^\]\n]+\]:[^\n]*$", " "), (r"`[^`\n]+`", " "), (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1"), (r"</?[A-Za-z][^<>\n]*>", " "),
    (r"(?:https?://|mailto:)[^ \t\n)>\]]+", " "), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "), (r"[\\`*_~#>\[\]{}|]", " "), (r"[+-]?[0-9]+(?:[.,:/-][0-9]+)*", " "), (r"[ \t\n\r\f]+", " "),
)


def prose(x: str) -> str:
    return f"trim({replaced(unix(x), _STEPS)})"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def number_tokens(x: str) -> str:
    plain = f"regexp_replace({x}, '&#([0-9]+|[xX][0-9A-Fa-f]+);', ' ', 'g')"
    plain = f"translate(regexp_replace({plain}, '([ÃÂ])[⁰¹²³⁴-⁹]', '\\1', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"
    return f"regexp_extract_all(regexp_replace({plain}, '([0-9])[+]', '\\1 ', 'g'), '[+-]?[0-9]+(?:[.,:/-][0-9]+)*')"


def symbol_tokens(x: str) -> str:
    for a, b in (("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"), ("&percnt;", "%"), ("&dollar;", "$"), ("&permil;", "‰"), ("&#36;", "$"), ("&#37;", "%"), ("&#8364;", "€")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_extract_all({x}, '[$€£¥₹₿%‰‱]')"


def suspicious(x: str) -> str:
    first = f"regexp_replace({x}, '(\\p{{L}})[$\"]', '\\1' || chr(1), 'g')"
    lone = f"regexp_replace(regexp_replace(regexp_replace({x}, '[$][$]+', chr(1), 'g'), '([0-9][ \\t]*)[$]', '\\1' || chr(1), 'g'), '[$]([ \\t]*[0-9])', chr(1) || '\\1', 'g')"
    spaced = count_of(x, r"(?:^|[^\p{L}0-9_])(?:\p{L}[ \t]+){4,}\p{L}(?:$|[^\p{L}0-9_])")
    lost = f"(length({x}) - length(replace({x}, chr(65533), '')))"
    touching = f"(length({first}) - length(replace({first}, chr(1), '')) + len(regexp_extract_all({first}, '[$\"]\\p{{L}}')))"
    return f"({lost} + {touching} + length({lone}) - length(replace({lone}, '$', '')) + {spaced})"


def quality(x: str) -> str:
    v = replaced(x, ((r"(?s)<!--.*?-->", " "), (r"[`#*_|>\[\]()]", " ")))
    compact = f"length(regexp_replace({v}, '[ \\t\\n\\r\\f]', '', 'g'))"
    words = f"regexp_extract_all({v}, '\\p{{L}}+')"
    short = f"CASE WHEN len({words}) = 0 THEN 1.0 ELSE len(list_filter({words}, lambda w: length(w) = 1))::DOUBLE / len({words}) END"
    score = (
        f"0.5::DOUBLE * least(1.0::DOUBLE, {letters(v)}::DOUBLE / {compact} / 0.75::DOUBLE) + 0.2::DOUBLE * (1 - least(1.0::DOUBLE, 2 * {short}))"
        f" + 0.15::DOUBLE * least(1.0::DOUBLE, {letters(v)} / 80.0::DOUBLE) + 0.15::DOUBLE * (1 - least(1.0::DOUBLE, {suspicious(x)} / 4.0::DOUBLE))"
    )
    return f"CASE WHEN {compact} = 0 OR {letters(v)} = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score})), 6) END"


def language_code(x: str) -> str:
    table = {n: code for code, names in text.LANGUAGES.items() for n in (code, *names)}
    low = f"lower(trim({x}))"
    case = lambda y: "CASE " + y + " " + " ".join(f"WHEN {q(n)} THEN {q(c)}" for n, c in table.items()) + " END"
    return f"coalesce({case(low)}, {case(f'regexp_extract({low}, {q("^([^-_]+)")}, 1)')})"


def one_edit(a: str, b: str, swaps: bool = False) -> str:
    """Whether two words differ by one letter more, less or other, or by neighbours that changed places; by characters, not bytes."""
    drop = lambda x, y: f"(length({x}) = length({y}) + 1 AND len(list_filter(range(1, length({x}) + 1), lambda i: substring({x}, 1, i - 1) || substring({x}, i + 1) = {y})) > 0)"
    other = f"(length({a}) = length({b}) AND len(list_filter(range(1, length({a}) + 1), lambda i: substring({a}, i, 1) <> substring({b}, i, 1))) = 1)"
    swap = f"(length({a}) = length({b}) AND {a} <> {b} AND len(list_filter(range(1, length({a})), lambda i: substring({a}, 1, i - 1) || substring({a}, i + 1, 1) || substring({a}, i, 1) || substring({a}, i + 2) = {b})) > 0)"
    return f"({other} OR {drop(a, b)} OR {drop(b, a)}{f' OR {swap}' if swaps else ''})"
