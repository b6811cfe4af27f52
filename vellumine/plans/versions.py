"""Queries that compare two versions of a text: translations with their sources, answers with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions import text as T
from ..operators import compare as P
from ..operators import consensus as C
from ..operators import fidelity as V
from ..session import table


def _cases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "translation_cases").where("source is not null and expected is not null").select("id", "source", "expected").distinct()


def _answers(s: SparkSession, d: str) -> DataFrame:
    """name, response_no, answer, expected: every answer beside the reference answer."""
    r = table(s, d, "response_cases").select("name", F.posexplode("responses").alias("response_no", "answer"), "expected").distinct()
    return r.where("answer is not null and expected is not null")


def _spoken(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "translation_cases").where("source is not null and expected is not null")
    return c.select("id", "source", "expected", T.language_code(F.col("source_lang")).alias("source_code"), T.language_code(F.col("target_lang")).alias("target_code")).distinct()


def number_conservation(s: SparkSession, d: str) -> DataFrame:
    return P.conservation(_cases(s, d), "id", T.number_tokens(F.col("source")), T.number_tokens(F.col("expected")))


def number_fidelity(s: SparkSession, d: str) -> DataFrame:
    return P.number_fidelity(_spoken(s, d), "id", "source", "expected", "source_code", "target_code")


def roman_conservation(s: SparkSession, d: str) -> DataFrame:
    roman = lambda c: F.transform(T.roman_references(F.col(c)), lambda v: v.cast("string"))
    return P.conservation(_cases(s, d), "id", roman("source"), roman("expected"))


def code_conservation(s: SparkSession, d: str) -> DataFrame:
    return P.conservation(_cases(s, d), "id", T.code_spans(F.col("source")), T.code_spans(F.col("expected")))


def symbol_conservation(s: SparkSession, d: str) -> DataFrame:
    return P.conservation(_cases(s, d), "id", T.symbol_tokens(F.col("source")), T.symbol_tokens(F.col("expected")))


def address_conservation(s: SparkSession, d: str) -> DataFrame:
    url = lambda c: T.matches(F.col(c), r"https?://[A-Za-z0-9./_-]+")
    return P.conservation(_cases(s, d), "id", url("source"), url("expected"))


def coverage_ratio(s: SparkSession, d: str) -> DataFrame:
    return P.coverage(_cases(s, d), "id", "source", "expected")


def block_alignment(s: SparkSession, d: str) -> DataFrame:
    a = P.align_blocks(_cases(s, d), "id", "source", "expected")
    return a.groupBy("id").agg(F.count("source_block").alias("source_blocks"), F.count("target_block").alias("target_blocks"), F.count_if(F.col("source_block") == F.col("target_block")).alias("unchanged"))


def issue_totals(s: SparkSession, d: str) -> DataFrame:
    n = number_conservation(s, d).select(F.lit("numbers").alias("kind"), "id").distinct()
    u = address_conservation(s, d).select(F.lit("addresses").alias("kind"), "id").distinct()
    c = coverage_ratio(s, d).where("issue is not null").select(F.concat(F.lit("coverage_"), "issue").alias("kind"), "id")
    return n.unionByName(u).unionByName(c).groupBy("kind").agg(F.count(F.lit(1)).alias("cases"))


def revision_risk(s: SparkSession, d: str) -> DataFrame:
    """The answers that a rule of counts and forms judges risky; those that only word similarity finds are revision_rewrites."""
    return P.revision_risk(_answers(s, d), ["name", "response_no"], "expected", "answer").where("reason not in ('none', 'rewritten')")


def revision_rewrites(s: SparkSession, d: str) -> DataFrame:
    r = P.revision_risk(_answers(s, d), ["name", "response_no"], "expected", "answer")
    return r.where("reason = 'rewritten'").select("name", "response_no")


def revision_hunks(s: SparkSession, d: str) -> DataFrame:
    return P.hunks(_answers(s, d), ["name", "response_no"], "expected", "answer")


def near_duplicate_blocks(s: SparkSession, d: str) -> DataFrame:
    return P.near_duplicates(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")


def page_overlap(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pdf_review_issues").where("markdown is not null").select("identifier", "export_id", "markdown").distinct()
    return P.overlap(pages, table(s, d, "markdown_exports"), "identifier", "export_id", "markdown", "primary_markdown")


def glossary_hits(s: SparkSession, d: str) -> DataFrame:
    cases = table(s, d, "translation_cases").where("source is not null")
    return C.glossary_hits(cases, "id", "source", "expected", "glossary")


def glossary_duplicates(s: SparkSession, d: str) -> DataFrame:
    return C.glossary_duplicates(table(s, d, "translation_cases").select("id", "glossary").distinct(), "id", "glossary")


def strict_findings(s: SparkSession, d: str) -> DataFrame:
    return V.findings(_cases(s, d), "id", "source", "expected").groupBy("rule").agg(F.count(F.lit(1)).alias("cases"))


def heading_fidelity(s: SparkSession, d: str) -> DataFrame:
    return V.heading_fidelity(_cases(s, d), "id", "source", "expected")


def heading_variants(s: SparkSession, d: str) -> DataFrame:
    return V.heading_variants(_cases(s, d), "id", "source", "expected")


def polarity_pairs(s: SparkSession, d: str) -> DataFrame:
    return V.polarity(_spoken(s, d), "id", "source", "expected", "source_code", "target_code")


def segment_issues(s: SparkSession, d: str) -> DataFrame:
    return V.segment_issues(_cases(s, d), "id", "source", "expected")


CASES = "(SELECT DISTINCT id, source, expected FROM translation_cases WHERE source IS NOT NULL AND expected IS NOT NULL)"
ANSWERS = """(SELECT DISTINCT name, i - 1 AS response_no, answer, expected FROM (SELECT name, unnest(responses) AS answer, generate_subscripts(responses, 1) AS i, expected FROM response_cases)
            WHERE answer IS NOT NULL AND expected IS NOT NULL)"""
#: Number words of six languages, composed here on their own: (lang, word, value).
NUMBERS = """
    u AS (SELECT lang, replace(unnest(string_split(ws, ' ')), '_', ' ') AS w, generate_subscripts(string_split(ws, ' '), 1) - 1 AS v FROM (VALUES
        ('en', 'zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen'),
        ('es', 'cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve'),
        ('fr', 'zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix_sept dix_huit dix_neuf'),
        ('de', 'null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn'),
        ('pt', 'zero um dois três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezasseis dezassete dezoito dezanove'),
        ('it', 'zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove')) t(lang, ws)),
    tens AS (SELECT lang, unnest(string_split(ws, ' ')) AS w, 10 * (generate_subscripts(string_split(ws, ' '), 1) + 1) AS v FROM (VALUES
        ('en', 'twenty thirty forty fifty sixty seventy eighty ninety'), ('es', 'veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa'), ('fr', 'vingt trente quarante cinquante soixante'),
        ('de', 'zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig'), ('pt', 'vinte trinta quarenta cinquenta sessenta setenta oitenta noventa'), ('it', 'venti trenta quaranta cinquanta sessanta settanta ottanta novanta')) t(lang, ws)),
    words AS (
        SELECT lang, w, min(v) AS v FROM (
            SELECT lang, w, v FROM u WHERE NOT (lang = 'fr' AND w = 'un') AND NOT (lang = 'pt' AND w = 'um') UNION ALL SELECT lang, w, v FROM tens
            UNION ALL SELECT t.lang, CASE t.lang WHEN 'en' THEN t.w || ' ' || u.w WHEN 'es' THEN t.w || ' y ' || u.w WHEN 'pt' THEN t.w || ' e ' || u.w
                WHEN 'de' THEN (CASE WHEN u.v = 1 THEN 'ein' ELSE u.w END) || 'und' || t.w WHEN 'it' THEN (CASE WHEN u.v IN (1, 8) THEN left(t.w, length(t.w) - 1) ELSE t.w END) || u.w
                ELSE t.w || (CASE WHEN u.v = 1 THEN ' et ' ELSE ' ' END) || u.w END, t.v + u.v FROM tens t JOIN u ON t.lang = u.lang WHERE u.v BETWEEN 1 AND 9
            UNION ALL SELECT 'fr', CASE WHEN v = 11 THEN 'soixante et onze' ELSE 'soixante ' || w END, 60 + v FROM u WHERE lang = 'fr' AND v BETWEEN 10 AND 19
            UNION ALL SELECT 'fr', 'quatre vingt ' || w, 80 + v FROM u WHERE lang = 'fr' AND v BETWEEN 1 AND 19
            UNION ALL SELECT lang, w || 'fold', v FROM (SELECT lang, w, v FROM u UNION ALL SELECT lang, w, v FROM tens UNION ALL VALUES ('en', 'hundred', 100), ('en', 'thousand', 1000)) WHERE lang = 'en' AND v > 1
            UNION ALL VALUES ('fr', 'quatre vingt', 80), ('fr', 'quatre vingts', 80), ('es', 'veintiuno', 21), ('es', 'veintidós', 22), ('es', 'veintitrés', 23), ('es', 'veinticuatro', 24), ('es', 'veinticinco', 25),
                ('es', 'veintiséis', 26), ('es', 'veintisiete', 27), ('es', 'veintiocho', 28), ('es', 'veintinueve', 29), ('pt', 'dezesseis', 16), ('pt', 'dezessete', 17), ('pt', 'dezenove', 19), ('pt', 'duas', 2),
                ('en', 'hundred', 100), ('es', 'cien', 100), ('fr', 'cent', 100), ('de', 'hundert', 100), ('pt', 'cem', 100), ('it', 'cento', 100),
                ('en', 'thousand', 1000), ('es', 'mil', 1000), ('fr', 'mille', 1000), ('de', 'tausend', 1000), ('pt', 'mil', 1000), ('it', 'mille', 1000)
            UNION ALL SELECT lang, unnest(string_split(forms, ' ')), n FROM (SELECT lang, unnest(string_split(all_, '|')) AS forms, generate_subscripts(string_split(all_, '|'), 1) AS n FROM (VALUES
                ('en', 'first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth'), ('es', 'primer primero primera|segundo segunda|tercer tercero tercera|cuarto cuarta|quinto quinta|sexto sexta|séptimo séptima|octavo octava|noveno novena|décimo décima'),
                ('fr', 'premier première|deuxième|troisième|quatrième|cinquième|sixième|septième|huitième|neuvième|dixième'),
                ('de', 'erste ersten erster erstes|zweite zweiten zweiter zweites|dritte dritten dritter drittes|vierte vierten vierter viertes|fünfte fünften|sechste sechsten|siebte siebten|achte achten|neunte neunten|zehnte zehnten'),
                ('pt', 'primeiro primeira|segundo segunda|terceiro terceira|quarto quarta|quinto quinta|sexto sexta|sétimo sétima|oitavo oitava|nono nona|décimo décima'),
                ('it', 'primo prima|secondo seconda|terzo terza|quarto quarta|quinto quinta|sesto sesta|settimo settima|ottavo ottava|nono nona|decimo decima')) o(lang, all_))
        ) GROUP BY lang, w),
    runs AS (SELECT lang, ' (' || string_agg(replace(w, ' ', '  '), '|' ORDER BY length(w) DESC, w) || ') ' AS pattern FROM words GROUP BY lang)"""
FLAT_WORDS = "' ' || regexp_replace(lower({}), '[^\\p{{L}}]+', '  ', 'g') || ' '"


def _conserved(tokens: str) -> str:
    one = lambda c, d: f"SELECT id, unnest({tokens.replace('{}', c)}) AS token, {d} AS d FROM {CASES}"
    return f"""
        SELECT id, token, greatest(d, 0) AS missing, greatest(-d, 0) AS added FROM (
            SELECT id, token, sum(d)::BIGINT AS d FROM ({one('source', 1)} UNION ALL {one('expected', -1)}) GROUP BY ALL HAVING sum(d) <> 0)"""


_COVER = f"""
    SELECT id, s AS source_letters, t AS target_letters, CASE WHEN s >= 80 AND t / s < 0.55 THEN 'short' WHEN s >= 80 AND t / s > 1.8 THEN 'long' WHEN s >= 20 AND s < 80 AND t / s > 2.5 AND t > s + 80 THEN 'long' END AS issue
    FROM (SELECT id, {D.letters('source')} AS s, {D.letters('expected')} AS t FROM {CASES} WHERE trim(source) <> '' AND trim(expected) <> '')"""
_NUMBERS = _conserved(D.number_tokens("{}"))
_URLS = _conserved("regexp_extract_all({}, 'https?://[A-Za-z0-9./_-]+')")


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def _names(c: str) -> str:
    return f"list_sort(regexp_extract_all({c}, '[\\p{{Ll}}\\p{{N}},;:)] +(\\p{{Lu}}[\\p{{L}}\\p{{N}}]+)', 1))"


def _nblocks(c: str) -> str:
    return D.count_of(f"trim({D.unix(c)})", r"\n[ \t]*\n[ \t\n]*")


def _pieces(c: str) -> str:
    return f"list_filter(string_split_regex({D.unix(c)}, '\\n[ \\t\\f]*(?:\\n[ \\t\\f]*)+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(12)) <> '')"


def _levels(c: str) -> str:
    return f"list_transform(regexp_extract_all({D.unix(c)}, '(?m)^[ \\t]{{0,3}}(#{{1,6}})[ \\t]', 1), lambda h: length(h))"


def _jumps(c: str) -> str:
    return f"len(list_filter(range(2, len({_levels(c)}) + 1), lambda i: ({_levels(c)})[i] - ({_levels(c)})[i - 1] > 1)) > 0"


def _headings_only(c: str) -> str:
    return f"len(list_filter(string_split({D.unix(c)}, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]'))) = 0"


def _hidden(c: str, side: str) -> str:
    """A text in small letters without what no term is looked for in, and without the longer terms that hold this one."""
    for p in ("(?ms)^[ \\t]{0,3}```+[^\\n]*$.*?(^[ \\t]{0,3}```+[ \\t]*$|\\z)", "`[^`\\n]+`", "\\]\\([^)\\n]*\\)", "https?://[^ \\t\\n)>]+", "</?[A-Za-z][^<>\\n]*>"):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    longer = f"list_transform(list_filter(glossary, lambda o: length(trim(o.{side})) > length(trim(g.{side})) AND contains(lower(o.{side}), lower(trim(g.{side})))), lambda o: lower(trim(o.{side})))"
    return f"list_reduce(list_concat([lower({c})], {longer}), lambda a, b: replace(a, b, ' § '))"


def _whole(text: str, term: str) -> str:
    """Whether a text holds a term between blanks, signs or letters of scripts without blanks."""
    spaced = "[\\p{Latin}\\p{Cyrillic}\\p{Greek}\\p{Arabic}\\p{Devanagari}\\p{N}_]"
    other = spaced.replace("[", "[^", 1)
    return f"regexp_matches({text}, '(^|{other})' || regexp_escape(lower(trim({term}))) || '($|{other})')"


_FENCES = "(?ms)^[ \\t]{0,3}```+[^\\n]*$.*?(^[ \\t]{0,3}```+[ \\t]*$|\\z)"
_HEADS = "regexp_extract_all({}, '(?m)^[ \\t]{{0,3}}#{{1,6}}[ \\t]+([^\\n]+)$', 1)"


def _strict() -> dict[str, str]:
    """The checks of two versions, each as a list of a column {}."""
    bare = f"regexp_replace({D.unix('{}')}, '{_FENCES}', ' ', 'g')"
    roman = "regexp_extract_all({}, '(?:^|[^\\p{L}\\p{N}_])((?:X{0,3}(?:IX|IV|V?I{2,3}|VI?)|X{1,3}|XL|LX{0,3}|XC|C{1,3})(?:$|[^\\p{L}\\p{N}_]))', 1)"
    return {
        "numbers": f"list_sort({D.number_tokens('{}')})", "symbols": f"list_sort({D.symbol_tokens('{}')})", "roman": f"list_sort(list_filter(list_transform({roman}, lambda x: regexp_replace(x, '[^IVXLC]', '', 'g')), lambda x: x <> 'I'))",
        "addresses": f"list_sort(regexp_extract_all({D.unix('{}')}, '!?\\[[^\\]\\n]*\\]\\(<?([^)>\\n]+)>?\\)', 1))", "code": f"list_sort(regexp_extract_all({bare}, '`([^`\\n]+)`', 1))",
        "fences": f"regexp_extract_all({D.unix('{}')}, '(?m)^[ \\t]{{0,3}}(?:```|~~~)')", "headings": f"list_transform(regexp_extract_all({bare}, '(?m)^[ \\t]{{0,3}}(#{{1,6}})[ \\t]', 1), lambda h: length(h))",
        "tables": f"list_transform(regexp_extract_all({bare}, '(?m)^[ \\t]*\\|[^\\n]*\\|[ \\t]*$'), lambda x: len(string_split(x, '|')))", "lists": f"list_transform(regexp_extract_all({bare}, '(?m)^[ \\t]{{0,3}}(?:[-*+]|[0-9]{{1,9}}[.)])[ \\t]'), lambda x: regexp_matches(x, '[0-9]'))",
        "quotes": f"list_transform(regexp_extract_all({bare}, '(?m)^[ \\t]{{0,3}}>+'), lambda x: trim(x))", "images": "regexp_extract_all({}, '!\\[[^\\]\\n]*\\]\\(([^)\\n]*)\\)', 1)",
        "comments": "list_transform(regexp_extract_all({}, '(?s)<!--(.*?)-->', 1), lambda x: trim(x))", "tags": f"list_transform(regexp_extract_all(regexp_replace({bare}, '(?s)<!--.*?-->', ' ', 'g'), '</?[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x))",
    }


def _unequal(rule: str) -> str:
    return f"({rule.replace('{}', 'source').replace('{{', '{').replace('}}', '}')}) <> ({rule.replace('{}', 'expected').replace('{{', '{').replace('}}', '}')})"


_DENIED = {
    "en": "no|not|never|none|nobody|nothing|neither|nor|cannot|without", "es": "no|nunca|jamás|nadie|nada|ninguno|ninguna|tampoco|sin", "fr": "ne|jamais|personne|rien|aucun|aucune|sans",
    "de": "nicht|kein|keine|keinen|nie|niemals|niemand|nichts|ohne", "pt": "não|nunca|jamais|ninguém|nada|nenhum|nenhuma|sem", "it": "non|mai|nessuno|niente|nulla|nessuna|senza",
}


def _denied(text: str, code: str) -> str:
    flat = f"' ' || regexp_replace(regexp_replace(lower({text}), 'n[’''’]t([^\\p{{L}}]|$)', ' not\\1', 'g'), '[^\\p{{L}}]+', '  ', 'g') || ' '"
    return "CASE " + " ".join(f"WHEN {code} = '{c}' THEN len(regexp_extract_all({flat}, ' (?:{w}) '))" for c, w in _DENIED.items()) + " END"


SQL: dict[str, str] = {
    "block_alignment": f"""
        SELECT id, len(a) AS source_blocks, len(b) AS target_blocks, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: trim(a[i], chr(10)) = trim(b[i], chr(10)))) AS unchanged
        FROM (SELECT id, {_pieces('source')} AS a, {_pieces('expected')} AS b FROM {CASES}) WHERE len(a) > 0 OR len(b) > 0""",
    "number_conservation": _NUMBERS,
    "symbol_conservation": _conserved(D.symbol_tokens("{}")),
    "number_fidelity": f"""
        WITH {NUMBERS}, n AS ({_NUMBERS}),
        c AS (SELECT DISTINCT id, source, expected, {D.language_code('source_lang')} AS sl, {D.language_code('target_lang')} AS tl FROM translation_cases WHERE source IS NOT NULL AND expected IS NOT NULL),
        said AS (SELECT id, lang, unnest(regexp_extract_all({FLAT_WORDS.format('source')}, pattern, 1)) AS w, 1 AS d FROM c JOIN runs ON lang = sl
            UNION ALL SELECT id, lang, unnest(regexp_extract_all({FLAT_WORDS.format('expected')}, pattern, 1)), -1 FROM c JOIN runs ON lang = tl),
        spare AS (SELECT id, v, sum(d) AS spoken FROM said JOIN words ON words.lang = said.lang AND words.w = replace(said.w, '  ', ' ') GROUP BY ALL HAVING sum(d) > 0),
        x AS (SELECT n.*, CASE WHEN regexp_full_match(token, '[0-9]{{1,9}}') AND added > 0 THEN token::INT END AS v FROM n)
        SELECT x.id, token, missing, added, CASE WHEN spoken IS NULL THEN 0 ELSE greatest(0, least(added, spoken - coalesce(sum(added) OVER (PARTITION BY x.id, x.v ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END::INT AS explained
        FROM x LEFT JOIN spare ON spare.id = x.id AND spare.v = x.v""",
    "code_conservation": _conserved("regexp_extract_all({}, '`([^`\\n]+)`', 1)"),
    "address_conservation": _URLS,
    "coverage_ratio": _COVER,
    "issue_totals": f"""
        SELECT kind, count(*) AS cases FROM (
            SELECT DISTINCT 'numbers' AS kind, id FROM ({_NUMBERS}) UNION ALL SELECT DISTINCT 'addresses', id FROM ({_URLS})
            UNION ALL SELECT concat('coverage_', issue), id FROM ({_COVER}) WHERE issue IS NOT NULL) GROUP BY kind""",
    "revision_risk": f"""
        SELECT name, response_no, 'high' AS risk, reason FROM (
            SELECT name, response_no, CASE WHEN list_sort({D.number_tokens('expected')}) <> list_sort({D.number_tokens('answer')}) THEN 'numbers'
                WHEN ({_jumps('answer')} AND NOT {_jumps('expected')}) OR (len({_levels('expected')}) = 0 AND coalesce(list_max({_levels('answer')}) > 3, false)) THEN 'structure'
                WHEN (trim(expected) = '') <> (trim(answer) = '') THEN 'emptied'
                WHEN {_names('expected')} <> {_names('answer')} THEN 'names'
                WHEN {_headings_only('expected')} AND {_headings_only('answer')} AND trim(expected) <> '' AND trim(expected) <> trim(answer) THEN 'headings'
                WHEN {_nblocks('expected')} <> {_nblocks('answer')} THEN 'blocks'
                WHEN len({_words('expected')}) >= 8 AND (len({_words('answer')}) / len({_words('expected')}) < 0.8 OR len({_words('answer')}) / len({_words('expected')}) > 1.25) THEN 'length'
                ELSE 'none' END AS reason
            FROM {ANSWERS}) WHERE reason <> 'none'""",
    "page_overlap": f"""
        SELECT identifier, tokens, shared, round(shared / tokens, 6) AS share FROM (
            SELECT identifier, len(p) AS tokens, len(list_intersect(p, w)) AS shared FROM (
                SELECT identifier, list_distinct(flatten(list({_words('markdown')}))) AS p, list_distinct(flatten(list({_words('primary_markdown')}))) AS w
                FROM pdf_review_issues JOIN (SELECT DISTINCT export_id, primary_markdown FROM markdown_exports) USING (export_id)
                WHERE markdown IS NOT NULL AND primary_markdown IS NOT NULL GROUP BY identifier)) WHERE tokens > 0""",
    "glossary_hits": f"""
        WITH c AS (SELECT DISTINCT id, source, expected, glossary FROM translation_cases WHERE source IS NOT NULL AND glossary IS NOT NULL),
        e AS (SELECT id, source, expected, glossary, unnest(glossary) AS g FROM c),
        x AS (SELECT id, g.source AS term, g.target AS wanted, {_hidden('source', 'source')} AS s, {_hidden("coalesce(expected, '')", 'target')} AS t FROM e WHERE trim(g.source) <> '')
        SELECT DISTINCT id, term, wanted, coalesce({_whole('t', 'wanted')} AND trim(wanted) <> '', false) AS in_target FROM x WHERE {_whole('s', 'term')}""",
    "strict_findings": " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS cases FROM {CASES} WHERE {_unequal(rule)} HAVING count(*) > 0" for name, rule in _strict().items()),
    "heading_fidelity": f"""
        SELECT id, CASE WHEN len(b) < len(a) THEN 'missing' WHEN len(b) > len(a) THEN 'added' ELSE 'levels' END AS issue, array_to_string(a, ' ') AS expected, array_to_string(b, ' ') AS actual
        FROM (SELECT id, {_levels('source')} AS a, {_levels('expected')} AS b FROM {CASES}) WHERE a <> b""",
    "heading_variants": f"""
        SELECT id, heading, count(DISTINCT other) AS variants FROM (SELECT id, lower(trim(unnest(a))) AS heading, lower(trim(unnest(b))) AS other FROM (
            SELECT id, {_HEADS.format(D.unix('source'))} AS a, {_HEADS.format(D.unix('expected'))} AS b FROM {CASES}) WHERE len(a) = len(b)) GROUP BY ALL HAVING count(DISTINCT other) > 1""",
    "polarity_pairs": f"""
        SELECT id, a AS source_denials, b AS target_denials FROM (
            SELECT id, {_denied('source', 'sl')} AS a, {_denied('expected', 'tl')} AS b
            FROM (SELECT DISTINCT id, source, expected, {D.language_code('source_lang')} AS sl, {D.language_code('target_lang')} AS tl FROM translation_cases WHERE source IS NOT NULL AND expected IS NOT NULL)) WHERE (a = 0) <> (b = 0)""",
    "glossary_duplicates": """
        SELECT id, lower(g.source) AS term, count(*) AS n FROM (SELECT id, unnest(glossary) AS g FROM (SELECT DISTINCT id, glossary FROM translation_cases WHERE glossary IS NOT NULL))
        WHERE g.source IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        number_conservation, number_fidelity, roman_conservation, code_conservation, symbol_conservation, address_conservation, coverage_ratio, block_alignment, issue_totals, revision_risk, revision_rewrites, revision_hunks,
        near_duplicate_blocks, page_overlap, glossary_hits, glossary_duplicates, strict_findings, heading_fidelity, heading_variants, polarity_pairs, segment_issues,
    )
}
