"""Queries over the texts of documents, exports and review pages, with SQL that another engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions import text as T
from ..operators import blocks as B
from ..operators import consensus as C
from ..operators import fidelity as V
from ..session import table


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def _exports(s: SparkSession, d: str) -> DataFrame:
    """Exports with a text, repeated rows once."""
    return table(s, d, "markdown_exports").where("primary_markdown is not null").select("export_id", "primary_markdown").distinct()


EXPORTS = "(SELECT DISTINCT export_id, primary_markdown FROM markdown_exports WHERE primary_markdown IS NOT NULL)"


def doc_quality_score(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", T.quality(F.col("text")).alias("score"))


def quality_by_source(s: SparkSession, d: str) -> DataFrame:
    q = _documents(s, d).select("source", T.quality(F.col("text")).alias("score"))
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") < 0.48).alias("poor"))


def prose_text(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", T.prose(F.col("text")).alias("prose"))


def letter_counts(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", T.letters(F.col("text")).alias("letters"))


def text_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", F.sha2(T.canonical(F.col("text")), 256).alias("fingerprint"))


def excerpts(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def title_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("title is not null").select("doc_id", T.slug(F.col("title")).alias("slug"))


def language_codes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(T.language_code(F.col("lang")).alias("code")).agg(F.count(F.lit(1)).alias("docs"))


def number_tokens(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", F.explode(T.number_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def symbol_tokens(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", F.explode(T.symbol_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def link_targets(s: SparkSession, d: str) -> DataFrame:
    x = _exports(s, d).select("export_id", F.explode(T.link_targets(F.col("primary_markdown"))).alias("target"))
    return x.groupBy("export_id", "target").agg(F.count(F.lit(1)).alias("n"))


def conversion_damage(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).where(T.damaged(F.col("text"))).select("doc_id")


def title_lines(s: SparkSession, d: str) -> DataFrame:
    x = B.explode_lines(_exports(s, d), "export_id", "primary_markdown").where(~F.col("fenced") & T.title_like(F.col("line")))
    return x.select("export_id", "line_no", "line")


def structural_ledger(s: SparkSession, d: str) -> DataFrame:
    return B.ledger(_exports(s, d), "export_id", "primary_markdown")


def heading_levels(s: SparkSession, d: str) -> DataFrame:
    return B.headings(_exports(s, d), "export_id", "primary_markdown")


def heading_outline(s: SparkSession, d: str) -> DataFrame:
    return B.outline(heading_levels(s, d), "export_id").select("export_id", "heading_no", "parent_no", "level")


def text_blocks(s: SparkSession, d: str) -> DataFrame:
    return B.with_ids(B.explode_blocks(_exports(s, d), "export_id", "primary_markdown"), "export_id").select("export_id", "position", "ordinal", "block_id")


def block_roles(s: SparkSession, d: str) -> DataFrame:
    b = B.explode_blocks(_exports(s, d), "export_id", "primary_markdown")
    return b.groupBy("export_id", B.role(F.col("block")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def table_shapes(s: SparkSession, d: str) -> DataFrame:
    return B.tables(_exports(s, d), "export_id", "primary_markdown")


def chapter_split(s: SparkSession, d: str) -> DataFrame:
    c = B.chapters(_exports(s, d), "export_id", "primary_markdown")
    return c.select("export_id", "chapter_no", "start_line", "lines", F.sha2("chapter", 256).alias("fingerprint"))


def page_marks(s: SparkSession, d: str) -> DataFrame:
    p = B.page_fill(_exports(s, d), "export_id", "primary_markdown").where("page is not null")
    return p.groupBy("export_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"))


def tag_counts(s: SparkSession, d: str) -> DataFrame:
    return V.tag_counts(_exports(s, d), "export_id", "primary_markdown")


def list_breaks(s: SparkSession, d: str) -> DataFrame:
    return V.list_breaks(_exports(s, d), "export_id", "primary_markdown")


def block_context(s: SparkSession, d: str) -> DataFrame:
    return V.context(B.explode_blocks(_exports(s, d), "export_id", "primary_markdown"), "export_id", "position", "block", 40)


def publication_years(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", T.publication_year(F.col("text")).alias("year")).where("year is not null")


def emphasis_stretches(s: SparkSession, d: str) -> DataFrame:
    return V.emphasis_pairs(_exports(s, d), "export_id", "primary_markdown").groupBy("export_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def chunk_plan(s: SparkSession, d: str) -> DataFrame:
    b = B.explode_blocks(_exports(s, d), "export_id", "primary_markdown")
    p = B.plan_chunks(b, "export_id")
    return p.groupBy("export_id", "chunk_no").agg(F.count(F.lit(1)).alias("blocks"), F.sum("chars").alias("chars"))


def word_counts(s: SparkSession, d: str) -> DataFrame:
    return C.corpus_counts(_documents(s, d), "doc_id", "text")


def doc_terms(s: SparkSession, d: str) -> DataFrame:
    return C.terms(_documents(s, d), "doc_id", "text")


def spelling_outliers(s: SparkSession, d: str) -> DataFrame:
    return C.spelling_outliers(_documents(s, d), "doc_id", "text")


def repeated_margins(s: SparkSession, d: str) -> DataFrame:
    return C.repeated_lines(table(s, d, "pdf_review_issues"), "export_id", "page_number", "markdown")


def duplicate_documents(s: SparkSession, d: str) -> DataFrame:
    return C.duplicate_classes(_documents(s, d), "doc_id", "text")


def format_sizes(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "part")
    return x.select("p_partkey", T.alphabetic_index(F.col("p_size")).alias("mark"), T.format_bytes(F.col("p_partkey") * F.col("p_size") * 37).alias("bytes"), T.format_duration(F.col("p_partkey") * F.col("p_size")).alias("duration"))


_LINES = f"""
    lines AS (
        SELECT export_id, unnest(string_split({D.unix('primary_markdown')}, chr(10))) AS line,
               generate_subscripts(string_split({D.unix('primary_markdown')}, chr(10)), 1) - 1 AS line_no
        FROM {EXPORTS} WHERE primary_markdown <> ''
    ),
    marked AS (SELECT *, regexp_matches(line, '^[ \\t]{{0,3}}(?:```|~~~)') AS mark FROM lines),
    fenced AS (
        SELECT *, mark OR coalesce(sum(mark::INT) OVER (PARTITION BY export_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced
        FROM marked
    )"""
_BLOCKS = (
    _LINES
    + """,
    blanks AS (SELECT *, NOT fenced AND regexp_replace(line, '[ \\t\\f]', '', 'g') = '' AS blank FROM fenced),
    starts AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY export_id ORDER BY line_no), true) AS opens FROM blanks),
    placed AS (SELECT *, sum(opens::INT) OVER (PARTITION BY export_id ORDER BY line_no) - 1 AS position FROM starts),
    blocks AS (
        SELECT export_id, CAST(position AS BIGINT) AS position, string_agg(line, chr(10) ORDER BY line_no) AS block
        FROM placed WHERE NOT blank GROUP BY ALL
    )"""
)
_HEADINGS = (
    _LINES
    + """,
    heads AS (
        SELECT export_id, line_no, length(regexp_extract(line, '^[ \\t]{0,3}(#{1,6})', 1)) AS level,
               trim(regexp_replace(regexp_replace(line, '^[ \\t]{0,3}#{1,6}[ \\t]+', ''), '[ \\t]#+[ \\t]*$', '')) AS title,
               row_number() OVER (PARTITION BY export_id ORDER BY line_no) - 1 AS heading_no
        FROM fenced WHERE NOT fenced AND regexp_matches(line, '^[ \\t]{0,3}#{1,6}[ \\t]')
    )"""
)
_N = lambda p: D.count_of("t", p)
DOCS = "documents WHERE text IS NOT NULL"

SQL: dict[str, str] = {
    "doc_quality_score": f"SELECT doc_id, {D.quality('text')} AS score FROM {DOCS}",
    "quality_by_source": f"""
        SELECT source, count(*) AS docs, round(avg(score), 4) AS mean_score, count(*) FILTER (score < 0.48) AS poor
        FROM (SELECT source, {D.quality('text')} AS score FROM {DOCS}) GROUP BY source""",
    "prose_text": f"SELECT doc_id, {D.prose('text')} AS prose FROM {DOCS}",
    "letter_counts": f"SELECT doc_id, {D.letters('text')} AS letters FROM {DOCS}",
    "text_fingerprints": f"""
        SELECT doc_id, sha256(regexp_replace(regexp_replace({D.unix('text')}, '(?m)[ \\t]+$', '', 'g'), '\\A\\n+|\\n+\\z', '', 'g')) AS fingerprint FROM {DOCS}""",
    "excerpts": f"""
        SELECT doc_id, CASE WHEN length(flat) <= 80 THEN flat ELSE concat(rtrim(substring(flat, 1, 79)), '…') END AS excerpt
        FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS flat FROM {DOCS})""",
    "title_slugs": """
        SELECT doc_id, CASE WHEN x = '' THEN 'item' ELSE x END AS slug FROM (
            SELECT doc_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS x
            FROM documents WHERE title IS NOT NULL)""",
    "language_codes": f"SELECT {D.language_code('lang')} AS code, count(*) AS docs FROM documents GROUP BY 1",
    "number_tokens": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({D.number_tokens('text')}) AS token FROM {DOCS}) GROUP BY ALL",
    "symbol_tokens": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({D.symbol_tokens('text')}) AS token FROM {DOCS}) GROUP BY ALL",
    "link_targets": f"""
        SELECT export_id, target, count(*) AS n FROM (SELECT export_id, unnest(regexp_extract_all({D.unix('primary_markdown')}, {D.q(r'!?\[[^\]\n]*\]\(<?([^)>\n]+)>?\)')}, 1)) AS target FROM {EXPORTS}) GROUP BY ALL""",
    "title_lines": f"""
        WITH {_LINES} SELECT export_id, line_no::INT AS line_no, line FROM fenced WHERE NOT fenced AND (
            regexp_matches(line, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]') OR ({D.letters('line')} > 0 AND {D.count_of('line', '[^ \\t\\n]+')} <= 12
            AND length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) >= 0.8::DOUBLE * {D.letters('line')}))""",
    "structural_ledger": f"""
        SELECT export_id, {_N(r'(?m)^[ \t]{0,3}#{1,6}[ \t]')} AS headings, {_N(r'!\[[^\]\n]*\]\([^)\n]*\)')} AS images,
            {_N(r'\[[^\]\n]*\]\([^)\n]*\)')} - {_N(r'!\[[^\]\n]*\]\([^)\n]*\)')} AS links,
            {_N(r'(?m)^[ \t]{0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]')} AS list_items, {_N(r'(?m)^[ \t]{0,3}>')} AS quote_lines,
            {_N(r'(?m)^[ \t]*\|')} AS table_lines, {_N('<!--')} AS comments, {_N(r'(?m)^[ \t]{0,3}```')} AS fence_marks
        FROM (SELECT export_id, {D.unix('primary_markdown')} AS t FROM {EXPORTS})""",
    "heading_levels": f"WITH {_HEADINGS} SELECT export_id, heading_no, line_no, level, title FROM heads",
    "heading_outline": f"""
        WITH {_HEADINGS} SELECT a.export_id, a.heading_no, a.level,
            (SELECT max(b.heading_no) FROM heads b WHERE b.export_id = a.export_id AND b.heading_no < a.heading_no AND b.level < a.level) AS parent_no
        FROM heads a""",
    "text_blocks": f"""
        WITH {_BLOCKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY export_id, sha256(block) ORDER BY position) - 1 AS ordinal FROM blocks)
        SELECT export_id, position, ordinal, substring(sha256(concat_ws('|', 'block-1', sha256(block), CAST(ordinal AS VARCHAR))), 1, 20) AS block_id FROM numbered""",
    "block_roles": f"""
        WITH {_BLOCKS} SELECT export_id, CASE
            WHEN regexp_matches(block, '^[ \\t]*<!--') THEN 'provenance'
            WHEN regexp_matches(block, '^[ \\t]{{0,3}}(?:```|~~~)') THEN 'code'
            WHEN regexp_matches(block, '^[ \\t]*!\\[[^\\]]*\\]\\([^)]*\\)[ \\t]*$') THEN 'image'
            WHEN regexp_matches(block, '(?m)^[ \\t]*\\|?[ \\t]*:?-{{3,}}:?[ \\t]*(?:\\|[ \\t]*:?-{{3,}}:?[ \\t]*)+\\|?[ \\t]*$') THEN 'table'
            WHEN regexp_matches(block, '^[ \\t]*(?:Note|Notes|Nota|Notas|Hinweis|Remarque)[ \\t]*[:.]') THEN 'note'
            WHEN regexp_matches(block, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]') THEN 'heading'
            WHEN regexp_matches(block, '^[ \\t]{{0,3}}(?:[-*+]|[0-9]{{1,9}}[.)])[ \\t]') THEN 'list'
            WHEN regexp_matches(block, '^[ \\t]*>') THEN 'quote' ELSE 'body' END AS role, count(*) AS n
        FROM blocks GROUP BY ALL""",
    "table_shapes": f"""
        WITH {_LINES}, piped AS (SELECT *, NOT fenced AND regexp_matches(line, '^[ \\t]*\\|.*\\|[ \\t]*$') AS p FROM fenced),
        runs AS (SELECT *, sum((p AND NOT coalesce(before, false))::INT) OVER (PARTITION BY export_id ORDER BY line_no) AS run
                 FROM (SELECT *, lag(p) OVER (PARTITION BY export_id ORDER BY line_no) AS before FROM piped)),
        shapes AS (SELECT export_id, run, min(line_no) AS line_no, count(*) FILTER (NOT divider) AS rows, max(cells) AS columns, count(*) FILTER (divider) AS dividers
                   FROM (SELECT *, regexp_matches(line, '^[ \\t]*\\|(?:[ \\t]*:?-{{3,}}:?[ \\t]*\\|)+[ \\t]*$') AS divider,
                                len(string_split(regexp_replace(line, '^[ \\t]*\\||\\|[ \\t]*$', '', 'g'), '|')) AS cells FROM runs WHERE p) GROUP BY ALL)
        SELECT export_id, row_number() OVER (PARTITION BY export_id ORDER BY line_no) - 1 AS table_no, rows, columns FROM shapes WHERE dividers >= 1""",
    "chapter_split": f"""
        WITH {_LINES}, levelled AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]') THEN length(regexp_extract(line, '^[ \\t]{{0,3}}(#{{1,6}})', 1)) END AS level FROM fenced),
        cuts AS (SELECT export_id, min(level) AS cut FROM (SELECT export_id, level FROM levelled WHERE level IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
        placed AS (SELECT l.*, sum(coalesce(l.level = c.cut, false)::INT) OVER (PARTITION BY l.export_id ORDER BY line_no) AS chapter_no FROM levelled l LEFT JOIN cuts c USING (export_id))
        SELECT export_id, chapter_no::BIGINT AS chapter_no, min(line_no) AS start_line, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS fingerprint FROM placed GROUP BY ALL""",
    "page_marks": f"""
        WITH {_LINES}, pages AS (SELECT export_id, line_no, last_value(CASE WHEN regexp_extract(line, '^[ \\t]*<!-- page ([0-9]{{1,6}}) -->', 1) <> '' THEN regexp_extract(line, '^[ \\t]*<!-- page ([0-9]{{1,6}}) -->', 1)::INT END IGNORE NULLS)
            OVER (PARTITION BY export_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM lines)
        SELECT export_id, page, count(*) AS lines, min(line_no) AS first_line FROM pages WHERE page IS NOT NULL GROUP BY ALL""",
    "chunk_plan": f"""
        WITH RECURSIVE {_BLOCKS}, facts AS (
            SELECT export_id, position, length(block) AS n, len(regexp_extract_all(block, '[+-]?[0-9]+(?:[.,:/-][0-9]+)*')) + len(regexp_extract_all(block, '[$€£¥₹₿%‰‱]')) + len(regexp_extract_all(block, 'https?://')) AS v,
                NOT regexp_matches(block, '^[ \\t]*<!--') AND NOT regexp_matches(block, '^[ \\t]{{0,3}}(?:```|~~~)') AND NOT regexp_matches(block, '^[ \\t]*!\\[[^\\]]*\\]\\([^)]*\\)[ \\t]*$')
                AND (regexp_matches(block, '(?m)^[ \\t]*\\|?[ \\t]*:?-{{3,}}:?[ \\t]*(?:\\|[ \\t]*:?-{{3,}}:?[ \\t]*)+\\|?[ \\t]*$')
                    OR (regexp_matches(block, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]') AND NOT regexp_matches(block, '^[ \\t]*(?:Note|Notes|Nota|Notas|Hinweis|Remarque)[ \\t]*[:.]'))) AS alone FROM blocks),
        walk AS (
            SELECT export_id, position, 0 AS chunk_no, n AS used, v AS held, n, alone FROM facts WHERE position = 0
            UNION ALL
            SELECT f.export_id, f.position, CASE WHEN s.fits THEN w.chunk_no ELSE w.chunk_no + 1 END, CASE WHEN s.fits THEN w.used + f.n + 2 ELSE f.n END, CASE WHEN s.fits THEN w.held + f.v ELSE f.v END, f.n, f.alone
            FROM walk w JOIN facts f ON f.export_id = w.export_id AND f.position = w.position + 1, LATERAL (SELECT NOT w.alone AND NOT f.alone AND w.used + f.n + 2 <= 4000 AND w.held + f.v <= 16 AS fits) s)
        SELECT export_id, chunk_no, count(*) AS blocks, sum(n)::BIGINT AS chars FROM walk GROUP BY ALL""",
    "tag_counts": f"""
        SELECT export_id, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, count(*) FILTER (NOT starts_with(t, '</')) AS opened,
            count(*) FILTER (starts_with(t, '</') OR ends_with(t, '/>') OR lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) IN ('br', 'hr', 'img', 'meta', 'link', 'input', 'col')) AS closed
        FROM (SELECT export_id, unnest(regexp_extract_all(regexp_replace(regexp_replace({D.unix('primary_markdown')}, '(?s)<!--.*?-->', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), '</?[A-Za-z][A-Za-z0-9]*(?:[ \\t][^<>\\n]*)?/?>')) AS t FROM {EXPORTS}) GROUP BY ALL""",
    "list_breaks": f"""
        WITH l AS (SELECT export_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM (SELECT export_id, {D.unix('primary_markdown')} AS t FROM {EXPORTS})),
        x AS (SELECT export_id, line_no, TRY_CAST(regexp_extract(line, '^[ \\t]{{0,3}}([0-9]{{1,6}})[.)][ \\t]', 1) AS INT) AS stated FROM l WHERE trim(line) <> ''),
        y AS (SELECT *, lag(stated) OVER (PARTITION BY export_id ORDER BY line_no) AS before FROM x)
        SELECT export_id, line_no::INT AS line_no, stated, before + 1 AS expected FROM y WHERE stated IS NOT NULL AND before IS NOT NULL AND stated <> 1 AND stated <> before + 1""",
    "block_context": f"""
        WITH {_BLOCKS}, f AS (SELECT export_id, position, trim(regexp_replace(block, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM blocks)
        SELECT export_id, position, right(lag(t) OVER w, 40) AS before, left(lead(t) OVER w, 40) AS after FROM f WINDOW w AS (PARTITION BY export_id ORDER BY position)""",
    "publication_years": f"""
        SELECT doc_id, years[len(years)] AS year FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[0-9]{{5,}}', ' ', 'g'), '(?:1[4-9]|20)[0-9][0-9]'), lambda y: y::INT), lambda y: y >= 1450) AS years FROM {DOCS})
        WHERE len(years) > 0""",
    "spelling_outliers": f"""
        WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}{{6,}}')) AS word FROM {DOCS}) GROUP BY ALL),
        near AS (SELECT a.doc_id, a.word, b.word AS good FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.n = 1 AND b.n >= 4 AND lower(left(a.word, 3)) = lower(left(b.word, 3)) AND lower(right(a.word, 2)) = lower(right(b.word, 2))
            WHERE {D.one_edit('lower(a.word)', 'lower(b.word)', True)})
        SELECT doc_id, word, min(good) AS "right" FROM near GROUP BY ALL HAVING count(*) = 1""",
    "conversion_damage": f"""
        WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+|[^\\p{{L}}]+') AS x FROM {DOCS})
        SELECT doc_id FROM w WHERE contains(text, chr(65533)) OR regexp_matches(text, '(?:^|[^\\p{{L}}0-9_])(?:\\p{{L}} ){{5,}}\\p{{L}}')
            OR len(list_filter(range(1, len(x) - 3), lambda i: length(x[i]) >= 2 AND regexp_matches(x[i], '^\\p{{L}}') AND x[i] = x[i + 2] AND x[i] = x[i + 4] AND regexp_full_match(x[i + 1], '[ \\t\\n]+') AND regexp_full_match(x[i + 3], '[ \\t\\n]+'))) > 0""",
    "word_counts": f"""
        SELECT word, sum(n)::BIGINT AS n, count(*) AS documents FROM (
            SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM {DOCS}) GROUP BY ALL) GROUP BY word""",
    "doc_terms": f"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all({D.prose('text')}, {D.q(r'\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+')})) AS term FROM {DOCS}),
        spelt AS (SELECT doc_id, lower(term) AS low, term, count(*) AS n FROM t WHERE length(term) <= 80 GROUP BY ALL),
        best AS (SELECT doc_id, low, sum(n)::BIGINT AS n, first(term ORDER BY spelt.n DESC, term) AS term FROM spelt GROUP BY ALL HAVING sum(n) >= 2)
        SELECT doc_id, term, n FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(term) DESC, term) <= 50""",
    "repeated_margins": f"""
        WITH p AS (SELECT DISTINCT export_id, page_number, list_filter(string_split({D.unix('markdown')}, chr(10)), lambda x: trim(x) <> '') AS l FROM pdf_review_issues WHERE markdown IS NOT NULL),
        e AS (SELECT export_id, page_number, l[1] AS line FROM p UNION SELECT export_id, page_number, l[-1] FROM p),
        f AS (SELECT DISTINCT export_id, page_number, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS line FROM e WHERE line IS NOT NULL)
        SELECT export_id, line, count(DISTINCT page_number) AS pages FROM f WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT page_number) >= 3""",
    "duplicate_documents": f"""
        WITH h AS (SELECT doc_id, regexp_replace(regexp_replace({D.unix('text')}, '(?m)[ \\t]+$', '', 'g'), '\\A\\n+|\\n+\\z', '', 'g') AS t FROM {DOCS})
        SELECT doc_id, class_id, copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS copies FROM h) WHERE copies > 1""",
    "format_sizes": """
        SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE concat(chr(CAST(64 + (p_size - 1) // 26 AS INT)), chr(CAST(65 + (p_size - 1) % 26 AS INT))) END AS mark,
            CASE WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN concat(CAST(round(b / 1024.0::DOUBLE, 1) AS DECIMAL(18,1)), ' KiB') ELSE concat(CAST(round(b / 1048576.0::DOUBLE, 1) AS DECIMAL(18,1)), ' MiB') END AS bytes,
            CASE WHEN t < 60 THEN concat(t, ' s') WHEN t < 3600 THEN concat(t // 60, ' min ', t % 60, ' s') ELSE concat(t // 3600, ' h ', (t % 3600) // 60, ' min') END AS duration
        FROM (SELECT p_partkey, p_size, p_partkey * p_size * 37 AS b, p_partkey * p_size AS t FROM part)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        doc_quality_score, quality_by_source, prose_text, letter_counts, text_fingerprints, excerpts, title_slugs, language_codes, number_tokens, symbol_tokens,
        link_targets, conversion_damage, title_lines, structural_ledger, heading_levels, heading_outline, text_blocks, block_roles, table_shapes, chapter_split,
        page_marks, chunk_plan, tag_counts, list_breaks, block_context, publication_years, emphasis_stretches, word_counts, doc_terms, spelling_outliers, repeated_margins, duplicate_documents, format_sizes,
    )
}
