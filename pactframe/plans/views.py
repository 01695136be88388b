"""Inputs in the shapes of the operators, derived from the given tables.

Each view is one SQL text over the base tables (written ``@orders``). The text
runs unchanged in Spark and in DuckDB; where the engines differ (exploding an
array) a pair ``(spark, duckdb)`` is kept.
"""

from __future__ import annotations

import re

_I = "CAST({} AS BIGINT)"


def _div(a: str, n: int) -> str:
    return f"CAST(({a} - {a} % {n}) / {n} AS BIGINT)"


VIEWS: dict[str, str | tuple[str, str]] = {}

VIEWS["v_documents"] = """
SELECT doc_id AS document_id, concat('doc/', CAST(doc_id AS STRING), '.txt') AS path, source AS filename,
       text, n_chars, lang
  FROM @documents"""

VIEWS["v_runs"] = """
SELECT o_orderkey AS analysis_id, o_orderkey AS seq, o_custkey AS document_id, o_orderpriority AS surface,
       CASE WHEN o_orderkey % 23 = 0 THEN 'interrupted' WHEN o_orderkey % 19 = 0 THEN 'cancelled'
            WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'failed'
            WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'running'
            WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 1 THEN 'queued' ELSE 'done' END AS status,
       o_orderdate AS created_at, o_totalprice / 10000 AS cost_usd,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 10 END AS job_duration_s,
       5 AS criteria_requested, CAST(o_orderkey % 6 AS INT) AS criteria_completed,
       CAST(o_orderkey % 2 AS INT) AS criteria_skipped,
       CAST(o_orderkey % 900 AS BIGINT) AS input_tokens, CAST(o_orderkey % 300 AS BIGINT) AS output_tokens,
       CAST(o_orderkey % 7 AS BIGINT) AS tool_calls,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS needs_review,
       CAST(o_orderkey % 3 AS INT) AS capped,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 64) / 64 END AS mean_confidence,
       10 AS quotes_total, CAST(10 - o_orderkey % 3 AS INT) AS quotes_verified
  FROM @orders"""

VIEWS["v_spans"] = f"""
SELECT event_id AS span_id,
       CASE WHEN event_id % 64 = 0 THEN NULL
            WHEN event_id % 97 = 0 THEN event_id
            WHEN event_id % 89 = 0 THEN event_id + 1000000000000
            ELSE event_id - event_id % 64 + CAST(floor((event_id % 64 - 1) / 3) AS BIGINT) END AS parent_span_id,
       {_div('event_id', 64)} AS run_id,
       CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'agent.tool' WHEN 'purchase' THEN 'agent.call'
                       WHEN 'signup' THEN 'chat' ELSE 'ingest.embed' END AS name,
       CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
       value AS latency_ms, ts,
       CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('m', CAST(user_id % 4 AS STRING)) END AS model,
       value / 1000 AS cost_usd, event_id % 900 AS input_tokens, event_id % 300 AS output_tokens,
       event_id % 70 AS cache_read_tokens, event_id % 40 AS cache_write_tokens,
       CASE WHEN event_id % 31 = 0 THEN '[1, 2]' WHEN event_id % 37 = 0 THEN '{{broken'
            WHEN event_id % 41 = 0 THEN NULL ELSE props END AS attrs
  FROM @events"""

VIEWS["v_upstream"] = """
SELECT event_id, ts,
       CASE event_type WHEN 'error' THEN 'upstream.retry' WHEN 'signup' THEN 'upstream.failed' ELSE 'upstream.call' END AS name,
       CASE WHEN event_type IN ('error', 'signup') AND event_id % 13 <> 0
            THEN concat('{"reason": "HTTP ', CAST(500 + event_id % 5 AS STRING), '"}') END AS attrs
  FROM @events"""

VIEWS["v_samples"] = """
SELECT ts, event_id AS seq, value AS rss_mb, value / 1000 AS rss_pct,
       (event_id % 100) / 100 AS disk_used_pct FROM @events"""

#: One row per (run, line): the repeated pairs of the source keep the lowest part.
VIEWS["v_criterion_rows"] = (
    """
SELECT l_orderkey AS run_id, l_linenumber AS line, r.* FROM (
  SELECT l_orderkey, l_linenumber,
         min(struct(l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag,
                    l_linestatus, l_shipdate)) AS r
    FROM @lineitem GROUP BY l_orderkey, l_linenumber)""",
    """
SELECT run_id, line, r.l_partkey, r.l_suppkey, r.l_extendedprice, r.l_quantity, r.l_discount, r.l_tax,
       r.l_returnflag, r.l_linestatus, r.l_shipdate FROM (
  SELECT l_orderkey AS run_id, l_linenumber AS line,
         min(struct_pack(l_partkey := l_partkey, l_suppkey := l_suppkey, l_extendedprice := l_extendedprice,
             l_quantity := l_quantity, l_discount := l_discount, l_tax := l_tax, l_returnflag := l_returnflag,
             l_linestatus := l_linestatus, l_shipdate := l_shipdate)) AS r
    FROM @lineitem GROUP BY l_orderkey, l_linenumber)""",
)

VIEWS["v_criterion_results"] = """
SELECT run_id, line AS criterion_id,
       CASE l_returnflag WHEN 'A' THEN 'Fully Compliant' WHEN 'N' THEN 'Partially Compliant' ELSE 'Non-Compliant' END AS state,
       1 - CAST(round(l_discount * 100) AS INT) / 64 AS raw_confidence,
       CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE 1 - CAST(round(l_tax * 100) AS INT) / 32 END AS critic_confidence,
       CAST(CAST(l_quantity AS INT) % 4 AS INT) AS verified,
       CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE 3 END AS claimed,
       CAST(l_partkey % 2 AS INT) AS needs_review,
       CASE WHEN l_suppkey % 7 = 0 THEN 'cap' ELSE 'model' END AS ended_by,
       l_extendedprice / 10000 AS cost_usd,
       CAST(l_partkey % 800 AS BIGINT) AS input_tokens, CAST(l_suppkey % 90 AS BIGINT) AS output_tokens,
       CAST(l_partkey % 5 AS BIGINT) AS tool_calls, CAST(l_suppkey % 3 AS INT) AS rounds,
       CASE WHEN l_partkey % 9 = 0 THEN 'unevaluated' WHEN l_partkey % 4 = 0 THEN 'fallback' ELSE 'accept' END AS verdict,
       CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey / 100 ELSE 0 END AS evaluator_cost_usd
  FROM v_criterion_rows"""

VIEWS["v_labels"] = """
SELECT concat(CAST(run_id AS STRING), '.', CAST(line AS STRING)) AS label, CAST(run_id AS STRING) AS parent,
       line AS ordinal, run_id AS document_id, line AS position
  FROM v_criterion_rows"""

VIEWS["v_vectors"] = """
SELECT vec_id AS chunk_id, label AS document_id, embedding FROM @embeddings"""

VIEWS["v_quotes"] = """
SELECT item_id AS quote_id, text AS quote FROM @benchmark"""

VIEWS["v_lines"] = (
    """
SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line, source, lang
  FROM @documents LATERAL VIEW posexplode(split(text, chr(10), -1)) t AS pos, line""",
    """
SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no,
       unnest(string_split(text, chr(10))) AS line, source, lang
  FROM @documents""",
)

#: The four blocks a page has of itself, once for its first line.
_PAGE_BLOCKS = " ".join(
    f"UNION ALL SELECT doc_id, line, source, {_div('line_no', 8)}, {n} FROM v_lines WHERE line_no % 8 = 0" for n in (0, 1, 8, 11))

# Letters whose capital is one letter in DuckDB and two or three in Spark.
_LONG = "ß" + "".join(chr(c) for start in (0x1F80, 0x1F90, 0x1FA0) for c in range(start, start + 8)) + "ᾳῃῳ"
_SHORT = "ẞ" + "".join(chr(c) for start in (0x1F88, 0x1F98, 0x1FA8) for c in range(start, start + 8)) + "ᾼῌῼ"
# Letters that have a capital in Spark (Unicode 16) and none in DuckDB.
_PLAIN = "".join(map(chr, (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))))


def _capital(letter: str) -> str:
    """One capital for one letter in Spark, as DuckDB's ``upper`` has it; a letter without such a capital stays."""
    return (f"CASE WHEN char_length(upper({letter})) > 1 THEN translate({letter}, '{_LONG}', '{_SHORT}') "
            f"WHEN {letter} <> '' AND contains('{_PLAIN}', {letter}) THEN {letter} ELSE upper({letter}) END")


#: Layout blocks: every line of a document is one of eight blocks of a page, with
#: a header, a heading, an equation and a footer of the page beside them.
#: Geometry, font and decoration follow from place and length.
_BLOCKS = f"""
SELECT doc_id, page, block_no, line_no, kind,
       CASE WHEN kind = 'header' THEN concat('Master agreement | page ', CAST(page + 1 AS STRING))
            WHEN kind = 'footer' THEN CAST(page + 1 AS STRING)
            WHEN kind = 'caption' THEN concat(CASE WHEN (page + block_no) % 2 = 0 THEN 'Figure ' ELSE 'Table ' END,
                 CAST(page + 1 AS STRING), '.', CAST(block_no AS STRING), ': ', line)
            WHEN kind = 'heading' THEN concat(CAST(page + 1 AS STRING), '. Scope of ', source)
            WHEN kind = 'clause' THEN concat(CAST(page + 1 AS STRING), '.', CAST(block_no - 1 AS STRING), ' ',
                 upper(substring(line, 1, 1)), substring(line, 2), ' See Figure ', CAST(page + 1 AS STRING), '.5.')
            WHEN kind = 'equation' THEN concat('E = ', CAST(length(line) AS STRING))
            WHEN kind = 'dots' THEN concat(line, ' ......... ', CAST(page AS STRING))
            ELSE line END AS text,
       CASE WHEN kind = 'equation' THEN 'CMMI10' ELSE 'Times' END AS font,
       CASE WHEN kind = 'heading' THEN 14.5 ELSE 11.0 END AS size,
       CASE WHEN kind = 'heading' AND line_no % 5 = 0 THEN 1 ELSE 0 END AS italic,
       CASE WHEN kind IN ('header', 'footer', 'heading', 'caption', 'equation') THEN 1 ELSE 1 + CAST(floor(length(line) / 90) AS INT) END AS n_lines,
       CASE WHEN line_no % 9 = 4 THEN 54.0 WHEN kind = 'equation' THEN 210.0 ELSE 36.0 END AS x0,
       CASE WHEN kind IN ('header', 'footer', 'heading', 'caption', 'equation') THEN 300.0
            WHEN length(line) % 4 = 0 THEN 480.0 ELSE 577.0 END AS x1,
       CASE WHEN kind = 'header' THEN 20.0 WHEN kind = 'footer' THEN 770.0 ELSE 60.0 + 58.0 * block_no END AS y0,
       CASE WHEN kind = 'header' THEN 32.0 WHEN kind = 'footer' THEN 782.0 ELSE 84.0 + 58.0 * block_no END AS y1,
       792.0 AS page_height
  FROM (SELECT *, CASE WHEN line_no % 12 = 0 THEN 'header' WHEN line_no % 12 = 11 THEN 'footer'
                    WHEN line_no % 12 = 5 OR line_no % 24 = 6 THEN 'caption' WHEN line_no % 12 = 1 THEN 'heading'
                    WHEN line_no % 12 IN (2, 3, 7) THEN 'clause' WHEN line_no % 12 = 8 THEN 'equation'
                    WHEN line_no % 36 = 10 THEN 'dots' ELSE 'text' END AS kind
          FROM (SELECT doc_id, line, source, page, block_no, page * 12 + block_no AS line_no FROM (
                  SELECT doc_id, line, source, {_div('line_no', 8)} AS page,
                         CAST(CASE line_no % 8 WHEN 6 THEN 9 WHEN 7 THEN 10 ELSE 2 + line_no % 8 END AS INT) AS block_no FROM v_lines
                  {_PAGE_BLOCKS}) l) n) b"""
VIEWS["v_blocks"] = (_BLOCKS.replace("upper(substring(line, 1, 1))", _capital("substring(line, 1, 1)")), _BLOCKS)

#: Sectioned elements of the same documents, as the chunker reads them.
VIEWS["v_elements"] = f"""
SELECT doc_id, line_no AS ord, page, CAST(page + 1 AS STRING) AS page_label,
       CASE WHEN kind IN ('header', 'footer') THEN 'furniture' WHEN kind = 'heading' THEN 'heading'
            WHEN kind = 'equation' THEN 'equation' WHEN kind = 'caption' AND (page + block_no) % 2 = 0 THEN 'figure'
            WHEN kind = 'caption' THEN 'table' ELSE 'paragraph' END AS type,
       text, concat('Part ', CAST({_div('page', 2)} + 1 AS STRING)) AS part,
       CASE WHEN page % 4 = 3 THEN 'Contents' ELSE concat(CAST(page + 1 AS STRING), '. Scope') END AS section,
       CASE WHEN doc_id % 3 = 0 THEN 'outline' WHEN doc_id % 3 = 1 THEN 'headings' ELSE 'none' END AS spine_source
  FROM v_blocks"""

#: Every longer line broken in two with a hyphen where it splits a word.
VIEWS["v_wrapped"] = """
SELECT doc_id, 2 * line_no AS line_no, CAST((line_no - line_no % 3) / 3 AS BIGINT) AS block,
       CASE WHEN length(line) < 30 THEN line WHEN line_no % 4 = 3 THEN substring(line, 1, 20)
            ELSE concat(substring(line, 1, 20), '-') END AS line FROM v_lines
UNION ALL
SELECT doc_id, 2 * line_no + 1, CAST((line_no - line_no % 3) / 3 AS BIGINT), substring(line, 21) FROM v_lines
 WHERE length(line) >= 30"""

#: Lines that open with, or contain, clause labels of every kind.
VIEWS["v_labelled"] = f"""
SELECT doc_id, line_no, CASE line_no % 9
       WHEN 0 THEN concat('Exhibit ', chr(CAST(65 + n % 26 AS INT)), ' ', line)
       WHEN 1 THEN concat(CAST(n + 1 AS STRING), '. ', line)
       WHEN 2 THEN concat(CAST(n + 1 AS STRING), '.1 ', line, ' ', CAST(n + 1 AS STRING), '.2 Further terms.')
       WHEN 3 THEN concat(CAST(n + 1 AS STRING), '.3. ', line)
       WHEN 4 THEN concat('(', chr(CAST(97 + n % 26 AS INT)), ') ', line)
       WHEN 5 THEN concat('(', CASE n % 3 WHEN 0 THEN 'ii' WHEN 1 THEN 'iii' ELSE 'iv' END, ') ', line)
       WHEN 6 THEN concat('G', CAST(n % 40 AS STRING), CASE WHEN n % 2 = 0 THEN 'A' ELSE '' END, '. ', line)
       WHEN 7 THEN concat(line, ' 7.7 See above.')
       ELSE line END AS text
  FROM (SELECT doc_id, line_no, line, {_div('line_no', 9)} AS n FROM v_lines) l"""

#: One two-row table per even page run, some of them continued on the next page.
VIEWS["v_tables"] = f"""
SELECT doc_id, page, line_no AS ord,
       CASE WHEN page % 3 = 2 OR doc_id % 4 = 0 THEN 60.0 ELSE 420.0 END AS y0,
       CASE WHEN page % 3 = 2 OR doc_id % 4 = 0 THEN 700.0 ELSE 780.0 END AS y1, page_height,
       CASE WHEN page % 5 = 4 THEN 'Ref|Control|Owner' ELSE 'Ref |Control' END AS header,
       concat('R', CAST(page AS STRING), '|', replace(text, '|', ' ')) AS row_text,
       CASE WHEN page % 7 = 3 THEN 'text-fallback' WHEN page % 2 = 1 THEN 'recovered' ELSE 'ruled' END AS quality,
       CASE WHEN page % 4 = 0 THEN 1 ELSE 0 END AS breaks_before
  FROM v_blocks"""

#: Grids of three cells per block, whole texts in them, with blank rows and columns.
_GRIDS = """
SELECT doc_id, page, block_no, CASE WHEN page % 2 = 0 THEN {0}w1, '', concat(w2, w3){1} WHEN block_no % 3 = 0 THEN {0}'', text{1} ELSE {0}w1, w2, w3{1} END AS cells
  FROM (SELECT doc_id, page, block_no, text, substring(text, 1, 6) AS w1, substring(text, 7, 6) AS w2, substring(text, 13) AS w3 FROM v_blocks) g
UNION ALL SELECT doc_id, page, 12, {0}'', ' ', ''{1} FROM v_blocks WHERE kind = 'header'"""
VIEWS["v_grids"] = (_GRIDS.format("array(", ")"), _GRIDS.format("[", "]"))

#: Drafts of two criteria per run; every line of an order is one quote and one
#: sub-requirement of the draft it falls in.
VIEWS["v_draft_rows"] = """
SELECT run_id, CAST(line % 2 AS INT) AS criterion_id, line, l_partkey, l_suppkey, l_shipdate, l_discount, l_tax, l_returnflag,
       CAST(row_number() OVER (PARTITION BY run_id, line % 2 ORDER BY line) - 1 AS INT) AS idx,
       coalesce(p_name, 'plain item') AS p_name
  FROM v_criterion_rows LEFT JOIN @part ON p_partkey = l_partkey"""

VIEWS["v_evidence"] = """
SELECT run_id, concat('E', CAST(line AS STRING)) AS evidence_id, line AS entry, concat(CAST(line AS STRING), '. Section') AS section,
       CAST(l_suppkey AS STRING) AS page,
       concat('Item ', CAST(l_partkey AS STRING), ' | supplier – ', CAST(l_suppkey AS STRING), '  may ship   on time, ', p_name) AS text
  FROM v_draft_rows"""

VIEWS["v_draft_quotes"] = """
SELECT run_id, criterion_id, idx,
       CASE WHEN l_suppkey % 9 = 0 THEN 'E99' WHEN line >= 3 AND l_partkey % 6 = 0 THEN 'E1' ELSE concat('E', CAST(line AS STRING)) END AS evidence_id,
       CASE WHEN l_suppkey % 37 = 0 THEN '   ' WHEN line >= 3 AND l_partkey % 6 = 0 THEN 'ITEM'
            WHEN l_partkey % 31 = 0 THEN repeat(concat('item ', CAST(l_partkey AS STRING), ' and more '), 30)
            WHEN l_partkey % 5 = 0 THEN concat('ITEM ', CAST(l_partkey AS STRING), ' supplier: none')
            ELSE concat('ITEM ', CAST(l_partkey AS STRING), ' supplier - ', CAST(l_suppkey AS STRING), ' may  ship on time') END AS text
  FROM v_draft_rows"""

VIEWS["v_draft_subs"] = """
SELECT run_id, criterion_id, idx AS pos, concat('s', CAST(idx AS STRING)) AS sub_id, p_name AS requirement,
       CASE WHEN l_returnflag = 'A' THEN 'met' WHEN l_returnflag = 'N' THEN 'partial' WHEN l_partkey % 4 = 0 THEN 'not_determined' ELSE 'missing' END AS status,
       CASE WHEN l_partkey % 8 = 0 THEN 2 WHEN l_returnflag IN ('A', 'N') AND l_partkey % 7 <> 0 THEN 1 WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS cites
  FROM v_draft_rows"""

VIEWS["v_drafts"] = """
SELECT run_id, criterion_id, CASE WHEN max(l_suppkey) % 17 = 0 THEN 'Is it so?' ELSE concat('Question ', CAST(criterion_id AS STRING)) END AS question,
       CASE WHEN max(l_returnflag) = 'A' THEN 'Fully Compliant' WHEN max(l_returnflag) = 'N' THEN 'Partially Compliant' ELSE 'Non-Compliant' END AS state,
       CASE WHEN max(l_partkey) % 13 = 0 THEN ' ' ELSE 'because' END AS rationale,
       1 - CAST(round(max(l_discount) * 100) AS INT) / 8 AS raw_confidence, count(*) AS n_quotes
  FROM v_draft_rows GROUP BY run_id, criterion_id"""

#: Up to three rounds of findings per draft.
VIEWS["v_findings"] = """
SELECT run_id, line AS criterion_id, CAST(l_suppkey % 3 AS INT) AS round, CAST(l_partkey % 4 AS INT) AS n_support,
       CASE WHEN l_suppkey % 5 = 0 THEN 'disagree' ELSE 'agree' END AS state_agreement,
       CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS n_missing, CAST(l_suppkey % 4 AS INT) AS n_status,
       (l_partkey % 80) / 64 AS critic_confidence, l_partkey, l_suppkey
  FROM v_criterion_rows"""

VIEWS["v_subparts"] = """
SELECT p_brand AS criterion_id, concat('p', CAST(p_partkey AS STRING)) AS sub_id, p_partkey,
       concat(p_name, ' ', p_type, ' size', CAST(p_size AS STRING)) AS requirement,
       concat(p_brand, ' must cover large items') AS criterion_requirement
  FROM @part"""

_NAME = re.compile(r"\bv_[a-z_]+\b")
_TABLE = re.compile(r"@([a-z]+)")


def _text(name: str, duck: bool) -> str:
    body = VIEWS[name]
    return body if isinstance(body, str) else body[1 if duck else 0]


def needed(sql: str, duck: bool = True) -> list[str]:
    """Views a text depends on, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(_text(name, duck))
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def base_tables(sql: str, duck: bool = True) -> list[str]:
    texts = [sql, *[_text(n, duck) for n in needed(sql, duck)]]
    return sorted({t for text in texts for t in _TABLE.findall(text)})


def duck_sql(body: str) -> str:
    """The query with its views in front, for DuckDB."""
    body = body.strip()
    views = needed(body)
    text = body
    if views:
        ctes = ",\n".join(f"{n} AS MATERIALIZED ({_text(n, True).strip()})" for n in views)
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else None
        recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE", body, re.I) else ""
        text = f"WITH {recursive}{ctes},\n{rest}" if rest else f"WITH {ctes}\n{body}"
    return _TABLE.sub(r"\1", text)


#: Views kept as tables of their own: a source of many others that costs a
#: shuffle to derive.
STORED = ("v_criterion_rows", "v_draft_rows", "v_blocks")


def spark_sql(name: str, stored: dict[str, str] | None = None) -> str:
    """A view as one Spark text; ``stored`` names tables standing in for views."""
    stored = {k: v for k, v in (stored or {}).items() if k != name}
    order: list[str] = []

    def visit(view: str) -> None:
        for other in _NAME.findall(_text(view, False)):
            if other in VIEWS and other not in order and other not in stored:
                visit(other)
        if view not in order:
            order.append(view)

    visit(name)
    ctes = ",\n".join(f"{n} AS ({_text(n, False).strip()})" for n in order)
    text = f"WITH {ctes}\nSELECT * FROM {name}"
    for view, table in stored.items():
        text = re.sub(rf"\b{view}\b", table, text)
    return text
