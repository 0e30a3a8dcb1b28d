"""DuckDB SQL of the queries in ``corpus``, over the same tables."""

from __future__ import annotations

#: The whitespace class of ``functions.text`` for this engine.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{0080}-\x{009F}"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def decode(x: str) -> str:
    """Entities part by part: each part after an ampersand begins with at most one."""
    named = "".join(
        f"WHEN regexp_matches(p, '(?i)^{name};') THEN '{char}' || substr(p, {len(name) + 2}) " for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "))
    )
    number = "TRY_CAST(regexp_extract(p, '^#([0-9]+);', 1) AS BIGINT)"
    hexa = "TRY_CAST('0x' || regexp_extract(p, '(?i)^#x([0-9a-f]+);', 1) AS BIGINT)"

    def good(n: str) -> str:
        return f"({n} BETWEEN 1 AND 1114111 AND {n} NOT BETWEEN 55296 AND 57343)"

    return (
        f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p {named}"
        f"WHEN regexp_matches(p, '^#[0-9]+;') AND {good(number)} THEN chr(CAST({number} AS INTEGER)) || regexp_replace(p, '^#[0-9]+;', '') "
        f"WHEN regexp_matches(p, '(?i)^#x[0-9a-f]+;') AND {good(hexa)} THEN chr(CAST({hexa} AS INTEGER)) || regexp_replace(p, '(?i)^#x[0-9a-f]+;', '') "
        f"ELSE '&' || p END), '')"
    )


def visible(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?\\s*>|</p>|</div>', chr(10), 'g')"
    return f"regexp_replace({out}, '<[^>]+>', '', 'g')"


def escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def strip(x: str) -> str:
    inner = escape(decode(visible(f"coalesce({x}, '')")))
    return trim(f"regexp_replace(regexp_replace({inner}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def clean(x: str) -> str:
    return f"regexp_replace({decode(strip(x))}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def neutral(x: str) -> str:
    line = f"CASE WHEN regexp_matches(l, '^ {{0,3}}=+[{WS}]*$') THEN regexp_replace(l, '^( {{0,3}})=', '\\1\\\\=') ELSE l END"
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace({line}, '^[ \\t]', chr(160))), chr(10))"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def excerpt(x: str, limit: int) -> str:
    window = f"substr({x}, 1, {limit})"

    def last(end: str, size: int) -> str:
        return f"CASE WHEN strpos(reverse({window}), reverse({end})) > 0 THEN length({window}) - strpos(reverse({window}), reverse({end})) - {size} + 1 ELSE -1 END"

    best = f"greatest({last('chr(10) || chr(10)', 2)}, {last(chr(39) + '。' + chr(39), 1)}, {last(chr(39) + '！' + chr(39), 1)}, {last(chr(39) + '？' + chr(39), 1)}, {last(chr(39) + '. ' + chr(39), 2)})"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN {best} > 0.6 * {limit} THEN substr({x}, 1, {best} + 1) ELSE {window} END"


FIRSTS = """firsts AS (SELECT id, questionid, voteupcount, captureseq FROM answers WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY captureseq) = 1)"""

METADATA = """meta AS (SELECT id, title, detail, topics, answercount FROM question WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetchedat DESC, title DESC, detail DESC, topics DESC, answercount DESC) = 1)"""

INPUTS = f"""inputs AS (SELECT DISTINCT 'question-' || questionid || '-answer-' || coalesce(id, 'unknown') AS source_id, questionid || '/answers.json' AS relative_path,
  questionid, id AS answer_id, coalesce(author, '(匿名)') AS author, CAST({units("coalesce(content, '')")} AS BIGINT) AS chars, coalesce(voteupcount, 0) AS voteupcount,
  sha256(coalesce(content, '')) AS sha256 FROM answers WHERE questionid IS NOT NULL)"""

#: The derived digest of ``corpus._digest``.
DIGEST = """made AS (SELECT chunkid AS chunk_id, any_value(sourceids) AS source_ids, max(chunkhash) AS chunk_hash,
    CAST(regexp_extract(chunkid, '(\\d+)$', 1) AS BIGINT) AS m, CAST(regexp_extract(chunkid, '(\\d+)$', 1) AS BIGINT) % 10 AS n FROM chunk WHERE chunkid IS NOT NULL GROUP BY chunkid),
  ins AS (SELECT DISTINCT s AS source_id FROM (SELECT unnest(source_ids) AS s FROM made)),
  maps AS (SELECT m, n, chunk_id, 'map-' || chunk_id || '.json' AS file, CASE WHEN n = 1 THEN 'old' ELSE chunk_hash END AS chunk_hash, chunk_hash AS current_hash,
    source_ids AS have, CASE WHEN n = 3 THEN list_append(source_ids, 'question-0-answer-0') WHEN n = 4 THEN source_ids[2:] ELSE source_ids END AS source_ids,
    CASE WHEN n = 2 THEN ' ' ELSE 's' END AS summary FROM made WHERE n <> 9),
  gates AS (SELECT *, CASE WHEN chunk_hash IS DISTINCT FROM current_hash OR coalesce(trim(chunk_hash), '') = '' THEN 'stale_maps'
    WHEN len(source_ids) = 0 THEN 'malformed_maps' WHEN trim(summary) = '' THEN 'malformed_maps' END AS gate FROM maps),
  found AS (
    SELECT 'cross_chunk_evidence' AS kind FROM (SELECT unnest(source_ids) AS s, have FROM gates WHERE gate IS NULL) WHERE NOT list_contains(have, s)
    UNION ALL SELECT 'missing_mapped_sources' FROM (SELECT unnest(have) AS s, source_ids FROM gates WHERE gate IS NULL) WHERE NOT list_contains(source_ids, s)
    UNION ALL SELECT 'malformed_maps' FROM gates WHERE gate IS NULL AND n = 5
    UNION ALL SELECT 'malformed_maps' FROM gates WHERE gate IS NULL AND n = 6
    UNION ALL SELECT 'missing_mapped_sources' FROM (SELECT unnest(have) AS s, have FROM gates WHERE gate IS NULL AND n = 7) WHERE s <> have[1])"""

CLAIMS = """claims AS (
    SELECT m * 100 AS seq, 'claim ' || n AS claim, have[1:2] AS evidence, ['high', 'medium', 'low'][n % 3 + 1] AS confidence FROM maps
    UNION ALL SELECT m * 100 + 1, ' ', ['question-0-answer-0'], 'sure' FROM maps WHERE n = 5)"""

CAPTURES = f"""{METADATA}, per_id AS (SELECT questionid, id, count(*) AS n, max(captureseq) AS last FROM answers WHERE questionid IS NOT NULL GROUP BY ALL),
  captured AS (SELECT questionid, CAST(sum(n) AS BIGINT) AS answers, CAST(sum(CASE WHEN id IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates,
    CAST(sum(CASE WHEN NOT coalesce(regexp_full_match(id, '[0-9]{{1,20}}'), false) THEN n ELSE 0 END) AS BIGINT) AS bad, max(last) AS last FROM per_id GROUP BY questionid),
  judged AS (SELECT c.questionid AS directory_id, answers AS captured, CASE WHEN m.answercount >= 0 THEN m.answercount END AS reported, duplicates, answers AS frames,
    list_filter([CASE WHEN last % 11 = 0 AND c.questionid <> '0' THEN 'question_id_mismatch' END, CASE WHEN bad > 0 THEN 'bad_answer_id' END, CASE WHEN duplicates > 0 THEN 'duplicate_ids' END,
      CASE WHEN last % 7 = 0 THEN 'progress_missing' END, CASE WHEN last % 7 <> 0 AND last % 5 = 0 THEN 'not_done' END], lambda x: x IS NOT NULL) AS errors
    FROM captured c LEFT JOIN meta m ON m.id = c.questionid),
  accepted AS (SELECT directory_id, len(errors) = 0 AS valid, captured, reported, coalesce(reported <> captured, false) AS count_mismatch, duplicates, frames,
    array_to_string(CASE WHEN coalesce(reported <> captured, false) THEN list_append(errors, 'count_mismatch') ELSE errors END, ',') AS warnings FROM judged)"""


def greedy(table: str, group: str, key: str, size: str, most: int, items: int, number: str, keep: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {key}) AS rn FROM {table}),
      r AS (SELECT {group} AS g, rn, {key} AS k, {size} AS chars, 1 AS cnt, CAST(1 AS BIGINT) AS no FROM o WHERE rn = 1
        UNION ALL SELECT r.g, o.rn, o.{key}, CASE WHEN r.chars + o.{size} > {most} OR r.cnt >= {items} THEN o.{size} ELSE r.chars + o.{size} END,
          CASE WHEN r.chars + o.{size} > {most} OR r.cnt >= {items} THEN 1 ELSE r.cnt + 1 END, CASE WHEN r.chars + o.{size} > {most} OR r.cnt >= {items} THEN r.no + 1 ELSE r.no END
        FROM r JOIN o ON o.{group} IS NOT DISTINCT FROM r.g AND o.rn = r.rn + 1)
      SELECT {keep}, r.no AS {number} FROM o JOIN r ON o.{key} = r.k"""


_FRAGMENT_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace({collapse(decode(visible("coalesce(content, '')")))}, '([。！？!?])', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: {collapse("regexp_replace(s, '(?i)https?://[^ ]+', ' ', 'g')")}), lambda s: s <> '')"""

SQL: dict[str, str] = {
    "strip_html_answers": f"SELECT captureseq, {strip('content')} AS text FROM answers",
    "clean_text_answers": f"SELECT captureseq, {clean('content')} AS text FROM answers",
    "decode_entities_answers": f"SELECT captureseq, {decode('content')} AS text FROM answers WHERE content IS NOT NULL",
    "token_range_chunks": f"SELECT DISTINCT chunkid, chars, {half_up('chars / 2.2')} AS tokmin, {half_up('chars / 1.4')} AS tokmax FROM chunk",
    "terminal_safe_documents": f"SELECT doc_id, regexp_replace(text, '[{CONTROL}]', '', 'g') AS text FROM documents",
    "escape_inline_comments": r"SELECT DISTINCT id, answerid, regexp_replace(contentmarkdown, '([\\`*_\[\]{}()#+.!|>~-])', '\\\1', 'g') AS text FROM (SELECT DISTINCT * FROM comments)",
    "escape_markdown_documents": "SELECT doc_id, "
    + neutral(r"regexp_replace(regexp_replace(coalesce(text, ''), '([\\`*_\[\]{}()#+.!|>~<-])', '\\\1', 'g'), '[" + CONTROL + r"]', chr(65533), 'g')")
    + " AS text FROM documents",
    "neutralize_lines_documents": f"SELECT doc_id, {neutral('text')} AS text FROM documents",
    "text_measures_answers": f"""SELECT captureseq, CAST({units('content')} AS BIGINT) AS units,
        CAST(CASE WHEN content IS NULL THEN 0 ELSE coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x))), 0) END AS INTEGER) AS backticks,
        CAST(CASE WHEN coalesce(content, '') = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS BIGINT) AS lines,
        lower({collapse("coalesce(author, '')")}) AS author FROM answers""",
    "safe_lines_questions": f"SELECT DISTINCT id, {trim('regexp_replace(' + escape("coalesce(title, '')") + ", '[\\r\\n]+', ' ', 'g')")} AS safe, {collapse('title')} AS title FROM question",
    "masked_paths_documents": r"""SELECT doc_id, CAST(least(len(regexp_extract_all(text, '[A-Za-z]:[\\/][^\s`>]*|/(?:Users|home|tmp|private)/[^\s`>]*')), 5) AS BIGINT) AS leaks
        FROM documents WHERE regexp_matches(text, '[A-Za-z]:[\\/][^\s`>]*|/(?:Users|home|tmp|private)/[^\s`>]*')""",
    "format_time_answers": """SELECT captureseq, CASE WHEN createdtime IS NULL OR createdtime = 0 THEN '(未知)' ELSE strftime(make_timestamp(createdtime * 1000000) + INTERVAL 8 HOUR, '%Y/%-m/%-d %H:%M:%S') END AS created,
        format('{:,}', coalesce(voteupcount, 0)) AS votes, 'https://qa.example/question/' || questionid || '/answer/' || id AS url FROM answers""",
    "content_hashes_answers": "SELECT captureseq, sha256(content) AS sha256, md5(content) AS md5 FROM answers",
    "file_stats": f"""SELECT doc_id, CAST({units("coalesce(text, '')")} AS BIGINT) AS chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
        CAST(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT) AS lines, {half_up(units("coalesce(text, '')") + ' / 2.2')} AS tokmin,
        {half_up(units("coalesce(text, '')") + ' / 1.4')} AS tokmax FROM documents""",
    "corpus_totals": f"""SELECT count(*) AS files, CAST(sum({units("coalesce(text, '')")}) AS BIGINT) AS chars, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes,
        CAST(sum(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS BIGINT) AS lines, CAST(sum({half_up(units("coalesce(text, '')") + ' / 2.2')}) AS BIGINT) AS tokmin,
        CAST(sum({half_up(units("coalesce(text, '')") + ' / 1.4')}) AS BIGINT) AS tokmax FROM documents""",
    "stable_fragments_answers": f"""WITH s AS (SELECT captureseq, {_FRAGMENT_SENTENCES} AS x FROM answers), t AS (SELECT *, len(x) AS n, CAST(ceil(len(x) / 3.0) AS INTEGER) AS k FROM s),
        g AS (SELECT captureseq, CASE WHEN n >= 3 THEN [array_to_string(x[1:k], ' '), array_to_string(x[k+1:n-k], ' '), array_to_string(x[n-k+1:n], ' ')] ELSE [array_to_string(x, ' ')] END AS f FROM t)
        SELECT captureseq, list_filter(CASE WHEN len(f) = 3 AND f[2] IN (f[1]) THEN [f[1], f[3]] WHEN len(f) = 3 AND f[3] IN (f[1], f[2]) THEN [f[1], f[2]] ELSE f END, lambda z: length(z) >= 20) AS fragments FROM g""",
    "rank_answers": """SELECT questionid, captureseq, voteupcount, CAST(row_number() OVER (PARTITION BY questionid ORDER BY voteupcount DESC NULLS LAST, captureseq) AS BIGINT) AS rank
        FROM answers WHERE questionid IS NOT NULL""",
    "top_n_per_group": """SELECT source, doc_id, n_chars, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents) WHERE rank <= 6""",
    "top_lineitems_per_supplier": """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
        SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 6""",
    "popular_sample": f"""WITH b AS (SELECT source, doc_id, n_chars, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents),
        c AS (SELECT source, rank, doc_id, n_chars, {strip('text')} AS t FROM b WHERE rank <= 6)
        SELECT source, CAST(rank AS INTEGER) AS rank, doc_id AS key, n_chars AS score, {excerpt('t', 1300)} AS sample FROM c""",
    "excerpts_documents": f"SELECT doc_id, {excerpt('text', 300)} AS excerpt FROM documents",
    "quantile_sample": """WITH p AS (SELECT questionid, captureseq, row_number() OVER (PARTITION BY questionid ORDER BY captureseq) - 1 AS place, count(*) OVER (PARTITION BY questionid) AS n FROM answers WHERE questionid IS NOT NULL),
        w AS (SELECT *, list_distinct([CAST(floor((n - 1) * p) AS BIGINT) FOR p IN [0.0, 0.25, 0.5, 0.75, 1.0]]) AS q FROM p),
        f AS (SELECT *, list_filter(range(0, least(n, 5)), lambda x: NOT list_contains(q, x)) AS rest FROM w)
        SELECT questionid, captureseq, CAST(place AS BIGINT) AS place FROM f WHERE list_contains(q, place) OR list_contains(rest[1:greatest(0, 5 - len(q))], place)""",
    "top_percent_answers": f"""WITH {FIRSTS}, r AS (SELECT questionid, id, voteupcount, rank() OVER (PARTITION BY questionid ORDER BY coalesce(voteupcount, 0) DESC) AS k, count(*) OVER (PARTITION BY questionid) AS n
        FROM firsts WHERE questionid IS NOT NULL) SELECT questionid, id, voteupcount, n AS group_size FROM r WHERE k <= greatest(1, ceil(n * 20 / 100.0))""",
    "canonical_answers": """SELECT DISTINCT id, questionid, coalesce(author, '') AS author, coalesce(url, '') AS url, coalesce(excerpt, '') AS excerpt, coalesce(voteupcount, 0) AS voteupcount,
        coalesce(commentcount, 0) AS commentcount, createdtime, updatedtime FROM answers""",
    "dedupe_keep_first": f"WITH {FIRSTS} SELECT * FROM firsts",
    "duplicate_ids": """SELECT questionid, count(*) AS answers, count(DISTINCT id) AS ids, count(id) - count(DISTINCT id) AS duplicates FROM answers WHERE questionid IS NOT NULL GROUP BY questionid""",
    "repeated_page_guard": """WITH p AS (SELECT questionid, id, row_number() OVER (PARTITION BY questionid ORDER BY captureseq) - 1 AS k FROM answers WHERE questionid IS NOT NULL),
        f AS (SELECT questionid, CAST(k // 20 AS BIGINT) AS page, string_agg(coalesce(id, ''), ',' ORDER BY k) AS head FROM p WHERE k % 20 < 5 GROUP BY ALL)
        SELECT questionid, page, coalesce(head = lag(head) OVER (PARTITION BY questionid ORDER BY page), false) AS repeated FROM f""",
    "merge_insert_only": """WITH o AS (SELECT id, questionid, voteupcount, captureseq FROM answers WHERE id IS NOT NULL AND fetchedat < TIMESTAMPTZ '2022-04-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY id ORDER BY captureseq) = 1),
        n AS (SELECT id, questionid, voteupcount, captureseq FROM answers WHERE id IS NOT NULL AND fetchedat >= TIMESTAMPTZ '2022-04-01 00:00:00+00' AND id NOT IN (SELECT id FROM o) QUALIFY row_number() OVER (PARTITION BY id ORDER BY captureseq) = 1)
        SELECT * FROM o UNION ALL SELECT * FROM n""",
    "top10_answers": f"""WITH {FIRSTS} SELECT id, questionid, voteupcount, captureseq, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY questionid ORDER BY voteupcount DESC NULLS LAST, captureseq) AS rank FROM firsts WHERE questionid IS NOT NULL) WHERE rank <= 10""",
    "comments_upsert": f"""WITH {FIRSTS}, d AS (SELECT DISTINCT answerid, createdtime, id, replycommentid, replyrootcommentid, contenthtml, authorname FROM comments WHERE answerid IS NOT NULL),
        c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY answerid ORDER BY createdtime NULLS FIRST, id NULLS FIRST, replycommentid, replyrootcommentid, contenthtml, authorname NULLS FIRST) <= 3),
        g AS (SELECT answerid, bool_and(coalesce(replycommentid = '0' AND (replyrootcommentid = id OR replyrootcommentid = '0') AND contenthtml IS NOT NULL, false)) AS ok, list(id ORDER BY createdtime NULLS FIRST, id) AS ids FROM c GROUP BY answerid),
        b AS (SELECT id FROM firsts WHERE questionid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY questionid ORDER BY voteupcount DESC NULLS LAST, captureseq) <= 10)
        SELECT f.id, CASE WHEN b.id IS NULL THEN CASE WHEN g.ok THEN g.ids END WHEN CAST(right(f.id, 1) AS INTEGER) % 2 = 0 THEN ['new-' || f.id] WHEN g.ok THEN g.ids END AS comments
        FROM firsts f LEFT JOIN b ON b.id = f.id LEFT JOIN g ON g.answerid = f.id WHERE f.questionid IS NOT NULL""",
    "first3_comments": """WITH d AS (SELECT DISTINCT answerid, createdtime, id, replycommentid, replyrootcommentid, contenthtml, authorname FROM comments WHERE answerid IS NOT NULL),
        c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY answerid ORDER BY createdtime NULLS FIRST, id NULLS FIRST, replycommentid, replyrootcommentid, contenthtml, authorname NULLS FIRST) <= 3),
        g AS (SELECT answerid, bool_and(coalesce(replycommentid = '0' AND (replyrootcommentid = id OR replyrootcommentid = '0') AND contenthtml IS NOT NULL, false)) AS valid, list(id ORDER BY createdtime NULLS FIRST, id) AS ids FROM c GROUP BY answerid)
        SELECT answerid, valid, CAST(CASE WHEN valid THEN len(ids) ELSE -1 END AS INTEGER) AS kept, CASE WHEN valid THEN ids END AS ids FROM g""",
    "first10_distinct": """WITH f AS (SELECT questionid, min(captureseq) AS first_order, arg_max(author, captureseq) AS a, max(captureseq) AS last FROM answers WHERE questionid IS NOT NULL GROUP BY questionid ORDER BY first_order LIMIT 10)
        SELECT f.questionid, first_order, x.author FROM f JOIN answers x ON x.captureseq = f.last""",
    "search_candidates": """WITH f AS (SELECT questionid, min(captureseq) AS first_order FROM answers WHERE questionid IS NOT NULL GROUP BY questionid ORDER BY first_order LIMIT 10)
        SELECT questionid, first_order, max(CASE WHEN answercount >= 0 THEN answercount END) AS answercount FROM f LEFT JOIN question q ON q.id = f.questionid GROUP BY ALL""",
    "question_metadata": f"""WITH {METADATA} SELECT id, detail IS NOT NULL AS has_detail, CASE WHEN answercount >= 0 THEN answercount END AS answercount,
        CAST(CASE WHEN topics IS NULL THEN -1 ELSE len(list_filter(topics, lambda t: t.topicid IS NOT NULL AND t.topicname IS NOT NULL)) END AS INTEGER) AS topics FROM meta""",
    "question_ids": """SELECT captureseq, regexp_full_match(id, '[0-9]{1,20}') AS valid, nullif(regexp_extract(url, 'question/([0-9]{1,20})(?:$|[/?#])', 1), '') AS question_id FROM answers""",
    "split_long_text": """WITH RECURSIVE r AS (SELECT doc_id, 0 AS part, text AS rest, CAST(NULL AS VARCHAR) AS piece FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT doc_id, part + 1, substr(rest, cut + 1), substr(rest, 1, cut) FROM (
          SELECT doc_id, part, rest, CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN best > 1200 THEN best + 1 ELSE 2000 END AS cut FROM (
            SELECT *, greatest("""
    + ", ".join(
        f"CASE WHEN strpos(reverse(substr(rest, 1, 2000)), reverse({e})) > 0 THEN least(2000, length(rest)) - strpos(reverse(substr(rest, 1, 2000)), reverse({e})) - {n} + 1 ELSE -1 END"
        for e, n in (("chr(10) || chr(10)", 2), ("'。'", 1), ("'！'", 1), ("'？'", 1), ("'. '", 2))
    )
    + """) AS best FROM r WHERE rest <> '' OR part = 0)))
        SELECT doc_id, CAST(part - 1 AS INTEGER) AS part, piece AS text FROM r WHERE part > 0""",
    "greedy_chunks": greedy("documents", "source", "doc_id", "n_chars", 24_000, 40, "chunk_no", "o.source, o.doc_id, o.n_chars"),
    "volumes_by_chars": greedy("(SELECT doc_id, n_chars, 'all' AS g FROM documents)", "g", "doc_id", "n_chars", 50_000, 2**31 - 1, "volume", "o.doc_id, o.n_chars"),
    "volumes_by_count": "SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 + 1 AS BIGINT) AS volume_no FROM documents",
    "manifest_inputs": f"WITH {INPUTS} SELECT * FROM inputs",
    "manifest_reuse": """WITH a AS (SELECT 'question-' || questionid || '-answer-' || id AS s, content FROM answers WHERE id IS NOT NULL AND questionid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY captureseq) = 1),
        b AS (SELECT 'question-' || questionid || '-answer-' || id AS s, content FROM answers WHERE id IS NOT NULL AND questionid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY captureseq DESC) = 1)
        SELECT coalesce(bool_and(same), true) AS reusable, count(*) FILTER (NOT same) AS changed_sources, count(*) AS sources FROM (
          SELECT a.s IS NOT NULL AND b.s IS NOT NULL AND coalesce(a.content, '') = coalesce(b.content, '') AS same FROM a FULL JOIN b ON a.s = b.s)""",
    "missing_sources": f"WITH {INPUTS} SELECT 'missing_sources' AS kind, source_id AS item FROM (SELECT DISTINCT source_id FROM inputs) WHERE source_id NOT IN (SELECT unnest(sourceids) FROM chunk)",
    "unknown_sources": f"""WITH {INPUTS}, d AS (SELECT DISTINCT * FROM chunk) SELECT 'invalid_evidence_refs' AS kind, chunkid || ' ' || s AS item FROM (SELECT chunkid, unnest(sourceids) AS s FROM d)
        WHERE s NOT IN (SELECT source_id FROM inputs)""",
    "duplicate_assignments": "SELECT 'duplicate_assignments' AS kind, chunkid AS item FROM (SELECT DISTINCT * FROM chunk) WHERE len(sourceids) > 0",
    "missing_maps": f"WITH {DIGEST} SELECT 'missing_map_results' AS kind, chunk_id AS item FROM made WHERE n = 9",
    "map_gates": f"WITH {DIGEST} SELECT file, gate, true AS registered FROM gates",
    "map_issues": f"WITH {DIGEST} SELECT kind, count(*) AS n FROM found GROUP BY kind",
    "stale_hashes": f"WITH {DIGEST} SELECT 'stale_hashes' AS kind, source_id AS item FROM ins WHERE right(source_id, 1) = '7'",
    "coverage_report": f"""WITH {DIGEST} SELECT CAST(0 AS BIGINT) AS missing_sources, CAST(0 AS BIGINT) AS failed_chunks, CAST(0 AS BIGINT) AS duplicate_assignments, CAST(0 AS BIGINT) AS invalid_evidence_refs,
        (SELECT count(*) FROM gates WHERE gate = 'malformed_maps') + (SELECT count(*) FROM found WHERE kind = 'malformed_maps') AS malformed_maps, CAST(0 AS BIGINT) AS duplicate_maps,
        (SELECT count(*) FROM gates WHERE gate = 'stale_maps') AS stale_maps, (SELECT count(*) FROM found WHERE kind = 'cross_chunk_evidence') AS cross_chunk_evidence,
        (SELECT count(*) FROM found WHERE kind = 'missing_mapped_sources') AS missing_mapped_sources, (SELECT count(*) FROM made WHERE n = 9) AS missing_map_results,
        (SELECT count(*) FROM ins WHERE right(source_id, 1) = '7') AS stale_hashes, false AS valid""",
    "set_hash_chunks": """WITH m AS (SELECT chunkid, max(text) AS text FROM chunk GROUP BY chunkid), h AS (SELECT sha256(chunkid || ':' || sha256(text)) AS h FROM m)
        SELECT sha256(CAST(sum(CAST(('0x' || h[1:15]) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || h[16:30]) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || h[31:45]) AS HUGEINT)) AS VARCHAR)
          || ':' || CAST(sum(CAST(('0x' || h[46:60]) AS HUGEINT)) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)) AS set_hash, count(*) AS members FROM h""",
    "theme_counts": f"""SELECT t AS theme, count(*) AS occurrences FROM (SELECT {trim('x.topicname')} AS t FROM (SELECT unnest(topics) AS x FROM question)) WHERE t <> '' GROUP BY t""",
    "merge_claims": f"""WITH {DIGEST}, {CLAIMS}, t AS (SELECT *, trim(claim) AS text FROM claims WHERE trim(claim) <> '')
        SELECT text, list_sort(list_distinct(flatten(list(evidence)))) AS evidence, CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
        count(*) AS occurrences, min(seq) AS first_seq FROM t GROUP BY text""",
    "high_vote_sources": f"""WITH {DIGEST}, {CLAIMS}, d AS (SELECT DISTINCT * FROM chunk), s0 AS (SELECT chunkid, unnest(sources) AS s, generate_subscripts(sources, 1) AS pos FROM d),
        s AS (SELECT s.sourceid AS source_id, arg_max(coalesce(s.voteupcount, 0), CAST(regexp_extract(chunkid, '(\\d+)$', 1) AS BIGINT) * 10000 + pos) AS votes FROM s0 GROUP BY 1),
        c AS (SELECT seq, unnest(evidence) AS source_id, generate_subscripts(evidence, 1) AS pos FROM claims)
        SELECT seq, list(c.source_id ORDER BY pos) AS high_vote_sources FROM c JOIN s USING (source_id) WHERE votes >= 1000 GROUP BY seq""",
    "low_confidence": f"""WITH {DIGEST}, {CLAIMS} SELECT trim(claim) AS text, count(*) AS occurrences FROM claims WHERE trim(claim) <> '' GROUP BY 1 HAVING max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) = 1""",
    "uncertainties_in_order": f"WITH {DIGEST} SELECT 'doubt ' || (n % 2) AS uncertainty, min(m) AS first_seq FROM maps GROUP BY 1",
    "final_evidence_check": f"""WITH {DIGEST}, {CLAIMS}, e AS (SELECT unnest(evidence) AS s FROM claims WHERE trim(claim) <> '')
        SELECT count(*) AS claims, count(*) FILTER (trim(claim) = '' OR len(evidence) = 0) AS claims_without_evidence, count(*) FILTER (trim(claim) <> '' AND confidence NOT IN ('high', 'medium', 'low')) AS bad_confidence,
        (SELECT count(*) FROM e WHERE s IN (SELECT source_id FROM ins)) AS valid_refs, (SELECT count(*) FROM e WHERE s NOT IN (SELECT source_id FROM ins)) AS invalid_refs,
        count(*) > 0 AND count(*) FILTER (trim(claim) = '' OR len(evidence) = 0) = 0 AND (SELECT count(*) FROM e WHERE s NOT IN (SELECT source_id FROM ins)) = 0 AS valid FROM claims""",
    "acceptance_report": f"WITH {CAPTURES} SELECT * FROM accepted",
    "handoff_rows": f"""WITH {CAPTURES} SELECT 'digest' AS task, 'qa-answers' AS source_type, directory_id AS question_id, directory_id || '/answers.json' AS input_json, directory_id || '/answers.md' AS input_markdown,
        true AS verified, captured AS answer_count FROM accepted WHERE valid""",
    "status_rows": f"""WITH {CAPTURES} SELECT c.questionid AS question_id, c.answers AS "offset", last % 5 <> 0 AS done, c.answers AS answers, a.valid FROM captured c JOIN accepted a ON a.directory_id = c.questionid""",
    "batch_summary": f"WITH {CAPTURES} SELECT count(*) FILTER (valid) AS succeeded, count(*) FILTER (NOT valid) AS failed, bool_and(valid) AS ok FROM accepted",
    "archive_entries": f"""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS source, {trim(r"regexp_extract(regexp_extract(text, '^([^\r\n]*)', 1), '^#\s+(.+)$', 1)")} AS t,
        {trim(r"regexp_replace(text, '^\x{FEFF}?#[ \t]+[^\n]*(?:\n|$)', '')")} AS body FROM documents WHERE text IS NOT NULL)
        SELECT source, CASE WHEN t = '' THEN source ELSE t END AS title, CAST({units('body')} AS BIGINT) AS body_chars, sha256(body) AS body_sha256 FROM e""",
    "archive_totals": f"""SELECT count(*) AS files, CAST(sum({units(trim(r"regexp_replace(text, '^\x{FEFF}?#[ \t]+[^\n]*(?:\n|$)', '')"))}) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL""",
    "archive_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS source, 'ok' AS status FROM documents WHERE text IS NOT NULL",
    "classify_answer_urls": r"""SELECT captureseq, CASE WHEN url IS NULL THEN 'url_missing' WHEN url = 'https://qa.example/question/' || questionid || '/answer/' || id THEN 'ok'
        WHEN url LIKE 'https://qa.example/question/%' THEN 'path_mismatch' ELSE 'path_not_answer' END AS verdict FROM answers""",
    "image_counts_answers": r"""SELECT captureseq, CAST(len(u) AS INTEGER) AS images, CAST(len(list_filter(u, lambda x: x LIKE 'https://img.example/%')) AS INTEGER) AS clickable FROM (
        SELECT captureseq, list_distinct(list_filter(list_transform(regexp_extract_all(content, '<img[^>]*>'), lambda t: coalesce(nullif(regexp_extract(t, 'data-original="(https?://[^"]+)"', 1), ''), nullif(regexp_extract(t, ' src="(https://[^"]+)"', 1), ''))),
          lambda x: x IS NOT NULL)) AS u FROM answers WHERE content LIKE '%<img%')""",
    "code_blocks_answers": r"""SELECT captureseq, CAST(len(b) AS INTEGER) AS blocks, CAST(list_sum(list_transform(b, lambda x: CASE WHEN x = '' THEN 0 ELSE 1 + length(x) - length(replace(x, chr(10), '')) END)) AS BIGINT) AS lines
        FROM (SELECT captureseq, regexp_extract_all(content, '(?s)<pre[^>]*><code[^>]*>(.*?)</code>', 1) AS b FROM answers WHERE content LIKE '%<pre%')""",
}

SQL["numeric_props_events"] = "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS v FROM events"
