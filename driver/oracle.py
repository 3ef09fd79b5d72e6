"""The SQL that each driver query is checked against, for DuckDB.

Common steps are named table expressions; ``_with`` puts those a query needs in front of it. The SQL goes its
own way where it can: texts are cut by recursion, blocks are found by summed depth, selection ranks whole runs.
"""

from __future__ import annotations

import json
import re

from wayread import constants as C

WS, LINE_END = C.WS, C.LINE_END


def _q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, {_q(WS + '+')}, ' ', 'g'), ' ')"


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(C.NOT_WS + '+')}))"


def _headline(x: str) -> str:
    return f"trim(regexp_replace({_clean(x)}, {_q(C.SITE_SUFFIX)}, ''), ' ')"


def _entities(x: str) -> str:
    """The names that occur in the tables; HTML reads them without the semicolon too."""
    for name, char in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        x = f"regexp_replace({x}, '&{name};?', {_q(char)}, 'g')"
    return x


def _id(prefix: str, pos: str) -> str:
    return f"('{prefix}' || CASE WHEN {pos} + 1 < 10 THEN '0' ELSE '' END || ({pos} + 1))"


def _rfind(x: str, limit: int) -> str:
    """Index of the last space before the limit, -1 if none."""
    head = f"substr({x}, 1, {limit})"
    return f"(CASE WHEN contains({head}, ' ') THEN length({head}) - instr(reverse({head}), ' ') ELSE -1 END)"


def _quoted(x: str, limit: int) -> str:
    at = _rfind(x, limit + 1)
    return (
        f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE trim(CASE WHEN {at} > {limit}/2.0 "
        f"THEN substr({x}, 1, {at}) ELSE substr({x}, 1, {limit}) END, ' ') || '…' END"
    )


# fixed lists as SQL
ROLE_LIST = "[" + ", ".join(_q(r) for r in C.ROLE_NAMES) + "]"
LABEL = "CASE role " + " ".join(f"WHEN {_q(n)} THEN {_q(t)}" for n, t, _ in C.ROLES) + " ELSE 'Read' END"
WEIGHT = "CASE role " + " ".join(f"WHEN {_q(n)} THEN {w}::DOUBLE" for n, _, w in C.ROLES) + " ELSE 0.9::DOUBLE END"
SCORE = f"(p * ({WEIGHT}) * (0.8::DOUBLE + 0.2::DOUBLE * role_p))"
GRID = "[" + ", ".join(f"{n}/100::DOUBLE" for n in range(20, 91, 5)) + "]"
CATCH = "role IN ('qualification', 'counterpoint')"

MARK = "\x1f"
_RUN = rf"[{C.STOPS}]+[{C.CLOSERS}]*{WS}+"


def _sentences(name: str, source: str, key: str) -> dict[str, str]:
    """Sentence parts of ``source(key, text)``: boundaries marked, marks after abbreviations taken back."""
    unmark = f"(?:^|[({MARK}]|{WS})(?:{C.ABBREVIATIONS}){_RUN}"
    marked = f"regexp_replace(text, {_q(f'({_RUN})([{C.OPENERS}])')}, {_q(chr(92) + '1' + MARK + chr(92) + '2')}, 'g')"
    for _ in range(2):
        marked = f"regexp_replace({marked}, {_q(f'({unmark}){MARK}')}, {_q(chr(92) + '1')}, 'g')"
    head = "substr(rest, 1, 481)"
    space = f"(CASE WHEN contains({head}, ' ') THEN 481 - instr(reverse({head}), ' ') ELSE -1 END)"
    lead = f"length(regexp_extract(piece, {_q('^' + WS + '*')}))"
    tail = f"length(regexp_extract(piece, {_q(WS + '*$')}))"
    return {
        f"{name}_marked": f"SELECT {key}, string_split({marked}, {_q(MARK)}) AS parts FROM {source}",
        f"{name}_long": f"SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM {name}_marked",
        f"{name}_cut": f"""
            SELECT {key}, n, 0 AS k, NULL::VARCHAR AS piece, part AS rest FROM {name}_long WHERE length(part) > 480
            UNION ALL
            SELECT {key}, n, k + 1, substr(rest, 1, cut_at), substr(rest, cut_at + 1)
            FROM (SELECT *, CASE WHEN length(rest) <= 480 THEN 480 WHEN {space} > 240 THEN {space} ELSE 480 END AS cut_at
                  FROM {name}_cut WHERE rest <> '')""",
        f"{name}_all": f"""
            SELECT {key}, n, k, piece FROM {name}_cut WHERE k > 0
            UNION ALL SELECT {key}, n, 1, part FROM {name}_long WHERE length(part) <= 480""",
        f"{name}_at": f"""
            SELECT {key}, n, k, piece, coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY n, k
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {name}_all""",
        f"{name}": f"""
            SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY n, k) - 1 AS i, piece,
                   start + {lead} AS s, start + length(piece) - {tail} AS e, {_clean('piece')} AS text
            FROM {name}_at WHERE {_clean('piece')} <> ''""",
    }


# tokens of the given pages: comments, skipped elements, tags, text
_HTML = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(
    rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in C.RAW_TEXT_TAGS
) + r"|<[!/a-z][^>]*(?:>|\z)|[^<]+"
_NEST = "(" + ", ".join(_q(t) for t in C.NEST_BLOCK_TAGS) + ")"
_LEAF = "(" + ", ".join(_q(t) for t in C.LEAF_BLOCK_TAGS) + ")"

_FIND_JSON = json.dumps(C.FIND_QUESTION, separators=(",", ":"), ensure_ascii=False)
_NEEDED_JSON = json.dumps(C.NEEDED_QUESTION, separators=(",", ":"), ensure_ascii=False)
_ROLE_JSON = json.dumps(C.ROLE_QUESTION, separators=(",", ":"), ensure_ascii=False)

_SPLIT_AT = f"CASE WHEN length(rest) <= 960 THEN 960 WHEN {_rfind('rest', 960)} > 480 THEN {_rfind('rest', 960)} ELSE 960 END"


def _pieces(name: str, source: str, key: str) -> dict[str, str]:
    """``split_long`` of ``source(key, text)`` by recursion: (key, line_no, k, piece)."""
    lines = f"regexp_split_to_array(text, {_q(LINE_END)})"
    return {
        f"{name}_lines": f"""
            SELECT {key}, line_no, {_clean('line')} AS line FROM (
                SELECT {key}, unnest({lines}) AS line, generate_subscripts({lines}, 1) AS line_no
                FROM {source} WHERE length(text) > 960)""",
        f"{name}_cut": f"""
            SELECT {key}, line_no, 0 AS k, NULL::VARCHAR AS piece, line AS rest FROM {name}_lines WHERE line <> ''
            UNION ALL
            SELECT {key}, line_no, k + 1, trim(substr(rest, 1, cut_at), ' '), trim(substr(rest, cut_at + 1), ' ')
            FROM (SELECT *, {_SPLIT_AT} AS cut_at FROM {name}_cut WHERE rest <> '')""",
        f"{name}": f"""
            SELECT {key}, line_no, k, piece FROM {name}_cut WHERE k > 0
            UNION ALL SELECT {key}, 1, 1, {_clean('text')} FROM {source} WHERE length(text) <= 960 AND {_clean('text')} <> ''
            UNION ALL SELECT {key}, 1, 1, '' FROM {source} WHERE length(text) > 960 AND {_clean('text')} = ''""",
    }


def _recorded(source: str) -> str:
    return f"""
        SELECT *, ((doc_id * 37 + question_id * 17 + idx * 61) % 101)::DOUBLE / 100::DOUBLE AS p,
               {ROLE_LIST}[1 + (doc_id * 7 + question_id * 5 + idx * 3) % 7] AS role,
               ((doc_id * 13 + question_id * 3 + idx * 29) % 11)::DOUBLE / 10::DOUBLE AS role_p,
               ((doc_id + question_id + idx) % 10)::DOUBLE / 10::DOUBLE AS confidence
        FROM {source}"""


def _by_length(source: str, more: str) -> str:
    """Judgments of the function judge: by the length of the passage as it is asked, plus ``more``."""
    asked = "length(CASE WHEN heading <> '' THEN '[under heading: ' || heading || '] ' ELSE '' END || text)"
    return f"""
        SELECT * EXCLUDE (n), (n % 101)::DOUBLE / 100::DOUBLE AS p, {ROLE_LIST}[1 + n % 7] AS role, (n % 11)::DOUBLE / 10::DOUBLE AS role_p, 0.5::DOUBLE AS confidence
        FROM (SELECT *, {asked} + {more} AS n FROM {source})"""


def _selected(name: str, judged: str, extra: str = "", t: str = "0.45::DOUBLE") -> dict[str, str]:
    """Reading paths: the whole ranking of every run, without limits."""
    g = "doc_id, question_id" + extra
    return {
        f"{name}_ranked": f"""
            SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY score DESC, idx) AS rk,
                   row_number() OVER (PARTITION BY {g}, role ORDER BY score DESC, idx) = 1 AS rep
            FROM (SELECT *, {SCORE} AS score FROM {judged} WHERE p >= {t} AND role <> 'irrelevant')""",
        f"{name}_counted": f"""
            SELECT *, sum(rep::INT) OVER (PARTITION BY {g}) + coalesce(sum((NOT rep)::INT) OVER (
                   PARTITION BY {g} ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
            FROM {name}_ranked""",
        f"{name}_stopped": f"""
            SELECT *, min(CASE WHEN n >= 3 AND p < greatest(0.62::DOUBLE, {t}) THEN rk END) OVER (PARTITION BY {g}) AS stop
            FROM {name}_counted""",
        f"{name}": f"""
            SELECT *, CASE WHEN is_catch THEN 'The catch' ELSE {LABEL} END AS label FROM (
              SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY idx) AS ord,
                     {CATCH} AND row_number() OVER (PARTITION BY {g}, {CATCH} ORDER BY score DESC, idx) = 1 AS is_catch
              FROM {name}_stopped WHERE rep OR ((stop IS NULL OR rk < stop) AND n < 7))""",
    }


TABLES: dict[str, str] = {
    "n_questions": "SELECT count(*) AS n FROM benchmark",
    "runs": """
        SELECT doc_id, (doc_id * 7 + turn * 11) % n AS question_id, turn
        FROM documents, (VALUES (0), (1)) AS t(turn), n_questions""",
    "page_runs": """
        SELECT page_id AS doc_id, (page_id * 7 + turn * 11) % n AS question_id, turn
        FROM pages, (VALUES (0), (1)) AS t(turn), n_questions""",
    **_pieces("pieces", "documents", "doc_id"),
    "passages": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS idx, piece AS text
        FROM pieces WHERE length(piece) >= 40""",
    "asked": "SELECT p.*, question_id, turn FROM passages p JOIN runs USING (doc_id)",
    "judged": _recorded("asked"),
    **_selected("selected", "judged"),
    "dirty_judged": """
        SELECT * REPLACE (CASE WHEN idx % 7 = 3 THEN 0 ELSE p END AS p, CASE WHEN idx % 5 = 4 THEN 'irrelevant' ELSE role END AS role) FROM judged""",
    **_selected("dirty_selected", "dirty_judged"),
    "signal": f"""
        SELECT doc_id, question_id, sum(w)::BIGINT AS judged_words,
               coalesce(sum(w) FILTER (p >= 0.45::DOUBLE AND role <> 'irrelevant'), 0)::BIGINT AS signal_words,
               round_even(coalesce(sum(w) FILTER (p >= 0.45::DOUBLE AND role <> 'irrelevant'), 0)::DOUBLE / sum(w)::DOUBLE, 4)::DOUBLE AS signal_ratio
        FROM (SELECT *, {_words('text')} AS w FROM judged) GROUP BY ALL""",
    **_sentences("parts", "documents", "doc_id"),
    "sents": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, text, s, e
        FROM parts WHERE length(text) >= 12""",
    "queries": "SELECT item_id AS question_id, text AS query FROM benchmark",
    "sents_asked": "SELECT s.*, question_id, turn FROM sents s JOIN runs USING (doc_id)",
    "found_p": _recorded("sents_asked"),
    "found": """
        SELECT f.*, query, contains(lower(text), lower(trim(query))) AS is_literal
        FROM found_p f JOIN queries USING (question_id)""",
    "found_terms": """
        SELECT f.*, lang AS query, contains(lower(text), lower(trim(lang))) AS is_literal
        FROM found_p f JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""",
    # ---- web pages
    "tokens": f"""
        SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS pos
        FROM (SELECT page_id, regexp_extract_all(html, {_q(_HTML)}) AS t FROM pages)""",
    "tags": r"""
        SELECT page_id, pos, t, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name,
               t LIKE '</%' AS ends, t NOT LIKE '<%' AS is_text FROM tokens""",
    "in_body": """
        SELECT * FROM (SELECT *, min(pos) FILTER (name = 'body' AND NOT ends) OVER (PARTITION BY page_id) AS body_pos FROM tags)
        WHERE pos >= body_pos""",
    "depths": f"""
        SELECT *, sum(CASE WHEN name NOT IN {_NEST} THEN 0 WHEN ends THEN -1 ELSE 1 END) OVER w AS depth,
               last_value(CASE WHEN name IN {_LEAF} AND NOT ends THEN pos WHEN name IN {_NEST} OR name IN {_LEAF} THEN -1 END
                          IGNORE NULLS) OVER w AS leaf
        FROM in_body WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "owners": f"""
        SELECT *, CASE WHEN leaf >= 0 THEN leaf ELSE last_value(CASE WHEN name IN {_NEST} AND NOT ends THEN pos END IGNORE NULLS)
               OVER (PARTITION BY page_id, depth ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS owner
        FROM depths""",
    "blocks": f"""
        SELECT b.page_id, row_number() OVER (PARTITION BY b.page_id ORDER BY first) - 1 AS block_pos, owner AS block_id, name AS tag, text
        FROM (SELECT page_id, coalesce(owner, body_pos) AS owner, min(pos) AS first,
                     string_agg({_entities('t')}, '' ORDER BY pos) AS text
              FROM owners WHERE is_text AND {_clean(_entities('t'))} <> '' GROUP BY ALL) b
        JOIN tags ON tags.page_id = b.page_id AND tags.pos = b.owner""",
    "extents": f"""
        SELECT o.page_id, o.pos AS block_id, o.name AS tag, coalesce(CASE
               WHEN o.name IN {_LEAF} THEN (SELECT min(c.pos) - 1 FROM depths c WHERE c.page_id = o.page_id AND c.pos > o.pos
                                            AND (c.name IN {_NEST} OR c.name IN {_LEAF}))
               ELSE (SELECT min(c.pos) FROM depths c WHERE c.page_id = o.page_id AND c.pos > o.pos AND c.depth < o.depth) END, 2147483647) AS until
        FROM depths o WHERE NOT o.is_text AND NOT o.ends AND (o.name IN {_NEST} OR o.name IN {_LEAF})""",
    "kept_blocks": """
        SELECT x.page_id, s.question_id, x.block_id, x.until
        FROM (SELECT doc_id, question_id, block_id FROM web_selected UNION SELECT doc_id, question_id, heading_block_id FROM web_selected) s
        JOIN extents x ON x.page_id = s.doc_id AND x.block_id = s.block_id""",
    "focus_runs": """
        SELECT r.*, (SELECT max(x.block_id) FROM extents x WHERE x.page_id = r.doc_id AND x.tag IN ('article', 'main')
                     AND r.first_id BETWEEN x.block_id AND x.until) AS part
        FROM (SELECT doc_id, question_id, arg_min(block_id, idx) AS first_id, min(block_id) AS least_id, max(block_id) AS last_id
              FROM web_selected GROUP BY ALL) r""",
    "headed": f"""
        SELECT *, last_value(CASE WHEN tag ~ '^h[1-6]$' THEN {_clean('text')} END IGNORE NULLS) OVER w AS heading,
               last_value(CASE WHEN tag ~ '^h[1-6]$' THEN block_id END IGNORE NULLS) OVER w AS heading_block_id
        FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY block_pos ROWS UNBOUNDED PRECEDING)""",
    "block_texts": "SELECT page_id * 1000000 + block_pos AS b, text FROM blocks",
    **_sentences("block_parts", "block_texts", "b"),
    "page_sents": """
        SELECT b // 1000000 AS page_id, row_number() OVER (PARTITION BY b // 1000000 ORDER BY b, i) - 1 AS idx, text, s, e
        FROM block_parts WHERE length(text) >= 12""",
    "packed": """
        SELECT b, i, s, e, piece, 0 AS grp, (e - s) AS size FROM block_parts WHERE i = 0
        UNION ALL
        SELECT n.b, n.i, n.s, n.e, n.piece,
               CASE WHEN packed.size + n.e - n.s > 960 THEN grp + 1 ELSE grp END,
               CASE WHEN packed.size + n.e - n.s > 960 THEN n.e - n.s ELSE packed.size + n.e - n.s END
        FROM packed JOIN block_parts n ON n.b = packed.b AND n.i = packed.i + 1""",
    "spans": f"""
        SELECT b // 1000000 AS page_id, b % 1000000 AS block_pos, grp, min(s) AS s, max(e) AS e,
               {_clean("string_agg(piece, '' ORDER BY i)")} AS text
        FROM packed GROUP BY b, grp""",
    "web": f"""
        SELECT s.page_id, row_number() OVER (PARTITION BY s.page_id ORDER BY s.block_pos, grp) - 1 AS idx, s.text,
               coalesce(heading, '') AS heading, heading_block_id, block_id, s, e
        FROM spans s JOIN headed h ON h.page_id = s.page_id AND h.block_pos = s.block_pos
        WHERE NOT h.tag ~ '^h[1-6]$' AND length({_clean('h.text')}) >= 40 AND length(s.text) >= 40""",
    "web_asked": "SELECT doc_id, question_id, idx, text, heading, heading_block_id, block_id FROM web JOIN page_runs ON page_id = doc_id",
    "web_judged": _recorded("web_asked"),
    **_selected("web_selected", "web_judged"),
    "headline": f"""
        SELECT page_id, coalesce(
                 (list_filter(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)(?:</h1>|\\z)', 1),
                    lambda x: {_headline(_entities("regexp_replace(regexp_replace(x, '(?i)<br>', ' ', 'g'), '<[^>]*>', '', 'g')"))}),
                    lambda x: length(x) BETWEEN 3 AND 300))[1],
                 (list_filter([{_headline(_entities("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))}],
                    lambda x: length(x) BETWEEN 3 AND 300))[1]) AS headline
        FROM pages""",
    "opener": f"""
        SELECT page_id, coalesce(any_value(w), any_value(f)) AS opener FROM (
            SELECT page_id, arg_min(text, idx) AS w, NULL AS f FROM web GROUP BY page_id
            UNION ALL SELECT page_id, NULL, arg_min({_clean('text')}, block_pos) FROM blocks
            WHERE length({_clean('text')}) >= 40 GROUP BY page_id) GROUP BY page_id""",
    "auto": f"""
        SELECT page_id, CASE
            WHEN headline IS NOT NULL THEN {_q(C.AUTO_FROM_HEADLINE[0])} || ({_quoted('headline', 200)}) || {_q(C.AUTO_FROM_HEADLINE[1])}
            WHEN opener IS NOT NULL THEN {_q(C.AUTO_FROM_OPENER[0])} || ({_quoted('opener', 280)}) || {_q(C.AUTO_FROM_OPENER[1])}
            ELSE '' END AS question,
            CASE WHEN headline IS NOT NULL THEN 'headline' WHEN opener IS NOT NULL THEN 'first paragraph' ELSE '' END AS source
        FROM pages LEFT JOIN headline USING (page_id) LEFT JOIN opener USING (page_id)""",
    # ---- layout
    "layout": f"""
        SELECT *, CASE WHEN y0 <= 64 THEN 'top' WHEN y0 + 24 >= 736 THEN 'bottom' ELSE '' END AS band,
               row_number() OVER (PARTITION BY doc_id ORDER BY page, round_even(y0 / 4, 0), x0, number) - 1 AS reading_no
        FROM (SELECT doc_id, l // 8 + 1 AS page, l % 8 AS number, {_clean('line')} AS text,
                     CASE WHEN (doc_id + l) % 2 = 0 THEN 36.0 ELSE 320.0 END::DOUBLE AS x0,
                     ((l % 8) // 2 * 238 + 24 + l % 3)::DOUBLE AS y0,
                     CASE WHEN (doc_id + l) % 4 = 0 THEN 15.0 ELSE 11.0 END::DOUBLE AS size, (doc_id * 5 + l * 3) % 5 = 0 AS bold
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents))
        WHERE text <> ''""",
    "repeats": """
        SELECT doc_id, text, count(*) AS n_blocks, count(DISTINCT page) AS n_pages FROM layout
        WHERE length(text) <= 120 GROUP BY ALL HAVING count(DISTINCT page) >= 3""",
    "prev": """
        SELECT *, lag(text) OVER w AS prev_text, lag(size) OVER w AS prev_size, lag(bold) OVER w AS prev_bold
        FROM layout WINDOW w AS (PARTITION BY doc_id, page ORDER BY reading_no)""",
    "layout_headed": f"""
        SELECT *, CASE WHEN length(prev_text) <= 200 AND {_words('prev_text')} <= 12
                        AND (prev_size >= size * 1.08::DOUBLE OR (prev_bold AND NOT bold)) THEN prev_text ELSE '' END AS heading
        FROM prev""",
    "layout_body": """
        SELECT *, doc_id * 1000000 + reading_no AS b FROM layout_headed WHERE length(text) >= 40
        AND NOT (band <> '' AND (doc_id, text) IN (SELECT (doc_id, text) FROM repeats))""",
    **_pieces("layout_pieces", "layout_body", "b"),
    "layout_passages": """
        SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY reading_no, line_no, k) - 1 AS idx, page,
               CASE WHEN row_number() OVER (PARTITION BY l.b ORDER BY line_no, k) = 1 THEN heading ELSE '' END AS heading,
               piece AS text, [x0, y0, x0 + 244, y0, x0, y0 + 24, x0 + 244, y0 + 24] AS quad
        FROM layout_pieces p JOIN layout_body l ON l.b = p.b WHERE length(piece) >= 40""",
    "layout_asked": "SELECT p.*, question_id, turn FROM layout_passages p JOIN runs USING (doc_id)",
    "layout_judged": _recorded("layout_asked"),
    **_selected("layout_selected", "layout_judged"),
    "boxed_judged": _by_length("layout_asked", "0"),
    **_selected("boxed_selected", "boxed_judged"),
    "own_asked": """
        SELECT w.*, CASE WHEN b.text ~ '^[AEIOU]' THEN a.question ELSE trim(b.text, ' ') END AS question
        FROM web_asked w JOIN benchmark b ON b.item_id = w.question_id JOIN auto a ON a.page_id = w.doc_id
        WHERE NOT regexp_matches(b.text, '^[AEIOU]') OR a.question <> ''""",
    "own_judged": _by_length("own_asked", "length(question)"),
    **_selected("own_selected", "own_judged"),
    "bin_counts": """
        SELECT mode, role, least(floor(p * 10)::BIGINT, 9) AS bin, count(*) AS n, count(*) FILTER (correct) AS yes FROM records WHERE p IS NOT NULL GROUP BY ALL""",
    "bin_spans": """
        SELECT a.mode, a.role, a.bin AS j, b.bin AS k,
               (SELECT sum(yes) / sum(n)::DOUBLE FROM bin_counts c WHERE c.mode = a.mode AND c.role = a.role AND c.bin BETWEEN a.bin AND b.bin) AS mean
        FROM bin_counts a JOIN bin_counts b ON a.mode = b.mode AND a.role = b.role AND a.bin <= b.bin""",
    "bin_floors": """
        SELECT c.mode, c.role, c.bin, j, min(mean) AS mean
        FROM bin_counts c JOIN bin_spans s ON s.mode = c.mode AND s.role = c.role AND j <= bin AND k >= bin GROUP BY ALL""",
    # ---- requests
    "windows": f"""
        SELECT doc_id, question_id, turn, idx // 12 AS window_no, count(*) AS n_items,
               string_agg({_id('P', '(idx % 12)')} || '| ' || text, chr(10) ORDER BY idx) AS passage
        FROM asked GROUP BY ALL""",
    "requests": """
        SELECT w.*, b.text AS question,
               sha256(concat_ws(chr(1), 'default', 'digest', b.text, passage)) AS request_key
        FROM windows w JOIN benchmark b ON b.item_id = w.question_id""",
    "find_windows": f"""
        SELECT doc_id, question_id, idx // 25 AS window_no, count(*) AS n_items,
               string_agg({_id('S', '(idx % 25)')} || '| ' || text, chr(10) ORDER BY idx) AS passage
        FROM sents_asked GROUP BY ALL""",
    # one answer per key: that of the lowest ids
    "answer_of": """
        SELECT request_key, arg_min(doc_id, (doc_id, question_id, window_no)) AS a_doc,
               arg_min(question_id, (doc_id, question_id, window_no)) AS a_question,
               arg_min(window_no, (doc_id, question_id, window_no)) AS a_window, max(n_items) * 100 AS input_tokens,
               max(n_items) * 10 AS output_tokens
        FROM requests GROUP BY request_key""",
    "answer_of_first": """
        SELECT request_key, count(*) AS n FROM requests WHERE turn = 0 GROUP BY request_key""",
    "usage": """
        SELECT doc_id, question_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
               'recorded' AS model
        FROM requests JOIN answer_of USING (request_key) GROUP BY doc_id, question_id""",
    # ---- lexical judge
    "passage_terms": r"""
        SELECT doc_id, idx, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term
        FROM passages""",
    "frequency": "SELECT term, count(*) AS df FROM passage_terms GROUP BY term",
    "question_terms": r"""
        SELECT item_id AS question_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term
        FROM benchmark""",
    "idf": """
        SELECT question_id, term, ln(1 + (SELECT count(*) FROM passages) / coalesce(df, 1)::DOUBLE) AS idf
        FROM question_terms LEFT JOIN frequency USING (term)""",
    "totals": "SELECT question_id, sum(idf) AS total FROM idf GROUP BY question_id",
    "overlap": """
        SELECT r.doc_id, r.question_id, t.idx, sum(idf) AS hit
        FROM runs r JOIN passage_terms t ON t.doc_id = r.doc_id JOIN idf i ON i.question_id = r.question_id AND i.term = t.term
        GROUP BY ALL""",
    "lexical_p": """
        SELECT a.doc_id, a.question_id, a.idx, lower(a.text) AS low,
               round(coalesce(hit, 0) / total, 6) AS p
        FROM asked a JOIN totals USING (question_id) LEFT JOIN overlap o
          ON o.doc_id = a.doc_id AND o.question_id = a.question_id AND o.idx = a.idx""",
    # ---- labels
    "records": """
        SELECT l.doc_id * 1000 + turn AS ts, 'doc/' || l.doc_id AS url, 'digest' AS mode, b.text AS query, j.text AS text, p, role, role_p,
               quality = 1 AS correct
        FROM labels l JOIN judged j ON j.doc_id = l.doc_id JOIN benchmark b ON b.item_id = j.question_id""",
    **_selected("swept", "swept_judged", ", threshold", "threshold"),
    "swept_judged": f"SELECT * FROM judged, (SELECT unnest({GRID}) AS threshold)",
}

def _needs(sql: str) -> set[str]:
    return {n for n in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b|\), {n}\b", sql)}


def _with(body: str) -> str:
    """Put the table expressions that ``body`` needs in front of it, inner ones first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in sorted(_needs(TABLES[name]) - {name}):
            visit(other)
        order.append(name)

    for name in sorted(_needs(body)):
        visit(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in order) + "\n" + body


ORACLE: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "word_count": f"SELECT doc_id, {_words('text')} AS n_words FROM documents",
    "excerpt": f"""
        SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 120), ' ') || '...' END AS excerpt
        FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)""",
    "truncate_quoted": f"SELECT doc_id, {_quoted('t', 200)} AS quoted FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)",
    "clean_headline": f"""
        SELECT page_id, {_headline(_entities("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} AS title FROM pages""",
    "rfind": f"SELECT doc_id, {_rfind('text', 960)} AS at FROM documents",
    "split_long_text": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS piece_no, piece FROM pieces",
    "split_sentences": "SELECT doc_id, i AS n, s, e FROM parts",
    "sentences": "SELECT doc_id, idx, text, s, e FROM sents",
    "text_passages": "SELECT doc_id, idx, text FROM passages",
    # web
    "html_blocks": "SELECT page_id, block_pos, tag, text FROM blocks",
    "web_headings": "SELECT page_id, block_pos, tag, coalesce(heading, '') AS heading FROM headed WHERE NOT tag ~ '^h[1-6]$'",
    "web_passages": "SELECT page_id, idx, text, heading, s, e FROM web",
    "page_sentences": "SELECT page_id, idx, text, s, e FROM page_sents",
    "page_headline": "SELECT page_id, headline FROM headline",
    "page_opener": "SELECT page_id, opener FROM opener",
    "auto_question": "SELECT page_id, question, source FROM auto",
    "background_blocks": """
        SELECT b.page_id, r.question_id, block_pos, tag FROM blocks b
        JOIN (SELECT DISTINCT doc_id, question_id FROM web_selected) r ON r.doc_id = b.page_id
        WHERE tag <> 'h1' AND NOT EXISTS (SELECT 1 FROM web_selected s WHERE s.doc_id = b.page_id AND s.question_id = r.question_id
              AND (s.block_id = b.block_id OR s.heading_block_id = b.block_id))""",
    "background_containment": """
        SELECT b.page_id, r.question_id, b.block_pos, b.tag FROM blocks b
        JOIN extents x ON x.page_id = b.page_id AND x.block_id = b.block_id
        JOIN focus_runs r ON r.doc_id = b.page_id
        LEFT JOIN extents f ON f.page_id = b.page_id AND f.block_id = r.part
        WHERE b.tag <> 'h1'
          AND CASE WHEN r.least_id BETWEEN f.block_id AND f.until AND r.last_id BETWEEN f.block_id AND f.until
                   THEN b.block_id > f.block_id AND b.block_id <= f.until ELSE b.tag <> 'body' END
          AND NOT EXISTS (SELECT 1 FROM kept_blocks k WHERE k.page_id = b.page_id AND k.question_id = r.question_id
              AND (k.block_id BETWEEN b.block_id AND x.until OR b.block_id BETWEEN k.block_id AND k.until))""",
    "web_reading_path": "SELECT doc_id, question_id, ord, idx, role, label, heading, text, is_catch FROM web_selected",
    # layout
    "layout_reading_order": "SELECT doc_id, page, number, reading_no FROM layout",
    "layout_bands": "SELECT doc_id, page, number, band, text FROM layout",
    "repeated_lines": "SELECT * FROM repeats",
    "running_headers": "SELECT doc_id, page, number FROM layout WHERE band <> '' AND (doc_id, text) IN (SELECT (doc_id, text) FROM repeats)",
    "layout_headings": "SELECT doc_id, page, number, heading FROM layout_headed",
    "layout_passages": """
        SELECT doc_id, idx, page, heading, text, '[{"page":' || page || ',"quad":' ||
               replace(quad::VARCHAR, ' ', '') || '}]' AS quads FROM layout_passages""",
    # requests
    "request_windows": """
        SELECT doc_id, question_id, idx // 12 AS window_no, count(*) AS n_items, min(idx) AS first_idx, max(idx % 12) AS last_pos
        FROM asked GROUP BY ALL""",
    "find_requests": f"""
        SELECT doc_id, question_id, window_no, n_items,
               sha256(concat_ws(chr(1), 'default', 'find', b.text, passage)) AS request_key,
               '{{"state":' || json_object('query', b.text, 'passage', passage)::VARCHAR || ',"questions":{{' ||
               list_aggregate(list_transform(range(n_items), lambda i: '"' || {_id('S', 'i')} || '":' ||
                   replace({_q(_FIND_JSON)}, '{{id}}', {_id('S', 'i')})), 'string_agg', ',') || '}}}}' AS request
        FROM find_windows w JOIN benchmark b ON b.item_id = w.question_id""",
    "digest_requests": f"""
        SELECT doc_id, question_id, window_no, n_items, request_key,
               '{{"state":' || json_object('question', question, 'passages', passage)::VARCHAR || ',"questions":{{' ||
               list_aggregate(list_transform(range(n_items), lambda i:
                   '"' || {_id('P', 'i')} || '_needed":' || replace({_q(_NEEDED_JSON)}, '{{id}}', {_id('P', 'i')}) ||
                   ',"' || {_id('P', 'i')} || '_role":' || replace({_q(_ROLE_JSON)}, '{{id}}', {_id('P', 'i')})), 'string_agg', ',')
               || '}}}}' AS request
        FROM requests""",
    "parse_answers": """
        SELECT r.doc_id, r.question_id, r.window_no * 12 + j.idx % 12 AS idx, p, role, role_p, confidence
        FROM requests r JOIN answer_of a USING (request_key)
        JOIN judged j ON j.doc_id = a_doc AND j.question_id = a_question AND j.idx // 12 = a_window""",
    "missing_answers": f"""
        SELECT doc_id, question_id, window_no, unnest(list_transform(range(n_items), lambda i: {_id('P', 'i')} || '_needed') ||
               list_transform(range(n_items), lambda i: {_id('P', 'i')} || '_role')) AS missing_id
        FROM requests WHERE request_key NOT IN (SELECT request_key FROM answer_of_first)""",
    "judgment_reuse": """
        SELECT request_key, count(*) AS copies,
               CASE WHEN request_key IN (SELECT request_key FROM answer_of_first) THEN 'stored' ELSE 'new' END AS status
        FROM requests GROUP BY request_key""",
    "usage_totals": "SELECT * FROM usage",
    "run_progress": """
        SELECT doc_id, question_id, count(n) AS windows_done, count(*) AS windows_total
        FROM requests LEFT JOIN answer_of_first USING (request_key) GROUP BY ALL""",
    "valid_runs": """
        SELECT doc_id, question_id, trim(text, ' ') AS question FROM runs JOIN benchmark ON item_id = question_id
        WHERE length(trim(text, ' ')) >= 2""",
    "questions_or_auto": """
        SELECT doc_id, question_id, CASE WHEN b.text ~ '^[AEIOU]' THEN a.question ELSE trim(b.text, ' ') END AS question,
               regexp_matches(b.text, '^[AEIOU]') AS is_auto
        FROM page_runs r JOIN benchmark b ON b.item_id = r.question_id JOIN auto a ON a.page_id = r.doc_id
        WHERE NOT regexp_matches(b.text, '^[AEIOU]') OR a.question <> ''""",
    "lexical_judge": f"""
        SELECT doc_id, question_id, idx, p, role,
               CASE WHEN p > 0 AND role IN ('qualification', 'counterpoint', 'reasoning', 'evidence') THEN 1.0 ELSE p END::DOUBLE AS role_p
        FROM (SELECT *, CASE WHEN p = 0 THEN 'irrelevant'
                {' '.join(f"WHEN regexp_matches(low, {_q(x)}) THEN {_q(n)}" for n, x in C.LEXICAL_CUES)}
                WHEN p >= 0.8 THEN 'direct_answer' ELSE 'background' END AS role FROM lexical_p)""",
    "function_judge": f"""
        SELECT doc_id, question_id, idx, (length(text) % 101)::DOUBLE / 100::DOUBLE AS p, {ROLE_LIST}[1 + length(text) % 7] AS role,
               (length(text) % 11)::DOUBLE / 10::DOUBLE AS role_p, 0.5::DOUBLE AS confidence FROM asked""",
    # digest
    "judge_from_table": """
        SELECT doc_id, question_id, idx, CASE WHEN turn = 0 THEN p END AS p, CASE WHEN turn = 0 THEN role END AS role,
               CASE WHEN turn = 0 THEN role_p END AS role_p FROM judged""",
    "scores": f"SELECT doc_id, question_id, idx, {SCORE} AS score FROM judged",
    "select_digest": "SELECT doc_id, question_id, ord, idx, role, p, score FROM selected",
    "mark_catch": "SELECT doc_id, question_id, ord, is_catch, label FROM selected",
    "reading_path": """
        SELECT doc_id, question_id, ord, idx, 1::BIGINT AS page, role, label, p, role_p, confidence, score, text,
               NULL::VARCHAR AS heading, is_catch FROM selected""",
    "signal_stats": "SELECT * FROM signal",
    "digest_summary": """
        SELECT s.doc_id, s.question_id, coalesce(n, 0) AS n_selected, coalesce(labels, '') AS labels,
               round(signal_words::DOUBLE / judged_words::DOUBLE * 100)::BIGINT AS signal_percent
        FROM signal s LEFT JOIN (
            SELECT doc_id, question_id, sum(n)::BIGINT AS n, string_agg(label, ' · ' ORDER BY first) AS labels FROM (
                SELECT doc_id, question_id, label, min(ord) AS first, count(*) AS n FROM selected GROUP BY ALL)
            GROUP BY ALL) p ON p.doc_id = s.doc_id AND p.question_id = s.question_id""",
    "threshold_sweep": f"""
        SELECT a.*, coalesce(n_selected, 0) AS n_selected, catch_idx FROM (
            SELECT doc_id, question_id, threshold, sum(w)::BIGINT AS judged_words,
                   coalesce(sum(w) FILTER (p >= threshold AND role <> 'irrelevant'), 0)::BIGINT AS signal_words,
                   round_even(coalesce(sum(w) FILTER (p >= threshold AND role <> 'irrelevant'), 0)::DOUBLE / sum(w)::DOUBLE, 4)::DOUBLE AS signal_ratio
            FROM (SELECT *, {_words('text')} AS w FROM swept_judged) GROUP BY ALL) a
        LEFT JOIN (SELECT doc_id, question_id, threshold, count(*) AS n_selected, max(idx) FILTER (is_catch) AS catch_idx
                   FROM swept GROUP BY ALL) b
        ON a.doc_id = b.doc_id AND a.question_id = b.question_id AND a.threshold = b.threshold""",
    "signal_leaderboard": """
        SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id
            ORDER BY signal_ratio DESC NULLS LAST, signal_words DESC, doc_id) AS place, doc_id, signal_words, signal_ratio FROM signal)
        WHERE place <= 5""",
    "path_lines": """
        SELECT doc_id, question_id, ord, ord || ' · ' || label || ' · ' || printf('%.2f', round_even(p, 2)) || ' · 1 · ' ||
               CASE WHEN length(text) <= 120 THEN text ELSE rtrim(substr(text, 1, 120), ' ') || '...' END AS line
        FROM selected""",
    "signal_lines": """
        SELECT doc_id, question_id, 'Signal: ' || round_even(signal_ratio * 100, 0)::INT || '% of judged text (' ||
               signal_words || '/' || judged_words || ' words)' AS line FROM signal""",
    # find
    "find_matches": """
        SELECT doc_id, question_id, idx, text, p, CASE WHEN p >= 0.72::DOUBLE THEN 'hi' ELSE 'mid' END AS tier, is_literal
        FROM found WHERE p >= 0.45::DOUBLE""",
    "find_summary": """
        SELECT doc_id, question_id, count(*) FILTER (p >= 0.45::DOUBLE) AS n_matches, count(*) FILTER (is_literal) AS n_literal,
               count(*) FILTER (p >= 0.45::DOUBLE AND NOT is_literal) AS n_only_here FROM found GROUP BY ALL""",
    "find_turns": f"""
        SELECT doc_id, question_id, count(*) FILTER (p >= 0.45::DOUBLE) AS n_matches, count(*) FILTER (lit) AS n_literal,
               count(*) FILTER (p >= 0.45::DOUBLE AND NOT lit) AS n_only_here
        FROM (SELECT j.*, contains(lower(text), lower(trim(query))) AS lit FROM ({_recorded('''(
            SELECT conv_id AS doc_id, turn AS idx, text, (conv_id * 7 + t.turn_no * 11) % n AS question_id
            FROM conversations, (VALUES (0), (1)) AS t(turn_no), n_questions)''')}) j JOIN queries USING (question_id))
        GROUP BY ALL""",
    "literal_matches": "SELECT doc_id, question_id, idx FROM found_terms WHERE is_literal",
    "semantic_only": "SELECT doc_id, question_id, idx FROM found_terms WHERE p >= 0.45::DOUBLE AND NOT is_literal",
    "literal_and_semantic": """
        SELECT doc_id, question_id, idx FROM found_terms WHERE is_literal
        INTERSECT SELECT doc_id, question_id, idx FROM found_terms WHERE p >= 0.45::DOUBLE""",
    "find_sweep": f"""
        SELECT doc_id, question_id, threshold, count(*) FILTER (p >= threshold) AS n_matches
        FROM found, (SELECT unnest({GRID}) AS threshold) GROUP BY ALL""",
    "top_matches": """
        SELECT doc_id, question_id, idx, p, text FROM found WHERE p >= 0.45::DOUBLE
        ORDER BY p DESC, doc_id, question_id, idx LIMIT 50""",
    "match_navigation": """
        SELECT doc_id, question_id, idx, row_number() OVER w AS match_no, count(*) OVER g AS n_matches,
               coalesce(lag(idx) OVER w, max(idx) OVER g) AS prev_idx, coalesce(lead(idx) OVER w, min(idx) OVER g) AS next_idx
        FROM found WHERE p >= 0.45::DOUBLE
        WINDOW w AS (PARTITION BY doc_id, question_id ORDER BY idx), g AS (PARTITION BY doc_id, question_id)""",
    # labels
    "label_records": "SELECT * FROM records",
    "label_counts": """
        SELECT mode, role, count(*) AS n_labels, count(*) FILTER (correct) AS n_yes, count(*) FILTER (NOT correct) AS n_no
        FROM records GROUP BY ALL""",
    "label_calibration": """
        SELECT mode, role, least(floor(p * 10)::BIGINT, 9) AS bin, count(*) AS n_labels, count(*) FILTER (correct) AS n_yes,
               avg(p) AS mean_p, count(*) FILTER (correct) / count(*)::DOUBLE AS precision
        FROM records GROUP BY ALL""",
    "label_thresholds": f"""
        SELECT *, n_yes_kept / nullif(n_kept, 0)::DOUBLE AS precision, n_yes_kept / nullif(n_yes, 0)::DOUBLE AS recall FROM (
            SELECT mode, threshold, count(*) FILTER (correct) AS n_yes, count(*) FILTER (p >= threshold) AS n_kept,
                   count(*) FILTER (p >= threshold AND correct) AS n_yes_kept
            FROM records, (SELECT unnest({GRID}) AS threshold) GROUP BY ALL)""",
    # nested
    "source_info": "SELECT doc_id, 'doc/' || doc_id AS path, sha256(text) AS sha256, 1::BIGINT AS pages FROM documents",
    "page_counts": "SELECT doc_id, count(*) AS n_passages, max(page) AS n_pages FROM layout_passages GROUP BY doc_id",
    "documents_without_text": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM passages)",
    "manifest_flat": """
        SELECT doc_id, question_id, 2::BIGINT AS manifest_version, sha256(d.text) AS sha256, b.text AS question, 0.45::DOUBLE AS threshold,
               'recorded' AS model, input_tokens, signal_ratio, ord AS "order", 1::BIGINT AS page, role, label, p AS probability,
               role_p AS role_probability, confidence, score, s.text AS text, NULL::VARCHAR AS heading, is_catch
        FROM selected s JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = s.question_id
        JOIN usage USING (doc_id, question_id) JOIN signal USING (doc_id, question_id)""",
    "manifest_json": """
        SELECT s.doc_id, s.question_id, json_object('manifest_version', 2,
               'source', json_object('path', 'doc/' || s.doc_id, 'sha256', sha256(any_value(d.text)), 'pages', 1),
               'config', json_object('model', 'recorded', 'batch_size', 12),
               'usage', json_object('input_tokens', any_value(u.n) * 100, 'output_tokens', any_value(u.n) * 10),
               'passages', to_json(list(json_object('order', ord, 'role', role, 'heading', NULL, 'text', s.text) ORDER BY ord))
               )::VARCHAR AS manifest
        FROM selected s JOIN documents d ON d.doc_id = s.doc_id
        JOIN (SELECT doc_id, question_id, count(*) AS n FROM asked GROUP BY ALL) u ON u.doc_id = s.doc_id AND u.question_id = s.question_id
        GROUP BY s.doc_id, s.question_id""",
    "annotation_plan": """
        SELECT doc_id, question_id, page, ord, ord || ' ' || label AS title,
               'reading-path role=' || role || '; order=' || ord || '; p=' || printf('%.3f', p) || '; role_p=' ||
               printf('%.3f', role_p) || CASE WHEN is_catch THEN '; catch=yes' ELSE '' END AS content,
               '[' || replace(quad::VARCHAR, ' ', '') || ']' AS quads
        FROM layout_selected""",
    "latest_answers_only": f"""
        SELECT doc_id, question_id, idx, run_id FROM (
            SELECT *, max(run_id) OVER (PARTITION BY doc_id, question_id) AS newest FROM (
                SELECT doc_id, question_id, idx, 1::BIGINT AS run_id FROM judged
                UNION ALL SELECT doc_id, question_id, idx, 2::BIGINT FROM judged WHERE turn = 0 AND {_words('text')} % 2 = 0))
        WHERE run_id = newest""",
}
ORACLE["streamed_labels"] = ORACLE["label_counts"]
ORACLE["streamed_paths"] = "SELECT doc_id, question_id, ord, idx, label, score FROM selected"
ORACLE["streamed_passages"] = "SELECT page_id, idx, text, heading FROM web"
_BINNED = "SELECT mode, role, correct, least(floor(p * 10)::BIGINT, 9) AS bin FROM records WHERE p IS NOT NULL"
ORACLE["label_calibration_cube"] = f"""
    SELECT mode, role, bin, grouping(mode) = 1 AS all_modes, grouping(role) = 1 AS all_roles, count(*) AS n_labels, count(*) FILTER (correct) AS n_yes,
           count(*) FILTER (correct) / count(*)::DOUBLE AS precision
    FROM ({_BINNED}) GROUP BY GROUPING SETS ((mode, role, bin), (mode, bin), (role, bin), (bin))"""
ORACLE["label_isotonic"] = """
    SELECT c.mode, c.role, c.bin, n AS n_labels, yes AS n_yes, yes / n::DOUBLE AS precision,
           (SELECT max(mean) FROM bin_floors l WHERE l.mode = c.mode AND l.role = c.role AND l.bin = c.bin) AS calibrated FROM bin_counts c"""
ORACLE["exported_labels"] = ORACLE["label_records"]
ORACLE["stored_and_fresh_answers"] = ORACLE["function_judge"]
ORACLE["stored_layout"] = "SELECT doc_id, idx, page, heading, text FROM layout_passages"
ORACLE["find_sweep_counts"] = f"""
    SELECT doc_id, question_id, threshold, count(*) FILTER (p >= threshold) AS n_matches, count(*) FILTER (is_literal) AS n_literal,
           count(*) FILTER (p >= threshold AND NOT is_literal) AS n_only_here
    FROM found_terms, (SELECT unnest({GRID}) AS threshold) GROUP BY ALL"""
ORACLE["trim_spans"] = f"""
    SELECT doc_id, s, greatest(s, n - length(regexp_extract(head, {_q(WS + '*$')}))) AS e
    FROM (SELECT doc_id, substr(text, 1, 400) AS head, length(substr(text, 1, 400)) AS n, length(regexp_extract(substr(text, 1, 400), {_q('^' + WS + '*')})) AS s FROM documents)"""
ORACLE["run_auto_digest"] = "SELECT doc_id, question_id, ord, idx, label, p, role_p, text FROM own_selected"
ORACLE["run_layout_manifest"] = f"""
    SELECT s.doc_id, s.question_id, trim(b.text, ' ') AS question, (len(string_split(d.text, chr(10))) - 1) // 8 + 1 AS pages, sha256(d.text) AS sha256,
           'by_length' AS model, (SELECT count(DISTINCT idx // 12) FROM layout_asked a WHERE a.doc_id = s.doc_id AND a.question_id = s.question_id)::BIGINT AS output_tokens,
           (SELECT sum({_words('a.text')}) FROM layout_asked a WHERE a.doc_id = s.doc_id AND a.question_id = s.question_id)::BIGINT AS judged_words,
           ord, page, role, nullif(heading, '') AS heading, s.text AS text, '[' || replace(quad::VARCHAR, ' ', '') || ']' AS quads,
           '[' || replace([quad[1], quad[2], quad[7], quad[8]]::VARCHAR, ' ', '') || ']' AS rects
    FROM boxed_selected s JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = s.question_id"""
ORACLE["streamed_dirty_paths"] = "SELECT doc_id, question_id, ord, idx, label, score FROM dirty_selected"
ORACLE["streamed_pages_resent"] = "SELECT doc_id, question_id, ord, idx, label, text FROM web_selected WHERE doc_id % 10 <> 0"
ORACLE["store_second_run"] = """
    SELECT run, CASE run WHEN 1 THEN 0 WHEN 2 THEN early ELSE every END AS reused, CASE run WHEN 1 THEN early WHEN 2 THEN every - early ELSE 0 END AS asked,
           CASE run WHEN 1 THEN early WHEN 2 THEN every - early ELSE 0 END AS done, CASE run WHEN 1 THEN early ELSE every END AS stored
    FROM (SELECT count(DISTINCT request_key) AS every, count(DISTINCT request_key) FILTER (turn = 0) AS early FROM requests), (SELECT unnest([1, 2, 3])::BIGINT AS run)"""
ORACLE["failed_windows"] = """
    SELECT doc_id, question_id, window_no, 'ValueError: no reply' AS error, 1::BIGINT AS failures FROM requests WHERE length(passage) % 5 = 0"""
ORACLE["retried_windows"] = """
    SELECT doc_id, question_id, window_no, 1::BIGINT AS failures, 1::BIGINT AS replies, 0::BIGINT AS still_failed,
           (SELECT count(DISTINCT request_key) FROM requests WHERE length(passage) % 5 = 0)::BIGINT AS asked
    FROM requests WHERE length(passage) % 5 = 0"""
ORACLE = {name: _with(sql) for name, sql in ORACLE.items()}
