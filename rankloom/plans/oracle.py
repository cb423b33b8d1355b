"""Independent DuckDB SQL for the registered queries, composed from named common tables."""

from __future__ import annotations

import re

from rankloom.config import DEFAULTS as C
from rankloom.operators.fusion import plan_grid
from rankloom.operators.metrics import PROBABILITY_STEPS, RUBRIC_STEPS
from rankloom.plans.study import LINE_WINDOW, PAGE_RULES


def code_tokens(x: str) -> str:
    spaced = rf"regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({spaced}), '[^a-z0-9]+'), lambda t: length(t) > 1)"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"


OR_TERMS = (
    "list_filter(list_transform(regexp_split_to_array(replace(question, '\"', ' '), '\\s+'), "
    "lambda w: regexp_replace(w, '^[-+]+', '')), lambda w: length(w) > 0 AND lower(w) NOT IN ('or', 'and'))"
)

MARKDOWN = "html"
for _p, _to in PAGE_RULES:
    _to = _to.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
    MARKDOWN = f"regexp_replace({MARKDOWN}, '{_p}', '{_to}', 'g')"

TABLES: dict[str, str] = {
    "questions": "SELECT item_id AS query_id, text AS question FROM benchmark",
    "docs": "SELECT doc_id, source AS title, source AS folder, lang, text FROM documents",
    "chunks": """
        SELECT doc_id * 4294967296 + ordinal AS chunk_id, doc_id, ordinal, title,
               CASE WHEN length(text) <= 1400 THEN text ELSE substring(text, ordinal * 1200 + 1, 1400) END AS body
        FROM (SELECT *, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1400 THEN 1
                                     ELSE CAST(ceil(length(text) / 1200.0) AS BIGINT) END)) AS ordinal FROM docs)""",
    "chunk_text": "SELECT chunk_id, title || chr(10) || body AS text FROM chunks",
    "gold": """SELECT query_id, doc_id FROM docs, questions WHERE contains(text, question)""",
    # lexical
    "q_terms": f"SELECT DISTINCT query_id, unnest({code_tokens('question')}) AS term FROM questions",
    "unit_tokens": f"SELECT chunk_id, {code_tokens('text')} AS tokens FROM chunk_text",
    "tf": "SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM unit_tokens) GROUP BY ALL",
    "df": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "coll": "SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM unit_tokens",
    "bm25": """
        SELECT query_id, tf.chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
               / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / avg_len))), 9) AS score
        FROM q_terms JOIN tf USING (term) JOIN df USING (term) JOIN unit_tokens ON unit_tokens.chunk_id = tf.chunk_id, coll
        GROUP BY query_id, tf.chunk_id""",
    "or_words": f"""
        SELECT DISTINCT query_id, term FROM
          (SELECT query_id, unnest({words("array_to_string(" + OR_TERMS + ", ' ')")}) AS term FROM questions)
        WHERE term <> 'or'""",
    "wt": f"""
        SELECT chunk_id, term, sum(w) AS w FROM (
          SELECT chunk_id, unnest({words('title')}) AS term, 10 AS w FROM chunks
          UNION ALL SELECT chunk_id, unnest({words('body')}), 4 FROM chunks) GROUP BY ALL""",
    "fts": "SELECT query_id, chunk_id, sum(w) / 10.0::DOUBLE AS score FROM or_words JOIN wt USING (term) GROUP BY ALL",
    # hashed vectors
    "hashed": """
        SELECT term, h % 64 AS dim, ((h // 64) % 2) * 2 - 1 AS sign FROM (
          SELECT term, ('0x' || substring(md5(term), 1, 8))::BIGINT AS h FROM (
            SELECT DISTINCT term FROM tf UNION SELECT term FROM q_terms))""",
    "unit_vec": "SELECT chunk_id, dim, sum(sign * tf)::DOUBLE AS v FROM tf JOIN hashed USING (term) GROUP BY ALL",
    "query_vec": f"""
        SELECT query_id, dim, sum(sign)::DOUBLE AS v
        FROM (SELECT query_id, unnest({code_tokens('question')}) AS term FROM questions) JOIN hashed USING (term) GROUP BY ALL""",
    "unit_norm": "SELECT chunk_id, sqrt(sum(v * v)) AS nv FROM unit_vec GROUP BY 1",
    "query_norm": "SELECT query_id, sqrt(sum(v * v)) AS nq FROM query_vec GROUP BY 1",
    "vec_dots": """
        SELECT query_id, chunk_id, sum(q.v * u.v) AS dot FROM query_vec q JOIN unit_vec u USING (dim) GROUP BY ALL""",
    "cosines": """
        SELECT query_id, c.chunk_id, round(CASE WHEN nq > 0 AND nv > 0 THEN coalesce(dot, 0) / (nq * nv) ELSE 0 END, 9) AS score
        FROM questions CROSS JOIN (SELECT chunk_id FROM chunks) c
        LEFT JOIN vec_dots d USING (query_id, chunk_id)
        LEFT JOIN query_norm USING (query_id) LEFT JOIN unit_norm USING (chunk_id)""",
}


BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _top(source: str, k: int, columns: str = "") -> str:
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank,
        chunk_id, score{columns} FROM {source} QUALIFY rank <= {k}"""


TABLES |= {
    "fts60": _top("fts", 60),
    "vec60": _top("cosines", 60),
    "rrf": """
        SELECT query_id, chunk_id, round(sum(w), 12) AS score, max(lexical) AS lexical, max(dense) AS dense FROM (
          SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS w, score AS lexical, NULL::DOUBLE AS dense FROM fts60
          UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL, score FROM vec60) GROUP BY ALL""",
    "hyb": _top("rrf", 30, ", lexical, dense"),
    "short": """
        SELECT 'fts' AS stage, query_id, rank, chunk_id, score FROM fts60 WHERE rank <= 30
        UNION ALL SELECT 'vector', query_id, rank, chunk_id, score FROM vec60 WHERE rank <= 30
        UNION ALL SELECT 'hybrid', query_id, rank, chunk_id, score FROM hyb""",
    "pairs": """
        SELECT query_id, rank, chunk_id, doc_id, lexical, dense, question, title,
               title || chr(10) || chr(10) || body AS passage
        FROM hyb JOIN chunks USING (chunk_id) JOIN questions USING (query_id)""",
    # judges
    "overlap": f"""
        SELECT query_id, chunk_id, rank, doc_id, length(passage) AS plen, length(question) AS qlen,
               round(len(list_intersect(q, p))::DOUBLE / nullif(len(q), 0), 6) AS share
        FROM (SELECT *, list_distinct({code_tokens('question')}) AS q, list_distinct({code_tokens('passage')}) AS p FROM pairs)""",
    "judged": """
        SELECT *, share AS single, round(3 * share, 4) AS graded,
               (rank - 1) // 15 AS batch FROM overlap""",
    "batch_scores": "SELECT *, single AS batched FROM judged",
    "judge_ranks": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY single IS NULL, single DESC, rank) AS r_single,
               row_number() OVER (PARTITION BY query_id ORDER BY graded IS NULL, graded DESC, rank) AS r_graded,
               row_number() OVER (PARTITION BY query_id ORDER BY batched IS NULL, batched DESC, rank) AS r_batched
        FROM batch_scores""",
    "cascade": """
        SELECT *, CASE WHEN r_batched <= 10 THEN single END AS s_cascade,
               CASE WHEN r_batched > 10 THEN r_batched ELSE
                 row_number() OVER (PARTITION BY query_id, r_batched <= 10 ORDER BY single IS NULL, single DESC, r_batched)
               END AS r_cascade
        FROM judge_ranks""",
    "strategies": """
        SELECT 'hybrid' AS strategy, query_id, doc_id, chunk_id, rank, NULL::DOUBLE AS score FROM cascade
        UNION ALL SELECT 'hybrid+single', query_id, doc_id, chunk_id, r_single, single FROM cascade
        UNION ALL SELECT 'hybrid+batched', query_id, doc_id, chunk_id, r_batched, batched FROM cascade
        UNION ALL SELECT 'hybrid+graded', query_id, doc_id, chunk_id, r_graded, graded FROM cascade
        UNION ALL SELECT 'hybrid+cascade', query_id, doc_id, chunk_id, r_cascade, s_cascade FROM cascade""",
    "stored": _top("bm25", 30),
}


# A candidate's score against the best one of its request.
RELATIVE = {"batch_scores": """
        SELECT *, round(single / nullif(max(single) OVER (PARTITION BY query_id, batch), 0), 6) AS batched FROM judged"""}


def _all_asked(lists: str) -> dict[str, str]:
    """Every question with every strategy, for ``_metric_tables``: without gold or list it scores zero."""
    return {"asked": f"SELECT strategy, query_id FROM questions CROSS JOIN (SELECT DISTINCT strategy FROM {lists})"}


def _metric_tables(lists: str) -> dict[str, str]:
    """Per-list metrics over ``lists(strategy, query_id, doc_id, rank)``."""
    return {
        "flagged": f"""SELECT l.*, g.doc_id IS NOT NULL AS rel FROM {lists} l
            LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM gold) g ON g.query_id = l.query_id AND g.doc_id = l.doc_id""",
        "scored": """
            SELECT strategy, query_id, min(rank) FILTER (rel) AS first_rank, count(*) FILTER (rel) AS n_rel,
                   coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS dcg
            FROM flagged GROUP BY ALL""",
        "asked": f"""SELECT strategy, query_id FROM (SELECT DISTINCT query_id FROM gold) CROSS JOIN (SELECT DISTINCT strategy FROM {lists})""",
        "per_query": f"""
            SELECT q.strategy, q.query_id, first_rank,
                   {", ".join(f"coalesce((first_rank <= {d})::INT, 0)::BIGINT AS hit_at_{d}" for d in (1, 3, 5, 10))},
                   round(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END, 9) AS rr,
                   round(CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda i: 1 / log2(i + 1)))
                         ELSE 0 END, 9) AS ndcg
            FROM asked q LEFT JOIN scored p ON p.query_id = q.query_id AND p.strategy = q.strategy""",
    }


STAGE_LISTS = {"stage_lists": "SELECT stage AS strategy, query_id, chunk_id // 4294967296 AS doc_id, rank FROM short"}
METRIC_MEANS = "count(*) AS n, " + ", ".join(f"round(avg(hit_at_{d}), 9) AS hit_at_{d}" for d in (1, 3, 5, 10)) + \
    ", round(avg(rr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg"


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """The final select with every common table it reaches, in order of use."""
    known = TABLES | (extra or {})
    ordered: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name in known:
            if name not in ordered and name not in above and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(known[name], (*above, name))
                if name not in ordered:
                    ordered.append(name)

    visit(final, ())
    recursive = {"merged", "packed"}
    ctes = ",\n".join(f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({known[n]})" for n in ordered)
    start = "WITH RECURSIVE" if recursive & set(ordered) else "WITH"
    return f"{start} {ctes}\n{final}" if ctes else final


# ---------------------------------------------------------------------- fusion
RANKERS = ["lexical", "dense", "overlap"]
FUSE_TABLES = {
    "long_scores": " UNION ALL ".join(
        f"SELECT '{r}' AS ranker, query_id, chunk_id, doc_id, rank AS first_rank, {e} AS score FROM fuse_base"
        for r, e in [("lexical", "lexical"), ("dense", "dense"), ("overlap", "single")]
    ),
    "fuse_base": """SELECT j.query_id, j.chunk_id, j.doc_id, j.rank, h.lexical, h.dense, j.single
        FROM judged j JOIN hyb h ON h.query_id = j.query_id AND h.chunk_id = j.chunk_id""",
    "spans": """SELECT *, min(coalesce(score, 0)) OVER w AS lo, max(coalesce(score, 0)) OVER w AS hi,
        row_number() OVER (PARTITION BY ranker, query_id ORDER BY score DESC NULLS LAST, first_rank) AS pos,
        count(*) OVER w AS size FROM long_scores WINDOW w AS (PARTITION BY ranker, query_id)""",
    "normed": """SELECT *, CASE WHEN hi > lo THEN (coalesce(score, 0) - lo) / (hi - lo) ELSE 0 END AS norm FROM spans""",
}
FUSE_SQL = {
    "rrf": "sum(1.0::DOUBLE / (60 + pos))",
    "combsum": "sum(norm)",
    "combmnz": "sum(norm) * greatest(1, count(*) FILTER (norm > 0.5))",
    "borda": "sum(size - pos)::DOUBLE",
    "geometric": "product(norm + 0.01)",
    "max": "max(norm)",
}


def _fuse(method: str) -> str:
    return sql(
        f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank, chunk_id, score
        FROM (SELECT query_id, chunk_id, first_rank, round({FUSE_SQL[method]}, 9) AS score FROM normed GROUP BY ALL)""",
        FUSE_TABLES,
    )


_PLANS = plan_grid(RANKERS)
GRID_TABLES = FUSE_TABLES | {
    "combos": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}::BIGINT, '{label}', '{method}', {len(w)}::BIGINT)" for i, label, method, w in _PLANS) + ") t(combo, label, method, n_rankers)",
    "members": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{r}')" for i, _, _, w in _PLANS for r in w) + ") t(combo, ranker)",
    "grid_lists": f"""
        SELECT combo::VARCHAR AS strategy, query_id, doc_id,
               row_number() OVER (PARTITION BY combo, query_id ORDER BY score DESC, first_rank) AS rank
        FROM (SELECT combo, query_id, chunk_id, doc_id, first_rank, round(CASE any_value(method)
                {" ".join(f"WHEN '{m}' THEN {e}" for m, e in FUSE_SQL.items())} END, 9) AS score
              FROM normed JOIN members USING (ranker) JOIN combos USING (combo)
              GROUP BY combo, query_id, chunk_id, doc_id, first_rank)""",
    "halves": """SELECT query_id, row_number() OVER (ORDER BY query_id) % 2 = 1 AS dev
        FROM (SELECT DISTINCT query_id FROM gold)""",
    "grid": """
        SELECT c.combo, label, n_rankers, round(avg(hit_at_1) FILTER (dev), 9) AS dev_r1, round(avg(hit_at_1) FILTER (NOT dev), 9) AS test_r1,
               round(avg(rr) FILTER (NOT dev), 9) AS test_mrr, round(avg(ndcg) FILTER (NOT dev), 9) AS test_ndcg
        FROM per_query p JOIN halves USING (query_id) JOIN combos c ON c.combo = p.strategy::INT GROUP BY ALL""",
} | _metric_tables("grid_lists")

# ----------------------------------------------------------------- line ranges


def _line_tables(size: int) -> dict[str, str]:
    return {
        "doc_lines": r"""SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS lines FROM docs""",
        "cut_lines": f"""
            SELECT * FROM (SELECT doc_id, a + 1 AS start_line, least(a + {size}, len(lines)) AS end_line,
                array_to_string(lines[a + 1 : a + {size}], chr(10)) AS body
            FROM (SELECT *, unnest(range(0, len(lines), {size})) AS a FROM doc_lines)) WHERE length(trim(body, {BLANK})) > 0""",
    }


RANGE_TABLES = _line_tables(LINE_WINDOW) | {
    # the same lexical tables over line windows
    "chunks": "SELECT doc_id * 4294967296 + start_line AS chunk_id, doc_id, '' AS title, start_line, end_line, body FROM cut_lines",
    "chunk_text": "SELECT chunk_id, 'doc' || doc_id || chr(10) || body AS text FROM chunks",
    "bm": _top("bm25", 120),
    "ranked_windows": "SELECT query_id, rank, chunk_id, doc_id, start_line, end_line FROM bm JOIN chunks USING (chunk_id)",
    "bm200": _top("bm25", 200),
    "file_windows": "SELECT query_id, rank, doc_id FROM bm200 JOIN chunks USING (chunk_id)",
    "tool30": _top("fts", 30),
    "tool": """SELECT query_id, doc_id, start_line, end_line, rank AS pos,
        CASE WHEN rank % 5 <> 0 THEN round(score / (score + 10), 6) END AS p FROM tool30 JOIN chunks USING (chunk_id)""",
    "best3": """SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coalesce(p, 0) DESC, pos) AS range_rank
        FROM tool QUALIFY range_rank <= 3""",
    "covered": """SELECT query_id, count(*) AS lines FROM (
        SELECT DISTINCT query_id, doc_id, unnest(range(start_line, end_line + 1)) AS line FROM best3) GROUP BY 1""",
    "prefix": """SELECT w.*, sum(end_line - start_line + 1) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used,
        greatest(coalesce(lines, 0), 80) AS room FROM ranked_windows w LEFT JOIN covered USING (query_id) QUALIFY used <= room""",
    "file_ranks": """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS file_rank
        FROM file_windows GROUP BY query_id, doc_id""",
    "regions": """SELECT query_id, doc_id, s AS start_line, s + len(string_split(question, chr(10))) - 1 AS end_line
        FROM (SELECT query_id, doc_id, question, len(string_split(left(text, instr(text, question) - 1), chr(10))) AS s
              FROM gold JOIN questions USING (query_id) JOIN docs USING (doc_id))""",
}


def _region_recall(ranges: str) -> str:
    return f"""SELECT query_id, count(*) AS n_regions, round(avg(hit::INT), 9) AS region_recall FROM (
        SELECT r.query_id, EXISTS (SELECT 1 FROM {ranges} x WHERE x.query_id = r.query_id AND x.doc_id = r.doc_id
            AND x.start_line <= r.end_line AND r.start_line <= x.end_line) AS hit FROM regions r) GROUP BY 1"""


# -------------------------------------------------------------- classification
CLASS_TABLES = {
    "vecs": "SELECT vec_id AS id, label::BIGINT AS label, embedding::DOUBLE[] AS vec FROM embeddings",
    "parts": "SELECT *, ('0x' || substring(md5(id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE AS is_test FROM vecs",
    "near": """SELECT t.id, t.label AS gold, c.id AS train_id, c.label,
        round(list_cosine_similarity(t.vec, c.vec), 9) AS sim,
        row_number() OVER (PARTITION BY t.id ORDER BY round(list_cosine_similarity(t.vec, c.vec), 9) DESC, c.id) AS rank
        FROM parts t, parts c WHERE t.is_test AND NOT c.is_test QUALIFY rank <= 10""",
    "means": """SELECT label, list(x ORDER BY pos) AS vec FROM (
        SELECT label, pos, round(avg(vec[pos]), 6) AS x FROM parts, range(1, 65) r(pos) WHERE NOT is_test GROUP BY ALL) GROUP BY label""",
    "sims": """SELECT t.id, t.label AS gold, m.label, round(list_cosine_similarity(t.vec, m.vec), 9) AS sim
        FROM parts t, means m WHERE t.is_test""",
    "probs": """
        SELECT 'knn10' AS arm, id, gold, label, round(sum(sim) / sum(sum(sim)) OVER (PARTITION BY id), 9) AS p FROM near GROUP BY id, gold, label
        UNION ALL
        SELECT 'zeroshot', id, gold, label, round(e / sum(e) OVER (PARTITION BY id), 9) FROM (
          SELECT *, exp((sim - max(sim) OVER (PARTITION BY id)) / 0.02::DOUBLE) AS e FROM sims)""",
    "preds": """SELECT arm, id, any_value(gold) AS gold, list(label ORDER BY p DESC, label)[1] AS pred,
        max(p) AS conf, list(label ORDER BY p DESC, label)[1:10] AS top, bool_or(false) AS unused FROM probs GROUP BY arm, id""",
    "ok": "SELECT *, pred = gold AS right_one FROM preds",
    "gated": "SELECT * FROM ok WHERE arm IN (SELECT arm FROM ok GROUP BY arm HAVING count(conf) >= 0.95 * count(*))",
    "by_conf": """SELECT *, row_number() OVER w AS i, sum(right_one::INT) OVER w AS hits, count(*) OVER (PARTITION BY arm) AS n
        FROM gated WINDOW w AS (PARTITION BY arm ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING)""",
    "positions": "SELECT *, row_number() OVER (PARTITION BY arm ORDER BY id) - 1 AS idx FROM gated",
    "steps": """SELECT d.arm, t.thr, count(*) AS n, sum(right_one::INT) AS hits
        FROM (SELECT DISTINCT arm, round_even(conf, 4) AS thr FROM positions WHERE idx % 2 = 0) t
        JOIN positions d ON d.arm = t.arm AND d.idx % 2 = 0 AND d.conf >= t.thr GROUP BY ALL""",
    "chosen": "SELECT arm, min(thr) FILTER (hits >= n * 0.95::DOUBLE) AS threshold FROM steps GROUP BY arm",
    "discord": """SELECT count(*) AS n, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (
        SELECT bool_or(right_one) FILTER (arm = 'knn10') AS a, bool_or(right_one) FILTER (arm = 'zeroshot') AS b FROM ok GROUP BY id)""",
    "label_means": """SELECT label AS query_id, list(x ORDER BY pos) AS vec FROM (
        SELECT label, pos, round(avg(vec[pos]), 6) AS x FROM vecs, range(1, 65) r(pos) GROUP BY ALL) GROUP BY label""",
    "dense_scores": """SELECT query_id, v.id AS chunk_id, round(list_cosine_similarity(q.vec, v.vec), 9) AS score
        FROM label_means q, vecs v""",
}

# ---------------------------------------------------------------------- pages
PAGE_TABLES = {
    "md": f"SELECT page_id AS doc_id, {MARKDOWN} AS text FROM pages",
    "md_lines": r"""SELECT doc_id, ln, list_extract(string_split(text, chr(10)), ln + 1) AS line, len(string_split(text, chr(10))) AS n
        FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS ln FROM md)""",
    "heads": r"""SELECT doc_id, ln, n, length(regexp_extract(line, '^(#{1,4})\s+(.*)$', 1)) AS level,
        trim(regexp_extract(line, '^(#{1,4})\s+(.*)$', 2)) AS heading FROM md_lines WHERE regexp_matches(line, '^#{1,4}\s+.*$')""",
    "enclosing": """SELECT h.doc_id, h.ln, string_agg(o.heading, ' > ' ORDER BY o.ln) AS path FROM heads h JOIN heads o
        ON o.doc_id = h.doc_id AND o.ln <= h.ln AND NOT EXISTS (
          SELECT 1 FROM heads x WHERE x.doc_id = h.doc_id AND x.ln > o.ln AND x.ln <= h.ln AND x.level <= o.level)
        GROUP BY ALL""",
    "marks": """SELECT doc_id, ln, heading, path, n FROM heads JOIN enclosing USING (doc_id, ln)
        UNION ALL SELECT DISTINCT doc_id, -1, '', '', n FROM md_lines""",
    "sections": f"""SELECT * FROM (
        SELECT doc_id, m.ln, heading, path, until - m.ln - 1 AS n_lines,
          list_slice(string_split(md.text, chr(10)), m.ln + 2, until) AS body_lines
        FROM (SELECT *, coalesce(lead(ln) OVER (PARTITION BY doc_id ORDER BY ln), n) AS until FROM marks) m JOIN md USING (doc_id))
        WHERE heading <> '' OR trim(array_to_string(body_lines, chr(10)), {BLANK}) <> ''""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i, count(*) OVER (PARTITION BY doc_id) AS last FROM sections",
    # short sections move into the next one; the state is one row per section
    "merged": """
        SELECT doc_id, i, last, heading, path, body_lines AS held FROM numbered WHERE i = 1
        UNION ALL
        SELECT n.doc_id, n.i, n.last,
               CASE WHEN done OR m.heading = '' THEN n.heading ELSE m.heading END,
               CASE WHEN done OR m.path = '' THEN n.path ELSE m.path END,
               CASE WHEN done THEN n.body_lines ELSE
                 list_concat(list_append(m.held, CASE WHEN m.heading <> '' THEN '## ' || n.heading ELSE '' END), n.body_lines) END
        FROM (SELECT *, length(trim(regexp_replace(array_to_string(held, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) >= 120 AS done FROM merged) m JOIN numbered n ON n.doc_id = m.doc_id AND n.i = m.i + 1""",
    "whole_sections": """SELECT * FROM (SELECT doc_id, i, heading, path, trim(regexp_replace(array_to_string(held, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body, i = last AS ends FROM merged)
        WHERE length(body) >= 120 OR ends""",
    "paragraphs": r"""SELECT doc_id, i, k, ps[k] AS p, len(ps) AS n FROM (
        SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM (
          SELECT doc_id, i, regexp_split_to_array(body, '\n{2,}') AS ps FROM whole_sections WHERE length(body) > 1400))""",
    # paragraph packing: ``buf`` is the open window after paragraph k, ``shut`` the one it closed
    "packed": """
        SELECT doc_id, i, 0::BIGINT AS k, ''::VARCHAR AS buf, ''::VARCHAR AS shut, ''::VARCHAR AS wide FROM paragraphs WHERE k = 1
        UNION ALL
        SELECT p.doc_id, p.i, p.k,
               CASE WHEN length(p.p) > 1400 THEN ''
                    WHEN length(o.buf) + length(p.p) + 2 <= 1400 THEN CASE WHEN o.buf = '' THEN p.p ELSE o.buf || chr(10) || chr(10) || p.p END
                    WHEN o.buf <> '' AND length(right(o.buf, 200)) < length(p.p) THEN right(o.buf, 200) || chr(10) || chr(10) || p.p
                    ELSE p.p END,
               CASE WHEN length(p.p) > 1400 OR length(o.buf) + length(p.p) + 2 > 1400 THEN o.buf ELSE '' END,
               CASE WHEN length(p.p) > 1400 THEN p.p ELSE '' END
        FROM packed o JOIN paragraphs p ON p.doc_id = o.doc_id AND p.i = o.i AND p.k = o.k + 1""",
    "pieces_of": f"""
        SELECT doc_id, i, k, 0 AS part, trim(shut, {BLANK}) AS body FROM packed WHERE trim(shut, {BLANK}) <> ''
        UNION ALL SELECT doc_id, i, k, 1 + c, substring(wide, c * 1200 + 1, 1400) FROM (
          SELECT *, unnest(range(CAST(ceil(length(wide) / 1200.0) AS BIGINT))) AS c FROM packed WHERE wide <> '')
        UNION ALL SELECT p.doc_id, p.i, p.k + 1, 0, trim(buf, {BLANK}) FROM packed p JOIN (
          SELECT DISTINCT doc_id, i, n FROM paragraphs) e ON e.doc_id = p.doc_id AND e.i = p.i AND e.n = p.k WHERE trim(buf, {BLANK}) <> ''
        UNION ALL SELECT doc_id, i, 0, 0, body FROM whole_sections WHERE length(body) BETWEEN 1 AND 1400""",
    "md_chunks": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k, part) - 1 AS ordinal,
        heading, path AS heading_path, x.body FROM pieces_of x JOIN whole_sections w USING (doc_id, i)""",
    "titles": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages""",
}
PUNCT = "[§()\\[\\]{}.:,;\"''–—-]"
STRUCTURAL = "('luku','mom','momentti','pykälä','liite','osa','kohta','ja','tai')"


def _heading_tokens(x: str) -> str:
    return (
        rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(string_split({x}, '/')[-1]), '{PUNCT}', ' ', 'g'), '\s+'), "
        rf"lambda t: length(t) > 2 AND NOT regexp_full_match(t, '\d+') AND NOT regexp_full_match(t, '[ivxlcdm]+') AND t NOT IN {STRUCTURAL}))"
    )


def _section_number(x: str) -> str:
    return (
        rf"coalesce(nullif(regexp_extract({x}, '(\d+)\s*\.?\s*§|§\s*(\d+)', 1), ''), "
        rf"nullif(regexp_extract({x}, '(\d+)\s*\.?\s*§|§\s*(\d+)', 2), ''))::DOUBLE"
    )


def _normal_heading(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[§.:,]', ' ', 'g'), '\s+', ' ', 'g'))"


def _headings_match(a: str, b: str) -> str:
    ta, tb = _heading_tokens(a), _heading_tokens(b)
    na, nb = _section_number(a), _section_number(b)
    shared, smaller = f"len(list_intersect({ta}, {tb}))", f"least(len({ta}), len({tb}))"
    return (
        f"(({na} IS NULL OR {nb} IS NULL OR {na} = {nb}) AND {smaller} >= 1 AND "
        f"({shared} = {smaller} OR ({shared} >= 2 AND {shared} / {smaller} >= 0.6)))"
    )


def _section_hit(sections: str, heading: str, path: str) -> str:
    return (f"coalesce(trim({sections}, {BLANK}) <> '' AND ({_headings_match(sections, heading)} OR "
            f"(length({_normal_heading(sections)}) > 12 AND contains({_normal_heading(path)}, {_normal_heading(sections)}))), false)")


# BM25 over the heading chunks of pages, asked with the article heading of every page; relevance of the page and of the section.
PAGE_SEARCH = PAGE_TABLES | {
    "questions": "SELECT page_id AS query_id, heading AS question FROM titles",
    "chunks": "SELECT doc_id * 4294967296 + ordinal AS chunk_id, doc_id, ordinal, heading, heading_path, body FROM md_chunks",
    "chunk_text": "SELECT chunk_id, heading_path || chr(10) || body AS text FROM chunks",
    "page_list": _top("bm25", 30),
    "page_rows": f"""SELECT l.query_id, l.rank, l.score, c.doc_id, c.ordinal, c.doc_id = l.query_id AS rel_doc,
        c.doc_id = l.query_id AND {_section_hit('q.question', 'c.heading', 'c.heading_path')} AS rel_section
        FROM page_list l JOIN chunks c USING (chunk_id) JOIN questions q ON q.query_id = l.query_id""",
} | _metric_tables("page_list") | {
    "flagged": """SELECT 'doc' AS strategy, query_id, rank, rel_doc AS rel FROM page_rows
        UNION ALL SELECT 'section', query_id, rank, rel_section FROM page_rows""",
    "asked": f"""SELECT DISTINCT 'doc' AS strategy, query_id FROM questions JOIN chunks ON doc_id = query_id
        UNION SELECT 'section', query_id FROM questions q JOIN chunks c ON c.doc_id = q.query_id
        WHERE {_section_hit('q.question', 'c.heading', 'c.heading_path')}""",
}
TENTH_ASKED = {"questions": "SELECT page_id AS query_id, heading AS question FROM titles WHERE page_id % 10 = 0"}
NEAREST = PAGE_TABLES | {
    "wanted": r"""SELECT page_id, title, lower(regexp_split_to_array(regexp_replace(title, '^\d+[.\s§]*', ''), '\s+')[1]) AS word FROM titles""",
    "lost": f"""SELECT page_id FROM wanted t LEFT JOIN md_chunks c ON c.doc_id = t.page_id GROUP BY page_id
        HAVING NOT bool_or({_section_hit('t.title', 'c.heading', 'c.heading_path')})""",
    "close": """SELECT page_id, heading, row_number() OVER (PARTITION BY page_id ORDER BY ordinal) AS i FROM wanted JOIN md_chunks ON doc_id = page_id
        WHERE length(word) > 4 AND contains(lower(heading), word) QUALIFY i <= 3""",
}


def _judged(rank: str, score: str, extra: dict[str, str] | None = None) -> str:
    return sql(f"SELECT query_id, {rank} AS rank, rank AS first_rank, chunk_id, {score} AS score FROM cascade", extra)


def _stored(score: str) -> str:
    return sql(f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score IS NULL, score DESC, first_rank) AS rank,
        first_rank, chunk_id, score FROM (SELECT h.query_id, h.rank AS first_rank, h.chunk_id, {score} AS score
        FROM hyb h LEFT JOIN stored s ON s.query_id = h.query_id AND s.chunk_id = h.chunk_id)""")


def _draw(index: str, seed: int = C.seed) -> str:
    m = "4294967296::HUGEINT"
    a = f"(({seed}::HUGEINT + {index}::HUGEINT * 1831565813) % {m})"
    steps = f"(SELECT {a} AS a)"
    t1 = f"(SELECT (xor(a::BIGINT, (a::BIGINT >> 15))::HUGEINT * (a::BIGINT | 1)::HUGEINT) % {m} AS t FROM {steps})"
    t2 = f"(SELECT xor(((t + (xor(t::BIGINT, t::BIGINT >> 7)::HUGEINT * (t::BIGINT | 61)::HUGEINT) % {m}) % {m})::BIGINT, t::BIGINT) AS u FROM {t1})"
    return f"(SELECT xor(u, u >> 14)::DOUBLE / 4294967296.0::DOUBLE FROM {t2})"


POOL = {
    "pool": """SELECT doc_id, folder, row_number() OVER (ORDER BY doc_id) AS i FROM docs
        WHERE doc_id NOT IN (SELECT doc_id FROM gold)
          AND folder IN (SELECT folder FROM docs WHERE doc_id IN (SELECT doc_id FROM gold))""",
    "drawn": f"SELECT doc_id, folder, {_draw('pool.i')} AS draw FROM pool",
}
STRAT = (RELATIVE | {"strategy_lists": "SELECT strategy, query_id, doc_id, rank FROM strategies"}
         | _metric_tables("strategy_lists") | _all_asked("strategy_lists"))
STAGE = STAGE_LISTS | _metric_tables("stage_lists") | _all_asked("stage_lists")
PAIRED = STRAT | {
    "moved": """SELECT a.strategy, a.query_id, coalesce(b.first_rank, 999) AS before, coalesce(a.first_rank, 999) AS after
        FROM per_query a JOIN per_query b ON b.query_id = a.query_id AND b.strategy = 'hybrid' WHERE a.strategy <> 'hybrid'"""
}
ABSTAIN = STRAT | {
    "tops": """SELECT p.strategy, p.query_id, p.first_rank, s.score AS top_score FROM per_query p
        LEFT JOIN strategies s ON s.strategy = p.strategy AND s.query_id = p.query_id AND s.rank = 1""",
    "scales": f"""SELECT strategy, count(*) AS evaluable, unnest(CASE WHEN max(top_score) > 1.5
        THEN {RUBRIC_STEPS}::DOUBLE[] ELSE {PROBABILITY_STEPS}::DOUBLE[] END) AS threshold FROM tops GROUP BY strategy HAVING max(top_score) IS NOT NULL""",
}
USAGE = {
    "usage": """
        SELECT query_id, count(*) AS n, sum(plen) AS chars, max(qlen) AS q, count(*) FILTER (single IS NULL) AS failed,
               ceil(count(*) / 15.0)::BIGINT AS batches, least(count(*), 10) AS kept,
               sum(plen) FILTER (r_batched <= 10) AS kept_chars, count(*) FILTER (single IS NULL AND r_batched <= 10) AS failed_again
        FROM judge_ranks GROUP BY query_id""",
    "used": """
        SELECT 'hybrid+single' AS strategy, n AS requests, failed, chars + q * n AS units FROM usage
        UNION ALL SELECT 'hybrid+batched', batches, failed, chars + q * batches FROM usage
        UNION ALL SELECT 'hybrid+cascade', batches + kept, failed + failed_again, chars + q * (batches + kept) + kept_chars FROM usage""",
}
EVENT_LABELS = "['click', 'error', 'purchase', 'signup', 'view']"
MASS = {
    "option_rows": f"""SELECT user_id AS id, {EVENT_LABELS}[k + 1] AS label, exp(-value / 10.0::DOUBLE) AS m
        FROM (SELECT user_id, value, (props->>'$.k')::INT AS k FROM events) WHERE k < 5""",
    "option_sums": "SELECT id, label, sum(m) AS m, sum(sum(m)) OVER (PARTITION BY id) AS total FROM option_rows GROUP BY id, label",
}
SPANS = {
    "ordered": """SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events"""
}
FILES = {
    "pieces": f"""SELECT doc_id, i, trim(p, {BLANK}) AS p FROM (SELECT doc_id, unnest(string_split(replace(text, '.', '.md,'), ',')) AS p,
        generate_subscripts(string_split(replace(text, '.', '.md,'), ','), 1) AS i FROM docs) WHERE length(trim(p, {BLANK})) > 0""",
    "glued": """SELECT *, coalesce(sum((lower(p) LIKE '%.md')::INT) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM pieces""",
    "items": "SELECT doc_id, g, string_agg(p, ', ' ORDER BY i) AS item FROM glued GROUP BY ALL",
}

RANKED = "query_id, rank, chunk_id, score"

ORACLE: dict[str, str] = {
    "dense_topk": sql(_top("dense_scores", 30), CLASS_TABLES),
    "dense_norm_topk": sql(_top("dense_scores", 200), CLASS_TABLES),
    "bm25_topk": sql(_top("bm25", 30)),
    "bm25_statistics": sql("""
        SELECT term, count(*) AS df, sum(len(tokens))::BIGINT AS len_sum FROM
          (SELECT tokens, unnest(list_distinct(tokens)) AS term FROM unit_tokens)
        WHERE term IN (SELECT term FROM q_terms) GROUP BY term
        UNION ALL SELECT '', count(*), sum(len(tokens))::BIGINT FROM unit_tokens"""),
    "lexical_or_match": sql(f"""
        SELECT query_id, count(chunk_id) AS matched_units, coalesce(max(terms), 0) AS most_terms FROM questions LEFT JOIN (
          SELECT query_id, chunk_id, count(*) AS terms FROM (SELECT DISTINCT query_id, unnest({words('question')}) AS term FROM questions)
          JOIN (SELECT DISTINCT chunk_id, unnest({words('body')}) AS term FROM chunks) USING (term) GROUP BY ALL) USING (query_id)
        GROUP BY query_id"""),
    "lexical_weighted_topk": sql(_top("fts", 30)),
    "hashed_vector_topk": sql(_top("cosines", 30)),
    "hybrid_rrf": sql(f"SELECT {RANKED} FROM hyb"),
    "first_stages": sql("""SELECT stage, query_id, count(*) AS n, min(score) AS least, max(score) AS most,
        count(DISTINCT chunk_id // 4294967296) AS documents FROM short GROUP BY ALL"""),
    "shortlist_passages": sql("SELECT query_id, rank, chunk_id, title, length(passage) AS n_chars, md5(passage) AS digest FROM pairs"),
    "or_queries": sql(f"SELECT query_id, array_to_string({OR_TERMS}, ' OR ') AS or_query FROM questions"),
    "verbatim_gold": sql("SELECT query_id, doc_id FROM gold"),
    **{f"fuse_{m}": _fuse(m) for m in FUSE_SQL},
    "fuse_normalised": sql("SELECT ranker, query_id, chunk_id, pos, round(norm, 9) AS norm FROM normed", FUSE_TABLES),
    "fusion_grid_devtest": sql("SELECT combo, label, n_rankers, dev_r1, test_r1, test_mrr, test_ndcg FROM grid", GRID_TABLES),
    "fusion_top": sql("""SELECT row_number() OVER (ORDER BY dev_r1 DESC, combo) AS place, label, dev_r1, test_r1, test_mrr, test_ndcg
        FROM grid QUALIFY place <= 12""", GRID_TABLES),
    "cost_with_surcharge": """SELECT role, count(*) AS n, round(avg(length(text) / 1e6 * CASE WHEN role = 'user' THEN 0.4::DOUBLE ELSE 1.6::DOUBLE END) * 1000
        + CASE WHEN role = 'user' THEN 0.02::DOUBLE ELSE 0 END, 9) AS usd_per_1000 FROM conversations GROUP BY role""",
    "label_samples": sql("""SELECT label, id FROM vecs QUALIFY row_number() OVER (PARTITION BY label
        ORDER BY ('0x' || substring(md5(id::VARCHAR), 1, 8))::BIGINT, id) <= 5""", CLASS_TABLES),
    "reparsed_answers": "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type = 'signup' THEN NULL ELSE event_type END AS pred FROM events",
    "fusion_verdict": sql("""SELECT kind, label, dev_r1, test_r1, test_mrr FROM (
        SELECT *, CASE WHEN n_rankers = 1 THEN 'single' ELSE 'fusion' END AS kind FROM grid)
        QUALIFY row_number() OVER (PARTITION BY kind ORDER BY dev_r1 DESC, combo) = 1""", GRID_TABLES),
    "doc_windows": sql("SELECT chunk_id, doc_id, ordinal, length(body) AS n_chars, md5(body) AS digest FROM chunks"),
    "line_windows": sql("SELECT doc_id, start_line, end_line, md5(body) AS digest FROM cut_lines", _line_tables(C.line_window)),
    "heading_outline": sql("SELECT doc_id, i - 1 AS position, heading, path, n_lines FROM numbered", PAGE_TABLES),
    "markdown_chunks": sql("""SELECT doc_id, ordinal, heading, heading_path, length(body) AS n_chars, md5(body) AS digest
        FROM md_chunks""", PAGE_TABLES),
    "section_mask": sql(f"""SELECT doc_id, coalesce(bool_or(hit), false) AS evaluable, count(*) FILTER (hit) AS matching_chunks FROM (
        SELECT t.page_id AS doc_id, trim(t.heading, {BLANK}) <> '' AND ({_headings_match('t.heading', 'c.heading')} OR
          (length({_normal_heading('t.heading')}) > 12 AND contains({_normal_heading('c.heading_path')}, {_normal_heading('t.heading')}))) AS hit
        FROM titles t LEFT JOIN md_chunks c ON c.doc_id = t.page_id) GROUP BY doc_id""", PAGE_TABLES),
    "heading_features": sql(f"""SELECT page_id, array_to_string(list_sort({_heading_tokens('title')}), ' ') AS tokens,
        {_section_number('title')} AS number, {_normal_heading('title')} AS normal FROM titles""", PAGE_TABLES),
    "heading_match": sql(f"SELECT page_id, {_headings_match('title', 'heading')} AS same FROM titles", PAGE_TABLES),
    "reachability": sql("""SELECT q.query_id, count(c.chunk_id) AS gold_chunks, count(*) FILTER (contains(c.body, q.question)) AS holding_chunks
        FROM questions q LEFT JOIN gold g USING (query_id) LEFT JOIN chunks c ON c.doc_id = g.doc_id GROUP BY q.query_id"""),
    "passage_texts": sql("""SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (
        SELECT doc_id, CASE WHEN lang = 'en' THEN lang ELSE title || ' — ' || lang END || chr(10) || chr(10) || text AS t FROM docs)"""),
    "title_fallback": sql("SELECT doc_id, CASE WHEN lang = 'fr' THEN doc_id::VARCHAR ELSE title END AS title FROM docs"),
    "file_lists": sql("""SELECT d.doc_id, count(item) AS n_items, md5(coalesce(string_agg(item, '|' ORDER BY g), '')) AS digest
        FROM docs d LEFT JOIN items USING (doc_id) GROUP BY d.doc_id""", FILES),
    "section_lists": sql(f"""SELECT doc_id, len(x) AS n_items, md5(array_to_string(x, '|')) AS digest FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '.', ';'), '[;|]'), lambda s: trim(s, {BLANK})), lambda s: length(s) > 0) AS x FROM docs)"""),
    "page_topk": sql("SELECT query_id, rank, doc_id, ordinal, score FROM page_rows", PAGE_SEARCH | TENTH_ASKED),
    "page_section_metrics": sql("SELECT strategy AS level, * EXCLUDE (strategy) FROM per_query", PAGE_SEARCH),
    "ir_metrics_section": sql(f"SELECT strategy AS level, {METRIC_MEANS} FROM per_query GROUP BY strategy", PAGE_SEARCH),
    "nearest_headings": sql("""SELECT l.page_id, count(heading) AS n_near, coalesce(string_agg(heading, ' | ' ORDER BY i), '') AS nearest
        FROM lost l LEFT JOIN close c ON c.page_id = l.page_id GROUP BY l.page_id""", NEAREST),
    "cells_recall": sql("""SELECT count(*) FILTER (id % 100 = 0) AS n_queries, (count(*) FILTER (id % 100 = 0) * least(30, count(*)))::BIGINT AS n_wanted,
        true AS enough FROM vecs""", CLASS_TABLES),
    "qrels_group": sql("SELECT query_id, count(*) AS n_gold, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM gold GROUP BY 1"),
    "positive_labels": sql("""SELECT folder, count(*) AS positives, sum(toxic)::BIGINT AS toxic FROM labels JOIN docs USING (doc_id)
        WHERE quality > 0 GROUP BY folder"""),
    "evaluable_queries": sql("SELECT query_id, length(question) AS n_chars FROM questions WHERE query_id IN (SELECT query_id FROM gold)"),
    "resolved_queries": sql("""SELECT *, n_files > 0 AND n_missing = 0 AS usable FROM (
        SELECT q.query_id, count(g.doc_id) AS n_files, count(g.doc_id) FILTER (l.doc_id IS NULL) AS n_missing,
               min(g.doc_id) FILTER (l.doc_id IS NULL) AS first_missing
        FROM questions q LEFT JOIN gold g USING (query_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = g.doc_id GROUP BY q.query_id)"""),
    "distractor_pool": sql("SELECT doc_id, folder, draw FROM drawn", POOL),
    "corpus_selection": sql("""SELECT DISTINCT doc_id, 'gold' AS role FROM gold UNION ALL
        (SELECT doc_id, 'distractor' FROM (SELECT *, row_number() OVER (ORDER BY draw, doc_id) AS i FROM drawn)
         WHERE i <= greatest(160 - (SELECT count(DISTINCT doc_id) FROM gold), 0))""", POOL),
    "seeded_draws": f"SELECT event_id, {_draw('(events.event_id + 1)')} AS draw FROM events",
    "question_ids": """SELECT pos, node, CASE WHEN i > 1 THEN node || '.' || i ELSE node END AS id FROM (
        SELECT event_id AS pos, node, row_number() OVER (PARTITION BY node ORDER BY event_id) AS i
        FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'Q' ELSE event_type END AS node FROM events))""",
    "corpus_stats": sql("""SELECT count(*) AS documents, sum(c)::BIGINT AS chunks, sum(ch)::BIGINT AS chars, round(sum(ch) / sum(c), 9) AS mean_chars,
        min(c) AS min_chunks, max(c) AS max_chunks, list_sort(list(c))[count(*) // 2 + 1] AS median_chunks
        FROM (SELECT doc_id, count(*) AS c, sum(length(body)) AS ch FROM chunks GROUP BY 1)"""),
    "embed_cache_misses": sql("""SELECT sha256(text) AS key, count(*) AS copies, min(doc_id) AS doc_id FROM docs
        WHERE sha256(text) NOT IN (SELECT sha256(text) FROM docs JOIN labels USING (doc_id)) GROUP BY 1"""),
    "resume_todo": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "last_success_rows": """SELECT user_id, event_id, event_type, value, pos FROM (
        SELECT *, min(event_id) OVER (PARTITION BY user_id) AS pos, row_number() OVER (PARTITION BY user_id
          ORDER BY event_type = 'error', CASE WHEN event_type <> 'error' THEN -event_id ELSE event_id END) AS i FROM events) WHERE i = 1""",
    "strategy_append": """SELECT event_type, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'fresh' ELSE 'earlier' END AS run,
        round(avg(value), 6) AS score FROM events GROUP BY ALL""",
    "ir_metrics": sql("SELECT * FROM per_query", STAGE),
    "ir_metrics_agg": sql(f"SELECT strategy, {METRIC_MEANS} FROM per_query GROUP BY strategy", STAGE),
    "shortlist_ceiling": sql("SELECT strategy, count(*) AS n, round(avg((first_rank IS NOT NULL)::INT), 9) AS ceiling FROM per_query GROUP BY 1", STAGE),
    "rerank_single": _judged("r_single", "single"),
    "rerank_batched": _judged("r_batched", "batched", RELATIVE),
    "rerank_graded": _judged("r_graded", "graded"),
    "rerank_cascade": _judged("r_cascade", "s_cascade", RELATIVE),
    "rerank_precomputed": _stored("s.score"),
    "rerank_scattered": _stored("coalesce(s.score, 0)"),
    "rerank_metrics_agg": sql(f"SELECT strategy, {METRIC_MEANS} FROM per_query GROUP BY strategy", STRAT),
    "movement": sql("""SELECT strategy, count(*) FILTER (after < before) AS moved_up, count(*) FILTER (after > before) AS moved_down,
        count(*) FILTER (after = before) AS unchanged FROM moved GROUP BY 1""", PAIRED),
    "rescued_broken": sql("""SELECT * FROM (SELECT *, CASE WHEN after = 1 AND before > 3 THEN 'rescued' WHEN before = 1 AND after > 1 THEN 'broken'
        WHEN before = 999 AND after = 999 THEN 'missed' END AS outcome FROM moved) WHERE outcome IS NOT NULL""", PAIRED),
    "abstention_curve": sql("""SELECT s.strategy, threshold,
        round(count(*) FILTER (top_score >= threshold)::DOUBLE / any_value(evaluable), 9) AS answered,
        round(coalesce(count(*) FILTER (top_score >= threshold AND first_rank = 1)::DOUBLE / nullif(count(*) FILTER (top_score >= threshold), 0), 0), 9) AS precision
        FROM scales s JOIN tops t ON t.strategy = s.strategy GROUP BY s.strategy, threshold""", ABSTAIN),
    "usage_cost": sql("""SELECT strategy, count(*) AS questions, sum(requests)::BIGINT AS requests, sum(failed)::BIGINT AS failed,
        sum(units)::BIGINT AS input_units, round(sum(units) / 1e6 * 0.042::DOUBLE, 9) AS usd,
        round(sum(units) / 1e6 * 0.042::DOUBLE / count(*) * 1000, 9) AS usd_per_1000 FROM used GROUP BY strategy""", USAGE),
    "judge_requests": sql("""SELECT query_id, batch, count(*) AS candidates, count(*) FILTER (batched IS NULL) AS unanswered,
        (sum(plen) + max(qlen))::BIGINT AS input_units FROM batch_scores GROUP BY ALL"""),
    "window_judge": sql(f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank > 30, score IS NULL, score DESC, first_rank) AS rank,
        first_rank, chunk_id, score FROM (
          SELECT w.query_id, w.rank AS first_rank, w.chunk_id, CASE WHEN w.rank <= 30 THEN
            round(len(list_intersect(list_distinct({code_tokens('question')}), list_distinct({code_tokens('body')})))::DOUBLE
              / nullif(len(list_distinct({code_tokens('question')})), 0), 6) END AS score
          FROM ranked_windows w JOIN chunks USING (chunk_id) JOIN questions q ON q.query_id = w.query_id)""", RANGE_TABLES),
    "judge_summary": sql("SELECT query_id, count(single) AS scored, max(single) AS top_score FROM judged GROUP BY 1"),
    "latency_percentiles": sql("""SELECT event_type, max(n) AS n, min(value) FILTER (i = ceil(0.5 * n)) AS p50,
        min(value) FILTER (i = ceil(95 * n / 100.0)) AS p95 FROM ordered GROUP BY 1""", SPANS),
    "lower_index_percentiles": sql("""SELECT event_type, max(n) AS n, min(value) FILTER (i = n // 2 + 1) AS p50_index,
        min(value) FILTER (i = least(floor(n * 95 / 100.0) + 1, n)) AS p95_index, round(median(value), 9) AS median FROM ordered GROUP BY 1""", SPANS),
    "file_ranking": sql("SELECT query_id, file_rank, doc_id FROM file_ranks WHERE file_rank <= 20", RANGE_TABLES),
    "file_recall": sql("""SELECT g.query_id, count(*) AS n_gold, """ + ", ".join(
        f"round(count(*) FILTER (file_rank <= {d})::DOUBLE / count(*), 9) AS file_recall_at_{d}" for d in (1, 5, 10)) +
        " FROM gold g LEFT JOIN file_ranks f ON f.query_id = g.query_id AND f.doc_id = g.doc_id GROUP BY 1", RANGE_TABLES),
    "file_recall_at_budget": sql("""SELECT g.query_id, max(greatest(coalesce(n, 0), 1)) AS n_files,
        round(count(*) FILTER (file_rank <= greatest(coalesce(n, 0), 1))::DOUBLE / count(*), 9) AS file_recall_at_n
        FROM gold g LEFT JOIN file_ranks f ON f.query_id = g.query_id AND f.doc_id = g.doc_id
        LEFT JOIN (SELECT query_id, count(DISTINCT doc_id) AS n FROM tool GROUP BY 1) b ON b.query_id = g.query_id GROUP BY 1""", RANGE_TABLES),
    "passage_regions": sql("SELECT query_id, doc_id, start_line, end_line FROM regions", RANGE_TABLES),
    "region_recall": sql(_region_recall("best3"), RANGE_TABLES),
    "top_ranges": sql("SELECT query_id, doc_id, start_line, end_line, range_rank, p FROM best3", RANGE_TABLES),
    "covered_lines": sql("SELECT query_id, lines FROM covered", RANGE_TABLES),
    "budget_prefix": sql("SELECT query_id, rank, doc_id, start_line, end_line, used FROM prefix", RANGE_TABLES),
    "region_recall_at_budget": sql(_region_recall("prefix"), RANGE_TABLES),
    "zero_hit_queries": sql("""SELECT query_id FROM questions WHERE query_id NOT IN (
        SELECT query_id FROM gold JOIN file_windows USING (query_id, doc_id))""", RANGE_TABLES),
    "knn_neighbours": sql("SELECT id, rank, train_id, label, sim FROM near", CLASS_TABLES),
    "neighbour_examples": sql("SELECT id, string_agg(train_id || ':' || label, ' ' ORDER BY rank) AS examples FROM near GROUP BY id", CLASS_TABLES),
    "knn_vote": sql("SELECT arm, id, gold, pred, conf, array_to_string(top, ' ') AS top_labels FROM preds WHERE arm = 'knn10'", CLASS_TABLES),
    "zero_shot_softmax": sql("SELECT arm, id, gold, pred, conf, array_to_string(top, ' ') AS top_labels FROM preds WHERE arm = 'zeroshot'", CLASS_TABLES),
    "shortlist_labels": sql("""SELECT id, len(x) AS n_labels, array_to_string(list_sort(x), ' ') AS labels FROM (
        SELECT id, list_distinct(list_append(top, 0)) AS x FROM preds WHERE arm = 'knn10')""", CLASS_TABLES),
    "accuracy_wilson": sql("""SELECT arm, n, k AS "right", errors, round(k / n, 9) AS accuracy,
        round(greatest((k / n + z2 / (2 * n)) / (1 + z2 / n) - h, 0), 9) AS ci_low, round(least((k / n + z2 / (2 * n)) / (1 + z2 / n) + h, 1), 9) AS ci_high
        FROM (SELECT *, 1.959963984540054::DOUBLE / (1 + z2 / n) * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n)) AS h FROM (
          SELECT arm, count(*) AS n, count(*) FILTER (right_one) AS k, count(*) FILTER (pred IS NULL) AS errors,
                 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2 FROM ok GROUP BY arm))""", CLASS_TABLES),
    "complete_arms": sql("""SELECT arm, n, k AS "right", errors, round(k / n, 9) AS accuracy,
        round(greatest((k / n + z2 / (2 * n)) / (1 + z2 / n) - h, 0), 9) AS ci_low, round(least((k / n + z2 / (2 * n)) / (1 + z2 / n) + h, 1), 9) AS ci_high
        FROM (SELECT *, 1.959963984540054::DOUBLE / (1 + z2 / n) * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n)) AS h FROM (
          SELECT arm, count(*) AS n, count(*) FILTER (right_one) AS k, count(*) FILTER (pred IS NULL) AS errors,
                 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2 FROM ok WHERE arm = 'knn10' GROUP BY arm))""", CLASS_TABLES),
    "macro_f1": sql("""SELECT arm, count(*) AS labels, round(avg(2.0::DOUBLE * tp / (g + p)), 9) AS macro_f1 FROM (
        SELECT a.arm, l.label, count(*) FILTER (gold = l.label) AS g, count(*) FILTER (pred = l.label) AS p,
               count(*) FILTER (gold = l.label AND pred = l.label) AS tp
        FROM ok a, (SELECT DISTINCT gold AS label FROM ok) l GROUP BY ALL) GROUP BY arm""", CLASS_TABLES),
    "oos_metrics": sql("""SELECT arm, count(*) FILTER (gold = 0) AS n_oos,
        round(coalesce(count(*) FILTER (gold <> 0 AND right_one)::DOUBLE / nullif(count(*) FILTER (gold <> 0), 0), 0), 9) AS in_scope_accuracy,
        round(coalesce(count(*) FILTER (gold = 0 AND right_one)::DOUBLE / nullif(count(*) FILTER (gold = 0), 0), 0), 9) AS oos_recall,
        round(coalesce(count(*) FILTER (pred = 0 AND right_one)::DOUBLE / nullif(count(*) FILTER (pred = 0), 0), 0), 9) AS oos_precision
        FROM ok GROUP BY arm""", CLASS_TABLES),
    "calibration_error": sql("""SELECT arm, round(sum(n * abs(acc - c)) / sum(n), 9) AS ece FROM (
        SELECT arm, floor(least(greatest(conf, 0), 0.9999::DOUBLE) * 10) AS b, count(*) AS n, avg(right_one::INT) AS acc, avg(conf) AS c
        FROM gated GROUP BY ALL) GROUP BY arm""", CLASS_TABLES),
    "gate_validity": sql("SELECT arm, count(*) AS n, count(conf) AS with_conf FROM ok GROUP BY arm HAVING count(conf) >= 0.95 * count(*)", CLASS_TABLES),
    "coverage_at": sql("""SELECT arm, count(*) AS n, round(coalesce(max(i) FILTER (hits / i >= 0.95::DOUBLE), 0) / count(*), 9) AS coverage_95,
        round(coalesce(max(i) FILTER (hits / i >= 0.98::DOUBLE), 0) / count(*), 9) AS coverage_98 FROM by_conf GROUP BY arm""", CLASS_TABLES),
    "accuracy_top80": sql("""SELECT arm, count(*) AS kept, round(avg(right_one::INT), 9) AS accuracy_top FROM by_conf
        WHERE i <= round_even(n * 0.8::DOUBLE, 0) GROUP BY arm""", CLASS_TABLES),
    "heldout_gate": sql("""SELECT c.arm, any_value(threshold) AS threshold, round(count(*) FILTER (conf >= threshold)::DOUBLE / count(*), 9) AS coverage,
        round(coalesce(count(*) FILTER (conf >= threshold AND right_one)::DOUBLE / nullif(count(*) FILTER (conf >= threshold), 0), 0), 9) AS accuracy
        FROM positions p JOIN chosen c ON c.arm = p.arm AND p.idx % 2 = 1 GROUP BY c.arm""", CLASS_TABLES),
    "mcnemar": sql("""SELECT n, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(
        range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1)
        - (only_a + only_b) * ln(2))))) END, 9) AS p_value FROM discord""", CLASS_TABLES),
    "parse_labels": """SELECT event_id, CASE event_type WHEN 'signup' THEN NULL ELSE event_type END AS label FROM events""",
    "option_mass": sql("""SELECT id, arg_min(label, (-p, label)) AS pred, max(p) AS conf, count(*) AS options
        FROM (SELECT id, label, round(m / total, 9) AS p FROM option_sums) GROUP BY id""", MASS),
    "yesno_probability": f"""SELECT conv_id, turn, round(CASE WHEN y + n > 0 THEN y / (y + n) ELSE said END, 9) AS p, digit FROM (
        SELECT conv_id, turn, starts_with(lower(trim(text)), 'yes')::INT AS said,
          coalesce(nullif(regexp_extract(text, '([0-9])', 1), '')::INT, -1)::BIGINT AS digit,
          coalesce(list_sum(list_transform(list_filter({words('text')}, lambda w: starts_with(w, 'yes')), lambda w: exp(-length(w) / 4.0::DOUBLE))), 0) AS y,
          coalesce(list_sum(list_transform(list_filter({words('text')}, lambda w: starts_with(w, 'no')), lambda w: exp(-length(w) / 4.0::DOUBLE))), 0) AS n
        FROM conversations)""",
    "cost_per_thousand": """SELECT role, count(*) AS n, round(avg(length(text) / 1e6 * CASE WHEN role = 'user' THEN 0.4::DOUBLE ELSE 1.6::DOUBLE END) * 1000, 9)
        AS usd_per_1000, sum(length(text))::BIGINT AS units FROM conversations GROUP BY role""",
    "humanized_labels": "SELECT 'event ' || event_type AS label, count(*) AS n FROM events GROUP BY event_type",
}
