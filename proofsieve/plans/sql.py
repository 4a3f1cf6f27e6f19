"""Pieces of DuckDB SQL that several registered queries share."""

from __future__ import annotations

from proofsieve.functions.terms import SIGNAL_TERMS
from proofsieve.functions.text import normalize_python


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normal(x: str) -> str:
    """SQL of normalize_token."""
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def intent_ctes(queries: str) -> str:
    rows = ", ".join(f"({quoted(key)}, {quoted(term)}, {quoted(normalize_python(term))})" for key, terms in SIGNAL_TERMS.items() for term in terms)
    return f"""terms(section_key, term, token) AS (VALUES {rows}),
ihit AS (SELECT query_id, section_key, term, token, CASE len(string_split(token, ' ')) WHEN 1 THEN 1.0 WHEN 2 THEN 1.75 ELSE 2.5 END::DOUBLE AS w FROM {queries} q JOIN terms ON contains({normal('q.text')}, token)),
iper AS (SELECT query_id, section_key, sum(w) AS score FROM ihit GROUP BY 1, 2),
isec AS (SELECT query_id, list(section_key ORDER BY score DESC, section_key)[1:3] AS target_sections, max(score) AS best FROM iper GROUP BY 1),
iterm AS (SELECT query_id, list(term ORDER BY token, term) AS matched_terms, list(token ORDER BY token, term) AS matched_tokens FROM (SELECT DISTINCT query_id, term, token FROM ihit) GROUP BY 1),
intent AS (SELECT q.query_id, coalesce(target_sections, []) AS target_sections, CASE WHEN best > 0 THEN round(least(0.95, best / (best + 2)), 4) ELSE 0.0 END::DOUBLE AS confidence, coalesce(matched_terms, []) AS matched_terms, coalesce(matched_tokens, []) AS matched_tokens
  FROM {queries} q LEFT JOIN isec USING (query_id) LEFT JOIN iterm USING (query_id))"""


def dense_ctes(queries: str, chunks: str, k: int, metric: str) -> str:
    a, b = "q.embedding::DOUBLE[]", "c.embedding::DOUBLE[]"
    distance = f"greatest(0, 1 - list_cosine_similarity({a}, {b}))" if metric == "cosine" else f"list_distance({a}, {b})"
    return f"""dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM
  (SELECT q.query_id, c.chunk_id, round({distance}, 9) AS distance FROM {queries} q JOIN {chunks} c ON q.ticker = c.ticker AND c.embedding IS NOT NULL)) WHERE rank <= {k})"""


#: Tokenizers of BM25 as SQL: runs of letters and digits in lower case, and white-space words with their case.
RUNS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
SPACED = r"list_filter(regexp_split_to_array({}, '[ \t\r\n\f]+'), lambda x: x <> '')"


def bm25_ctes(queries: str, chunks: str, k: int, split: str = RUNS, pad: bool = False) -> str:
    """``pad``: chunks with text that share no term with the query are hits of score 0."""
    found = """SELECT a.query_id, p.chunk_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))), 6) AS score
   FROM bask a JOIN bpost p ON a.ticker = p.ticker AND a.term = p.term JOIN bdf f ON f.ticker = p.ticker AND f.term = p.term JOIN bstat s ON s.ticker = p.ticker GROUP BY 1, 2"""
    if pad:
        found = rf"""SELECT query_id, chunk_id, max(score) AS score FROM ({found}
   UNION ALL SELECT q.query_id, c.chunk_id, 0 FROM {queries} q JOIN {chunks} c ON q.ticker = c.ticker WHERE regexp_matches(c.text, '[^ \t\r\n\f]')) GROUP BY 1, 2"""
    return f"""btok AS (SELECT ticker, chunk_id, {split.format('text')} AS t FROM {chunks}),
bstat AS (SELECT ticker, count(*) AS n, avg(len(t)) AS avgdl FROM btok GROUP BY 1),
bpost AS (SELECT ticker, chunk_id, term, dl, count(*) AS tf FROM (SELECT ticker, chunk_id, len(t) AS dl, unnest(t) AS term FROM btok) GROUP BY 1, 2, 3, 4),
bdf AS (SELECT ticker, term, count(*) AS df FROM bpost GROUP BY 1, 2),
bask AS (SELECT query_id, ticker, unnest(list_distinct({split.format('text')})) AS term FROM {queries}),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  ({found})) WHERE rank <= {k})"""
