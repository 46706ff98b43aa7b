"""SQL for DuckDB that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

import string

from sitegrain.llm.common import WORD

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def _near(k: int, similar: int, more: str = "") -> str:
    """Classes of documents whose sets of ``k``-word shingles are ``similar`` hundredths alike."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{WORD}') w FROM documents),
     g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - {k - 2}), lambda p: array_to_string(list_slice(w, p, p + {k - 1}), ' ')) END) s FROM w),
     sh AS (SELECT DISTINCT doc_id, s FROM g),
     n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
     sets AS (SELECT doc_id, list(s ORDER BY s) ss FROM sh GROUP BY doc_id),
     rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ss) r FROM sets),
     rare AS (SELECT s FROM sh WHERE doc_id IN (SELECT r FROM rep) GROUP BY s HAVING count(*) > 1),
     rs AS (SELECT doc_id, s FROM sh WHERE doc_id IN (SELECT r FROM rep) AND s IN (SELECT s FROM rare)),
     o AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM rs a JOIN rs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
     link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {similar} * (x.n + y.n - c)),
     both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
     reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
     least_of AS (SELECT a, min(b) b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) n_shingles, least(coalesce(r, w.doc_id), coalesce(l.b, w.doc_id)) component_id{more}
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN least_of l ON l.a = coalesce(r, w.doc_id)"""


ORACLES = {
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') w FROM benchmark),
     iw AS (SELECT item_id, least(10, len(w)) m, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) p FROM b WHERE len(w) > 0),
     items AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') g FROM iw),
     sizes AS (SELECT DISTINCT m FROM items),
     dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) p FROM d, sizes WHERE len(w) >= m),
     hits AS (SELECT dw.doc_id, dw.p, dw.m, g FROM dw JOIN (SELECT DISTINCT m, g FROM items) i ON i.m = dw.m AND i.g = array_to_string(list_slice(dw.w, dw.p, dw.p + dw.m - 1), ' ')),
     hw AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(p, p + m)) q FROM hits) GROUP BY doc_id),
     hi AS (SELECT doc_id, count(*) n, string_agg(item, ',' ORDER BY item) ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM hits JOIN items USING (m, g)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(hw.n, 0) n_hit, coalesce(hi.n, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, hw.n IS NOT NULL contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op7_line_dedup": f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) line, unnest(range(len(ls))) pos FROM s),
     k AS (SELECT *, {_lower(f"trim(line, {_SPACES})")} AS key FROM l),
     dup AS (SELECT key, min(doc_id) keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) n_lines, count(*) FILTER (keeper <> k.doc_id) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = k.doc_id), '')) kept_sha256
FROM k LEFT JOIN dup USING (key) GROUP BY k.doc_id""",
    "op8_ngram_join": _near(5, 75),
    "op11_minhash": _near(4, 80, ", w.doc_id = least(coalesce(r, w.doc_id), coalesce(l.b, w.doc_id)) kept"),
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
     w AS (SELECT * FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM p) WHERE len(w) > 0),
     g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) s FROM w, range(1, 6) t(k) WHERE len(w) >= k),
     f AS (SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') phrase, count(*) f FROM g GROUP BY ALL HAVING count(*) >= 100),
     n AS (SELECT lang, sum(len(w))::BIGINT n FROM w GROUP BY lang),
     c AS (SELECT lang, k, phrase, string_split(phrase, ' ') w, f a FROM f WHERE k > 1),
     m AS (SELECT lang, k, w, a, unnest(range(2, k)) m FROM c WHERE k > 2),
     longer AS (SELECT lang, array_to_string(list_slice(w, s, s + m - 1), ' ') phrase, max(a) b FROM (SELECT *, unnest(range(1, k - m + 2)) s FROM m) GROUP BY ALL),
     kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a),
     cut AS (SELECT *, unnest(range(1, k)) x FROM kept),
     scored AS (SELECT cut.lang, cut.phrase, a, x, p.f l, q.f r, n, (1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) score
                FROM cut JOIN f p ON p.lang = cut.lang AND p.phrase = array_to_string(list_slice(w, 1, x), ' ')
                JOIN f q ON q.lang = cut.lang AND q.phrase = array_to_string(list_slice(w, x + 1, cut.k), ' ') JOIN n ON n.lang = cut.lang),
     best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, n, score::BIGINT score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
