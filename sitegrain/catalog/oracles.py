"""The same results in plain SQL, for checking the queries."""

from __future__ import annotations

from sitegrain.constants import NON_PAGE_EXTENSIONS, PAGE_EXTENSIONS, TWO_LABEL_SUFFIXES, USELESS_PHRASES


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# --- shared pieces ---------------------------------------------------------------------

ADDRESS = (
    r"((ht|f)tps?://)?[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_\-]+"
    r"([\p{L}\p{N}_\-.,@?^=%&:/~+#]*[\p{L}\p{N}_\-@?^=%&/~+#])?"
)


def host(u: str) -> str:
    rest = f"regexp_replace({u}, '^[^/:]+:', '')"
    return f"""regexp_replace(CASE
        WHEN regexp_matches({u}, '^([^/:]+:)?//[^/#?]') THEN regexp_extract({u}, '^([^/:]+:)?//([^/#?]+)', 2)
        WHEN NOT starts_with({rest}, '//') THEN {rest}
        WHEN {rest} = '//' OR starts_with({rest}, '///') THEN substr({rest}, 3)
        ELSE '/' || substr({rest}, 3) END, ':[0-9]*$', '')"""


def domain(h: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    labels = f"string_split({h}, '.')"
    last = lambda k: f"array_to_string(list_slice({labels}, greatest(len({labels}) - {k - 1}, 1), len({labels})), '.')"
    return f"""CASE WHEN regexp_matches({h}, '^({octet}[.]){{3}}{octet}$') THEN {h}
        WHEN len({labels}) < 3 THEN {h}
        WHEN '.' || {last(2)} IN {_in(TWO_LABEL_SUFFIXES)} THEN {last(3)}
        ELSE {last(2)} END"""


def _protocol(u: str) -> str:
    return f"coalesce(nullif(lower(regexp_extract({u}, '^([^/:]+):', 1)), ''), 'http')"


def _slashed(u: str) -> str:
    return f"""CASE WHEN regexp_matches({u}, '^[^/:]+:') THEN regexp_replace({u}, '^[^/:]+:', '') ELSE '//' || {u} END"""


def parts(source: str, u: str = "url") -> str:
    """Subquery with protocol, host, port, root and key of every row of a table."""
    return f"""(SELECT *, CASE WHEN p_host <> '' THEN p_root || CASE WHEN p_trim <> '' THEN p_trim || '/' ELSE '' END END AS p_key
      FROM (SELECT *, CASE WHEN p_ok AND p_host <> '' THEN p_protocol || '://' || p_host || ':' || p_port || '/' END AS p_root,
                   trim(regexp_replace(p_rest, '^//[^/#?]*', ''), '/') AS p_trim
      FROM (SELECT *, CASE WHEN p_ok THEN p_scheme END AS p_protocol,
                   CASE WHEN p_ok THEN regexp_replace(p_auth, ':[0-9]*$', '') END AS p_host,
                   CASE WHEN p_ok THEN coalesce(nullif(regexp_extract(p_auth, ':([0-9]+)$', 1), ''),
                        CASE WHEN p_scheme = 'https' THEN '443' ELSE '80' END) END AS p_port
      FROM (SELECT *, starts_with(p_rest, '//') AS p_ok, regexp_extract(p_rest, '^//([^/#?]*)', 1) AS p_auth
      FROM (SELECT *, {_protocol(u)} AS p_scheme, {_slashed(u)} AS p_rest FROM {source})))))"""


def is_page_link(l: str) -> str:
    return f"({l} LIKE '%download/app' OR regexp_extract({l}, '[^.]*$') NOT IN {_in(NON_PAGE_EXTENSIONS)})"


def completed(page: str, l: str) -> str:
    """Completion of a link without dot segments on an http(s) page."""
    root = f"(lower(regexp_extract({page}, '^([^/:]+):', 1)) || '://' || {host(page)})"
    short = f"regexp_replace({l}, '[.]+$', '')"
    bare = f"regexp_extract({page}, '^[^?#]*')"
    no_fragment = f"regexp_extract({page}, '^[^#]*')"
    folder = f"regexp_replace({bare}, '[^/]*$', '')"
    to_page = f"""(NOT regexp_matches({l}, '^.+[.].+') OR (length({l}) - length(replace({l}, '.', '')) <= 1
        AND regexp_extract({l}, '[^.]*$') IN {_in(PAGE_EXTENSIONS)}))"""
    return f"""CASE
        WHEN {l} LIKE '//%' THEN regexp_extract({page}, '^[^:]+:') || {short}
        WHEN {l} LIKE '/%' THEN {root} || {short}
        WHEN NOT {to_page} THEN {l}
        WHEN {l} = '' THEN {page}
        WHEN {l} LIKE '#%' THEN {no_fragment} || {l}
        WHEN {l} LIKE '?%' THEN {bare} || {l}
        WHEN regexp_matches({l}, '^[a-z]+:') THEN {l}
        ELSE {folder} || {l} END"""


def anchors_of(pages: str) -> str:
    return f"""(SELECT DISTINCT page_id, url, link FROM
    (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM {pages})
    WHERE link NOT IN ('/', '*'))"""


def page_links_of(pages: str) -> str:
    raw = f"""(SELECT page_id, url, link FROM {anchors_of(pages)}
    UNION SELECT page_id, url, unnest(regexp_extract_all(html, '{ADDRESS}')) FROM {pages})"""
    return f"""(SELECT DISTINCT page_id, url, {completed('url', 'link')} AS link FROM {raw}
    WHERE {is_page_link('link')})"""


ANCHORS, PAGE_LINKS = anchors_of("pages"), page_links_of("pages")


def scoped(level: int, links: str = PAGE_LINKS) -> str:
    test = {
        0: f"{host('link')} = {host('url')}",
        1: f"{domain('(' + host('link') + ')')} = {domain('(' + host('url') + ')')}",
        2: "true",
    }[level]
    return f"SELECT page_id, link FROM {links} WHERE {test}"


# --- derived inputs ----------------------------------------------------------------------

TASK_LINES = """(SELECT trim(v) AS v FROM (
    SELECT '  ' || url || ' ' AS v FROM pages
    UNION ALL SELECT CASE page_id % 4
        WHEN 0 THEN '{"url":"' || url || '","level":null}'
        WHEN 1 THEN '{"url":"' || url || '","level":1,"max_depth":3}'
        WHEN 2 THEN '"' || url || '"'
        ELSE '{"timeout":7,"url":"' || url || '"}' END FROM pages
    UNION ALL SELECT props FROM events))"""

TASK_KINDS = f"""(SELECT v, CASE WHEN NOT json_valid(v) THEN 'url'
        WHEN json_type(v) = 'VARCHAR' THEN 'json'
        WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.url') THEN 'json'
        ELSE 'reject' END AS kind,
    CASE WHEN NOT json_valid(v) THEN v WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE v->>'$.url' END AS url,
    CASE WHEN json_valid(v) THEN v ELSE '{{"max_depth":1}}' END AS o FROM {TASK_LINES})"""

VARIANTS = """(SELECT unnest([url, url || '/', regexp_replace(url, '^http', 'HTTP'),
    regexp_replace(url, '^(http://[^/]+)', '\\1:80'), regexp_replace(url, '^https?://', ''),
    'mailto:' || page_id || '@x.y']) AS url FROM pages)"""

WRITTEN = """(SELECT url, unnest(['/a' || page_id || '.', 'a' || page_id, 'a' || page_id || '.html',
    'a' || page_id || '.html?x=1', 'd/a.b' || page_id || '.html', 'http://o' || page_id || '.com/z',
    '//cdn.x.com/' || page_id, '#t' || page_id, '?x=' || page_id, 'tel:' || page_id, '/x' || page_id || '.png',
    'http://e' || page_id || '.ai', 'css', 'download/app', '']) AS link FROM pages)"""

RESOLVED = f"(SELECT url, link, {completed('url', 'link')} AS resolved FROM {WRITTEN})"

FRAMED = """(SELECT page_id, html || CASE page_id % 5
    WHEN 0 THEN '<iframe src="/f' || page_id || '"></iframe>'
    WHEN 1 THEN '<iframe src=" "></iframe>'
    WHEN 2 THEN '<FRAME name="x" src=''http://f.example.com/' || page_id || '''>'
    WHEN 3 THEN '<iframe src="about:blank"></iframe>'
    ELSE '<frame src="/*/x">' END AS html FROM pages)"""

FRAMES = """(SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/f' || page_id
    ELSE 'http://f.example.com/' || page_id END AS link FROM pages WHERE page_id % 5 IN (0, 2))"""

MARKED = """(WITH m AS (SELECT page_id, html, ([990, 999, 1000, 1010])[page_id % 4 + 1]::INT AS s,
    CASE page_id % 5 WHEN 0 THEN '404 Not Found' WHEN 1 THEN '网站维护中' WHEN 2 THEN ''
      WHEN 3 THEN 'loading...' ELSE 'BadRequest(InvalidHostname)' END AS mark FROM pages)
    SELECT page_id, mark || html AS html FROM m UNION ALL SELECT -page_id - 1, rpad(mark, s, '.') FROM m)"""

REDIRECTING = """(SELECT a.page_id, a.url, b.url AS goal, a.html AS plain,
    CASE a.page_id % 7
    WHEN 0 THEN '<head><meta http-equiv="refresh" content="0;URL=' || b.url || '"></head>' || a.html
    WHEN 1 THEN '<head><script>window.onload=function(){top.location.href="' || b.url || '"}</script></head>' || a.html
    WHEN 2 THEN '<body>' || chr(13) || chr(10) || '<script>window.navigate("' || b.url || '")</script></body>' || a.html
    WHEN 3 THEN '<script>location="' || b.url || '"</script>' || a.html
    WHEN 4 THEN '<head><meta content="0;url=' || a.url || '"></head>' || a.html
    WHEN 5 THEN '<head><meta content="0;url=http://gone.example.com/x"></head>' || a.html
    ELSE a.html END AS html
    FROM pages a JOIN pages b ON (a.page_id + 1) % (SELECT count(*) FROM pages) = b.page_id)"""

FRONTIER = f"""(SELECT {host('url')} AS task, unnest([url, url || '/', 'http://missing.example.com/' || page_id,
    'mailto:x' || page_id]) AS url FROM pages)"""

FETCHED = f"""(SELECT f.task, f.url, f.p_key AS url_key, CASE WHEN f.p_key IS NULL THEN 'invalid'
    WHEN p.p_key IS NULL THEN 'failed' ELSE 'success' END AS outcome
    FROM {parts(FRONTIER)} f LEFT JOIN (SELECT DISTINCT p_key FROM {parts('pages')}) p USING (p_key))"""

PAGE_RESULTS = f"""(SELECT {domain('(' + host('url') + ')')} AS task, url, md5(cast(page_id * 5 AS VARCHAR)) AS ref,
    page_id FROM pages)"""

# The linked site: its pages g, its links e, and the walk w with the smallest depth per key.
USELESS = " OR ".join("contains(html, '" + p.replace("'", "''") + "')" for p in USELESS_PHRASES)

SITE = f"""n AS (SELECT count(*) AS n FROM pages),
  o AS (SELECT page_id, 'http://g.example.com/p' || page_id AS url, CASE WHEN page_id % 17 = 3 THEN ''
          ELSE CASE WHEN page_id % 13 = 5 THEN '404 Not Found ' ELSE '' END
          || '<a href="/p' || ((page_id * 3 + 1) % n) || '">x</a><a href="/p' || ((page_id * 7 + 2) % (n + n // 5))
          || '">x</a><a href="/p' || (page_id // 2) || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END || '">x</a>'
          || CASE WHEN page_id % 26 = 5 THEN '' ELSE html END END AS html
        FROM pages, n),
  g AS MATERIALIZED (SELECT page_id AS i, url, 'http://g.example.com:80/p' || page_id || '/' AS k, html,
        CASE WHEN html = '' THEN 'blank' WHEN length(html) < 1000 AND ({USELESS}) THEN 'useless' ELSE 'kept' END AS state
        FROM o),
  e AS MATERIALIZED (SELECT DISTINCT g.k, g.state, x.link AS url, x.p_key AS dst
        FROM {parts('(SELECT page_id, link FROM (' + scoped(0, page_links_of('o')) + '))', 'link')} x JOIN g ON g.i = x.page_id)"""


def walk(max_depth: int) -> str:
    return f"""WITH RECURSIVE {SITE},
  r AS (SELECT url AS task, k, 0 AS depth FROM g
        UNION SELECT r.task, e.dst, r.depth + 1 FROM r JOIN e ON e.k = r.k AND e.state = 'kept'
        WHERE r.depth < {max_depth}),
  w AS (SELECT task, k, min(depth) AS depth FROM r GROUP BY ALL),
  v AS (SELECT w.task, w.k AS url_key, w.depth, CASE WHEN g.k IS NULL THEN 'failed' ELSE 'success' END AS outcome,
        g.state FROM w LEFT JOIN g ON g.k = w.k),
  -- distinct URLs tried per round; those beyond the first arrivals are duplicates
  f AS (SELECT task, url, 0 AS depth FROM (SELECT url AS task, url FROM g)
        UNION SELECT w.task, e.url, w.depth + 1 FROM w JOIN e ON e.k = w.k AND e.state = 'kept' WHERE w.depth < {max_depth}),
  t AS (SELECT task, depth, count(*) AS tried FROM f GROUP BY ALL),
  a AS (SELECT t.task, t.depth, t.tried - (SELECT count(*) FROM v WHERE v.task = t.task AND v.depth = t.depth) AS dup FROM t)
"""


# Kept pages of the walk with the URL each was first reached by.
KEPT = """FROM v JOIN g ON g.k = v.url_key
        JOIN (SELECT f.task, f.depth, coalesce(e2.dst, g2.k) AS k, min(f.url) AS url FROM f
              LEFT JOIN (SELECT DISTINCT url, dst FROM e) e2 ON e2.url = f.url
              LEFT JOIN g g2 ON g2.url = f.url GROUP BY ALL) first_url
          ON first_url.task = v.task AND first_url.k = v.url_key AND first_url.depth = v.depth
        WHERE v.outcome = 'success' AND v.state = 'kept'"""

STATS = """count(*) FILTER (outcome IN ('success', 'failed')) AS downloads,
    count(*) FILTER (outcome = 'success') AS success,
    count(*) FILTER (coalesce(state <> 'kept', false)) AS useless,
    count(*) FILTER (coalesce(state <> 'kept', false))"""

EVENT_LATEST = """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts
    FROM events GROUP BY ALL"""

VERSIONED = """(SELECT user_id, min(value) AS low, coalesce(nullif(count(*) % 4, 0), 0) AS stored,
    nullif(count(*) % 4, 0) AS raw, user_id % 4 AS sent FROM events GROUP BY user_id)"""

EVENT_RESULT = """cast(user_id AS VARCHAR) AS task, event_type AS url,
    cast(event_id AS VARCHAR) AS ref_content_id, ts AS update_time"""

ORACLES: dict[str, str] = {
    # sources
    "seed_validate": f"""SELECT url FROM (SELECT unnest([h, '.' || string_split(h, '.')[1], string_split(h, '.')[1]]) AS url
        FROM (SELECT {host('url')} AS h FROM pages)) WHERE regexp_matches(url, '^.+[.].+')""",
    "seeds_list": f"SELECT unnest([url, {host('url')}]) AS url FROM pages",
    "task_parse": f"""SELECT kind, url,
        CASE WHEN json_type(o) = 'OBJECT' AND kind <> 'reject' THEN try_cast(o->>'$.max_depth' AS INT) END AS max_depth,
        CASE WHEN json_type(o) = 'OBJECT' AND kind <> 'reject' THEN try_cast(o->>'$.level' AS INT) END AS level
        FROM {TASK_KINDS}""",
    "task_defaults": f"""SELECT url,
        CASE WHEN json_exists(o, '$.max_depth') THEN try_cast(o->>'$.max_depth' AS INT) ELSE 2 END AS max_depth,
        CASE WHEN json_exists(o, '$.level') THEN try_cast(o->>'$.level' AS INT) ELSE 0 END AS level,
        CASE WHEN json_exists(o, '$.timeout') THEN try_cast(o->>'$.timeout' AS INT) ELSE 300 END AS timeout
        FROM {TASK_KINDS} WHERE kind <> 'reject'""",
    "task_union": f"""SELECT kind, level, count(*) AS n FROM (
        SELECT kind, CASE WHEN json_valid(v) AND kind <> 'reject' AND json_type(v) = 'OBJECT' THEN try_cast(v->>'$.level' AS INT) END AS level
        FROM {TASK_KINDS} UNION ALL SELECT 'url', 2 FROM pages) GROUP BY ALL""",
    "task_route": """SELECT spider, spider IN ('spider', 'click', 'view') AS known, count(*) AS n
        FROM (SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'spider' END AS spider FROM events) GROUP BY ALL""",
    "fetch_outcomes": f"SELECT task, url, url_key, outcome FROM {FETCHED}",
    "fetch_bodies": f"""SELECT f.task, f.url, CASE WHEN f.p_key IS NULL THEN 'invalid' WHEN p.p_key IS NULL THEN 'failed'
            ELSE 'success' END AS outcome, md5(p.html) AS text_md5,
            CASE WHEN page_id % 2 = 1 AND html <> '' THEN 2 + 2 * length(html) ELSE octet_length(encode(html)) END AS n_bytes
        FROM {parts(FRONTIER)} f LEFT JOIN (SELECT p_key, arg_min(page_id, url) AS page_id, arg_min(html, url) AS html
            FROM {parts('pages')} GROUP BY p_key) p USING (p_key)""",
    "fetch_log_parse": f"""SELECT CASE WHEN outcome = 'success' THEN 'Success' ELSE 'Failed' END AS outcome,
        count(*) AS n, count(DISTINCT url) AS urls FROM {FETCHED} GROUP BY 1""",
    # URL reports
    "url_parts": f"""SELECT p_protocol AS protocol, p_host AS host, p_port AS port, count(*) AS n
        FROM {parts(VARIANTS)} GROUP BY ALL""",
    "url_key": f"""SELECT p_key AS url_key, min(url) AS url, count(*) AS n FROM {parts(VARIANTS)}
        WHERE p_key IS NOT NULL GROUP BY 1""",
    "url_root": f"""SELECT p_root AS url_key, min(url) AS url, count(*) AS n FROM {parts(VARIANTS)}
        WHERE p_root IS NOT NULL GROUP BY 1""",
    "pages_by_host": f"""SELECT {host('url')} AS host, count(*) AS pages, cast(sum(length(html)) AS BIGINT) AS chars
        FROM pages GROUP BY 1""",
    "pages_by_site_domain": f"""SELECT {domain('h')} AS domain, count(*) AS pages, count(DISTINCT h) AS hosts
        FROM (SELECT {host('url')} AS h FROM pages) GROUP BY 1""",
    "ip_links": f"""SELECT ip, count(*) AS n FROM (SELECT {host('link')} AS ip FROM
        (SELECT unnest(regexp_extract_all(text, '{ADDRESS}')) AS link FROM
          (SELECT text FROM documents UNION ALL SELECT html FROM pages)))
        WHERE regexp_matches(ip, '^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)[.]){{3}}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$')
        GROUP BY 1""",
    "url_filter": r"""SELECT url FROM (SELECT unnest([url, 'http://', 'ftp://' || url, replace(url, '://', ':\\')]) AS url
        FROM pages) WHERE regexp_matches(url, '^https?:(//|\\\\)') AND url NOT IN ('http://', 'https://')""",
    # links
    "links_anchor": f"SELECT page_id, link FROM {ANCHORS}",
    "links_frame": f"SELECT page_id, link FROM {FRAMES}",
    "text_urls": f"""SELECT DISTINCT 'p' || page_id AS k, page_id AS id, url FROM
        (SELECT page_id, unnest(regexp_extract_all(html, '{ADDRESS}')) AS url FROM pages)
        UNION ALL SELECT DISTINCT 'd' || doc_id, doc_id, url FROM
        (SELECT doc_id, unnest(regexp_extract_all(text, '{ADDRESS}')) AS url FROM documents)""",
    "links_resolved": f"SELECT url AS base, link, resolved FROM {RESOLVED}",
    "links_extension_filter": f"SELECT link FROM {WRITTEN} WHERE {is_page_link('link')}",
    "links_distinct": f"SELECT link, count(*) AS n FROM {ANCHORS} GROUP BY 1",
    "links_union": f"""SELECT page_id, link FROM {ANCHORS} UNION SELECT page_id, link FROM {FRAMES}
        UNION SELECT page_id, unnest(regexp_extract_all(html, '{ADDRESS}')) FROM {FRAMED}""",
    "links_in_scope": f"""SELECT url, resolved AS link, 0 AS level FROM {RESOLVED} WHERE {host('resolved')} = {host('url')}
        UNION ALL SELECT url, resolved, 1 FROM {RESOLVED}
        WHERE {domain('(' + host('resolved') + ')')} = {domain('(' + host('url') + ')')}""",
    **{f"links_scope_{level}": scoped(level) for level in (0, 1, 2)},
    "page_links": f"""SELECT {host('p.url')} AS host, cast(sum(coalesce(k, 0)) AS BIGINT) AS links, count(*) AS pages
        FROM pages p LEFT JOIN (SELECT page_id, count(*) AS k FROM ({scoped(0)}) GROUP BY 1) l USING (page_id) GROUP BY 1""",
    # page quality
    "useless_pages": f"SELECT page_id FROM {MARKED} WHERE NOT (length(html) < 1000 AND ({USELESS}))",
    "blank_pages": "SELECT page_id FROM pages WHERE page_id % 3 = 2 AND length(html) > 0",
    "decode_pages": "SELECT doc_id, text FROM documents",
    "content_fingerprint": "SELECT md5(text) AS md5, min(doc_id) AS kept, count(*) AS n FROM documents GROUP BY 1",
    "content_hook": "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS page_text FROM pages",
    "pattern_hits": """SELECT doc_id, item_id,
        cast((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS BIGINT) AS hits
        FROM documents d JOIN benchmark b ON contains(d.text, b.text)""",
    # redirects
    "redirect_targets": f"""SELECT page_id, (['meta', 'onload', 'body_script', 'script', '', 'meta'])[page_id % 7 + 1] AS kind,
        CASE WHEN page_id % 7 = 5 THEN 'http://gone.example.com/x' ELSE goal END AS target
        FROM {REDIRECTING} WHERE page_id % 7 NOT IN (4, 6)""",
    "redirect_follow": f"""SELECT a.page_id, CASE WHEN a.page_id % 7 < 4
          THEN (['meta', 'onload', 'body_script', 'script'])[a.page_id % 7 + 1] END AS redirect_kind,
        md5(CASE WHEN a.page_id % 7 < 4 THEN b.html ELSE a.html END) AS body_md5
        FROM {REDIRECTING} a JOIN {REDIRECTING} b ON a.goal = b.url""",
    # crawl
    "deny_lists": f"""SELECT page_id FROM pages WHERE NOT regexp_matches({host('url')}, 'example[.]org$')
        AND {host('url')} NOT IN (SELECT {host('url')} FROM pages WHERE {host('url')} LIKE 'm.%')
        AND NOT contains(url, '/de/')""",
    "frontier_new": f"""WITH {SITE} SELECT 't' AS task, dst AS url_key, min(url) AS url FROM e
        WHERE e.k NOT IN (SELECT k FROM g WHERE state = 'blank')
        AND dst NOT IN (SELECT k FROM g WHERE state = 'blank') GROUP BY dst""",
    "crawl_depth0": walk(0) + "SELECT task, url_key, depth, outcome FROM v",
    "crawl_depth2": walk(2) + "SELECT task, url_key, depth, outcome FROM v",
    "crawl_outcomes": walk(2) + """SELECT depth, outcome, count(*) AS n FROM v GROUP BY ALL
        UNION ALL SELECT depth, 'duplicate', cast(sum(dup) AS BIGINT) FROM a GROUP BY depth HAVING sum(dup) > 0""",
    "crawl_results": walk(1) + """SELECT v.task, first_url.url, md5(g.html) AS body_md5
        """ + KEPT,
    "crawl_tasks": walk(1) + """SELECT s.store, url, CASE s.store WHEN 'urls' THEN 0 WHEN 'news' THEN length(replace(html, '</a>', '')) ELSE length(html) END AS chars
        FROM (SELECT seed.i % 3 AS turn, first_url.url, g.html """ + KEPT.replace("JOIN (", "JOIN g seed ON seed.url = v.task JOIN (", 1) + """) k
        JOIN (VALUES ('saved', 0), ('news', 1), ('urls', 1)) s(store, turn) ON s.turn = k.turn""",
    "crawl_stats": walk(2) + f"""SELECT v.task, {STATS.replace('state', 'v.state')} + any_value(d.dup) AS useless_with_duplicates
        FROM v JOIN (SELECT task, cast(sum(dup) AS BIGINT) AS dup FROM a GROUP BY 1) d ON d.task = v.task GROUP BY v.task""",
    "crawl_stats_total": walk(2) + f"""SELECT {STATS} + (SELECT cast(sum(dup) AS BIGINT) FROM a) AS useless_with_duplicates,
        count(*) / 10.0::DOUBLE AS speed FROM v""",
    "crawl_pages": f"""WITH l AS (SELECT p.url AS task, x.link AS url, x.p_key AS k, q.p_key AS own
          FROM {parts('(SELECT page_id, link FROM (' + scoped(0) + '))', 'link')} x
          JOIN pages p USING (page_id) JOIN {parts('pages')} q USING (page_id)),
        known AS (SELECT DISTINCT p_key FROM {parts('pages')}),
        r AS (SELECT *, row_number() OVER (PARTITION BY task, k ORDER BY url) AS n FROM l)
        SELECT url AS task, 0 AS depth, 'success' AS outcome, 1 AS n FROM pages
        UNION ALL SELECT task, 1, CASE WHEN k IS NULL THEN 'invalid' WHEN n > 1 OR k = own THEN 'duplicate'
            WHEN k IN (SELECT p_key FROM known) THEN 'success' ELSE 'failed' END AS outcome, count(*)
        FROM r GROUP BY ALL""",
    # store
    "insert_append": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "content_put": """SELECT md5(cast(doc_id AS VARCHAR)) AS content_id, cast(doc_id AS VARCHAR) AS filename,
        octet_length(encode(text)) AS length FROM documents""",
    "content_by_name": """SELECT source AS filename, md5(cast(max(doc_id) AS VARCHAR)) AS content_id,
        arg_max(octet_length(encode(text)), doc_id) AS length FROM documents
        WHERE source IN (SELECT source FROM documents WHERE lang = 'en') GROUP BY source""",
    "upsert_latest": """SELECT cast(user_id AS VARCHAR) AS task, event_type AS url, max(ts) AS update_time,
        arg_max(props, ts) AS page_text, md5(event_type) AS filename FROM events GROUP BY user_id, event_type""",
    "latest_per_url": EVENT_LATEST,
    "update_set": "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS value FROM events",
    "update_upsert": "SELECT event_id, event_type FROM events UNION ALL SELECT -1, 'refund'",
    "update_optimistic": f"""SELECT user_id, CASE WHEN sent >= stored THEN 'applied' ELSE 'rejected' END AS status,
        CASE WHEN sent >= stored THEN stored + 1 ELSE stored END AS version FROM {VERSIONED}
        UNION ALL SELECT DISTINCT -user_id - 1, 'missing', NULL FROM events""",
    "update_optimistic_table": f"""SELECT user_id, CASE WHEN sent >= stored THEN -1.0::DOUBLE ELSE low END AS low,
        CASE WHEN sent >= stored THEN stored + 1 ELSE raw END AS version FROM {VERSIONED}""",
    "update_partitioned": """SELECT event_type, count(*) AS rows,
        count(*) FILTER (value > 50 AND event_type IN ('error', 'click')) AS changed FROM events GROUP BY 1""",
    "delete_where": "SELECT event_id, value FROM events WHERE NOT value < 10",
    "delete_contents": f"""SELECT cast(doc_id AS VARCHAR) AS filename, octet_length(encode(text)) AS length FROM documents
        WHERE md5(cast(doc_id AS VARCHAR)) NOT IN (SELECT ref FROM {PAGE_RESULTS} WHERE task = 'example.com')""",
    "delete_contents_dangling": f"""SELECT task, url FROM {PAGE_RESULTS}
        WHERE task = 'example.com' OR page_id * 5 >= (SELECT count(*) FROM documents)""",
    "delete_contents_cascade": f"SELECT task, url FROM {PAGE_RESULTS} WHERE task <> 'example.com'",
    "purge_overdue": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY",
    "purge_log": """SELECT event_id FROM events
        WHERE floor((epoch(TIMESTAMP '2024-02-10 12:00:00') - floor(epoch(ts))) / 86400) <= 30""",
    # search
    "find_project": "SELECT event_id, value FROM events WHERE event_type = 'error'",
    "find_one": "SELECT event_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1",
    "find_by_task": f"SELECT {EVENT_RESULT} FROM events WHERE user_id = 8",
    "find_by_url": f"SELECT {EVENT_RESULT} FROM events WHERE user_id = 8 AND event_type = 'error' ORDER BY ts DESC LIMIT 1",
    "count_where": "SELECT count(*) AS n FROM events WHERE event_type = 'error'",
    "page_rows": """SELECT event_id, value, count(*) OVER () AS total FROM events
        ORDER BY value DESC, event_id DESC LIMIT 50 OFFSET 10""",
    "page_rows_rest": """SELECT event_id, value, count(*) OVER () AS total FROM events
        ORDER BY value DESC, event_id DESC OFFSET 100""",
    "aggregate_paged": """SELECT user_id, count(*) AS n, max(value) AS top, count(*) OVER () AS total
        FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20 OFFSET 5""",
    # export
    "export_pages": f"""SELECT r.task, r.url, {host('r.url')} AS host, translate(r.url, '/:*?', '{{}}[^') AS file_name,
        octet_length(encode(d.text)) AS length, md5(d.text) AS body_md5
        FROM {PAGE_RESULTS} r JOIN documents d ON r.ref = md5(cast(d.doc_id AS VARCHAR))""",
    "export_first": f"""SELECT r.task, r.url FROM {PAGE_RESULTS} r JOIN documents d ON r.ref = md5(cast(d.doc_id AS VARCHAR))
        WHERE task = 'example.net' ORDER BY page_id DESC LIMIT 1""",
    "page_file_names": """SELECT u AS url, t AS escaped, to_base64(encode(u)) AS b64,
        CASE WHEN length(t) > 255 THEN md5(t) ELSE t END AS final_name
        FROM (SELECT u, translate(u, '/:*?', '{}[^') AS t FROM
          (SELECT url || repeat('x', cast(page_id % 300 AS INT)) AS u FROM pages))""",
    "saved_pages": f"""SELECT {host('url')} AS host, count(*) AS pages, cast(sum(length(html)) AS BIGINT) AS chars
        FROM pages WHERE length(html) > 0 GROUP BY 1""",
    "result_batches": f"SELECT {host('url')} AS task, url, md5(html) AS body_md5 FROM pages",
    # streams
    "stream_tasks": f"SELECT kind, count(*) AS n, count(DISTINCT url) AS urls FROM {TASK_KINDS} GROUP BY kind",
    "stream_dedup": """WITH RECURSIVE a AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
        UNION ALL SELECT a.user_id, a.event_type, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id
          AND e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 1 DAY GROUP BY a.user_id, a.event_type)
        SELECT user_id, event_type, ts FROM a""",
    "stream_upsert_pages": """SELECT 't' AS task, 'http://k.example.com/' || k AS url, md5('http://k.example.com/' || k) AS filename,
        octet_length(encode(html)) AS length, md5(html) AS body_md5
        FROM (SELECT page_id // 3 AS k, arg_max(html, page_id) AS html FROM pages GROUP BY 1)""",
    "stream_crawl_stats": """SELECT cast(user_id AS VARCHAR) AS task, count(*) FILTER (event_type <> 'click') AS downloads,
        count(*) FILTER (event_type NOT IN ('click', 'error')) AS success, count(*) FILTER (event_type = 'view') AS useless
        FROM events GROUP BY 1""",
    "raw_pages": """SELECT page_id || '.html' AS name, octet_length(encode(html)) AS length, md5(html) AS md5 FROM pages""",
    "stream_dedup_window": "SELECT DISTINCT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start FROM events",
    "stream_upsert": EVENT_LATEST,
    "stream_stats": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_links": scoped(0),
    "stream_sinks": """SELECT url, CASE WHEN length(t) > 255 THEN md5(t) ELSE t END AS final_name, NULL::BIGINT AS page_id
        FROM (SELECT url, translate(url, '/:*?', '{}[^') AS t FROM pages) UNION ALL SELECT NULL, NULL, page_id FROM pages""",
}
ORACLES["text_urls"] = f"SELECT id, url FROM ({ORACLES['text_urls']})"
ORACLES["crawl_bytes"] = ORACLES["crawl_results"]
