"""DuckDB oracle SQL for ``crawl_queries.py``: the derived robots / sitemap / attempt / edge
tables rebuilt in SQL, robots parsing as a list fold, sitemap order from the tables the XML was
made from, fetch outcomes by aggregation, and the uncapped crawl as a recursive CTE."""

from __future__ import annotations

from sitefold.operators import crawl as C
from sitefold.operators import fetchlog as FL
from sitefold.operators.robots import LINE_SPLIT_RE
from sitefold.plans import sqlparts as S
from sitefold.sources import derived as D

NL = "chr(10)"


def ranked(with_html: bool = False) -> str:
    cols = "page_id, url, html" if with_html else "page_id, url"
    s = S.url_parts(f"SELECT {cols} FROM pages", "url", "u")
    s = f"SELECT {cols}, {S.site_of('u')} AS site, {S.normalized('u')} AS norm_url FROM ({s})"
    s = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, norm_url ORDER BY page_id) AS k FROM ({s})) WHERE k = 1"
    return f"SELECT {cols}, site, norm_url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM ({s})"


def robots() -> str:
    tok = D.AGENT_TOKEN
    sm = "'https://' || site || '/sitemap_index.xml'"
    t1 = f"'User-agent: *' || {NL} || 'Disallow: /de/' || {NL}"
    t2 = (f"'# rules for {tok}' || {NL} || 'User-agent: {tok}' || {NL} || 'Disallow: /fr/' || {NL} || 'Crawl-delay: 2' || {NL} || {NL} "
          f"|| 'User-agent: *' || {NL} || 'Disallow: /' || {NL} || {NL} || 'Sitemap: ' || {sm} || {NL}")
    t3 = (f"'User-agent: *' || {NL} || 'Allow: /en/' || {NL} || 'Disallow: /en' || {NL} || 'Disallow: /es/' || {NL} || 'Disallow:' "
          f"|| {NL} || {NL} || 'sitemap: ' || {sm} || {NL} || 'Sitemap: https://' || site || '/missing.xml' || {NL}")
    return (f"SELECT site, CAST(CASE WHEN length(site) % 4 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status, "
            f"CASE WHEN length(site) % 4 = 1 THEN {t1} WHEN length(site) % 4 = 2 THEN {t2} WHEN length(site) % 4 = 3 THEN {t3} END AS text "
            f"FROM (SELECT DISTINCT site FROM ({ranked()}))")


def _lines(src: str) -> str:
    return (f"SELECT site, CASE WHEN status = 200 AND text IS NOT NULL THEN string_split_regex(text, {S.lit(LINE_SPLIT_RE)}) "
            f"ELSE []::VARCHAR[] END AS lines FROM ({src})")


def robots_sitemaps() -> str:
    s = f"SELECT site, i - 1 AS ln, lines[i] AS line FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM ({_lines(robots())}))"
    s = f"SELECT site, ln, {S.strip('line')} AS s FROM ({s})"
    s = f"SELECT site, ln, {S.strip('substring(s, 9)')} AS sitemap_url FROM ({s}) WHERE starts_with(lower(s), 'sitemap:')"
    return (f"SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY ln) - 1 AS INTEGER) AS pos, sitemap_url "
            f"FROM ({s}) WHERE sitemap_url != ''")


def _unquote(x: str) -> str:
    return f"(CASE WHEN strpos({x}, '%') > 0 THEN url_decode(replace({x}, '+', '%2B')) ELSE {x} END)"


def robots_rules() -> str:
    rule_t = "STRUCT(allow BOOLEAN, path VARCHAR)"
    grp_t = f"STRUCT(agents VARCHAR[], rules {rule_t}[])"
    cut = f"{S.strip('split_part(raw, ' + S.lit('#') + ', 1)')}"
    key = f"lower({S.strip(f'CASE WHEN strpos(c_, {S.lit(chr(58))}) > 0 THEN substring(c_, 1, strpos(c_, {S.lit(chr(58))}) - 1) ELSE c_ END')})"
    val = f"CASE WHEN strpos(c_, ':') > 0 THEN {_unquote(S.strip('substring(c_, strpos(c_, ' + S.lit(':') + ') + 1)'))} END"
    parsed = (f"list_transform(list_transform(lines, lambda raw: {{'blank': raw = '', 'c': {cut}}}), "
              f"lambda y: {{'blank': y.blank, 'key': {key.replace('c_', 'y.c')}, 'val': {val.replace('c_', 'y.c')}}})")
    empty_a, empty_r, empty_g = "[]::VARCHAR[]", f"[]::{rule_t}[]", f"[]::{grp_t}[]"
    add = "list_append(a.groups, {'agents': a.agents, 'rules': a.rules})"
    step = (f"CASE WHEN x.blank THEN (CASE WHEN a.state = 1 THEN {{'state': 0, 'agents': {empty_a}, 'rules': {empty_r}, 'groups': a.groups}} "
            f"WHEN a.state = 2 THEN {{'state': 0, 'agents': {empty_a}, 'rules': {empty_r}, 'groups': {add}}} ELSE a END) "
            f"WHEN x.val IS NULL THEN a "
            f"WHEN x.key = 'user-agent' THEN (CASE WHEN a.state = 2 THEN {{'state': 1, 'agents': [x.val], 'rules': {empty_r}, 'groups': {add}}} "
            f"ELSE {{'state': 1, 'agents': list_append(a.agents, x.val), 'rules': a.rules, 'groups': a.groups}} END) "
            f"WHEN x.key IN ('disallow', 'allow', 'crawl-delay', 'request-rate') THEN (CASE WHEN a.state != 0 THEN "
            f"{{'state': 2, 'agents': a.agents, 'rules': CASE WHEN x.key IN ('disallow', 'allow') "
            f"THEN list_append(a.rules, {{'allow': x.key = 'allow', 'path': x.val}}) ELSE a.rules END, 'groups': a.groups}} ELSE a END) "
            f"ELSE a END")
    init = f"{{'state': 0, 'agents': {empty_a}, 'rules': {empty_r}, 'groups': {empty_g}}}"
    folded = f"list_reduce({parsed}, lambda a, x: {step}, {init})"
    s = f"SELECT site, {folded} AS st FROM ({_lines(robots())})"
    s = f"SELECT site, CASE WHEN st.state = 2 THEN list_append(st.groups, {{'agents': st.agents, 'rules': st.rules}}) ELSE st.groups END AS groups FROM ({s})"
    g = f"SELECT site, CAST(i - 1 AS INTEGER) AS group_no, groups[i] AS g FROM (SELECT *, unnest(generate_series(1, len(groups))) AS i FROM ({s}))"
    g = f"SELECT *, list_contains(g.agents, '*') AS is_default FROM ({g})"
    g = (f"SELECT * FROM (SELECT *, min(CASE WHEN is_default THEN group_no END) OVER (PARTITION BY site) AS fd FROM ({g})) "
         f"WHERE NOT is_default OR group_no = fd")
    r = (f"SELECT site, group_no, is_default, g.agents AS agents, "
         f"CASE WHEN len(g.rules) > 0 THEN CAST(j - 1 AS INTEGER) END AS rule_no, g.rules[j].allow AS allow, g.rules[j].path AS raw_path "
         f"FROM (SELECT *, unnest(generate_series(1, greatest(len(g.rules), 1))) AS j FROM ({g}))")
    r = S.url_parts(r, "raw_path", "p")
    path = S.unsplit("p_scheme", "p_netloc", "p_path", "p_params", "p_query", "p_fragment")
    return (f"SELECT site, group_no, is_default, agents, rule_no, CASE WHEN raw_path = '' THEN true ELSE allow END AS allow, "
            f"CASE WHEN raw_path IS NULL THEN NULL ELSE {path} END AS path FROM ({r})")


def _chosen(rules: str, agent: str) -> str:
    name = agent.split("/")[0].lower()
    key = (f"CASE WHEN NOT is_default AND len(list_filter(agents, lambda t: strpos({S.lit(name)}, lower(t)) > 0)) > 0 THEN group_no "
           f"WHEN is_default THEN group_no + 1073741824 END")
    return (f"SELECT site, CASE WHEN k >= 1073741824 THEN k - 1073741824 ELSE k END AS group_no FROM "
            f"(SELECT site, min({key}) AS k FROM (SELECT DISTINCT site, group_no, is_default, agents FROM ({rules})) GROUP BY site) "
            f"WHERE k IS NOT NULL")


def decisions(urls: str, url: str = "url") -> str:
    """SELECT *, allowed FROM (urls) -- urls carry ``site`` and the url column."""
    rules = robots_rules()
    s = f"SELECT *, {_unquote(url)} AS _dec FROM ({urls})"
    s = S.url_parts(s, "_dec", "q")
    key = S.unsplit("''", "''", "q_path", "q_params", "q_query", "q_fragment")
    s = f"SELECT * EXCLUDE (_dec, q_scheme, q_netloc, q_path, q_params, q_query, q_fragment), regexp_replace({key}, '^$', '/') AS _pq FROM ({s})"
    return f"""
    WITH u AS ({s}), rules AS ({rules}), chosen AS ({_chosen('SELECT * FROM rules', D.DEFAULT_AGENT)}),
    active AS (SELECT r.site, r.rule_no, r.allow, r.path FROM rules r JOIN chosen c USING (site, group_no) WHERE r.rule_no IS NOT NULL),
    hits AS (SELECT DISTINCT u.site, u._pq FROM u),
    first AS (SELECT h.site, h._pq, arg_min(a.allow, a.rule_no) AS f FROM hits h JOIN active a ON a.site = h.site
              AND starts_with(h._pq, a.path) GROUP BY h.site, h._pq)
    SELECT u.* EXCLUDE (_pq), coalesce(first.f, true) AS allowed FROM u LEFT JOIN first USING (site, _pq)
    """


def robots_decisions() -> str:
    return f"SELECT page_id, site, url, allowed FROM ({decisions(f'SELECT site, page_id, url FROM ({ranked()})')})"


def _chunk() -> str:
    return f"(floor((n - 1) / {D.SITEMAP_CHUNK}) * 2 + n % 2)"


def sitemap_urls(limit: str = "9223372036854775807") -> str:
    """Urls of every site whose robots names the sitemap index, in the order the index and its
    children list them (the tables the XML was made from)."""
    return (f"SELECT site, CAST(seq AS INTEGER) AS seq, url FROM (SELECT site, url, "
            f"row_number() OVER (PARTITION BY site ORDER BY {_chunk()}, n) - 1 AS seq FROM ({ranked()}) WHERE length(site) % 4 >= 2) "
            f"WHERE seq < {limit}")


def _jobs(max_pages: str) -> str:
    s = f"SELECT site, url AS root_url, {max_pages} AS max_pages FROM ({ranked()}) WHERE n = 1"
    s = S.url_parts(s, "root_url", "r")
    return f"SELECT site, root_url, max_pages, {S.normalized('r')} AS norm_root FROM ({s})"


def site_seeds(max_pages: int = 50) -> str:
    sm = sitemap_urls(str(max_pages))
    sm = S.url_parts(sm, "url", "s")
    sm = f"SELECT site, seq, url, {S.normalized('s')} AS norm FROM ({sm})"
    return f"""
    WITH j AS ({_jobs(str(max_pages))}), sm AS ({sm}),
    seeded AS (SELECT DISTINCT site FROM j WHERE length(site) % 4 >= 2),
    found AS (SELECT DISTINCT sm.site FROM sm JOIN j ON sm.site = j.site AND sm.norm = j.norm_root),
    both_ AS (SELECT sm.site, sm.seq, sm.url FROM sm
              UNION ALL SELECT j.site, -1, j.root_url FROM j WHERE site IN (SELECT site FROM seeded) AND site NOT IN (SELECT site FROM found)),
    ranked_ AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) - 1 AS pos FROM both_)
    SELECT r.site, j.root_url, CAST(r.pos AS INTEGER) AS pos, r.url, 0 AS depth, true AS sitemap_seeded
    FROM ranked_ r JOIN j USING (site) WHERE r.pos < j.max_pages
    UNION ALL
    SELECT site, root_url, 0 AS pos, norm_root AS url, 0 AS depth, false AS sitemap_seeded FROM j WHERE site NOT IN (SELECT site FROM seeded)
    """


def attempts() -> str:
    code = "((page_id * 7 + attempt) % 11)"
    status = (f"CAST(CASE WHEN {code} <= 6 THEN 200 WHEN {code} = 7 THEN 404 WHEN {code} = 8 THEN 429 WHEN {code} = 9 THEN 503 "
              f"WHEN {code} = 10 AND page_id % 2 = 0 THEN 304 END AS INTEGER)")
    ctype = (f"CASE WHEN {code} = 0 AND page_id % 13 = 0 THEN NULL WHEN {code} <= 5 THEN 'text/html; charset=utf-8' "
             f"WHEN {code} = 6 THEN 'application/pdf' END")
    ra = f"CASE WHEN {code} = 8 THEN CASE WHEN page_id % 3 = 0 THEN '2' WHEN page_id % 3 = 2 THEN {S.lit(D.RETRY_AFTER_DATE)} END END"
    kind = f"CASE WHEN {code} = 10 THEN CASE WHEN page_id % 2 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'timeout' ELSE 'other' END END"
    return (f"SELECT norm_url, CAST(attempt AS INTEGER) AS attempt, {status} AS status, {ctype} AS content_type, {ra} AS retry_after, "
            f"{kind} AS error_kind, CASE WHEN {kind} = 'timeout' THEN 'read timed out' WHEN {kind} = 'other' THEN 'connection reset by peer' END "
            f"AS error_text, CASE WHEN {code} <= 5 THEN html END AS body "
            f"FROM ({ranked(True)}), (SELECT unnest([0, 1, 2]) AS attempt)")


def outcomes() -> str:
    last = FL.MAX_RETRIES
    ra = f"(CASE WHEN retry_after IS NULL THEN {FL.RETRY_AFTER_DEFAULT} ELSE TRY_CAST(trim(retry_after) AS DOUBLE) END)"
    ra_text = f"coalesce(retry_after, {S.lit(str(FL.RETRY_AFTER_DEFAULT))})"
    ctype = "coalesce(content_type, '')"
    kind = (f"CASE WHEN error_kind IN ('timeout', 'connect') THEN 'retry' WHEN error_kind IS NOT NULL THEN 'final' "
            f"WHEN status = 200 THEN CASE WHEN strpos({ctype}, 'text/html') > 0 THEN 'ok' ELSE 'final' END "
            f"WHEN status = 429 THEN CASE WHEN {ra} IS NULL THEN 'final' ELSE 'retry' END "
            f"WHEN status >= 400 AND status < 500 THEN 'final' ELSE 'retry' END")
    error = (f"CASE WHEN error_kind IN ('timeout', 'connect') THEN 'timeout after ' || CAST(attempt + 1 AS VARCHAR) || ' attempt(s)' "
             f"WHEN error_kind IS NOT NULL THEN coalesce(error_text, '') "
             f"WHEN status = 200 THEN CASE WHEN strpos({ctype}, 'text/html') > 0 THEN NULL "
             f"ELSE 'non-HTML content-type: ' || split_part({ctype}, ';', 1) END "
             f"WHEN status = 429 THEN CASE WHEN {ra} IS NULL THEN 'could not convert string to float: ''' || {ra_text} || '''' "
             f"ELSE {S.lit(FL.RATE_LIMITED)} END ELSE 'HTTP ' || CAST(status AS VARCHAR) END")
    c = f"SELECT norm_url, attempt, {kind} AS kind, {error} AS error, body FROM ({attempts()}) WHERE attempt <= {last}"
    return f"""
    WITH c AS ({c}),
    t AS (SELECT norm_url, min(attempt) FILTER (WHERE kind IN ('ok', 'final')) AS t, max(attempt) AS last_,
                 arg_min({{'k': kind, 'e': error}}, attempt) FILTER (WHERE kind IN ('ok', 'final')) AS term,
                 arg_max({{'e': error}}, attempt) FILTER (WHERE kind = 'retry') AS last_retry_s,
                 arg_min(body, attempt) FILTER (WHERE kind = 'ok') AS first_ok_body FROM c GROUP BY norm_url)
    SELECT t.norm_url, coalesce(term.k = 'ok', false) AS ok, CASE WHEN coalesce(term.k = 'ok', false) THEN first_ok_body END AS html,
           CASE WHEN t.t IS NOT NULL THEN term.e ELSE coalesce(last_retry_s.e, 'unknown error') END AS error,
           CAST(CASE WHEN t.t IS NOT NULL THEN t.t + 1 ELSE last_ + 1 END AS INTEGER) AS attempts_used
    FROM t
    """


def fetch_outcomes() -> str:
    return (f"SELECT norm_url, ok, error, attempts_used, CAST(length(html) AS BIGINT) AS html_chars "
            f"FROM ({outcomes()})")


def edges() -> str:
    r = f"SELECT site, n, url, norm_url FROM ({ranked()})"
    inner = (f"SELECT s.site, s.norm_url AS src_norm, e.pos, d.url AS dst_url FROM ({r}) s, "
             f"(SELECT unnest([0, 1, 2]) AS pos) e JOIN ({r}) d ON d.site = s.site "
             f"AND d.n = CASE e.pos WHEN 0 THEN s.n * 2 WHEN 1 THEN s.n * 2 + 1 ELSE s.n - 1 END")
    extra = (f"SELECT site, norm_url AS src_norm, 3 AS pos, 'https://{D.OFFSITE_HOST}/p' || CAST(n AS VARCHAR) AS dst_url FROM ({r}) WHERE n % 5 = 0 "
             f"UNION ALL SELECT site, norm_url, 4, 'https://' || site || '/files/' || CAST(n AS VARCHAR) || '.pdf' FROM ({r}) WHERE n % 6 = 0")
    return f"SELECT * FROM ({inner}) UNION ALL SELECT * FROM ({extra})"


def extracted_links() -> str:
    """(site, src_norm, dst_url): E6 over the ranked pages and over their menus."""
    anchor = "'<a href=\"' || replace(dst_url, '&', '&amp;') || '\">' || pos || '</a>'"
    menus = f"SELECT site, src_norm AS norm_url, '<nav>' || string_agg({anchor}, '' ORDER BY pos) || '</nav>' AS html FROM ({edges()}) GROUP BY ALL"
    menu = f"(SELECT page_id, url, m.html FROM ({ranked()}) JOIN ({menus}) m USING (site, norm_url))"
    return (f"SELECT site, src_norm, url AS dst_url FROM ({S.page_links()} UNION ALL {S.page_links(menu)}) "
            f"WHERE src_ord IN (SELECT page_id FROM ({ranked()}))")


def crawl_reach(max_depth: int = 3, links: str | None = None) -> str:
    """Uncapped crawl: BFS reach by min depth through pages that were fetched (robots allowed,
    fetch ok), seeds from ``site_seeds``, no expansion for sitemap-seeded sites."""
    seeds, links = site_seeds(1 << 30), links or edges()
    cand = f"SELECT DISTINCT site, url FROM (SELECT site, url FROM ({seeds}) UNION ALL SELECT site, dst_url FROM ({links}))"
    cand = S.url_parts(cand, "url", "c")
    cand = (f"SELECT site, url, {S.normalized('c')} AS norm_url, lower(c_netloc) = site AS same_site, {S.crawlable('c')} AS crawlable "
            f"FROM ({cand})")
    ann = decisions(cand)
    return f"""
    WITH RECURSIVE sd AS ({seeds}), e AS ({links}), o AS ({outcomes()}),
    a AS (SELECT ann.*, coalesce(o.ok, false) AS fetched, o.error FROM ({ann}) ann LEFT JOIN o USING (norm_url)),
    mode AS (SELECT site, bool_or(sitemap_seeded) AS seeded FROM sd GROUP BY site),
    reach(site, url, depth) AS (
      SELECT site, url, 0 FROM sd
      UNION
      SELECT e.site, e.dst_url, r.depth + 1 FROM reach r
        JOIN a ON a.site = r.site AND a.url = r.url
        JOIN mode m ON m.site = r.site
        JOIN e ON e.site = r.site AND e.src_norm = a.norm_url
      WHERE a.same_site AND a.crawlable AND a.allowed AND a.fetched AND NOT m.seeded AND r.depth < {max_depth}),
    firsts AS (SELECT r.site, a.norm_url, min(r.depth) AS depth FROM reach r JOIN a ON a.site = r.site AND a.url = r.url GROUP BY r.site, a.norm_url)
    SELECT DISTINCT f.site, f.norm_url, CAST(f.depth AS INTEGER) AS depth,
           CASE WHEN NOT a.allowed THEN 'skipped' WHEN a.fetched THEN 'ok' ELSE 'skipped' END AS outcome,
           CASE WHEN NOT a.allowed THEN {S.lit(C.ROBOTS_REASON)} WHEN a.fetched THEN NULL ELSE coalesce(a.error, {S.lit(C.MISSING_REASON)}) END AS reason
    FROM firsts f JOIN reach r ON r.site = f.site AND r.depth = f.depth
         JOIN a ON a.site = r.site AND a.url = r.url AND a.norm_url = f.norm_url
    WHERE a.same_site AND a.crawlable
    """


def crawl_links() -> str:
    return crawl_reach(links=extracted_links())


ORACLE = {
    "robots_sitemaps": robots_sitemaps,
    "robots_rules": robots_rules,
    "robots_decisions": robots_decisions,
    "sitemap_urls": sitemap_urls,
    "site_seeds": site_seeds,
    "fetch_outcomes": fetch_outcomes,
    "crawl_reach": crawl_reach,
    "crawl_links": crawl_links,
}


# ------------------------------------------------------------------ capped crawl (one state row per site and level)

_ITEM = "{{'url': {p}.url, 'norm': {p}.norm, 'same': {p}.same, 'crawlable': {p}.crawlable, 'allowed': {p}.allowed, " \
        "'fetched': {p}.fetched, 'error': {p}.error, 'qord': {q}}}"


def _capped_levels(max_pages: int = 50, max_depth: int = 3) -> str:
    """Recursive CTE: each row is one processed level of one site, carrying the visited list, the
    crawled count and the next frontier (lists), exactly the level step of the Spark loop."""
    seeds = site_seeds(max_pages)
    cand = f"SELECT DISTINCT site, url FROM (SELECT site, url FROM ({seeds}) UNION ALL SELECT site, dst_url FROM ({edges()}))"
    cand = S.url_parts(cand, "url", "c")
    cand = (f"SELECT site, url, {S.normalized('c')} AS norm_url, lower(c_netloc) = site AS same_site, {S.crawlable('c')} AS crawlable "
            f"FROM ({cand})")
    ann = decisions(cand)
    item = ("{{'url': a.url, 'norm': a.norm_url, 'same': a.same_site, 'crawlable': a.crawlable, 'allowed': a.allowed, "
            "'fetched': a.fetched, 'error': a.error, 'qord': CAST({q} AS BIGINT)}}")
    dedup = "list_filter(fr, lambda x, i: list_position(list_transform(fr, lambda y: y.norm), x.norm) = i AND NOT list_contains(vis, x.norm))"
    outcome = ("list_transform(f1, lambda x: {'item': x, 'outcome': CASE WHEN NOT (x.same AND x.crawlable) THEN NULL "
               "WHEN NOT x.allowed THEN 'skipped' WHEN x.fetched THEN 'ok' ELSE 'skipped' END, "
               f"'reason': CASE WHEN NOT (x.same AND x.crawlable) THEN NULL WHEN NOT x.allowed THEN {S.lit(C.ROBOTS_REASON)} "
               f"WHEN x.fetched THEN NULL ELSE coalesce(x.error, {S.lit(C.MISSING_REASON)}) END}})")
    before = "list_transform(f2, lambda x, i: {'item': x.item, 'outcome': x.outcome, 'reason': x.reason, " \
             "'before': crawled + len(list_filter(f2[1:i - 1], lambda z: z.outcome = 'ok'))})"
    step_cols = (f"SELECT *, {dedup} AS f1 FROM prev", f"SELECT *, {outcome} AS f2 FROM s1", f"SELECT *, {before} AS f3 FROM s2",
                 "SELECT *, list_filter(f3, lambda x: x.before < max_pages) AS done_ FROM s3")
    nxt_raw = ("flatten(list_transform(list_filter(done_, lambda x: x.outcome = 'ok' AND lvl < max_depth AND NOT seeded), "
               "lambda x: coalesce(links[x.item.norm], [])))")
    vis2 = "list_concat(vis, list_transform(done_, lambda x: x.item.norm))"
    nxt = (f"list_transform(list_filter({nxt_raw}, lambda y: y.same AND NOT list_contains({vis2}, y.norm)), "
           f"lambda y, i: {_ITEM.format(p='y', q='CAST(i AS BIGINT)')})")
    finish = (f"SELECT site, lvl, done_ AS processed, {vis2} AS vis, crawled + len(list_filter(done_, lambda x: x.outcome = 'ok')) AS crawled, "
              f"{nxt} AS fr, max_pages, max_depth, seeded, links FROM s4")

    def chain(src: str) -> str:
        s1 = step_cols[0].replace("FROM prev", f"FROM ({src})")
        s2 = step_cols[1].replace("FROM s1", f"FROM ({s1})")
        s3 = step_cols[2].replace("FROM s2", f"FROM ({s2})")
        s4 = step_cols[3].replace("FROM s3", f"FROM ({s3})")
        return finish.replace("FROM s4", f"FROM ({s4})")

    base = ("SELECT f0.site, 0 AS lvl, f0.fr, []::VARCHAR[] AS vis, CAST(0 AS BIGINT) AS crawled, j.max_pages, "
            f"{max_depth} AS max_depth, m.seeded, coalesce(em.links, MAP {{}}) AS links FROM f0 JOIN j USING (site) "
            "JOIN mode m USING (site) LEFT JOIN em USING (site)")
    rec = ("SELECT site, lvl + 1 AS lvl, fr, vis, crawled, max_pages, max_depth, seeded, links FROM st "
           "WHERE len(fr) > 0")
    return f"""
    WITH RECURSIVE sd AS ({seeds}), e AS ({edges()}), o AS ({outcomes()}), j AS ({_jobs(str(max_pages))}),
    a AS (SELECT ann.*, coalesce(o.ok, false) AS fetched, o.error FROM ({ann}) ann LEFT JOIN o USING (norm_url)),
    mode AS (SELECT site, bool_or(sitemap_seeded) AS seeded FROM sd GROUP BY site),
    em AS (SELECT site, map_from_entries(list({{'key': src_norm, 'value': dsts}})) AS links FROM (
             SELECT e.site, e.src_norm, list({item.format(q='0')} ORDER BY e.pos) AS dsts
             FROM e JOIN a ON a.site = e.site AND a.url = e.dst_url GROUP BY e.site, e.src_norm) GROUP BY site),
    f0 AS (SELECT sd.site, list({item.format(q='sd.pos')} ORDER BY sd.pos) AS fr FROM sd JOIN a ON a.site = sd.site AND a.url = sd.url
           GROUP BY sd.site),
    st(site, lvl, processed, vis, crawled, fr, max_pages, max_depth, seeded, links) AS (
      {chain(base)}
      UNION ALL
      {chain(rec)}
    )
    SELECT st.site, st.lvl, st.processed, len(st.fr) AS enqueued_next, j.norm_root FROM st JOIN j USING (site)
    """


def _capped_rows() -> str:
    return f"""
    SELECT site, p.item.url AS url, p.item.norm AS norm_url, lvl AS depth, CAST(lvl AS BIGINT) * {C.ORD_SCALE} + p.item.qord AS page_ord,
           p.outcome AS outcome, p.reason AS reason,
           (p.item.norm = norm_root AND p.outcome = 'skipped' AND p.before = 0 AND p.reason != {S.lit(C.ROBOTS_REASON)}) AS root_failed
    FROM (SELECT site, lvl, norm_root, unnest(processed) AS p FROM ({_capped_levels()}))
    WHERE p.outcome IS NOT NULL
    """


def crawl_skips() -> str:
    return f"SELECT site, url, reason, page_ord FROM ({_capped_rows()}) WHERE outcome = 'skipped'"


def _worker(max_pages: int = 50, max_depth: int = 3) -> str:
    """One worker at its queue, an item a step, all sites at once: (site, step, norm, crawled, put, queue_size, known)."""
    seeds = site_seeds(max_pages)
    cand = f"SELECT DISTINCT site, url FROM (SELECT site, url FROM ({seeds}) UNION ALL SELECT site, dst_url FROM ({edges()}))"
    cand = S.url_parts(cand, "url", "c")
    cand = (f"SELECT site, url, {S.normalized('c')} AS norm_url, lower(c_netloc) = site AS same_site, {S.crawlable('c')} AS crawlable "
            f"FROM ({cand})")
    good = "a.same_site AND a.crawlable AND a.allowed AND a.fetched"
    return f"""
    WITH RECURSIVE sd AS ({seeds}), e AS ({edges()}), o AS ({outcomes()}), j AS ({_jobs(str(max_pages))}),
    a AS (SELECT ann.*, coalesce(o.ok, false) AS fetched FROM ({decisions(cand)}) ann LEFT JOIN o USING (norm_url)),
    mode AS (SELECT site, bool_or(sitemap_seeded) AS seeded FROM sd GROUP BY site),
    em AS (SELECT site, map_from_entries(list({{'key': src_norm, 'value': dsts}})) AS links FROM (
             SELECT e.site, e.src_norm, list({{'norm': a.norm_url, 'same': a.same_site, 'good': {good}}} ORDER BY e.pos) AS dsts
             FROM e JOIN a ON a.site = e.site AND a.url = e.dst_url GROUP BY e.site, e.src_norm) GROUP BY site),
    q0 AS (SELECT sd.site, list({{'norm': a.norm_url, 'good': {good}, 'depth': 0}} ORDER BY sd.pos) AS queue
           FROM sd JOIN a ON a.site = sd.site AND a.url = sd.url GROUP BY sd.site),
    w(site, step, queue, visited, norm, page, crawled, put, links, seeded) AS (
      SELECT q0.site, 0, queue, []::VARCHAR[], NULL::VARCHAR, false, 0::BIGINT, 0::BIGINT, coalesce(em.links, MAP {{}}), m.seeded
      FROM q0 JOIN mode m USING (site) LEFT JOIN em USING (site)
      UNION ALL
      SELECT site, step + 1, list_concat(queue, new), seen, x.norm, page, now, len(new)::BIGINT, links, seeded FROM (
        SELECT *, CASE WHEN page AND NOT seeded AND x.depth < {max_depth} THEN list_transform(
                         list_filter(coalesce(links[x.norm], []), lambda y: y.same AND NOT list_contains(seen, y.norm)),
                         lambda y: {{'norm': y.norm, 'good': y.good, 'depth': x.depth + 1}}) ELSE [] END AS new,
               crawled + page::BIGINT AS now FROM (
          SELECT * EXCLUDE (page), takes AND x.good AS page, CASE WHEN takes THEN list_append(visited, x.norm) ELSE visited END AS seen FROM (
            SELECT *, NOT list_contains(visited, x.norm) AND crawled < {max_pages} AS takes FROM (
              SELECT *, queue[step + 1] AS x FROM w WHERE step < len(queue))))))
    SELECT site, step, norm, page, crawled, put, len(queue) - step AS queue_size, CASE WHEN put > 0 THEN crawled + len(queue) - step END AS known FROM w
    """


def crawl_timeline() -> str:
    return f"""
    WITH w AS ({_worker()}), r AS ({_capped_rows()})
    SELECT w.site, r.page_ord, w.crawled, w.put AS enqueued, w.queue_size::BIGINT AS queue_size, w.known::BIGINT AS total_known
    FROM w JOIN r ON r.site = w.site AND r.norm_url = w.norm WHERE w.page
    """


def crawl_progress() -> str:
    seeds = site_seeds(50)
    return f"""
    WITH r AS ({_capped_rows()}), w AS ({_worker()}), sd AS ({seeds}), j AS ({_jobs('50')}),
    mode AS (SELECT site, bool_or(sitemap_seeded) AS seeded, count(*) AS n_seeds FROM sd GROUP BY site),
    c AS (SELECT site, count(*) FILTER (WHERE outcome = 'ok') AS crawled, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
                 arg_min('Could not reach ' || url || ': ' || reason, page_ord) FILTER (WHERE root_failed) AS error FROM r GROUP BY site),
    live AS (SELECT site, arg_max(queue_size, step) FILTER (WHERE page) AS queue_size, arg_max(known, step) FILTER (WHERE put > 0) AS known FROM w GROUP BY site)
    SELECT j.site, j.root_url, coalesce(m.seeded, false) AS sitemap_seeded, CAST(coalesce(l.queue_size, 0) AS BIGINT) AS queue_size,
           CAST(coalesce(c.crawled, 0) AS BIGINT) AS pages_crawled, CAST(coalesce(c.skipped, 0) AS BIGINT) AS pages_skipped,
           CAST(coalesce(l.known, m.n_seeds, 0) AS BIGINT) AS total_known,
           CASE WHEN c.error IS NOT NULL THEN 'error' ELSE 'done' END AS status, c.error, CAST(100.0 AS DOUBLE) AS progress_pct
    FROM j LEFT JOIN mode m USING (site) LEFT JOIN c USING (site) LEFT JOIN live l USING (site)
    """


def crawl_level_progress() -> str:
    return f"""
    WITH lv AS (SELECT site, lvl, len(processed) AS n, len(list_filter(processed, lambda x: x.outcome = 'ok')) AS ok, enqueued_next AS q
                FROM ({_capped_levels()}) WHERE len(processed) > 0),
    mode AS (SELECT site, bool_or(sitemap_seeded) AS seeded, count(*) AS n_seeds FROM ({site_seeds(50)}) GROUP BY site),
    c AS (SELECT *, sum(ok) OVER (PARTITION BY site ORDER BY lvl) AS crawled FROM lv JOIN mode USING (site))
    SELECT site, CAST(lvl AS INTEGER) AS depth, CAST(n AS BIGINT) AS processed, CAST(crawled AS BIGINT) AS pages_crawled, CAST(q AS BIGINT) AS queue_size,
           CAST(CASE WHEN seeded THEN n_seeds ELSE crawled + q END AS BIGINT) AS total_known,
           CASE WHEN seeded THEN least(crawled / n_seeds * 100, 99.0) END AS progress_pct FROM c
    """


ORACLE["crawl_skips"] = crawl_skips
ORACLE["crawl_level_progress"] = crawl_level_progress
ORACLE["crawl_progress"] = crawl_progress
ORACLE["crawl_timeline"] = crawl_timeline


def crawl_documents() -> str:
    from sitefold.plans import site_oracle as SO

    # crawl order restarts per site; a global rank keeps each site's order and is unique as a key
    pages = (f"(SELECT row_number() OVER (ORDER BY r.site, r.page_ord) AS page_ord, r.url, o.html FROM ({_capped_rows()}) r "
             f"JOIN ({outcomes()}) o ON o.norm_url = r.norm_url WHERE r.outcome = 'ok') crawled_pages")
    meta = S.page_meta(order_col="page_ord", source=pages)
    sites = f"SELECT site, root_url FROM ({_jobs('50')})"
    return SO._documents(meta, given_sites=sites)


ORACLE["crawl_documents"] = crawl_documents


def crawl_job_detail() -> str:
    return (f"SELECT p.site, p.status, p.pages_crawled, p.pages_skipped, p.queue_size, p.total_known, p.sitemap_seeded, p.progress_pct, p.error, "
            f"CASE WHEN p.status = 'done' THEN p.pages_crawled END AS page_count, "
            f"CASE WHEN p.status = 'done' THEN d.llms_txt END AS llms_txt "
            f"FROM ({crawl_progress()}) p LEFT JOIN ({crawl_documents()}) d USING (site)")


ORACLE["crawl_job_detail"] = crawl_job_detail


def crawl_job_children() -> str:
    return f"""
    WITH r AS (SELECT *, CASE WHEN outcome = 'ok' THEN 'crawled' ELSE 'skipped' END AS kind FROM ({_capped_rows()})),
    n AS (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY page_ord) - 1 AS n FROM r)
    SELECT site, kind, n // 1000 AS page_no, CAST(n % 1000 AS INTEGER) AS slot, url, CAST(depth AS INTEGER) AS depth, reason FROM n
    """


def crawl_job_manifest() -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_rows, coalesce(max(page_no) FILTER (kind = '{k}') + 1, 0) AS {k}_pages"
                       for k in ("skipped", "crawled"))
    # a document's parts: its header, and one for every 1,000 list lines begun
    lines = "len(list_filter(string_split(llms_txt, chr(10)), lambda x: starts_with(x, '- [')))"
    return f"""
    WITH c AS (SELECT site, {counts} FROM ({crawl_job_children()}) GROUP BY site),
    d AS (SELECT site, CAST(1 + ceil({lines} / 1000) AS BIGINT) AS document_parts, CAST(length(llms_txt) AS BIGINT) AS document_chars FROM ({crawl_documents()}))
    SELECT p.*, coalesce(skipped_rows, 0) AS skipped_rows, coalesce(skipped_pages, 0) AS skipped_pages, coalesce(crawled_rows, 0) AS crawled_rows,
           coalesce(crawled_pages, 0) AS crawled_pages, CASE WHEN status = 'done' THEN document_parts END AS document_parts,
           CASE WHEN status = 'done' THEN document_chars END AS document_chars
    FROM ({crawl_progress()}) p LEFT JOIN c USING (site) LEFT JOIN d USING (site)
    """


ORACLE["crawl_job_children"] = crawl_job_children
ORACLE["crawl_job_manifest"] = crawl_job_manifest
