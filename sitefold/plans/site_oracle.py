"""DuckDB oracle SQL for the queries in ``site_queries.py`` (same column names)."""

from __future__ import annotations

from sitefold.functions import urls as U
from sitefold.operators.documents import DEFAULT_SECTION, EMPTY_SITE_LINE, UNDESCRIBED_SECTION
from sitefold.plans import sqlparts as S

NL = "chr(10)"


def _meta() -> str:
    return S.page_meta()


def _varied(meta: str) -> str:
    return (f"SELECT site, page_ord, url, norm_url, path_prefix, "
            f"CASE WHEN page_ord % 5 < 3 AND title IS NOT NULL THEN title || ' | ' || site ELSE title END AS title, "
            f"CASE WHEN page_ord % 7 = 0 THEN NULL ELSE description END AS description, h1, depth, "
            f"CASE WHEN page_ord % 7 = 0 THEN false ELSE description IS NOT NULL END AS has_description FROM ({meta})")


def _sites(meta: str, given: str | None = None) -> str:
    s = given or f"SELECT DISTINCT site, 'https://' || site || '/' AS root_url FROM ({meta})"
    s = S.url_parts(s, "root_url", "r")
    return f"SELECT site, root_url, {S.normalized('r')} AS norm_root, r_netloc AS root_netloc FROM ({s})"


def url_normalize() -> str:
    s = S.url_parts("SELECT page_id, url FROM pages", "url", "u")
    return f"SELECT page_id, url, {S.normalized('u')} AS norm_url, {S.without_fragment('u')} AS no_fragment FROM ({s})"


def url_parts() -> str:
    s = S.url_parts("SELECT page_id, url FROM pages", "url", "u")
    cols = ", ".join(f"u_{x} AS {x}" for x in U.PARTS)
    return (f"SELECT page_id, {cols}, {S.site_of('u')} AS site, {S.path_prefix('u')} AS path_prefix, "
            f"{S.hostname('u')} AS hostname FROM ({s})")


def _hrefs() -> str:
    return S.hrefs()


def url_resolve() -> str:
    s = S.resolved(_hrefs(), "url", "href", "resolved")
    return f"SELECT page_id, pos, href, resolved FROM ({s})"


def url_crawlable() -> str:
    s = S.resolved(_hrefs(), "url", "href", "target")
    s = S.url_parts(S.url_parts(s, "target", "t"), "url", "s")
    return (f"SELECT page_id, pos, target, {S.crawlable('t')} AS crawlable, "
            f"{S.site_of('t')} = {S.site_of('s')} AS same_domain FROM ({s})")


def page_metadata() -> str:
    return _meta()


def page_links() -> str:
    return S.page_links()


def links_per_site() -> str:
    return (f"SELECT site, count(*) AS n_links, count(*) FILTER (WHERE dst_site = site) AS n_internal, "
            f"count(DISTINCT norm_url) AS n_targets FROM ({S.page_links()}) GROUP BY site")


def site_suffix() -> str:
    return S.site_suffixes(_meta())


def site_suffix_varied() -> str:
    return S.site_suffixes(_varied(_meta()))


def _site_title(title: str, h1: str, netloc: str, suffix: str) -> str:
    cleaned = S.without_suffix(title, suffix)
    return (f"(CASE WHEN {title} IS NOT NULL AND {title} != '' AND {cleaned} != '' THEN {cleaned} "
            f"WHEN {h1} IS NOT NULL AND {h1} != '' THEN {h1} ELSE {netloc} END)")


def site_titles() -> str:
    capped = _varied(_meta())
    return f"""
    WITH c AS ({capped}),
    s AS ({_sites('SELECT * FROM c')}),
    x AS ({S.site_suffixes('SELECT * FROM c')}),
    r AS (SELECT c.site, arg_min({{'title': title, 'h1': h1}},
                 (CASE WHEN norm_url != norm_root THEN 1 ELSE 0 END) * 1000000000000000 + page_ord) AS r
          FROM c JOIN s USING (site) GROUP BY c.site)
    SELECT s.site, root_url, suffix, {_site_title('r.r.title', 'r.r.h1', 'root_netloc', 'suffix')} AS site_title
    FROM s JOIN x USING (site) JOIN r USING (site)
    """


def _sections(capped: str, given_sites: str | None = None) -> str:
    dt = S.display_title("title", "h1", "url", "suffix")
    shown = "CASE WHEN display_title != '' THEN display_title ELSE url END"
    line = ("'- [' || shown || '](' || url || ')' || "
            "CASE WHEN description IS NOT NULL AND description != '' THEN ': ' || description ELSE '' END")
    return f"""
    WITH c AS ({capped}),
    s AS ({_sites('SELECT * FROM c', given_sites)}),
    x AS ({S.site_suffixes('SELECT * FROM c')}),
    j AS (SELECT c.*, s.norm_root, x.suffix FROM c JOIN s USING (site) JOIN x USING (site)),
    l AS (SELECT *, {dt} AS display_title FROM j WHERE norm_url != norm_root),
    l2 AS (SELECT *, {shown} AS shown FROM l)
    SELECT site, page_ord, url,
           CASE WHEN has_description THEN {S.section_name('path_prefix')} ELSE '{UNDESCRIBED_SECTION}' END AS section,
           NOT has_description AS undescribed, display_title, {line} AS line
    FROM l2
    """


def site_sections() -> str:
    return _sections(_varied(_meta()))


def _documents(meta: str, given_sites: str | None = None) -> str:
    key = f"undescribed, section != '{DEFAULT_SECTION}', section, display_title, page_ord"
    header = (f"'# ' || title_line || {NL} || {NL} || CASE WHEN rdesc IS NOT NULL AND rdesc != '' "
              f"THEN '> ' || rdesc || {NL} || {NL} ELSE '' END")
    return f"""
    WITH c AS ({meta}),
    s AS ({_sites('SELECT * FROM c', given_sites)}),
    x AS ({S.site_suffixes('SELECT * FROM c')}),
    r AS (SELECT c.site, arg_min({{'title': title, 'h1': h1, 'description': description}},
                 (CASE WHEN norm_url != norm_root THEN 1 ELSE 0 END) * 1000000000000000 + page_ord) AS r,
                 count(*) AS page_count
          FROM c JOIN s USING (site) GROUP BY c.site),
    items AS ({_sections('SELECT * FROM c', given_sites)}),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {key}) AS rn,
                       lag(undescribed) OVER (PARTITION BY site ORDER BY {key}) AS p_u,
                       lag(section) OVER (PARTITION BY site ORDER BY {key}) AS p_sec FROM items),
    parts AS (SELECT site, {key}, CASE WHEN rn = 1 OR p_u != undescribed OR p_sec != section
                    THEN CASE WHEN rn > 1 THEN {NL} ELSE '' END || '## ' || section || {NL} || {NL} ELSE '' END
                    || line || {NL} AS piece FROM ordered),
    bodies AS (SELECT site, string_agg(piece, '' ORDER BY {key}) AS body FROM parts GROUP BY site),
    d AS (SELECT s.site, s.root_url, s.root_netloc, r.page_count, r.r.description AS rdesc,
                 {_site_title('r.r.title', 'r.r.h1', 'root_netloc', "coalesce(x.suffix, '')")} AS title_line, bodies.body
          FROM s LEFT JOIN x USING (site) LEFT JOIN r USING (site) LEFT JOIN bodies USING (site))
    SELECT site, root_url, CAST(coalesce(page_count, 0) AS BIGINT) AS page_count,
           CASE WHEN page_count IS NULL THEN '# ' || root_netloc || {NL} || {NL} || {S.lit(EMPTY_SITE_LINE)} || {NL}
                ELSE {S.rstrip(f"{header} || coalesce(body, '')")} || {NL} END AS llms_txt
    FROM d
    """


def site_documents() -> str:
    return _documents(_meta())


def site_documents_varied() -> str:
    return _documents(_varied(_meta()))


def site_document_parts() -> str:
    """The whole documents cut after every PART_LINES list lines; the header is part 0."""
    docs = f"SELECT site, page_count, llms_txt FROM ({site_documents_varied()})"
    return f"""
    WITH d AS ({docs}),
    l AS (SELECT site, page_count, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line
          FROM (SELECT site, page_count, string_split(rtrim(llms_txt, {NL}), {NL}) AS x FROM d)),
    n AS (SELECT *, starts_with(line, '- [') AS item,
                 count(*) FILTER (starts_with(line, '- [')) OVER (PARTITION BY site ORDER BY i) AS seen,
                 min(i) FILTER (starts_with(line, '## ')) OVER (PARTITION BY site) AS body FROM l),
    p AS (SELECT *, CASE WHEN body IS NULL OR i < body THEN 0
                    ELSE CAST(floor((CASE WHEN item THEN seen - 1 ELSE seen END) / 1000) AS BIGINT) + 1 END AS part_no FROM n)
    SELECT site, page_count, CAST(part_no AS BIGINT) AS part_no, string_agg(line, {NL} ORDER BY i) || {NL} AS text,
           count(*) FILTER (item) AS listed FROM p GROUP BY site, page_count, part_no
    """


ORACLE = {
    "url_normalize": url_normalize,
    "url_parts": url_parts,
    "url_crawlable": url_crawlable,
    "url_resolve": url_resolve,
    "page_metadata": page_metadata,
    "page_links": page_links,
    "links_per_site": links_per_site,
    "site_suffix": site_suffix,
    "site_suffix_varied": site_suffix_varied,
    "site_titles": site_titles,
    "site_sections": site_sections,
    "site_document_parts": site_document_parts,
    "site_documents": site_documents,
    "site_documents_varied": site_documents_varied,
}
