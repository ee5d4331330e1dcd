"""DuckDB oracle SQL for ``job_queries.py`` (same column names)."""

from __future__ import annotations

from sitefold.operators.requests import TTL_SECONDS
from sitefold.plans import sqlparts as S
from sitefold.sources import jobtables as T


def _url(key: str) -> str:
    return (f"('https://' || CASE WHEN {key} % 4 = 1 THEN 'WWW.' ELSE 'www.' END || 'c' || CAST(({key} // 4) % 500 AS VARCHAR) "
            f"|| '.example.com' || CASE WHEN {key} % 2 = 0 THEN '/' ELSE '' END)")


_STARTS = ("SELECT o_custkey AS batch_id, min(o_orderdate) + to_seconds(o_custkey % 3 * 60) AS batch_start FROM orders "
           "WHERE o_orderkey % 3 = 0 GROUP BY o_custkey")


def jobs() -> str:
    return f"""
    SELECT o_orderkey AS job_id, {_url('o_orderkey')} AS url, status,
           CAST(CASE WHEN status = 'pending' THEN 0 ELSE ok_lines END AS BIGINT) AS pages_crawled,
           CAST(CASE WHEN status = 'pending' THEN 0 ELSE r_lines END AS BIGINT) AS pages_skipped,
           CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS parent_batch_id, 50 AS max_pages, 3 AS max_depth, submitted_at, started_at,
           CASE WHEN status IN ('done', 'error', 'cancelled')
                THEN started_at + to_microseconds(CAST((ok_lines * 2 + o_orderkey % 7) * 1000000 + 250000 AS BIGINT)) END AS completed_at,
           CASE WHEN status = 'error' THEN 'Could not reach ' || {_url('o_orderkey')} || ': HTTP 503' END AS error
    FROM (
      SELECT *, CASE WHEN status != 'pending' THEN submitted_at + to_microseconds(CAST((o_orderkey % 50) * 1000000 AS BIGINT)) END AS started_at
      FROM (
        SELECT o.o_orderkey, o.o_custkey, coalesce(li.ok_lines, 0) AS ok_lines, coalesce(li.r_lines, 0) AS r_lines,
               CASE WHEN o.o_orderkey % 6 = 0 THEN greatest(o.o_orderdate, b.batch_start) ELSE o.o_orderdate END AS submitted_at,
               CASE WHEN o.o_orderkey % 10 = 0 THEN 'error' WHEN o.o_orderkey % 10 = 1 THEN 'cancelled'
                    WHEN o.o_orderstatus = 'F' THEN 'done' WHEN o.o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status
        FROM orders o LEFT JOIN (
          SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag != 'R') AS ok_lines,
                 count(*) FILTER (WHERE l_returnflag = 'R') AS r_lines FROM lineitem GROUP BY l_orderkey) li
        ON o.o_orderkey = li.l_orderkey LEFT JOIN ({_STARTS}) b ON b.batch_id = o.o_custkey))
    """


def batches() -> str:
    return (f"SELECT batch_id, batch_urls, batch_start AS submitted_at, batch_id % 5 = 0 AS cancel_requested FROM "
            f"(SELECT o_custkey AS batch_id, list({_url('o_orderkey')} ORDER BY o_orderkey) AS batch_urls FROM orders "
            f"WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) JOIN ({_STARTS}) USING (batch_id)")


def requests() -> str:
    host = ("(CASE WHEN event_id % 3 = 0 THEN 'U' ELSE 'u' END || CAST(user_id % 300 AS VARCHAR) || '.example.org')")
    url = (f"CASE WHEN event_id % 97 = 0 THEN 'not-a-url-' || CAST(event_id AS VARCHAR) "
           f"WHEN event_id % 89 = 0 THEN 'ftp://' || {host} || '/' "
           f"ELSE 'https://' || {host} || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END END")
    return (f"SELECT event_id AS request_id, {url} AS url, ts AS requested_at, CAST(abs(value) AS DOUBLE) AS run_seconds, "
            f"event_type = 'error' AS failed, CAST(event_id % 230 - 10 AS INTEGER) AS max_pages, "
            f"CAST(event_id % 13 AS INTEGER) AS max_depth FROM events")


def seed_lines() -> str:
    line = ("CASE WHEN page_id % 7 = 0 THEN 'not a url ' || CAST(page_id AS VARCHAR) "
            "WHEN page_id % 5 = 0 THEN '  ' || url || ' ,, ' || url || '#dup' "
            "WHEN page_id % 11 = 0 THEN 'HTTPS://x' || CAST(page_id AS VARCHAR) || '.example.com' ELSE url END")
    return (f"SELECT 0 AS source_no, page_id AS line_no, {line} AS line FROM pages "
            f"UNION ALL SELECT 1 AS source_no, -page_id AS line_no, url AS line FROM pages")


def seed_list() -> str:
    s = f"SELECT source_no, line_no, string_split_regex(line, {S.lit('[' + chr(10) + ',]+')}) AS parts FROM ({seed_lines()})"
    s = f"SELECT source_no, line_no, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS raw FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM ({s}))"
    s = f"SELECT source_no, line_no, pos, {S.strip('raw')} AS url FROM ({s})"
    s = f"SELECT * FROM ({s}) WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')"
    return (f"SELECT url, source_no, line_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_no, line_no, pos) AS rn "
            f"FROM ({s})) WHERE rn = 1")


def _validated() -> str:
    s = S.url_parts(requests(), "url", "v")
    ok_url = "(v_scheme IN ('http', 'https') AND regexp_replace(v_netloc, '^.*@|:[0-9]*$', '', 'g') != '')"
    reason = (f"CASE WHEN NOT {ok_url} THEN 'invalid url' WHEN max_pages < 1 OR max_pages > 200 THEN 'max_pages out of range' "
              f"WHEN max_depth < 1 OR max_depth > 10 THEN 'max_depth out of range' END")
    s = f"SELECT *, {reason} AS reject_reason FROM ({s})"
    accepted = ("CASE WHEN reject_reason IS NULL THEN CASE WHEN v_path = '' AND v_params = '' "
                "THEN regexp_replace(url, '[?#].*$', '') || '/' || regexp_extract(url, '([?#].*)$', 1) ELSE url END END")
    return f"SELECT *, {accepted} AS accepted_url FROM ({s})"


def request_validation() -> str:
    return f"SELECT request_id, url, max_pages, max_depth, reject_reason, accepted_url FROM ({_validated()})"


def request_dedup() -> str:
    """Sequential TTL fold as a recursive CTE: the next kept request of a key is the first one at
    or after the expiry of the previous kept one."""
    s = f"SELECT * FROM ({_validated()}) WHERE reject_reason IS NULL"
    s = S.url_parts(s, "accepted_url", "k")
    s = f"SELECT request_id, {S.normalized('k')} AS norm_url, requested_at, run_seconds, failed FROM ({s})"
    ttl_us = int(TTL_SECONDS * 1_000_000)
    return f"""
    WITH RECURSIVE r AS (
      SELECT request_id, norm_url, epoch_us(requested_at) AS t,
             epoch_us(requested_at) + CAST(round(run_seconds * 1000000) AS BIGINT) + CASE WHEN failed THEN 0 ELSE {ttl_us} END AS exp,
             row_number() OVER (PARTITION BY norm_url ORDER BY epoch_us(requested_at), request_id) AS i
      FROM ({s})),
    chain(norm_url, i, exp) AS (
      SELECT norm_url, i, exp FROM r WHERE i = 1
      UNION ALL
      SELECT norm_url, i, exp FROM (
        SELECT r.norm_url, r.i, r.exp, row_number() OVER (PARTITION BY r.norm_url ORDER BY r.i) AS k
        FROM chain c JOIN r ON r.norm_url = c.norm_url AND r.i > c.i AND r.t >= c.exp) WHERE k = 1),
    kept AS (SELECT r.request_id, r.norm_url, r.i FROM r JOIN chain USING (norm_url, i))
    SELECT r.request_id, r.norm_url, kept.request_id IS NOT NULL AS kept,
           (SELECT k2.request_id FROM kept k2 WHERE k2.norm_url = r.norm_url AND k2.i <= r.i ORDER BY k2.i DESC LIMIT 1) AS job_request_id
    FROM r LEFT JOIN kept ON kept.request_id = r.request_id
    """


def _secs(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 1000000.0)"


def job_states() -> str:
    t = "TIMESTAMP '2001-09-01 00:00:00'"
    state = (f"CASE WHEN completed_at IS NOT NULL AND completed_at <= {t} THEN status "
             f"WHEN started_at IS NOT NULL AND started_at <= {t} THEN 'running' ELSE 'pending' END")
    return (f"SELECT job_id, state, state IN ('pending', 'running') AS cancellable FROM "
            f"(SELECT job_id, {state} AS state FROM ({jobs()}) WHERE submitted_at <= {t})")


def job_events() -> str:
    none = "CAST(NULL AS VARCHAR)"
    late = "to_microseconds(CAST(((job_id * 7 + l_linenumber * 13) % 80) * 1000000 + CASE WHEN l_linenumber % 2 = 1 THEN 250000 ELSE 0 END AS BIGINT))"
    return f"""
    WITH j AS MATERIALIZED ({jobs()})
    SELECT job_id, submitted_at AS at_, 0 AS seq, 'submit' AS kind, {none} AS error FROM j
    UNION ALL SELECT job_id, submitted_at + INTERVAL 5 SECOND, 1, 'submit', {none} FROM j WHERE job_id % 21 = 0
    UNION ALL SELECT job_id, started_at, 10, 'start', {none} FROM j WHERE started_at IS NOT NULL
    UNION ALL SELECT job_id, started_at, 20, 'cancel', {none} FROM j WHERE status = 'cancelled'
    UNION ALL SELECT job_id, completed_at, 30, 'end', {none} FROM j WHERE status IN ('done', 'cancelled')
    UNION ALL SELECT job_id, completed_at, 31, 'fail', error FROM j WHERE status = 'error'
    UNION ALL SELECT job_id, completed_at + INTERVAL 10 SECOND, 32, 'end', {none} FROM j WHERE status IN ('done', 'cancelled', 'error') AND job_id % 15 = 0
    UNION ALL SELECT CASE WHEN l_linenumber = 6 THEN -job_id ELSE job_id END, submitted_at + {late}, CAST(l_linenumber + 40 AS INTEGER), 'cancel', {none}
              FROM j JOIN lineitem ON l_orderkey = job_id WHERE l_returnflag = 'R'
    """


def _job_marks() -> str:
    """Per job the places of its submission, its start and its end in its log (structs that compare as (at, seq))."""
    place = "{'at': at_, 'seq': seq}"
    return f"""
    ev AS MATERIALIZED ({job_events()}),
    s AS (SELECT job_id, min({place}) AS sub FROM ev WHERE kind = 'submit' GROUP BY job_id),
    t AS (SELECT job_id, min({place}) AS st FROM ev JOIN s USING (job_id) WHERE kind = 'start' AND {place} > sub GROUP BY job_id),
    e AS (SELECT job_id, min({place}) AS en, arg_min({{'kind': kind, 'error': error}}, {place}) AS how
          FROM ev JOIN t USING (job_id) WHERE kind IN ('end', 'fail') AND {place} > st GROUP BY job_id),
    c AS (SELECT ev.job_id, at_, seq, CASE WHEN sub IS NULL OR {place} < sub THEN 'not found' WHEN en IS NULL OR {place} < en THEN 'cancelling' ELSE 'late' END AS out_
          FROM ev LEFT JOIN s USING (job_id) LEFT JOIN e USING (job_id) WHERE kind = 'cancel'),
    n AS (SELECT job_id, min(at_) FILTER (WHERE out_ = 'cancelling') AS asked, count(*) FILTER (WHERE out_ = 'cancelling') AS yes,
                 count(*) FILTER (WHERE out_ != 'cancelling') AS no_ FROM c GROUP BY job_id),
    m AS (SELECT job_id, sub, st, en, how, asked, coalesce(yes, 0) AS yes, coalesce(no_, 0) AS no_, k.others,
                 CASE WHEN sub IS NULL THEN 'not found' WHEN how.kind = 'fail' THEN 'error' WHEN en IS NOT NULL AND yes > 0 THEN 'cancelled'
                      WHEN en IS NOT NULL THEN 'done' WHEN st IS NOT NULL THEN 'running' ELSE 'pending' END AS state
          FROM (SELECT job_id, count(*) FILTER (WHERE kind != 'cancel') AS others FROM ev GROUP BY job_id) k
          LEFT JOIN s USING (job_id) LEFT JOIN t USING (job_id) LEFT JOIN e USING (job_id) LEFT JOIN n USING (job_id))"""


def job_event_states() -> str:
    return f"""
    WITH {_job_marks()}
    SELECT job_id, state, state IN ('pending', 'running') AND yes > 0 AS cancelling, sub.at AS submitted_at, st.at AS started_at,
           asked AS cancel_requested_at, en.at AS completed_at,
           CASE WHEN state IN ('done', 'cancelled') THEN {_secs('en.at', 'st.at')} END AS duration_seconds,
           CASE WHEN state IN ('done', 'cancelled') THEN 100.0::DOUBLE END AS progress_pct, how.error AS error,
           yes AS cancels_accepted, no_ AS cancels_refused,
           others - (sub IS NOT NULL)::BIGINT - (st IS NOT NULL)::BIGINT - (en IS NOT NULL)::BIGINT AS events_ignored
    FROM m
    """


def job_cancels() -> str:
    place = "{'at': at_, 'seq': seq}"
    return f"""
    WITH {_job_marks()},
    x AS (SELECT c.job_id, at_, seq, out_, CASE WHEN out_ = 'late' THEN state WHEN out_ = 'not found' THEN 'not found'
                 WHEN st IS NOT NULL AND st < {place} THEN 'running' ELSE 'pending' END AS met FROM c JOIN m USING (job_id))
    SELECT job_id, at_ AS "at", seq, met AS state_met, CASE WHEN out_ = 'late' THEN 'already ' || met ELSE out_ END AS outcome FROM x
    """


def _duration() -> str:
    return f"CASE WHEN completed_at IS NOT NULL AND started_at IS NOT NULL THEN {_secs('completed_at', 'started_at')} END"


def _elapsed() -> str:
    return (f"CASE WHEN started_at IS NOT NULL THEN {_secs(f'coalesce(completed_at, TIMESTAMP {S.lit(T.AS_OF)})', 'started_at')} END")


def _fmt(d: str) -> str:
    whole = f"CAST(round({d}) AS BIGINT)"
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN round({d}, 1) < 60 THEN printf('%.1f', round({d}, 1)) || 's' "
            f"ELSE CAST(floor({whole} / 60) AS BIGINT) || 'm ' || CAST({whole} % 60 AS BIGINT) || 's' END")


def _progress() -> str:
    return "CASE WHEN status IN ('done', 'cancelled') THEN 100.0::DOUBLE END"


def _listing(status: str | None) -> str:
    top = (f"SELECT job_id, url, status, pages_crawled, pages_skipped, submitted_at, started_at, completed_at, 0 AS batch_url_count, "
           f"{_progress()} AS progress_pct FROM ({jobs()}) WHERE parent_batch_id IS NULL")
    parents = (f"SELECT -batch_id AS job_id, batch_urls[1] AS url, status, pages_crawled, pages_skipped, submitted_at, submitted_at AS started_at, "
               f"completed_at, len(batch_urls) AS batch_url_count, NULL::DOUBLE AS progress_pct "
               f"FROM ({batches()}) JOIN ({batch_rollup()}) USING (batch_id)")
    rows = f"SELECT * FROM ({top} UNION ALL {parents})"
    if status:
        rows = f"SELECT * FROM ({rows}) WHERE status = {S.lit(status)}"
    return f"""
    WITH rows AS ({rows}), d AS (SELECT *, {_duration()} AS duration_seconds FROM rows)
    SELECT job_id, url, status, pages_crawled, pages_skipped, progress_pct, duration_seconds, {_elapsed()} AS elapsed_seconds,
           {_fmt('duration_seconds')} AS duration_text, batch_url_count > 0 AS is_batch,
           CAST(batch_url_count AS INTEGER) AS batch_url_count, (SELECT count(*) FROM rows) AS total, submitted_at
    FROM d
    """


def job_listing() -> str:
    return _listing(None)


def job_listing_done() -> str:
    return _listing("done")


def job_detail() -> str:
    return (f"SELECT job_id, status, url, pages_crawled, pages_skipped, max_pages, max_depth, {_progress()} AS progress_pct, {_elapsed()} AS elapsed_seconds, "
            f"{_duration()} AS duration_seconds, CASE WHEN status = 'done' THEN pages_crawled END AS page_count, error FROM ({jobs()})")


def job_lookup() -> str:
    return (f"SELECT job_id, status IS NOT NULL AS found, status, CASE WHEN status = 'done' THEN pages_crawled END AS page_count, error FROM "
            f"(SELECT DISTINCT unnest([l_orderkey, l_orderkey + 1]) AS job_id FROM lineitem) LEFT JOIN ({jobs()}) USING (job_id)")


def job_metrics() -> str:
    return (f"SELECT count(*) FILTER (WHERE status IN ('pending', 'running')) AS active_jobs, count(*) AS total_jobs, "
            f"count(*) FILTER (WHERE status = 'done') AS completed_jobs, count(*) FILTER (WHERE status = 'error') AS failed_jobs, "
            f"count(*) FILTER (WHERE status = 'cancelled') AS cancelled_jobs, "
            f"CAST(coalesce(sum(pages_crawled), 0) AS BIGINT) AS total_pages_crawled, "
            f"CAST(coalesce(sum(pages_skipped), 0) AS BIGINT) AS total_pages_skipped FROM ({jobs()})")


def recent_jobs() -> str:
    return (f"SELECT job_id, url, status, pages_crawled, pages_skipped, {_duration()} AS duration_seconds, submitted_at "
            f"FROM ({jobs()}) ORDER BY submitted_at DESC, job_id DESC LIMIT 10")


def _norm_col(src: str, url: str, out: str) -> str:
    s = S.url_parts(src, url, "z")
    return f"SELECT * EXCLUDE ({', '.join('z_' + x for x in ('scheme', 'netloc', 'path', 'params', 'query', 'fragment'))}), {S.normalized('z')} AS {out} FROM ({s})"


def _submitted() -> str:
    """(submission, pos, url): distinct urls by file, then form, by key, then place in the line."""
    sub = f"o_custkey // {T.CUSTOMERS_PER_SUBMISSION}"
    url = _url("o_orderkey")
    mark = "chr(65533)"  # what a broken sequence becomes, once for each maximal part
    bad = f"CASE o_orderkey % 4 WHEN 2 THEN {mark} || {mark} WHEN 3 THEN {mark} || {mark} || {mark} ELSE {mark} END"
    line = (f"CASE WHEN ({sub}) % 9 = 0 THEN 'HTTPS://' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 7 = 0 THEN 'no url ' || CAST(o_orderkey AS VARCHAR) "
            f"WHEN o_orderkey % 11 = 0 THEN '  ' || {url} || ' ,, ' || {url} || '#x ' WHEN o_orderkey % 13 = 0 THEN {url} || '/' || {bad} ELSE {url} END")
    return f"""
    WITH l AS (SELECT {sub} AS submission, o_orderkey AS key, {line} AS line FROM orders WHERE o_orderkey % 5 = 2),
    s AS (SELECT 0 AS source, * FROM l WHERE key % 2 = 0 UNION ALL SELECT 1, * FROM l WHERE key % 2 = 1 OR key % 3 = 0),
    i AS (SELECT submission, source, key, i, {S.strip('parts[i]')} AS url
          FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM (SELECT *, string_split_regex(line, ',+') AS parts FROM s))),
    f AS (SELECT submission, url, min({{'source': source, 'key': key, 'i': i}}) AS o FROM i
          WHERE starts_with(url, 'http://') OR starts_with(url, 'https://') GROUP BY submission, url)
    SELECT submission, row_number() OVER (PARTITION BY submission ORDER BY o) - 1 AS pos, url FROM f
    """


def batch_submissions() -> str:
    return f"""
    WITH t AS (SELECT DISTINCT o_custkey // {T.CUSTOMERS_PER_SUBMISSION} AS submission FROM orders WHERE o_orderkey % 5 = 2),
    p AS (SELECT submission, CAST(least(submission * 37 % 230 - 10, 200) AS INTEGER) AS max_pages, CAST(submission % 12 AS INTEGER) AS max_depth FROM t),
    u AS (SELECT submission, count(*) AS url_count, arg_min(url, pos) AS url FROM ({_submitted()}) GROUP BY submission),
    r AS (SELECT p.*, coalesce(url_count, 0) AS url_count, url, CASE WHEN max_pages < 1 THEN 'max_pages out of range'
                 WHEN max_depth < 1 OR max_depth > 10 THEN 'max_depth out of range' WHEN url_count IS NULL THEN 'no valid urls' END AS reject_reason
          FROM p LEFT JOIN u USING (submission))
    SELECT submission, CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, reject_reason, url_count, url, max_pages, max_depth FROM r
    """


def submission_expand() -> str:
    return _expand(f"""
    SELECT submission AS batch_id, started, CAST(pos AS INTEGER) AS pos, url FROM ({_submitted()})
    JOIN (SELECT submission FROM ({batch_submissions()}) WHERE outcome = 'accepted') USING (submission)
    JOIN (SELECT o_custkey // {T.CUSTOMERS_PER_SUBMISSION} AS submission, max(o_orderdate) + INTERVAL 10 MINUTE AS started FROM orders
          WHERE o_orderkey % 5 = 2 GROUP BY ALL) USING (submission)""")


def _expand(items: str | None = None) -> str:
    """Each batch url looks at all jobs before it: submitted earlier, or at its instant and not a child."""
    items = items or (f"SELECT batch_id, submitted_at AS started, CAST(i - 1 AS INTEGER) AS pos, batch_urls[i] AS url "
                      f"FROM (SELECT *, unnest(generate_series(1, len(batch_urls))) AS i FROM ({batches()}))")
    items = _norm_col(items, "url", "norm_url")
    seen = _norm_col(f"SELECT job_id, url AS c_url, status, submitted_at, completed_at, parent_batch_id IS NOT NULL AS child FROM ({jobs()})", "c_url", "c_norm")
    return f"""
    WITH items AS ({items}), seen AS ({seen}),
    l AS (SELECT i.batch_id, i.pos, arg_max({{'id': job_id, 'status': status, 'completed_at': completed_at}},
                 {{'t': submitted_at, 'child': child, 'id': job_id}}) AS j
          FROM items i JOIN seen s ON i.norm_url = s.c_norm AND (s.submitted_at < i.started OR s.submitted_at = i.started AND NOT s.child)
          GROUP BY i.batch_id, i.pos),
    a AS (SELECT items.*, l.j, min(items.pos) OVER (PARTITION BY items.batch_id, norm_url) AS first_pos
          FROM items LEFT JOIN l ON l.batch_id = items.batch_id AND l.pos = items.pos),
    act AS (SELECT *, CASE WHEN j IS NOT NULL AND (j.completed_at IS NULL OR j.completed_at > started) THEN 'drop'
                           WHEN j.status = 'done' AND started < j.completed_at + INTERVAL 1 HOUR THEN 'reuse'
                           WHEN pos > first_pos THEN 'drop' ELSE 'spawn' END AS action FROM a)
    SELECT batch_id, pos, url, norm_url, action, CASE WHEN action = 'reuse' THEN j.id END AS reused_job_id FROM act
    """


def batch_expand() -> str:
    return _expand()


def _children() -> str:
    kids = _norm_col(f"SELECT * FROM ({jobs()}) WHERE parent_batch_id IS NOT NULL", "url", "norm_url")
    return (f"SELECT e.batch_id, e.pos, e.url, k.job_id, k.status, k.pages_crawled, k.pages_skipped, k.error, k.completed_at "
            f"FROM ({_expand()}) e JOIN ({kids}) k ON k.parent_batch_id = e.batch_id AND k.norm_url = e.norm_url "
            f"WHERE e.action = 'spawn' QUALIFY row_number() OVER (PARTITION BY e.batch_id, e.pos ORDER BY k.job_id) = 1")


def batch_result_rows() -> str:
    return f"""
    SELECT e.batch_id, e.pos, e.url, r.job_id, 'done' AS status, r.pages_crawled AS page_count, NULL::VARCHAR AS error, true AS finished
    FROM ({_expand()}) e JOIN ({jobs()}) r ON r.job_id = e.reused_job_id
    UNION ALL
    SELECT batch_id, pos, url, job_id, status, CASE WHEN status IN ('error', 'cancelled') THEN NULL ELSE pages_crawled END, error,
           status NOT IN ('pending', 'running') FROM ({_children()})
    """


def _job_documents() -> str:
    """(site, root_url, page_count, llms_txt) of the done jobs, the job id as site."""
    from sitefold.plans import site_oracle as SO

    number, host = "l_linenumber", "lower(regexp_replace(j.url, '^https://|/$', '', 'g'))"
    section = f"CASE WHEN {number} % 3 = 0 THEN 'docs/' WHEN {number} % 3 = 1 THEN 'blog-posts/' ELSE '' END"
    rows = f"""
    SELECT CAST(job_id AS VARCHAR) AS site, CAST({number} AS BIGINT) AS page_ord, NULL::VARCHAR AS h1, CASE WHEN {number} = 1 THEN 0 ELSE 1 END AS depth,
           CASE WHEN {number} = 1 THEN j.url ELSE 'https://' || {host} || '/' || {section} || 'p' || {number} END AS url,
           'Part ' || l_partkey || CASE WHEN {number} % 4 != 0 THEN ' | ' || {host} ELSE '' END AS title,
           CASE WHEN {number} % 5 != 0 THEN 'Line ' || {number} || ' of job ' || job_id END AS description
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag != 'R' GROUP BY ALL)
    JOIN ({jobs()}) j ON l_orderkey = job_id WHERE status = 'done'"""
    meta = S.url_parts(rows, "url", "u")
    meta = (f"SELECT site, page_ord, url, {S.normalized('u')} AS norm_url, {S.path_prefix('u')} AS path_prefix, title, description, h1, depth, "
            f"description IS NOT NULL AS has_description FROM ({meta})")
    return SO._documents(meta, f"SELECT CAST(job_id AS VARCHAR) AS site, url AS root_url FROM ({jobs()}) WHERE status = 'done'")


def batch_result_documents() -> str:
    return (f"SELECT r.*, CASE WHEN status = 'done' THEN llms_txt END AS llms_txt FROM ({batch_result_rows()}) r "
            f"LEFT JOIN ({_job_documents()}) d ON d.site = CAST(r.job_id AS VARCHAR)")


def batch_results() -> str:
    return f"""
    WITH c AS (SELECT batch_id, count(*) FILTER (WHERE finished) AS completed_count, count(*) FILTER (WHERE status = 'done') AS done_count,
                      count(*) FILTER (WHERE NOT finished) AS in_progress_count, count(*) AS result_rows FROM ({batch_result_rows()}) GROUP BY batch_id)
    SELECT b.batch_id, CAST(len(b.batch_urls) AS INTEGER) AS url_count, coalesce(completed_count, 0) AS completed_count,
           coalesce(done_count, 0) AS done_count, coalesce(in_progress_count, 0) AS in_progress_count,
           coalesce(result_rows, 0) AS result_rows
    FROM ({batches()}) b LEFT JOIN c USING (batch_id)
    """


def batch_rollup() -> str:
    return f"""
    WITH a AS (SELECT batch_id, CAST(sum(pages_crawled) AS BIGINT) AS pages_crawled, CAST(sum(pages_skipped) AS BIGINT) AS pages_skipped,
                      count(*) FILTER (WHERE status IN ('pending', 'running')) AS active_children, max(completed_at) AS last_completed,
                      count(*) AS children FROM ({_children()}) GROUP BY batch_id),
    b AS (SELECT b.*, coalesce(a.pages_crawled, 0) AS pc, coalesce(a.pages_skipped, 0) AS ps, coalesce(active_children, 0) AS ac,
                 last_completed, coalesce(children, 0) AS ch FROM ({batches()}) b LEFT JOIN a USING (batch_id))
    SELECT batch_id, CASE WHEN ac > 0 THEN 'running' WHEN cancel_requested THEN 'cancelled' ELSE 'done' END AS status,
           CAST(pc AS BIGINT) AS pages_crawled, CAST(ps AS BIGINT) AS pages_skipped, CAST(ch AS BIGINT) AS children,
           CASE WHEN ac = 0 THEN coalesce({_secs('last_completed', 'submitted_at')}, 0.0) END AS duration_seconds,
           CASE WHEN ac = 0 THEN coalesce(last_completed, submitted_at) END AS completed_at
    FROM b
    """


ORACLE = {
    "seed_list": seed_list,
    "batch_submissions": batch_submissions,
    "submission_expand": submission_expand,
    "request_validation": request_validation,
    "request_dedup": request_dedup,
    "job_states": job_states,
    "job_event_states": job_event_states,
    "job_cancels": job_cancels,
    "job_listing": job_listing,
    "job_listing_done": job_listing_done,
    "job_detail": job_detail,
    "job_lookup": job_lookup,
    "job_metrics": job_metrics,
    "recent_jobs": recent_jobs,
    "batch_expand": batch_expand,
    "batch_results": batch_results,
    "batch_result_rows": batch_result_rows,
    "batch_result_documents": batch_result_documents,
    "batch_rollup": batch_rollup,
}
