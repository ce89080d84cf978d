"""DuckDB oracle SQL for the registered queries.

Each string runs on DuckDB with the driver tables registered as views.
The ``fx_*`` views are the same rules as ``feedloom.sources.tables``,
written independently in SQL; every query is prefixed with the CTEs.
"""

from __future__ import annotations

FX_CTES = r"""
fx_articles AS (
  SELECT doc_id + 1 AS id,
    CASE WHEN doc_id % 7 = 0 THEN text ELSE substr(split_part(text, chr(10), 1), 1, 80) END AS title,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS summary,
    'https://' || source || '.example.com/a/' || doc_id AS link,
    CASE doc_id % 4
      WHEN 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT), '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 1 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT), '%Y-%m-%dT%H:%M:%S') || '-06:00'
      WHEN 2 THEN NULL ELSE CASE WHEN doc_id % 8 = 7 THEN '08:00:00' ELSE 'not a date' END END AS published,
    CAST(NULL AS VARCHAR) AS updated,
    source,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'https://img.example.com/' || doc_id || '.png' END AS og_image,
    TIMESTAMP '2024-01-01' + to_seconds((doc_id // 10)::INT) AS created_at
  FROM documents),
fx_rules AS (
  SELECT id::BIGINT AS id, name, phrase FROM (VALUES
    (1, 'Artificial Intelligence', 'license'), (2, 'Startups', ' and '),
    (3, 'Technology', ' the '), (4, 'Unused', 'no such phrase')) r(id, name, phrase)),
fx_tags AS (SELECT id, name, TIMESTAMP '2024-01-01' AS created_at FROM fx_rules),
fx_article_tags AS (
  SELECT a.id * 16 + r.id AS id, a.id AS article_id, r.id AS tag_id, a.created_at
  FROM fx_articles a JOIN fx_rules r
    ON contains(' ' || regexp_replace(lower(coalesce(a.title, '') || ' ' || coalesce(a.summary, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', r.phrase)),
fx_feed AS (
  SELECT a.*, coalesce((SELECT list(t.name ORDER BY t.name) FROM fx_article_tags x JOIN fx_tags t ON t.id = x.tag_id
                        WHERE x.article_id = a.id), []::VARCHAR[]) AS tags
  FROM fx_articles a),
fx_entries AS (
  SELECT 'https://' || ['arktimes.com', 'www.arkansasbusiness.com', 'talkbusiness.net', 'arkansasadvocate.com', 'www.kark.com', 'www.google.com', 'feed6.example.com'][user_id % 7 + 1] || '/rss' AS feed_url, event_id AS pos,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type || ' ' || user_id END AS title,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'https://news.example.com/' || user_id || '/' || event_type END AS link,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'value ' || CAST(floor(value) AS BIGINT) END AS summary,
    props AS content,
    CASE event_id % 8
      WHEN 0 THEN strftime(ts, '%d %b %Y %H:%M:%S') || ' +0000'
      WHEN 1 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
      WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 4 THEN strftime(ts, '%A, %d %b %y %H:%M:%S') || ' EST'
      WHEN 5 THEN strftime(ts, '%H:%M:%S')
      WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-06:00' ELSE NULL END AS published_raw,
    CAST(NULL AS VARCHAR) AS updated_raw
  FROM events),
fx_pages AS (
  SELECT page_id, url, replace(html, '<meta charset="utf-8">', '<meta charset="utf-8">' || CASE page_id % 7
    WHEN 0 THEN '<meta property="og:image" content="https://img.example.com/' || page_id || '.png">'
    WHEN 1 THEN '<meta content="/img/' || page_id || '.png" property="og:image">'
    WHEN 2 THEN '<meta property="og:image" content="//cdn.example.com/' || page_id || '.png">'
    WHEN 3 THEN '<meta property="og:image" content=""><meta name="twitter:image" content="t' || page_id || '.png">'
    WHEN 4 THEN '<meta property="article:image" content="https://a.example.com/' || page_id || '.png">'
    WHEN 6 THEN '<meta data-x="a>b" property="og:image" content="/a&#038;b' || page_id || '.png?x=1&gt;2">'
    WHEN 5 THEN '<!-- <meta property="og:image" content="/commented.png"> -->' ELSE '' END) AS html
  FROM pages),
fx_vectors AS (SELECT vec_id + 1 AS article_id, embedding FROM embeddings)
"""


def with_fx(body: str, extra_ctes: str = "") -> str:
    ctes = FX_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    kw = "WITH RECURSIVE" if "UNION ALL\n  SELECT w.rn + 1" in ctes else "WITH"
    return f"{kw} {ctes}\n{body}"


def iso_ts(col: str) -> str:
    """DuckDB twin of F5 (ISO text to UTC instant, naive)."""
    return f"(CASE WHEN {col} LIKE '____-%' THEN try_cast({col} AS TIMESTAMPTZ) END AT TIME ZONE 'UTC')"


FEED_COLS = "id, title, summary, link, published, updated, source, og_image"

SQL: dict[str, str] = {}

SQL["A1_tag_counts"] = with_fx("""
SELECT t.name AS name, count(x.article_id) AS article_count
FROM fx_tags t LEFT JOIN fx_article_tags x ON t.id = x.tag_id
GROUP BY t.id, t.name ORDER BY article_count DESC, t.name""")

SQL["A2_popular_tags"] = with_fx("""
SELECT t.name AS name, count(x.article_id) AS article_count
FROM fx_tags t JOIN fx_article_tags x ON t.id = x.tag_id
GROUP BY t.id, t.name ORDER BY article_count DESC, t.name LIMIT 10""")

SQL["A3_table_counts"] = with_fx("""
SELECT 'articles' AS table_name, count(*) AS n_rows FROM fx_articles
UNION ALL SELECT 'tags', count(*) FROM fx_tags
UNION ALL SELECT 'article_tags', count(*) FROM fx_article_tags
UNION ALL SELECT 'article_embeddings', count(*) FROM fx_vectors""")

SQL["A3_health"] = with_fx("""
SELECT 'healthy' AS status, count(*) AS article_count FROM fx_articles""")

SQL["A4_feed_tag_counts"] = with_fx("""
SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM fx_feed) GROUP BY tag""")

SQL["A5_tags_per_article"] = with_fx("SELECT id, tags FROM fx_feed")

SQL["A7_distinct_tag_ids"] = with_fx("SELECT DISTINCT tag_id FROM fx_article_tags")

SQL["J1_articles_by_tag"] = with_fx("""
SELECT a.id, a.title, a.summary, a.link, a.published, a.updated, a.created_at
FROM fx_articles a JOIN fx_article_tags x ON a.id = x.article_id JOIN fx_tags t ON x.tag_id = t.id
WHERE t.name = 'Technology' ORDER BY a.created_at DESC, a.id""")

SQL["P7_any_of_tags"] = with_fx(f"""
SELECT {FEED_COLS} FROM fx_articles a
WHERE a.id IN (SELECT x.article_id FROM fx_article_tags x JOIN fx_tags t ON x.tag_id = t.id
               WHERE t.name IN ('Startups', 'Artificial Intelligence'))""")

SQL["P8_feed_contains_tag"] = with_fx("""
SELECT id, link, tags FROM fx_feed WHERE list_contains(tags, 'Artificial Intelligence')""")

_PAGE = """
SELECT id, title, summary, link, {pub} AS published, {upd} AS updated, source, og_image, created_at, tags
FROM (SELECT * FROM fx_feed {where} ORDER BY created_at DESC, id LIMIT {limit} OFFSET {offset})
ORDER BY created_at DESC, id"""

SQL["O2_feed_page"] = with_fx(_PAGE.format(pub=iso_ts("published"), upd=iso_ts("updated"),
                                           where="", limit=50, offset=100))

SQL["J5_feed_page_by_tag"] = with_fx(_PAGE.format(
    pub=iso_ts("published"), upd=iso_ts("updated"),
    where="WHERE list_contains(tags, 'Startups')", limit=500, offset=20))

SQL["O8_page_walk"] = with_fx(f"""
SELECT {FEED_COLS}, created_at, n > 10 AS has_more FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS r, count(*) OVER () AS n
  FROM (SELECT * FROM fx_feed WHERE list_contains(tags, 'Artificial Intelligence')
        ORDER BY created_at DESC, id LIMIT 11 OFFSET 30))
WHERE r <= 10""")

SQL["S12_feed_document"] = with_fx("""
SELECT count(*) AS n_articles,
  to_json({'articles': list({'title': title, 'summary': summary, 'link': link,
      'published': strftime(""" + iso_ts("published") + """, '%Y-%m-%dT%H:%M:%S+00:00'),
      'updated': strftime(""" + iso_ts("updated") + """, '%Y-%m-%dT%H:%M:%S+00:00'),
      'source': source, 'og_image': og_image, 'tags': tags} ORDER BY created_at DESC, id)})::VARCHAR AS document
FROM (SELECT * FROM fx_feed WHERE list_contains(tags, 'Technology') ORDER BY created_at DESC, id LIMIT 10)""")

SQL["P17_card_projection"] = with_fx("""
SELECT id, title, summary, link, source, tags,
  coalesce(og_image, '/static/placeholder.svg') AS image,
  coalesce(strftime(""" + iso_ts("published") + """, '%-m/%-d/%Y'), 'Unknown date') AS published_display
FROM fx_feed""")

SQL["P18_title_preview"] = with_fx("""
SELECT id, substr(title, 1, 60) AS title_60, substr(title, 1, 50) AS title_50 FROM fx_articles""")

_TOP = """(SELECT t.id, t.name FROM fx_tags t JOIN fx_article_tags x ON t.id = x.tag_id
           GROUP BY t.id, t.name ORDER BY count(*) DESC, t.name LIMIT 1)"""

SQL["O7_top_tag_sample"] = with_fx(f"""
SELECT tt.name AS top_tag, a.id, substr(a.title, 1, 60) AS title_preview, a.created_at
FROM fx_articles a JOIN fx_article_tags x ON a.id = x.article_id JOIN {_TOP} tt ON tt.id = x.tag_id
ORDER BY a.created_at DESC, a.id LIMIT 3""")

SQL["R1_run_report"] = with_fx(f"""
SELECT 'unique_tags' AS item, CAST(NULL AS VARCHAR) AS label, count(*) AS value, 0 AS rank FROM fx_tags
UNION ALL
SELECT 'top_tag', name, article_count, row_number() OVER (ORDER BY article_count DESC, name) FROM (
  SELECT t.name, count(*) AS article_count FROM fx_tags t JOIN fx_article_tags x ON t.id = x.tag_id
  GROUP BY t.id, t.name ORDER BY article_count DESC, t.name LIMIT 5)
UNION ALL
SELECT 'sample_title', title_preview, id, row_number() OVER (ORDER BY created_at DESC, id) FROM (
  SELECT a.id, substr(a.title, 1, 60) AS title_preview, a.created_at
  FROM fx_articles a JOIN fx_article_tags x ON a.id = x.article_id JOIN {_TOP} tt ON tt.id = x.tag_id
  ORDER BY a.created_at DESC, a.id LIMIT 3)""")

# ------------------------------------------------------------------ scan and clean

_P1 = """SELECT feed_url, pos, coalesce(title, 'Untitled') AS title, coalesce(link, '') AS link,
  coalesce(summary, '') AS summary, content, published_raw, updated_raw FROM fx_entries"""
_P3 = f"""SELECT *, CASE WHEN summary = '' THEN coalesce(content, '') ELSE summary END AS summary2
  FROM ({_P1}) WHERE link <> ''"""
_STORE = """store_links AS (SELECT link FROM fx_entries
  WHERE pos < (SELECT max(pos) / 4 FROM fx_entries) AND link IS NOT NULL)"""


def _feed_iso(col: str) -> str:
    """Expected text of each fixture style, written out: offsets stay as given."""
    rfc = lambda fmt, tail: f"strftime(strptime(regexp_replace({col}, ' [^ ]+$', ''), '{fmt}'), '%Y-%m-%dT%H:%M:%S') || '{tail}'"
    return (f"CASE WHEN regexp_matches({col}, '^[0-9:]+$') THEN NULL"
            f" WHEN {col} LIKE '%Z' THEN replace({col}, 'Z', '+00:00')"
            f" WHEN {col} LIKE '____-__-__T%' THEN {col}"
            f" WHEN {col} LIKE '% +0000' THEN {rfc('%d %b %Y %H:%M:%S', '+00:00')}"
            f" WHEN {col} LIKE '% GMT' THEN {rfc('%a, %d %b %Y %H:%M:%S', '+00:00')}"
            f" WHEN {col} LIKE '% EST' THEN {rfc('%A, %d %b %y %H:%M:%S', '-05:00')} END")


def _source(col: str) -> str:
    dom = f"lower(coalesce(regexp_extract({col}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''))"
    return (f"coalesce(CASE {dom} WHEN 'arktimes.com' THEN 'Arkansas Times' "
            f"WHEN 'www.arkansasbusiness.com' THEN 'Arkansas Business' "
            f"WHEN 'talkbusiness.net' THEN 'Talk Business & Politics' "
            f"WHEN 'arkansasadvocate.com' THEN 'Arkansas Advocate' WHEN 'www.kark.com' THEN 'KARK 4 News' "
            f"WHEN 'www.google.com' THEN 'Google News Alert' END, {dom})")


SQL["P1_defaulted_entries"] = with_fx(f"SELECT pos, title, link, summary FROM ({_P1})")
SQL["P2_entries_with_link"] = with_fx(f"SELECT pos, link FROM ({_P1}) WHERE link <> ''")
SQL["P3_summary_fallback"] = with_fx(f"SELECT pos, summary2 AS summary FROM ({_P3})")
SQL["F4_feed_dates"] = with_fx(f"SELECT pos, published_raw, {_feed_iso('published_raw')} AS published FROM fx_entries")
SQL["F5_parse_iso"] = with_fx(f"SELECT id, published, {iso_ts('published')} AS published_ts FROM fx_articles")
SQL["F7_url_authority"] = with_fx(
    "SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')) AS authority FROM pages")
SQL["P4_source_names"] = with_fx(
    f"SELECT feed_url, {_source('feed_url')} AS source, count(*) AS entries FROM fx_entries GROUP BY feed_url")
SQL["J4_new_links"] = with_fx(f"""
SELECT pos, link, title, summary2 AS summary, {_feed_iso('published_raw')} AS published, {_source('feed_url')} AS source
FROM ({_P3}) e WHERE link NOT IN (SELECT link FROM store_links)""", _STORE)
SQL["A12_ingest_stats"] = with_fx(f"""
SELECT feed_url, count(*) AS entries,
  count(*) FILTER (WHERE link = '') AS skipped_no_link,
  count(*) FILTER (WHERE link <> '' AND link IN (SELECT link FROM store_links)) AS skipped_stored,
  count(*) FILTER (WHERE link <> '' AND link NOT IN (SELECT link FROM store_links)) AS new_entries,
  count(*) FILTER (WHERE link <> '' AND link NOT IN (SELECT link FROM store_links) AND link LIKE '%/c%') AS images_found
FROM ({_P1}) GROUP BY feed_url""", _STORE)
SQL["S1_feed_scan"] = with_fx(f"SELECT pos, title, link, summary2 AS summary, published_raw FROM ({_P3})")
_LANDED = "coalesce(title, '') AS title, coalesce(link, '') AS link, coalesce(summary, '') AS summary"
SQL["U1_feed_union"] = with_fx("""
SELECT feed_url, count(*) AS entries, count(DISTINCT link) AS links FROM (
  SELECT 'https://even.example.com/rss' AS feed_url, coalesce(link, '') AS link FROM fx_entries WHERE pos % 2 = 0
  UNION ALL SELECT 'https://other.example.com/rss', coalesce(link, '') FROM fx_entries WHERE pos % 2 = 1 OR pos % 3 = 0) GROUP BY feed_url""")
SQL["S1_rss_files"] = with_fx(f"""
SELECT feed_url, row_number() OVER (ORDER BY o, pos) AS pos, {_LANDED} FROM (
  SELECT *, CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END AS o FROM (SELECT * REPLACE (
    CASE WHEN pos % 4 = 0 THEN 'https://small.example.com/rss' ELSE 'https://large.example.com/rss' END AS feed_url) FROM fx_entries))""")
SQL["S1_atom_files"] = with_fx(f"""
SELECT row_number() OVER (ORDER BY pos) AS pos, {_LANDED} FROM fx_entries""")
SQL["S2_feed_list"] = with_fx(f"""
SELECT feed_url, {_source('feed_url')} AS source, count(*) AS entries FROM fx_entries GROUP BY feed_url""")

# ------------------------------------------------------------------ images and HTML

_CLEAN = """regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"""


def _attr(t: str, name: str) -> str:
    return (f"(regexp_extract({t}, '(?is)\\s{name}\\s*=\\s*\"([^\"]*)\"', 1) || "
            f"regexp_extract({t}, '(?is)\\s{name}\\s*=\\s*''([^'']*)''', 1) || "
            f"regexp_extract({t}, '(?is)\\s{name}\\s*=\\s*([^\\s\"''>]+)', 1))")


def _unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&#038;", "&"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _first(kind_attr: str, value: str) -> str:
    first = f"list_filter(metas, lambda t: {_attr('t', kind_attr)} = '{value}')[1]"
    content = f"regexp_replace({_unescape(_attr(first, 'content'))}, '^\\s+|\\s+$', '', 'g')"
    return f"nullif({content}, '')"


_REF = f"""(SELECT page_id, url, coalesce({_first('property', 'og:image')}, {_first('name', 'twitter:image')},
      {_first('property', 'article:image')}) AS ref
  FROM (SELECT page_id, url, regexp_extract_all({_CLEAN}, '(?is)<meta\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS metas FROM fx_pages))"""

_RESOLVED = """CASE WHEN ref IS NULL THEN NULL
  WHEN starts_with(ref, 'http://') OR starts_with(ref, 'https://') THEN ref
  WHEN starts_with(ref, '//') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || ':' || ref
  WHEN starts_with(ref, '/') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://'
       || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || ref
  ELSE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://'
       || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)
       || coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/')
       || ref END"""

_BLOCKED = "contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'example.net')"

SQL["F9_preview_image_ref"] = with_fx(f"SELECT page_id, ref AS image_ref FROM {_REF}")
SQL["F8_resolve_image"] = with_fx(f"SELECT page_id, url, {_RESOLVED} AS og_image FROM {_REF}")
SQL["P9_blocked_pages"] = with_fx(f"SELECT page_id, {_BLOCKED} AS blocked FROM fx_pages")
_X4 = f"""(SELECT url, max(CASE WHEN {_BLOCKED} OR trim(url) = '' THEN NULL ELSE {_RESOLVED} END) AS og_image
  FROM {_REF} GROUP BY url)"""
SQL["X4_page_images"] = with_fx(f"SELECT url, og_image FROM {_X4}")
_GROWN = """EXISTS (SELECT 1 FROM grown g WHERE contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), g.domain))"""
_GROWN_CTE = """grown AS (SELECT DISTINCT domain FROM (
  SELECT 'example.net' AS domain
  UNION ALL SELECT lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''))
  FROM pages WHERE page_id % 9 = 0) WHERE domain <> '')"""
SQL["X4_grown_blocklist"] = with_fx(f"""
SELECT url, max(CASE WHEN bad OR trim(url) = '' THEN NULL ELSE {_RESOLVED} END) AS og_image
FROM (SELECT *, {_GROWN} AS bad FROM {_REF}) GROUP BY url""", _GROWN_CTE)
SQL["P11_blank_urls"] = with_fx(f"""
SELECT url, max(CASE WHEN {_BLOCKED} OR trim(url) = '' THEN NULL ELSE {_RESOLVED} END) AS og_image
FROM (SELECT * REPLACE (CASE page_id % 10 WHEN 0 THEN '' WHEN 5 THEN '  ' ELSE url END AS url) FROM {_REF}) GROUP BY url""")
SQL["J6_attach_images"] = with_fx(f"""
SELECT a.id, coalesce(p.url, a.link) AS link, x.og_image
FROM fx_articles a LEFT JOIN pages p ON p.page_id + 1 = a.id LEFT JOIN {_X4} x ON x.url = coalesce(p.url, a.link)""")
_NO_TAGS = "regexp_replace(" + _CLEAN + """, '(?s)<(?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[^>]*>', ' ', 'g')"""
SQL["F10_clean_html"] = with_fx(f"""
SELECT page_id, regexp_replace(regexp_replace({_unescape(_NO_TAGS)},
  '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""")

# ------------------------------------------------------------------ similarity and dedup

def _knn_ctes(vectors: str, thr: float, k: int = 20) -> str:
    return f"""
dists AS (SELECT a.article_id AS x, b.article_id AS y,
            list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
          FROM {vectors} a, {vectors} b),
knn AS (SELECT x, y, greatest(0, 1 - d * d / 2) AS sim,
          row_number() OVER (PARTITION BY x ORDER BY d, y) AS r FROM dists),
nb AS (SELECT x, y, sim FROM knn WHERE r <= {k} AND sim >= {thr} AND x <> y)"""


def _d3_ctes(vectors: str) -> str:
    return f"""
nl AS MATERIALIZED (SELECT v.article_id AS id, row_number() OVER (ORDER BY v.article_id) AS rn,
         coalesce((SELECT list(y) FROM nb WHERE nb.x = v.article_id), []::BIGINT[]) AS ns FROM {vectors} v),
walk(rn, processed, seeds) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT w.rn + 1,
    CASE WHEN list_contains(w.processed, n.id) OR len(n.ns) = 0 THEN w.processed
         ELSE list_distinct(list_concat(w.processed, list_append(n.ns, n.id))) END,
    CASE WHEN list_contains(w.processed, n.id) OR len(n.ns) = 0 THEN w.seeds
         ELSE list_append(w.seeds, n.id) END
  FROM walk w JOIN nl n ON n.rn = w.rn + 1),
seeds AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM walk ORDER BY rn DESC LIMIT 1)),
mem AS (SELECT s.seed, nb.y AS m FROM seeds s JOIN nb ON nb.x = s.seed UNION ALL SELECT seed, seed FROM seeds),
kp AS (SELECT seed, min(m) AS keep_id FROM mem GROUP BY seed),
gpairs AS (SELECT DISTINCT kp.keep_id, mem.m AS member_id FROM mem JOIN kp USING (seed) WHERE mem.m <> kp.keep_id),
gpos AS (SELECT keep_id, min(seed) AS group_pos FROM kp GROUP BY keep_id),
groups AS (SELECT g.keep_id, g.member_id, p.group_pos FROM gpairs g JOIN gpos p USING (keep_id))"""


_D4_CTES = """
gl AS MATERIALIZED (SELECT keep_id, group_pos, list(member_id) AS ms, row_number() OVER (ORDER BY group_pos) AS rn
       FROM groups GROUP BY keep_id, group_pos),
walk2(rn, removed, applied) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT w.rn + 1,
    CASE WHEN list_contains(w.removed, g.keep_id) THEN w.removed ELSE list_distinct(list_concat(w.removed, g.ms)) END,
    CASE WHEN list_contains(w.removed, g.keep_id) THEN w.applied ELSE list_append(w.applied, g.keep_id) END
  FROM walk2 w JOIN gl g ON g.rn = w.rn + 1),
final AS (SELECT removed, applied FROM walk2 ORDER BY rn DESC LIMIT 1),
resolution AS (SELECT gl.keep_id, gl.group_pos, list_contains((SELECT applied FROM final), gl.keep_id) AS applied FROM gl),
removed_ids AS (SELECT DISTINCT unnest(removed) AS id FROM final)"""


def _d2_ctes(batch: str, thr: float, stored: str | None, sfx: str = "") -> str:
    """First-wins walk over ``batch`` in id order; CTE names carry ``sfx`` so
    that one statement can hold several walks."""
    store_part = ""
    if stored:
        store_part = f""",
shit{sfx} AS (SELECT x, y AS duplicate_id, d FROM (
  SELECT b.article_id AS x, s.article_id AS y,
    list_distance(b.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY b.article_id ORDER BY list_distance(b.embedding::DOUBLE[], s.embedding::DOUBLE[]), s.article_id) AS r
  FROM {batch} b, {stored} s) WHERE r = 1 AND greatest(0, 1 - d * d / 2) >= {thr})"""
    store_match = f"UNION ALL SELECT x, duplicate_id, d, 'store' FROM shit{sfx}" if stored else ""
    not_store = f"WHERE v.article_id NOT IN (SELECT x FROM shit{sfx})" if stored else ""
    return f"""
bpairs{sfx} AS MATERIALIZED (SELECT a.article_id AS a, b.article_id AS b,
    list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM {batch} a JOIN {batch} b ON a.article_id < b.article_id
  WHERE greatest(0, 1 - pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) / 2) >= {thr}){store_part},
bnodes{sfx} AS MATERIALIZED (SELECT v.article_id AS id, row_number() OVER (ORDER BY v.article_id) AS rn,
   coalesce((SELECT list(p.a) FROM bpairs{sfx} p WHERE p.b = v.article_id), []::BIGINT[]) AS preds
   FROM {batch} v {not_store}),
walk3{sfx}(rn, acc) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT w.rn + 1, CASE WHEN len(list_intersect(w.acc, n.preds)) > 0 THEN w.acc ELSE list_append(w.acc, n.id) END
  FROM walk3{sfx} w JOIN bnodes{sfx} n ON n.rn = w.rn + 1),
accepted{sfx} AS (SELECT unnest(acc) AS id FROM (SELECT acc FROM walk3{sfx} ORDER BY rn DESC LIMIT 1)),
matched{sfx} AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(d, 9), y) AS r FROM (
    SELECT p.b AS x, p.a AS y, p.d, 'batch' AS reason FROM bpairs{sfx} p JOIN accepted{sfx} k ON k.id = p.a
    {store_match}) m WHERE x NOT IN (SELECT id FROM accepted{sfx})) WHERE r = 1)"""


SQL["J8_knn_similarity"] = with_fx("""
SELECT x AS article_id, y AS neighbour_id, round(sim, 6) AS similarity FROM knn WHERE r <= 20 AND sim >= 0.3""",
                                   _knn_ctes("fx_vectors", 0.3).strip().rstrip(",") )

SQL["J9_nearest_stored"] = with_fx("""
SELECT x AS article_id, y AS duplicate_id, round(greatest(0, 1 - d * d / 2), 6) AS similarity FROM (
  SELECT b.article_id AS x, s.article_id AS y, list_distance(b.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY b.article_id ORDER BY list_distance(b.embedding::DOUBLE[], s.embedding::DOUBLE[]), s.article_id) AS r
  FROM fx_vectors b, fx_vectors s
  WHERE b.article_id > (SELECT max(article_id) / 2 FROM fx_vectors) AND s.article_id <= (SELECT max(article_id) / 2 FROM fx_vectors))
WHERE r = 1 AND greatest(0, 1 - d * d / 2) >= 0.3""")

SQL["D2_ingest_dedup"] = with_fx("""
SELECT v.article_id, m.x IS NULL AS accepted, m.reason, m.y AS duplicate_id,
  CASE WHEN m.x IS NOT NULL THEN round(greatest(0, 1 - m.d * m.d / 2), 6) END AS similarity
FROM fx_vectors v LEFT JOIN matched m ON m.x = v.article_id""", _d2_ctes("fx_vectors", 0.3, None))

SQL["D2_ingest_dedup_with_store"] = with_fx("""
SELECT v.article_id, m.x IS NULL AS accepted, m.reason, m.y AS duplicate_id,
  CASE WHEN m.x IS NOT NULL THEN round(greatest(0, 1 - m.d * m.d / 2), 6) END AS similarity
FROM d2batch v LEFT JOIN matched m ON m.x = v.article_id""", """
d2batch AS (SELECT * FROM fx_vectors WHERE article_id > (SELECT max(article_id) / 5 FROM fx_vectors)),
d2store AS (SELECT * FROM fx_vectors WHERE article_id <= (SELECT max(article_id) / 5 FROM fx_vectors)),""" +
    _d2_ctes("d2batch", 0.3, "d2store"))

SQL["D3_duplicate_groups"] = with_fx("SELECT keep_id, member_id, group_pos FROM groups",
                                     _knn_ctes("fx_vectors", 0.3) + "," + _d3_ctes("fx_vectors"))

SQL["D4_group_resolution"] = with_fx("SELECT keep_id, group_pos, applied FROM resolution",
                                     _knn_ctes("fx_vectors", 0.3) + "," + _d3_ctes("fx_vectors") + "," + _D4_CTES)

SQL["D4_removed_articles"] = with_fx("SELECT id FROM removed_ids",
                                     _knn_ctes("fx_vectors", 0.3) + "," + _d3_ctes("fx_vectors") + "," + _D4_CTES)

SQL["A14_dedup_summary"] = with_fx("""
SELECT 'original_articles' AS metric, count(*) AS value FROM fx_articles
UNION ALL SELECT 'with_embedding', count(embedding) FROM av
UNION ALL SELECT 'claimed_duplicates', count(*) FROM groups
UNION ALL SELECT 'groups', count(*) FROM resolution
UNION ALL SELECT 'skipped_groups', count(*) FILTER (WHERE NOT applied) FROM resolution
UNION ALL SELECT 'removed', count(*) FROM removed_ids
UNION ALL SELECT 'final_articles', count(*) FROM fx_articles WHERE id NOT IN (SELECT id FROM removed_ids)
UNION ALL SELECT 'embeddings_stored', count(*) FROM av WHERE embedding IS NOT NULL AND article_id NOT IN (SELECT id FROM removed_ids)""",
    "av AS (SELECT * FROM fx_vectors WHERE article_id IN (SELECT id FROM fx_articles))," +
    _knn_ctes("av", 0.3) + "," + _d3_ctes("av") + "," + _D4_CTES)

_EMBED_TEXT = "substr(title || ' ' || coalesce(summary, ''), 1, 8000)"

SQL["F1_embed_text"] = with_fx(f"""
SELECT id, length({_EMBED_TEXT}) AS n_chars, substr({_EMBED_TEXT}, 1, 100) AS head, md5({_EMBED_TEXT}) AS text_md5
FROM fx_articles""")

_SPARSE = f"""
etxt AS (SELECT id, title || ' ' || coalesce(summary, '') AS t FROM fx_articles
         WHERE regexp_replace(title || ' ' || coalesce(summary, ''), '^\\s+|\\s+$', '', 'g') <> ''),
ewords AS (SELECT id, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM etxt),
esh AS (SELECT id, CASE WHEN len(ws) = 1 THEN ws
          ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END AS s FROM ewords),
ecnt AS (SELECT id, (('0x' || substr(md5(sh), 1, 8))::BIGINT) % 1536 AS bucket,
           CAST(sum(CASE WHEN substr(md5(sh), 9, 1) < '8' THEN 1 ELSE -1 END) AS BIGINT) AS c
         FROM (SELECT id, unnest(s) AS sh FROM esh) GROUP BY ALL HAVING c <> 0),
sparse AS (SELECT id AS article_id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS weight FROM ecnt)"""

SQL["X3_embed_sparse"] = with_fx(
    "SELECT article_id, bucket, round(weight::FLOAT::DOUBLE, 6) AS weight FROM sparse", _SPARSE)

_TEXT_VECTORS = _SPARSE + """,
tvec AS (SELECT article_id, list_transform(range(0, 1536),
           lambda i: coalesce(list_extract(map_extract(m, i), 1), 0.0)::FLOAT) AS embedding
         FROM (SELECT article_id, map(list(bucket), list(weight)) AS m FROM sparse GROUP BY article_id))"""

SQL["D3_text_duplicate_groups"] = with_fx("SELECT keep_id, member_id, group_pos FROM groups",
                                          _TEXT_VECTORS + "," + _knn_ctes("tvec", 0.7) + "," + _d3_ctes("tvec"))

# ------------------------------------------------------------------ write path

_WRITE = """
wstore AS (SELECT * FROM fx_articles WHERE id <= (SELECT max(id) / 2 FROM fx_articles)),
wnewer AS (SELECT * FROM fx_articles WHERE id > (SELECT max(id) / 2 FROM fx_articles)),
wbatch0 AS (
  SELECT id AS pos, title, summary, link FROM wnewer
  UNION ALL SELECT 1000000 + id, 'changed ' || title, summary, link FROM wstore WHERE id % 10 = 0
  UNION ALL SELECT 2000000 + id, 'again ' || title, summary, link FROM wnewer WHERE id % 50 = 1),
wbatch AS (
  SELECT w.*, list_concat(
      coalesce((SELECT list(r.name ORDER BY r.id) FROM fx_rules r
                WHERE contains(' ' || regexp_replace(lower(coalesce(w.title, '') || ' ' || coalesce(w.summary, '')), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', r.phrase)),
               []::VARCHAR[]),
      CASE WHEN w.pos % 3 = 0 THEN [' New Tag ', ''] ELSE []::VARCHAR[] END) AS tags
  FROM wbatch0 w),
wnum AS (SELECT *, (SELECT max(id) FROM wstore) + row_number() OVER (ORDER BY pos) AS new_id FROM wbatch),
wlast AS (SELECT link, max(pos) AS pos FROM wnum GROUP BY link),
wlatest AS (SELECT n.* FROM wnum n JOIN wlast l ON n.link = l.link AND n.pos = l.pos),
new_articles AS (
  SELECT id, link, title, created_at FROM wstore WHERE link NOT IN (SELECT link FROM wbatch)
  UNION ALL SELECT new_id, link, title, TIMESTAMP '2024-02-01 00:00:00' FROM wlatest),
wraw AS (SELECT new_id AS article_id, pos, trim(unnest(tags)) AS name, generate_subscripts(tags, 1) AS i FROM wnum),
wfirst AS (SELECT article_id, pos, name, min(i) AS i FROM wraw WHERE name <> '' GROUP BY ALL),
wnames AS (SELECT article_id, pos, name, row_number() OVER (PARTITION BY article_id ORDER BY i) - 1 AS tag_idx FROM wfirst),
wnewtags AS (SELECT name, min({'p': pos, 'i': tag_idx}) AS f FROM wnames WHERE name NOT IN (SELECT name FROM fx_tags) GROUP BY name),
new_tags AS (
  SELECT id, name FROM fx_tags
  UNION ALL SELECT (SELECT max(id) FROM fx_tags) + row_number() OVER (ORDER BY f.p, f.i), name FROM wnewtags),
wbridge0 AS (SELECT * FROM fx_article_tags WHERE article_id IN (SELECT id FROM wstore)),
wpairs AS (
  SELECT n.article_id, t.id AS tag_id, min(n.tag_idx) AS i FROM wnames n JOIN new_tags t ON t.name = n.name
  WHERE n.article_id IN (SELECT id FROM new_articles) GROUP BY ALL),
new_bridge AS (
  SELECT id, article_id, tag_id FROM wbridge0 WHERE article_id IN (SELECT id FROM new_articles)
  UNION ALL SELECT (SELECT max(id) FROM wbridge0) + row_number() OVER (ORDER BY article_id, i), article_id, tag_id FROM wpairs)"""

SQL["M1_upsert_articles"] = with_fx("SELECT id, link, title, created_at FROM new_articles", _WRITE)
SQL["M2_get_or_create_tags"] = with_fx("SELECT id, name FROM new_tags", _WRITE)
SQL["M3_replace_tag_sets"] = with_fx("SELECT id, article_id, tag_id FROM new_bridge", _WRITE)
SQL["M8_untagged_articles_kept"] = with_fx(
    "SELECT id FROM new_articles WHERE id NOT IN (SELECT article_id FROM new_bridge)", _WRITE)

SQL["J11_orphan_bridge_rows"] = with_fx("""
SELECT article_id, tag_id FROM fx_article_tags
WHERE article_id NOT IN (SELECT id FROM fx_articles WHERE id % 9 <> 0)""")

SQL["J12_unused_tags"] = with_fx("""
SELECT id, name FROM fx_tags WHERE id NOT IN (SELECT DISTINCT tag_id FROM fx_article_tags WHERE tag_id <> 1)""")

SQL["M6_clean_up"] = with_fx("""
SELECT t.id, t.name, count(b.article_id) AS n_rows FROM fx_tags t
JOIN (SELECT * FROM fx_article_tags WHERE tag_id <> 3
      AND article_id IN (SELECT id FROM fx_articles WHERE id % 9 <> 0)) b ON b.tag_id = t.id
GROUP BY t.id, t.name""")

SQL["S8_constraint_violations"] = with_fx("""
SELECT 'articles.title NOT NULL' AS constraint_name, '1' AS key
UNION ALL SELECT 'articles.link UNIQUE', 'https://dup.example.com/x'
UNION ALL SELECT 'article_tags (article_id, tag_id) UNIQUE', article_id || ',' || tag_id
  FROM (SELECT * FROM fx_article_tags ORDER BY id LIMIT 1)
UNION ALL SELECT 'article_tags.article_id FOREIGN KEY', CAST(article_id + 10000000 AS VARCHAR)
  FROM (SELECT * FROM fx_article_tags ORDER BY id LIMIT 1)""")

SQL["S8_constraints_clean_store"] = with_fx(
    "SELECT 'none' AS constraint_name, 'none' AS key WHERE false", _WRITE)

SQL["S3_article_scan"] = with_fx("SELECT id, title, summary, link, published FROM fx_articles ORDER BY id")

SQL["S5_embedding_upsert"] = with_fx("""
SELECT article_id, round(embedding[1]::DOUBLE, 6) AS e1, len(embedding) AS dim FROM fx_vectors
WHERE article_id <= (SELECT 2 * max(article_id) // 5 FROM fx_vectors)
UNION ALL SELECT article_id + (SELECT 2 * max(article_id) // 5 FROM fx_vectors), round(embedding[1]::DOUBLE, 6), len(embedding)
FROM fx_vectors""")

SQL["S6_embedding_lookup"] = with_fx("""
SELECT v.article_id, len(v.embedding) AS dim FROM fx_vectors v
WHERE v.article_id IN (SELECT x.article_id FROM fx_article_tags x JOIN fx_tags t ON t.id = x.tag_id
                       WHERE t.name = 'Artificial Intelligence')""")

SQL["S7_embedding_delete"] = with_fx("SELECT article_id FROM fx_vectors WHERE article_id NOT IN (SELECT id FROM removed_ids)",
                                     _knn_ctes("fx_vectors", 0.3) + "," + _d3_ctes("fx_vectors") + "," + _D4_CTES)

SQL["A13_embedding_coverage"] = with_fx("""
SELECT count(*) FILTER (WHERE article_id % 17 <> 0) AS with_embedding, count(*) AS total FROM fx_vectors""")

SQL["M7_quarantine"] = with_fx("""
SELECT pos, CASE WHEN title IS NULL THEN 'null title' ELSE 'missing link' END AS reason
FROM fx_entries WHERE title IS NULL OR link IS NULL OR link = ''""")

# ------------------------------------------------------------------ composed jobs

_R2 = _TEXT_VECTORS + """,
r2tagged AS (
  SELECT a.id, a.title, a.link, lower(a.source) || '.example.com' AS source,
    (SELECT list(DISTINCT r.name) FROM fx_rules r
     WHERE contains(' ' || regexp_replace(lower(coalesce(a.title, '') || ' ' || coalesce(a.summary, '')), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', r.phrase)) AS names
  FROM fx_articles a
  WHERE EXISTS (SELECT 1 FROM fx_rules r
                WHERE contains(' ' || regexp_replace(lower(coalesce(a.title, '') || ' ' || coalesce(a.summary, '')), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', r.phrase))),
r2vec AS (SELECT * FROM tvec WHERE article_id IN (SELECT id FROM r2tagged)),""" + _d2_ctes("r2vec", 0.7, None) + """,
r2acc AS (SELECT id FROM accepted UNION SELECT id FROM r2tagged WHERE id NOT IN (SELECT article_id FROM tvec))"""

SQL["R2_ingest_single_run"] = with_fx("""
SELECT row_number() OVER (ORDER BY id) AS id, link, title, source FROM r2tagged WHERE id IN (SELECT id FROM r2acc)""",
                                      _R2)

SQL["A11_load_stats"] = with_fx("""
SELECT 'batch_articles' AS metric, count(*) AS value FROM r2tagged
UNION ALL SELECT 'loaded', count(*) FROM r2acc
UNION ALL SELECT 'duplicates_skipped', (SELECT count(*) FROM r2tagged) - (SELECT count(*) FROM r2acc)
UNION ALL SELECT 'images_found', 0
UNION ALL SELECT 'total_articles', count(*) FROM r2acc
UNION ALL SELECT 'total_tags', count(DISTINCT n) FROM (SELECT unnest(names) AS n FROM r2tagged WHERE id IN (SELECT id FROM r2acc))
UNION ALL SELECT 'total_embeddings', count(*) FROM r2vec WHERE article_id IN (SELECT id FROM r2acc)""", _R2)

_D5 = _TEXT_VECTORS + "," + _knn_ctes("tvec", 0.7) + "," + _d3_ctes("tvec") + "," + _D4_CTES

SQL["D5_dedup_job"] = with_fx("""
SELECT 'original_articles' AS metric, count(*) AS value FROM fx_articles
UNION ALL SELECT 'with_embedding', count(*) FROM tvec
UNION ALL SELECT 'claimed_duplicates', count(*) FROM groups
UNION ALL SELECT 'groups', count(*) FROM resolution
UNION ALL SELECT 'skipped_groups', count(*) FILTER (WHERE NOT applied) FROM resolution
UNION ALL SELECT 'removed', count(*) FROM removed_ids
UNION ALL SELECT 'final_articles', count(*) FROM fx_articles WHERE id NOT IN (SELECT id FROM removed_ids)
UNION ALL SELECT 'embeddings_stored', count(*) FROM tvec WHERE article_id NOT IN (SELECT id FROM removed_ids)""", _D5)

SQL["D5_store_after_dedup"] = with_fx("""
SELECT t.name, count(*) AS article_count FROM fx_article_tags x JOIN fx_tags t ON t.id = x.tag_id
WHERE x.article_id NOT IN (SELECT id FROM removed_ids) GROUP BY t.name""", _D5)

SQL["S9_snapshot"] = with_fx("""
SELECT a.id, a.link, md5(a.title) AS title_md5,
  (SELECT count(*) FROM fx_article_tags x WHERE x.article_id = a.id) AS n_tags FROM fx_articles a""")

SQL["F13_request_bodies"] = with_fx("""
SELECT (id - 1) // 10 AS batch_no, count(*) AS n_articles, count(*) AS parsed,
  arg_min(link, id) AS first_link, arg_max(link, id) AS last_link,
  md5(string_agg(title || '|' || coalesce(summary, '') || '|' || coalesce(published, '') || '|' || coalesce(updated, '')
      || '|' || source || '|' || coalesce(og_image, ''), chr(10) ORDER BY id)) AS body_md5
FROM fx_articles GROUP BY (id - 1) // 10""")

SQL["P10_grow_blocklist"] = with_fx("""
SELECT DISTINCT domain FROM (
  SELECT 'example.net' AS domain
  UNION ALL SELECT lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''))
  FROM pages WHERE page_id % 9 = 0) WHERE domain <> ''""")

SQL["F12_vector_json"] = with_fx("""
SELECT article_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last,
  round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS weighted FROM fx_vectors""")

SQL["F11_normalised"] = with_fx("""
SELECT article_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first
FROM fx_vectors""")

SQL["S10_absent_store"] = with_fx("""
SELECT 'fixture' AS store, count(*) AS articles FROM fx_articles UNION ALL SELECT 'absent', 0""")

SQL["P16_page_arguments"] = with_fx("""
SELECT l AS page_limit, o AS page_offset, l BETWEEN 0 AND 500 AND o >= 0 AS accepted,
  CASE WHEN l BETWEEN 0 AND 500 AND o >= 0 THEN greatest(0, least(l, (SELECT count(*) FROM fx_articles) - o)) END AS n_rows
FROM (VALUES (0, 0), (500, 0), (501, 0), (-1, 0), (10, -1), (10, 5), (500, 150)) v(l, o)""")

SQL["U2_failed_batches"] = with_fx("SELECT id, 'Technology' AS tag FROM fx_articles WHERE length(title) % 3 <> 0")

SQL["X2_blank_text"] = with_fx("SELECT id, id % 10 <> 0 AS has_vector FROM fx_articles")

SQL["T3_stream_links"] = with_fx("SELECT DISTINCT coalesce(link, '') AS link FROM fx_entries WHERE coalesce(link, '') <> ''")

SQL["O8_keyset_page"] = with_fx("SELECT id, created_at FROM fx_articles ORDER BY created_at DESC, id LIMIT 25 OFFSET 31")

_TAG_TEXT = ("' ' || regexp_replace(lower(coalesce({t}, '') || ' ' || coalesce(summary, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '")

SQL["X1_default_rules"] = with_fx(f"""
SELECT id, coalesce(list(name ORDER BY first) FILTER (name IS NOT NULL), []::VARCHAR[]) AS tags FROM (
  SELECT t.id, r.name, min(r.n) AS first
  FROM (SELECT id, {_TAG_TEXT.format(t="title || ' ' || ['New AI-powered software.', 'AI, startups: what''s next', '(Venture capital)', 'MACHINE  LEARNING!', 'said airtight', ''][id % 6 + 1]")} AS t
        FROM fx_articles) t
  LEFT JOIN (VALUES (1, 'Artificial Intelligence', ' artificial intelligence '), (2, 'Artificial Intelligence', ' machine learning '),
    (3, 'Artificial Intelligence', ' ai '), (4, 'Artificial Intelligence', ' llm '), (5, 'Startups', ' startup '), (6, 'Startups', ' startups '),
    (7, 'Startups', ' venture capital '), (8, 'Startups', ' seed round '), (9, 'Technology', ' technology '), (10, 'Technology', ' software '),
    (11, 'Technology', ' tech ')) r(n, name, phrase) ON contains(t.t, r.phrase)
  GROUP BY t.id, r.name) GROUP BY id""")

SQL["X1_many_rules"] = with_fx(f"""
SELECT t.id, coalesce(list(r.name ORDER BY r.n) FILTER (r.name IS NOT NULL), []::VARCHAR[]) AS tags
FROM (SELECT id, {_TAG_TEXT.format(t="title")} AS t FROM fx_articles) t
LEFT JOIN (
  SELECT i * 32 + j AS n, w[i + 1] || ' ' || w[j + 1] AS name
  FROM (SELECT string_split('an the re on ti sh er in ha ed es or st en th nd is of and to that was with he at tion be by from ou ea le', ' ') AS w),
       range(0, 32) a(i), range(0, 32) b(j)) r ON contains(t.t, ' ' || r.name || ' ')
GROUP BY t.id""")

SQL["T3_link_state"] = with_fx("""
SELECT coalesce(link, '') AS link, 1 AS passed FROM fx_entries WHERE coalesce(link, '') <> '' GROUP BY ALL""")

SQL["T3_vector_state"] = with_fx("""
SELECT v.article_id, m.x IS NULL AS accepted, m.y AS duplicate_id,
  CASE WHEN m.x IS NOT NULL THEN round(greatest(0, 1 - m.d * m.d / 2), 6) END AS similarity
FROM fx_vectors v LEFT JOIN matched m ON m.x = v.article_id""", _d2_ctes("fx_vectors", 0.3, None))

SQL["A1_kept_counts"] = with_fx("""
SELECT t.name, count(x.article_id) AS article_count
FROM fx_tags t LEFT JOIN fx_article_tags x ON x.tag_id = t.id AND x.article_id % 7 <> 0 GROUP BY t.id, t.name""")

SQL["O2_deep_page"] = """
SELECT id, created_at FROM (
  SELECT o_orderkey AS id, o_orderdate::TIMESTAMP AS created_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r,
         count(*) OVER () // 2 AS half FROM orders)
WHERE r > half AND r <= half + 100"""

SQL["M7_vectors"] = with_fx("""
SELECT article_id, CASE article_id % 50 WHEN 0 THEN 'vector length' WHEN 1 THEN 'vector not finite' WHEN 3 THEN 'vector length' END AS reason
FROM fx_vectors""")

# R2 twice: run 1 = articles with id <= max/2; run 2 = all articles, of which
# the links stored by run 1 are dropped (J4) and the rest are tested against
# run 1's vectors and each other.  T1 lands the same two batches as files.
_R2_TWO = _R2 + """,
r2h AS (SELECT max(id) / 2 AS h FROM fx_articles),
r2v1 AS (SELECT * FROM r2vec WHERE article_id <= (SELECT h FROM r2h)),""" + _d2_ctes("r2v1", 0.7, None, "_1") + """,
r2acc1 AS (SELECT id FROM accepted_1
           UNION SELECT id FROM r2tagged WHERE id <= (SELECT h FROM r2h) AND id NOT IN (SELECT article_id FROM tvec)),
r2s1 AS (SELECT * FROM r2vec WHERE article_id IN (SELECT id FROM r2acc1)),
r2v2 AS (SELECT * FROM r2vec WHERE article_id NOT IN (SELECT id FROM r2acc1)),""" + _d2_ctes("r2v2", 0.7, "r2s1", "_2") + """,
r2acc2 AS (SELECT id FROM accepted_2
           UNION SELECT id FROM r2tagged WHERE id NOT IN (SELECT id FROM r2acc1) AND id NOT IN (SELECT article_id FROM tvec)),
r2final AS (
  SELECT row_number() OVER (ORDER BY id) AS new_id, id, TIMESTAMP '2024-03-01 00:00:00' AS created_at FROM r2acc1
  UNION ALL
  SELECT (SELECT count(*) FROM r2acc1) + row_number() OVER (ORDER BY id), id, TIMESTAMP '2024-03-02 00:00:00' FROM r2acc2)"""

_R2_TWO_SELECT = """
SELECT f.new_id AS id, t.link, f.created_at, list_sort(t.names) AS tags
FROM r2final f JOIN r2tagged t ON t.id = f.id"""
_POLLED = _R2_TWO_SELECT.replace("AS tags", "AS tags, 'KARK 4 News' AS source")

SQL["R2_ingest_two_runs"] = with_fx(_R2_TWO_SELECT, _R2_TWO)
SQL["T1_stream_poll"] = with_fx(_POLLED, _R2_TWO)
SQL["T2_two_streams"] = with_fx(_POLLED, _R2_TWO)
SQL["T2_replay"] = with_fx("""
SELECT row_number() OVER (ORDER BY a.id) AS id, t.link FROM r2acc a JOIN r2tagged t ON t.id = a.id""", _R2)
SQL["R2_ingest_with_pages"] = with_fx("""
SELECT row_number() OVER (ORDER BY a.id) AS id, t.link,
  CASE WHEN a.id % 4 = 0 THEN 'https://img.example.com/p' || a.id || '.png' END AS og_image
FROM r2acc a JOIN r2tagged t ON t.id = a.id""", _R2)
