"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

Tables are the pre-registered views of the corpus.  Column names match the
Spark output exactly.  DuckDB's RE2 has no look-arounds, so where the Spark
expression uses them the SQL states the same rule another way.
"""

ORACLE = {}

ORACLE["latest_per_key"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS order_date
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
                                   ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey ASC) AS rn
      FROM orders) t
WHERE rn = 1 AND o_orderstatus = 'F'
"""

_CUSTOMER_RECORDS = """
WITH recs AS (
  SELECT c_custkey, c_name, c_mktsegment, c_acctbal, n_name AS city, r_name AS province,
         n_nationkey, n_regionkey,
         concat_ws(' ', c_name, c_mktsegment, n_name) AS body,
         c_acctbal > 0 AS flag
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey)
"""

ORACLE["faceted_search"] = _CUSTOMER_RECORDS + """
SELECT c_custkey, c_name, c_mktsegment, city, province FROM recs
WHERE flag IS TRUE AND c_name ILIKE '%customer#0000%' AND city ILIKE '%a%'
  AND (c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%' OR body ILIKE '%build%')
"""

ORACLE["faceted_search_province"] = _CUSTOMER_RECORDS + """
SELECT c_custkey, c_name, c_mktsegment, city, province FROM recs
WHERE flag IS TRUE AND c_mktsegment ILIKE '%mobile%' AND province = 'ASIA'
"""

ORACLE["dashboard_counts"] = _CUSTOMER_RECORDS + """
, r2 AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN '' ELSE city END AS city FROM recs)
SELECT count(DISTINCT c_mktsegment) AS total_names, count(*) AS total_records,
       count(DISTINCT CASE WHEN city IS NOT NULL AND city <> '' THEN city END) AS total_cities
FROM r2
"""

ORACLE["year_buckets"] = """
WITH sk AS (SELECT * FROM (VALUES ('2002', 0), ('2001', 1), ('2000', 2), ('1999', 3), ('1998', 4),
                                  ('Before 1998', 5)) v(bucket, bucket_order)),
d AS (SELECT CASE WHEN year(o_orderdate) >= 1998 THEN CAST(year(o_orderdate) AS VARCHAR)
                  ELSE 'Before 1998' END AS bucket, o_orderdate
      FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate IS NOT NULL),
a AS (SELECT bucket, count(*) AS n_records, strftime(max(o_orderdate), '%Y-%m-%d') AS newest,
             strftime(min(o_orderdate), '%Y-%m-%d') AS oldest FROM d GROUP BY bucket)
SELECT coalesce(sk.bucket, a.bucket) AS bucket, coalesce(sk.bucket_order, -1) AS bucket_order,
       coalesce(a.n_records, 0) AS n_records, newest, oldest
FROM sk FULL JOIN a ON sk.bucket = a.bucket
"""

ORACLE["year_buckets_fixed"] = """
WITH sk AS (SELECT * FROM (VALUES ('1996', 0), ('1997', 1), ('1998', 2), ('1999', 3), ('2000', 4),
                                  ('Before 1996', 5)) v(bucket, bucket_order)),
d AS (SELECT CASE WHEN year(o_orderdate) >= 1996 THEN CAST(year(o_orderdate) AS VARCHAR)
                  ELSE 'Before 1996' END AS bucket, o_orderdate
      FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate IS NOT NULL),
a AS (SELECT bucket, count(*) AS n_records, strftime(max(o_orderdate), '%Y-%m-%d') AS newest,
             strftime(min(o_orderdate), '%Y-%m-%d') AS oldest
      FROM d WHERE bucket IN ('1996', '1997', '1998', '1999', '2000', 'Before 1996') GROUP BY bucket)
SELECT coalesce(sk.bucket, a.bucket) AS bucket, coalesce(sk.bucket_order, -1) AS bucket_order,
       coalesce(a.n_records, 0) AS n_records, newest, oldest
FROM sk FULL JOIN a ON sk.bucket = a.bucket
"""

ORACLE["year_bucket_rows"] = """
SELECT CASE WHEN year(o_orderdate) >= 1998 THEN CAST(year(o_orderdate) AS VARCHAR)
            ELSE 'Before 1998' END AS bucket,
       o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate IS NOT NULL
"""

_LOCATED = _CUSTOMER_RECORDS + """
, loc AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN n_nationkey * 2.5 - 30.0 END::DOUBLE AS latitude,
                    CASE WHEN c_acctbal >= 0 THEN n_regionkey * 15.0 - 100.0 END::DOUBLE AS longitude
          FROM recs),
groups AS (SELECT latitude AS lat, longitude AS lon, count(*) AS n_records,
                  count(DISTINCT city) AS n_cities, min(c_name) AS first_name_in_group,
                  max(c_name) AS last_name_in_group, min(c_custkey) AS min_id
           FROM loc WHERE latitude IS NOT NULL AND NOT isnan(latitude)
                      AND longitude IS NOT NULL AND NOT isnan(longitude)
           GROUP BY latitude, longitude)
"""

ORACLE["location_groups"] = _LOCATED + "SELECT * FROM groups"

ORACLE["location_members"] = _LOCATED + """
SELECT latitude AS lat, longitude AS lon, c_name, city, province, c_custkey FROM loc
WHERE latitude IS NOT NULL AND NOT isnan(latitude) AND longitude IS NOT NULL AND NOT isnan(longitude)
"""

ORACLE["location_bounds"] = _LOCATED + """
SELECT coalesce(min(lat), 42.3149) AS min_lat, coalesce(max(lat), 42.3149) AS max_lat,
       coalesce(min(lon), -83.0364) AS min_lon, coalesce(max(lon), -83.0364) AS max_lon,
       count(*) AS n_groups
FROM groups
"""


# ----------------------------------------------------------------- J2 ---
import re as _re  # noqa: E402

from ..sources.fixed import longest_first as _longest_first  # noqa: E402
from .catalog import DOC_INSTITUTIONS, DOC_SIMPLE_KEYWORDS, DOC_STATUSES, DOC_WINDOW  # noqa: E402

# RE2 stand-ins for Java's (?U) classes.
_RE2_WS = r"[\t\n\v\f\r\x{85}\p{Z}]+"
_RE2_WORD = r"[\pL\p{Nl}\p{Nd}\pM\p{Pc}\x{200C}\x{200D}]"


def _re2_literal(s: str) -> str:
    return _re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", s)


def _re2_keyword(k: str) -> str:
    return "(?i)" + r"\s+".join(_re2_literal(p) for p in k.split())


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _kw_values(keywords, kind):
    rows = [f"({_sql_str(k)}, {_sql_str(_re2_keyword(k))}, {i}, {_sql_str(kind)})"
            for i, k in enumerate(_longest_first(keywords))]
    return ", ".join(rows)


def _occurrence_sql(kw_values: str) -> str:
    return f"""
d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_RE2_WS}', ' ', 'g')) AS t FROM documents),
kw AS (SELECT * FROM (VALUES {kw_values}) v(keyword, pat, rank, kind)),
raw AS (SELECT doc_id, t, keyword, rank, kind,
               string_split_regex(t, pat) AS pieces, regexp_extract_all(t, pat) AS ms
        FROM d, kw),
ex AS (SELECT doc_id, t, keyword, rank, kind, pieces, ms,
              unnest(generate_series(1, len(ms))) AS k FROM raw WHERE len(ms) > 0),
sp AS (SELECT doc_id, t, keyword, rank, kind,
              CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
              length(ms[k]) AS mlen FROM ex),
occ AS (SELECT doc_id, t, keyword, rank, kind, start, CAST(start + mlen AS INTEGER) AS "end" FROM sp
        WHERE (start = 0 OR NOT regexp_matches(substr(t, start, 1), '^{_RE2_WORD}$'))
          AND (start + mlen = length(t) OR NOT regexp_matches(substr(t, start + mlen + 1, 1), '^{_RE2_WORD}$')))
"""


ORACLE["keyword_hits_simple"] = (
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN contains(lower(coalesce(text, '')), {_sql_str(k.lower())}) THEN {_sql_str(k)}"
               for k in _longest_first(DOC_SIMPLE_KEYWORDS))
    + " END AS keyword, "
    + "(" + " OR ".join(f"contains(lower(coalesce(text, '')), {_sql_str(k.lower())})"
                        for k in DOC_SIMPLE_KEYWORDS) + ") AS is_match FROM documents")

ORACLE["keyword_occurrences"] = "WITH " + _occurrence_sql(
    _kw_values(DOC_INSTITUTIONS + DOC_STATUSES, "k")) + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, rank) AS INTEGER) AS ordinal,
       start, "end", keyword FROM occ
"""

ORACLE["proximity_match"] = "WITH " + _occurrence_sql(
    _kw_values(DOC_INSTITUTIONS, "i") + ", " + _kw_values(DOC_STATUSES, "s")) + f""",
io AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank) AS ord FROM occ WHERE kind = 'i'),
so AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank) AS ord FROM occ WHERE kind = 's'),
pairs AS (SELECT io.doc_id, io.t, io.keyword AS institution, so.keyword AS status,
                 least(io.start, so.start) AS lo, greatest(io."end", so."end") AS hi,
                 io.ord AS iord, so.ord AS sord
          FROM io JOIN so ON io.doc_id = so.doc_id
           AND greatest(0, greatest(io.start, so.start) - least(io."end", so."end")) <= {DOC_WINDOW}),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY iord, sord) = 1)
SELECT documents.doc_id, best.doc_id IS NOT NULL AS is_match, institution, status,
       trim(substr(t, greatest(0, lo - 45) + 1, least(length(t), hi + 45) - greatest(0, lo - 45))) AS matched_text
FROM documents LEFT JOIN best ON documents.doc_id = best.doc_id
"""


# ----------------------------------------------------------------- J1 ---
from ..functions.html import ENTITIES as _ENT, element_pattern as _elpat, link_pattern as _linkpat  # noqa: E402
from .catalog import DISCOVERY_DOMAIN, LINK_PREFIX, PRIORITY_SITES  # noqa: E402

_ROOT = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def _collapse(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '{_RE2_WS}', ' ', 'g'))"


def _unescape(x):
    for k, v in _ENT:
        x = f"replace({x}, {_sql_str(k)}, {_sql_str(v)})"
    return x


def _element_text(html, tag):
    pat = _sql_str(_elpat(tag))
    inner = f"regexp_extract(coalesce({html}, ''), {pat}, 1)"
    x = f"regexp_replace({inner}, '(?is)<script(?:\\s[^>]*)?>.*?</script\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<style(?:\\s[^>]*)?>.*?</style\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return f"CASE WHEN regexp_matches(coalesce({html}, ''), {pat}) THEN {_collapse(_unescape(x))} ELSE 'N/A' END"


def _split_name(x):
    """(first, last) SQL for P4+P5 over text expression x."""
    cleaned = f"trim(regexp_replace(regexp_replace({_collapse(x)}, ' Obituary$', ''), ' obituary$', ''))"
    toks = f"string_split({cleaned}, ' ')"
    ok = f"({cleaned} <> '' AND len({toks}) >= 2)"
    first = f"CASE WHEN {ok} THEN array_to_string({toks}[1:len({toks}) - 1], ' ') END"
    lastt = f"{toks}[len({toks})]"
    last = f"CASE WHEN {ok} THEN upper(substr({lastt}, 1, 1)) || lower(substr({lastt}, 2)) END"
    return first, last


_LINKS_CTE = f"""
l AS (SELECT page_id, regexp_extract(url, '{_ROOT}', 1) AS root,
             regexp_extract_all(coalesce(html, ''), {_sql_str(_linkpat(LINK_PREFIX))}, 1) AS ls FROM pages),
u AS (SELECT page_id, root, unnest(ls) AS link, generate_subscripts(ls, 1) AS i FROM l),
f AS (SELECT page_id, root, link, min(i) AS first_i FROM u GROUP BY page_id, root, link),
pl AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_i) AS INTEGER) AS position,
              root || link AS link FROM f)
"""

ORACLE["page_links"] = "WITH " + _LINKS_CTE + "SELECT * FROM pl"

ORACLE["distinct_links"] = "WITH " + _LINKS_CTE + """
SELECT link, arg_min(page_id, (page_id, position)) AS first_page_id,
       arg_min(position, (page_id, position)) AS first_position, count(*) AS n_pages
FROM pl GROUP BY link
"""

_b_first, _b_last = _split_name("h1")
_c_first, _c_last = _split_name("split_part(title, ' Obituary', 1)")
ORACLE["page_title_h1"] = f"""
WITH p AS (SELECT page_id, {_element_text('html', 'title')} AS title, {_element_text('html', 'h1')} AS h1 FROM pages)
SELECT page_id, title, h1,
       CASE WHEN {_b_first} IS NOT NULL AND {_b_last} IS NOT NULL THEN {_b_first} ELSE {_c_first} END AS first_name,
       CASE WHEN {_b_first} IS NOT NULL AND {_b_last} IS NOT NULL THEN {_b_last} ELSE {_c_last} END AS last_name
FROM p
"""

ORACLE["page_body"] = f"""
WITH p AS (SELECT page_id, {_element_text('html', 'article')} AS a, {_element_text('html', 'main')} AS m FROM pages)
SELECT page_id, CASE WHEN a <> '' AND a <> 'N/A' THEN a WHEN m <> '' AND m <> 'N/A' THEN m ELSE '' END AS body FROM p
"""

_LABEL = f"nullif(split_part(lower(regexp_extract(url, '{_HOST}', 1)), '.', 1), '')"

ORACLE["site_lookup"] = f"""
WITH lab AS (SELECT page_id, {_LABEL} AS subdomain FROM pages),
dim AS (SELECT DISTINCT subdomain, upper(subdomain) AS city,
               'P' || CAST(length(subdomain) % 5 AS VARCHAR) AS province
        FROM lab WHERE length(subdomain) >= 5)
SELECT lab.page_id, lab.subdomain, dim.city, dim.province FROM lab LEFT JOIN dim ON lab.subdomain = dim.subdomain
"""

ORACLE["site_discovery"] = f"""
WITH h AS (SELECT lower(regexp_extract(url, '{_HOST}', 1)) AS h FROM pages)
SELECT DISTINCT split_part(h, '.', 1) AS subdomain FROM h
WHERE h LIKE '%{DISCOVERY_DOMAIN}' AND len(string_split(h, '.')) > 2 AND split_part(h, '.', 1) <> 'www'
"""

ORACLE["site_order"] = f"""
WITH s AS (SELECT DISTINCT {_LABEL} AS subdomain FROM pages)
SELECT subdomain, CAST(nullif(coalesce(list_position([{', '.join(_sql_str(x) for x in PRIORITY_SITES)}], subdomain), 0), 0) AS INTEGER) AS priority_pos
FROM s WHERE subdomain IS NOT NULL
"""


# ------------------------------------------------------- F1-F13 text ---
from ..functions.dates import BODY_DATE_PATTERNS as _BODY_PATS  # noqa: E402
from .catalog import BODY_TERMS, PUBLICATION_AS_OF  # noqa: E402

_LAYOUTS_SQL = ["%B %-d, %Y", "%b %-d, %Y", "%-m/%-d/%y", "%-m-%-d-%Y", "%B %-d", "%b %-d", "%Y"]


def _first_body_date(x):
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract(coalesce({x}, ''), {_sql_str(p)}, 0), '')" for p in _BODY_PATS) + ")"


def _year_from_text(x):
    return (f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '\\b(\\d{{4}})\\b', 1), '') AS INTEGER), "
            f"TRY_CAST(nullif(regexp_extract({x}, '(?:/|-|,?\\s+)(\\d{{2}})$', 1), '') AS INTEGER) + 2000)")


_date_text = "CASE " + " ".join(
    f"WHEN o_orderkey % 7 = {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_LAYOUTS_SQL)) + " END"

ORACLE["death_date_text"] = f"""
WITH n AS (SELECT o_orderkey,
                  'Notice ' || CAST(o_orderkey AS VARCHAR) || ': passed away ' || {_date_text}
                  || '. Customer ' || CAST(o_custkey AS VARCHAR) || '.' AS body,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN ['N/A', strftime(o_orderdate, '%B %-d, %Y')]
                       WHEN o_orderpriority = '2-HIGH' THEN [' ', ''] END AS header FROM orders),
c AS (SELECT *, {_first_body_date('body')} AS candidate,
             list_filter(list_transform(coalesce(header, []), lambda x: trim(x)), lambda x: x <> '') AS hs FROM n)
SELECT o_orderkey, candidate, {_year_from_text('candidate')} AS candidate_year,
       CASE WHEN len(hs) > 0 AND len(hs) >= 2 AND hs[1] <> 'N/A' THEN hs[1] END AS birth_date,
       CASE WHEN len(hs) > 0 THEN (CASE WHEN hs[len(hs)] <> 'N/A' THEN hs[len(hs)] END)
            WHEN {_year_from_text('candidate')} > 2000 THEN candidate END AS death_date
FROM c
"""

_FMT_LIST = "['%B %d, %Y', '%b %d, %Y', '%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S%z', '%m/%d/%Y']"

ORACLE["publication_date"] = f"""
WITH o AS (SELECT o_orderkey,
                  list_filter([CASE WHEN o_orderstatus = 'P' THEN 'Published online soon'
                                    ELSE 'Published online ' || strftime(o_orderdate, '%B %-d, %Y') END,
                               CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END],
                              lambda x: x IS NOT NULL) AS cands FROM orders),
p AS (SELECT o_orderkey, list_filter(list_transform(cands, lambda x: strftime(try_strptime(
          trim(regexp_replace(x, '(?i)^Published(?:\\s+online|\\s+on)?\\s+', '')), {_FMT_LIST}), '%B %d, %Y')),
          lambda x: x IS NOT NULL)[1] AS publication_text FROM o),
t AS (SELECT *, try_strptime(trim(publication_text), '%B %d, %Y') AS ts FROM p)
SELECT o_orderkey, publication_text, strftime(ts, '%Y-%m-%d') AS publication_day,
       coalesce(year(ts) = year(TIMESTAMP '{PUBLICATION_AS_OF}') AND month(ts) = month(TIMESTAMP '{PUBLICATION_AS_OF}'), false) AS is_current
FROM t
"""


def _sentence_filter(x, terms):
    cond = " OR ".join(f"contains(lower(s), {_sql_str(t.lower())})" for t in terms)
    return f"array_to_string(list_filter(string_split(coalesce({x}, ''), '. '), lambda s: {cond}), '; ')"


ORACLE["sentence_filter"] = f"""
SELECT doc_id, {_sentence_filter('text', BODY_TERMS)} AS donation_information FROM documents
"""


def _display_normalize(x):
    t = f"regexp_replace(trim(coalesce({x}, '')), '{_RE2_WS}', ' ', 'g')"
    t = f"regexp_replace({t}, '([a-z0-9,;:])([A-Z])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([.!?])([A-Z])', '\\1 \\2', 'g')"
    sentinel = f"{_collapse(x)} IN ('', 'N/A', 'None', 'null')"
    return f"(CASE WHEN {x} IS NULL OR {sentinel} THEN '' ELSE trim({t}) END)"


def _clean_body(x, name):
    t = _display_normalize(x)
    t = f"regexp_replace({t}, '(?i)\\bObituary\\s+Events\\s+Guestbook\\s+Share\\b', ' ', 'g')"
    q = f"('\\Q' || replace(trim({name}), '\\E', '\\E\\\\E\\Q') || '\\E')"
    date = "[A-Za-z]+\\s+\\d{1,2},\\s+\\d{4}"
    header = (f"('(?i)^(?:' || {q} || '\\s*)?(?:{date}\\s*-\\s*{date}\\s*)?(?:' || {q} || '\\s*)+')")
    t = f"trim(regexp_replace({t}, {header}, ''))"
    title = f"({name} || ' Obituary')"
    idx = f"instr(lower({t}), lower({title}))"
    t = f"(CASE WHEN {idx} > 0 AND {idx} <= 500 THEN trim(substr({t}, {idx} + length({title}))) ELSE {t} END)"
    return f"trim(regexp_replace({t}, '^(Obituary|Events|Guestbook|Share)\\b', ''))"


_NAMED = """
nd AS (SELECT doc_id, 'Ana Lee' || CAST(doc_id AS VARCHAR) AS name, text FROM documents),
named AS (SELECT doc_id, name,
                 CASE WHEN doc_id % 3 = 0 THEN name || ' January 1, 1950 - June 1, 2026 ' || name || ' ' || name
                                               || ' Obituary Events Guestbook Share ' || text
                      WHEN doc_id % 3 = 1 THEN 'Share ' || name || ' Obituary ' || text
                      ELSE text END AS body FROM nd)
"""

ORACLE["clean_body"] = "WITH " + _NAMED + f"SELECT doc_id, {_clean_body('body', 'name')} AS cleaned FROM named"

ORACLE["paragraphs"] = "WITH " + _NAMED + f""",
c AS (SELECT doc_id, {_clean_body('body', 'name')} AS cleaned FROM named),
s AS (SELECT doc_id, cleaned, list_filter(list_transform(string_split(
          regexp_replace(cleaned, '([.!?])\\s+([A-Z"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
          lambda x: trim(x)), lambda x: x <> '') AS sents FROM c),
p AS (SELECT doc_id, CASE WHEN cleaned = '' THEN []
                          WHEN len(sents) <= 1 THEN [cleaned]
                          ELSE list_transform(range(1, len(sents) + 1, 2),
                                              lambda i: array_to_string(sents[i:i + 1], ' ')) END AS p FROM s)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_paragraphs, array_to_string(p, ' || ') AS paragraphs FROM p
"""

ORACLE["donation_items"] = f"""
WITH f AS (SELECT doc_id, {_display_normalize(_sentence_filter('text', BODY_TERMS))} AS t FROM documents),
i AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE list_transform(
          list_filter(string_split_regex(t, ';|\\n'), lambda s: trim(s) <> ''),
          lambda s: regexp_replace(trim(s), '\\.+$', '')) END AS items FROM f)
SELECT doc_id, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items, ' | ') AS items FROM i
"""


# --------------------------------------------------------- J3/J4 admit ---

_n1, _l1 = _split_name(
    "array_to_string(string_split(" + _collapse("split_part(coalesce(text, ''), chr(10), 1)") + ", ' ')[1:3], ' ')")
_SIMPLE_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(coalesce(body, '')), {_sql_str(k.lower())}) THEN {_sql_str(k)}"
    for k in _longest_first(DOC_SIMPLE_KEYWORDS)) + " END"

_OUTCOMES = f"""
cand AS (SELECT doc_id, 'https://' || source || '.example.com/doc/' || CAST(doc_id AS VARCHAR) AS url,
                {_n1} AS first_name, {_l1} AS last_name, text AS body FROM documents),
m AS (SELECT *, {_SIMPLE_CASE} AS institution FROM cand),
ex AS (SELECT doc_id AS ex_key, 'Stored ' || CAST(doc_id AS VARCHAR) AS stored_name,
              quality = 1 AS stored_is_alumni,
              CASE WHEN toxic = 1 THEN 'updated' ELSE 'new' END AS stored_tags FROM labels),
sites AS (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS subdomain, n_name AS city, r_name AS province
          FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'),
gaz AS (SELECT n_name AS g_city, r_name AS g_prov, CAST(n_nationkey * 2.5 - 30.0 AS DOUBLE) AS g_lat,
               CAST(n_regionkey * 15.0 - 100.0 AS DOUBLE) AS g_lon
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'),
j AS (SELECT m.*, ex.*, sites.city, sites.province, g_lat, g_lon,
             (first_name IS NOT NULL AND last_name IS NOT NULL) AS has_name,
             institution IS NOT NULL AS matched, ex_key IS NOT NULL AS dup, sites.city IS NOT NULL AS known
      FROM m LEFT JOIN ex ON m.doc_id = ex.ex_key
             LEFT JOIN sites ON nullif(split_part(lower(regexp_extract(url, '{_HOST}', 1)), '.', 1), '') = sites.subdomain
             LEFT JOIN gaz ON sites.city = gaz.g_city AND sites.province = gaz.g_prov),
oc AS (SELECT doc_id, url,
         CASE WHEN NOT has_name THEN 'skipped' WHEN NOT matched THEN 'skipped' WHEN dup THEN 'duplicate'
              WHEN NOT known THEN 'skipped' ELSE 'saved' END AS status,
         CASE WHEN NOT has_name THEN 'missing_name' WHEN NOT matched THEN 'no_alumni_keyword'
              WHEN dup THEN 'existing_url' WHEN NOT known THEN 'unknown_city' END AS reason,
         CASE WHEN has_name AND matched AND dup THEN stored_name
              WHEN has_name THEN concat_ws(' ', first_name, last_name) END AS name,
         CASE WHEN NOT has_name OR NOT matched THEN false WHEN dup THEN stored_is_alumni ELSE true END AS is_alumni,
         institution, city, province,
         CASE WHEN has_name AND matched AND NOT dup AND known THEN g_lat END AS latitude,
         CASE WHEN has_name AND matched AND NOT dup AND known THEN g_lon END AS longitude,
         CASE WHEN has_name AND matched AND dup THEN stored_tags
              WHEN has_name THEN 'new' END AS tags
       FROM j)
"""

ORACLE["outcomes"] = "WITH " + _OUTCOMES + "SELECT * FROM oc"

ORACLE["site_saved"] = "WITH " + _OUTCOMES + """
SELECT city, CAST(count_if(status = 'saved') AS BIGINT) AS saved_count, count(*) AS n_outcomes FROM oc GROUP BY city
"""

ORACLE["admit_new"] = """
SELECT doc_id, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""

ORACLE["admit_duplicates"] = """
SELECT doc_id, source FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""

ORACLE["dedup_by_text"] = "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text"


# -------------------------------------------------------- J5 frontier ---
from .catalog import (ACTIVE_KEYWORDS, GRID_KEYWORDS, REPEAT_THRESHOLD, STALE_AS_OF,  # noqa: E402
                      STALE_RUN_AS_OF, URL_KEYWORDS)

ORACLE["stop_at_stale"] = f"""
WITH c AS (SELECT o_custkey, o_orderkey % 3 + 1 AS page, o_orderkey,
                  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS ts
           FROM orders),
f AS (SELECT *, coalesce(year(ts) = year(TIMESTAMP '{STALE_AS_OF}') AND month(ts) = month(TIMESTAMP '{STALE_AS_OF}'), false) AS cur FROM c),
fr AS (SELECT o_custkey, page, arg_min(cur, o_orderkey) AS first_cur FROM f GROUP BY o_custkey, page),
d AS (SELECT f.*, fr.first_cur, (f.page = 1 AND NOT fr.first_cur) AS gate
      FROM f JOIN fr USING (o_custkey, page) WHERE f.ts IS NOT NULL),
o AS (SELECT *, min(CASE WHEN cur THEN 1 ELSE 0 END) OVER (
          PARTITION BY o_custkey, page ORDER BY ts DESC, o_orderkey ASC
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_prefix FROM d),
k AS (SELECT *, in_prefix = 1 AND NOT gate AS kept FROM o),
pages AS (SELECT o_custkey, page FROM fr),
ps AS (SELECT p.o_custkey, p.page,
              coalesce(sum(CASE WHEN k.kept THEN 1 ELSE 0 END), 0) AS n_kept,
              coalesce(bool_or(NOT k.cur), false) AS cut,
              coalesce(bool_or(k.gate), false) OR (p.page = 1 AND NOT any_value(fr.first_cur)) AS gated
       FROM pages p LEFT JOIN k ON p.o_custkey = k.o_custkey AND p.page = k.page
                    JOIN fr ON fr.o_custkey = p.o_custkey AND fr.page = p.page
       GROUP BY p.o_custkey, p.page),
st AS (SELECT o_custkey, min(page) AS stop_page FROM ps WHERE n_kept = 0 OR cut OR gated GROUP BY o_custkey)
SELECT k.o_custkey, k.page, k.o_orderkey, strftime(k.ts, '%Y-%m-%d') AS order_date, st.stop_page
FROM k LEFT JOIN st USING (o_custkey)
WHERE k.kept AND (st.stop_page IS NULL OR k.page <= st.stop_page)
"""

ORACLE["repeated_pages"] = "WITH " + _LINKS_CTE + f""",
sg AS (SELECT page_id, string_agg(link, chr(10) ORDER BY position) AS sig, count(*) AS n FROM pl GROUP BY page_id),
p AS (SELECT pages.page_id, {_LABEL} AS site, coalesce(sg.n, 0) AS n_links, sg.sig
      FROM pages LEFT JOIN sg ON pages.page_id = sg.page_id),
r AS (SELECT *, CASE WHEN sig IS NOT NULL THEN row_number() OVER (PARTITION BY site, sig ORDER BY page_id) END AS rn FROM p),
s AS (SELECT *, CASE WHEN n_links = 0 THEN 'no_links' WHEN rn - 1 >= {REPEAT_THRESHOLD} THEN 'repeated_page' END AS stop_reason FROM r),
sp AS (SELECT site, min(page_id) AS stop_page FROM s WHERE stop_reason IS NOT NULL GROUP BY site)
SELECT page_id, s.site, CAST(n_links AS INTEGER) AS n_links, CAST(least(rn, {REPEAT_THRESHOLD + 2}) AS INTEGER) AS sighting,
       rn > 1 AS is_repeat, stop_reason, (stop_page IS NULL OR page_id <= stop_page) AS read,
       CAST(CASE WHEN (stop_page IS NULL OR page_id <= stop_page) AND rn = 1 THEN n_links ELSE 0 END AS INTEGER) AS n_yielded
FROM s LEFT JOIN sp ON s.site IS NOT DISTINCT FROM sp.site
"""

_EVENT_STATE = """
ev AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS page, event_id,
              'https://u' || CAST(user_id AS VARCHAR) || '.example.com/obituary/' || CAST(event_id AS VARCHAR) AS url,
              event_type, value, ts FROM events),
st0 AS (SELECT user_id, arg_max(page, event_id) AS page_number, arg_max(url, event_id) AS u,
               arg_max(value, event_id) AS v FROM ev WHERE event_type = 'error' GROUP BY user_id),
state AS (SELECT user_id, page_number,
                 CASE WHEN v < 10 THEN 'https://gone.example.com/x' ELSE u END AS last_processed_url,
                 CASE WHEN v > 45 THEN 'completed' ELSE 'running' END AS status FROM st0)
"""

ORACLE["resume_slice"] = "WITH " + _EVENT_STATE + """,
c AS (SELECT ev.user_id, ev.page, ev.event_id, ev.url, state.page_number AS sp, state.last_processed_url AS su,
             state.status AS ss
      FROM ev LEFT JOIN state ON ev.user_id = state.user_id
      WHERE NOT coalesce(state.status IN ('completed', 'pagination_blocked'), false)),
mk AS (SELECT user_id, min(event_id) AS mark FROM c WHERE url = su AND page = sp GROUP BY user_id)
SELECT c.user_id, c.page, c.event_id FROM c LEFT JOIN mk ON c.user_id = mk.user_id
WHERE NOT coalesce(ss = 'running' AND sp IS NOT NULL AND coalesce(su <> '', false), false)
   OR page > sp OR (page = sp AND (mark IS NULL OR event_id > mark))
"""

ORACLE["resume_start_page"] = "WITH " + _EVENT_STATE + """
SELECT CAST(user_id % 7 AS INTEGER) AS site,
       coalesce(min(CASE WHEN status = 'running' AND coalesce(page_number > 0, false) THEN page_number END), 1) AS start_page
FROM state GROUP BY CAST(user_id % 7 AS INTEGER)
"""

ORACLE["url_keywords"] = f"""
WITH h AS (SELECT source, k AS keyword FROM documents,
                  (VALUES {', '.join('(' + _sql_str(k) + ')' for k in URL_KEYWORDS)}) v(k)
           WHERE contains(lower(coalesce(text, '')), lower(k)))
SELECT source, array_to_string(list_sort(list_distinct(list(keyword))), ',') AS keywords
FROM h WHERE keyword IN ({', '.join(_sql_str(k) for k in ACTIVE_KEYWORDS)}) GROUP BY source
"""

ORACLE["request_grid"] = f"""
WITH s AS (SELECT lower(replace(n_name, ' ', '')) AS site FROM nation),
k AS (SELECT * FROM (VALUES {', '.join('(' + _sql_str(k) + ')' for k in GRID_KEYWORDS)}) v(keyword)),
p AS (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS page),
g AS (SELECT site, keyword, page FROM s, k, p)
SELECT site, keyword, page,
       'https://' || site || '.remembering.ca/obituaries/obituaries/search?limit=125&search_type=advanced&ap_search_keyword='
       || replace(keyword, ' ', '+') || '&sort_by=date&order=desc'
       || CASE WHEN page > 1 THEN '&p=' || CAST(page AS VARCHAR) ELSE '' END AS search_url,
       'https://' || site || '.remembering.ca/obituaries/obituaries/search?limit=125'
       || CASE WHEN page > 1 THEN '&p=' || CAST(page AS VARCHAR) ELSE '' END AS listing_url
FROM g
"""


# ---------------------------------------------------------- J6 ledger ---

_EV_OUT = """
e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'view' THEN 'skipped'
                     WHEN 'click' THEN 'duplicate' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'stopped' END AS status,
             event_type = 'purchase' AS is_alumni FROM events),
e2 AS (SELECT *, coalesce(status = 'saved' OR (status IS NULL AND coalesce(is_alumni, false)), false) AS sv,
              coalesce(status = 'duplicate', false) AS dp, coalesce(status = 'stopped', false) AS so,
              CASE WHEN status = 'error' THEN coalesce(nullif(props, ''), 'Obituary processing error.') END AS msg
       FROM e),
cnt AS (SELECT user_id, CAST(count_if(sv) AS BIGINT) AS saved_count,
               CAST(count_if(NOT sv AND NOT dp AND NOT so) AS BIGINT) AS skipped_count,
               CAST(count_if(dp) AS BIGINT) AS duplicate_count,
               substr(arg_max(msg, (ts, event_id)) FILTER (WHERE msg IS NOT NULL), 1, 4000) AS error_message
        FROM e2 GROUP BY user_id)
"""

ORACLE["run_counters"] = "WITH " + _EV_OUT + "SELECT * FROM cnt"

ORACLE["latest_state"] = """
WITH ev AS (SELECT user_id, event_type, ts, event_id, CAST(floor(value) AS INTEGER) AS page_number,
                   'https://u' || CAST(user_id AS VARCHAR) || '.example.com/obituary/' || CAST(event_id AS VARCHAR) AS url,
                   CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'pagination_blocked'
                                   WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status FROM events)
SELECT user_id, event_type, arg_max(page_number, (ts, event_id)) AS page_number,
       arg_max(url, (ts, event_id)) AS last_processed_url, arg_max(status, (ts, event_id)) AS status,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM ev GROUP BY user_id, event_type
"""

_RUNS = "WITH " + _EV_OUT + """,
r0 AS (SELECT user_id AS id, min(ts) AS started_at,
              CASE WHEN arg_max(event_type, (ts, event_id)) IN ('purchase', 'view') THEN max(ts) END AS finished_at,
              arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'error' AND value > 40) AS error_message,
              arg_max(event_type, (ts, event_id)) AS last_type,
              arg_max(CAST(floor(value) AS INTEGER), (ts, event_id)) AS page_number
       FROM e GROUP BY user_id),
runs AS (SELECT id, CASE WHEN finished_at IS NULL THEN 'running' ELSE 'success' END AS status,
                started_at, finished_at, 'city' || CAST(id % 7 AS VARCHAR) AS city,
                CASE WHEN last_type = 'view' THEN '__listing__' ELSE last_type END AS search_keyword,
                page_number, r0.error_message, saved_count, skipped_count, duplicate_count
         FROM r0 LEFT JOIN cnt ON r0.id = cnt.user_id)
"""

ORACLE["stale_runs"] = _RUNS + f"""
SELECT id, CASE WHEN status = 'running' AND finished_at IS NULL THEN 'stopped' ELSE status END AS status,
       strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
       strftime(CASE WHEN status = 'running' AND finished_at IS NULL THEN TIMESTAMP '{STALE_RUN_AS_OF}'
                     ELSE finished_at END, '%Y-%m-%d %H:%M:%S') AS finished_at,
       CASE WHEN status = 'running' AND finished_at IS NULL AND coalesce(error_message, '') = ''
            THEN 'Marked stopped before starting a new scraper run.' ELSE error_message END AS error_message
FROM runs
"""

ORACLE["latest_run"] = _RUNS + """
SELECT id, status,
       strftime(started_at, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(started_at, '%f') <> '000000' THEN '.' || strftime(started_at, '%f') ELSE '' END AS started_at,
       strftime(finished_at, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(finished_at, '%f') <> '000000' THEN '.' || strftime(finished_at, '%f') ELSE '' END AS finished_at,
       city, CASE WHEN search_keyword = '__listing__' THEN 'Listing scan' ELSE search_keyword END AS search_keyword,
       search_keyword AS search_keyword_raw,
       page_number, coalesce(saved_count, 0) AS saved_count, coalesce(skipped_count, 0) AS skipped_count,
       coalesce(duplicate_count, 0) AS duplicate_count, error_message
FROM runs ORDER BY id DESC LIMIT 1
"""

ORACLE["attempts"] = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
                  event_type <> 'error' AS ok FROM events QUALIFY attempt <= 3),
g AS (SELECT user_id, min(attempt) FILTER (WHERE ok) AS resolved_attempt,
             arg_min(event_type, attempt) FILTER (WHERE ok) AS ok_outcome,
             arg_max(props, attempt) FILTER (WHERE NOT ok) AS last_error, count(*) AS used FROM a GROUP BY user_id)
SELECT user_id, CAST(resolved_attempt AS INTEGER) AS resolved_attempt,
       CASE WHEN resolved_attempt IS NOT NULL THEN resolved_attempt ELSE used END AS attempts_used,
       CASE WHEN resolved_attempt IS NOT NULL THEN 'saved' ELSE 'skipped' END AS status,
       CASE WHEN resolved_attempt IS NOT NULL THEN ok_outcome END AS outcome,
       CASE WHEN resolved_attempt IS NULL THEN substr(coalesce(last_error, 'Obituary processing error.'), 1, 4000) END AS message
FROM g
"""


# -------------------------------------------------- J8/J9 export, curate ---

ORACLE["csv_rows"] = f"""
WITH j AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey
                  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT o_orderkey AS id, concat_ws(' ', c_mktsegment, c_name) AS name,
             NULL::VARCHAR AS birth_date, strftime(o_orderdate, '%B %-d, %Y') AS death_date,
             o_orderdate AS publication_date, n_name AS city, r_name AS province, 'N/A' AS funeral_home,
             'https://example.com/obituary/' || CAST(o_orderkey AS VARCHAR) AS obituary_url,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'updated' ELSE 'new' END AS tags,
             CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS is_alumni,
             CASE WHEN r_name <> 'EUROPE' THEN n_nationkey * 2.5 - 30.0 END AS latitude,
             CASE WHEN r_name <> 'EUROPE' THEN n_regionkey * 15.0 - 100.0 END AS longitude,
             '  Order' || chr(9) || o_orderpriority || '  for' || chr(10) || ' ' || c_name || ' ' AS family_information,
             '' AS donation_information FROM j)
SELECT CAST(id AS VARCHAR) AS id, {_collapse('name')} AS name,
       {_collapse(_split_name('name')[0])} AS first_name, {_collapse(_split_name('name')[1])} AS last_name,
       {_collapse('birth_date')} AS birth_date, {_collapse('death_date')} AS death_date,
       coalesce(strftime(publication_date, '%Y-%m-%d'), '') AS publication_date,
       {_collapse('city')} AS city, {_collapse('province')} AS province, {_collapse('funeral_home')} AS funeral_home,
       {_collapse('obituary_url')} AS obituary_url, {_collapse('tags')} AS tags,
       CASE WHEN coalesce(is_alumni, false) THEN 'true' ELSE 'false' END AS is_alumni,
       coalesce(CAST(latitude AS VARCHAR), '') AS latitude, coalesce(CAST(longitude AS VARCHAR), '') AS longitude,
       {_collapse('family_information')} AS family_information,
       {_collapse('donation_information')} AS donation_information
FROM r WHERE coalesce(is_alumni, false)
"""

ORACLE["tag_updates"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'new' END AS tags FROM customer),
ch AS (SELECT o_custkey AS c_custkey, o_orderdate, o_orderkey,
              CASE o_orderstatus WHEN 'F' THEN 'updated' WHEN 'O' THEN 'new' ELSE 'archived' END AS tags FROM orders),
l AS (SELECT c_custkey, arg_max(tags, (o_orderdate, o_orderkey)) AS new_tag FROM ch
      WHERE tags IN ('new', 'updated') GROUP BY c_custkey)
SELECT c.c_custkey, coalesce(l.new_tag, coalesce(c.tags, 'new')) AS tags FROM c LEFT JOIN l ON c.c_custkey = l.c_custkey
"""


# ------------------------------------------------------- J10 streaming ---

ORACLE["stream_dedup"] = """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event_id,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts
FROM events GROUP BY user_id
"""
ORACLE["stream_counters"] = ORACLE["run_counters"]
ORACLE["stream_state"] = ORACLE["latest_state"]


# ---------------------------------------------- T3/T4/T12 crawl plans ---
# Sequential rules stated with window functions (row_number per signature,
# first stop page per key), independent of the Spark aggregate/join form.

_PLAN_BASE = "WITH " + _LINKS_CTE + f""",
lk AS (SELECT page_id, list(link ORDER BY position) AS links FROM pl GROUP BY page_id),
ap AS (SELECT pages.page_id AS page, {_LABEL} AS site,
              regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1) AS keyword,
              coalesce(lk.links, []) AS links
       FROM pages LEFT JOIN lk ON pages.page_id = lk.page_id),
ex AS (SELECT link AS url FROM pl GROUP BY link HAVING count(*) >= 2),
pg AS (SELECT * FROM ap WHERE site IS NOT NULL)
"""


def _plan_sql(keys):
    """Shared CTEs for a plan keyed by ``keys`` (site or site, keyword)."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    kw_state = "'__listing__'" if keys == ["site"] else "keyword"
    return f""",
fp AS (SELECT {k}, min(page) AS page_number FROM pg GROUP BY {k}),
st AS (SELECT {', '.join('fp.' + c for c in keys)}, fp.page_number, pg.links[1] AS last_processed_url,
              CASE WHEN length(fp.site) % 5 = 0 THEN 'completed' WHEN length(fp.site) % 2 = 0 THEN 'running' END AS status
       FROM fp JOIN pg ON {on('fp', 'pg')} AND fp.page_number = pg.page),
st2 AS (SELECT *, {kw_state} AS search_keyword FROM st WHERE status IS NOT NULL)"""


_LISTING_SQL = _PLAN_BASE + _plan_sql(["site"]) + f""",
sp AS (SELECT site, coalesce(min(CASE WHEN status = 'running' AND coalesce(page_number > 0, false)
                                      THEN page_number END), 1) AS start_page FROM st2 GROUP BY site),
p AS (SELECT pg.* FROM pg LEFT JOIN sp ON pg.site = sp.site
      WHERE NOT EXISTS (SELECT 1 FROM st2 WHERE st2.site = pg.site AND st2.status IN ('completed', 'pagination_blocked'))
        AND pg.page >= coalesce(sp.start_page, 1)),
s AS (SELECT *, len(links) AS n_links, CASE WHEN len(links) > 0 THEN array_to_string(links, chr(10)) END AS sig FROM p),
r AS (SELECT *, CASE WHEN sig IS NOT NULL THEN row_number() OVER (PARTITION BY site, sig ORDER BY page) END AS rn FROM s),
r2 AS (SELECT *, CASE WHEN n_links = 0 THEN 'no_links' WHEN rn - 1 >= 1 THEN 'repeated_page' END AS stop_reason FROM r),
stops AS (SELECT site, min(page) AS stop_page, arg_min(stop_reason, page) AS stop_reason
          FROM r2 WHERE stop_reason IS NOT NULL GROUP BY site),
y AS (SELECT r2.site, r2.page, r2.links FROM r2 LEFT JOIN stops ON r2.site = stops.site
      WHERE (stops.stop_page IS NULL OR r2.page <= stops.stop_page) AND r2.rn = 1 AND r2.n_links > 0),
rows0 AS (SELECT site, page, unnest(links) AS url, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos FROM y),
c AS (SELECT rows0.*, st2.page_number AS sp_, st2.last_processed_url AS su, st2.status AS ss
      FROM rows0 LEFT JOIN st2 ON rows0.site = st2.site),
mk AS (SELECT site, min(pos) AS mark FROM c WHERE url = su AND page = sp_ GROUP BY site),
rs AS (SELECT c.site, c.page, c.pos, c.url FROM c LEFT JOIN mk ON c.site = mk.site
       WHERE NOT coalesce(ss = 'running' AND sp_ IS NOT NULL AND coalesce(su <> '', false), false)
          OR page > sp_ OR (page = sp_ AND (mark IS NULL OR pos > mark))),
fs AS (SELECT site, url, arg_min(page, (page, pos)) AS page, arg_min(pos, (page, pos)) AS pos FROM rs GROUP BY site, url),
lst AS (SELECT site, arg_max(page, (page, pos)) AS lp, arg_max(url, (page, pos)) AS lu FROM fs GROUP BY site),
ks AS (SELECT site FROM st2 UNION SELECT site FROM stops UNION SELECT site FROM lst)
"""

ORACLE["listing_plan_work"] = _LISTING_SQL + """
SELECT fs.site, fs.page, fs.pos, fs.url, CASE WHEN ex.url IS NULL THEN 'new' ELSE 'duplicate' END AS kind
FROM fs LEFT JOIN ex ON fs.url = ex.url
"""

ORACLE["listing_plan_state"] = _LISTING_SQL + """
SELECT ks.site,
       CASE WHEN stops.stop_page IS NOT NULL THEN stops.stop_page ELSE coalesce(lst.lp, st2.page_number) END AS page_number,
       coalesce(lst.lu, st2.last_processed_url) AS last_processed_url,
       CASE WHEN stops.stop_page IS NOT NULL THEN
              CASE WHEN stops.stop_reason = 'repeated_page' THEN 'pagination_blocked'
                   WHEN stops.stop_reason = 'error' THEN 'error' ELSE 'completed' END
            WHEN lst.lp IS NOT NULL THEN 'running' ELSE coalesce(st2.status, 'running') END AS status
FROM ks LEFT JOIN st2 ON ks.site = st2.site LEFT JOIN stops ON ks.site = stops.site LEFT JOIN lst ON ks.site = lst.site
"""

_SEARCH_SQL = _PLAN_BASE + _plan_sql(["site", "keyword"]) + f""",
active AS (SELECT * FROM st2 WHERE status <> 'completed'),
sp AS (SELECT site, coalesce(min(CASE WHEN status = 'running' AND coalesce(page_number > 0, false)
                                      THEN page_number END), 1) AS start_page FROM active GROUP BY site),
own AS (SELECT site, keyword, page_number AS own FROM active WHERE status = 'running'),
p AS (SELECT pg.* FROM pg LEFT JOIN sp ON pg.site = sp.site
                       LEFT JOIN own ON pg.site = own.site AND pg.keyword = own.keyword
      WHERE NOT EXISTS (SELECT 1 FROM st2 WHERE st2.site = pg.site AND st2.keyword = pg.keyword
                                             AND st2.status = 'completed')
        AND pg.page >= coalesce(sp.start_page, 1) AND pg.page >= coalesce(own.own, 1)),
s AS (SELECT *, len(links) AS n_links, CASE WHEN len(links) > 0 THEN array_to_string(links, chr(10)) END AS sig FROM p),
r AS (SELECT *, CASE WHEN sig IS NOT NULL THEN row_number() OVER (PARTITION BY site, keyword, sig ORDER BY page) END AS rn
      FROM s),
r2 AS (SELECT *, CASE WHEN n_links = 0 THEN 'no_links' WHEN rn - 1 >= 1 THEN 'repeated_page' END AS stop_reason FROM r),
stops AS (SELECT site, keyword, min(page) AS stop_page FROM r2 WHERE stop_reason IS NOT NULL GROUP BY site, keyword),
y AS (SELECT r2.site, r2.keyword, r2.page, r2.links FROM r2
      LEFT JOIN stops ON r2.site = stops.site AND r2.keyword = stops.keyword
      WHERE (stops.stop_page IS NULL OR r2.page <= stops.stop_page) AND r2.rn = 1 AND r2.n_links > 0),
rows0 AS (SELECT site, keyword, page, unnest(links) AS url, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos FROM y),
c AS (SELECT rows0.*, st2.page_number AS sp_, st2.last_processed_url AS su, st2.status AS ss
      FROM rows0 LEFT JOIN st2 ON rows0.site = st2.site AND rows0.keyword = st2.keyword),
mk AS (SELECT site, keyword, min(pos) AS mark FROM c WHERE url = su AND page = sp_ GROUP BY site, keyword),
rs AS (SELECT c.site, c.keyword, c.page, c.pos, c.url FROM c
       LEFT JOIN mk ON c.site = mk.site AND c.keyword = mk.keyword
       WHERE NOT coalesce(ss = 'running' AND sp_ IS NOT NULL AND coalesce(su <> '', false), false)
          OR page > sp_ OR (page = sp_ AND (mark IS NULL OR pos > mark))),
fpg AS (SELECT site, url, min(page) AS fp_ FROM rs GROUP BY site, url),
af AS (SELECT rs.* FROM rs JOIN fpg ON rs.site = fpg.site AND rs.url = fpg.url AND rs.page = fpg.fp_),
merged AS (SELECT site, url, min(page) AS page, arg_min(pos, (keyword, pos)) AS pos,
                  array_to_string(list_sort(list_distinct(list(keyword))), ',') AS keywords FROM af GROUP BY site, url),
lst AS (SELECT site, keyword, arg_max(page, (page, pos)) AS lp, arg_max(url, (page, pos)) AS lu
        FROM af GROUP BY site, keyword),
ks AS (SELECT site, keyword FROM st2 UNION SELECT site, keyword FROM stops UNION SELECT site, keyword FROM lst)
"""

ORACLE["search_plan_work"] = _SEARCH_SQL + """
SELECT merged.site, merged.url, merged.page, merged.pos, merged.keywords,
       CASE WHEN ex.url IS NULL THEN 'new' ELSE 'duplicate' END AS kind
FROM merged LEFT JOIN ex ON merged.url = ex.url
"""

ORACLE["search_plan_state"] = _SEARCH_SQL + """
SELECT ks.site, ks.keyword,
       CASE WHEN stops.stop_page IS NOT NULL THEN stops.stop_page ELSE coalesce(lst.lp, st2.page_number) END AS page_number,
       coalesce(lst.lu, st2.last_processed_url) AS last_processed_url,
       CASE WHEN stops.stop_page IS NOT NULL THEN 'completed'
            WHEN lst.lp IS NOT NULL THEN 'running' ELSE coalesce(st2.status, 'running') END AS status
FROM ks LEFT JOIN st2 ON ks.site = st2.site AND ks.keyword = st2.keyword
        LEFT JOIN stops ON ks.site = stops.site AND ks.keyword = stops.keyword
        LEFT JOIN lst ON ks.site = lst.site AND ks.keyword = lst.keyword
"""


ORACLE["serving_copy"] = """
SELECT 'https://example.com/c/' || CAST(o_custkey AS VARCHAR) AS obituary_url,
       min(o_orderkey) AS id, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
       strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS order_date
FROM orders GROUP BY o_custkey
"""


# ------------------------------------------------ further bindings ---

ORACLE["record_lookup"] = """
SELECT c_custkey, c_name, n_name AS city, r_name AS province
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey = 7
"""

ORACLE["target_site"] = """
SELECT DISTINCT 'www' AS subdomain, CAST(NULL AS INTEGER) AS priority_pos
FROM pages WHERE starts_with(lower(split_part(url, '://', 2)), 'www.')
"""

ORACLE["json_records"] = """
SELECT o_orderkey AS id, o_orderstatus AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS publication_date,
       o_orderpriority AS tags FROM orders
"""

ORACLE["custom_keyword_hits"] = """
SELECT doc_id, CASE WHEN contains(lower(text), 'apache license') THEN 'apache license'
                    WHEN contains(lower(text), 'mit license') THEN 'mit license' ELSE 'that' END AS keyword
FROM documents
WHERE contains(lower(text), 'apache license') OR contains(lower(text), 'mit license') OR contains(lower(text), 'that')
"""

ORACLE["appended_records"] = """
SELECT o_orderkey AS id, o_orderstatus AS name, 'https://example.com/o/' || o_orderkey AS obituary_url FROM orders
"""

ORACLE["stream_dedup_watermark"] = "SELECT DISTINCT user_id FROM events"
