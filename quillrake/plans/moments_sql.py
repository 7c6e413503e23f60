"""SQL of the queries over instants: the written forms are those of ``functions.moments``; offsets come from the SQL
engine's own time zones and not from the interval table."""

from __future__ import annotations

from ..functions import moments as M
from ..functions import zones

#: Zones for which the SQL knows abbreviations (those of the test tables' providers and their neighbours).
ZONES = (
    "UTC Europe/London Europe/Dublin Europe/Lisbon Europe/Berlin Europe/Paris Europe/Madrid Europe/Rome Europe/Amsterdam Europe/Vienna Europe/Zurich Europe/Brussels "
    "Europe/Athens Europe/Moscow Europe/Kiev Europe/Istanbul Africa/Johannesburg Africa/Lagos Africa/Nairobi Africa/Cairo America/New_York America/Chicago America/Denver "
    "America/Los_Angeles America/Phoenix America/Toronto America/Halifax America/Mexico_City America/Sao_Paulo America/Argentina/Buenos_Aires America/Bogota America/Lima "
    "America/Santiago Asia/Kolkata Asia/Dubai Asia/Tokyo Asia/Singapore Asia/Hong_Kong Asia/Shanghai Australia/Sydney Australia/Perth Pacific/Auckland"
).split()


def _abbreviations() -> str:
    rows = {(r[0], s[3].upper(), s[2]) for r in zones.local_intervals(ZONES, (2025, 2025)) for s in r[2]}
    return ", ".join(f"('{z}', '{a}', {o})" for z, a, o in sorted(rows))


def _re2(pattern: str) -> str:
    """A Java pattern as the SQL engine reads it: white space of any kind is spelled out."""
    p = pattern.replace("\\u2212", "\u2212").replace(r"[\s\-]", "[\x01\\-]").replace(r"\s", "[\x01]")
    return p.replace("\x01", r"\s\p{Z}").replace("'", "''")


def _parts() -> str:
    out = []
    for tag, pattern, order in M._FORMS:
        p = _re2(pattern)
        part = lambda k, p=p: f"regexp_extract(s, '{p}', {k})" if k < 10 else r"regexp_extract(s, '\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]$', 1)"  # noqa: E731  only nine groups can be had
        out.append(f"WHEN regexp_matches(s, '{p}') THEN ['{tag}', " + ", ".join(map(part, order)) + "]")
    return "CASE " + " ".join(out) + " END"


_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')".format
_MONTHS = "MAP {" + ", ".join(f"'{n}': {m}" for m, names in M.MONTHS.items() for n in names.split()) + "}"
_INT = "TRY_CAST(nullif({0}, '') AS BIGINT)".format


def read(source: str) -> str:
    """CTEs that give ``read`` (the columns of ``source``, utc_ms, moment_status) for a source of (provider_id, raw, others)."""
    hour, half = _INT("g[5]"), "lower(g[9])"
    num = r"replace(regexp_replace(w, '^(?i:UTC|GMT)([+\-])', '\1'), chr(8722), '-')"
    return rf"""src AS ({source}),
ab(zone, abbr, off) AS (VALUES {_abbreviations()}),
named AS (SELECT src.*, {_TRIM("raw")} AS s, {_TRIM("config['timezone']")} AS home, lower({_TRIM("config['date_order']")}) AS ord FROM src LEFT JOIN providers p ON p.id = src.provider_id),
cut AS (SELECT *, regexp_matches(s, '^-?(\d{{9,10}}(\.\d{{1,9}})?|\d{{12,13}}|\d{{15,16}}|\d{{18,19}})$') AS epoch, {_parts()} AS g FROM named),
num AS (SELECT *, {_INT("g[2]")} AS y, g[1] = 'num' AND coalesce(ord, 'dmy') = 'mdy' AS mdy,
  CASE WHEN {half} = '' THEN {hour} WHEN {hour} BETWEEN 1 AND 12 THEN {hour} % 12 + CASE WHEN {half} = 'p' THEN 12 ELSE 0 END END AS hh, {_INT("g[6]")} AS mi, coalesce({_INT("g[7]")}, 0) AS se,
  CAST(left(rpad(g[8], 3, '0'), 3) AS BIGINT) AS fr, CASE WHEN g[10] <> '' THEN g[10] ELSE coalesce(g[11], '') END AS w FROM cut),
day AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d', y, CASE WHEN g[1] = 'named' THEN {_MONTHS}[lower(g[3])] WHEN mdy THEN {_INT("g[4]")} ELSE {_INT("g[3]")} END, CASE WHEN mdy THEN {_INT("g[3]")} ELSE {_INT("g[4]")} END) AS DATE) AS d,
  {num} AS n FROM num),
wall AS (SELECT *, CASE WHEN NOT epoch AND hh BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND se BETWEEN 0 AND 59 THEN epoch_ms(d::TIMESTAMP) + (hh * 3600 + mi * 60 + se) * 1000 + fr END AS local,
  regexp_replace(regexp_replace(n, '[^0-9]', '', 'g'), '^(\d)$', '0\1') AS digits FROM day),
off AS (SELECT *, CASE WHEN upper(w) IN ('Z', 'UTC', 'GMT', 'UT') THEN 0
  WHEN regexp_matches(n, '^[+\-]\d') AND CAST(left(digits, 2) AS INT) <= 18 AND coalesce({_INT("substr(digits, 3, 2)")}, 0) < 60
  THEN (CASE WHEN n LIKE '-%' THEN -1 ELSE 1 END) * (CAST(left(digits, 2) AS INT) * 60 + coalesce({_INT("substr(digits, 3, 2)")}, 0)) * 60000 END AS fixed FROM wall),
zoned AS (SELECT *, CASE WHEN w LIKE '%/%' THEN w ELSE home END AS z, CASE WHEN w NOT LIKE '%/%' THEN nullif(upper(w), '') END AS abbr FROM off),
there AS (SELECT *, fixed IS NULL AND local IS NOT NULL AND z IN (SELECT name FROM pg_timezone_names()) AS clock FROM zoned),
inst AS (SELECT *, CASE WHEN clock THEN timezone(z, make_timestamp(local * 1000)) END AS u FROM there),
cand AS (SELECT *, CASE WHEN clock THEN list_filter([-7200000, -3600000, -1800000, 0, 1800000, 3600000, 7200000], lambda x: epoch_ms(timezone(z, u + to_milliseconds(x))) = local) END AS hits FROM inst),
said AS (SELECT cand.*, (SELECT max(off) FROM ab WHERE ab.zone = z AND ab.abbr = cand.abbr) AS soff FROM cand),
stat AS (SELECT *, CASE WHEN epoch THEN 'fixed' WHEN local IS NULL THEN 'unreadable' WHEN fixed IS NOT NULL THEN 'fixed' WHEN NOT clock THEN 'unknown_zone' WHEN abbr IS NOT NULL AND soff IS NULL THEN 'unreadable'
  WHEN len(hits) = 0 THEN 'skipped' WHEN len(hits) > 1 THEN 'ambiguous' ELSE 'local' END AS moment_status FROM said),
read AS (SELECT * EXCLUDE (s, home, ord, epoch, g, y, mdy, hh, mi, se, fr, w, d, n, local, digits, fixed, z, abbr, clock, u, hits, soff), CASE WHEN epoch THEN CASE WHEN length(regexp_extract(s, '^-?(\d+)', 1)) <= 10 THEN CAST(regexp_extract(s, '^-?\d+') AS BIGINT) * 1000 + CAST(left(rpad(regexp_extract(s, '\.(\d+)', 1), 3, '0'), 3) AS BIGINT)
  WHEN length(s) <= 13 THEN CAST(s AS BIGINT) WHEN length(s) <= 16 THEN CAST(s AS BIGINT) // 1000 ELSE CAST(s AS BIGINT) // 1000000 END
  WHEN moment_status = 'fixed' THEN local - fixed WHEN moment_status IN ('local', 'ambiguous') THEN CASE WHEN abbr IS NOT NULL THEN local - soff ELSE epoch_ms(u + to_milliseconds(list_min(hits))) END END AS utc_ms FROM stat)"""


TEXTS = """SELECT 'sitemap_entries' AS tab, entry_id AS row_id, provider_id, news.publication_date AS raw FROM sitemap_entries
UNION ALL SELECT 'articles', row_id, provider_id, published_at FROM articles UNION ALL SELECT 'harvest_events', delivery_id, provider_id, collected_at FROM harvest_events"""
EVENTS = "SELECT delivery_id, provider_id, article.id AS article_id, article.title AS title, article.url AS url, collected_at AS raw FROM harvest_events"
_COPIES = "SELECT *, provider_id IS NOT NULL AND article_id IS NOT NULL AND utc_ms IS NOT NULL AND row_number() OVER (PARTITION BY provider_id, article_id, utc_ms ORDER BY delivery_id) > 1 AS copy FROM read"


def oracles() -> dict[str, str]:
    texts, events = f"WITH {read(TEXTS)}", f"WITH {read(EVENTS)}, c AS ({_COPIES})"
    return {
        "p5_found": rf"{texts} SELECT tab, row_id, utc_ms FROM read WHERE utc_ms IS NOT NULL AND NOT regexp_matches(raw, '{M.CANONICAL}')",
        "p5_status": f"{texts} SELECT tab, provider_id, moment_status, count(*) AS texts FROM read GROUP BY ALL",
        "p2_found": f"{events} SELECT delivery_id FROM c WHERE copy",
        "p2_messages": f"{events} SELECT delivery_id, provider_id, article_id, utc_ms AS collected_ms, title, url FROM c WHERE NOT copy",
    }
