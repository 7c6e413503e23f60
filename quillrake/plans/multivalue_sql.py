"""SQL of ``p6_found`` by a rule that was written down beforehand, against which what the operator learns is held.

The rule: delimiters of ``HARD`` separate, those of ``SOFT`` only between blanks; quoted spans are hidden from the split.
"""

from __future__ import annotations

from ..operators.multivalue import HARD, SOFT

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')".format
_SPAN = r'"(?:[^"]|"")*"|“[^“”]*”|„[^„“]*“|«[^«»]*»'
#: Characters of private use that stand for delimiters inside of quotes.
_SHOWN, _HIDDEN = HARD + SOFT, "".join(chr(0xE100 + k) for k in range(len(HARD + SOFT)))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "-]\\^[" else c for c in chars) + "]"


def oracle() -> str:
    blank, soft = r"[\s\p{Z}]+", _class(SOFT)
    cut = f"{_class(HARD)}|{blank}{soft}(?:{blank}{soft})*{blank}"
    quoted = " OR ".join(f"(v[1] = '{a}' AND v[-1] = '{b}')" for a, b in ('""', "“”", "„“", "«»"))
    bare = f"CASE WHEN length(v) >= 2 AND ({quoted}) THEN {_TRIM('replace(v[2:-2], v[-1] || v[-1], v[-1])')} ELSE v END"
    shown = _TRIM(f"translate(x, '{_HIDDEN}', '{_SHOWN}')")
    return rf"""WITH t AS (SELECT 'sitemap_entries' AS tab, entry_id AS row_id, news.keywords AS text, NULL::VARCHAR[] AS listed FROM sitemap_entries UNION ALL SELECT 'articles', row_id, array_to_string(keywords, ', '), keywords FROM articles),
u AS (SELECT tab, row_id, listed, CASE WHEN regexp_full_match(text, '(?s)\s*\[\s*".*"\s*\]\s*') THEN regexp_replace(text, '(?s)^\s*\[(.*)\]\s*$', '\1')
  WHEN regexp_full_match(text, '\s*#[^\s#][^#]*(\s#[^\s#][^#]*)*') THEN regexp_replace(text, '(^|\s)#', ',', 'g') ELSE text END AS s FROM t WHERE text IS NOT NULL),
k AS (SELECT *, list_reduce(list_prepend(s, list_distinct(regexp_extract_all(s, '{_SPAN}'))), lambda a, x: replace(a, x, translate(x, '{_SHOWN}', '{_HIDDEN}'))) AS m FROM u),
p AS (SELECT *, list_filter(list_transform(list_transform(regexp_split_to_array(m, '{cut}'), lambda x: {shown}), lambda v: {bare}), lambda v: v <> '') AS vals FROM k),
f AS (SELECT * FROM p WHERE CASE WHEN tab = 'articles' THEN listed IS DISTINCT FROM vals ELSE len(vals) >= 2 END)
SELECT tab, row_id, generate_subscripts(vals, 1)::BIGINT AS pos, unnest(vals) AS val FROM f"""
