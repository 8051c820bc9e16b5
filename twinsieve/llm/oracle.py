"""DuckDB SQL for the operators that SQL can express."""

from twinsieve.llm import decontaminate, license_scan, mixing, secret_scan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- secrets


def _rule_spans(rank: int, rule: secret_scan.Rule) -> str:
    rx = _quoted(rule.pattern)
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {rx})) + 1), lambda i: {{
        'start': coalesce(list_sum(list_transform(string_split_regex(t, {rx})[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(regexp_extract_all(t, {rx})[1:i-1], lambda x: length(x))), 0),
        'rank': {rank},
        'size': length(regexp_extract_all(t, {rx})[i]),
        'part': length(regexp_extract_all(t, {rx}, {rule.group})[i])}}), lambda s: s.part >= {rule.least})"""


_NAMES = "[" + ", ".join(_quoted(r.kind) for r in secret_scan.RULES) + "]"
_TEXT_OF = f"""array_to_string(list_transform({{}}, lambda s:
    {_NAMES}[s.rank + 1] || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT), ',')"""
_RANKS = range(len(secret_scan.RULES))

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
each_rule AS (SELECT doc_id, {", ".join(f"{_rule_spans(i, r)} AS r{i}" for i, r in enumerate(secret_scan.RULES))} FROM d),
s AS (SELECT doc_id, list_sort(list_concat(r0, r1, r2)) AS base,
             list_sort(flatten([{", ".join(f"r{i}" for i in _RANKS)}])) AS every, r0, r1, r2 FROM each_rule)
SELECT doc_id, len(r0)::BIGINT AS n_assign, len(r1)::BIGINT AS n_access, len(r2)::BIGINT AS n_hex,
       sha256({_TEXT_OF.format("base")}) AS base_sha256, {_TEXT_OF.format("every")} AS spans
FROM s"""

# ---------------------------------------------------------------- mixing

_WHEN = lambda column, weights: (
    f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"
)


def _share(name: str, source: str, parent: str, own: str, budget: str, weight: str) -> str:
    """CTEs that split `budget` of each parent over `own`, as `name` (own, got)."""
    return f"""
{name}_in AS (SELECT {own}, sum(room)::BIGINT AS cap, max({budget}) AS b, ({weight})::BIGINT AS w FROM {source} GROUP BY ALL),
{name}_run AS (SELECT *,
    (b - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    >= cap * (sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS is_full
    FROM {name}_in),
{name} AS (SELECT {own}, CASE WHEN is_full THEN cap ELSE
    ((w * (b - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {parent}), 0)))::HUGEINT
     // greatest(sum(w) FILTER (NOT is_full) OVER (PARTITION BY {parent}), 1)::HUGEINT)::BIGINT END AS got
    FROM {name}_run)"""


def mixing_sql(domains: dict[str, int], langs: dict[str, int], percent: int = 60, epochs: int = 2, seed: int = 29) -> str:
    number = "regexp_extract(source, '([0-9]{1,9})$', 1)"
    key = f"md5('{seed}:' || whole || ':' || unit)"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    coalesce('domain' || (try_cast({number} AS INT) % 4), 'other') AS dom FROM documents),
r AS (SELECT doc_id, dom, coalesce(lang, '') AS la, coalesce(source, '') AS so, lang, source,
    len(regexp_extract_all(t, {_quoted(mixing.WORD)}))::BIGINT AS n,
    coalesce(doc_id::VARCHAR, '') || ':' || md5(t) AS unit FROM d),
leaf AS (SELECT dom, la, so, sum(n)::BIGINT AS have, sum(n)::BIGINT * {epochs} AS room FROM r GROUP BY ALL),
l0 AS (SELECT *, ((SELECT sum(have) FROM leaf) * {percent} // 100)::BIGINT AS b0 FROM leaf),
{_share("s1", "l0", "1", "dom", "b0", _WHEN("dom", domains))},
l1 AS (SELECT l0.*, got AS b1 FROM l0 JOIN s1 USING (dom)),
{_share("s2", "l1", "dom", "dom, la", "b1", _WHEN("la", langs))},
l2 AS (SELECT l1.*, got AS b2 FROM l1 JOIN s2 USING (dom, la)),
{_share("s3", "l2", "dom, la", "dom, la, so", "b2", "1")},
plan AS (SELECT l2.*, got AS budget, got // have AS whole, got % have AS rest
         FROM l2 JOIN s3 USING (dom, la, so) WHERE have > 0 AND got > 0),
k AS (SELECT r.*, budget, whole, rest, {key} AS k FROM r JOIN plan USING (dom, la, so)),
run AS (SELECT *, sum(n) OVER (PARTITION BY dom, la, so ORDER BY k) <= rest AND rest > 0 AS in_next FROM k)
SELECT doc_id, dom AS domain, lang, source, n AS n_words,
       unnest(range(0, (whole + in_next::BIGINT)::BIGINT))::INT AS epoch, budget AS leaf_budget
FROM run"""


# ---------------------------------------------------------------- contamination

_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), "
    f"{_quoted(decontaminate.WORD)})"
)
CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (SELECT item_id, size, unnest(list_transform(range(1, len(w) - size + 2),
            lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g
          FROM (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
mine AS (SELECT id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2),
            lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g
         FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT DISTINCT id, pos, mine.size, item_id FROM mine JOIN grams ON mine.g = grams.g AND mine.size = grams.size),
words AS (SELECT id, count(DISTINCT p) AS n_hit
          FROM (SELECT id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT id, pos, size FROM hit)) GROUP BY id),
items AS (SELECT id, count(DISTINCT item_id) AS n_items,
                 sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256
          FROM hit GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN items USING (id)"""

# ---------------------------------------------------------------- licences


def _canonical(text: str) -> str:
    line = license_scan.COPYRIGHT_LINE.replace("(?md)", "(?m)")
    out = f"regexp_replace(lower({text}), {_quoted(line)}, ' ', 'g')"
    for spelling, usual in license_scan.SPELLINGS.items():
        out = f"replace({out}, {_quoted(spelling)}, {_quoted(usual)})"
    return out


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in license_scan.LICENSES)
_BARE = r"trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
LICENSES = f"""
WITH k AS (SELECT name, {_BARE.format(_canonical("text"))} AS c FROM (VALUES {_KNOWN}) AS v(name, text)),
known AS (SELECT md5(c) AS digest, array_to_string(list_sort(list(DISTINCT name)), ' OR ') AS name FROM k WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS id, doc_id, {_canonical("coalesce(text, '')")} AS c FROM documents),
l AS (SELECT DISTINCT id, md5({_BARE.format("x")}) AS digest
      FROM (SELECT id, unnest(string_split(c, chr(10))) AS x FROM d)),
hit AS (SELECT id, count(DISTINCT digest) AS n, array_to_string(list_sort(list(DISTINCT name)), ',') AS names
        FROM l JOIN known USING (digest) GROUP BY id),
whole AS (SELECT id, doc_id, md5({_BARE.format("c")}) AS digest FROM d)
SELECT doc_id, whole.digest, known.name AS license, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(names, '') AS line_licenses
FROM whole LEFT JOIN hit USING (id) LEFT JOIN known ON whole.digest = known.digest"""
