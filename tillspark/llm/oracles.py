"""SQL of the text operators for DuckDB, where SQL can say what they compute."""

from __future__ import annotations

from . import manifest

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(name: str) -> str:
    return (f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR)::VARCHAR || ':' "
            f"|| {name}::VARCHAR END")


def _leaf(text: str) -> str:
    head = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"sha256({head} || {text})"


def _tree(nodes: str, prefix: str, levels: int) -> tuple[list[str], str]:
    """CTEs of a tree over ``nodes`` (grp, i, d), unrolled, and the root's name."""
    out = []
    for k in range(levels):
        below = nodes if k == 0 else f"{prefix}{k}"
        out.append(f"{prefix}runs{k} AS (SELECT grp, i // {manifest.ARITY} AS run, "
                   f"list(d ORDER BY i) AS ds, max(size) AS size FROM (SELECT *, "
                   f"count(*) OVER (PARTITION BY grp) AS size FROM {below}) GROUP BY grp, run)")
        out.append(f"{prefix}{k + 1} AS (SELECT grp, run AS i, CASE WHEN size = 1 THEN ds[1] "
                   f"ELSE sha256(array_to_string(ds, '')) END AS d FROM {prefix}runs{k})")
    return out, f"{prefix}{levels}"


def _climb(start: str, prefix: str, name: str, levels: int) -> tuple[list[str], str]:
    """CTEs that follow each row of ``start`` (grp, i, p, f, ...) up a tree."""
    out = []
    for k in range(levels):
        below = start if k == 0 else f"{name}{k}"
        left, right = "array_to_string(ds[1:pos], '')", "array_to_string(ds[pos + 2:], '')"
        out.append(
            f"{name}{k + 1} AS (SELECT s.* EXCLUDE (p, f, pos, ds, size), "
            f"CASE WHEN size = 1 THEN p ELSE p || {left} || {right} END AS p, "
            f"CASE WHEN size = 1 THEN f ELSE sha256({left} || f || {right}) END AS f FROM ("
            f"SELECT b.*, (b.i // {manifest.ARITY ** k}) % {manifest.ARITY} AS pos, "
            f"r.ds, r.size FROM {below} b JOIN {prefix}runs{k} r ON b.grp = r.grp "
            f"AND b.i // {manifest.ARITY ** (k + 1)} = r.run) s)")
    return out, f"{name}{levels}"


def merkle(levels: int = 11, source_levels: int = 7) -> str:
    """The manifest's rows; the trees are unrolled to these heights."""
    steps = ("list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform("
             "string_split(doc_id::VARCHAR, ''), lambda ch: list_prepend(ascii(ch)::BIGINT, "
             "[-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda c, x: "
             "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 "
             "THEN xor(c // 2, 3988292384) ELSE c // 2 END)")
    cut = _field("replace(text, chr(10), '')")
    leaves = (
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) "
        "- 1 AS i FROM (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END "
        f"AS grp, {_leaf(_field('text'))} AS d, CASE WHEN {steps} % 2 = 1 "
        f"THEN {_leaf(cut)} ELSE {_leaf(_field('text'))} END AS bent FROM documents))")
    tree, roots = _tree("leaves", "t", levels)
    subs = (f"subs AS (SELECT '' AS grp, grp AS own, d, "
            f"row_number() OVER (ORDER BY encode(grp)) - 1 AS i FROM {roots})")
    top_tree, top = _tree("subs", "u", source_levels)
    climbs, done = _climb("starts", "t", "c", levels)
    starts = "starts AS (SELECT doc_id, grp, i, d AS leaf, '' AS p, bent AS f FROM leaves)"
    middle = (f"middle AS (SELECT m.doc_id, m.leaf, s.d AS subroot, s.grp, s.i, m.p, m.f "
              f"FROM {done} m JOIN subs s ON m.grp = s.own)")
    top_climbs, last = _climb("middle", "u", "e", source_levels)
    ctes = [leaves, *tree, subs, *top_tree, starts, *climbs, middle, *top_climbs]
    return (f"WITH {', '.join(ctes)} SELECT v.doc_id, v.leaf, v.subroot, r.d AS root, "
            f"sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = r.d AS verified "
            f"FROM {last} v, {top} r")


def phrases(least: int = 100, best: int = 2000) -> str:
    """The collocations' rows."""
    return rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM pieces, (SELECT unnest(range(1, 6)) AS k))
  GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c
  FROM f WHERE k > 1),
scores AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.a AS l, y.a AS r, s.n, c.c,
         (1000 * c.a::HUGEINT * s.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.c], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1:], ' ')
  JOIN sizes s ON s.lang = c.lang),
lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m
              FROM f WHERE k > 2))
  GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase
      WHERE i.a IS NULL OR i.a < o.a)
QUALIFY rank <= {best}"""


def archives() -> str:
    """The index of all pages; the SHA-1 in base 32, five hex digits at a time."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = "CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS INT), 5) AS BIGINT)"
    coded = (f"list_aggregate(list_transform(range(32), lambda k: substr('{digits}', CAST("
             f"1 + (({group} >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '')")
    key = ("list_aggregate(list_reverse(string_split(regexp_replace(parts.host, '^www\\.', ''), '.')),"
           " 'string_agg', ',') || ')' || CASE WHEN parts.path = '' THEN '/' ELSE parts.path END"
           " || CASE WHEN parts.query IN ('', '?') THEN '' ELSE parts.query END")
    return f"""WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
        sha1(coalesce(html, '')) AS h, regexp_extract(lower(url[:8]) || url[9:],
          '^https?://([^/?#:]*)[^/?#]*([^?#]*)([^#]*)', ['host', 'path', 'query']) AS parts
      FROM pages),
    first AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS best FROM hashed)
    SELECT page_id, payload_bytes, {coded} AS payload_digest,
      CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> best THEN best END AS refers_to, {key} AS url_key,
      strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS time,
      true AS verified FROM first"""


def dated_list() -> str:
    """Pages against the intervals of the list that is made of their own names."""
    first = "1704067200 + (CAST('0x' || substr(md5(key), 1, 4) AS BIGINT) % 300) * 86400"
    stay = "(1 + CAST('0x' || substr(md5(key), 5, 4) AS BIGINT) % 60) * 86400"
    at = "make_timestamp(CAST({} AS BIGINT) * 1000000)"
    return f"""WITH seen AS (SELECT page_id, url,
        {at.format("1704067200 + 60 * ((page_id * 7) % 525600)")} AS fetched,
        regexp_replace(regexp_extract(lower(coalesce(url, '')),
          '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.$', '') AS host,
        regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
    named AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END AS address,
        string_split(host, '.') AS labels FROM seen),
    entries AS (SELECT DISTINCT unnest([host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1), address])
        AS key FROM named WHERE host <> ''),
    dated AS (SELECT key, {first} AS f, {stay} AS s FROM entries WHERE key <> ''),
    spans AS (SELECT key, {at.format("f")} AS valid_from, {at.format("f + s")} AS valid_to FROM dated
      UNION ALL SELECT key, {at.format("f + 2 * s")}, NULL FROM dated),
    keyed AS (SELECT DISTINCT page_id, fetched, unnest(list_append(list_transform(
        range(1, greatest(len(labels) - 1, 1) + 1),
        lambda i: list_aggregate(labels[i:], 'string_agg', '.')), address)) AS key
      FROM named WHERE host <> ''),
    hits AS (SELECT page_id, count(*) AS n, arg_max(key, (length(key), key)) AS entry,
        arg_max(valid_from, (length(key), key)) AS valid_from
      FROM keyed JOIN spans USING (key)
      WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY 1)
    SELECT page_id, CASE WHEN url IS NOT NULL THEN host END AS host, fetched, n IS NOT NULL AS blocked,
      coalesce(n, 0) AS n_entries, entry, valid_from FROM named LEFT JOIN hits USING (page_id)"""


ORACLES = {"op4_dated_url_list": dated_list(), "op9_warc_index": archives(),
           "op12_merkle_manifest": merkle(), "op13_phrase_collocations": phrases()}
