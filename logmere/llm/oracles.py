"""DuckDB SQL giving the same rows as the query of the same name."""

from __future__ import annotations


def _vector_codes() -> str:
    """Two rounds of moving the codebooks, then the codes; distances by direct subtraction."""
    parts = """
WITH given AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbers AS (SELECT rid, vec_id, label, unnest(list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x,
    unnest(range(len(embedding))) AS spot, len(embedding) // 16 AS width, embedding FROM given),
pieces AS (SELECT rid, spot // width AS part, spot % width AS place, x FROM numbers),
first_ones AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS entry
  FROM given QUALIFY entry < 64),
book0 AS (SELECT part, entry, place, x AS c FROM pieces JOIN first_ones USING (rid))"""
    for k in range(3):
        parts += f""",
far{k} AS (SELECT p.rid, p.part, b.entry, sum((p.x - b.c) * (p.x - b.c)) AS d
  FROM pieces p JOIN book{k} b USING (part, place) GROUP BY ALL),
near{k} AS (SELECT rid, part, entry, d FROM far{k}
  QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1)"""
        if k < 2:
            parts += f""",
sums{k} AS (SELECT p.part, n.entry, p.place, sum(p.x) AS s, count(*) AS n
  FROM pieces p JOIN near{k} n USING (rid, part) GROUP BY ALL),
book{k + 1} AS (SELECT b.part, b.entry, b.place,
    CASE WHEN s.n IS NULL THEN b.c ELSE CAST((s.s - ((s.s % s.n + s.n) % s.n)) // s.n AS BIGINT) END AS c
  FROM book{k} b LEFT JOIN sums{k} s USING (part, entry, place))"""
    return parts + """,
coded AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code,
  CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY rid)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM coded JOIN given USING (rid)"""


#: Levels that the SQL spells out: up to 8^7 documents a language, and 8^3 languages.
LEVELS, UPPER_LEVELS = 7, 3


def _siblings(name: str, level: str) -> str:
    return f""",
{name} AS (SELECT a.g, a.spot,
    coalesce(string_agg(b.d, '' ORDER BY b.spot) FILTER (b.spot < a.spot), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.spot) FILTER (b.spot > a.spot), '') AS r
  FROM {level} a JOIN {level} b ON a.g IS NOT DISTINCT FROM b.g AND a.spot // 8 = b.spot // 8
  WHERE a.n > 1 GROUP BY a.g, a.spot)"""


def _merkle_manifest() -> str:
    def leaf(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        framed_all = ", ".join(
            f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values
        )
        return f"sha256(concat({framed_all}))"

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(text, '{capitals}', '{capitals.lower()}')"

    def climb(name: str, levels: int) -> str:
        return "".join(
            f""",
{name}{k + 1} AS (SELECT g, spot // 8 AS spot, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY spot)) AS d
  FROM (SELECT g, spot, n, d FROM {name}{k} WHERE n > 1) GROUP BY g, spot // 8, n)"""
            for k in range(levels)
        )

    def tops(name: str, levels: int) -> str:
        return " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1))

    sql = f"""
WITH crcs AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS steps),
leaves AS (SELECT doc_id, lang AS g, {leaf("text")} AS leaf,
    CASE WHEN xor(4294967295, list_reduce(
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295)) % 3 = 0
    THEN {leaf(lower)} END AS changed
  FROM documents, crcs),
low0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
    count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM leaves)"""
    sql += climb("low", LEVELS)
    sql += f""",
subroots AS ({tops("low", LEVELS)}),
top0 AS (SELECT 0 AS g, g AS lang, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS spot,
    count(*) OVER () AS n FROM subroots)"""
    sql += climb("top", UPPER_LEVELS) + f""",
roots AS ({tops("top", UPPER_LEVELS)})"""
    steps = [("low", k) for k in range(LEVELS)] + [("top", k) for k in range(UPPER_LEVELS)]
    for name, k in steps:
        sql += _siblings(f"{name}_siblings{k}", f"{name}{k}")
    joins, proof, fold = "", [], "coalesce(x.changed, x.leaf)"
    for name, k in steps:
        s, node = f"{name[0]}{k}", "x" if name == "low" else "t"
        joins += (
            f"\nLEFT JOIN {name}_siblings{k} {s} ON {s}.g IS NOT DISTINCT FROM {node}.g"
            f" AND {s}.spot = {node}.spot // {8**k}"
        )
        proof.append(f"coalesce({s}.l || {s}.r, '')")
        fold = f"CASE WHEN {s}.l IS NULL THEN {fold} ELSE sha256({s}.l || {fold} || {s}.r) END"
        # One expression after another: each stands twice in the next.
        sql_name = f"f_{s}"
        joins += f"\nCROSS JOIN LATERAL (SELECT {fold} AS v) {sql_name}"
        fold = f"{sql_name}.v"
    return sql + f"""
SELECT x.doc_id, x.leaf, t.d AS subroot, (SELECT d FROM roots) AS root,
  sha256(concat({", ".join(proof)})) AS proof_sha256, {fold} AS folded_root,
  {fold} = (SELECT d FROM roots) AS verified
FROM low0 x JOIN top0 t ON x.g IS NOT DISTINCT FROM t.lang{joins}"""


ORACLES: dict[str, str] = {
    "op11_vector_codes": _vector_codes(),
    "op13_merkle_manifest": _merkle_manifest(),
}
