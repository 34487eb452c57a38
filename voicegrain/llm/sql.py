"""SQL of operators 11 to 13 for the comparison; levels and rounds are written out."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PART = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc(column: str) -> str:
    """CRC-32 of the decimal digits of ``column``, bit by bit."""
    bit = "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(x, y), range(8)), {bit})"
    codes = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda x, y: {byte}), 4294967295)"


def merkle(levels: int = 4, fanout: int = 16) -> str:
    """Trees of up to ``fanout ** levels`` leaves."""
    n = fanout
    ctes = [
        f"d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc('doc_id')} % 5 = 0 THEN {_leaf(_LOW)} END AS changed FROM documents)",
        "l AS (SELECT *, coalesce('1' || source, '0') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM d)",
        "n0 AS (SELECT tree, i0 AS i, leaf AS h FROM l)",
    ]
    for name in ("n", "m"):
        if name == "m":
            ctes.append(f"m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS name FROM n{levels})")
        for k in range(1, levels + 1):  # the runs of a level, and their digests or the node that remains as it is
            ctes += [
                f"{name}r{k} AS (SELECT tree, i // {n} AS r, string_agg(h, '' ORDER BY i) AS run, any_value(t) AS t FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS t FROM {name}{k - 1}) GROUP BY tree, i // {n})",
                f"{name}{k} AS (SELECT tree, r AS i, CASE WHEN t = 1 THEN run ELSE sha256(run) END AS h FROM {name}r{k})",
            ]
    ctes.append(f"f0 AS (SELECT l.doc_id, l.leaf, l.tree, l.i0 AS n, m0.i AS m, m0.h AS subroot, top.h AS root, '' AS siblings, coalesce(changed, leaf) AS folded FROM l JOIN m0 ON m0.name = l.tree CROSS JOIN m{levels} AS top)")
    step = 0
    for name in ("n", "m"):
        for k in range(1, levels + 1):
            place = f"CAST(f.{name} // {n ** (k - 1)} % {n} * 64 AS BIGINT)"
            left, right = f"substr(r.run, 1, {place})", f"substr(r.run, {place} + 65)"
            ctes.append(
                f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN r.t = 1 THEN siblings ELSE siblings || {left} || {right} END AS siblings, CASE WHEN r.t = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded) "
                f"FROM f{step} f JOIN {name}r{k} r ON r.tree = {'f.tree' if name == 'n' else chr(39) * 2} AND r.r = f.{name} // {n**k})"
            )
            step += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{step}"


def substrings(window: int = 20) -> str:
    """For tables of one row an id."""
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, i) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {window})) AS p FROM r) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)) a
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS p FROM g) b WHERE a.doc_id = b.doc_id AND a.p = b.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def kmeans(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    ctes = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS (SELECT r, j, v[j] AS c FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS j FROM v))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id) - 1 AS cluster FROM v QUALIFY cluster < {k})",
        "c0 AS (SELECT cluster, j, c FROM s JOIN x USING (r))",
    ]
    for t in range(rounds + 1):
        ctes.append(f"d{t} AS (SELECT x.r, c{t}.cluster, CAST(sum((x.c - c{t}.c) * (x.c - c{t}.c)) AS BIGINT) AS d FROM x JOIN c{t} USING (j) GROUP BY ALL)")
        ctes.append(f"a{t} AS (SELECT r, cluster, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)")
        if t < rounds:
            mean = "CAST(sum(x.c) // count(*) AS BIGINT) - CASE WHEN sum(x.c) % count(*) < 0 THEN 1 ELSE 0 END"
            ctes.append(f"m{t} AS (SELECT a{t}.cluster, x.j, {mean} AS c FROM a{t} JOIN x USING (r) GROUP BY ALL)")
            ctes.append(f"c{t + 1} AS (SELECT c{t}.cluster, c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (cluster, j))")
    return f"""WITH {", ".join(ctes)}, h AS (SELECT cluster, sha256(string_agg(c, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (cluster)"""
