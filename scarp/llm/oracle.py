"""SQL that must give the same rows as the queries of this subpackage."""

from __future__ import annotations

_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_ID = r"'CHEMBL' || nullif(regexp_extract(upper({c}), '^\s*CHEMBL[\s_:#-]*0*([1-9]\d*)\s*$', 1), '')"
_FLAG = r"regexp_matches(regexp_replace(lower(trim(activity_flag)), '[\s._-]+', '', 'g'), '^(active|act|1|inactive|inact|(not|non)act(ive)?|0)$')"
_USABLE = {"activity_flag": _FLAG, "standard_value": "standard_value > 0 AND NOT isnan(standard_value)", "pic50": "NOT isnan(pic50) AND abs(pic50) < 50"}
_ENDS = "SELECT nullif({a}, '') AS a, nullif({b}, '') AS b FROM activity_cliffs".format(a=_STRIP.format(c="mol_i"), b=_STRIP.format(c="mol_j"))
_TOKEN = r"nullif(regexp_replace(trim(fragment), '\[(?:\d+\*|\*:\d+|\d+\*:\d+)\]', '[*]', 'g'), '')"

_SIMILAR = f"""t AS (SELECT DISTINCT mol_id, {_TOKEN} AS tok FROM fragment_membership WHERE mol_id IS NOT NULL AND {_TOKEN} IS NOT NULL), n AS (SELECT mol_id, count(*) AS n FROM t GROUP BY 1),
        o AS (SELECT a.mol_id AS a, b.mol_id AS b, count(*) AS o FROM t a JOIN t b ON a.tok = b.tok AND a.mol_id < b.mol_id GROUP BY 1, 2),
        f AS (SELECT a, b, o / (x.n + y.n - o) AS sim FROM o JOIN n x ON x.mol_id = a JOIN n y ON y.mol_id = b WHERE 5 * o >= 4 * (x.n + y.n - o))"""

_BEST = f"""reg AS (SELECT smi, min(id) AS found FROM (SELECT {_STRIP.format(c='canonical_smiles')} AS smi, {_ID.format(c='chembl_id')} AS id FROM chemical_space) WHERE id IS NOT NULL GROUP BY 1),
        src AS (SELECT source_name, min(trust_rank) AS trust_rank FROM data_sources GROUP BY 1),
        raw AS (SELECT *, {_ID.format(c='chembl_id')} AS id, nullif({_STRIP.format(c='canonical_smiles')}, '') AS smi FROM removed_compounds WHERE record_id IS NOT NULL),
        r AS (SELECT raw.* EXCLUDE (smi), coalesce(id, found, '=' || raw.smi) AS compound, trust_rank FROM raw LEFT JOIN reg ON reg.smi = raw.smi LEFT JOIN src ON src.source_name = raw.source_name WHERE id IS NOT NULL OR raw.smi IS NOT NULL),
        several AS (SELECT compound FROM r GROUP BY 1 HAVING min(record_id) < max(record_id)),
        f AS ({' UNION ALL '.join(f"SELECT compound, '{n}' AS field_name, record_id, trust_rank, curated_at, activity_flag, standard_value, pic50 FROM r WHERE {u}" for n, u in _USABLE.items())}),
        best AS (SELECT * FROM f WHERE compound IN (SELECT compound FROM several) QUALIFY row_number() OVER (PARTITION BY compound, field_name ORDER BY trust_rank NULLS LAST, curated_at DESC NULLS LAST, record_id) = 1)"""

ORACLE_SQL = {
    "p1_found": f"WITH {_BEST} SELECT CASE WHEN compound NOT LIKE '=%' THEN compound END AS chembl_id, field_name, record_id FROM best",
    "p1_merged_records": f"""WITH {_BEST} SELECT CASE WHEN compound NOT LIKE '=%' THEN compound END AS chembl_id,
        max(CASE WHEN field_name = 'activity_flag' THEN CASE WHEN regexp_matches(regexp_replace(lower(trim(activity_flag)), '[\\s._-]+', '', 'g'), '^(active|act|1)$') THEN 1 ELSE 0 END END)::DOUBLE AS is_active,
        max(CASE WHEN field_name = 'standard_value' THEN standard_value END) AS standard_value, max(CASE WHEN field_name = 'pic50' THEN pic50 END) AS pic50,
        {', '.join(f"max(CASE WHEN field_name = '{n}' THEN record_id END)::DOUBLE AS {n}_from" for n in _USABLE)} FROM best GROUP BY compound""",
    "p1_top_records": f"""WITH {_BEST} SELECT compound, record_id, n_usable FROM (SELECT *, {' + '.join(f"CASE WHEN coalesce({u}, false) THEN 1 ELSE 0 END" for u in _USABLE.values())} AS n_usable FROM r)
        QUALIFY row_number() OVER (PARTITION BY compound ORDER BY n_usable DESC, trust_rank NULLS LAST, curated_at DESC NULLS LAST, record_id) = 1""",
    "p5_checks": "SELECT least(500, count(DISTINCT trim(smiles))) AS n, least(500, count(DISTINCT trim(smiles))) AS n_structures, 0 AS n_strange FROM hits WHERE trim(smiles) <> ''",
    "p7_checks": "SELECT budget_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_texts, 0 AS n_overfull, 0 AS n_cut, 0 AS n_broken FROM pack_budgets",
    "p8_checks": "SELECT doc_source, 0 AS n_beyond, 0 AS n_twice, 0 AS n_strange FROM mix_targets",
    "p4_found": f"""WITH RECURSIVE l AS (SELECT * FROM ({_ENDS}) WHERE a IS NOT NULL AND b IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c AS (SELECT a AS mol, a AS g FROM e UNION SELECT e.b, c.g FROM c JOIN e ON e.a = c.mol WHERE c.g < e.b) SELECT min(g) AS group_mol, mol FROM c GROUP BY mol""",
    "p6_found": f"WITH {_SIMILAR} SELECT a AS mol_a, b AS mol_b FROM f",
    "p6_similar_pairs": f"WITH {_SIMILAR} SELECT a AS mol_i, b AS mol_j, sim FROM f",
    "p6_similar_sets": f"""WITH {_SIMILAR}, l AS (SELECT mol_id, list(tok ORDER BY tok) AS toks FROM t GROUP BY 1), e AS (SELECT a AS mol_id FROM f UNION ALL SELECT b FROM f)
        SELECT mol_id, min(mol_id) OVER (PARTITION BY toks) AS class_id, count(*) OVER (PARTITION BY toks) AS copies, (SELECT count(*) FROM e WHERE e.mol_id = l.mol_id) AS n_links FROM l""",
}
