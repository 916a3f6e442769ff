"""Building blocks of the SQL checks (DuckDB)."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\r\f]+'), lambda w: len(w) > 0)"
NAMES = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: len(w) > 0)"


def words(text: str) -> str:
    return WORDS.format(text)


def names(text: str) -> str:
    return NAMES.format(text)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def counts(name: str, source: str, key: str, text: str, dim: int = 64, unit: str = "char") -> str:
    """CTEs ``name_c(key, b, n)``: how often each bucket occurs in a text."""
    norm = f"lower(strip_accents({text}))"
    if unit == "char":
        grams = (f"SELECT {key}, unnest(list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i+1] || ch[i+2])) AS g "
                 f"FROM (SELECT {key}, string_split(' ' || {norm} || ' ', '') AS ch FROM {source})")
    else:
        grams = f"SELECT {key}, unnest({words(norm)}) AS g FROM {source}"
    return (f"{name}_g AS ({grams}),\n{name}_c AS (SELECT {key}, ('0x' || substr(md5(g), 1, 8))::BIGINT % {dim} AS b, "
            f"count(*) AS n FROM {name}_g GROUP BY ALL)")


def dense(name: str, source: str, key: str, counted: str, dim: int = 64, value: str = "n") -> str:
    """CTE ``name(key, vec, nrm)``: unit vectors in float precision from bucket counts."""
    return (
        f"{name}_s AS (SELECT {key}, sqrt(sum({value} * {value})) AS s FROM {counted} GROUP BY ALL),\n"
        f"{name}_d AS (SELECT {key}, unnest(range({dim})) AS b FROM (SELECT DISTINCT {key} FROM {source})),\n"
        f"{name}_v AS (SELECT {key}, list(coalesce(({value} / s)::FLOAT, 0)::DOUBLE ORDER BY b) AS vec "
        f"FROM {name}_d LEFT JOIN {counted} USING ({key}, b) LEFT JOIN {name}_s USING ({key}) GROUP BY {key}),\n"
        f"{name} AS (SELECT {key}, vec, sqrt(list_dot_product(vec, vec)) AS nrm FROM {name}_v)")


def encoded(name: str, source: str, key: str, text: str, dim: int = 64, unit: str = "char") -> str:
    """CTE ``name(key, vec, nrm)`` with the default encoder's vectors of ``text``."""
    return counts(name, source, key, text, dim, unit) + ",\n" + dense(name, source, key, f"{name}_c", dim)


def cosine(a: str, b: str) -> str:
    return (f"CASE WHEN {a}.nrm = 0 OR {b}.nrm = 0 THEN 0.0 "
            f"ELSE round(list_dot_product({a}.vec, {b}.vec) / ({a}.nrm * {b}.nrm), 6) END")


EMB = ("emb AS (SELECT vec_id, label, vec, sqrt(list_dot_product(vec, vec)) AS nrm FROM "
       "(SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings))")


def centroid(name: str, source: str, key: str, vec: str = "vec") -> str:
    """CTE ``name(key, vec, nrm)``: element-wise mean per key."""
    return (f"{name}_f AS (SELECT {key}, unnest({vec}) AS x, unnest(range(len({vec}))) AS i FROM {source}),\n"
            f"{name}_m AS (SELECT {key}, i, avg(x) AS x FROM {name}_f GROUP BY ALL),\n"
            f"{name}_v AS (SELECT {key}, list(x ORDER BY i) AS vec FROM {name}_m GROUP BY {key}),\n"
            f"{name} AS (SELECT {key}, vec, sqrt(list_dot_product(vec, vec)) AS nrm FROM {name}_v)")


def _typed(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^[0-9]+$') THEN 'Number' ELSE 'Text' END"


DOC_COLS = (
    f"doc_w AS (SELECT source, doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM "
    f"(SELECT source, doc_id, {names('text')} AS l FROM documents)),\n"
    "doc_cols AS (SELECT source AS domain, doc_id AS resource_id, w AS field_name, "
    f"{_typed('w')} AS data_type, "
    "row_number() OVER (PARTITION BY source, doc_id ORDER BY min(p)) AS ordinal_position "
    "FROM doc_w GROUP BY source, doc_id, w)")

CONV_COLS = (
    f"conv_w AS (SELECT role, conv_id, turn, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM "
    f"(SELECT role, conv_id, turn, {names('text')} AS l FROM conversations)),\n"
    "conv_t AS (SELECT role, conv_id, turn, w, row_number() OVER (PARTITION BY role, conv_id, turn ORDER BY min(p)) AS p "
    "FROM conv_w GROUP BY role, conv_id, turn, w),\n"
    "conv_cols AS (SELECT role AS domain, conv_id AS resource_id, w AS field_name, "
    f"{_typed('w')} AS data_type, min({{'turn': turn, 'at': p}}) AS ordinal_position FROM conv_t GROUP BY role, conv_id, w)")

# every distinct conversation word with its vector, and the columns with theirs
CONV_VECS = (CONV_COLS + ",\nconv_names AS (SELECT DISTINCT field_name FROM conv_cols),\n"
             + encoded("nv", "conv_names", "field_name", "field_name")
             + ",\nconv_vecs AS (SELECT * FROM conv_cols JOIN nv USING (field_name))")

TAXONOMY = ("tax AS (SELECT 'item_' || item_id AS category, 'group_' || (item_id % 7) AS hypernym, text AS gloss FROM benchmark),\n"
            "tax_t AS (SELECT category, category || ': ' || coalesce(gloss, '') AS t FROM tax),\n"
            + encoded("tax_e", "tax_t", "category", "t")
            + ",\ntaxo AS (SELECT * FROM tax JOIN tax_e USING (category))")


def enum_members(rows: list[tuple[str, str, list[str]]]) -> str:
    values = ", ".join(f"('{n}', '{lab}', '{t}')" for n, lab, ts in rows for t in ts)
    return f"enums(domain_name, domain_label, term) AS (VALUES {values})"
