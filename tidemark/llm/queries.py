"""The text operators as queries over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import codes, exact_dedup, fim, fingerprints, langid, licenses, mixing, near_dedup, packing, sharding, suffix_array, suffix_tree, tokencount
from tidemark.llm.common import documents


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir)).drop("print")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies", "print")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("print")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.substring_dedup(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.byte_dedup(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op11_sql() -> str:
    """License scan: every block of every width against every template, without filters."""
    index = licenses.Index.of()
    spelled = {i: w.decode() for w, i in index.words.items()}
    pairs = [(t, index.widths[t], *(spelled[w] for w in index.tokens[k])) for t, tokens in enumerate(index.sets) for k in tokens]
    tokens = ", ".join(f"({t}, {width}, '{a}', '{b}')" for t, width, a, b in pairs)
    templates = ", ".join(f"({t}, '{label}', {index.least[t]}, {len(index.sets[t])})" for t, label in enumerate(index.labels))
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
spots AS (SELECT r, unnest(words) AS a, unnest(list_concat(words[2:], [NULL])) AS b, unnest(list_concat(words[3:], [NULL, NULL])) AS c, unnest(range(len(words))) AS i FROM w),
base AS (
  SELECT r, i, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM spots),
based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM base WHERE label IS NOT NULL GROUP BY r),
tokens(template, width, a, b) AS (VALUES {tokens}),
templates(template, label, least, size) AS (VALUES {templates}),
hit AS (SELECT r, template, width, tokens.a AS a, tokens.b AS b, i FROM spots JOIN tokens ON spots.a = tokens.a AND spots.b = tokens.b),
inside AS (
  SELECT r, template, a, b, i // (width // 2) AS block FROM hit
  UNION ALL SELECT r, template, a, b, i // (width // 2) - 1 FROM hit WHERE i >= width // 2 AND i + 1 < (i // (width // 2) + 1) * (width // 2)),
shared AS (SELECT r, template, block, count(DISTINCT (a, b)) AS n FROM inside GROUP BY ALL),
found AS (SELECT r, list(DISTINCT label) AS more, max(n / size) AS score FROM shared JOIN templates USING (template) WHERE n >= least GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN based USING (r) LEFT JOIN found USING (r)
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op13_sql() -> str:
    """Lloyd's algorithm with every distance, four rounds written out."""
    nearest = """near{r} AS MATERIALIZED (
  SELECT n, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT n, x.part AS part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN book{r} ON x.part = book{r}.part) GROUP BY n, part, v)"""
    moved = """mean{r} AS (
  SELECT part, entry, list(m ORDER BY i) AS c FROM (
    SELECT part, entry, i, floor(sum(y)::HUGEINT / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(v) AS y, unnest(range(len(v))) AS i FROM near{r}) GROUP BY part, entry, i) GROUP BY part, entry),
book{s} AS MATERIALIZED (SELECT part, entry, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (part, entry))"""
    steps = [f"{nearest.format(r=r)},\n{moved.format(r=r, s=r + 1)}" for r in range(codes.ROUNDS)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT n, part, w[part * len(w) // 4 + 1:(part + 1) * len(w) // 4] AS v FROM kept, range(4) AS parts(part)),
book0 AS (SELECT part, n AS entry, v AS c FROM x WHERE n < 256),
{(","+chr(10)).join(steps)},
{nearest.format(r=codes.ROUNDS)},
coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{codes.ROUNDS} GROUP BY n),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS s FROM book{codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (n), digest
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_dedup, op2_sharding, op3_fingerprints, op4_token_counts, op5_packing, op6_mixing, op7_exact_dedup, op8_substring_dedup, op9_language_id, op10_suffix_dedup)
    found += (op11_license_scan, op12_fill_in_middle, op13_vector_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op11_license_scan": op11_sql(), "op12_fill_in_middle": OP12_SQL, "op13_vector_codes": op13_sql()}
