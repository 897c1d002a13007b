"""The registered queries of this subpackage and their DuckDB SQL. Each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsforest.llm import chat_tree, decontaminate, hard_negatives, kneser_ney, language_id, license_scan, mixing, near_dedup, order_minhash, ppm, quality_rules, ranked_search, token_counts
from epsforest.runtime import cut

#: Fixed values of the contracts: words by white space, A-Z lower-cased only.
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({SQL_LOWER}, '{SQL_SPACE}'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s),
g AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(id, comp) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT y.b, c.comp FROM c JOIN both_ways y ON y.a = c.id WHERE c.comp < y.b
), m AS (SELECT id, min(comp) AS comp FROM c GROUP BY id)
SELECT d.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.comp AS component_id, m.comp = d.doc_id AS kept
FROM documents d JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("regions")


def _pattern(template: str) -> str:
    """A template as a pattern over words that are each followed by one blank: by replacing its marks, apart from the operator's parser."""
    out = ""
    for part in re.split(r"(\[\[|\]\]|\{\{\w+:\d+-\d+\}\})", template):
        if part in ("[[", "]]"):
            out += {"[[": "(?:", "]]": ")?"}[part]
        elif part.startswith("{{"):
            out += "(?:[^ ]+ ){" + part[part.index(":") + 1 : -2].replace("-", ",") + "}"
        else:
            out += "".join(f"{w} " for w in re.findall("[a-z0-9]+", part.lower()))
    return out


def _op2_sql() -> str:
    base, labels = [], []
    for phrase, label in license_scan.PHRASES.items():
        same = " AND ".join(f"ws[i+{k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        base.append(f"SELECT doc_id, '{label}' AS label, list_filter(range(0, len(ws)), lambda i: {same}) AS places FROM w")
    for label, templates in license_scan.TEMPLATES.items():
        some = " OR ".join(f"regexp_matches(line, ' {_pattern(t)}')" for t in templates)
        labels.append(f"CASE WHEN {some} THEN '{label}' END")
    joined = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex({SQL_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), p AS ({" UNION ALL ".join(base)}),
b AS (
  SELECT doc_id, CAST(sum(len(places)) AS BIGINT) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
    list(CASE WHEN len(places) > 0 THEN label END) AS found FROM p GROUP BY doc_id
), t AS (SELECT doc_id, [{", ".join(labels)}] AS kinds FROM (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w))
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, n_base, first_word, last_word, {joined.format("found")} AS base_labels,
  {joined.format("list_concat(found, kinds)")} AS labels,
  CASE WHEN len(list_filter(kinds, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM w JOIN b USING (doc_id) JOIN t USING (doc_id)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 mixes to: the targets of all sources, to millionths of a word."""
    sizes = table(spark, sf_dir, "documents").select("source", mixing.words_of().alias("size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


SOURCE_TARGETS_SQL = r"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
-- sources reach their cap in the order of cap over weight; the level is the first that the next one's cap stands above
r AS (
  SELECT *, 2 * source_size / weight AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS wanted, sum(weight) OVER () AS weights,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w
), l AS (SELECT coalesce(max((wanted - below) / (weights - gone)) FILTER (WHERE (wanted - below) / (weights - gone) <= full_at), max(full_at)) AS level FROM r)
SELECT source, source_size, round(least(weight * level, 2.0 * source_size), 6) AS target FROM r, l
"""


def op8_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(source, '<none>') AS hk, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(later - i, 8))) AS n_repeat_words FROM twice GROUP BY doc_id),
l AS (
  SELECT doc_id, hk, t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}', '0', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM (SELECT *, unnest(ls) AS line FROM w)
), c AS (SELECT hk, norm, count(DISTINCT t) AS n FROM l GROUP BY hk, norm),
f AS (SELECT hk, norm FROM c WHERE n > CASE WHEN len(string_split(norm, ' ')) >= 50 THEN 2 ELSE 10 END),
x AS (SELECT doc_id, sum(words) AS gone FROM l JOIN f USING (hk, norm) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)
), v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed_words AS n_left_words FROM m)
SELECT *, NOT base_failed AND n_left_words >= 20 AND n_left_words >= 0.5 * n_words AS kept FROM v
"""

def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: one more conversation whose texts are control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_tree.read_back(cut(chat_tree.pack_conversations(conversations.unionByName(probe)), "packs"))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), e AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(er) + 1 + length(et) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_byte_gru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# all windows of every item's length, without fingerprints; items of at least five words
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
dg AS (SELECT doc_id, p, n, array_to_string(ws[p+1:p+5], ' ') AS gram FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(0, len(ws) - 4)) AS p FROM d)),
ig AS (SELECT item_id, w, gram, count(*) AS c FROM (SELECT item_id, w, array_to_string(ws[p+1:p+5], ' ') AS gram FROM (SELECT item_id, ws, len(ws) AS w, unnest(range(0, len(ws) - 4)) AS p FROM i)) GROUP BY ALL),
m AS (SELECT doc_id, item_id, w, gram, c, unnest(range(greatest(0, p - (w - 5)), least(p, n - w) + 1)) AS s FROM dg JOIN ig USING (gram)),
x AS (SELECT doc_id, item_id, w, s, sum(shared) AS shared FROM (SELECT doc_id, item_id, w, s, gram, least(count(*), any_value(c)) AS shared FROM m GROUP BY doc_id, item_id, w, s, gram) GROUP BY doc_id, item_id, w, s),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared DESC, s) AS r FROM x WHERE 100 * shared >= 80 * (2 * (w - 4) - shared))
SELECT doc_id, item_id, s AS start_word, CAST(w AS BIGINT) AS n_words, CAST(shared AS BIGINT) AS shared, CAST(shared AS DOUBLE) / (2 * (w - 4) - shared) AS similarity FROM y WHERE r = 1
"""


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
), p AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, br FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT * FROM n WHERE rank <= 3
"""


def op12_threshold_seeded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents) WHERE len(ws) > 0
), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws FROM benchmark),
t AS (SELECT i, item_id, unnest(ws) AS term FROM i),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
x AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN t USING (term), c GROUP BY ALL
), y AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM y WHERE rank <= 50
"""


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_chat_prefix_tree": op4_chat_prefix_tree,
    "op5_byte_gru_language_id": op5_byte_gru_language_id,
    "op6_simhash_decontamination": op6_simhash_decontamination,
    "op7_source_mixing": op7_source_mixing,
    "source_targets": source_targets,
    "op8_line_frequency_rules": op8_line_frequency_rules,
    "op9_kneser_ney_quality": op9_kneser_ney_quality,
    "op10_ppm_scoring": op10_ppm_scoring,
    "op11_pivot_hard_negatives": op11_pivot_hard_negatives,
    "op12_threshold_seeded_search": op12_threshold_seeded_search,
    "op13_order_minhash": op13_order_minhash,
}

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op2_license_scan": _op2_sql(),
    "op4_chat_prefix_tree": OP4_SQL,
    "op6_simhash_decontamination": OP6_SQL,
    "source_targets": SOURCE_TARGETS_SQL,
    "op8_line_frequency_rules": OP8_SQL,
    "op11_pivot_hard_negatives": OP11_SQL,
    "op12_threshold_seeded_search": OP12_SQL,
}
