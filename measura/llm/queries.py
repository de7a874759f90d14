"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, toxicity, warc
from .common import table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .pii import find_personal_data
from .html_text import extract_text
from .merkle import manifest
from .packing import pack_documents
from .search import top_k
from .simhash import simhash_components


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: Shares of the mixture by domain, in words. The domains are the languages of labelled documents by their quality; those not named
#: share what is left.
TARGETS = {"en-1": 0.54, "en-0": 0.035, "de-1": 0.15, "fr-1": 0.145, "es-1": 0.10}


def domains_of(docs: DataFrame, labels: DataFrame) -> mixing.Domains:
    known = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality").distinct(), "doc_id")
    return mixing.fit_domains(docs, known.select("doc_id", F.concat_ws("-", "lang", "quality").alias("label")).where("label <> ''"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domains_of(docs, table(spark, sf_dir, "labels")), TARGETS)[0]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_language(docs, language.fit(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages"))).withColumnRenamed("response_row", "page_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of documents whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 50 = 0"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).drop("first")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _audit_sql(letters: str = "ABCDE") -> str:
    def lost(x: str) -> str:
        return f"list_sum([x.{x} FOR x IN c.cells IF x.mask & l.bit <> 0 AND x.mask & s.applied = 0])"

    return f"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                                    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
             m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                          + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
                          + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM t),
             b AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
                   FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL),
             c AS (SELECT part, list({{'mask': mask, 'n': n, 'good': good, 'toxic': toxic}}) AS cells FROM b GROUP BY part),
             l AS (SELECT unnest(string_split('{letters}', '')) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
             s(part, path, step, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
               SELECT part, '', 0, 0, '', 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT FROM c
               UNION ALL
               SELECT s.part, s.path || l.letter, step + 1, applied | l.bit, l.letter,
                      list_sum([x.n FOR x IN c.cells IF x.mask & (s.applied | l.bit) = 0]), {lost("n")},
                      list_sum([x.n FOR x IN c.cells IF x.mask & l.bit <> 0 AND x.mask & s.applied <> 0]),
                      list_sum([x.n FOR x IN c.cells IF x.mask = l.bit]), {lost("good")}, {lost("toxic")}
               FROM s JOIN l ON s.applied & l.bit = 0 JOIN c ON c.part = s.part),
             o AS (SELECT part, path AS filter_order FROM s WHERE step = 5)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM o JOIN s USING (part) WHERE step > 0 AND starts_with(filter_order, path)"""


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in values) + "))"

    # crc32 of the id's digits, bit by bit.
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {bits}), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, leaves: str) -> str:
        return f"""{name}(tree, level, pos, h, n) AS (
               SELECT tree, 0, pos, h, count(*) OVER (PARTITION BY tree) FROM {leaves}
               UNION ALL
               SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n)"""

    def siblings(nodes: str, on: str) -> str:
        return f"""SELECT i, {nodes}.level, string_agg({nodes}.h, '' ORDER BY {nodes}.pos) AS h FROM l JOIN s USING (tree)
                     JOIN {nodes} ON {on} AND n > 1 AND {nodes}.pos // 8 = at.pos // 8 AND {nodes}.pos <> at.pos GROUP BY ALL"""

    return f"""
        WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER () AS i, coalesce('=' || lang, '') AS tree, {leaf("text")} AS h,
                                    CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS v,
                                    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
             {tree("t", "l")},
             s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t WHERE n = 1),
             r AS (SELECT '' AS tree, pos, h FROM s),
             {tree("u", "r")},
             nodes AS (SELECT tree, level, pos, h FROM t WHERE n > 1
                       UNION ALL SELECT s.tree, 100 + level, u.pos, u.h FROM u, s WHERE n > 1),
             tops AS (SELECT tree, max(level) AS depth FROM t GROUP BY tree),
             place AS (SELECT i, tree, level, h, pos, CASE WHEN level < 100 THEN lp >> (3 * level) ELSE sp >> (3 * (level - 100)) END AS own
                       FROM (SELECT i, l.tree, l.pos AS lp, s.pos AS sp FROM l JOIN s USING (tree)) JOIN nodes USING (tree)),
             near AS (SELECT * FROM place WHERE pos // 8 = own // 8),
             proof AS (SELECT i, sha256(string_agg(h, '' ORDER BY level, pos)) AS proof_sha256 FROM near WHERE pos <> own GROUP BY i),
             steps AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY level) AS k, count(*) OVER (PARTITION BY i) AS n, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS a,
                              coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS z FROM near GROUP BY i, level),
             f(i, k, h) AS (SELECT i, 0, v FROM l UNION ALL SELECT i, steps.k, sha256(concat(a, h, z)) FROM f JOIN steps USING (i) WHERE steps.k = f.k + 1),
             g AS (SELECT i, arg_max(h, k) AS folded_root FROM f GROUP BY i)
        SELECT doc_id, l.h AS leaf, s.h AS subroot, u.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = u.h AS verified
        FROM l JOIN s USING (tree) JOIN (SELECT h FROM u WHERE n = 1) AS u ON true JOIN g USING (i) LEFT JOIN proof USING (i)"""


def _decontamination_sql() -> str:
    def words(table: str, key: str) -> str:
        return f"""SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}"""

    return f"""
        WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "item_id")}),
             v AS (SELECT DISTINCT item_id, k AS len, array_to_string(w[p:p + k - 1], ' ') AS g
                   FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
             n AS (SELECT DISTINCT len FROM v),
             o AS (SELECT doc_id, p, n.len AS len, array_to_string(w[p:p + n.len - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), n WHERE p + n.len - 1 <= len(w)),
             h AS (SELECT DISTINCT o.doc_id, o.p, o.len, v.item_id FROM o JOIN v ON o.g = v.g AND o.len = v.len),
             c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + len)) FROM h) GROUP BY doc_id),
             i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS x FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""


ORACLE = {
    "op11_filter_audit": _audit_sql(),
    "op12_merkle": _merkle_sql(),
    "op13_decontamination": _decontamination_sql(),
    "op8_search": """
        WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+')) AS t FROM documents),
             p AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t <> '' GROUP BY ALL),
             l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
             g AS (SELECT count(*) AS n, (SELECT sum(dl) FROM l) / count(*) AS a FROM documents),
             i AS (SELECT t, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY t),
             s AS (SELECT q.doc_id AS query_id, p.doc_id AS doc_id,
                          round(sum(idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score
                   FROM p AS q JOIN i USING (t) JOIN p USING (t) JOIN l ON l.doc_id = p.doc_id, g
                   WHERE q.doc_id % 50 = 0 GROUP BY ALL)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank
        FROM s QUALIFY rank <= 10""",
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
}
