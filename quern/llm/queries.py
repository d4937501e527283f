"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import contamination
from quern.llm.dominance import sales_above
from quern.llm.fingerprint import neighbours
from quern.llm.importance import resample
from quern.llm.jaccard_join import jaccard_components
from quern.llm.language_id import identified
from quern.llm.lexical_search import search
from quern.llm.license_scan import license_scan
from quern.llm.ngram_trie import scored
from quern.llm.personal_data import personal_data
from quern.llm.sentencepiece_scan import encoded
from quern.llm.substring_dedup import substring_dedup
from quern.llm.token_planes import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, text_ok)."""
    return encoded(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept)."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of the training texts count, also those that occur once."""
    return scored(table(spark, sf_dir, "documents"), least=1)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))


def op11_dominance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_above(table(spark, sf_dir, "sales"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# What SQL can say of other operators' results


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the license scan; -1 where there is no place."""
    found = op6_license_scan(spark, sf_dir)
    return found.select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.coalesce("last_word", F.lit(-1)).alias("last_word"), "base_labels")


def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each base kind the personal data operator finds."""
    return op8_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the fingerprinted texts, and digests of the edited ones."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_jaccard_join, op2_decontamination, op3_language_id, op4_token_planes, op5_sentencepiece_scan,
        op6_license_scan, op7_importance_resampling, op8_personal_data, op9_ngram_trie, op10_fingerprints,
        op11_dominance_count, op12_substring_dedup, op13_lexical_search,
        license_places, personal_counts, edited_texts,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


_LOWER_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_LOWER_WORDS}, []) AS w FROM documents
), b AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(w)) AS size, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)
), m AS (SELECT g.doc_id, g.i, g.size, p.item FROM g JOIN p ON p.phrase = g.phrase AND p.size = g.size
), h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
), pos AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), f AS (SELECT word, count(*) AS n FROM pos GROUP BY word
), q AS (SELECT item, size, list_distinct(string_split(phrase, ' ')) AS u FROM p
), z AS (SELECT item, size, u, arg_min(v, coalesce(f.n, 0)) AS rarest FROM (SELECT item, size, u, unnest(u) AS v FROM q) LEFT JOIN f ON f.word = v GROUP BY item, size, u
), c AS (SELECT pos.doc_id, pos.i, z.item, z.size + 5 AS n, z.u FROM pos JOIN z ON z.rarest = pos.word
), a AS (SELECT DISTINCT c.doc_id, c.item FROM c JOIN d ON d.doc_id = c.doc_id WHERE list_bool_or(list_transform(range(greatest(c.i - c.n + 1, 1), c.i + 1), lambda s: list_has_all(d.w[s:s + c.n - 1], c.u)))
), b2 AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM a GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated,
  coalesce(b2.n, 0)::BIGINT AS n_near, sha256(coalesce(b2.items, '')) AS near_items_sha256
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN b2 ON b2.doc_id = d.doc_id
"""


LICENSE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_LOWER_WORDS}, []) AS w FROM documents
), p AS (SELECT unnest([['gnu', 'general', 'public', 'license'], ['apache', 'license'], ['cc', 'by'], ['mit', 'license']]) AS p, unnest(['gpl', 'apache', 'cc-by', 'mit']) AS label
), m AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS k FROM d, p
), g AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, coalesce(a, -1)::BIGINT AS first_word, coalesce(b, -1)::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

_LUHN = "list_sum(list_transform(range(1, len(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN x[len(x) - k + 1]::INT WHEN x[len(x) - k + 1]::INT > 4 THEN x[len(x) - k + 1]::INT * 2 - 9 ELSE x[len(x) - k + 1]::INT * 2 END)) % 10 = 0"

PERSONAL_SQL = rf"""
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda y: len(ltrim(y, '0')) > 3 OR ('0' || ltrim(y, '0')[1:3])::INT > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda y: regexp_replace(y, '[^0-9]', '', 'g')), lambda x: len(x) BETWEEN 16 AND 19 AND {_LUHN}))::BIGINT AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))::BIGINT AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS n FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, (length(t) - length(t) // 3)::INT) || left(n, (length(t) // 3)::INT)) AS edited_sha256 FROM d
"""


#: Slots and levels by arithmetic; crc32 by a table of its 256 steps; pairs by comparison.
OP11_SQL = """
WITH RECURSIVE t AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8
), steps AS (SELECT list(c ORDER BY byte) AS tab FROM t WHERE k = 8
), s AS (
  SELECT sale_id, epoch_us(date_trunc('minute', sold_at)) // 60000000 AS slot, floor(floor(100 * total + 0.5) / 1)::BIGINT AS level,
    1 + xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(coalesce(sale_id::VARCHAR, '')) + 1), lambda i: ascii((sale_id::VARCHAR)[i])::BIGINT)),
      lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) % 5 AS copies
  FROM sales, steps
), n AS (SELECT a.sale_id, count(*) AS n_sales, sum(b.copies) AS n_rows FROM s a JOIN s b ON b.slot < a.slot AND b.level > a.level GROUP BY a.sale_id)
SELECT s.sale_id, slot, level, CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(n_sales, 0) END::BIGINT AS n_sales,
  CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(n_rows, 0) END::BIGINT AS n_rows FROM s LEFT JOIN n ON n.sale_id = s.sale_id
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), f AS (SELECT s, min({'doc_id': doc_id, 'i': i}) AS least FROM p GROUP BY s
), r AS (SELECT doc_id, i FROM p JOIN f ON f.s = p.s WHERE {'doc_id': doc_id, 'i': i} > least
), g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM r) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents
), p AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t
), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), z AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n
), w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, z GROUP BY t
), q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t
), s AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t JOIN n USING (doc_id), z GROUP BY item_id, doc_id
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op2_decontamination": OP2_SQL, "license_places": LICENSE_SQL, "personal_counts": PERSONAL_SQL, "edited_texts": EDITED_SQL, "op11_dominance_count": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL}
