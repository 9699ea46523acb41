"""The thirteen queries over ``documents`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loglattice.llm.byte_bpe import encoded_and_decoded
from loglattice.llm.common import documents, new_folder
from loglattice.llm.exact_dedup import exact_dedup
from loglattice.llm.fingerprint import fingerprints_with_neighbours
from loglattice.llm.language_id import predict, train
from loglattice.llm.merkle import manifest
from loglattice.llm.near_dedup import near_dedup
from loglattice.llm.packing import best_fit_packing
from loglattice.llm.pii import find_pii
from loglattice.llm.quality import classify
from loglattice.llm.secret_scan import secret_scan
from loglattice.llm.simhash import simhash_dedup
from loglattice.llm.spelling import spelling_variants
from loglattice.llm.token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query("""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))


@query()
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(documents(spark, folder))


@query()
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder), documents(spark, folder, "labels"))


@query()
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(documents(spark, folder))


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
  ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (sh) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 85 * (na.n + nb.n - i)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON r.b = l.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(documents(spark, folder))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return predict(docs, train(docs))


@query()
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(documents(spark, folder), path, WORD_TOKENIZER, end_id=1)
    return read_token_files(spark, path)


@query()
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints_with_neighbours(documents(spark, folder))


@query()
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_and_decoded(documents(spark, folder), BYTE_RANKS, public_tokenizers.PATTERN)


@query()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing(documents(spark, folder), WORD_TOKENIZER, end_id=0)


# CTEs: the table of the checksum's remainders, and the unsigned checksum of a list of bytes ``b`` as an expression.
CRC_TABLE = """steps AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8)"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)))"
BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)"


@query(f"""WITH RECURSIVE {CRC_TABLE},
field AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail, {BYTES.format("doc_id::VARCHAR")} AS b FROM documents),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
  CASE WHEN {CRC} % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) END AS bad FROM field, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
up AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS l FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM up WHERE len(l) > 1),
trees AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE len(l) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS l FROM trees
  UNION ALL SELECT level + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM top WHERE len(l) > 1),
root AS (SELECT l[1] AS root FROM top WHERE len(l) = 1),
inside AS (SELECT lang, list(l ORDER BY level) AS levels FROM up WHERE len(l) > 1 GROUP BY lang),
above AS (SELECT list(l ORDER BY level) AS levels FROM top WHERE len(l) > 1),
side AS (SELECT doc_id, leaf, bad, subroot, root, list_concat(
  list_transform(range(coalesce(len(i.levels), 0)), lambda k: struct_pack(o := coalesce(i.levels[k + 1][xor(x.pos >> k, 1) + 1], ''), r := (x.pos >> k) & 1)),
  list_transform(range(coalesce(len(a.levels), 0)), lambda k: struct_pack(o := coalesce(a.levels[k + 1][xor(t.pos >> k, 1) + 1], ''), r := (t.pos >> k) & 1))) AS path
  FROM leaves x JOIN trees t ON x.lang IS NOT DISTINCT FROM t.lang LEFT JOIN inside i ON x.lang IS NOT DISTINCT FROM i.lang, above a, root),
fold AS (SELECT *, list_reduce(list_prepend(struct_pack(o := coalesce(bad, leaf), r := 0::BIGINT), path),
  lambda s, p: struct_pack(o := sha256(CASE WHEN p.r = 1 THEN p.o || s.o ELSE s.o || p.o END), r := 0::BIGINT)).o AS folded_root FROM side)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.o), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(documents(spark, folder)).drop("proof")


@query()
def op12_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup(documents(spark, folder)).drop("kept")


@query(f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, {CRC} AS h FROM (SELECT w, n, {BYTES.format("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS b FROM runs WHERE length(w) >= 6), crc),
words AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
cut AS (SELECT w, n, substr(w, 1, i) || '*' || substr(w, i + 2) AS hole, substr(w, 1, i) || substr(w, i + 2) AS less FROM words, range(40) r(i) WHERE i < length(w)
  UNION ALL SELECT w, n, substr(w, 1, i) || '*' || substr(w, i + 2), substr(w, 1, i) || substr(w, i + 2) FROM words, range(40, 4000) r(i) WHERE length(w) > 40 AND i < length(w)),
one AS (SELECT a.w, b.w AS o, b.n AS m FROM cut a JOIN cut b USING (hole) WHERE a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cut a JOIN words b ON a.less = b.w UNION SELECT b.w, a.w, a.n FROM cut a JOIN words b ON a.less = b.w),
best AS (SELECT w, count(*) AS n_near, min(struct_pack(m := -m, o := encode(o))) AS b FROM one GROUP BY w),
variant AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN decode(b.o) END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n FROM words LEFT JOIN best USING (w)),
chain AS (SELECT w, coalesce(form, w) AS root, form IS NOT NULL AS more FROM variant
  UNION ALL SELECT c.w, coalesce(v.form, v.w), v.form IS NOT NULL FROM chain c JOIN variant v ON c.root = v.w WHERE c.more)
SELECT w AS word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM variant JOIN chain USING (w) WHERE NOT more""")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(documents(spark, folder))
