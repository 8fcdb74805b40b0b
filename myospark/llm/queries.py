"""The corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from .common import table
from .conversations import repair_conversations
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .mixing import ALPHA, MOST_RATE, SEED, poisson_mix
from .near_dedup import near_duplicates
from .personal_data import personal_data
from .repeats import drop_repeats
from .secrets import scan_secrets
from .url_filter import judge
from .whitening import whiten


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of three grades from the labels: 0 bad, 1 good but toxic, 2 good."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, graded(table(spark, sf_dir, "labels"))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("span_list")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def _op12_sql() -> str:
    """Dynamic programming from the last row to the first: for each role last given, the least (cost, audit, repaired text)."""
    name = {2: "user", 3: "assistant"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    arc = lambda to, cost, letter, line: f"{{'c': f{to}.c + {cost}, 'a': '{letter}' || f{to}.a, 't': {line} || f{to}.t}}"
    best = lambda *arcs: f"list_sort([{', '.join(arcs)}])[1]"
    none = "{'c': 1000000000, 'a': '', 't': ''}"

    def row_arcs(q: int) -> str:
        changed = arc(after[q], "1 + cut", "R", f"chr(10) || '{name[after[q]]}:' || text")
        fits = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        kept = "".join(f" WHEN left(role, 1) = '{k}' THEN {arc(to, 'cut', 'K', "chr(10) || role || ':' || text")}" for k, to in fits.items())
        return best(arc(q, "2", "D", "''"), f"CASE WHEN forced THEN {none} ELSE {changed} END", f"CASE WHEN forced THEN {none}{kept} ELSE {none} END")

    def closed(q: int) -> str:
        one, two = after[q], after[after[q]]
        lines = f"chr(10) || '{name[one]}:'", f"chr(10) || '{name[one]}:' || chr(10) || '{name[two]}:'"
        return best(f"f{q}", arc(one, "5", "I", lines[0]), arc(two, "10", "II", lines[1]))

    all_of = lambda f: ", ".join(f"{f(q)} AS f{q}" for q in range(4))
    done, open_ = "{'c': 0::BIGINT, 'a': '', 't': ''}", "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS h FROM src, tab),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
m AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
x AS (SELECT conv_id, turn, role, text, i, prior, shown = '' AS blank, shown <> '' AND again AS duplicate, shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated FROM m),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
      count(*) FILTER (prior IS NOT NULL AND prior || '>' || left(role, 1) NOT IN ('s>u', 'u>a', 'a>u')) AS illegal FROM x GROUP BY conv_id),
r AS (SELECT conv_id, i, role, text, blank OR duplicate AS forced, CASE WHEN truncated THEN 5 ELSE 0 END AS cut FROM x),
dp AS (SELECT conv_id, n + 1 AS i, {all_of(closed)} FROM (SELECT conv_id, n, {done} AS f0, {open_} AS f1, {open_} AS f2, {done} AS f3 FROM s)
       UNION ALL SELECT conv_id, i, {all_of(closed)} FROM (SELECT r.conv_id, r.i, {all_of(row_arcs)} FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i - 1))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN (SELECT * FROM dp WHERE i = 1) AS dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _op12_sql()


OP8_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, count(*)::DOUBLE ^ {ALPHA} AS want FROM documents GROUP BY source),
w AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE * (want / (SELECT sum(want) FROM n)) / n AS rate FROM n),
r AS (SELECT source, greatest(ceil(rate / {MOST_RATE}), 1)::INT AS parts, rate / greatest(ceil(rate / {MOST_RATE}), 1)::INT AS rate FROM w),
p AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM p
      WHERE k + 1 <= ceil(rate + 10 * sqrt(rate) + 20)),
c AS (SELECT r.source, parts, cums FROM r JOIN (SELECT source, list(cum ORDER BY k) AS cums FROM p GROUP BY source) AS q ON r.source IS NOT DISTINCT FROM q.source),
d AS (SELECT documents.*, parts, cums, list_transform(range(parts), lambda j: ('0x' || substr(md5(CASE WHEN j = 0 THEN '{SEED}:' || doc_id ELSE '{SEED}:part:' || doc_id || ':' || j END), 1, 13))::BIGINT / {2**52}.0::DOUBLE) AS us
      FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source),
m AS (SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(cums, lambda x: u >= x))))::BIGINT AS m FROM d),
e AS (SELECT * EXCLUDE (parts, cums, us, m), unnest(range(m)) AS copy FROM m)
SELECT *, md5('{SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM e
"""

QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filter": op4_url_filter,
    "op5_near_dedup": op5_near_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_toxicity": op7_toxicity,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op8_poisson_mix": OP8_SQL,
    "op12_conversation_repair": OP12_SQL,
}
