"""Registered queries of the corpus operators: whole tables, production parameters, digest columns where a contract names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, hard_negatives, near_embeddings, packing, quality, secrets, sentencepiece_codec, sharding, simhash, substring_dedup, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """The tokenizer file; its place is a parameter of the operator and known on the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), model_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeated_paragraphs(table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), model_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_digest(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_sentencepiece, op3_quality, op4_secret_scan, op5_kd_sharding, op6_suffix_dedup, op7_substring_dedup, op8_url_filter, op9_simhash, op10_decontamination, op11_packing, op12_conversation_repair, op13_hard_negatives)}

# ---- the same results in DuckDB SQL; tokenizers, trained models and xxHash have no form there ----

VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95 * a.size * b.size),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n ON n.a = vec_id"""


def secrets_sql() -> str:
    """What split() leaves between the matches of a rule gives their places, as in the operator."""
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda y: length(y))), 0)"
    rules, out = secrets.BASE + secrets.MORE, []
    for i, r in enumerate(rules):
        rx = "'" + r.regex.replace("'", "''") + "'"
        out.append(
            f"list_filter(list_transform(list_zip(range(1, len(h{i}) + 1), h{i}, q{i}), lambda z: {{'s': CAST({size(f'g{i}[1:z[1]]')} + {size(f'h{i}[1:z[1] - 1]')} AS BIGINT), 'o': {i}, "
            f"'e': CAST({size(f'g{i}[1:z[1]]')} + {size(f'h{i}[1:z[1]]')} AS BIGINT), 'k': '{r.kind}', 'n': length(z[3])}}), lambda z: z.n >= {r.least})"
        )
        rules[i] = f"string_split_regex(t, {rx}) AS g{i}, regexp_extract_all(t, {rx}) AS h{i}, regexp_extract_all(t, {rx}, {r.group}) AS q{i}"
    text = lambda spans: f"array_to_string(list_transform({spans}, lambda z: z.k || ':' || z.s || ':' || z.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(found, lambda z: z.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(rules)} FROM d), f AS (SELECT doc_id, list_sort(list_concat({', '.join(out)})) AS found FROM m) "
        f"SELECT doc_id, {counts}, sha256({text(f'list_filter(found, lambda z: z.o < {len(secrets.BASE)})')}) AS base_sha256, {text('found')} AS spans FROM f"
    )


REPEATS_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), s AS (SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM d, unnest(range(0, length(h) // 2 - 99)) u(i)),
f AS (SELECT k, min({'d': doc_id, 'i': i}) AS first FROM s GROUP BY k HAVING count(*) > 1), g AS (SELECT r, i FROM s JOIN f USING (k) WHERE {'d': doc_id, 'i': i} > first),
n AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM g), c AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM n),
runs AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM c GROUP BY r, run), p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
k AS (SELECT d.r, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM d JOIN p USING (r) GROUP BY d.r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

LEAKS_SQL = r"""WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) WHERE len(w) > 0),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM bw) m, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k), c AS (SELECT r, count(DISTINCT place) AS n_hit FROM hit, unnest(range(i, i + n)) u(place) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN ids USING (r)"""


def urls_sql() -> str:
    """Rules as one CASE, and the Witten-Bell back-off as one pair of tables for each order."""
    order, upper, lower = url_filter.ORDER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cases, verdicts = [], []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}') THEN '{rule}'")
        verdicts.append(f"WHEN '{rule}' THEN '{verdict}'")
    parts = [
        "a AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"b AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_replace(coalesce(url, ''), '^[^:/?#]*://', '') AS tail FROM a)",
        f"c AS (SELECT rid, page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path, repeat(chr(2), {order}) || host || substr(tail, length(host) + 1) || chr(3) AS s FROM b)",
        f"d AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM c)",
        f"e AS (SELECT *, CASE rule {' '.join(verdicts)} END AS ruled, substr(md5(s), 1, 1) NOT IN ('0', '1', '2') AS fit FROM d)",
        f"g AS (SELECT rid, ruled, fit, substr(s, i, {order + 1}) AS g FROM e, unnest(range(1, length(s) - {order} + 1)) u(i))",
        "n AS (SELECT g, count(*) FILTER (ruled = 'allow' AND fit) AS allow, count(*) FILTER (ruled = 'block' AND fit) AS block FROM g GROUP BY g)",
        f"v AS (SELECT CAST(count(DISTINCT substr(g, {order + 1}, 1)) + 1 AS DOUBLE) AS size FROM n)",
    ]
    for k in range(order + 1):
        parts.append(f"o{k} AS (SELECT substr(g, {order + 1 - k}, {k + 1}) AS gram, sum(allow) AS allow, sum(block) AS block FROM n GROUP BY 1)")
        parts.append(f"t{k} AS (SELECT substr(gram, 1, {k}) AS context, sum(allow) AS allow_n, count(*) FILTER (allow > 0) AS allow_t, sum(block) AS block_n, count(*) FILTER (block > 0) AS block_t FROM o{k} GROUP BY 1)")
        shorter = (lambda c: "1.0 / size") if k == 0 else lambda c, k=k: f"p{k - 1}.{c}_p"
        p = lambda c: f"CASE WHEN {c}_n = 0 THEN {shorter(c)} ELSE ({c} + {c}_t * {shorter(c)}) / CAST({c}_n + {c}_t AS DOUBLE) END AS {c}_p"  # noqa: E731, B023
        parts.append(f"p{k} AS (SELECT o{k}.gram, {p('allow')}, {p('block')} FROM o{k} JOIN t{k} ON substr(o{k}.gram, 1, {k}) = context {'CROSS JOIN v' if k == 0 else f'JOIN p{k - 1} ON p{k - 1}.gram = substr(o{k}.gram, 2, {k})'})")
    parts += [
        f"r AS (SELECT rid, sum(CAST(round(1e6 * (ln(allow_p) - ln(block_p))) AS BIGINT)) / count(*) / 1e6 AS score FROM g JOIN p{order} ON g = gram GROUP BY rid)",
        "f AS (SELECT e.*, score FROM e JOIN r USING (rid))",
        "h AS (SELECT floor((least(greatest(score, -10.0), 10.0) + 10.0) * 200.0) AS bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM f WHERE ruled IS NOT NULL AND NOT fit GROUP BY 1)",
        "w AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS before, (sum(a) OVER () - sum(a) OVER (ORDER BY bin) + a) / nullif(sum(a) OVER (), 0) + (sum(b) OVER (ORDER BY bin) - b) / nullif(sum(b) OVER (), 0) AS found FROM h)",
        "k AS (SELECT coalesce((before + 1 + bin) / 2, bin) * 2 * 10.0::DOUBLE / 4000 - 10.0::DOUBLE AS cut FROM w WHERE found IS NOT NULL ORDER BY found DESC, bin LIMIT 1)",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(score >= (SELECT cut FROM k), true) THEN 'allow' ELSE 'block' END) AS verdict, score FROM f"


def conversations_sql() -> str:
    """crc32 by its table, faults by windows, and the edits as one reduction over a conversation's characters: before each row the
    states (o nothing, s, u, a) take what insertions lead to, then the row is deleted, kept or given a new role. A state is its
    cost, padded, with its audit after it, so the least of two texts is the cheaper, then the ASCII-least."""
    plus = lambda x, cost, letters: f"lpad(CAST(CAST(substr({x}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || {letters}"
    to_u = f"least(x.u, {plus('least(x.o, x.s, x.a)', 5, chr(39) + 'I' + chr(39))})"
    to_a = f"least(x.a, {plus('x.u', 5, chr(39) + 'I' + chr(39))}, {plus('least(x.o, x.s)', 10, chr(39) + 'II' + chr(39))})"
    keep = lambda source, initial: f"CASE WHEN c.f IN ('', 'truncated') THEN {plus(source, '(CASE WHEN c.f = ' + chr(39) * 2 + ' THEN 0 ELSE 5 END + CASE WHEN c.i = ' + chr(39) + initial + chr(39) + ' THEN 0 ELSE 1 END)', '(CASE WHEN c.i = ' + chr(39) + initial + chr(39) + ' THEN ' + chr(39) + 'K' + chr(39) + ' ELSE ' + chr(39) + 'R' + chr(39) + ' END)')} END"
    gone = lambda x: plus(x, 2, "'D'")
    first = f"CASE WHEN c.f IN ('', 'truncated') AND c.i = 's' THEN {plus('x.o', '(CASE WHEN c.f = ' + chr(39) * 2 + ' THEN 0 ELSE 5 END)', chr(39) + 'K' + chr(39))} END"
    opened = f"{{'o': x.o, 's': x.s, 'u': {to_u}, 'a': {to_a}}}"
    row = f"{{'o': {gone('x.o')}, 's': least({gone('x.s')}, {first}), 'u': least({gone('x.u')}, {keep('least(x.o, x.s, x.a)', 'u')}), 'a': least({gone('x.a')}, {keep('x.u', 'a')})}}"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
k AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT r, conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda z: CAST(ascii(z) AS BIGINT)), lambda c, z: xor(c // 256, t[xor(c % 256, z) + 1]), 4294967295), 4294967295) % 20 AS f FROM k, t),
m AS (SELECT r, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d, unnest(range(0, CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(i)),
b AS (SELECT *, rtrim(text, {white}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM m),
e AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f, substr(role, 1, 1) AS i FROM b),
g AS (SELECT conv_id, list({{'f': f, 'i': i, 'role': role, 'text': text}} ORDER BY n) AS rows, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated FROM e GROUP BY conv_id),
s AS (SELECT *, list_reduce(list_transform(flatten(list_transform(rows, lambda z: [{{'f': '+', 'i': ''}}, {{'f': z.f, 'i': z.i}}])), lambda z: z), lambda x, c: CASE WHEN c.f = '+' THEN {opened} ELSE {row} END,
  {{'o': '000000000', 's': CAST(NULL AS VARCHAR), 'u': CAST(NULL AS VARCHAR), 'a': CAST(NULL AS VARCHAR)}}) AS x, list_sum(list_transform(range(1, len(rows)), lambda j: CASE WHEN (rows[j].i || rows[j + 1].i) IN ('su', 'ua', 'au') THEN 0 ELSE 1 END)) AS illegal FROM g),
z AS (SELECT *, least(x.o, {to_a}) AS best FROM s),
v AS (SELECT *, substr(best, 10) AS audit, list_transform(range(1, length(substr(best, 10)) + 1), lambda j: {{'e': substr(best, 9 + j, 1), 'r': length(replace(substr(best, 10, j), 'I', ''))}}) AS edits FROM z),
o AS (SELECT *, list_filter(edits, lambda y: y.e <> 'D') AS kept FROM v),
h AS (SELECT *, CASE WHEN kept[1].e = 'K' AND rows[kept[1].r].i = 's' THEN 1 ELSE 0 END AS head FROM o),
l AS (SELECT *, array_to_string(list_transform(range(1, len(kept) + 1), lambda j: CASE WHEN kept[j].e = 'K' THEN rows[kept[j].r].role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN kept[j].e = 'I' THEN '' ELSE rows[kept[j].r].text END), chr(10)) AS repaired FROM h)
SELECT conv_id, coalesce(n_rows, 0) AS n_rows, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
CAST(coalesce(CAST(substr(best, 1, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) LEFT JOIN l ON conv_id IS NOT DISTINCT FROM c""".replace("SELECT conv_id, coalesce(n_rows", "SELECT c AS conv_id, coalesce(n_rows")


NEGATIVES_SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON s.ar = p.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.ar, p.pr ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10"""

ORACLES: dict[str, str] = {"op1_embedding_near_dedup": VECTORS_SQL, "op4_secret_scan": secrets_sql(), "op6_suffix_dedup": REPEATS_SQL, "op8_url_filter": urls_sql(), "op10_decontamination": LEAKS_SQL, "op12_conversation_repair": conversations_sql(), "op13_hard_negatives": NEGATIVES_SQL}
