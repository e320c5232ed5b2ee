"""The registered queries of the training-data operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, decontamination, mixing, quality_classifier, quality_rules, simhash, spelling, suffix_dedup, toxicity, url_filter, warc, whitening
from tidemark.llm.shared import bound_batches

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by hand-written rules, else by mined association rules of one or two tokens, as its SQL defines them."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, most_tokens=2)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by labelled neighbours in a latent-semantic space."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash and vantage-point trees."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document by rules that vote and are weighed by expectation-maximisation."""
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found to every 50th vector, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by weighted fair queueing takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes that an earlier one has."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by its nearest labelled examples."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    path, pattern = tokenizer()
    return bpe.encode(table(spark, sf_dir, "documents"), path, pattern, digests=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the number of words one edit away, the commoner form and the root of each."""
    return spelling.group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"), slip_every=97)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every vector on the first components of the covariance of all."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of a benchmark item, and the items."""
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and pre-token pattern of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def sql_url_filters(min_support: float = 0.01, min_confidence: float = 0.8) -> str:
    """Counts every frequent token and every two of them over whole rows."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(v, h + p)[k]}'" for v, h, p in longest) + " END"
    values = {
        "host": "[host]", "label": "l", "path": "string_split(path, '/')", "query": "list_transform(string_split(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))",
        "site": "[array_to_string(l[greatest(len(l) - 1, 1):len(l)], '.')]", "tail": "[CASE WHEN ends_with(path, '/') THEN 'slash' ELSE regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1) END]",
        "web": "[split_part(url, '://', 1)]",
    }
    tokens = ", ".join(f"list_transform(list_filter({v}, lambda x: x <> ''), lambda x: '{k}=' || CASE WHEN length(x) > 64 THEN md5(x) ELSE x END)" for k, v in values.items())
    return f"""
WITH parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
split AS (SELECT *, string_split(host, '.') AS l, {case(1)} AS rule, {case(0)} AS hand FROM parts),
tokens AS (SELECT *, CASE WHEN host = '' THEN [] ELSE list_distinct(flatten([{tokens}])) END AS every FROM split),
labelled AS (SELECT row_number() OVER () AS k, every, hand FROM tokens WHERE hand IS NOT NULL),
need AS (SELECT count(*) AS n, ceil({min_support} * count(*)) AS least FROM labelled),
named AS (SELECT k, hand, unnest(every) AS token FROM labelled),
frequent AS (SELECT token FROM named GROUP BY token HAVING count(*) >= (SELECT least FROM need)),
kept AS MATERIALIZED (SELECT k, hand, token FROM named JOIN frequent USING (token)),
ones AS (SELECT token AS a, count(*) AS n, count(*) FILTER (hand = 'allow') AS allow, count(*) FILTER (hand = 'block') AS block FROM kept GROUP BY token),
twos AS (
  SELECT x.token AS a, y.token AS b, count(*) AS n, count(*) FILTER (x.hand = 'allow') AS allow, count(*) FILTER (x.hand = 'block') AS block
  FROM kept x JOIN kept y ON x.k = y.k AND x.token < y.token GROUP BY ALL),
counts AS (
  SELECT a, NULL AS b, a AS name, n, allow, block FROM ones UNION ALL
  SELECT t.a, t.b, t.a || '&' || t.b, t.n, t.allow, t.block FROM twos t JOIN ones p ON p.a = t.a JOIN ones q ON q.a = t.b WHERE t.n < p.n AND t.n < q.n),
mined AS MATERIALIZED (
  SELECT a, b, name, v, m / counts.n AS confidence, m / need.n AS support
  FROM (SELECT *, 'allow' AS v, allow AS m FROM counts UNION ALL SELECT *, 'block', block FROM counts) counts, need WHERE m > 0 AND m >= least AND m / counts.n >= {min_confidence}),
urls AS (SELECT DISTINCT url, every FROM tokens WHERE hand IS NULL),
best AS (
  SELECT url, arg_max(v, row(confidence, support, name, v)) AS v, arg_max(name, row(confidence, support, name, v)) AS name
  FROM (SELECT url, every, unnest(every) AS a FROM urls) JOIN mined USING (a) WHERE b IS NULL OR list_contains(every, b) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(hand, v, 'allow') AS verdict, name AS mined_rule FROM tokens LEFT JOIN best ON tokens.url = best.url AND hand IS NULL"""


def sql_quality_rules() -> str:
    """One pair of common table expressions per round of expectation-maximisation, over at most 3 ** 6 vote patterns."""
    rules, s = quality_rules.RULES, quality_rules.START
    blank = "[ \\x09-\\x0D]+"
    votes = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v_{r}" for r, (b, g) in rules.items())
    cells = [(c, r, v) for r in rules for v in (-1, 0, 1) for c in ("good", "bad")]
    name = lambda c, r, v: f"{c}_{r}_{v + 1}"
    start = {-1: lambda c: s[f"bad_if_{c}"], 1: lambda c: s[f"good_if_{c}"], 0: lambda c: 1 - s[f"bad_if_{c}"] - s[f"good_if_{c}"]}
    odds = "ln(good / (1 - good)) + " + " + ".join(
        f"CASE v_{r} WHEN -1 THEN ln({name('good', r, -1)} / {name('bad', r, -1)}) WHEN 1 THEN ln({name('good', r, 1)} / {name('bad', r, 1)}) ELSE ln({name('good', r, 0)} / {name('bad', r, 0)}) END"
        for r in rules
    )
    steps = ["p0 AS (SELECT " + f"{s['good']}::DOUBLE AS good, " + ", ".join(f"{start[v](c)!r}::DOUBLE AS {name(c, r, v)}" for c, r, v in cells) + ")"]
    for k in range(quality_rules.ROUNDS):
        share = lambda c, r, v: f"(coalesce(sum(n * {'p' if c == 'good' else '(1 - p)'}) FILTER (v_{r} = {v}), 0) + 1) / (sum(n * {'p' if c == 'good' else '(1 - p)'}) + 3) AS {name(c, r, v)}"
        steps.append(
            f"p{k + 1} AS MATERIALIZED (SELECT (sum(n * p) + 1) / (sum(n) + 2) AS good, " + ", ".join(share(*x) for x in cells)
            + f" FROM (SELECT patterns.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns, p{k}))"
        )
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_marks, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM split LEFT JOIN covered USING (doc_id)),
voted AS (SELECT *, {votes} FROM measured),
patterns AS MATERIALIZED (SELECT {", ".join(f"v_{r}" for r in rules)}, count(*) AS n FROM voted GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted, p{quality_rules.ROUNDS}"""


SQL_SOURCE_MIXING = """
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '')) AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
settled AS (SELECT arg_min(level, row(cap / weight, rank)) FILTER (cap >= weight * level) AS level FROM levels),
targets AS (SELECT source, source_size, rank, least(cap::DOUBLE, coalesce(weight * settled.level, cap::DOUBLE)) AS target FROM levels, settled),
queued AS (
  SELECT doc_id, size, source_size, target, rank, place, sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS running
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
entries AS (SELECT *, (running + k * source_size) / target AS finish FROM queued, range(2) e(k) WHERE size > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS upto FROM entries),
mixed AS (SELECT doc_id, place, running, rank, sum(size)::BIGINT AS taken FROM ordered WHERE upto <= 1.5::DOUBLE * (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(m.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN mixed m ON q.rank = m.rank AND q.running = m.running AND q.place = m.place AND q.size > 0"""


def sql_crc32(text: str) -> str:
    """CRC-32 of the UTF-8 of a SQL expression: four bits at a time, the low ones of each byte first, with the 16 remainders of the polynomial."""

    def remainder(bits: int) -> int:
        for _ in range(4):
            bits = bits >> 1 ^ (0xEDB88320 if bits & 1 else 0)
        return bits

    remainders, ones = [remainder(k) for k in range(16)], "4294967295::BIGINT"
    digit = f"strpos('0123456789abcdef', lower(substr(hex(encode({text})), (i + 1 - 2 * (i % 2) + 1)::INT, 1))) - 1"
    step = f"lambda a, x: xor(a >> 4, list_extract({remainders}::BIGINT[], (xor(a, x) & 15) + 1))"
    return f"xor(list_reduce(list_transform(range(2 * octet_length(encode({text}))), lambda i: {digit}), {step}, {ones}), {ones})"


def sql_spelling_variants() -> str:
    """Pairs meet at what is left when either loses a letter."""
    return f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, {sql_crc32("doc_id || ':' || run")} AS h FROM each),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.cut = b.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS best_n, min(other) FILTER (n = most) AS best FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM pairs) GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
led AS (
  WITH RECURSIVE r AS (SELECT word, word AS at FROM formed UNION ALL SELECT r.word, f.form FROM r JOIN formed f ON r.at = f.word WHERE f.form IS NOT NULL)
  SELECT r.word, r.at AS root FROM r JOIN formed f ON r.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN led USING (word)"""


SQL_DECONTAMINATION = """
WITH lower AS (
  SELECT 'item' AS kind, item_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
  UNION ALL SELECT 'doc', doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents),
split AS (SELECT kind, id, list_filter(regexp_split_to_array(coalesce(t, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM lower),
grams AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM split WHERE kind = 'item' AND len(w) > 0)),
windows AS (
  SELECT id AS doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (SELECT DISTINCT n FROM grams) WHERE kind = 'doc')),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN grams USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM split LEFT JOIN covered ON id = covered.doc_id LEFT JOIN named ON id = named.doc_id WHERE kind = 'doc'"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filters, op2_quality_classifier, op3_simhash_near_dedup, op4_quality_rules, op5_multi_index_hashing, op6_source_mixing,
        op7_suffix_array_dedup, op8_toxicity, op9_bpe, op10_warc, op11_spelling_variants, op12_embedding_whitening, op13_decontamination,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": sql_url_filters(), "op4_quality_rules": sql_quality_rules(), "op6_source_mixing": SQL_SOURCE_MIXING, "op11_spelling_variants": sql_spelling_variants(), "op13_decontamination": SQL_DECONTAMINATION}
