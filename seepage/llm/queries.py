"""Queries of the training-data operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.functions.text import let
from seepage.llm import (
    host_reputation, language, mixing, ngram_join, ngram_lm, outliers, packing, periodic, token_files, token_lengths, topk, toxicity,
    vector_codes,
)
from seepage.llm.tables import table
from seepage.sources.checkpoint import fresh_folder

RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return token_lengths.length_report(table(spark, sf, "documents"))


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    judged = host_reputation.judge(table(spark, sf, "pages"), table(spark, sf, "labels").select("doc_id", bad.alias("bad")), RULES)
    return judged.withColumns({"bad_share": F.round("bad_share", 6), "bound": F.round("bound", 6)})


def op4_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_near_documents(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.predict(docs, toxicity.train_from_labels(docs, table(spark, sf, "labels")))


def op6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", topk.quantized(F.col("embedding"), 64).alias("codes"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf, "documents"))


def op8_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.judge(table(spark, sf, "documents"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    profiles = language.learn(docs.filter(~held_out()))
    return language.predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    manifest = token_files.write(table(spark, sf, "documents"), folder)
    return token_files.read(spark, folder, manifest)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        g, n = F.floor(draw / 10), F.size(words)
        first = (g % n).cast("int")
        return F.when(n > 0, periodic.repeated_tail(words, first, (F.floor((n - first) / (3 + g % 8)) + 1).cast("int"))).otherwise("")

    text = F.when(draw % 10 == 0, let(periodic.words_of(F.col("text")), planted)).otherwise(F.col("text"))
    found = periodic.periodic(table(spark, sf, "documents").select("doc_id", text.alias("text"))).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_ngram_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = ngram_lm.held_out(F.col("doc_id"))
    model = ngram_lm.train(docs.filter(~held))
    return ngram_lm.score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf, "embeddings"), ["label"])
    return vector_codes.label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_token_lengths, op3_url_filter, op4_pack, op5_toxicity, op6_top_k, op7_ngram_join, op8_outliers, op9_language, op10_token_files,
    op11_periodic_runs, op12_ngram_lm, op13_vector_codes)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"'[^\x20\x09-\x0D]+'"

_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {WORDS})), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget,
  CAST(coalesce(sum(2 * source_size) OVER before, 0) AS BIGINT) AS given,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS open
  FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (budget - given) * weight >= 2 * source_size * open AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE
  (budget - CAST(coalesce(sum(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0) AS BIGINT)) * weight
  / CAST(sum(CASE WHEN NOT is_full THEN weight END) OVER () AS BIGINT) END AS target FROM f),
u AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS units,
  CAST('0x' || left(md5('mix' || coalesce('=' || d.source, 'null')), 6) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(start + sum(units) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM u)
SELECT doc_id, size, source_size, target, (stop // 16777216 - (stop - units) // 16777216) * size AS taken FROM e"""


def _shrunk(children: str, parents: str, key: str) -> str:
    """Posterior counts of ``children`` from the mean and the fitted strength of ``parents``."""
    noise = "mean * (1 - mean)"
    spread = f"""SELECT {key}, mean, sum(total * pow(bad / total - mean, 2)) AS scatter, count(*) AS k, sum(total) AS n, sum(total * total) AS squares
      FROM (SELECT c.*, p.mean FROM {children} AS c JOIN {parents} AS p USING ({key}) WHERE c.total > 0) AS r GROUP BY {key}, mean"""
    rho = f"SELECT {key}, CASE WHEN room > 0 THEN greatest((scatter - {noise} * (k - 1)) / room, 0) ELSE 0 END AS rho FROM (SELECT *, {noise} * (n - squares / n - (k - 1)) AS room FROM ({spread}) AS x) AS y"
    prior = f"SELECT p.{key}, p.mean AS m, greatest(1, least(1000, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000))) AS s FROM {parents} AS p LEFT JOIN ({rho}) AS q USING ({key})"
    return f"""SELECT *, a / (a + b) AS mean FROM (SELECT c.*, m * s + c.bad AS a, (1 - m) * s + c.total - c.bad AS b FROM {children} AS c JOIN ({prior}) AS p USING ({key})) AS z"""


def _rules() -> tuple[str, str]:
    name, verdict = "NULL", "NULL"
    for kind, rule in sorted(RULES, key=lambda r: len(r[1])):
        own, start = rule.split("/", 1)
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}')"
        name, verdict = f"CASE WHEN {fits} THEN '{rule}' ELSE {name} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return name, verdict


_URLS = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT doc_id, max(greatest(CAST(quality = 0 AS INT), CAST(toxic = 1 AS INT))) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, split_part(host, '.', -1) AS suffix,
  CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain, bad, total FROM (
  SELECT host, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, CAST(count(bad) AS DOUBLE) AS total FROM p
  LEFT JOIN k ON k.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.\w+)?/?$', 1), '') AS BIGINT) GROUP BY host) AS c),
d AS (SELECT domain, suffix, sum(bad) AS bad, sum(total) AS total FROM h GROUP BY ALL),
s AS (SELECT suffix, '' AS root, sum(bad) AS bad, sum(total) AS total FROM d GROUP BY ALL),
r AS (SELECT root, CAST(sum(bad) + 0.5 AS DOUBLE) / CAST(sum(total) + 1.0 AS DOUBLE) AS mean FROM s GROUP BY root),
s2 AS ({_shrunk('s', 'r', 'root')}),
d2 AS ({_shrunk('d', 's2', 'suffix')}),
h2 AS ({_shrunk('h', 'd2', 'domain')}),
j AS (SELECT host, mean, greatest(0, mean - CAST(1.645 AS DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS bound FROM h2)
SELECT page_id, host, path, {_rules()[0]} AS rule, coalesce({_rules()[1]}, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS bad_share, round(bound, 6) AS bound FROM p JOIN j USING (host)"""

_TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) AS r WHERE rank <= 20"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM w),
s AS (SELECT doc_id, unnest(x) AS s FROM x),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN x AS a ON a.doc_id = u JOIN x AS b ON b.doc_id = v WHERE 100 * n >= 80 * (len(a.x) + len(b.x) - n)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM x UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v)
SELECT doc_id, len(x) AS n_shingles, component_id FROM x JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) AS c ON c.u = doc_id"""



def _codes(rounds: int = 2) -> str:
    def assigned(name: str, books: str) -> str:
        apart = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i])))"
        return f"{name} AS (SELECT vec_id, part, CAST(min({apart} * 64 + e) AS BIGINT) AS best FROM p JOIN {books} AS e USING (part) GROUP BY ALL)"

    steps = []
    for r in range(rounds):
        steps.append(assigned(f"a{r}", f"e{r}"))
        steps.append(f"""e{r + 1} AS (SELECT o.part, o.e, coalesce(m.x, o.x) AS x FROM e{r} AS o LEFT JOIN (
          SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
            SELECT part, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (
              SELECT p.part, best % 64 AS e, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM a{r} JOIN p USING (vec_id, part)) AS u GROUP BY ALL) AS t GROUP BY ALL) AS m USING (part, e))""")
    steps.append(assigned("done", f"e{rounds}"))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, c[part * (len(c) // 16) + 1 : (part + 1) * (len(c) // 16)] AS x FROM v, range(16) AS t(part)),
e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < 64),
{", ".join(steps)},
s AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM done GROUP BY vec_id),
l AS (SELECT s.*, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM s JOIN v USING (vec_id))
SELECT *, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM e{rounds}) AS codebooks_sha256 FROM l"""


#: Encoding, regression, search trees, profiles and robust estimates are not SQL; tests hold those against brute force.
ORACLES = {"op1_mix_sources": _MIX, "op3_url_filter": _URLS, "op6_top_k": _TOP, "op7_ngram_join": _NEAR, "op13_vector_codes": _codes()}
