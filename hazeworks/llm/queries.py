"""Queries of this subpackage for the driver: each reads its whole table and returns its operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.llm import bpe, licenses, merkle, mixing, neardup, pii, quality, repeats, search, sharding, substrings, vectors, warc
from hazeworks.llm.common import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), shards=24)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir), temperature=0.7, seed=17)
    return mixed.select("doc_id", "source", F.col("mix_copy").alias("copy"), F.col("mix_copies").alias("copies"), F.round("mix_rate", 6).alias("rate"), F.col("mix_order").alias("shuffle_key"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate_documents(_documents(spark, sf_dir))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), neardup.Settings(width=2, threshold=80))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.self_search(_documents(spark, sf_dir), every=20, k=10, alike=["lang"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir), with_text=False).drop("kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectors.quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256)
    digest = F.lit(vectors.codebooks_digest(books)).alias("codebooks_sha256")
    return vectors.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in columns]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf(*lowered))
    rows = merkle.manifest(_documents(spark, sf_dir), columns, "source", "doc_id", carried={"tampered": tampered})
    seen = merkle.verified(rows.withColumn("seen", F.coalesce("tampered", "leaf")), "seen")
    return seen.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir), with_text=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_neardup": op2_neardup,
        "op3_pii": op3_pii,
        "op4_mixing": op4_mixing,
        "op5_quality": op5_quality,
        "op6_search": op6_search,
        "op7_warc": op7_warc,
        "op8_substrings": op8_substrings,
        "op9_bpe": op9_bpe,
        "op10_licenses": op10_licenses,
        "op11_vectors": op11_vectors,
        "op12_merkle": op12_merkle,
        "op13_repeats": op13_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_quality": OP5_SQL, "op6_search": OP6_SQL, "op10_licenses": _op10_sql(), "op11_vectors": OP11_SQL, "op12_merkle": _op12_sql(), "op13_repeats": OP13_SQL}


OP4_SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), shares AS (
  SELECT source, pow(size, 0.7) * (sum(size) OVER ()) / (size * sum(pow(size, 0.7)) OVER ()) AS rate FROM sizes
), pmf AS (
  SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM shares, (SELECT unnest(range(0, 400)) AS k)
), cdf AS (
  SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), drawn AS (
  SELECT doc_id, source, text,
         (CAST('0x' || substr(md5('17|' || id_text), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u, id_text
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, ''))) AS id_text FROM documents)
), counted AS (
  SELECT d.doc_id, d.id_text, d.source, d.text, c.rate, count(*) FILTER (WHERE c.c < d.u) AS copies
  FROM (SELECT *, row_number() OVER () AS row_no FROM drawn) d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY d.row_no, d.doc_id, d.id_text, d.source, d.text, c.rate
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS "copy", CAST(copies AS INTEGER) AS copies, round(rate, 6) AS rate,
       md5('17|' || id_text || '|' || CAST(copy AS VARCHAR)) AS shuffle_key,
       md5(coalesce(text, '')) AS text_md5
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
"""

OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY doc_id, term
), lengths AS (
  SELECT d.doc_id, coalesce(sum(t.tf), 0) AS dl FROM documents d LEFT JOIN tf t USING (doc_id) GROUP BY d.doc_id
), stats AS (
  SELECT count(*) AS n, avg(dl) AS mean FROM lengths
), idf AS (
  SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id AS hit_id,
         round(sum(i.idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.dl / s.mean))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN idf i USING (term) JOIN lengths l ON l.doc_id = d.doc_id, stats s
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id
)
SELECT query_id, CAST(rank AS INTEGER) AS "rank", hit_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM scored)
WHERE rank <= 10
"""

OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM windows) WHERE k > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (
  base_failed OR n_symbols * 10 > n_words OR (n_dup_lines > 3 AND n_dup_lines * 10 > len(string_split(t, chr(10))) * 3) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
  OR n_repeat_words * 10 > n_words * 4 OR length(regexp_replace(t, '[^!]', '', 'g')) * 5 > n_words
  OR length(regexp_replace(t, '[^A-Z]', '', 'g')) * 2 > word_chars OR length(regexp_replace(t, '[^0-9]', '', 'g')) * 5 > word_chars * 2) AS kept
FROM f
"""


def _op10_sql() -> str:
    """Without the operator's bounds: every segment against every template, every anchored window against its own."""
    templates = ", ".join(f"('{n}', {sorted(licenses.bigrams(body))!r}, {licenses.length(body)})" for n, body in licenses.TEMPLATES.items())
    anchors = ", ".join(map(repr, licenses.anchors(licenses.TEMPLATES, licenses.THRESHOLD)))
    return r"""
WITH templates(name, b, n) AS (VALUES TEMPLATES), anchors(name, x, o) AS (VALUES ANCHORS), segments AS (
  SELECT doc_id, 1 AS part, 'line' AS kind, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
  UNION ALL SELECT doc_id, 2, 'paragraph', unnest(p), generate_subscripts(p, 1) - 1 FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09\r]*\n') AS p FROM documents)
  UNION ALL SELECT doc_id, 3, 'text', coalesce(text, ''), 0 FROM documents
), pairs AS (
  SELECT doc_id, part, kind, i, list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1]) AS p
  FROM (SELECT *, string_split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM segments)
), own AS (
  SELECT doc_id, part, kind, i, list_distinct(p) AS b FROM pairs
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, p FROM pairs WHERE part = 3
), starts AS (
  SELECT DISTINCT r, name, greatest(i - o, 0) AS i FROM (SELECT r, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM texts) JOIN anchors USING (x)
), windows AS (
  SELECT doc_id, r, i, name, b AS tb, list_distinct(p[i + 1 : i + n]) AS b FROM starts JOIN texts USING (r) JOIN templates USING (name)
), near AS (
  SELECT doc_id, r, i, name, len(list_intersect(b, tb)) AS shared, len(b) + len(tb) AS total, len(tb) AS size FROM windows
), rated AS (
  SELECT o.doc_id, o.part, o.kind, o.i, t.name, len(list_intersect(o.b, t.b)) AS shared, len(o.b) + len(t.b) AS total, len(t.b) AS size FROM own o, templates t WHERE len(o.b) > 0
), best AS (
  SELECT *, round(2.0::DOUBLE * shared / total, 4) AS d, row_number() OVER (PARTITION BY doc_id, part, i ORDER BY 2.0::DOUBLE * shared / total DESC, name) AS n FROM rated WHERE 200 * shared >= 80 * total
  UNION ALL SELECT doc_id, 4, 'window', i, name, shared, total, size, round(2.0::DOUBLE * shared / total, 4), row_number() OVER (PARTITION BY r, name ORDER BY 2.0::DOUBLE * shared / total DESC, i)
  FROM near WHERE 200 * shared >= 80 * total
), found AS (
  SELECT doc_id, arg_min(name, (size - 2 * shared, -(2.0::DOUBLE * shared / total), name)) AS license, arg_min(d, (size - 2 * shared, -(2.0::DOUBLE * shared / total), name)) AS dice, count(*) AS n_matches, string_agg(kind || ':' || i || ':' || name || ':' || d, ',' ORDER BY part, CASE part WHEN 4 THEN 0 ELSE i END, name) AS matches
  FROM best WHERE n = 1 GROUP BY doc_id
)
SELECT d.doc_id, license, dice, coalesce(n_matches, 0) AS n_matches, coalesce(matches, '') AS matches FROM documents d LEFT JOIN found USING (doc_id)
""".replace("TEMPLATES", templates).replace("ANCHORS", anchors)


def _op11_sql(rounds: int = 2) -> str:
    """Every distance of every part to every entry, in whole numbers."""
    apart = "list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - b.q[i]) * (p.q[i] - b.q[i])))"
    nearest = f"SELECT r, part, any_value(q) AS q, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.r, p.part, p.q, b.entry, {apart} AS d FROM p JOIN b{{n}} b USING (part)) GROUP BY r, part"
    steps = []
    for n in range(rounds):
        mean = "(s - ((s % n + n) % n)) // n"
        sums = f"SELECT part, entry, i, {mean} AS c FROM (SELECT part, entry, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, q, unnest(range(1, len(q) + 1)) AS i FROM a{n}) GROUP BY part, entry, i)"
        steps.append(f"a{n} AS ({nearest.format(n=n)})")
        steps.append(f"b{n + 1} AS (SELECT part, entry, coalesce(m.q, b.q) AS q FROM b{n} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS q FROM ({sums}) GROUP BY part, entry) m USING (part, entry))")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, part, list_transform(e[part * w + 1 : (part + 1) * w], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM (SELECT r, e, w, unnest(range(0, 16)) AS part FROM v)
), b0 AS (
  SELECT part, r - 1 AS entry, q FROM p WHERE r <= 64
), {", ".join(steps)}, a AS ({nearest.format(n=rounds)}), coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), books
"""


OP11_SQL = _op11_sql()


def _op12_sql(levels: int = 5) -> str:
    """Trees of up to 16^levels leaves, level by level."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, first: str) -> list[str]:
        """Nodes name0 .. (g, i, h, n), their siblings name_s0 .., and the last node of each group, name_top."""
        steps = [f"{name}0 AS ({first})"]
        for k in range(levels):
            steps.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16, n)")
            left, right = (f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i {sign} a.i), '')" for sign in "<>")
            steps.append(f"{name}_s{k} AS (SELECT a.g, a.i, {left} AS l, {right} AS r FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.g, a.i)")
        return [*steps, f"{name}_top AS ({' UNION ALL '.join(f'SELECT g, h FROM {name}{k} WHERE n = 1' for k in range(levels + 1))})"]

    steps = [
        "bits AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)",
        "crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, bits)",
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS h, CASE WHEN crc % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM crc)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        *tree("u", "SELECT g, i, h, n FROM placed"),
        *tree("v", "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM u_top"),
        "tops AS (SELECT g AS source, h, row_number() OVER (ORDER BY g) - 1 AS place FROM u_top)",
        "f0 AS (SELECT doc_id, p.h AS leaf, coalesce(tampered, p.h) AS x, '' AS proof, p.g AS own, p.i AS at, t.h AS subroot, t.place FROM placed p JOIN tops t ON p.g = t.source)",
    ]
    k = 0
    for name, group, at in (("u", "f.own", "f.at"), ("v", "''", "f.place")):
        for level in range(levels):
            steps.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.l IS NULL THEN x ELSE sha256(s.l || x || s.r) END AS x, proof || coalesce(s.l || s.r, '') AS proof) FROM f{k} f LEFT JOIN {name}_s{level} s ON s.g = {group} AND s.i = {at} // {16**level})")
            k += 1
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, v_top.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = v_top.h AS verified FROM f{k}, v_top"


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
