"""The operators bound to the driver tables, one thin query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lang_id, merkle, quality_model, quality_rules, warc
from docloom.llm.bpe import decode_ids, encode_documents
from docloom.llm.click_dedup import deduplicate_clicks
from docloom.llm.common import Scratch, crc32_of_id, read_table, remove
from docloom.llm.decontamination import find_leaks
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.packing import pack
from docloom.llm.sharding import shard
from docloom.llm.token_counts import count_tokens


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    path = warc.archive_dir(spark)
    index = warc.write_archives(pages, path, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    read = warc.read_records(index, path, payload=False)
    out = read.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
    with Scratch(spark, "records") as scratch:  # what is returned is narrow; the archives go
        out = scratch.write(out, "records", keep=True)
        remove(spark, path)
        return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    remainder = F.coalesce(crc32_of_id("doc_id") % 4, F.lit(-1))
    models = lang_id.train(docs.where((remainder != 2) & (remainder >= 0)), "doc_id", "text", "lang")
    return docs.select("doc_id", (remainder == 2).alias("held_out"), lang_id.identify("text", models, spark).alias("got")).select("doc_id", "held_out", "got.lang_pred", "got.score", "got.rejected")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    remainder = F.coalesce(crc32_of_id("doc_id") % 3, F.lit(-1))
    model = quality_model.train(labels.where((remainder != 1) & (remainder >= 0)), docs, "doc_id", "text", "quality")
    scored = docs.select("doc_id", (remainder == 1).alias("held_out"), quality_model.score("text", model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint")
    return shard(docs).select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or vocabulary()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_documents(docs, path).select("doc_id", "ids")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode_ids(F.col("ids"), path).cast("binary"), 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.apply_rules(docs, always=measures).select("doc_id", *measures, base.alias("base_failed"), "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path or vocabulary()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "merkle") as scratch:
        proofs = merkle.document_manifest(read_table(spark, sf_dir, "documents"), scratch).proofs()
    folded = merkle.fold(F.coalesce("tampered", "leaf"), "path")
    proof = F.sha2(merkle.siblings("path").cast("binary"), 256)
    return proofs.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"), path or vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = deduplicate_clicks(read_table(spark, sf_dir, "clicks"))
    return windows.select(F.col("key").alias("click_id"), "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_decontamination": op2_decontamination, "op3_lang_id": op3_lang_id, "op5_sharding": op5_sharding, "op4_near_dedup": op4_near_dedup, "op7_quality_model": op7_quality_model, "op6_bpe": op6_bpe, "op8_line_dedup": op8_line_dedup, "op9_quality_rules": op9_quality_rules, "op10_token_counts": op10_token_counts, "op11_merkle": op11_merkle, "op12_packing": op12_packing, "op13_click_dedup": op13_click_dedup}


_WORD = r"[^\x20\x09-\x0D]+"

_NEAR_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
runs AS (SELECT r, x || chr(1) || lead(x, 1) OVER o || chr(1) || lead(x, 2) OVER o || chr(1) || lead(x, 3) OVER o || chr(1) || lead(x, 4) OVER o AS s FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
sh AS (SELECT DISTINCT r, s FROM runs WHERE s IS NOT NULL UNION ALL SELECT r, array_to_string(w, chr(1)) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON b.s = a.s AND b.r > a.r GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT reach.r, min(o.doc_id) AS c FROM reach JOIN d o ON o.r = reach.other GROUP BY 1) m ON m.r = d.r"""

_RULES_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT r, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM grams WHERE z IS NOT NULL) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) AS n_letters,
  [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORD}')] AS lines, coalesce(cover.n, 0) AS n_repeat_words FROM d LEFT JOIN cover ON cover.r = d.r),
q AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len([x for x in lines if regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')]) AS n_bullets FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_letters < 50 * word_chars OR 100 * n_bullets > 90 * n_lines) AS kept FROM q"""


_WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p"""

# A line of one edit from another of at least its length shares its first or its last half with it, at the length of the shorter.
_LINES_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, {'d': doc_id, 'p': pos} AS place FROM l),
f AS (SELECT line, min(place) AS first, length(line) AS n FROM t WHERE line <> '' GROUP BY line),
k AS (SELECT line, first, n, base, side, CASE side WHEN 0 THEN left(line, base // 2) ELSE right(line, base - base // 2) END AS part FROM (SELECT *, unnest([n, n - 1]) AS base FROM f WHERE n >= 40), (SELECT unnest([0, 1]) AS side)),
c AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS na, b.n AS nb, b.first < a.first AS later FROM k a JOIN k b ON a.base = b.base AND a.side = b.side AND a.part = b.part WHERE a.line <> b.line AND a.n <= b.n AND a.n = a.base),
near AS (SELECT DISTINCT CASE WHEN later THEN a ELSE b END AS line FROM c WHERE CASE WHEN na = nb THEN len([i for i in range(1, na + 1) if substr(a, i, 1) <> substr(b, i, 1)]) <= 1 ELSE len([i for i in range(0, nb) if left(b, i) || substr(b, i + 2) = a]) > 0 END),
j AS (SELECT t.*, t.line <> '' AND t.place > f.first AS equal, near.line IS NOT NULL AS alike FROM t LEFT JOIN f ON f.line = t.line LEFT JOIN near ON near.line = t.line),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE equal) AS n_exact, count(*) FILTER (WHERE alike AND NOT coalesce(equal, false)) AS n_near, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(equal, false) AND NOT alike), '') AS text FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, length(r.text) AS n_chars, sha256(r.text) AS text_sha256 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""


def _merkle_sql(levels: int = 8, heads: int = 4) -> str:
    """The tree's levels written out one by one (8 ** levels documents a language at most); a root is carried up unchanged."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    byte = "n"
    for _ in range(8):
        byte = f"[CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END for x in {byte}]"
    codes = "list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, byte[(xor(a, b) & 255) + 1])), 4294967295)"
    nodes = "SELECT *, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM (SELECT *, count(*) OVER (PARTITION BY g) AS w FROM ({})) WINDOW r AS (PARTITION BY g, i // 8 ORDER BY i)"
    up = "SELECT g, i // 8 AS i, CASE WHEN max(w) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {} GROUP BY 1, 2"
    parts = [
        f"crcs AS MATERIALIZED (SELECT {byte} AS byte FROM (SELECT CAST(range(256) AS BIGINT[]) AS n))",
        f"doc AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS d, CASE WHEN {crc} % 3 = 0 THEN {leaf('lower_text')} END AS t FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents), crcs)",
        "langs AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents))",
        "leaves AS MATERIALIZED (SELECT doc_id, g, d, t, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d, t) - 1 AS i FROM doc JOIN langs ON langs.lang IS NOT DISTINCT FROM doc.lang)",
    ]
    for name, first, n in (("n", "SELECT g, i, d FROM leaves", levels), ("h", f"SELECT 0 AS g, g AS i, d FROM n{levels - 1}", heads)):
        parts += [f"{name}{k} AS MATERIALIZED ({nodes.format(up.format(f'{name}{k - 1}') if k else first)})" for k in range(n)]
    steps = {f"n{k}": f"n{k}.g = leaves.g AND n{k}.i = leaves.i // {8**k}" for k in range(levels)} | {f"h{k}": f"h{k}.i = leaves.g // {8**k}" for k in range(heads)}
    others, runs = " || ".join(f"{x}.pre || {x}.post" for x in steps), ", ".join(f"{{'w': {x}.w, 'pre': {x}.pre, 'post': {x}.post}}" for x in steps)
    parts.append(f"f0 AS (SELECT doc_id, leaves.d AS leaf, n{levels - 1}.d AS subroot, h{heads - 1}.d AS root, sha256({others}) AS proof_sha256, coalesce(leaves.t, leaves.d) AS c, [{runs}] AS s FROM leaves {' '.join(f'JOIN {x} ON {on}' for x, on in steps.items())})")
    parts += [f"f{k} AS (SELECT * EXCLUDE (c), CASE WHEN s[{k}].w = 1 THEN c ELSE sha256(s[{k}].pre || c || s[{k}].post) END AS c FROM f{k - 1})" for k in range(1, len(steps) + 1)]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, c AS folded_root, c = root AS verified FROM f{len(steps)}"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op1_warc": _WARC_SQL, "op8_line_dedup": _LINES_SQL, "op4_near_dedup": _NEAR_SQL, "op9_quality_rules": _RULES_SQL, "op11_merkle": _merkle_sql()}
