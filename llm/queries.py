"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.session import fresh_path
from llm import decontamination, licenses, minhash, packing, passages, pii, quality, resampling, runs, toolcalls, toxicity, vectors, warc
from llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine's public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"), size=3, num=85, den=100)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


# Tools of the conversations: what a user or a system turn asks for.
TOOLS = {"reply": {"n_chars": "integer", "text": "string", "turn": "integer"}, "configure": {"n_chars": "integer", "text": "string", "turn": "integer"}}


def tool_tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool calls and results: an assistant turn is the result of the turn before it.

    Arguments, order and deliveries are disturbed by rules on conv_id and turn: arguments with a
    wrong type, without a field, with one too many, or no JSON at all; unknown tools; conversations
    told backwards, so every call comes before what it depends on; calls that also depend on the next
    ones, which makes cycles; calls and results sent twice.
    """
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    key = lambda turn: F.concat_ws("-", F.lit("c"), "conv_id", turn.cast("string"))
    size, number = F.length("text").alias("n_chars"), (conv + turn) % 11
    arguments = F.when(number == 1, F.to_json(F.struct(turn.cast("string").alias("turn"), "text", size)))
    arguments = arguments.when(number == 2, F.to_json(F.struct("text", "turn")))
    arguments = arguments.when(number == 3, F.to_json(F.struct("turn", F.lit(True).alias("note"), "text", size)))
    arguments = arguments.when(number == 4, F.concat(F.lit("{"), "text")).when(number == 5, F.lit(None))
    before, behind = [key(turn - 1), key(turn - 2)], [key(turn + 1), key(turn + 2)]
    calls = conversations.where("role <> 'assistant'").select(
        "conv_id",
        key(turn).alias("call_id"),
        F.when(conv % 4 == 1, -turn).otherwise(turn).alias("position"),
        F.when(number == 6, "search").when(F.col("role") == "system", "configure").otherwise("reply").alias("name"),
        arguments.otherwise(F.to_json(F.struct("turn", "text", size))).alias("arguments"),
        F.when((conv % 8 == 2) & (turn <= 2), F.array(*before, *behind)).otherwise(F.array(*before)).alias("depends_on"),
    )
    again = calls.where(conv % 5 == 0).withColumns({"position": F.col("position") + 1000, "arguments": F.lit("{}"), "name": F.lit("late")})
    results = conversations.where("role = 'assistant'").select("conv_id", key(turn - 1).alias("call_id"), turn.alias("position"), text.alias("content"))
    late = results.where(conv % 3 == 0).withColumns({"position": F.col("position") + 1000, "content": F.lit("late")})
    return calls.unionByName(again), results.unionByName(late)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = toolcalls.link(spark, *tool_tables(read(spark, sf_dir, "conversations")), TOOLS)
    return linked.select("conv_id", "call_id", "place", "step", "name", "n_results", F.array_join("errors", ";").alias("errors"), F.sha2("canonical", 256).alias("canonical_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, read(spark, sf_dir, "embeddings"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(spark, read(spark, sf_dir, "documents")).drop("kept_text")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by their doc_id's CRC-32, repeat some words to their end."""
    if doc_id is None or not words:
        return words
    chosen, number = zlib.crc32(str(doc_id).encode()) % 10 == 0, zlib.crc32(str(doc_id).encode()) // 10
    if not chosen:
        return words
    start = number % len(words)
    rest = len(words) - start
    period = 1 + rest // (3 + number % 8)
    return words[:start] + (words[start : start + period] * (rest // period + 1))[:rest]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(read(spark, sf_dir, "documents"), least=6, exponent=4, edit=planted)
    best = runs.longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(spark, read(spark, sf_dir, "pages"), path, least=100)
    return warc.read(spark, path)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), order=1, buckets=10_000, seed=2024, least_words=20, percent=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_pii, op3_minhash, op4_packing, op5_tool_calls, op6_decontamination, op7_quality,
        op8_toxicity, op9_vectors, op10_passages, op11_runs, op12_warc, op13_resampling,
    )
}


def op5_sql() -> str:
    """The tool-call query in DuckDB's SQL.

    Calls of a conversation with at most two turns between them form a chain. Told backwards, the
    chain's first turn is the place of all of it; a chain that begins at turn 2 or before and has
    several calls is a cycle where the first turns depend on the next ones.
    """
    return """
    WITH calls AS (
        SELECT conv_id, turn, 'c-' || conv_id || '-' || turn AS call_id, (conv_id + turn) % 11 AS number,
               CASE WHEN (conv_id + turn) % 11 = 6 THEN 'search' WHEN role = 'system' THEN 'configure' ELSE 'reply' END AS name, text
        FROM conversations WHERE role <> 'assistant'),
    gaps AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM calls),
    chains AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM gaps),
    placed AS (
        SELECT *, min(turn) OVER (PARTITION BY conv_id, chain) AS first, count(*) OVER (PARTITION BY conv_id, chain) AS calls,
               row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) - 1 AS number_in_chain
        FROM chains),
    ordered AS (
        SELECT *, conv_id % 8 = 2 AND first <= 2 AND calls > 1 AS cyclic,
               CASE WHEN conv_id % 4 = 1 THEN -first ELSE turn END AS place, CASE WHEN conv_id % 4 = 1 THEN number_in_chain ELSE 0 END AS step
        FROM placed),
    results AS (
        SELECT conv_id, turn - 1 AS turn, count(*) AS sent, min(text) AS content
        FROM conversations WHERE role = 'assistant' GROUP BY ALL),
    checked AS (
        SELECT *,
               CASE WHEN number IN (4, 5) THEN 'arguments' WHEN number = 6 THEN 'tool' WHEN number = 1 THEN 'type turn'
                    WHEN number = 2 THEN 'missing n_chars' WHEN number = 3 THEN 'unknown note' ELSE '' END AS errors,
               CASE WHEN number IN (4, 5) THEN 'null' ELSE
                    '{' || CASE WHEN number = 2 THEN '' ELSE '"n_chars":' || length(text) || ',' END
                    || CASE WHEN number = 3 THEN '"note":true,' ELSE '' END || '"text":' || to_json(text) || ',"turn":'
                    || CASE WHEN number = 1 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '}' END AS arguments
        FROM ordered LEFT JOIN results USING (conv_id, turn))
    SELECT conv_id, call_id, CASE WHEN NOT cyclic THEN place END AS place, CASE WHEN NOT cyclic THEN step END AS step, name,
           coalesce(CASE WHEN conv_id % 3 = 0 THEN 2 * sent ELSE sent END, 0) AS n_results, errors,
           sha256('{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(content), 'null') || '}')
               AS canonical_sha256
    FROM checked
    """


def crc32_sql(data: str) -> str:
    """The CRC-32 of a blob in DuckDB's SQL, byte by byte."""
    step = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {start})"
    byte = f"CAST('0x' || substr(hex({data}), 2 * i + 1, 2) AS BIGINT)"
    crc = f"list_reduce(list_transform(range(octet_length({data})), lambda i: {byte}), lambda crc, b: xor(crc >> 8, {step.format(start='xor(crc & 255, b)')}), 4294967295)"
    return f"xor({crc}, 4294967295)"


def op11_sql() -> str:
    """Runs from places that are a whole number of periods into the text, three of which a run must hold."""
    return f"""
    WITH split AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("encode(CAST(doc_id AS VARCHAR))")} AS h
        FROM documents),
    sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
    cut AS (SELECT *, g % greatest(n, 1) AS a FROM sized),
    docs AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
            ELSE w END AS w
        FROM cut),
    steps AS (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM docs),
    -- three periods of a run of four begin at a multiple of the period, so two such pairs of words agree
    seen AS (
        SELECT doc_id, q FROM steps, unnest(range(0, n - 2 * q, q)) AS t(i)
        WHERE w[i + 1] = w[i + q + 1] AND w[i + q + 1] = w[i + 2 * q + 1] GROUP BY ALL),
    words AS (SELECT doc_id, n, q, unnest(range(n - q)) AS i, w FROM seen JOIN docs USING (doc_id)),
    equal AS (SELECT doc_id, q, i FROM words WHERE w[i + 1] = w[i + q + 1]),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
    stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
    runs AS (
        SELECT doc_id, start, length, min(q) AS period FROM stretches
        WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
    listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
               first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best
        FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    left_over AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
        FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
           1000 * best.length // best.period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN left_over USING (doc_id)
    """


def op12_sql() -> str:
    return """
    WITH read AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    named AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM read),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM firsts
    """


def op13_sql() -> str:
    words = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    return f"""
    WITH mine AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {words} AS word FROM documents) GROUP BY ALL),
    theirs AS (SELECT word, count(*) AS n FROM (SELECT {words} AS word FROM benchmark) GROUP BY ALL),
    vocabulary AS (SELECT word FROM mine UNION SELECT word FROM theirs),
    hashed AS (SELECT word, {crc32_sql("encode(word)")} % 10000 AS bucket FROM vocabulary),
    corpus AS (SELECT bucket, sum(n) AS s FROM mine JOIN hashed USING (word) GROUP BY bucket),
    target AS (SELECT bucket, sum(n) AS t FROM theirs JOIN hashed USING (word) GROUP BY bucket),
    sizes AS (SELECT coalesce((SELECT sum(s) FROM corpus), 0) AS all_s, coalesce((SELECT sum(t) FROM target), 0) AS all_t),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (all_s + 10000)
                                            / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
        FROM corpus FULL JOIN target USING (bucket), sizes),
    weights AS (
        SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
        FROM mine JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM documents LEFT JOIN weights USING (doc_id)),
    ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
        FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)
    """


ORACLE: dict[str, str] = {"op5_tool_calls": op5_sql(), "op11_runs": op11_sql(), "op12_warc": op12_sql(), "op13_resampling": op13_sql()}
