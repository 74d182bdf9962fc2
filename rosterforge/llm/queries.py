"""The queries of this subpackage and, where SQL can express them, their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, fim, langid, minhash, mixing, packing, pii, quality, sharding, wavelet, whitening
from .common import Scratch, held_out, table

SHARDS = 16
MIX_WEIGHTS = {"domain": {"web": 0.5, "reference": 0.3, "forum": 0.2}, "language": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 11
KEY = "rosterforge-demo-key"
END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domain(source):
    """The top of the tree, by the number of a source: documents have no column for it."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    k = F.coalesce(F.try_to_number(n, F.lit("999999999")).cast("int"), F.lit(0)) % 10
    return F.when(k < 5, "web").when(k < 8, "reference").otherwise("forum")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain(F.col("source")), MIX_SHARE, MIX_WEIGHTS, seed=MIX_SEED, max_epochs=MIX_EPOCHS).drop("order_key")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    x = quality.score(docs, model)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the whole documents as shards into the shared folder and read them back."""
    x = sharding.write_shards(table(spark, sf_dir, "documents"), Scratch(spark, "sharding").path("shards"), SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return x.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = pii.pseudonymise(docs, KEY)
    return x.select("doc_id", "text", F.size("pii").alias("n_pii"), F.to_json("pii").alias("spans"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    x = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def token_digest(docs: DataFrame) -> DataFrame:
    """Write docs as shards of wavelet matrices into the shared folder and read them back."""
    tmp = Scratch(docs.sparkSession, "tokens")
    wavelet.write_tokens(docs.select("doc_id", "text"), tmp.path("shards"), tokenizer_path(), END_ID)
    return wavelet.read_tokens(docs.sparkSession, tmp.path("shards")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


PLANTED = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = chat.format_paths(chat.root_paths(chat.linear(rows.unionByName(planted))))
    out = Scratch(spark, "chat").write(out, "formatted")
    x = chat.parse(out)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return x.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return x.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond a long


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the packed sequences into the shared folder and read them back, with the step group of each."""
    tmp = Scratch(spark, "packing")
    packing.write_packed(table(spark, sf_dir, "documents"), tmp.path("sequences"), tokenizer_path("word_bpe_49k.json"), END_ID)
    x = packing.read_packed(spark, tmp.path("sequences"))
    steps = packing.step_groups(x).select("sequence_id", "step")
    return packing.pieces_of(x).join(steps, "sequence_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    own = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    return x.select(*own, sha(F.col("output")).alias("output_sha256"), sha(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_mixing, op3_quality, op4_sharding, op5_pii, op6_minhash_dedup, op7_decontaminate, op8_language_id, op9_token_ids, op10_chat,
        op11_whitening, op12_packing, op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""",
    "op10_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<', '\<'), '#', '\#')) + length(replace(replace(replace(text, '\', '\\'), '<', '\<'), '#', '\#')) + 18 AS chars FROM c),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(chars) AS chars FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT *, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
          sha256(t) AS restored_sha256
        FROM p""",
}
