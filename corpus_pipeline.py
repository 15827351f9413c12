"""The corpus pipeline: documents through stages, each an operator of loomtable.llm.

Every stage works on all rows that the one before kept. The first four return the columns
of documents; a text that loses lines gets a new n_chars. The quality stage drops the
documents that the rules or the likelihood ratio reject, near-dedup all but one of each
class, decontamination those that leak a benchmark item; the last stage returns token ids.

Rows with equal doc_id and text are one document from near-dedup on; null texts have no
words and go in the first stage."""

from pyspark.sql import functions as F

from loomtable.llm import bag_minhash, byte_bpe, decontaminate, line_dedup, quality_rules
from loomtable.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs, sf_dir):
    """Documents that the rules and the likelihood ratio keep."""
    rows = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    gone = rows.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (key == gone["_k"]), "left_anti").select(*COLUMNS)


def lines(spark, docs, sf_dir):
    """All documents, less the lines of chunks that occurred before."""
    out = line_dedup.dedup(docs)
    n_chars = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def near(spark, docs, sf_dir):
    """One document of each class of near duplicates."""
    return bag_minhash.keep_one(docs.select(*COLUMNS))


def benchmark(spark, docs, sf_dir):
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """doc_id, lang, source, n_chars, n_tokens, ids, ids_sha256, decoded_sha256."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmark), ("byte bpe", tokens)]
#: The likelihood ratio, signatures and merges are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
