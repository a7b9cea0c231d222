"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, decontam, exact_dedup, html_text, langid, maxent, packing, prefix_trie, secret_scan, simhash, token_align, toxicity, wordpiece
from tidemark.llm.common import fold, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@_register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents with the public lower-case vocabulary."""
    import public_tokenizers
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_register
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a source stands for an owner, a document for a repository."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), owner_col="source", repo_col="doc_id")
    base = F.filter("spans", lambda s: s["kind_no"] < len(secret_scan.BASE))

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    def listed(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select("doc_id", *[number("kind", k).alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        number("verdict", "live").alias("n_live"), number("verdict", "example").alias("n_example"))


@_register
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents; learned from the rows outside the held-out fold."""
    found = maxent.scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all documents: 3-word shingles, 3 bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@_register
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, by nearest-URL differencing within each host."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


@_register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, lexicon).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_matches")


@_register
def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, top=10)


@_register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@_register
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents, by 13-word windows; changed passages by proximity (drift of 2 words), which
    ``contaminated`` does not count."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), drift=2)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"))


@_register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, by harmonic classes."""
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_register
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and sentence-piece tokens of all documents aligned, with corpus counts of linked pairs."""
    import public_tokenizers
    return token_align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_register
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates, white space aside, among all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt on the first turns of its block of twenty."""
    conv = F.col("conv_id")
    turns = prefix_trie.rebuilt(table(spark, sf_dir, "conversations"), conv - conv % 20, fold("conv_id", 4), most_taken=3)
    return prefix_trie.prefix_trie(turns).drop("words")
