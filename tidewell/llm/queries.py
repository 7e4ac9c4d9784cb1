"""The queries opN_<name> over whole tables, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import knn

    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.dedup(table(spark, sf_dir, "documents"), digests=True).drop("spans")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, 1)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import records

    return records.write_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), digests=True)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def quoting(messages: DataFrame) -> DataFrame:
    """`messages` made to quote, as the table's own don't: by turns, a message quotes the one before it whole with an attribution, that one
    with what it quoted itself (nested), or all but its first line with a line of its own (in part)."""
    from pyspark.sql import functions as F

    said = messages.where("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("t"))
    back = lambda n: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("t").alias(f"p{n}"))
    quote = lambda x: F.concat(F.lit("> "), F.replace(x, F.lit("\n"), F.lit("\n> ")))
    base, wrote, third = F.coalesce("text", F.lit("")), F.lit("On Monday somebody wrote:\n"), F.pmod("turn", F.lit(3))
    nested = quote(F.concat(wrote, quote(F.coalesce("p2", F.lit(""))), F.lit("\n"), "p1"))
    part = F.concat(quote(F.regexp_replace("p1", "^[^\n]*\n", "")), F.lit("\n> as far as I recall"))
    made = F.when(third == 1, F.concat(wrote, quote(F.col("p1")))).when(third == 2, nested).otherwise(part)
    joined = messages.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    return joined.withColumn("text", F.when(F.col("p1").isNull(), F.col("text")).otherwise(F.concat(made, F.lit("\n"), base))).drop("p1", "p2")


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quotes

    return quotes.link(quoting(table(spark, sf_dir, "conversations"))).drop("own")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, keep=["doc_id"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.join(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import licences

    # Documents have no paths: a tree by source, with every seventh document as a licence file that others inherit from.
    place = F.when(F.col("doc_id") % 14 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("doc_id") % 10).cast("string")))
    name = F.when(F.col("doc_id") % 7 == 0, "/LICENSE").otherwise(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/"), "source", place, name).alias("path"))
    return licences.scan(files)


def op11_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of zero have no price for one and never pair, nor do prices and amounts that aren't finite or reach 2^60 cents;
    a null line_no is written as nothing."""
    from pyspark.sql import functions as F

    from . import bands

    def cents(name: str):
        x = F.floor(100 * F.col(name).cast("double") + 0.5)
        return F.when(F.abs(F.col(name)) < 2.0**60 / 100, x)

    written = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    lines = table(spark, sf_dir, "sale_lines").where("quantity <> 0").select("sale_id", F.col("line_no").cast("long").alias("line_no"), "item_id", F.col("quantity").cast("long").alias("q"), cents("amount").alias("a"), F.crc32(written.cast("binary")).alias("check"))
    lines = lines.select("*", F.expr("sign(q)::long * (2 * a + q)").alias("x"), F.expr("2 * abs(q)").alias("y"))
    rows = lines.select(F.expr("(x - pmod(x, y)) div y").alias("at"), F.col("item_id").alias("key"), F.col("sale_id").alias("order1"), F.col("line_no").alias("order2"), "check")
    points = table(spark, sf_dir, "items").select(F.col("item_id").alias("key"), cents("price").alias("at"))
    found = bands.nearest(points, rows, k=5, least=10, share=500)
    names = {"item_id": "key", "rank": "rank", "gap": "gap", "u": "value", "sale_id": "order1", "line_no": "order2", "line_item_id": "row_key", "n_pairs": "n", "gap_sum": "gaps", "lines_crc": "checks"}
    return found.select(*[F.col(b).alias(a) for a, b in names.items()])


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import archives

    found = archives.archived(spark, table(spark, sf_dir, "pages"), least=1000)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import kmeans

    found, centroids = kmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64)
    digests = F.array(*[F.lit(kmeans.digest(c)) for c in centroids] or [F.lit("")])
    return found.withColumn("centroid_sha256", F.element_at(digests, F.col("cluster") + 1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_packing": op3_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_records": op5_token_records,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_price_bands": op11_price_bands,
    "op12_arc_to_warc": op12_arc_to_warc,
    "op13_kmeans": op13_kmeans,
}

ORACLE: dict[str, str] = {
    "op1_topk": oracles.TOPK,
    "op8_quotation_linking": oracles.quoting(),
    "op10_license_scan": oracles.license_scan(),
    "op11_price_bands": oracles.PRICE_BANDS,
    "op12_arc_to_warc": oracles.ARCHIVES,
    "op13_kmeans": oracles.kmeans(),
}
