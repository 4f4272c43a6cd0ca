"""The stateless text operators over streams, and hourly demand with late events. An addition: nothing to match here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import lexicon, nlp


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(doc_id, text, ...) from Parquet files as they arrive; the schema is that of the files already there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clean_english(docs: DataFrame) -> DataFrame:
    """(doc_id, clean, phrases) of documents whose language is found to be English. Works on tables and streams alike."""
    language = nlp.best_language(nlp.language_scores(F.col("text"), lexicon.STOP_WORDS))
    text = C.printable(F.col("text"))
    return docs.filter(language == "en").select("doc_id", C.kea_clean(F.col("text")).alias("clean"), nlp.lda_text_phrases(text, lexicon.LDA_STOP).alias("phrases"))


def hourly_demand(events: DataFrame, entity: str = "event_type", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """(entity, hour, demand): tumbling hours, closed when the watermark has passed."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), F.col(entity).alias("entity")).count()
    return counted.select("entity", F.col("w.start").alias("hour"), F.col("count").alias("demand"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet and stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
