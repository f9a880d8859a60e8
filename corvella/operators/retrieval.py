"""Search over collections and prompts for answers with sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.config import Settings
from corvella.functions.text import citation_label, filled, truncated
from corvella.operators import services, vectors

DEFAULTS = Settings()

TEMPLATES = {
    "en": {
        "system": "Answer from the passages below and from nothing else. Name the source of each statement in brackets, for example [handbook.pdf (Page: 3)]. Say so if the passages hold no answer.",
        "document": "Source $doc_num: $source\nPassage: $chunk_text",
        "footer": "Use only the passages above.\nAnswer in the language of the question.\nQuestion:\n$query\n\nAnswer:",
    },
    "ar": {
        "system": "أجب من المقاطع التالية فقط. اذكر مصدر كل عبارة بين قوسين مثل [handbook.pdf (Page: 3)]. وإن لم تجد الجواب فقل ذلك.",
        "document": "المصدر $doc_num: $source\nPassage: $chunk_text",
        "footer": "استخدم المقاطع أعلاه فقط.\nأجب بلغة السؤال.\nالسؤال:\n$query\n\nالجواب:",
    },
}


def template(lang: str | None, key: str, default: str = DEFAULTS.language) -> str:
    """A template in a language, else in the default one."""
    return TEMPLATES.get((lang or default).strip().lower(), TEMPLATES[default])[key]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def indexed(chunks: DataFrame, embed: str = "hashed", most: int | None = DEFAULTS.input_characters) -> DataFrame:
    """Chunks (chunk_id, chunk_project_id, chunk_text, chunk_metadata) as collection rows; their text is cut to what the service takes."""
    text = truncated(F.col("chunk_text"), most)
    return chunks.select(
        F.col("chunk_id").cast("long").alias("id"), F.col("chunk_project_id").alias("project_key"), F.lit(services.EMBEDDING_SIZE).alias("dim"), text.alias("text"),
        services.embedder(embed)(text, "document").alias("vector"), F.col("chunk_metadata").alias("metadata"), "chunk_id",
    )


def answers(collection: DataFrame, requests: DataFrame, embed: str = "hashed", lang: str = DEFAULTS.language, limit: int = DEFAULTS.search_limit) -> DataFrame:
    """query_id, full_prompt and answer for requests (query_id, query_text): search, prompt and generation."""
    asked = requests.select("query_id", "query_text", services.embedder(embed)(F.col("query_text"), "query").alias("query_vector"))
    hits = vectors.batch_search(collection, asked, limit)
    found = hits.join(collection.select("id", "text", "metadata"), "id").join(requests, "query_id")
    prompts = full_prompts(found.withColumn("source", citation_label(F.col("metadata"))), lang)
    return prompts.withColumn("answer", services.generator("extractive")(F.col("full_prompt")))


def document_prompts(found: DataFrame, lang: str = DEFAULTS.language) -> DataFrame:
    """``found`` (place, source, text) with doc_prompt."""
    return found.withColumn("doc_prompt", filled(template(lang, "document"), doc_num=F.col("place"), source=F.col("source"), chunk_text=F.col("text")))


def full_prompts(found: DataFrame, lang: str = DEFAULTS.language) -> DataFrame:
    """query_id, full_prompt and chat of found passages (query_id, query_text, place, source, text): passages by place, then the question."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "doc_prompt")))
    by_query = document_prompts(found, lang).groupBy("query_id", "query_text").agg(F.array_join(F.transform(ordered, lambda x: x["doc_prompt"]), "\n").alias("documents"))
    prompt = F.concat(F.col("documents"), F.lit("\n\n"), filled(template(lang, "footer"), query=F.col("query_text")))
    return by_query.select("query_id", prompt.alias("full_prompt"), F.array(message("system", F.lit(template(lang, "system"))), message("user", prompt)).alias("chat"))


def responses(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.struct("text", "score", "metadata").alias("result"))
